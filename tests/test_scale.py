"""What the searches move and call, counted on small tables cut into small tiles; results against plain searches."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvane.functions import fuzzy
from corvane.operators import cells, knn, match


@pytest.fixture()
def counted(spark):
    """Sums over all tiles: calls, rows that go in, and rows that leave."""
    sums = [spark.sparkContext.accumulator(0) for _ in range(3)]
    plain = knn._tile_top

    def tile(left, right, *args):
        out = plain(left, right, *args)
        for total, n in zip(sums, (1, len(left) + len(right), len(out))):
            total.add(n)
        return out

    knn._tile_top = tile
    yield sums
    knn._tile_top = plain


def vectors(spark, n, width=8, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, width))
    x[n // 2 : n // 2 + 40] = x[0]  # copies, so that ties are met across blocks
    rows = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "item_id bigint, item_vec array<double>")
    return x, rows.select(F.col("item_id").alias("query_id"), F.col("item_vec").alias("query_vec")), rows


def expected(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(1 - u @ u.T, 9) + 0.0
    return {q: [int(i) for i in np.lexsort((np.arange(len(x)), d[q]))[:k]] for q in range(len(x))}


def ranked(rows):
    out = {}
    for r in rows.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.item_id)
    return out


def test_small_tiles_share_a_block(spark, counted):
    """A tile is the size of a product: rows travel by blocks, however small the tile."""
    x, q, c = vectors(spark, 1200)
    assert ranked(knn.knn(q, c, 5, tile=20)) == expected(x, 5)
    assert counted[0].value <= 64 and counted[1].value <= 2 * 8 * 1200


def test_blocks_of_a_few_values_keep_the_ties(spark, counted):
    x, q, c = vectors(spark, 500)
    hits = knn.tiled_topk(q, c, 7, [], tile=16, values=8 * 50)
    assert ranked(knn.rank_hits(hits, 7)) == expected(x, 7)
    assert counted[0].value >= 50


def test_limits_leave_only_near_rows(spark):
    x, q, c = vectors(spark, 300)
    near = ranked(knn.rank_hits(knn.tiled_topk(q.withColumn("most", F.when(F.col("query_id") % 2 == 0, F.lit(0.2))), c, 9, [], tile=40, most="most"), 9))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i, rows in expected(x, 9).items():
        assert near[i] == [j for j in rows if i % 2 or round(1 - u[i] @ u[j], 9) <= 0.2]


def test_a_hash_bucket_moves_by_blocks(spark, counted):
    _, q, c = vectors(spark, 1500)
    found = knn.knn_lsh(q, c, 3, tables=2, bits=1, probes=1, tile=50)
    assert ranked(found) == ranked(knn.knn(q, c, 3))
    assert counted[1].value <= 2 * (2 + 1) * 1500 + 2 * 8 * 1500


def test_a_row_travels_once_with_its_buckets_of_all_tables(spark, monkeypatch):
    seen, plain = spark.sparkContext.accumulator(0), knn._tile_shared

    def tile(left, right, *args):
        seen.add(len(left) + len(right))
        return plain(left, right, *args)

    monkeypatch.setattr(knn, "_tile_shared", tile)
    x, q, c = vectors(spark, 600)
    got, exact = ranked(knn.knn_lsh(q, c, 5, tables=4, bits=3, probes=1, tile=200)), expected(x, 5)
    assert 0 < seen.value <= 2 * 3 * 600
    assert sum(len(set(a) & set(exact[i])) for i, a in got.items()) >= 0.9 * 5 * 600


def test_rows_meet_only_in_shared_buckets():
    draw = np.random.default_rng(5)
    x, codes = draw.normal(size=(90, 6)), draw.integers(0, 16, (90, 2))
    rows = {"query_id": np.arange(90), "item_id": np.arange(90), "query_vec": list(x), "item_vec": list(x), "codes": list(codes)}
    frame = pd.DataFrame(rows)
    got = knn._tile_shared(frame, pd.concat([frame, frame]), 4, "codes", 1, 7).groupby("query_id").item_id.agg(set)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(90):
        every = set()
        for t in range(2):
            for bucket in {int(codes[i, t]) ^ f for f in (0, 1, 2, 4, 8)}:
                near = sorted(np.flatnonzero(codes[:, t] == bucket), key=lambda j: (round(1 - u[i] @ u[j], 9), j))
                every |= {int(j) for j in np.repeat(near, 2)[:4]}  # each row is there twice
        assert got[i] == set(sorted(every, key=lambda j: (round(1 - u[i] @ u[j], 9), j))[:4])


@pytest.mark.parametrize("exact", [True, False])
def test_a_query_travels_once_for_each_pack_of_cells(spark, counted, exact):
    """Vectors without clusters: nearly every cell is visited, but no vector is sent to each of them."""
    x, q, c = vectors(spark, 1500, 24)
    index = cells.build_cells(c)
    assert index.centroids.shape[0] >= 35 and set(index.packs) == {0}
    first, _, others = cells._rounds(index, q, 5, exact, None, knn.TILE)
    assert max(first.count(), others.count()) <= 1500
    assert cells.compared_pairs(index, others) > 0.3 * 1500 * 1500
    found = ranked(cells.search_cells(index, q, 5, exact=exact))
    same = sum(len(set(a) & set(found[i])) for i, a in expected(x, 5).items())
    assert same == 5 * 1500 if exact else same >= 0.95 * 5 * 1500
    counts = np.array([3, 3, 9, 1, 1, 0, 4])
    assert cells.pack_cells(counts, 5).tolist() == [0, 0, 1, 3, 3, 3, 3]


def test_blocks_of_cosines_are_bounded(monkeypatch):
    assert [p.stop - p.start for p in cells._parts(3, 2 * cells._BLOCK)] == [1, 1, 1]
    assert max(p.stop - p.start for p in cells._parts(10_000, cells.MOST_CELLS)) * cells.MOST_CELLS <= cells._BLOCK


@pytest.mark.parametrize("dedupe_first", [True, False])
def test_children_beyond_the_bound_stay_in_their_tile(spark, counted, dedupe_first):
    draw = np.random.default_rng(8)
    tree = [(i, None, "app", None) for i in range(5)] + [(5 + i, i % 5, "bo", ["actions"]) for i in range(25)]
    tree += [(30 + i, 5 + i % 25, "op", ["actions"] if i % 3 else None) for i in range(5000)]
    x = draw.normal(size=(len(tree), 16))
    schema = "vec_id bigint, element_id bigint, parent_id bigint, typename string, op_types array<string>, embedding array<double>"
    stored = spark.createDataFrame([(i, i, p, t, kinds, x[i].tolist()) for i, p, t, kinds in tree], schema)
    wanted = spark.createDataFrame([(i, draw.normal(size=16).tolist(), "actions" if i % 4 == 0 else None) for i in range(40)], "request_id bigint, object_vec array<double>, kind string")
    asked = wanted.withColumns({"app_vec": F.col("object_vec"), "op_vec": F.col("object_vec")})
    objects = match.match_objects(asked, match.match_apps(asked, stored, 5, dedupe_first), stored, 5, dedupe_first).localCheckpoint()
    for total in counted:
        total.value = 0
    hits = match.match_ops(asked, objects, stored, 5, dedupe_first).collect()
    assert 0 < counted[2].value <= 40 * (100 + 300)  # not 40 requests x 25 objects x 100 rows
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = {}
    for r in hits:
        found.setdefault(r.query_id, set()).add(r.element_id)
    for r in asked.collect():
        own = {o.element_id for o in objects.collect() if o.query_id == r.request_id}
        rows = [i for i, p, t, kinds in tree if t == "op" and p in own and (r.kind is None or kinds)]
        v = np.array(r.op_vec) / np.linalg.norm(r.op_vec)
        assert found[r.request_id] == set(sorted(rows, key=lambda i: (round(1 - float(u[i] @ v), 9), i))[:100])


def test_window_ratios_of_a_batch(spark, monkeypatch):
    draw = np.random.default_rng(4)
    word = lambda n: "".join(draw.choice(list("abcé日😀 "), n))
    pairs = [(word(a), word(b)) for a in (0, 1, 2, 5, 63, 64, 65, 130) for b in (0, 1, 3, 20, 64, 70, 300) for _ in range(3)]
    single = [fuzzy.best_window_ratio(a, b) for a, b in pairs]
    calls = []
    plain = fuzzy.best_window_ratio
    monkeypatch.setattr(fuzzy, "best_window_ratio", lambda a, b: calls.append(min(len(a), len(b))) or plain(a, b))
    assert fuzzy.best_window_ratios(pairs).tolist() == single and fuzzy.best_window_ratios([]).tolist() == []
    assert all(n == 0 or n > 64 for n in calls)  # none else by itself
    monkeypatch.setattr(fuzzy, "_CELLS", 500)
    assert fuzzy.best_window_ratios(pairs).tolist() == single
