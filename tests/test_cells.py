"""The cell index: exact with the triangle inequality, recall and compared pairs without it, salts and packed tiles."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvane.operators import cells, knn
from corvane.operators.skew import hot_keys, rows_at, salted_join


def frame(spark, x, name):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, f"{name}_id bigint, {'item' if name == 'item' else 'query'}_vec array<double>")


def clustered(n, width, groups, spread, seed=0):
    draw = np.random.default_rng(seed)
    return draw.normal(size=(groups, width))[draw.integers(0, groups, n)] + spread * draw.normal(size=(n, width))


def as_queries(items, every):
    return items.where(F.col("item_id") % every == 0).select(F.col("item_id").alias("query_id"), F.col("item_vec").alias("query_vec"))


def searched(index, queries, k, **options):
    first, _, others = cells._rounds(index, queries, k, options.get("exact", False), None, knn.TILE)
    pairs = cells.compared_pairs(index, first.unionByName(others).cache())
    return cells.search_cells(index, queries, k, **options), pairs


@pytest.mark.parametrize("spread", [0.3, 1.0])
def test_clustered_rows_are_found_among_few(spark, spread):
    x = clustered(4000, 32, 40, spread)
    items = frame(spark, x, "item").cache()
    queries = as_queries(items, 100)
    exact = knn.knn(queries, items, 5)
    found, pairs = searched(cells.build_cells(items), queries, 5)
    assert knn.recall(found, exact).first().recall >= 0.97
    assert pairs < 0.2 * 40 * 4000


def test_exact_cells_equal_the_exact_search(spark):
    x = clustered(900, 12, 9, 0.8)
    x[5] = x[6] = x[7]  # ties
    x[8] = 0
    items = frame(spark, x, "item").unionByName(spark.createDataFrame([(5000, None)], "item_id bigint, item_vec array<double>")).cache()
    queries = as_queries(items, 10).unionByName(spark.createDataFrame([(6000, None)], "query_id bigint, query_vec array<double>"))
    for wanted in (None, 1, 60):
        found = cells.search_cells(cells.build_cells(items, wanted, sample=300), queries, 7, exact=True)
        a = sorted(tuple(r) for r in found.select("query_id", "item_id", "distance", "rank").collect())
        b = sorted(tuple(r) for r in knn.knn(queries.where("query_vec is not null"), items.where("item_vec is not null"), 7).select("query_id", "item_id", "distance", "rank").collect())
        assert a == b


def test_recall_of_every_hundredth_row_against_all(spark):
    """The given vectors have no clusters, so that little can be left out."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    items = rows.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("item_vec")).cache()
    queries = as_queries(items, 100)
    found, pairs = searched(cells.build_cells(items), queries, 5)
    share = knn.recall(found, knn.knn(queries, items, 5)).first().recall
    print("recall@5", share, "compared", pairs / (queries.count() * items.count()))
    assert share >= 0.9 and pairs < queries.count() * items.count()


def test_bound_covers_every_row_of_a_cell():
    x = clustered(3000, 16, 20, 0.7)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centroids = cells.fit_centroids(x[:500], 20)
    cosines = x @ centroids.T
    cell, cosine = cosines.argmax(axis=1), cosines.max(axis=1)
    near = np.array([cosine[cell == c].max(initial=-1) for c in range(20)])
    far = np.array([cosine[cell == c].min(initial=1) for c in range(20)])
    bound = cells.best_cosine(cosines[:50], near, far, 1.0)
    real = x[:50] @ x.T
    assert (bound[:, cell] >= real - 1e-9).all()


def test_empty_tables(spark):
    none = frame(spark, clustered(3, 4, 1, 1), "item").where("1 = 0")
    some = frame(spark, clustered(9, 4, 2, 1), "item")
    assert cells.search_cells(cells.build_cells(some), as_queries(none, 1), 3).count() == 0
    assert cells.search_cells(cells.build_cells(none), as_queries(some, 1), 3).count() == 0


def test_salts_grow_with_the_key(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") < 1500, "hot").when(F.col("id") < 2100, "warm").otherwise(F.concat(F.lit("c"), F.col("id"))).alias("k"))
    assert {r.k: r["__salts"] for r in hot_keys(df, ["k"], 100).collect()} == {"hot": 15, "warm": 6}
    assert hot_keys(df, ["k"]).count() == 0
    small = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for rows in (100, 1 << 20):
        joined = salted_join(df, small, ["k"], ["id"], rows)
        assert sorted((r.id, r.n) for r in joined.collect()) == [(i, 1500 if i < 1500 else 600 if i < 2100 else 1) for i in range(4000)]


def test_small_groups_share_python_calls(spark):
    """Thousands of groups of a few rows: calls in proportion to rows, and every group searched on its own."""
    calls = spark.sparkContext.accumulator(0)
    plain = knn._tile_top

    def counted(*args):
        calls.add(1)
        return plain(*args)

    x = clustered(6000, 8, 5, 1.0)
    items = frame(spark, x, "item").withColumn("k", F.col("item_id") % 2000)
    queries = as_queries(items, 2).withColumn("k", F.col("query_id") % 2000)
    knn._tile_top = counted
    try:
        got = knn.knn(queries, items, 2, keys=["k"], tile=1000).collect()
    finally:
        knn._tile_top = plain
    assert calls.value < 40 and len(got) == 6000
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    best = pd.DataFrame([tuple(r) for r in got], columns=["q", "i", "d", "rank"])
    for q, rows in best.groupby("q"):
        group = [j for j in range(6000) if j % 2000 == q % 2000]
        order = sorted(group, key=lambda j: (round(1 - x[q] @ x[j], 9) + 0.0, j))[:2]
        assert list(rows.sort_values("rank").i) == order


def test_many_draws_are_placed_without_one_task(spark):
    df = spark.range(50).select("id", (F.col("id") * 3).alias("v"))
    draws = spark.range(200_000).select(F.col("id").alias("draw"))
    got = rows_at(df, draws, F.md5(F.col("id").cast("string")), ["id"], F.col("draw") % 50, "draw")
    counts = got.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.col("draw") % 50).alias("places")).collect()
    assert len(counts) == 50 and all((r.n, r.places) == (4000, 1) for r in counts)
    plan = got._jdf.queryExecution().executedPlan().toString()
    single = [line for line in plan.splitlines() if "SinglePartition" in line]
    assert all("__head" in line or "partial_count" in plan for line in single) and "Window" in plan
    assert not any("draw" in line for line in single)
    none = rows_at(df.where("1 = 0"), draws, F.md5(F.col("id").cast("string")), ["id"], F.lit(0).cast("bigint"), "draw")
    assert none.count() == 0
