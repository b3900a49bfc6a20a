import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from corvane.functions import vectors
from corvane.operators import embed, knn, match, retrieval
from corvane.plans.catalog import Catalog
from corvane.plans.queries import REGISTRY


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8)).astype("float32")
    x[50] = x[7]  # a duplicate, so that ties are met
    x[51] = 0.0
    group = np.where(np.arange(300) % 3 == 0, 0, np.arange(300) % 20)
    rows = [(i, int(group[i]), x[i].tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, k int, v array<float>").cache()
    return x.astype("float64"), group, df


def brute(x, rows, q, k):
    length = np.linalg.norm(x, axis=1)
    u = np.divide(x, length[:, None], out=np.zeros_like(x), where=length[:, None] > 0)
    d = np.round(1 - u[rows] @ u[q], 9) + 0.0
    order = sorted(range(len(rows)), key=lambda i: (d[i], rows[i]))[:k]
    return [(rows[i], d[i]) for i in order]


def sides(df):
    return (
        df.select("k", F.col("id").alias("query_id"), F.col("v").alias("query_vec")),
        df.select("k", F.col("id").alias("item_id"), F.col("v").alias("item_vec")),
    )


def hits(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.item_id, r.distance))
    return out


@pytest.mark.parametrize("tile", [4096, 23, 64])
def test_exact_search(points, tile):
    x, _, df = points
    q, c = sides(df)
    got = hits(knn.knn(q, c, 5, tile=tile))
    assert len(got) == 300
    for i, found in got.items():
        expected = brute(x, list(range(300)), i, 5)
        assert [a for a, _ in found] == [a for a, _ in expected]
        assert np.allclose([b for _, b in found], [b for _, b in expected], atol=1e-8)


def test_search_within_a_hot_group(points):
    x, group, df = points
    q, c = sides(df)
    got = hits(knn.knn(q, c, 3, keys=["k"], tile=11))
    for i in range(300):
        rows = [j for j in range(300) if group[j] == group[i]]
        assert [a for a, _ in got[i]] == [a for a, _ in brute(x, rows, i, 3)]


def test_lsh_is_a_subset_ranked_exactly(spark, points):
    x, _, df = points
    q, c = sides(df)
    exact = knn.knn(q, c, 5)
    found = knn.knn_lsh(q, c, 5, tables=12, bits=4, tile=50)
    for i, rows in hits(found).items():
        for j, d in rows:
            assert abs(d - brute(x, [j], i, 1)[0][1]) < 1e-8
    share = knn.recall(found, exact).first().recall
    print("recall@5", share)
    assert share > 0.85


def test_recall_on_the_embeddings(spark):
    exact, found = REGISTRY["knn_exact"](spark, SF), REGISTRY["knn_lsh"](spark, SF)
    assert knn.recall(found, exact).first().recall > 0.95


@pytest.mark.parametrize("bits", [4, 8, 12])
def test_recall_stays_as_the_bits_grow(spark, bits):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    c = rows.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("item_vec")).cache()
    q = c.where("item_id % 16 = 0").limit(60).select(F.col("item_id").alias("query_id"), F.col("item_vec").alias("query_vec"))
    share = knn.recall(knn.knn_lsh(q, c, 5, bits=bits), knn.knn(q, c, 5)).first().recall
    print("bits", bits, "rows", c.count(), "recall@5", share)
    assert share >= 0.9


def test_default_bits_keep_the_recall(spark, points):
    q, c = sides(points[2])
    assert knn.recall(knn.knn_lsh(q, c, 5, tile=5), knn.knn(q, c, 5)).first().recall >= 0.9


def test_hash_encoder(spark):
    texts = ["Create a file", "create  A file!", "", "été déjà vu", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.embedding for r in vectors.hash_encode(df.where("t is not null"), "t", dim=64).collect()}
    assert got[0] == got[1] and abs(np.linalg.norm(got[0]) - 1) < 1e-6 and not any(got[2])
    assert sum(v != 0 for v in got[3]) >= 4


def test_each_text_is_encoded_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def encoder(batch):
        seen.add(len(batch))
        assert len(batch) <= 100
        return np.array([[len(t), 1.0] for t in batch])

    df = spark.range(2500).select("id", F.concat(F.lit("Text "), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 250)).alias("t"))
    rows = embed.embed_distinct(df, "t", encoder).collect()
    assert len(rows) == 2500 and all(r.embedding[0] == len(r.t) for r in rows)
    assert seen.value == 250


def test_embedding_of_documents_matches_per_row_encoding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    a = {r.doc_id: r.embedding for r in embed.embed_distinct(docs, "text", dim=32).collect()}
    b = {r.doc_id: r.embedding for r in vectors.hash_encode(docs.withColumn("text", F.lower("text")), "text", dim=32).collect()}
    assert a == b and len(a) == docs.count()


def small_catalog(spark):
    apps = [("slack", "Slack"), ("googlesheet", "Google sheet"), ("jenkins", "Jenkins")]
    objects = [("slack", "RawMessage", "message"), ("googlesheet", "worksheetRow", "row"), ("jenkins", "project", "project"), ("jenkins", "build", "build")]
    ops = [
        ("slack", "RawMessage", "CREATED", "triggers", "New message"),
        ("slack", "RawMessage", "CREATE", "actions", "Send message"),
        ("googlesheet", "worksheetRow", "CREATE", "actions", "Create row"),
        ("googlesheet", "worksheetRow", "UPDATEALL", "actions", "Update rows"),
        ("jenkins", "project", "CREATE", "actions", "Create project"),
        ("jenkins", "build", "CREATED", "triggers", "New build"),
    ]
    a = spark.createDataFrame([(x, y, "flat", None, ["p1"]) for x, y in apps], "app string, display_name string, dialect string, description string, products array<string>")
    o = spark.createDataFrame([(x, y, "flat", z, None) for x, y, z in objects], "app string, object string, dialect string, display_name string, description string")
    o = o.withColumn("summary", F.parse_json(F.lit("{}")))
    p = spark.createDataFrame([(*x, None) for x in ops], "app string, object string, op string, kind string, display_name string, description string")
    from corvane.operators.catalog import rollup_kinds

    return Catalog(a, rollup_kinds(o, p), p)


def test_match_of_request_texts(spark):
    catalog = small_catalog(spark)
    stored = catalog.description_vectors(dim=512)
    requests = [
        (1, "slack", "message", "new message", "triggers", "slack/RawMessage/CREATED"),
        (2, "google sheet", "row", "create row", "actions", "googlesheet/worksheetRow/CREATE"),
        (3, "jenkins", "project", "create", None, "jenkins/project/CREATE"),
        (4, "slack", "slash command", "new", "triggers", "slack/RawMessage/CREATED"),
    ]
    df = spark.createDataFrame(requests, "request_id bigint, app string, object string, op string, kind string, expected string")
    df = match.rewrite_requests(df)
    for level in ("app", "object", "op"):
        df = vectors.hash_encode(df, level, f"{level}_vec", dim=512)
    got = match.match_records(df, stored, catalog.elements, n=2)
    best = {r.request_id: r for r in got.where("rank = 1").collect()}
    for r in requests:
        assert best[r[0]]["op"] == r[5]
        if r[4]:
            assert best[r[0]].kind == r[4]
    first = match.match_records(df, stored, catalog.elements, n=2, dedupe_first=True).where("rank = 1")
    assert {r.request_id: r["op"] for r in first.collect()} == {k: v["op"] for k, v in best.items()}
    assert match.match_records(df, stored, n=2, product="none").count() == 0


def test_rows_cut_before_elements(spark):
    """Two rows of one element may fill the cut; with dedupe_first the elements do."""
    v = [(0, 0, [1.0, 0.0]), (1, 0, [0.99, 0.1]), (2, 1, [0.5, 0.5])]
    stored = spark.createDataFrame([(i, e, None, "app", None, x) for i, e, x in v], "vec_id bigint, element_id bigint, parent_id bigint, typename string, op_types array<string>, embedding array<float>")
    req = spark.createDataFrame([(9, [1.0, 0.0])], "request_id bigint, app_vec array<float>")
    assert {r.element_id for r in match.match_apps(req, stored, 2).collect()} == {0}
    assert {r.element_id for r in match.match_apps(req, stored, 2, dedupe_first=True).collect()} == {0, 1}


def test_hash_encoder_by_hand(spark):
    from hashlib import md5

    texts = ["Alpha beta alpha", "ñandú 日本 42", "", None, "x " * 5000 + "y"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in vectors.hash_encode(df, "t", dim=16).collect():
        words = re.findall(r"[^\W_]+", (r.t or "").lower())
        expected = np.zeros(16)
        for token in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
            code = int(md5(token.encode()).hexdigest()[24:], 16) % 32
            expected[code % 16] += 1 if code < 16 else -1
        length = np.linalg.norm(expected)
        assert np.allclose(r.embedding, expected / length if length else expected, atol=1e-6)


def test_a_word_is_hashed_once_a_task(monkeypatch):
    from hashlib import md5

    hashed, known = [], {}
    monkeypatch.setattr(vectors, "md5", lambda token: hashed.append(token) or md5(token))
    first = vectors.hash_counts("été a été", 16, known)
    assert first.tolist() == vectors.hash_counts("été a été", 16, known).tolist() and abs(first).sum() <= 5
    assert sorted(hashed) == sorted([w.encode() for w in ["été", "a", *["été a", "a été"] * 2]])
    assert not vectors.hash_counts("", 16, known).any() and len(known) == 2


def test_text_cosine(spark):
    df = spark.createDataFrame([(0, "a b c", "A, b; c"), (1, "a", "z"), (2, None, "a"), (3, "", "")], "i int, a string, b string")
    got = {r.i: r.similarity for r in embed.text_cosine(df, "a", "b", dim=1 << 12).collect()}
    assert abs(got[0] - 1) < 1e-6 and got[1] == got[2] == got[3] == 0
    own = embed.text_cosine(df.where("i < 2"), "a", "b", lambda batch: np.array([[len(t), 1.0] for t in batch]))
    assert all(0.7 < r.similarity <= 1 + 1e-9 for r in own.collect())


def test_retrieve_from_text_to_documents(spark):
    calls = spark.sparkContext.accumulator(0)

    def encoder(batch):
        calls.add(len(batch))
        return np.array([[t.count("a") + 1.0, t.count("b"), t.count("c")] for t in batch])

    commands = spark.createDataFrame([("p.a.X", "aaa", "P"), ("p.b.X", "bbb", "P"), ("p.c.X", None, "P"), ("p.b.Y", "bbb", "Q")], "command string, description string, app_display_name string")
    corpus = embed.corpus(commands, encoder).cache()
    assert corpus.count() == 4
    calls.value = 0
    texts = ["bb", "bb", "ccc", None, "", "a"] + ["bbb"] * 300
    test = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "i int, utterances string, rank string").drop("rank")
    for search in ("exact", "cells"):
        got = {}
        for r in retrieval.retrieve(test, corpus, 2, encoder=encoder, search=search).collect():
            got.setdefault(r.i, []).append((r["rank"], r.path, r.document))
        assert set(got) == {i for i, t in enumerate(texts) if t}
        assert sorted(got[0]) == sorted(got[1]) == [(1, "p.b.X", "p.b.X Flow description: bbb"), (2, "p.b.Y", "p.b.Y Flow description: bbb")]
        assert sorted(got[5])[0][1] == "p.a.X" and all(len(v) == 2 for v in got.values())
    assert calls.value <= 2 * 3 * 4  # each distinct text once a job that reads it, not once a row
    assert retrieval.retrieve(test.where("1 = 0"), corpus, 2, encoder=encoder).count() == 0
    with pytest.raises(ValueError):
        retrieval.retrieve(test, corpus, search="unknown")
