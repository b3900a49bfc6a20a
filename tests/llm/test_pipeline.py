"""Each stage on a small table: what it drops, what it keeps, and the columns it returns."""

import collections
import hashlib
import re

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from conftest import SF
from corvane.llm import toxicity
from corvane.llm.common import CHUNK_CHARS
from corvane.llm.queries import vocabulary_path


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_stages_follow_their_order():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "bpe"]


def test_filtering_stages(spark):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(5, words), (2, words), (2, words), (9, "quite another text of few words"), (4, None), (6, "")]
    rows += [(20 + i, f"line {i}\ncommon\nthe end of {i}") for i in range(12)]
    docs = docs_of(spark, rows)
    near = pipeline.drop_near_duplicates(spark, docs, SF)
    assert near.columns == docs.columns
    assert sorted(r.doc_id for r in near.collect()) == sorted([2, 9, 4, 6, *range(20, 32)])
    lines = pipeline.drop_frequent_lines(spark, docs, SF)
    assert lines.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in lines.collect()}
    assert got[20] == ("line 0\nthe end of 0", 19) and got[4] == (None, 0) and got[9][0].startswith("quite")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    leaked = docs.unionByName(docs_of(spark, [(99, f"before {item} after")]))
    assert sorted(r.doc_id for r in pipeline.drop_contaminated(spark, leaked, SF).collect()) == sorted(r.doc_id for r in docs.collect())
    assert pipeline.drop_near_duplicates(spark, docs.where("1 = 0"), SF).count() == 0


def test_whole_run(spark):
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(pipeline.run(spark, SF).columns)


def test_rows_that_repeat_an_id_are_judged_by_their_texts(spark):
    first, second, third = (" ".join(f"{name}{i}" for i in range(60)) for name in ("one", "two", "three"))
    rows = [(5, first), (5, second), (7, first + " tail"), (8, second + " tail"), (None, third), (None, third + " tail"), (5, second)]
    got = pipeline.drop_near_duplicates(spark, docs_of(spark, rows), SF).select("doc_id", "text").collect()
    assert len(got) == 3
    assert {(r.doc_id, r.text) for r in got} - {(None, third + " tail")} >= {(5, first), (5, second)}
    assert sum(r.doc_id is None for r in got) == 1


def wide(spark, rows):
    """The table of documents with further columns whose names the stages use inside."""
    more = "row string, score double, kept string, items string, rid bigint, again string, at int, h1 bigint, spans string, n_words int"
    base = [(i, t, lang, "s", len(t or "")) for i, t, lang in rows]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + more
    return spark.createDataFrame([(*r, "r", 0.1, "k", "i", 7, "a", 3, 4, "p", 5) for r in base], schema)


def test_stages_keep_other_columns_and_take_empty_tables(spark):
    words = " ".join(f"word{i}" for i in range(60))
    long = " ".join(f"long{i % 5000}" for i in range(60_000))
    docs = wide(spark, [(1, words, "en"), (1, words, "fr"), (1, words, "de"), (2, None, "en"), (3, "", None), (4, long, "en"), (None, "a b", "en")])
    assert len(long) > CHUNK_CHARS
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert stage(spark, docs.where("1 = 0"), SF).count() == 0, name
        if name != "bpe":
            assert out.columns == docs.columns, name
            rows = out.collect()
            assert all((r.row, r.score, r.kept, r["items"], r.rid, r.again, r.at, r.h1, r.spans) == ("r", 0.1, "k", "i", 7, "a", 3, 4, "p") for r in rows)
            assert len(rows) == (5 if name == "near_duplicates" else 7), name
        else:
            assert out.count() == 7


def test_of_rows_equal_in_id_and_text_the_same_one_stays(spark):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, lang) for lang in ("en", "fr", "de", "es", "it")] * 3
    stayed = {tuple(pipeline.drop_near_duplicates(spark, wide(spark, rows).repartition(n, "lang"), SF).collect()) for n in (1, 3, 7)}
    assert len(stayed) == 1 and len(next(iter(stayed))) == 1


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_run(spark, sf):
    """All stages in plain Python; only the scores are those of the fitted classifier."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labelled = toxicity.labelled(docs, spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "text", "toxic")
    scored = toxicity.score(docs, "text", toxicity.fit(labelled)).select("row.doc_id", "row.text", "score").collect()
    rows = [(r.doc_id, r.text) for r in scored if r.score < toxicity.THRESHOLD]

    counts, key = collections.Counter(), lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    for _, text in rows:
        counts.update({key(x) for x in (text or "").split("\n")} - {""})
    lines = [(i, t, [x for x in (t or "").split("\n") if counts[key(x)] < 10]) for i, t in rows]
    rows = [(i, "\n".join(kept) if len(kept) < len((t or "").split("\n")) else t) for i, t, kept in lines]

    words = [lower(t).encode().split() for _, t in rows]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in words]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                label = [label[j] if x == label[i] else x for x in label]
    hashed = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, doc_id bigint, text string")
    rid = dict(hashed.select("n", F.xxhash64("doc_id", "text")).collect())
    groups = collections.defaultdict(list)
    for n, x in enumerate(label):
        groups[x if sets[n] else (n,)].append(n)
    rows = [rows[min(g, key=lambda n: (rows[n][0] is None, rows[n][0] or 0, rid[n]))] for g in groups.values()]

    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    items = [w for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if (w := tokens(r.text))]
    patterns = {x for w in items for x in windows(w, min(10, len(w)))}
    rows = [(i, t) for i, t in rows if not any(windows(tokens(t), n) & patterns for n in {len(x) for x in patterns})]

    tokenizer = Tokenizer.from_file(vocabulary_path())
    ids = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    return [(i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for i, x in ids]


def test_run_equals_brute_force(spark, tmp_path):
    known = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    texts = [" ".join(f"{name}{i}" for i in range(60)) for name in ("one", "two")]
    rows = [(-5, texts[0]), (-5, texts[1]), (-4, texts[0] + " tail"), (-3, texts[1] + " tail"), (-2, None), (-1, ""), (-6, f"before {item} after")]
    rows += [(-20 - i, f"own {i} {i * i}\nCommon line \nthe end of {i}") for i in range(12)]
    docs = known.unionByName(docs_of(spark, rows).select(*[F.col(f.name).cast(f.dataType) for f in known.schema]))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    got = [(r.doc_id, r.n_tokens, r.ids_sha256) for r in pipeline.run(spark, str(tmp_path)).collect()]
    expected = brute_run(spark, str(tmp_path))
    assert sorted(got) == sorted(expected)
    assert {-5: 2, -4: 0, -3: 0, -6: 0} == {i: sum(x[0] == i for x in got) for i in (-5, -4, -3, -6)}
