"""Every operator on small odd tables against brute force, and the SQL of those that have it."""

import collections
import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from corvane.llm import bpe, decontam, jaccard, langid, linededup, quality, suffix, toxicity, urls, warc
from corvane.llm.common import work_folder
from corvane.llm.oracle import oracle_sql
from corvane.llm.queries import REGISTRY, vocabulary_path

LONG = "alpha beta gamma delta " * 3000
PASSAGE = " ".join(f"passage{i}" for i in range(60))
TEXTS = [
    None, "", " \n\t ", "one", "One two three four five six", "one two three four five six", LONG, LONG,
    PASSAGE + " tail one", "HEAD two " + PASSAGE.upper(), "Größe ñandú 日本語 text!\nshared line\n\nShared Line ",
    *[f"own {i}\nshared line\nlast {i}" for i in range(12)], "<|endoftext|> x<|endoftext|>", "a  b\t\tc \n d ", "ab" * 400,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "row", 1.5) for i, t in enumerate(TEXTS)]
    rows += [(3, "one", "en", "row", 1.5), (3, "one", "en", "row", 1.5), (None, "one two", None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, row string, key double").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("1 = 0")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    df = REGISTRY[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, cursor.fetchall()))


def test_bpe_equals_the_library(spark, docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    odd = [f"a{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)} " for c in range(0x80, 0x3000, 37)]
    table = docs.select("text").unionByName(spark.createDataFrame([(t,) for t in odd], "text string"))
    for r in bpe.encode(table, vocabulary_path(), keep=F.struct("text")).collect():
        assert r.ids == tokenizer.encode(r["row"]["text"] or "", add_special_tokens=False).ids
    encoded = bpe.encode(table, vocabulary_path(), keep=F.struct("text"))
    for r in bpe.decode(encoded, vocabulary_path(), keep=F.col("row")).collect():
        assert r.decoded == (r["row"]["text"] or "")
    assert bpe.digests(none, vocabulary_path()).count() == 0


def test_lines(docs, none):
    counts = collections.Counter()
    rows = docs.collect()
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    for r in rows:
        counts.update({key(x) for x in (r.text or "").split("\n")} - {""})
    expected = []
    for r in rows:
        lines = (r.text or "").split("\n")
        kept = [x for x in lines if not counts[key(x)] >= 10]
        expected.append((r.doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = linededup.drop_lines(docs, "text", min_docs=10, batches=4)
    found = [(r["row"]["doc_id"], r.n_lines, r.n_dropped, r.kept) for r in got.collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, expected)) and counts["shared line"] == 13
    assert linededup.drop_lines(none, "text").count() == 0


def test_line_runs_compact_and_settle(spark):
    runs = linededup.LineRuns(spark, work_folder(spark, "runs"), settle=3, fanout=2)
    for batch in ([1, 2], [1, 2], [1, 3], [1], [1, 2]):
        runs.add(spark.createDataFrame([(k, -k) for k in batch], "h1 bigint, h2 bigint"))
    assert sum(len(level) for level in runs.levels) <= 3
    assert {r.h1 for r in runs.frequent(3).collect()} == {1, 2}


def test_passages(spark, docs, none):
    items = [(1, " ".join(PASSAGE.split()[5:30])), (2, "Alpha, beta; gamma"), (None, "own 3"), (4, None), (5, "!!"), (1, "日本語 text")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(i)
    for block in (1 << 24, 30):
        for r in decontam.scan(docs, F.col("text"), bench, keep=F.struct("doc_id", "text"), block_chars=block).collect():
            w, hit, found = words(r["row"]["text"]), set(), set()
            for n in {len(x) for x in windows}:
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in windows:
                        hit.update(range(k, k + n))
                        found |= windows[tuple(w[k : k + n])]
            assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(hit), sorted(str(i) for i in found if i is not None))
            text = r["row"]["text"] or ""
            assert sum(len(words(text[s.start : s.end])) for s in r.spans) == len(hit)
    assert decontam.scan(none, F.col("text"), bench).count() == 0
    assert decontam.scan(docs, F.col("text"), bench.where("1 = 0")).where("n_hit > 0").count() == 0


def brute_components(rows, percent):
    sets = []
    for r in rows:
        w = lower(r.text).encode().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                label = [label[j] if x == label[i] else x for x in label]
    least = {}
    for r, x in zip(rows, label):
        if r.doc_id is not None:
            least[x] = min(least.get(x, r.doc_id), r.doc_id)
    return sorted(repr((r.doc_id, len(s), least.get(x))) for r, s, x in zip(rows, sets, label))


@pytest.mark.parametrize("hot", [16, 2])
def test_jaccard(spark, docs, none, hot):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    rows = [(100 + i, " ".join(w if rng.random() > rate else f"x{rng.integers(1e6)}" for w in base)) for i, rate in enumerate(np.repeat([0.005, 0.02, 0.05], 14))]
    rows += [(200 + i, " ".join(rng.choice(["a", "b", "c"], rng.integers(1, 12)))) for i in range(60)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = jaccard.link(table, "doc_id", "text", hot=hot).collect()
    assert sorted(repr((r.id, r.n_shingles, r.component)) for r in got) == brute_components(table.collect(), 75)
    if hot == 2:
        assert jaccard.link(none, "doc_id", "text").count() == 0


def test_allocation_reaches_the_weight():
    rng = np.random.default_rng(3)
    for scheme in range(12):
        partitions, deletions = jaccard.allocation(scheme, 75)
        for x in {1 << scheme, (2 << scheme) - 1}:
            tokens = np.unique(rng.integers(0, 1 << 63, x, np.uint64))
            _, weight = jaccard.signatures(tokens, scheme, partitions, deletions)
            assert weight > jaccard.most_different(x, jaccard.largest_partner(x, scheme, 75), 75)


@pytest.mark.parametrize("bucket_bytes", [suffix.BUCKET_BYTES, 500])
def test_suffixes(docs, none, bucket_bytes):
    rows = docs.collect()
    bodies = [(r.text or "").encode() for r in rows]
    counts = collections.Counter(b[i : i + 200] for b in bodies for i in range(len(b) - 199))
    expected = []
    for r, b in zip(rows, bodies):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if counts[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        runs = int((np.diff(np.append(0, gone.astype(int))) > 0).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        expected.append(repr((r.doc_id, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())))
    found = suffix.remaining(suffix.repeats(docs, "text", keep=F.struct("doc_id"), bucket_bytes=bucket_bytes))
    got = [repr((r["row"]["doc_id"], r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in found.collect()]
    assert sorted(got) == sorted(expected)
    assert len({(a - b) % suffix.PERIOD for a in suffix.COVER for b in suffix.COVER}) == suffix.PERIOD
    assert suffix.repeats(none, "text").count() == 0


def test_archives(spark):
    pages = [(i, "http://a.org/\r\n" if i == 2 else f"http://a.org/{i}", h) for i, h in enumerate(["x", "y", None, "x", "", "WARC/1.1\r\n\r\nz", "é" * 9000, "x"])]
    pages += [(1, "http://a.org/1", "y"), (None, None, "x"), (None, "q", "only")]
    table = spark.createDataFrame([(*p, 7) for p in pages], "page_id bigint, url string, html string, record int").repartition(3)
    folder = work_folder(spark, "warc-test")
    warc.write_archive(table, f"{folder}/raw")
    raw = {(r.page_id, bytes(r.payload)) for r in warc.read_archive(spark, f"{folder}/raw", payload=True).collect()}
    assert raw == {(p, (h or "").encode()) for p, _, h in pages}
    for least in (0, 1):
        out = f"{folder}/out{least}"
        warc.deduplicate(spark, f"{folder}/raw", out, f"{folder}/work{least}", least)
        rows = warc.read_archive(spark, out).collect()
        assert len(rows) == len(pages)
        originals = collections.Counter(r.payload_digest for r in rows if r.record_type == "response")
        assert all(n == 1 or d == warc.digest_of(b"") and least for d, n in originals.items())
        assert {r.page_id for r in rows if r.payload_digest == warc.digest_of(b"x") and r.record_type == "revisit" and r.refers_to == 0} == {3, 7, None}
    warc.write_archive(table.where("1 = 0"), f"{folder}/none")
    warc.deduplicate(spark, f"{folder}/none", f"{folder}/none-out", f"{folder}/none-work")
    assert warc.read_archive(spark, f"{folder}/none-out").count() == 0


def test_archives_that_hold_the_same_records(spark, monkeypatch):
    """Record ids repeat: no record is lost or doubled, one response a payload, and every other refers to it."""
    pages = spark.createDataFrame([(i, f"u{i}", t, "x") for i, t in enumerate(["aa", "bb", "bb" * 200_000])], "page_id bigint, url string, html string, record string").coalesce(1)
    folder = work_folder(spark, "warc-twice")
    for k in (1, 2):
        warc.write_archive(pages, f"{folder}/raw/part={k}")
    once = [r.record_id for r in warc.read_archive(spark, f"{folder}/raw").collect()]
    assert len(once) == 6 and len(set(once)) == 3
    for name, most in (("broadcast", 1_000_000), ("shuffle", -1)):
        monkeypatch.setattr(warc, "BROADCAST_DECISIONS", most)
        monkeypatch.setattr(warc, "FILE_BYTES", 1 << 19 if most < 0 else 1 << 26)
        warc.deduplicate(spark, f"{folder}/raw", f"{folder}/{name}", f"{folder}/work-{name}")
        rows = warc.read_archive(spark, f"{folder}/{name}", payload=True).collect()
        kept = {r.page_id: r.record_id for r in rows if r.record_type == "response"}
        assert len(rows) == 6 and set(kept) == {0, 1, 2}
        assert {(r.page_id, r.refers_to, r.refers_to_id) for r in rows if r.record_type == "revisit"} == {(i, i, kept[i]) for i in range(3)}
        assert len({r.record_id for r in rows}) == 6 and max(len(r.payload or b"") for r in rows) == 400_000
        # An archive that was resolved already stays as it is.
        warc.deduplicate(spark, f"{folder}/{name}", f"{folder}/{name}-again", f"{folder}/again-{name}")
        again = warc.read_archive(spark, f"{folder}/{name}-again").drop("file", "at").collect()
        assert sorted(map(repr, again)) == sorted(map(repr, warc.read_archive(spark, f"{folder}/{name}").drop("file", "at").collect()))


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"), "plain": ("", "", None, "allow"), "http://X.Example.org/es/a?b": ("x.example.org", "/es/a", "example.org/es/", "block"),
        "https://a.org": ("a.org", "", None, "allow"), "http://a.net/casino": ("a.net", "/casino", None, "block"), "http://a.net/casinos": ("a.net", "/casinos", None, "allow"),
        "http://a.net/free": ("a.net", "/free", None, "allow"), "http://a.net/Free/win": ("a.net", "/Free/win", None, "block"), "http://a.net/free/free": ("a.net", "/free/free", None, "allow"),
    }
    from corvane.llm.queries import RULES

    table = spark.createDataFrame([(u, 1) for u in cases], "url string, verdict int")
    got = {r["row"]["url"]: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(table, F.col("url"), RULES).collect()}
    assert got == cases
    assert urls.judge(table.where("1 = 0"), F.col("url"), RULES).count() == 0


def test_url_vocabulary_of_a_table(spark):
    rows = [("Kasyno", 2.0), ("tanio", 1.0), ("bonus", 0.5), ("bonus", 1.0), ("never", 0.0), (None, 2.0), ("", 2.0)]
    terms = urls.vocabulary(spark.createDataFrame(rows, "term string, weight double"))
    assert terms == (("kasyno",), ("bonus", "tanio"))
    long = "http://a.net/" + "x" * 300_000 + "/kasyno"
    cases = {"http://kasyno.pl": "block", "http://a.pl/tanio": "allow", "http://a.pl/tanio-bonus": "block", "http://a.pl/casino": "allow", long: "block", "http://a.pl/never": "allow"}
    table = spark.createDataFrame([(u, "x", ["y"]) for u in cases], "url string, row string, strict_terms array<string>")
    got = {r["row"]["url"]: r.verdict for r in urls.judge(table, F.col("url"), (), *terms).collect()}
    assert got == cases
    none = urls.vocabulary(spark.createDataFrame([], "term string, weight double"))
    assert {r.verdict for r in urls.judge(table, F.col("url"), (), *none).collect()} == {"allow"}
    twice = (urls.Rule("a.pl", "/", "allow"), urls.Rule("a.pl", "/", "block"))
    assert {r.verdict for r in urls.judge(table.where("url LIKE '%a.pl%'"), F.col("url"), twice).collect()} == {"allow"}


def test_languages(spark, docs, none):
    rows = REGISTRY["op2_langid"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out) and all(0 <= r.score <= 1 for r in rows)
    model = langid.fit(docs.where("lang IS NOT NULL"), F.col("text"), F.col("lang"))
    got = {r["row"]["text"]: r.lang_pred for r in langid.predict(docs, F.col("text"), model).collect()}
    assert got[None] == got[""] == got[" \n\t "] == "und" and got["one"] == "en"
    assert {r.lang_pred for r in langid.predict(docs, F.col("text"), langid.fit(none, F.col("text"), F.col("lang"))).collect()} == {"und"}


def test_toxicity(spark, docs, none):
    folder = SF.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = REGISTRY["op3_toxicity"](spark, folder).join(labels, "doc_id").where("held_out").collect()
    clean, toxic = ([r for r in got if r.toxic == k] for k in (0, 1))
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean) and sum(r.predicted for r in toxic) >= 0.7 * len(toxic)
    odd = spark.createDataFrame([(1, 1, "x"), (1, 0, "x"), (None, 1, "x"), (4, None, "x"), (2, 0, "x")], "doc_id bigint, toxic int, text string")
    rows = toxicity.labelled(docs, odd, "doc_id", "text", "toxic")
    assert sorted((r.id, r.label) for r in rows.collect()) == [(1, 1), (2, 0)]
    scores = toxicity.score(docs, F.col("text"), toxicity.fit(rows)).collect()
    assert len(scores) == docs.count() and all(0 <= r.score <= 1 for r in scores)
    assert {r.score for r in toxicity.score(docs, F.col("text"), toxicity.fit(toxicity.labelled(none, odd, "doc_id", "text", "toxic"))).collect()} == {0.0}


def test_quality(docs, none):
    blank = re.compile(r"[ \t-\r]+")
    for r in quality.judge(docs, "doc_id", "text", "lang").join(docs.select(F.col("doc_id").alias("id"), "text").distinct(), "id").collect():
        text = r.text or ""
        words = [w for w in blank.split(text) if w]
        windows = collections.Counter(zip(words, words[1:], words[2:]))
        hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if blank.sub("", x)]
        expected = (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (len(words) < 50 or 100 * len(hit) > 50 * len(words)) and not (r.base_failed and r.kept)
    assert quality.judge(none, "doc_id", "text", "lang").count() == 0


def brute_model(texts, order=quality.ORDER):
    """log10 probability of each padded n-gram, by dictionaries; characters are their own classes below 2,048."""
    code = lambda c: ord(c) if ord(c) < 2048 else 2048 + ((ord(c) * 0x9E3779B1 & 0xFFFFFFFF) >> 16) % 2048
    coded = [[0] * (order - 1) + [code(c) for c in (t or "").lower()] for t in texts]
    tables = {order: collections.Counter(tuple(x[i : i + order]) for x in coded for i in range(len(x) - order + 1))}
    for k in range(order - 1, 0, -1):
        tables[k] = collections.Counter(g[1:] for g in tables[k + 1])
    lower = None
    for k in range(1, order + 1):
        times = collections.Counter(tables[k].values())
        d = [0, *quality.discounts(*(times[i] for i in (1, 2, 3, 4)))]
        total, free = collections.Counter(), collections.Counter()
        for g, n in tables[k].items():
            total[g[:-1]] += n
            free[g[:-1]] += d[min(n, 3)]
        lower = {g: (max(n - d[min(n, 3)], 0) + free[g[:-1]] * (lower[g[1:]] if lower else 1 / 4096)) / total[g[:-1]] for g, n in tables[k].items()}
    return lower, coded


def brute_entropies(texts, order=quality.ORDER):
    model, coded = brute_model(texts, order)
    logs = {g: np.log10(max(p, 1e-12)) for g, p in model.items()}
    return [-sum(logs[tuple(x[i : i + order])] for i in range(len(x) - order + 1)) / (len(x) - order + 1) if len(x) >= order else None for x in coded]


@pytest.mark.parametrize("most", [4_000_000, 300, 0])
def test_perplexity_and_bands(spark, monkeypatch, most):
    """All n-grams broadcast, some of them, and none; against dictionaries."""
    monkeypatch.setattr(quality, "HELD_COUNTS", 1000)
    monkeypatch.setattr(quality, "BROADCAST_SUMS", 1_000_000 if most else 0)
    draw = np.random.default_rng(4)
    words = ["".join(draw.choice(list("aeinorst"), draw.integers(2, 7))) for _ in range(60)]
    prose = [" ".join(draw.choice(words, 70)) for _ in range(60)]
    odd = [" ".join("".join(draw.permutation(list(t))).split()) for t in prose[:2]] + ["".join(draw.choice(list("qxzvkjw#ßé"), 6)) + " " for _ in range(1)] * 1
    texts = prose + odd + [None, "", "x", "Größe 日本語 " * 40, prose[0], prose[0]]
    rows = [(i, t, "en" if i % 3 else None, "row", 1, 2) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, row string, h1 int, gram int").repartition(3)
    got = {r.id: r for r in quality.judge(df, "doc_id", "text", "lang", most=most).collect()}
    expected = brute_entropies(texts)
    for i, e in enumerate(expected):
        assert (got[i].entropy is None) == (e is None) and (e is None or abs(got[i].entropy - e) < 1e-5)
        assert e is None or abs(got[i].perplexity - 10**e) < 1e-3 * 10**e
    for name in ("en", "und"):
        mine = [r for r in got.values() if r.lang == name]
        passing = sorted(expected[r.id] for r in mine if not r.base_failed)
        q = [passing[int(np.ceil(x * len(passing))) - 1] for x in (0.25, 0.75)]
        width = max(q[1] - q[0], quality.LEAST_WIDTH)
        for r in mine:
            assert abs(r.low - (q[0] - quality.SPREAD * width)) < 1e-4 and abs(r.high - (q[1] + quality.SPREAD * width)) < 1e-4
            assert r.kept == (not r.base_failed and (r.entropy is None or r.low <= r.entropy <= r.high))
    assert not any(got[60 + k].kept for k in range(2)) and sum(got[i].kept for i in range(60)) >= 58  # shuffled characters


def test_probabilities_of_a_context_sum_to_one(spark):
    texts = ["the cat sat on the mat", "a cat, a rat", "the rat sat"]
    folder = work_folder(spark, "sum")
    grams = quality.count_grams(spark.createDataFrame([(t,) for t in texts], "t string"), F.col("t"))
    model = {r.gram: 10**r.log for r in quality.kneser_ney(grams, folder).collect()}
    unseen = {}
    for g, p in model.items():
        unseen.setdefault(g >> 12, []).append(p)
    # What a context does not have is what its discounts leave to lower orders, less what its own n-grams take of it.
    assert all(0 < sum(p) <= 1 + 1e-6 for p in unseen.values()) and max(sum(p) for p in unseen.values()) > 0.7
    brute, _ = brute_model(texts)
    assert len(brute) == len(model)
    for g, p in brute.items():
        assert abs(model[sum(c << 12 * (quality.ORDER - 1 - i) for i, c in enumerate(g))] - p) < 1e-6

