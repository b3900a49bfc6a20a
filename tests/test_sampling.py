"""Laws of the samplers, and the same results on skewed groups."""

import math
from collections import Counter
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from conftest import SF
from corvane.functions.sampling import gumbel_score, key_digest, uniform_index, unit
from corvane.functions.text import trigger_phrase
from corvane.operators import generation, sampling
from corvane.operators.lemma import Lemmatiser, lemmatise_last, noun_lemmatiser, verb_lemmatiser
from corvane.operators.skew import first_row, number_rows, rows_at, tiled_pairs
from corvane.plans import surrogates
from corvane.plans.catalog import sample_corpus as corpus_of
from corvane.vocab import NOUN_RULES, VERB_RULES


def chi2(observed, expected):
    return sum((o - e) ** 2 / e for o, e in zip(observed, expected))


def skewed(spark, n=3000):
    """A third of the rows in one group."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("k"), "id"
    )


def test_number_rows_on_a_hot_group(spark):
    rows = number_rows(skewed(spark), ["k"], F.md5(F.col("id").cast("string")), ties=["id"], total="n").collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.k, []).append(r)
    assert len(rows) == 3000 and len(groups["hot"]) == 1000
    import hashlib

    for members in groups.values():
        members.sort(key=lambda r: hashlib.md5(str(r.id).encode()).hexdigest())
        assert [r.idx for r in members] == list(range(len(members)))
        assert {r.n for r in members} == {len(members)}


def test_rows_at_reads_the_positions_of_number_rows(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") * 7).alias("v"))
    digest = F.md5(F.col("id").cast("string"))
    order = {r.idx: r.id for r in number_rows(df, [], digest, ties=["id"]).collect()}
    draws = spark.range(300).select(F.col("id").alias("draw"))
    got = rows_at(df, draws, digest, ["id"], uniform_index("__total", "s", "draw"), "draw", prefix=2).collect()
    index = {r.draw: r.i for r in draws.withColumn("n", F.lit(5000)).select("draw", uniform_index("n", "s", "draw").alias("i")).collect()}
    assert len(got) == 300
    for r in got:
        assert r.id == order[index[r.draw]] and r.v == 7 * r.id


def test_first_row_and_caps_keep_their_sizes(spark):
    df = skewed(spark)
    picked = first_row(df, ["k"], [key_digest("s", "id")]).collect()
    assert len(picked) == len({r.k for r in picked}) == df.select("k").distinct().count()
    sizes = Counter(r.k for r in sampling.cap_per(df, ["k"], 100, "s", ["id"]).collect())
    assert sizes["hot"] == 100 and min(sizes.values()) == min(40, *sizes.values())


def test_tiled_pairs_of_a_hot_group(spark):
    rows = [("hot", f"a{i}") for i in range(60)] + [("x", "a1"), ("x", "a2"), ("y", "a3")]
    df = spark.createDataFrame(rows, "bo string, app string")
    got = tiled_pairs(df, "bo", ["app"], F.col("app_a") != F.col("app_b"), tile=7).collect()
    expected = {(k, a, b) for k, a in rows for j, b in rows if k == j and a != b}
    assert len(got) == len(expected) and {(r.bo, r.app_a, r.app_b) for r in got} == expected


def test_weighted_pick_follows_the_weights(spark):
    n = 14000
    items = F.explode(F.array(*[F.struct(F.lit(w).alias("w")) for w in (1.0, 2.0, 4.0)]))
    df = spark.range(n).select(F.col("id").alias("g"), items.alias("i")).select("g", "i.w")
    picked = Counter(r.w for r in sampling.weighted_pick(df, ["g"], F.col("w"), "law", ["g", "w"]).collect())
    weights = [math.exp(w) for w in (1, 2, 4)]
    expected = [n * w / sum(weights) for w in weights]
    assert chi2([picked[w] for w in (1.0, 2.0, 4.0)], expected) < 13.8  # p = 0.001, 2 df


def test_long_texts_do_not_overflow(spark):
    df = spark.range(1).select(gumbel_score(F.lit(5000.0), unit("s", "id")).alias("s"))
    assert 4990 < df.first().s < 5030


def pair_draws(spark, n_left, n_right):
    left = [("t", "trigger", "A", f"l{i}") for i in range(n_left)]
    right = [("t", "action", "B", f"r{i}") for i in range(n_right)]
    df = spark.createDataFrame(left + right, "stream string, role string, app string, command string")
    numbered = sampling.number_draws(df.withColumn("source", F.lit(1)), "app").cache()
    return numbered, sampling.group_table(numbered, "app")


def test_index_pairs_have_the_law_of_the_cross_product(spark):
    """One uniform pair out of 3 x 4: the indices drawn for many seeds, against all pairs being equally likely."""
    n = 12000
    df = spark.range(n).select(F.lit(3).alias("n_t"), F.lit(4).alias("n_a"), F.col("id").cast("string").alias("a"))
    rows = df.select(uniform_index("n_t", "s/left", "a").alias("i"), uniform_index("n_a", "s/right", "a").alias("j")).collect()
    counts = Counter((r.i, r.j) for r in rows)
    assert len(counts) == 12 and chi2(counts.values(), [n / 12] * 12) < 31.3  # p = 0.001, 11 df
    numbered, groups = pair_draws(spark, 3, 4)
    product = {(f"l{i}", f"r{j}") for i in range(3) for j in range(4)}
    for seed in range(5):
        got = sampling.sampled_pairs(numbered, groups, "app", "t", ("trigger", "action"), f"s{seed}", ["command"]).collect()
        assert len(got) == 1 and (got[0].command_t, got[0].command_a) in product


def permuted(n, seed, key, x, y):
    """The rounds of the sampler in Python."""
    pair = [x, y]
    for k in range(sampling.ROUNDS):
        digest = md5(f"{seed}/{k}|{key}|{pair[(k + 1) % 2]}".encode()).hexdigest()
        pair[k % 2] = (pair[k % 2] + int((int(digest[:13], 16) + 0.5) / 2**52 * n)) % n
    return tuple(pair)


@pytest.mark.parametrize("groups,cap", [(1, 5), (2, 3), (3, 20), (31, 250), (85, 250), (100000, 250), (40, None), (0, 7)])
def test_permuted_combinations(spark, groups, cap):
    """Exactly min(cap, n * n) distinct pairs a key, by the same rule at every size."""
    keys = spark.range(20).select(F.col("id").cast("string").alias("k"), F.lit(groups).cast("bigint").alias("__n"))
    got = {}
    for r in sampling.permuted_combinations(keys, "k", cap, "s", ("a", "b")).collect():
        got.setdefault(r.k, []).append((r.a, r.b))
    size = min(cap, groups**2) if cap is not None else groups**2
    assert len(got) == (20 if groups else 0)
    for k, pairs in got.items():
        assert len(set(pairs)) == len(pairs) == size
        assert set(pairs) == {permuted(groups, "s", k, p // groups, p % groups) for p in range(size)}
    if groups == 100000:
        for side in (0, 1):
            mean = sum(p[side] for pairs in got.values() for p in pairs) / (20 * cap) / groups
            assert abs(mean - 0.5) < 0.02


def test_permutation_is_even():
    """Over many keys every pair is drawn about equally often, and so is every pair of drawn pairs."""
    n, keys, cap = 4, 4000, 3
    ones, twos = Counter(), Counter()
    for k in range(keys):
        drawn = [permuted(n, "s", k, p // n, p % n) for p in range(cap)]
        ones.update(drawn)
        twos.update(frozenset(x) for x in ((drawn[0], drawn[1]), (drawn[0], drawn[2]), (drawn[1], drawn[2])))
    assert len(ones) == 16 and chi2(ones.values(), [keys * cap / 16] * 16) < 44  # p about 1e-4, 15 df
    assert len(twos) == 120 and chi2(twos.values(), [keys * 3 / 120] * 120) < 190  # p about 1e-5, 119 df


def test_packed_draw_equals_the_draw_over_rows(spark):
    commands = surrogates.commands(spark, SF)
    utt = generation.utterances(commands, "caps")
    packed = generation.packed_utterances(commands, "caps")
    key = ["command", "source", "description"]
    a = {tuple(r) for r in sampling.sample_descriptions(utt, "9", "2").select(*key).collect()}
    b = {tuple(r) for r in sampling.draw_descriptions(packed, "9", ["2"]).select(*key).collect()}
    assert a == b
    per_command = Counter(x[0] for x in a)
    assert set(per_command.values()) == {1, 2}
    assert set(per_command) == {r.command for r in utt.select("command").distinct().collect()}


def test_resampling_with_replacement_covers_groups(spark):
    rows = sampling.resample_per(skewed(spark), "k", 4, "s", ["id"]).collect()
    assert set(Counter(r.k for r in rows).values()) == {4}
    assert sampling.resample(skewed(spark), 500, "s", ["id"]).count() == 500


def test_types_of_a_tiny_catalog(spark):
    """Samples whose texts can be written down."""
    rows = [
        ("box.file.CREATED", "box", "file", "CREATED", "triggers", "Triggers when issue comes.", "Box", "Files", "New"),
        ("box.file.RETRIEVEALL", "box", "file", "RETRIEVEALL", "actions", "Retrieves it all.", "Box", "Files", "x"),
        ("jira.file.CREATE", "jira", "file", "CREATE", "actions", "Creates it now.", "Jira", "Files", "x"),
    ]
    names = "command app object op kind description app_display_name object_display_name operation_display_name"
    commands = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))
    corpus = generation.sample_corpus(commands, verb_lemmatiser(spark), noun_lemmatiser(spark), "3")
    by_type = {}
    for r in corpus.collect():
        by_type.setdefault(r.type, []).append(r)
    assert set(by_type) == set(range(1, 9))
    assert len(by_type[2]) == 2 and len(by_type[3]) == len(by_type[4]) == 4  # per application pair and triple
    assert {r.commands for r in by_type[5]} == {"for file in box.file.RETRIEVEALL:\n\tjira.file.CREATE"}
    assert {r.utterances for r in by_type[6]} >= {"Sync new Box files with Jira files"}
    assert {r.commands for r in by_type[7]} == {
        "for file in box.file.RETRIEVEALL:\n\tjira.file.CREATE\nbox.file.DELETEALL",
        "for file in jira.file.RETRIEVEALL:\n\tbox.file.CREATE\njira.file.DELETEALL",
    }
    assert {r.utterances for r in by_type[8]} == {"Copy files from Box to Jira", "Copy files from Jira to Box"}
    assert all(len(r.app_list) == 3 for r in by_type[3])
    shuffled = generation.shuffled_corpus(corpus, "1")
    assert shuffled.count() == corpus.count()


def test_trigger_phrases(spark):
    texts = ["Triggers when issue created.", "Specifies the time.", "New records", "New record."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(
        trigger_phrase("t").alias("a"), trigger_phrase("t", compat=True).alias("b"), trigger_phrase("t", specifies=True).alias("c")
    ).collect()
    assert [r.a for r in got] == ["When issue created", "For a specifies the time", "For new records", "For a new record"]
    assert got[0].b == "When ue created"  # the character set eats the start of the next word
    assert got[1].c == "For the time"


def test_lemmatiser(spark):
    nouns = Lemmatiser(spark, ["address", "bus", "box", "entry", "man", "file"], NOUN_RULES, [("men", "man"), ("data", "datum")])
    df = spark.createDataFrame([("Big Boxes",), ("Entries",), ("data",), ("Unknowns",), ("files",)], "n string")
    assert [r.l for r in lemmatise_last(df, "n", "l", nouns).collect()] == ["big box", "entry", "datum", "unknowns", "file"]
    table = spark.createDataFrame([("widget",)], "w string")
    assert Lemmatiser(spark, table, NOUN_RULES).add(df.limit(1), F.lit("widgets"), "l").first().l == "widget"


def test_lemmas_by_lookup_equal_lemmas_by_forms(spark):
    """Both ways over a dictionary table and a table of exceptions, with words outside the built-in lists."""
    dictionary = spark.createDataFrame([(w,) for w in ["gizmo", "Anvil", "fly", "axe", "ax", "die", "box", "carry", "use", "", "us", "be"]], "w string")
    special = spark.createDataFrame([("mice", "mouse"), ("axes", "axis"), ("boxes", "boxen")], "s string, l string")
    words = ["gizmos", "anvils", "flies", "axes", "axed", "dies", "boxes", "mice", "carries", "carrying", "uses", "us", "being", "unknowns", "", None] * 40
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id int, w string")
    for rules in (NOUN_RULES, VERB_RULES):
        ways = [Lemmatiser(spark, dictionary, rules, special, most) for most in (1000, 0)]
        assert ways[0].forms is not None and ways[1].forms is None
        got = [sorted(((r.id, r.l) for r in way.add(df, F.col("w"), "l").collect())) for way in ways]
        assert got[0] == got[1] and len(got[0]) == len(words)
        first = dict(zip(words[:16], [l for _, l in got[0]]))
        assert (first["anvils"], first["flies"], first["mice"], first["axes"], first["boxes"], first["unknowns"], first[None]) == ("anvil", "fly", "mouse", "axis", "boxen", "unknowns", None)


def test_corpus_with_tables_of_words_and_without_caps(spark):
    commands = surrogates.commands(spark, SF).where("app IN ('brand1', 'brand2', 'brand3', 'brand4')")
    verbs = spark.createDataFrame([("retrieve",)], "v string")
    plain = {r.utterances for r in corpus_of(commands, "5", [1]).collect()}
    short = {r.utterances for r in corpus_of(commands, "5", [1], words=6).collect()}
    assert short and all(len(t.split()) >= 6 for t in short) and any(len(t.split()) < 6 for t in plain)
    texts = [r.utterances for r in corpus_of(commands, "5", [2], verbs=verbs).collect()]
    assert any(", creates " in t for t in texts) and not any(", retrieves " in t for t in texts)
    capped = Counter(r.app_list[0] for r in corpus_of(commands, "5", [3], cap=3).collect())
    whole = Counter(r.app_list[0] for r in corpus_of(commands, "5", [3], cap=None).collect())
    assert set(capped.values()) == {3} and set(whole.values()) == {16}


def test_triples_of_more_than_31_groups_are_the_permuted_ones(spark):
    apps = [f"app{i}" for i in range(33)]
    rows = [(s, role, a, f"{a}/{role}", 0) for s in ("x", "y") for role in ("trigger", "action") for a in apps]
    draws = spark.createDataFrame(rows, "stream string, role string, app string, command string, source int")
    numbered = sampling.number_draws(draws, "app")
    groups = sampling.group_table(numbered, "app")
    got = sampling.sampled_triples(numbered, groups, "app", ("x", "y"), ("trigger", "action"), "s", 250, ["command"])
    order = sorted(apps, key=lambda a: (md5(a.encode()).hexdigest(), a))
    expected = []
    for a in apps:
        drawn = [permuted(33, "s/cap", a, p // 33, p % 33) for p in range(250)]
        expected += [(a, order[x], order[y]) for x, y in drawn]
    assert sorted((r.app_t, r.app_a, r.app_b) for r in got.collect()) == sorted(expected)
