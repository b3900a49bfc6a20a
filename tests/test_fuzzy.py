import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF
from corvane.functions import fuzzy
from corvane.functions.fuzzy import _lcs_batch, best_window_ratio
from corvane.operators.generation import mentions_app
from corvane.operators.scoring import _token_distance
from corvane.plans import surrogates
from corvane.plans.queries import REGISTRY


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], (prev + 1 if x == y else max(row[j], row[j - 1]))
    return row[-1]


def brute_edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(prev + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


text = st.text(alphabet="abcé ", max_size=12)


@settings(max_examples=60, deadline=None)
@given(text, text, text)
def test_indel_is_a_metric(a, b, c):
    ab, ba, ac, cb = (len(x) + len(y) - 2 * int(_lcs_batch([x], [y])[0]) for x, y in ((a, b), (b, a), (a, c), (c, b)))
    assert ab == len(a) + len(b) - 2 * brute_lcs(a, b)
    assert ab == ba and ab <= ac + cb and (ab - len(a) - len(b)) % 2 == 0
    assert (ab == 0) == (a == b)


def test_batches_of_mixed_size():
    rng = random.Random(3)
    left = ["".join(rng.choices("abcd", k=rng.choice([0, 1, 5, 300]))) for _ in range(40)]
    right = ["".join(rng.choices("abcd", k=rng.choice([0, 2, 50, 200]))) for _ in range(40)]
    assert _lcs_batch(left, right).tolist() == [brute_lcs(a, b) for a, b in zip(left, right)]


def test_known_values(spark):
    pairs = [("kitten", "sitting", 5), ("", "", 0), ("", "abc", 3), ("same", "same", 0), (None, "x", None)]
    df = spark.createDataFrame(pairs, "a string, b string, d int")
    a, b = F.col("a"), F.col("b")
    got = df.select("d", fuzzy.indel_distance(a, b).alias("udf"), fuzzy.indel_distance_native(a, b).alias("native"), fuzzy.indel_similarity(a, b).alias("s")).collect()
    for r in got:
        assert r.d == r.udf == r.native
    assert got[1].s == 1.0 and abs(got[0].s - (1 - 5 / 13)) < 1e-12


def brute_ratio(a, b):
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    best = 0.0
    for i in range(len(long)):
        window = long[i : i + len(short)]
        best = max(best, 2 * brute_lcs(short, window) / (len(short) + len(window)))
    return int(100 * best + 0.5)


@pytest.mark.parametrize("a,b", [("slack", "send a slack message"), ("gmail", "g mail"), ("abc", "xxab"), ("new rod", "brand23"), ("x", "y")])
def test_partial_ratio(a, b):
    assert best_window_ratio(a, b) == brute_ratio(a, b)


def test_partial_ratio_edges():
    assert best_window_ratio("", "") == 100 and best_window_ratio("", "a") == 0 and best_window_ratio("ab", "zzabzz") == 100


def test_mentions(spark):
    df = spark.createDataFrame([("slack.msg.CREATE", "Post in Slack"), ("box.f.CREATE", " "), ("zendesk.t.CREATE", "Open a page")], "command string, description string")
    assert [r.mentions for r in mentions_app(df).collect()] == [True, False, False]


def test_whole_reply_pairs(spark):
    frame = {(r.conv_id, r.turn): r for r in surrogates.test_frame(spark, SF).collect()}
    got = REGISTRY["indel_reply_pairs"](spark, SF).collect()
    assert len(got) == len(frame)
    for r in got:
        x = frame[(r.conv_id, r.turn)]
        assert r.distance == len(x.utterances) + len(x.commands) - 2 * brute_lcs(x.utterances, x.commands)


def test_token_distances(spark):
    from corvane.operators.scoring import exact_match
    from corvane.functions.text import program_tokens

    rows = exact_match(surrogates.test_frame(spark, SF), distance=True)
    rows = rows.select("distance", "exact", program_tokens(F.col("response")).alias("a"), program_tokens(F.col("label")).alias("b")).collect()
    for r in rows:
        expected = brute_edit(r.a, r.b) / max(len(r.a), len(r.b), 1)
        assert abs(r.distance - expected) < 1e-9 and r.exact == (expected <= 1e-4)
    assert {r.exact for r in rows} == {True, False}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_token_distance_is_edit_distance(a, b):
    assert abs(_token_distance(a, b) - brute_edit(a, b) / max(len(a), len(b), 1)) < 1e-12
