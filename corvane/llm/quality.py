"""Quality rules: simple counts, and perplexity under an n-gram model with language-specific bands.

The model is an interpolated modified Kneser-Ney model over characters: an n-gram is ``ORDER`` lower-cased characters,
each in 12 bits (the first 2,048 code points have a code of their own, others share 2,048 by a hash), so there are as many
n-grams as the corpus has, and the model grows with it. Spark counts them over every text (sorted arrays merged where rows
are read, one sum by key), and derives the lower orders, discounts and probabilities by aggregates and joins of these
tables; keys that share a context, or a shorter n-gram, are at most 4,096. As the texts that are judged are those that are
counted, each of their n-grams has its probability in the table of the highest order, and no back-off is looked up.

Texts are scored with the most frequent n-grams, at most ``HELD_GRAMS``, in sorted arrays that are broadcast and searched by
bisection. N-grams beyond these are looked up by a join: each distinct text asks once for its distinct ones. The features
and the entropy of every text are stored; the bands of each language are its quartiles stretched by ``SPREAD`` times their
distance, and texts outside are rejected.

Cases: a null text has no words and fails the base rules; a text without characters has no entropy; a null language is
the language ``und``; bands that one document alone defines still keep it, as a band has a least width, and an entropy at
the edge of a band is inside; an empty table gives an empty result; repeated rows are judged alike; a text of any length
is one step of its own, about fifty bytes a character; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import code_points, map_rows, runs_of, stored, work_folder

ORDER = 4
CLASS_BITS = 12
CLASSES = 1 << CLASS_BITS
PLAIN = CLASSES // 2  # code points that have a class of their own
HELD_GRAMS = 4_000_000  # n-grams of 12 bytes that are broadcast
HELD_COUNTS = 1 << 21  # n-grams that a task sums before it lets them go
BROADCAST_SUMS = 1_000_000  # sums of rare n-grams, one a text; more of them are joined by a shuffle
SPREAD = 4.0
LEAST_WIDTH = 0.01  # log10 units a character
LEAST = 1e-12
UNKNOWN = "und"


def _mask(order: int) -> int:
    return (1 << (CLASS_BITS * order)) - 1


def gram_keys(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The key of the n-gram that ends at each character (texts are padded in front by class 0), and the texts' offsets."""
    points, offsets = code_points([t.lower() for t in texts])
    other = PLAIN + ((points * np.uint32(0x9E3779B1)) >> np.uint32(16)) % np.uint32(PLAIN)
    classes = np.where(points < PLAIN, points, other).astype(np.int64)
    number = np.arange(len(classes)) - np.repeat(offsets[:-1], np.diff(offsets))  # of a character in its text
    keys = classes.copy()
    for k in range(1, order):
        before = np.zeros_like(classes)
        before[k:] = classes[:-k]
        keys |= np.where(number >= k, before, 0) << np.int64(CLASS_BITS * k)
    return keys, offsets


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def count_grams(df: DataFrame, text: Column, order: int = ORDER) -> DataFrame:
    """(gram, n) over all texts."""

    def run(batches):
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # sorted runs, merged when the new ones outweigh the first
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            for a, b in runs_of(texts, 1 << 20):
                parts.append(np.unique(gram_keys(texts[a:b], order)[0], return_counts=True))
                if sum(len(k) for k, _ in parts[1:]) > len(parts[0][0]):
                    parts = [_summed(parts)]
                if len(parts[0][0]) > HELD_COUNTS:
                    yield sheet(*_summed(parts))
                    parts = []
        if parts:
            yield sheet(*_summed(parts))
        pa.default_memory_pool().release_unused()

    def sheet(keys, counts):
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=["gram", "n"])

    return df.select(text.alias("text")).mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(n1: float, n2: float, n3: float, n4: float) -> list[float]:
    """Discounts for counts of 1, 2, and 3 or more, by the counts of counts; 0.5, 1, 1.5 where those say nothing."""
    if min(n1, n2, n3) == 0:
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(x, 0.1), top) for x, top in zip(found, (0.9, 1.8, 2.7))]


def kneser_ney(grams: DataFrame, folder: str, order: int = ORDER) -> DataFrame:
    """(gram, n, log): log10 probability of each n-gram's last character after the others.

    Lower orders use the number of distinct characters to the left in place of counts.
    """
    tables = {order: grams}
    for k in range(order - 1, 0, -1):
        shorter = tables[k + 1].groupBy(F.col("gram").bitwiseAND(F.lit(_mask(k))).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        tables[k] = stored(shorter, f"{folder}/counts-{k}")
    below = None
    for k in range(1, order + 1):
        times = [F.sum((F.col("n") == i).cast("bigint")) for i in (1, 2, 3, 4)]
        d1, d2, d3 = discounts(*[x or 0 for x in tables[k].agg(*times).first()])
        context = F.shiftright("gram", CLASS_BITS).alias("context")
        taken = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3).alias("d")
        rows = tables[k].select("gram", "n", context, taken)
        sums = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("d").alias("free"))
        rows = rows.join(sums, "context")
        if below is None:
            rows = rows.withColumn("lower", F.lit(1.0 / CLASSES))
        else:
            rows = rows.withColumn("short", F.col("gram").bitwiseAND(F.lit(_mask(k - 1)))).join(below, "short")
        p = (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) + F.col("free") * F.col("lower")) / F.col("total")
        below = stored(rows.select(F.col("gram").alias("short"), "n", p.alias("lower")), f"{folder}/order-{k}")
        last, below = below, below.drop("n")
    return last.select(F.col("short").alias("gram"), "n", F.log10(F.greatest("lower", F.lit(LEAST))).cast("float").alias("log"))


def frequent(model: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The n-grams whose count reaches a level that at most ``most`` of them reach, and whether these are all."""
    level = F.floor(4 * F.log2("n")).cast("int")
    sizes = sorted(model.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["level"])
    held, least = 0, None  # at most 4 * 63 levels
    for r in sizes:
        if held + r["n"] > most:
            break
        held, least = held + r["n"], r["level"]
    none = F.lit(False) if least is None else level >= least
    return model.where(none), held == sum(r["n"] for r in sizes)


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, characters in words, symbols, repeated lines, words in repeated 3-word windows."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return 0, 0, 0, 0, 0
    solid = raw.translate(None, b" \t\n\x0b\x0c\r")
    chars = len(text) - (len(raw) - len(solid))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    repeated = 0
    if len(times) < len(windows):
        reach = 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, reach)
                reach = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def measure(df: DataFrame, text: Column, held: pa.Table, keep: Column | None = None, order: int = ORDER) -> DataFrame:
    """``row``, the base counts, ``base_failed``, the number of characters, the sum of the log probabilities of the n-grams
    that are ``held``, and ``rest``, the distinct other ones with their counts."""
    table = held.sort_by("gram")
    shared = df.sparkSession.sparkContext.broadcast((table.column("gram").to_numpy(), table.column("log").to_numpy()))

    def run(batch):
        keys, logs = shared.value
        texts = [t or "" for t in batch["text"]]
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        out = {n: list(c) for n, c in zip(names, zip(*map(base_counts, texts)))} if texts else {n: [] for n in names}
        out |= {"n_chars": [], "known": [], "rest": []}
        for a, b in runs_of(texts):
            grams, offsets = gram_keys(texts[a:b], order)
            each, place = np.unique(grams, return_inverse=True)
            at = np.minimum(np.searchsorted(keys, each), max(0, len(keys) - 1))
            found = keys[at] == each if len(keys) else np.zeros(len(each), bool)
            values = np.zeros(len(each))
            values[found] = logs[at[found]]
            total = np.append(0, np.cumsum(values[place]))[offsets]
            out["known"] += np.diff(total).tolist()
            out["n_chars"] += np.diff(offsets).tolist()
            for i in range(b - a):
                rest = Counter(grams[offsets[i] : offsets[i + 1]][~found[place[offsets[i] : offsets[i + 1]]]].tolist()) if not found.all() else {}
                out["rest"].append([{"gram": g, "times": c} for g, c in rest.items()])
        return out

    types = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_chars bigint, known double"
    found = map_rows(df, run, {"text": text}, types + ", rest array<struct<gram:bigint,times:bigint>>", keep)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def with_rest(measured: DataFrame, model: DataFrame, folder: str) -> DataFrame:
    """``known`` with the n-grams that were not held; (h1, h2) is the text, and equal texts ask once."""
    asked = measured.where(F.size("rest") > 0).groupBy("h1", "h2").agg(F.first("rest").alias("rest"))
    each = asked.select("h1", "h2", F.inline("rest"))
    sums = each.join(model.select("gram", "log"), "gram").groupBy("h1", "h2").agg(F.sum(F.col("times") * F.col("log").cast("double")).alias("more"))
    sums = stored(sums, f"{folder}/rest")
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_SUMS else sums
    return measured.join(sums, ["h1", "h2"], "left").withColumn("known", F.col("known") + F.coalesce("more", F.lit(0.0))).drop("more")


def bands(measured: DataFrame, lang: str, spread: float = SPREAD) -> DataFrame:
    """(lang, low, high) of the entropy, from the documents that pass the base rules."""
    q = F.percentile_approx("entropy", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10000)
    found = measured.where(~F.col("base_failed") & F.col("entropy").isNotNull()).groupBy(lang).agg(q.alias("q"))
    width = F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(LEAST_WIDTH))
    return found.select(lang, (F.col("q")[0] - spread * width).alias("low"), (F.col("q")[2] + spread * width).alias("high"))


def judge(
    df: DataFrame, doc_id: str, text: str, lang: str, spread: float = SPREAD, most: int = HELD_GRAMS, order: int = ORDER
) -> DataFrame:
    """id, language, base counts, ``entropy`` (minus the mean log10 probability of a character), ``perplexity``, the band and
    ``kept``.

    The measured rows (a few numbers a document) and the bands are stored, so that every text is scored once.
    """
    folder = work_folder(df.sparkSession, "quality")
    keys = [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")]
    rows = df.select(F.col(doc_id).alias("id"), F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"), *keys)
    model = kneser_ney(stored(count_grams(rows, F.col("text"), order), f"{folder}/grams"), folder, order)
    hot, whole = frequent(model, most)
    measured = measure(rows, F.col("text"), hot.select("gram", "log").toArrow(), F.struct("id", "lang", "h1", "h2"), order)
    measured = stored(measured.select("row.*", *MEASURES, "n_chars", "known", "rest"), f"{folder}/scored")
    if not whole:
        measured = with_rest(measured, model, folder)
    entropy = F.when(F.col("n_chars") > 0, -F.col("known") / F.col("n_chars"))
    measured = stored(measured.select("id", "lang", *MEASURES, entropy.alias("entropy")), f"{folder}/measured")
    limits = stored(bands(measured, "lang", spread), f"{folder}/bands")
    inside = F.coalesce(F.col("entropy").between(F.col("low"), F.col("high")), F.lit(True))
    return measured.join(limits, "lang", "left").withColumns(
        {"perplexity": F.pow(F.lit(10.0), "entropy"), "kept": ~F.col("base_failed") & inside}
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
