"""Benchmark decontamination: passages of test items in documents, found by Aho-Corasick automata in one pass each.

Texts are normalised to lower-case words (A-Z only) of ``[0-9a-z]`` and all non-ASCII characters. Every window of
``size`` consecutive words of an item (or the whole item, if shorter) is one pattern. Patterns are dealt into automata
of at most ``block_chars`` characters. One automaton is enough for common benchmarks: it is broadcast and scans each text
once. More of them scan the documents one after the other, each made once a worker and released before the next, so that
the driver and a task hold one block at a time; what they find is merged for each text. Hits are mapped back to offsets
in the original text.

Cases: a null text has no words; a text of any length is scanned whole (its words stand in memory); an item without words has no window; items that share an id are one item; windows of
an item with a null id are hits that name no item; repeated documents are judged one by one; ties do not arise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from hashlib import sha256
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import map_rows, stored, work_folder

WINDOW = 10
BLOCK_CHARS = 1 << 24
BROADCAST_TEXTS = 100_000  # texts with hits of several blocks; more of them are joined by a shuffle
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # in texts as they are, before A-Z are lower-cased
_BYTES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).translate(
    bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
)


def words_of(text: str | None) -> list[bytes]:
    """Normalised words of a text as UTF-8."""
    return text.encode("utf-8", "replace").translate(_BYTES).split() if text else []


def _pattern(words: list[bytes]) -> str:
    """Words between single spaces, as one character a byte."""
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def windows(benchmark: DataFrame, item: str, text: str, size: int = WINDOW) -> DataFrame:
    """Distinct patterns with the sorted ids of the items that hold them."""

    def run(batch):
        out = []
        for t in batch["text"]:
            w = words_of(t)
            out.append(sorted({_pattern(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}) if w else [])
        return {"patterns": out}

    named = map_rows(benchmark, run, {"text": F.col(text)}, "patterns array<string>", F.struct(F.col(item).cast("string").alias("item")))
    each = named.select(F.explode("patterns").alias("pattern"), F.col("row.item").alias("item"))
    return each.groupBy("pattern").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _automaton(rows: list[tuple[str, list[str]]]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for pattern, items in rows:
        automaton.add_word(pattern, (len(pattern), pattern.count(" ") - 1, items))
    automaton.make_automaton()
    return automaton


def blocks(patterns: DataFrame, block_chars: int) -> Iterator[list[tuple[str, list[str]]]]:
    """Patterns in lists of at most ``block_chars`` characters (a single longer pattern is a list of its own).

    Rows come one partition at a time and one list stands on the driver at a time; no document does.
    """
    held: list[tuple[str, list[str]]] = []
    size = 0
    for row in patterns.toLocalIterator():
        if held and size + len(row.pattern) > block_chars:
            yield held
            held, size = [], 0
        held.append((row.pattern, list(row["items"])))
        size += len(row.pattern)
    if held:
        yield held


def _ranges(text: str | None, automaton) -> tuple[list[tuple[int, int]], set[str]]:
    """Word numbers [first, end) of the windows that occur, and the items that hold them."""
    joined = _pattern(words) if (words := words_of(text)) else ""
    found = list(automaton.iter(joined)) if joined and len(automaton) else []
    if not found:
        return [], set()
    # Word i of the pattern text starts after space i; ends of matches are the spaces behind their last words.
    spaces = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), np.uint8) == 32)
    last = np.searchsorted(spaces, [end for end, _ in found]).tolist()
    return [(e - n, e) for e, (_, (_, n, _)) in zip(last, found)], {i for _, (_, _, items) in found for i in items}


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _judged(texts: list[str | None], found: list[tuple[list[tuple[int, int]], list[str]]]) -> dict[str, list]:
    """The columns of ``scan`` for texts with their ranges and items."""
    out = {"n_words": [len(words_of(t)) for t in texts], "n_hit": [], "items": [], "spans": []}
    for text, (ranges, items) in zip(texts, found):
        ranges = _merged(ranges)
        places = [m.span() for m in _WORD.finditer(text)] if ranges else []
        out["n_hit"].append(sum(b - a for a, b in ranges))
        out["items"].append(sorted(items))
        out["spans"].append([{"start": places[a][0], "end": places[b - 1][1]} for a, b in ranges])
    return out


_OUT = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:int,end:int>>"


def scan(
    df: DataFrame,
    text: Column | str,
    benchmark: DataFrame,
    item: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    block_chars: int = BLOCK_CHARS,
    keep: Column | None = None,
) -> DataFrame:
    """``row``, ``n_words``, ``n_hit`` (words inside a window's occurrence), ``items`` and ``spans``.

    ``items`` are the sorted ids of the items found; ``spans`` are maximal runs of hit words as (start, end) offsets in
    code points of the original text.
    """
    spark = df.sparkSession
    folder = work_folder(spark, "decontam")
    lists = blocks(stored(windows(benchmark, item, item_text, size), f"{folder}/patterns"), block_chars)
    first, second = next(lists, []), next(lists, None)

    def automaton(shared, state):
        if not state:
            state.append(_automaton(shared.value))
        return state[0]

    if second is None:
        shared = spark.sparkContext.broadcast(first)

        def run(batch, state=[]):  # noqa: B006  the automaton of a worker
            return _judged(batch["text"], [_ranges(t, automaton(shared, state)) for t in batch["text"]])

        return map_rows(df, run, {"text": text}, _OUT, keep)

    # Several blocks: each scans the documents in turn and is released; what is found waits beside its text's key.
    column = F.col(text) if isinstance(text, str) else text
    keys = [F.xxhash64(column).alias("h1"), F.xxhash64(F.lit("second"), column).alias("h2")]
    parts = []
    for number, rows in enumerate(chain([first, second], lists)):
        shared = spark.sparkContext.broadcast(rows)

        def part(batch, state=[], shared=shared):  # noqa: B006
            found = [_ranges(t, automaton(shared, state)) for t in batch["text"]]
            ranges = [[{"first": a, "end": b} for a, b in _merged(r)] for r, _ in found]
            return {"ranges": ranges, "items": [sorted(i) for _, i in found]}

        hits = map_rows(df, part, {"text": column}, "ranges array<struct<first:int,end:int>>, items array<string>", F.struct(*keys))
        hits = hits.where(F.size("ranges") > 0).select("row.*", "ranges", "items").dropDuplicates(["h1", "h2"])
        parts.append(stored(hits, f"{folder}/block-{number}"))
        shared.unpersist()
    both = reduce(DataFrame.unionByName, parts).groupBy("h1", "h2")  # one row a text and block
    hits = both.agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    hits = stored(hits, f"{folder}/hits")
    hits = F.broadcast(hits) if hits.count() <= BROADCAST_TEXTS else hits
    kept = df.select((F.struct("*") if keep is None else keep).alias("kept"), column.alias("text"), *keys).join(hits, ["h1", "h2"], "left")

    def judge(batch):
        found = [([(r["first"], r["end"]) for r in ranges or ()], items or []) for ranges, items in zip(batch["ranges"], batch["items"])]
        return _judged(batch["text"], found)

    inputs = {"text": F.col("text"), "ranges": F.col("ranges"), "items": F.col("items")}
    return map_rows(kept, judge, inputs, _OUT, F.col("kept"))


def digest(items: list[str]) -> str:
    return sha256(",".join(items).encode()).hexdigest()
