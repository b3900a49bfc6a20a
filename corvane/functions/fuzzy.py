"""Insert/delete string distance and partial ratio.

Short strings have a built-in expression; the vectorised functions run a whole Arrow batch of pairs
through one dynamic programme in numpy and take strings of any length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

_CELLS = 4_000_000  # cells of the pair x character matrix worked on at a time
_WORD = 64  # characters of the shorter text that fit one integer
_LONG = 1_000  # pairs with more cells than this are cheaper bit by bit than in a batch


def _codes(texts: list[str], pad: int) -> np.ndarray:
    width = max((len(t) for t in texts), default=0)
    out = np.full((len(texts), width), pad, dtype=np.int32)
    for i, text in enumerate(texts):
        if text:
            out[i, : len(text)] = np.frombuffer(text.encode("utf-32-le"), dtype=np.int32)
    return out


def common_length(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Longest common subsequence of each row pair of two code matrices (pads never match)."""
    best = np.zeros((a.shape[0], a.shape[1] + 1), dtype=np.int32)
    for j in range(b.shape[1]):
        step = best.copy()
        np.maximum(best[:, 1:], best[:, :-1] + (a == b[:, j : j + 1]), out=step[:, 1:])
        np.maximum.accumulate(step, axis=1, out=best)
    return best[:, -1]


def position_masks(items: Sequence) -> dict:
    """Bit set of the positions of every item."""
    masks: dict = {}
    bit = 1
    for item in items:
        masks[item] = masks.get(item, 0) | bit
        bit <<= 1
    return masks


def common_length_bits(a: str, b: str) -> int:
    """The same for one pair of long texts: a row of the table is one integer, its zero bits count the length."""
    if len(a) < len(b):
        a, b = b, a
    masks, full = position_masks(a), (1 << len(a)) - 1
    row = full
    for item in b:
        hit = row & masks.get(item, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _lcs_batch(left: list[str], right: list[str]) -> np.ndarray:
    """LCS length of every pair; short pairs go in batches, in order of size so that padding stays small."""
    out = np.zeros(len(left), dtype=np.int64)
    cells = [len(a) * len(b) for a, b in zip(left, right)]
    for i, size in enumerate(cells):
        if size > _LONG:
            out[i] = common_length_bits(left[i], right[i])
    order = sorted((i for i, size in enumerate(cells) if 0 < size <= _LONG), key=lambda i: len(left[i]) + len(right[i]))
    start = 0
    while start < len(order):
        stop, width = start, 1
        while stop < len(order):
            width = max(width, len(left[order[stop]]) + 1)
            if stop > start and (stop - start + 1) * width > _CELLS:
                break
            stop += 1
        rows = order[start:stop]
        out[rows] = common_length(_codes([left[i] for i in rows], -1), _codes([right[i] for i in rows], -2))
        start = stop
    return out


@F.pandas_udf(IntegerType())
def _indel_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        ok = (a.notna() & b.notna()).to_numpy()
        out = pd.Series([None] * len(a), dtype="Int32")
        left, right = a[ok].tolist(), b[ok].tolist()
        sizes = np.array([len(x) + len(y) for x, y in zip(left, right)], dtype=np.int64)
        out[ok] = (sizes - 2 * _lcs_batch(left, right)).astype("int32") if left else []
        yield out


def best_window_ratio(short: str, long: str) -> int:
    """Best ratio (0..100) of the shorter text against every window of its length in the longer one."""
    if len(short) > len(long):
        short, long = long, short
    m = len(short)
    if m == 0:
        return 100 if not long else 0
    code = np.frombuffer(long.encode("utf-32-le"), dtype=np.int32)
    padded = np.concatenate([code, np.full(m - 1, -2, dtype=np.int32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, m)
    pattern = np.frombuffer(short.encode("utf-32-le"), dtype=np.int32)[None, :]
    sizes = np.minimum(m, len(long) - np.arange(len(long)))
    best, chunk = 0.0, max(1, _CELLS // (m + 1))
    for start in range(0, len(long), chunk):
        block = windows[start : start + chunk]
        common = common_length(np.broadcast_to(pattern, block.shape), block)
        best = max(best, float((2.0 * common / (m + sizes[start : start + chunk])).max()))
    return int(np.floor(100.0 * best + 0.5))


def best_window_ratios(pairs: Sequence[tuple[str, str]]) -> np.ndarray:
    """``best_window_ratio`` of many pairs: the windows of all of them are the rows of one bit-parallel programme."""
    out = np.zeros(len(pairs), dtype=np.int64)
    ordered = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    todo = []
    for i, (short, long) in enumerate(ordered):
        if 0 < len(short) <= _WORD:
            todo.append(i)
        else:
            out[i] = best_window_ratio(short, long)
    todo.sort(key=lambda i: len(ordered[i][0]))  # pairs of about one length share the steps
    start = 0
    while start < len(todo):
        stop, cells = start, 0
        while stop < len(todo):
            cells += len(ordered[todo[stop]][0]) + len(ordered[todo[stop]][1])
            if stop > start and cells * len(ordered[todo[stop]][0]) > _CELLS:
                break
            stop += 1
        rows = todo[start:stop]
        out[rows] = _window_batch([ordered[i] for i in rows])
        start = stop
    return out


def _window_batch(pairs: list[tuple[str, str]]) -> np.ndarray:
    """The same for shorts of one to 64 characters, in order of their length.

    A row of the table is one 64-bit integer a window: bit j is character j of the short, zero bits count the length.
    """
    m = np.array([len(a) for a, _ in pairs])
    size = np.array([len(b) for _, b in pairs])
    most = int(m.max())
    patterns = _codes([a for a, _ in pairs], -1)
    text = np.frombuffer("".join(b for _, b in pairs).encode("utf-32-le"), dtype=np.int32)
    pair = np.repeat(np.arange(len(pairs)), size)
    hit = np.zeros(len(text) + most, dtype=np.uint64)  # characters of the short that equal the one of the long
    for j in range(most):
        hit[: len(text)] |= (patterns[pair, j] == text).astype(np.uint64) << np.uint64(j)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(text))  # characters up to the end of the long
    width = np.minimum(m[pair], left)
    full = (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(_WORD) - m.astype(np.uint64)))[pair]
    row = full.copy()
    for step in range(most):
        match = np.where(step < width, hit[step : step + len(text)], np.uint64(0)) & row
        row = ((row + match) | (row - match)) & full
    common = m[pair] - np.bitwise_count(row)
    ratio = 2.0 * common / (m[pair] + width)
    best = np.maximum.reduceat(ratio, np.cumsum(size) - size)
    return np.floor(100.0 * best + 0.5).astype(np.int64)


@F.pandas_udf(ArrayType(IntegerType()))
def _partial_ratios_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, names in batches:
        pairs: dict[tuple[str, str], int] = {}  # number of each distinct pair
        for text, row in zip(texts, names):
            if text is not None and row is not None:
                for name in row:
                    if name is not None:
                        pairs.setdefault((text, name), len(pairs))
        scores = best_window_ratios(list(pairs)).tolist()
        yield pd.Series([
            None if text is None or row is None else [None if name is None else scores[pairs[text, name]] for name in row]
            for text, row in zip(texts, names)
        ], dtype=object)


def indel_distance(a: Column, b: Column) -> Column:
    """Number of insertions and deletions that turn ``a`` into ``b`` (no substitutions)."""
    return _indel_udf(a, b)


def indel_similarity(a: Column, b: Column, distance: Column | None = None) -> Column:
    """1 - distance / total length; two empty texts are alike."""
    total = F.length(a) + F.length(b)
    d = indel_distance(a, b) if distance is None else distance
    return F.when(total == 0, F.lit(1.0)).otherwise(F.lit(1.0) - d / total)


def indel_distance_native(a: Column, b: Column) -> Column:
    """The same distance as a built-in expression; best for short strings in a plan without Python."""
    chars_a = F.filter(F.split(a, ""), lambda c: c != "")
    chars_b = F.filter(F.split(b, ""), lambda c: c != "")
    zeros = F.transform(chars_a, lambda _: F.lit(0))
    # State per character of b: the LCS row over a; inner state: (row so far, diagonal cell).
    def next_row(row: Column, ch: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("row"), F.lit(0).alias("diag"), F.lit(0).alias("left"))
        cells = F.arrays_zip(chars_a.alias("c"), row.alias("up"))

        def cell(acc: Column, x: Column) -> Column:
            value = F.when(x["c"] == ch, acc["diag"] + 1).otherwise(F.greatest(acc["left"], x["up"]))
            return F.struct(
                F.concat(acc["row"], F.array(value)).alias("row"), x["up"].alias("diag"), value.alias("left")
            )

        return F.aggregate(cells, start, cell)["row"]

    last = F.aggregate(chars_b, zeros, next_row)
    lcs = F.coalesce(F.try_element_at(last, F.lit(-1)), F.lit(0))
    return F.length(a) + F.length(b) - 2 * lcs


def partial_ratio(a: Column, b: Column) -> Column:
    """Score 0..100 of the best window of the longer text against the shorter."""
    return F.try_element_at(_partial_ratios_udf(a, F.array(b)), F.lit(1))


def partial_ratios(text: Column, names: Column) -> Column:
    """Partial ratio of a text against every name of an array."""
    return _partial_ratios_udf(text, names)
