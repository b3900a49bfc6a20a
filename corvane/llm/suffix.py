"""Removal of long repeated byte strings, by suffix buckets and difference-cover samples.

Two equal strings of ``LENGTH`` bytes, wherever they stand in their texts, have a common offset below the period of a
difference cover at which both texts are sampled. So only sampled positions (9 % of all) are compared over the whole
corpus: the samples of equal strings get one rank (a hash of the bytes that every window leaves behind the offset), and
ranks that one text alone has, once, are dropped. A suffix whose first ``LENGTH`` bytes hold no sample with a shared rank
ties with no other, so it is never sorted. The others go to suffix buckets by their smallest 8-gram hash, which equal
suffixes share and neighbours mostly do, so that neighbours travel as one piece of text; each bucket is sorted by
itself, with 128-bit hashes of the first ``LENGTH`` bytes in place of the bytes, and its ties are returned as runs of
positions. Only ties matter, so ranks need no alphabetical order. A bucket beyond ``BUCKET_BYTES`` is spread over the
cluster suffix by suffix instead, so memory is bounded whatever the texts share.

Equal texts are one class: one stands for all, and all their bytes repeat if they are long enough.

Cases: a null text is empty; texts shorter than ``LENGTH`` lose nothing; overlaps within a text count; rows that repeat
are equal texts; an empty table gives an empty result; other columns pass through or are not looked at.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import map_rows, parts_of, stored, work_folder
from corvane.llm.jaccard import mix

LENGTH = 200
#: Every residue modulo 133 is a difference of two of these (a perfect difference set).
PERIOD, COVER = 133, (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
GRAM = 8
BROADCAST_ROWS = 1_000_000  # row keys of 8 bytes
CHUNK_BYTES = 1 << 20
BUCKET_BYTES = 1 << 23  # what a task sorts of one bucket at a time


class Roller:
    """Polynomial hashes of all substrings of a byte array, modulo 2**64, over a random value for each byte."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 1 << 64, 256, np.uint64)
        self.base = int(rng.integers(0, 1 << 62)) * 8 + 5
        self.powers = self.inverses = np.ones(1, np.uint64)

    def load(self, data: np.ndarray) -> None:
        if len(self.powers) < len(data):
            self.powers = np.full(len(data) + 1, np.uint64(self.base % (1 << 64)))
            self.inverses = np.full(len(data) + 1, np.uint64(pow(self.base, -1, 1 << 64)))
            self.powers[0] = self.inverses[0] = 1
            np.multiply.accumulate(self.powers, out=self.powers)
            np.multiply.accumulate(self.inverses, out=self.inverses)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=self.sums[1:])

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        return mix((self.sums[starts + length] - self.sums[starts]) * self.inverses[starts])


def text_slices(texts: list[bytes]):
    """(first, last) of slices of about ``CHUNK_BYTES`` bytes."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, len(texts)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _sampled(size: int, length: int) -> np.ndarray:
    """Sampled positions of a text whose sample has all its bytes."""
    reach = length - PERIOD + 1
    at = (np.arange(0, size, PERIOD)[:, None] + np.array(COVER)).ravel()
    return at[at + reach <= size]


def _samples(rows: DataFrame, length: int) -> DataFrame:
    """(rank, class) of each distinct sample of each class; the lowest bit of class says that the text has it twice."""
    reach = length - PERIOD + 1
    roller = (11,)

    def run(batches):
        roll, seen = Roller(*roller), set()
        for batch in parts_of(batches):
            texts, classes = [], []
            for body, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if c not in seen:
                    texts.append(body)
                    classes.append(c)
                    seen.add(c)
            for a, b in text_slices(texts):
                roll.load(np.frombuffer(b"".join(texts[a:b]), np.uint8))
                ranks, owners, begin = [], [], 0
                for body, c in zip(texts[a:b], classes[a:b]):
                    at = _sampled(len(body), length)
                    if len(at):
                        h, n = np.unique(roll.at(begin + at, reach), return_counts=True)
                        ranks.append(h.view(np.int64))
                        owners.append(np.int64(c & ~1) | (n > 1))
                    begin += len(body)
                if ranks:
                    columns = [pa.array(np.concatenate(x), pa.int64()) for x in (ranks, owners)]
                    yield pa.RecordBatch.from_arrays(columns, names=["rank", "class"])
            if len(seen) > 1 << 20:
                seen.clear()

    return rows.mapInArrow(run, "rank bigint, class bigint")


def _runs_of_equal(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before."""
    fresh = np.ones(len(columns[0]), bool)
    if len(fresh) > 1:
        fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return fresh


def _by_group(batches, names: int, handle):
    """Feed ``handle`` sorted columns in pieces that never cut a group of equal first values."""
    tail = None
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(names)]
        if tail is not None:
            columns = [np.concatenate(x) for x in zip(tail, columns)]
        cut = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0
        yield from handle(*[c[:cut] for c in columns])
        tail = [c[cut:] for c in columns]
    if tail is not None:
        yield from handle(*tail)


def _shared(samples: DataFrame) -> DataFrame:
    """(class, rank) of the ranks that two classes have, or one class twice."""

    def run(batches):
        def handle(rank, owner):
            if not len(rank):
                return
            twice, owner = (owner & 1) > 0, owner & ~np.int64(1)
            starts = np.flatnonzero(_runs_of_equal(rank))
            sizes = np.diff(np.append(starts, len(rank)))
            several = (np.maximum.reduceat(owner, starts) != np.minimum.reduceat(owner, starts)) | np.logical_or.reduceat(twice, starts)
            live = np.repeat(several, sizes) & _runs_of_equal(rank, owner)
            if live.any():
                yield pa.RecordBatch.from_arrays([pa.array(owner[live]), pa.array(rank[live])], names=["class", "rank"])

        yield from _by_group(batches, 2, handle)

    return samples.repartition("rank").sortWithinPartitions("rank", "class").mapInArrow(run, "class bigint, rank bigint")


def _segments(texts: DataFrame, length: int) -> DataFrame:
    """(bucket, class, low, data): the suffixes that hold a shared sample in their first ``length`` bytes.

    Neighbouring suffixes of one bucket travel as one segment: ``data`` starts at byte ``low`` of the text and holds the
    first bytes of all of them, so that a suffix costs about three bytes.
    """
    reach = length - PERIOD + 1

    def run(batches):
        first, second = Roller(11), Roller(12)
        rows, held = [], 0
        for batch in parts_of(batches, 100):
            for body, c, live in zip(*(x.to_pylist() for x in batch.columns)):
                data = np.frombuffer(body, np.uint8)
                windows = len(data) - length + 1
                if windows < 1:
                    continue
                first.load(data)
                at = _sampled(len(data), length)
                good = at[np.isin(first.at(at, reach).view(np.int64), np.array(live, np.int64))]
                change = np.zeros(windows + 1, np.int32)
                np.add.at(change, np.maximum(good - PERIOD + 1, 0), 1)
                np.add.at(change, np.minimum(good + 1, windows), -1)
                starts = np.flatnonzero(np.cumsum(change[:windows]) > 0)
                if not len(starts):
                    continue
                second.load(data)
                grams = second.at(np.arange(len(data) - GRAM + 1), GRAM)
                bucket = sliding_min(grams, length - GRAM + 1)[starts].view(np.int64)
                begin = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (starts[1:] != starts[:-1] + 1)))
                end = np.append(begin[1:], len(starts)) - 1
                for k, low, high in zip(bucket[begin].tolist(), starts[begin].tolist(), starts[end].tolist()):
                    rows.append((k, c, low, body[low : high + length]))
                    held += high - low + length
                if held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["bucket", "class", "low", "data"])
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["bucket", "class", "low", "data"])

    return texts.mapInArrow(run, "bucket bigint, class bigint, low bigint, data binary")


def _tied(h, more, owner, at):
    """Runs (class, low, high) of the positions whose hashes another position has as well."""
    order = np.lexsort((at, owner, more, h))
    h, more, owner, at = h[order], more[order], owner[order], at[order]
    fresh = _runs_of_equal(h, more, owner, at)  # a class may have gone through two tasks
    h, more, owner, at = h[fresh], more[fresh], owner[fresh], at[fresh]
    new = _runs_of_equal(h, more)
    tied = ~(new & np.append(new[1:], True))
    owner, at = owner[tied], at[tied]
    order = np.lexsort((at, owner))
    owner, at = owner[order], at[order]
    begin = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1))) if len(at) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(at)) - 1 if len(at) else begin
    return owner[begin], at[begin], at[end]


def _sorted_buckets(segments: DataFrame, length: int, bucket_bytes: int) -> DataFrame:
    """(class, low, high, h, more): runs of tied positions, bucket by bucket.

    A bucket of more than ``bucket_bytes`` (a passage of very many texts) is not sorted here: its suffixes are returned
    one by one with their hashes, for a shuffle that spreads them.
    """
    columns = ("class", "low", "high", "h", "more")

    def table(*values):
        filled = [pa.nulls(len(values[0]), pa.int64()) if v is None else pa.array(v.astype(np.int64)) for v in values]
        return pa.RecordBatch.from_arrays(filled, names=columns)

    def run(batches):
        first, second = Roller(11), Roller(12)

        def hashed(rows):
            data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
            sizes = np.array([len(r[3]) for r in rows], np.int64)
            counts = sizes - length + 1
            place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            starts = place + np.repeat(np.cumsum(sizes) - sizes, counts)
            first.load(data)
            second.load(data)
            owner = np.repeat(np.array([r[1] for r in rows], np.int64), counts)
            at = place + np.repeat(np.array([r[2] for r in rows], np.int64), counts)
            return first.at(starts, length).view(np.int64), second.at(starts, length).view(np.int64), owner, at

        def opened(rows):
            h, more, owner, at = hashed(rows)
            return table(owner, at, None, h, more)

        whole, held, open_, size, wide, last = [], 0, [], 0, False, None
        for batch in parts_of(batches, 2000):
            for row in zip(*(x.to_pylist() for x in batch.columns)):
                if row[0] != last:
                    if wide and open_:
                        yield opened(open_)
                    elif not wide:
                        whole += open_
                        held += size
                    open_, size, wide, last = [], 0, False, row[0]
                    if held > 1 << 20:
                        yield table(*_tied(*hashed(whole)), None, None)
                        whole, held = [], 0
                open_.append(row)
                size += len(row[3])
                if size > (1 << 20 if wide else bucket_bytes):
                    yield opened(open_)
                    open_, size, wide = [], 0, True
        if wide and open_:
            yield opened(open_)
        elif not wide:
            whole += open_
        if whole:
            yield table(*_tied(*hashed(whole)), None, None)

    rows = segments.repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(run, ", ".join(f"{c} bigint" for c in columns))


def _ties(segments: DataFrame, length: int, folder: str, bucket_bytes: int) -> DataFrame:
    """(class, low, high): runs of positions whose suffixes tie with another over the first bytes."""
    found = stored(_sorted_buckets(segments, length, bucket_bytes), f"{folder}/buckets")
    wide = found.where("h IS NOT NULL").select("h", "more", "class", F.col("low").alias("at")).distinct()
    shared = wide.groupBy("h", "more").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(shared.select("h", "more"), f"{folder}/wide")
    tied = wide.join(shared, ["h", "more"]).select("class", F.col("at").alias("low"), F.col("at").alias("high"))
    return found.where("h IS NULL").select("class", "low", "high").unionByName(tied)


def _few(df: DataFrame) -> DataFrame:
    """A broadcast hint behind a count of the rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def repeats(
    df: DataFrame, text: str, length: int = LENGTH, keep: Column | None = None, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """``row``, ``n_bytes``, and ``spans``: the maximal runs of bytes covered by strings of ``length`` bytes that start
    anywhere else as well, as (start, end)."""
    if length < PERIOD + GRAM:
        raise ValueError(f"strings of at least {PERIOD + GRAM} bytes are asked for")
    folder = work_folder(df.sparkSession, "suffix")
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    group = F.xxhash64(body).bitwiseAND(F.lit(-2).cast("bigint"))
    row = F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.struct("*"))
    long_ones = df.where(F.octet_length(text) >= length)
    classes = long_ones.select(group.alias("class"), row.alias("rid")).groupBy("class").agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("n"))
    classes = stored(classes, f"{folder}/classes")
    shared = stored(_shared(_samples(long_ones.select(body.alias("body"), group.alias("class")), length)), f"{folder}/shared")
    live = shared.groupBy("class").agg(F.collect_list("rank").alias("live"))
    live = stored(live.join(classes, "class").select("class", "rid", "live"), f"{folder}/live")
    named = long_ones.select(row.alias("rid"), body.alias("body"))
    chosen = named.join(_few(live.select("rid")), "rid", "left_semi").join(live, "rid").select("body", "class", "live")
    ties = _ties(_segments(chosen, length), length, folder, bucket_bytes)
    spans = ties.groupBy("class").agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    found = classes.where("n > 1").select("class", "n").join(spans, "class", "full")
    found = stored(found.select("class", (F.col("n") > 1).alias("copied"), "runs"), f"{folder}/found")
    shaped = df.select((F.struct("*") if keep is None else keep).alias("row"), body.alias("body"), group.alias("class"))
    joined = shaped.join(found, "class", "left")

    def run(batch):
        out = {"n_bytes": [], "spans": []}
        for data, copied, runs in zip(batch["body"], batch["copied"], batch["runs"]):
            n = len(data)
            out["n_bytes"].append(n)
            if copied and n >= length:
                out["spans"].append([{"start": 0, "end": n}])
                continue
            spans = []
            for low, high in sorted((r["low"], r["high"]) for r in runs or ()):
                if spans and low <= spans[-1]["end"]:
                    spans[-1]["end"] = max(spans[-1]["end"], high + length)
                else:
                    spans.append({"start": low, "end": high + length})
            out["spans"].append(spans if n >= length else [])
        return out

    inputs = {c: F.col(c) for c in ("body", "copied", "runs")}
    types = "n_bytes bigint, spans array<struct<start:bigint,end:bigint>>"
    return map_rows(joined, run, inputs, types, F.struct("row", "body")).select("row.row", "row.body", "n_bytes", "spans")


def remaining(df: DataFrame) -> DataFrame:
    """Rows of ``repeats`` with ``n_removed``, ``n_spans`` and the SHA-256 of the bytes that stay."""

    def run(batch):
        out = {"n_removed": [], "n_spans": [], "kept_sha256": []}
        for data, spans in zip(batch["body"], batch["spans"]):
            at, digest = 0, sha256()
            for s in spans:
                digest.update(data[at : s["start"]])
                at = s["end"]
            digest.update(data[at:])
            out["n_removed"].append(sum(s["end"] - s["start"] for s in spans))
            out["n_spans"].append(len(spans))
            out["kept_sha256"].append(digest.hexdigest())
        return out

    types = "n_removed bigint, n_spans bigint, kept_sha256 string"
    return map_rows(df, run, {"body": F.col("body"), "spans": F.col("spans")}, types, F.struct("row", "n_bytes")).select("row.*", "n_removed", "n_spans", "kept_sha256")
