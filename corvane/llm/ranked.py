"""Ranked lexical search over bit-sliced Bloom signatures, exact by construction.

Index: each document puts its distinct terms into a Bloom signature, once for every level of ``LEVELS`` that its number
of occurrences reaches. Signatures of documents of similar size have one length, and blocks of them are stored as bit
slices: one bitmap over the block's documents for each bit. The same pass counts document frequencies.

Search: the slices of a term's bits, ANDed, are a bitmap of the documents that may hold it, never one too few. Weighted
sums of these bitmaps, level by level, bound each document's score from above. A first pass scores exactly the documents
with the best bounds that each task sees; the k-th best of these scores is a floor under the result. The second pass
takes every document whose bound reaches its item's floor, so what is left out is proven to be out, and scores those
exactly on their whole texts. No candidate is cut, and a false hit of a signature costs time, never a result.

Documents are numbered by two 64-bit hashes of id and text; equal rows share the key and each is ranked. Items come to
the driver in blocks of a bounded number of terms, and each block is sent to the tasks, searched and released in turn.
Candidates are broadcast behind a count, and joined by a shuffle beyond it. Hot keys: document frequencies are summed in
the tasks, and each task keeps its own best k for an item, so a text that a third of all rows share stays spread.

Cases: a null or empty text has no term and is not ranked; items that share an id are one item (so are those with a null
id), an item without terms has no result; equal scores are ranked by id, null ids last; rows that repeat are ranked each;
a long text stands in memory as a whole, and fills a signature of the greatest length, so that it is merely scored more
often; empty tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from corvane.llm.common import map_rows, parts_of, stored, work_folder

TOP = 10
LEVELS = (1, 2, 3, 5, 9, 17)  # least occurrences of a level; the last has no upper end but the document's length
BITS_A_KEY, HASHES = 8, 4
AREA = 1 << 22  # bits of a block: documents times signature length
MOST_DOCS = 2048
HELD_TERMS = 1 << 18
BLOCK_TERMS, BLOCK_ITEMS = 1 << 15, 512
BROADCAST_PAIRS = 1_000_000  # candidate keys of 16 bytes and their items; more of them are joined by a shuffle
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(_TERM_BYTES).split() if text else []


def hashes(terms: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, terms), np.uint64, len(terms))


def _leveled(h: np.ndarray, level: int) -> np.ndarray:
    x = h + np.uint64(int(_GOLD) * level & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def places(keys: np.ndarray, bits: int) -> np.ndarray:
    """(hash, key) positions in a signature of ``bits`` bits, a power of two."""
    first, second = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
    return np.stack([((first + np.uint64(i) * second) & np.uint64(bits - 1)).astype(np.int64) for i in range(HASHES)])


def signature_bits(n_keys: int) -> int:
    """Length for a document of so many keys: the next power of two, at most what leaves a block eight documents."""
    return min(AREA // 8, 1 << max(6, (max(1, n_keys) * BITS_A_KEY - 1).bit_length()))


def sliced(keys: list[np.ndarray], bits: int) -> np.ndarray:
    """Bitmaps over the documents, one row for each bit of the signature."""
    table = np.zeros((bits, -(-len(keys) // 8) * 8), bool)
    for d, k in enumerate(keys):
        table[places(k, bits).ravel(), d] = True
    return np.packbits(table, axis=1)


def _keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    one, two = F.xxhash64(doc_id, text), F.xxhash64(F.lit("second"), text, doc_id)
    return df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), one.alias("h1"), two.alias("h2"))


def build(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows with a ``term`` and its ``docs``, and rows of blocks: ``bits``, ``h1``, ``h2``, ``n`` (terms of each document,
    with repeats) and ``slices``."""
    rows = _keyed(df, doc_id, text).where("text IS NOT NULL").select("h1", "h2", "text")
    types = [("term", pa.string()), ("docs", pa.int64()), ("bits", pa.int32()), *((c, pa.list_(pa.int64())) for c in ("h1", "h2", "n")), ("slices", pa.binary())]
    schema = pa.schema(types)

    def told(counts: Counter) -> Iterator[pa.RecordBatch]:
        terms = list(counts)
        for a in range(0, len(terms), 1 << 16):
            part = terms[a : a + (1 << 16)]
            columns = [pa.array(part, pa.binary()).cast(pa.string()), pa.array([counts[t] for t in part], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(part), f.type) for f in list(schema)[2:])], schema=schema)

    def block(bits: int, held: list) -> pa.RecordBatch:
        slices = sliced([k for _, _, _, k in held], bits).tobytes()
        lists = [pa.array([[d[i] for d in held]], pa.list_(pa.int64())) for i in range(3)]
        columns = [pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([bits], pa.int32()), *lists, pa.array([slices], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches):
        docs: Counter = Counter()
        bands: dict[int, list] = {}
        for batch in parts_of(batches):
            for h1, h2, body in zip(*(c.to_pylist() for c in batch.columns)):
                words = terms_of(body)
                if not words:
                    continue
                counts = Counter(words)
                docs.update(counts.keys())
                h, tf = hashes(list(counts)), np.fromiter(counts.values(), np.int64, len(counts))
                keys = np.concatenate([_leveled(h[tf >= least], level) for level, least in enumerate(LEVELS)])
                bits = signature_bits(len(keys))
                held = bands.setdefault(bits, [])
                held.append((h1, h2, len(words), keys))
                if len(held) >= min(MOST_DOCS, AREA // bits):
                    yield block(bits, bands.pop(bits))
            if len(docs) > HELD_TERMS:
                yield from told(docs)
                docs.clear()
        yield from told(docs)
        for bits, held in bands.items():
            yield block(bits, held)
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, "term string, docs bigint, bits int, h1 array<bigint>, h2 array<bigint>, n array<bigint>, slices binary")


class Queries:
    """A block of items: their distinct terms, and of each item the rows of its terms and their weights."""

    def __init__(self, items: list[tuple[list[str], list[int]]]):
        self.terms = sorted({t for terms, _ in items for t in terms})
        self.place = {t.encode("utf-8"): k for k, t in enumerate(self.terms)}
        self.hash = hashes([t.encode("utf-8") for t in self.terms])
        place = {t: k for k, t in enumerate(self.terms)}
        self.rows = [np.array([place[t] for t in terms], np.int64) for terms, _ in items]
        self.weights = [np.array(w, np.int64) for _, w in items]


def part_score(tf, length):
    """Whole-number share of a term that occurs ``tf`` times, ``length`` being the document's length factor."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * length)


def length_factor(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    return np.array([10 + (90 * int(x) * documents) // total for x in n], np.int64)


def bounds(queries: Queries, bits: int, n: np.ndarray, slices: bytes, documents: int, total: int) -> np.ndarray:
    """(item, document) upper bounds of the scores within a block."""
    table = np.frombuffer(slices, np.uint8).reshape(bits, -1)
    factor = length_factor(n, documents, total)
    out = np.zeros((len(queries.rows), len(n)), np.int64)
    present, alive, before = None, np.arange(len(queries.terms)), np.zeros(len(n), np.int64)
    for level in range(len(LEVELS)):
        most = n if level + 1 == len(LEVELS) else np.minimum(n, LEVELS[level + 1] - 1)
        share = part_score(most, factor)
        maps = np.zeros((len(queries.terms), table.shape[1]), np.uint8)
        for a in range(0, len(alive), 1024):
            some = alive[a : a + 1024]
            maps[some] = np.bitwise_and.reduce(table[places(_leveled(queries.hash[some], level), bits)], axis=0)
        present = maps if present is None else present & maps
        alive = np.flatnonzero(present.any(axis=1))
        if not len(alive):
            break
        lives = np.zeros(len(queries.terms), bool)
        lives[alive] = True
        for i, (rows, weights) in enumerate(zip(queries.rows, queries.weights)):
            use = lives[rows]
            if use.any():
                maybe = np.unpackbits(present[rows[use]], axis=1)[:, : len(n)]
                out[i] += np.dot(weights[use].astype(np.float64), maybe.astype(np.float64)).astype(np.int64) * (share - before)
        before = share
    return out


def exact(queries: Queries, counts: Counter, items: list[int], factor: int) -> list[int]:
    """Scores of one document for some items."""
    tf = np.zeros(len(queries.terms), np.int64)
    for t, c in counts.items():
        k = queries.place.get(t)
        if k is not None:
            tf[k] = c
    share = part_score(tf, factor)
    return [int((queries.weights[i] * share[queries.rows[i]]).sum()) for i in items]


def _blocks(index: DataFrame) -> DataFrame:
    return index.where("bits IS NOT NULL").select("bits", "h1", "h2", "n", "slices")


def probes(index: DataFrame, shared, documents: int, total: int, top: int) -> DataFrame:
    """(item, h1, h2, bound) of the ``top`` best bounds of each item in each task."""

    def run(batches):
        best: list = []
        for batch in parts_of(batches, 1):
            row = batch.to_pylist()[0]
            found = bounds(shared.value, row["bits"], np.array(row["n"], np.int64), row["slices"], documents, total)
            part = min(top, found.shape[1])
            at = np.argpartition(-found, part - 1, axis=1)[:, :part]
            h1, h2 = np.array(row["h1"], np.int64), np.array(row["h2"], np.int64)
            fresh = [np.take_along_axis(found, at, axis=1), h1[at], h2[at]]
            best = [np.concatenate(x, axis=1) for x in zip(best, fresh)] if best else fresh
            if best[0].shape[1] > top:
                at = np.argpartition(-best[0], top - 1, axis=1)[:, :top]
                best = [np.take_along_axis(x, at, axis=1) for x in best]
        if best:
            item, column = np.nonzero(best[0] > 0)
            yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), *(pa.array(x[item, column]) for x in (best[1], best[2], best[0]))], names=["item", "h1", "h2", "bound"])

    return _blocks(index).mapInArrow(run, "item int, h1 bigint, h2 bigint, bound bigint")


def reaching(index: DataFrame, shared, documents: int, total: int, floors: list[int]) -> DataFrame:
    """(h1, h2, items): every document whose bound reaches the floor of some items."""
    least = np.maximum(np.array(floors, np.int64), 1)

    def run(batches):
        for batch in parts_of(batches, 1):
            row = batch.to_pylist()[0]
            found = bounds(shared.value, row["bits"], np.array(row["n"], np.int64), row["slices"], documents, total)
            doc, item = np.nonzero(found.T >= least)
            each, starts = np.unique(doc, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(item)).astype(np.int32)), pa.array(item.astype(np.int32)))
            keys = [pa.array(np.array(row[h], np.int64)[each]) for h in ("h1", "h2")]
            yield pa.RecordBatch.from_arrays([*keys, lists], names=["h1", "h2", "items"])

    rows = _blocks(index).mapInArrow(run, "h1 bigint, h2 bigint, items array<int>")
    return rows.groupBy("h1", "h2").agg(F.first("items").alias("items"))  # equal rows have equal bounds


def scored(df: DataFrame, doc_id: str, text: str, wanted: DataFrame, shared, documents: int, total: int, top: int) -> DataFrame:
    """(item, id, score): exact scores above 0 of the wanted (h1, h2, items), the ``top`` best of each task."""
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_PAIRS else wanted
    rows = _keyed(df, doc_id, text).join(wanted, ["h1", "h2"]).select("id", "text", "items")
    kind = rows.schema["id"].dataType
    out = StructType().add("item", IntegerType()).add("score", LongType()).add("id", kind)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        queries, best = shared.value, {}
        order = lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0)
        for batch in parts_of(batches):
            for doc, body, items in zip(*(c.to_pylist() for c in batch.columns)):
                words = terms_of(body)
                factor = 10 + (90 * len(words) * documents) // total
                for item, score in zip(items, exact(queries, Counter(words), items, factor)):
                    if score > 0:
                        held = best.setdefault(item, [])
                        held.append((score, doc))
                        if len(held) > 4 * top:
                            held.sort(key=order)
                            del held[top:]
        rows = [(item, score, doc) for item, held in best.items() for score, doc in sorted(held, key=order)[:top]]
        target = to_arrow_schema(out)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(target)], schema=target)

    return rows.mapInArrow(run, out)


def _item_blocks(items: DataFrame) -> Iterator[list]:
    """Rows (item, terms, weights) in lists of a bounded number of items and terms; one larger item is a list of its own."""
    held, size = [], 0
    for row in items.toLocalIterator():
        if held and (len(held) >= BLOCK_ITEMS or size + len(row.terms) > BLOCK_TERMS):
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row.terms)
    if held:
        yield held


def search(
    df: DataFrame, doc_id: str, text: str, benchmark: DataFrame, item: str = "item_id", item_text: str = "text", top: int = TOP
) -> DataFrame:
    """(item, rank, id, score): the ``top`` documents of each item, column names ``item`` and ``doc_id`` as given."""
    spark = df.sparkSession
    folder = work_folder(spark, "ranked")
    index = stored(build(df, doc_id, text), f"{folder}/index")
    sums = _blocks(index).agg(F.sum(F.size("n")), F.sum(F.expr("aggregate(n, 0L, (a, x) -> a + x)"))).first()
    documents, total = sums[0] or 0, sums[1] or 0

    asked = map_rows(
        benchmark, lambda b: {"terms": [sorted({w.decode() for w in terms_of(t)}) for t in b["text"]]},
        {"text": F.col(item_text)}, "terms array<string>", F.struct(F.col(item).alias("item")),
    )
    asked = asked.select(F.col("row.item").alias("item"), F.explode("terms").alias("term")).distinct()
    counts = index.where("term IS NOT NULL").groupBy("term").agg(F.sum("docs").alias("docs"))
    ratio = (F.lit(2 * documents + 2).cast("double")) / (2 * F.col("docs") + 1).cast("double")
    weighted = asked.join(counts, "term").withColumn("weight", F.floor(1000 * F.log(ratio)).cast("bigint"))
    items = weighted.groupBy("item").agg(F.collect_list(F.struct("term", "weight")).alias("w"))
    items = stored(items.select("item", F.col("w.term").alias("terms"), F.col("w.weight").alias("weights")), f"{folder}/items")

    kinds = items.select("item").schema.add("score", LongType()).add("id", df.schema[doc_id].dataType)
    results = spark.createDataFrame([], kinds)
    for number, block in enumerate(_item_blocks(items)):
        shared = spark.sparkContext.broadcast(Queries([(r.terms, r.weights) for r in block]))
        first = probes(index, shared, documents, total, top)
        best = W.partitionBy("item").orderBy(F.desc("bound"), "h1", "h2")
        first = stored(first.withColumn("r", F.row_number().over(best)).where(F.col("r") <= 3 * top), f"{folder}/probes-{number}")
        wanted = first.groupBy("h1", "h2").agg(F.collect_set("item").alias("items"))
        tried = scored(df, doc_id, text, wanted, shared, documents, total, top)
        ranked = tried.withColumn("r", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score")))).where(F.col("r") == top)
        floors = [0] * len(block)
        for r in ranked.select("item", "score").collect():  # one number an item of the block
            floors[r["item"]] = r["score"]
        wanted = stored(reaching(index, shared, documents, total, floors), f"{folder}/wanted-{number}")
        found = scored(df, doc_id, text, wanted, shared, documents, total, top).withColumnRenamed("item", "at")
        numbered = StructType().add("at", IntegerType()).add("item", kinds["item"].dataType)
        ids = spark.createDataFrame([(k, r["item"]) for k, r in enumerate(block)], numbered)
        found = found.join(F.broadcast(ids), "at").select("item", "score", "id")
        results = results.unionByName(stored(found, f"{folder}/found-{number}"))
        shared.unpersist()
    order = W.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranks = results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranks.select(F.col("item").alias(item), "rank", F.col("id").alias(doc_id), "score")

