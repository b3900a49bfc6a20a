"""Source divergence audit: how far the word frequencies of the sources of a language lie apart, and by which words.

Tokens come from one ``bytes.translate`` that lowers A-Z and blanks every separator, and one ``bytes.split``. A Counter
a document gives its frequencies; the (group, term, count) cells of many documents are summed where they are read, so
one pass gives both occurrences and document counts, and only sums are shuffled. Zero counts are never stored: a pair of
sources compares the cells of a slice of terms in numpy, and all terms that neither has are one product.

Shares are whole numbers out of ``SCALE`` with add-two smoothing, differences are whole numbers too, so results do not
hang on the order of additions; products of counts are decimals, which do not overflow.

Hot groups: a source with a third of all rows is summed in every task before the shuffle; terms of a language are dealt
into slices and its sources into blocks, so a task compares a bounded number of cells; the ten words of a group are cut
in each task before they are ranked. One row for each ordered pair of sources of a language is the result asked for.

Cases: a null text, language or source counts as ''; a group whose texts hold no term is listed like any other, with
zero counts; a language without kept terms has value 0 for all pairs; ties are ranked by the item's UTF-8 bytes; repeated
rows count as often as they occur; a text is handled whole, and holds its distinct terms in memory; an empty table gives
no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.common import parts_of, stored, work_folder

MIN_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
ADDED = 2
HELD_CELLS = 1 << 18  # cells of documents, and sums, that a task holds before it lets them go
SLICE_CELLS = 1 << 15
BLOCK_SOURCES = 256
BROADCAST_GROUPS = 100_000  # (language, source) rows; more of them are joined by a shuffle

_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(_TERM_BYTES).split() if text else []


def count_terms(df: DataFrame, text: Column, lang: Column, source: Column) -> DataFrame:
    """(lang, source, term, n, docs) of all texts; the term '' marks a group that occurs."""
    none = F.lit("")
    rows = df.select(text.alias("text"), F.coalesce(lang.cast("string"), none).alias("lang"), F.coalesce(source.cast("string"), none).alias("source"))
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches):
        groups: dict[tuple[str, str], int] = {}
        group, term, n = [], [], []
        held = None

        def summed(before: pa.Table | None) -> pa.Table:
            cells = pa.table({"g": pa.array(group, pa.int32()), "term": pa.array(term, pa.binary()), "n": pa.array(n, pa.int64())})
            part = cells.group_by(["g", "term"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])
            part = part.rename_columns(["g", "term", "n", "docs"])
            if before is not None:
                both = pa.concat_tables([before, part]).group_by(["g", "term"], use_threads=False)
                part = both.aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(["g", "term", "n", "docs"])
            group.clear(), term.clear(), n.clear()
            return part

        def told(sums: pa.Table):
            of = list(groups)
            for batch in sums.combine_chunks().to_batches(max_chunksize=1 << 16):
                code = batch.column(0).to_numpy(zero_copy_only=False)
                sides = [pa.array([of[g][k] for g in code.tolist()], pa.string()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*sides, batch.column(1).cast(pa.string()), *batch.columns[2:]], names=names)

        for batch in parts_of(batches):
            for body, *name in zip(*(c.to_pylist() for c in batch.columns)):
                key = tuple(name)
                if key not in groups:
                    groups[key] = len(groups)
                    group.append(groups[key]), term.append(b""), n.append(0)
                counts = Counter(terms_of(body))
                group.extend([groups[key]] * len(counts))
                term.extend(counts.keys())
                n.extend(counts.values())
            if len(term) > HELD_CELLS:
                held = summed(held)
                if held.num_rows > HELD_CELLS:
                    yield from told(held)
                    held = None
        yield from told(summed(held))
        pa.default_memory_pool().release_unused()

    counted = rows.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str, terms: str) -> Column:
    """Smoothed share of a count, in whole numbers; 0 for a language without terms."""
    top = f"cast({count} + {ADDED} as decimal(20,0)) * cast({SCALE} as decimal(10,0))"
    bottom = f"cast({total} + {ADDED} * {terms} as decimal(20,0))"
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + ({top}) div {bottom} ELSE 0L END")


def _tile_sums(group: pa.Table) -> pa.Table:
    """Of each pair of sources in a tile: the sum over the tile's terms of what they add to a pair without any cell.

    Rows with an empty term give the sources: their share of an unseen term, and the terms of the language where those
    that no tile holds are to be added (else 0).
    """
    source, term = group.column("source").to_pylist(), group.column("term").to_pylist()
    side, value = group.column("side").to_numpy(), group.column("p").to_numpy()
    marks = [i for i, t in enumerate(term) if t == ""]
    place = {s: k for k, s in enumerate(sorted({source[i] for i in marks}))}
    names = list(place)
    unseen, own = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    extra = 0
    for i in marks:
        unseen[place[source[i]]], own[place[source[i]]] = value[i], side[i]
        extra = max(extra, group.column("more")[i].as_py())
    cells = np.array([i for i, t in enumerate(term) if t != ""], np.int64)
    row = np.array([place[source[i]] for i in cells], np.int64)
    _, column = np.unique(np.array([term[i] for i in cells], object), return_inverse=True)
    width = int(column.max()) + 1 if len(cells) else 0
    total = np.zeros((len(names), len(names)), np.int64)
    far = lambda p, q: (p - q) ** 2 // np.maximum(p + q, 1)
    flat = far(unseen[:, None], unseen[None, :])
    step = max(1, (1 << 21) // max(1, len(names)))
    order = np.argsort(column, kind="stable")
    row, column, shares = row[order], column[order], value[cells][order]
    for start in range(0, width, step):
        a, b = np.searchsorted(column, [start, start + step])
        dense = np.repeat(unseen[:, None], min(step, width - start), axis=1)
        dense[row[a:b], column[a:b] - start] = shares[a:b]
        for k in range(len(names) - 1):
            total[k, k + 1 :] += (far(dense[k], dense[k + 1 :]) - flat[k, k + 1 :, None]).sum(axis=1)
    total += extra * flat
    # A tile of two blocks compares across them; within a block all pairs meet.
    low, high = np.triu_indices(len(names), 1)
    if group.column("low")[0] != group.column("high")[0]:
        across = own[low] != own[high]
        low, high = low[across], high[across]
    n = len(low)
    out = {"lang": [group.column("lang")[0].as_py()] * n, "a": [names[i] for i in low], "b": [names[i] for i in high], "part": total[low, high]}
    return pa.table({k: pa.array(v, pa.int64() if k == "part" else pa.string()) for k, v in out.items()})


def _pair_values(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) for all sources a < b of each language."""
    sizes = groups.groupBy("lang").agg(
        F.greatest(F.ceil(F.sum("cells") / SLICE_CELLS), F.lit(1)).cast("int").alias("slices"),
        F.ceil(F.count(F.lit(1)) / BLOCK_SOURCES).cast("int").alias("blocks"),
    )
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    cut = F.pmod(F.xxhash64("term"), F.col("slices")).cast("int")
    placed = cells.join(sizes, "lang").select("lang", "source", "term", F.col("p"), F.lit(0).cast("bigint").alias("more"), cut.alias("slice"), block.alias("block"), "blocks")
    every = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    marks = groups.join(sizes, "lang").withColumn("slice", every).select(
        "lang", "source", F.lit("").alias("term"), F.col("unseen").alias("p"),
        F.when(F.col("slice") == 0, F.col("terms")).otherwise(0).cast("bigint").alias("more"), "slice", block.alias("block"), "blocks",
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiled = placed.unionByName(marks).withColumn("other", other).select(
        "lang", "slice", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        F.col("block").cast("bigint").alias("side"), "source", "term", "p", "more",
    )
    sums = tiled.groupBy("lang", "slice", "low", "high").applyInArrow(_tile_sums, "lang string, a string, b string, part bigint")
    return sums.groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))


def audit(
    df: DataFrame, text: str, lang: str, source: str, min_docs: int = MIN_DOCS, top: int = TOP
) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows rank the other sources of the language by the sum of
    ``(p - q)**2 div (p + q)`` over all kept terms, ``term`` rows the ``top`` terms that the group uses more than its
    language by the same measure."""
    folder = work_folder(df.sparkSession, "divergence")
    counts = stored(count_terms(df, F.col(text), F.col(lang), F.col(source)), f"{folder}/counts")
    by_lang = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"))
    kept = by_lang.where(F.col("docs") >= min_docs).select("lang", "term", "total")
    cells = stored(counts.where("term <> ''").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total"), f"{folder}/cells")

    # A language's terms all occur in some source of it, so its sums are those of its cells.
    langs = cells.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.sum("total").alias("lang_n"), F.count(F.lit(1)).alias("terms"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.count(F.lit(1)).alias("cells"))
    groups = counts.where("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["group_n", "cells", "lang_n", "terms"])
    groups = stored(groups.withColumn("unseen", _share("0", "group_n", "terms")), f"{folder}/groups")

    few = groups.count() <= BROADCAST_GROUPS
    facts = groups.select("lang", "source", "group_n", "lang_n", "terms")
    shares = cells.join(F.broadcast(facts) if few else facts, ["lang", "source"]).select(
        "lang", "source", "term", "n", _share("n", "group_n", "terms").alias("p"), _share("total", "lang_n", "terms").alias("q")
    )
    shares = stored(shares, f"{folder}/shares")

    pairs = stored(_pair_values(shares.select("lang", "source", "term", "p"), groups), f"{folder}/pairs")
    sides = [pairs.select("lang", F.col(x).alias("source"), F.col(y).alias("item"), "value") for x, y in ("ab", "ba")]
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = sides[0].unionByName(sides[1]).withColumn("rank", F.row_number().over(order))

    value = F.expr("(p - q) * (p - q) div (p + q)")
    more = shares.where("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), value.alias("value"))
    words = more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    parts = [rows.withColumn("part", F.lit(name)) for name, rows in (("pair", ranked), ("term", words))]
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", "rank")
