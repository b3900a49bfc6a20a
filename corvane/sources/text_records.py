"""Multi-line text records.

A record starts on a line without a leading blank; lines that start with a blank continue it, ``#`` lines and empty
lines are skipped, and ``@`` lines are alternatives to the text so far: the lines after them are common to all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHUNK = 50_000


def number_lines(df: DataFrame, file: str, pos: str, line: Column) -> DataFrame:
    """``(file, chunk, pos, line)`` from a table that knows the position of each line."""
    return df.select(
        F.col(file).alias("file"), F.floor(F.col(pos) / CHUNK).alias("chunk"), F.col(pos).alias("pos"), line.alias("line")
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, chunk, pos, line)`` of text files. A chunk is an input split, so that a large file is read by many
    tasks; positions grow within a split, and splits are ordered by their offset."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("chunk"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("value").alias("line"),
    )


def running_count(df: DataFrame, by: str, flag: Column, out: str) -> DataFrame:
    """Running number of flagged rows of a file, counted per chunk and shifted by the totals of earlier chunks."""
    cut = df.withColumn("__flag", flag.cast("bigint"))
    totals = cut.groupBy(by, "chunk").agg(F.sum("__flag").alias("__sum"))
    ahead = W.partitionBy(by).orderBy("chunk").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = totals.withColumn("__before", F.sum("__sum").over(ahead) - F.col("__sum")).drop("__sum")
    inside = W.partitionBy(by, "chunk").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    local = cut.withColumn("__local", F.sum("__flag").over(inside))
    joined = local.join(before, [by, "chunk"], "inner")
    return joined.withColumn(out, F.col("__before") + F.col("__local")).drop("__flag", "__before", "__local")


def group_records(lines: DataFrame, variations: bool = False, add_end: str | None = None) -> DataFrame:
    """``(file, record, sample)`` from numbered lines, one row per variant of a record."""
    mark = F.substring("line", 1, 1)
    kept = lines.where((F.col("line") != "") & (mark != "#"))
    marked = mark.isin(" ", "@") if variations else mark == " "
    numbered = running_count(kept, "file", ~marked, "record").where(F.col("record") > 0)
    body = F.when(marked, F.substring("line", F.lit(2), F.length("line"))).otherwise(F.col("line"))
    alt = (mark == "@") if variations else F.lit(False)
    pieces = numbered.select("file", "record", "chunk", "pos", alt.alias("alt"), body.alias("text"))
    # A task meets the lines of a record one after the other and holds one record at a time.
    ordered = pieces.repartition("file", "record").sortWithinPartitions("file", "record", "chunk", "pos")
    kind = pieces.schema

    def run(batches):
        for rows in _sheets(_samples(batches, add_end)):
            arrays = [pa.array(x, t) for x, t in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays(arrays, names=["file", "record", "sample"])

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(kind[c].dataType) for c in ("file", "record")] + [pa.string()]
    out = StructType([kind["file"], kind["record"]]).add("sample", "string")
    return ordered.mapInArrow(run, out)


_BLANKS = " \t\n\x0b\x0c\r"


def _variants(head: list[str], others: list[str], tail: list[str], add_end: str | None) -> Iterator[str]:
    """The texts of a record: each distinct beginning with what all have in common."""
    rest = "".join(tail)
    for start in dict.fromkeys(["".join(head), *others]):
        sample = (start + rest).strip(_BLANKS)
        yield sample if add_end is None or sample.endswith(add_end) else sample + add_end


def _samples(batches: Iterable[pa.RecordBatch], add_end: str | None) -> Iterator[tuple]:
    """(file, record, sample) from the lines of whole records in their order, which may go on from batch to batch."""
    key, head, others, tail = None, [], [], []
    for batch in batches:
        for file, record, _, _, alt, text in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, record) != key:
                if key is not None:
                    yield from ((*key, t) for t in _variants(head, others, tail, add_end))
                key, head, others, tail = (file, record), [], [], []
            (others if alt else tail if others else head).append(text + "\n")
    if key is not None:
        yield from ((*key, t) for t in _variants(head, others, tail, add_end))


def _sheets(rows: Iterator[tuple], limit: int = 1 << 22) -> Iterator[list[tuple]]:
    """Rows in lists of a bounded number of characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) + 50
        if size > limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def read_text_records(spark: SparkSession, path: str, variations: bool = False, add_end: str | None = None) -> DataFrame:
    return group_records(read_lines(spark, path), variations, add_end)


def split_records(records: DataFrame) -> DataFrame:
    """``utterances`` (first line) and ``commands`` (the rest, blanks of indentation as tabs, no call brackets)."""
    cut = F.locate("\n", F.col("sample"))
    rest = F.when(cut > 0, F.substring("sample", cut + 1, F.length("sample"))).otherwise(F.lit(""))
    program = F.regexp_replace(rest, r"^\s+", "")
    program = F.replace(F.replace(program, F.lit("\n  "), F.lit("\n\t")), F.lit("()"), F.lit(""))
    return records.select(
        *[c for c in records.columns if c != "sample"],
        F.substring_index("sample", "\n", 1).alias("utterances"),
        program.alias("commands"),
    )


def eval_text(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation pairs of hand-written files with variations."""
    return split_records(read_text_records(spark, path, variations=True)).select("utterances", "commands")
