"""Line deduplication over levelled, sorted runs of line hashes. DataFrame operations only.

A run is a bucketed table, sorted by line hash within its buckets, of (hash, number of documents). Every batch of
documents counts its own line keys, merge-anti-joins the runs (bucket by bucket, without a shuffle of the runs) to leave
out the keys that a run settles already, and adds the rest as a run of level 0. When a level holds ``fanout`` runs, they
are compacted into one run of the next level. A key is settled once one run holds it with ``settle`` documents.

A line's key is the line without the blanks at its ends, with A-Z in lower case; its hash has 128 bits. The lines of a
document that are found in at least ``min_docs`` documents are removed by position: the positions come from a join of
the hashed lines with the stored frequent keys, so that a hot line is split by adaptive execution; texts move once.

Cases: a null text is one empty line; keys shorter than ``min_chars`` code points stay; every row counts as a document,
rows that repeat an id or are equal as well; a document may lose all its lines and stays with an empty text; an empty
table gives an empty result; other columns of a row, whatever their names, pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import BLANKS, lower_ascii, stored, work_folder

MIN_DOCS = 10
MIN_CHARS = 1
BATCHES = 3
FANOUT = 2


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return F.btrim(lower_ascii(line), F.lit(BLANKS))


def hashes(c: Column) -> Column:
    return F.struct(F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(1), c).alias("h2"))


class LineRuns:
    """The runs of one corpus below ``folder``; the list of runs is all the driver keeps."""

    def __init__(self, spark: SparkSession, folder: str, settle: int = 1, fanout: int = FANOUT):
        self.spark, self.folder, self.settle, self.fanout = spark, folder, settle, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def _write(self, counts: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        writer = counts.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
        writer.option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _sum(self, runs: list[str]) -> DataFrame:
        # Read as plain files: a union of bucketed scans may be taken for co-partitioned when its buckets are not.
        rows = self.spark.read.schema("h1 bigint, h2 bigint, n bigint").parquet(*[f"{self.folder}/{r}" for r in runs])
        return rows.groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def add(self, keys: DataFrame) -> None:
        """Add a batch: one row of (h1, h2) for each document and distinct key."""
        fresh = keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
        for run in [r for level in self.levels for r in level]:
            fresh = fresh.join(self.spark.table(run).where(F.col("n") >= self.settle), ["h1", "h2"], "left_anti")
        self.levels[0].append(self._write(fresh))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self._write(self._sum(self.levels[level]))
            for old in self.levels[level]:
                self.spark.sql(f"DROP TABLE {old}")  # external: the list forgets it, the files stay with the folder
            self.levels[level] = []
            level += 1
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(merged)

    def frequent(self, min_docs: int) -> DataFrame:
        """(h1, h2) of the keys found in at least ``min_docs`` documents; ``min_docs`` may not exceed ``settle``."""
        if min_docs > self.settle:
            raise ValueError("counts are kept only up to the settling count")
        runs = [r for level in self.levels for r in level]
        return self._sum(runs).where(F.col("n") >= min_docs).select("h1", "h2")


def document_keys(df: DataFrame, text: Column, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2) of each document's distinct keys."""
    keys = F.array_distinct(F.transform(lines_of(text), key_of))
    long_enough = F.filter(keys, lambda k: F.char_length(k) >= min_chars)
    return df.select(F.explode(F.transform(long_enough, hashes)).alias("h")).select("h.*")


def drop_lines(
    df: DataFrame,
    text: str,
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """``row`` (the whole row as a struct), ``kept`` (its text without frequent lines), ``n_lines``, ``n_dropped``.

    The rows are dealt into ``batches`` by a hash of the text, as if they had arrived one after the other.
    """
    spark = df.sparkSession
    folder = work_folder(spark, "lines")
    # No row is told apart by an id, which may repeat: equal rows have equal results, so their hash is key enough.
    row = df.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    key = F.xxhash64(F.to_json("rest"), "text"), F.xxhash64(F.lit(1), F.to_json("rest"), "text")
    others = [c for c in df.columns if c != text]
    rest = F.struct(*[F.col(f"row.`{c.replace('`', '``')}`").alias(f"c{i}") for i, c in enumerate(others)], F.lit(0).alias("z"))
    named = row.withColumn("rest", rest).select("row", "text", key[0].alias("k1"), key[1].alias("k2"))

    runs = LineRuns(spark, folder, settle=min_docs, fanout=fanout)
    for b in range(batches):
        part = df.where(F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(batches)) == b)
        runs.add(document_keys(part, F.col(text), min_chars))
    frequent = stored(runs.frequent(min_docs), f"{folder}/frequent")
    lines = F.transform(
        lines_of(F.col("text")),
        lambda line, i: F.struct(i.alias("at"), hashes(key_of(line)).alias("h"), F.char_length(key_of(line)).alias("size")),
    )
    each = named.select("k1", "k2", F.explode(lines).alias("l")).where(F.col("l.size") >= min_chars)
    each = each.select("k1", "k2", "l.at", "l.h.h1", "l.h.h2")
    hits = each.join(frequent, ["h1", "h2"], "left_semi").groupBy("k1", "k2").agg(F.collect_set("at").alias("at"))
    hits = stored(hits, f"{folder}/hits")
    joined = named.join(hits, ["k1", "k2"], "left")
    lines = lines_of(F.col("text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("at"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n")
    return joined.select("row", F.coalesce("text", F.lit("")).alias("text"), "at", lines.alias("lines")).select(
        "row",
        F.when(F.col("at").isNull(), F.col("text")).otherwise(kept).alias("kept"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("at"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
