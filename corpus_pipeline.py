"""Five stages that make training data of ``documents``: each takes what its predecessor kept, as Parquet.

toxicity          documents that the classifier (fitted on ``labels``) scores at 0.7 or more go
line_dedup        lines found in at least ten documents go; a text that loses lines stays, shorter
near_duplicates   of documents linked by word shingles (five words, similarity 0.75 or more) the one with the smallest id stays
decontamination   documents that hold ten consecutive words of a benchmark item go
bpe               the token ids of what is left, as digests, with the decoded text as a check
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, decontam, jaccard, linededup, toxicity
from corvane.llm.common import stored, table, work_folder
from corvane.llm.queries import vocabulary_path

#: A learned classifier and an iterative join are no SQL; tests hold run() against a brute-force version of all but the fit.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a score below 0.7. A null or empty text has the score of the bias alone; with labels of one class only
    every row stays; repeated rows are judged alike; an empty table stays empty; other columns pass as they are."""
    rows = toxicity.labelled(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic")
    scored = toxicity.score(docs, "text", toxicity.fit(rows))
    return scored.where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def drop_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without the lines whose key at least ten rows hold; repeated rows count each. A null or
    empty text, and one that loses nothing, stays as it is; one that loses all is empty; ``n_chars`` follows the text."""
    rows = linededup.drop_lines(docs, "text", min_docs=10, min_chars=1)
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("row.text"))
    length = F.when(F.col("n_dropped") > 0, F.char_length("kept").cast("bigint")).otherwise(F.col("row.n_chars"))
    new = {"text": text, "n_chars": length}
    return rows.select(*[new.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts: that with the smallest id, then the smallest hash of id and text, null ids
    last; of rows equal in both the one with the smallest digest of the whole row. Rows without words (null, empty or
    blank texts) all stay; an empty table stays empty; other columns pass as they are."""
    folder = work_folder(spark, "near")
    linked = stored(jaccard.link(docs, "doc_id", "text", words=5, percent=75), f"{folder}/linked")
    order = F.struct(F.col("id").isNull(), "id", "rid")
    best = linked.where("n_shingles > 0").groupBy("group_key").agg(F.min(order).alias("best")).select("best.rid")
    stay = best.unionByName(linked.where("n_shingles = 0").select("rid")).distinct()
    repeated = linked.where("n_shingles > 0").groupBy("rid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rid")
    stay = stored(stay.join(repeated.withColumn("again", F.lit(True)), "rid", "left"), f"{folder}/stay")
    if stay.count() <= jaccard.BROADCAST_ROWS:
        stay = F.broadcast(stay)
    kept = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("rid")).join(stay, "rid")
    whole = F.struct(F.xxhash64("row"), F.to_json("row"))
    once = kept.where("again").groupBy("rid").agg(F.min_by("row", whole).alias("row"))
    return kept.where("again IS NULL").select("row.*").unionByName(once.select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no window of ten words (or whole shorter item) of the benchmark occurs. A text without words, and
    every row if the benchmark is empty, stays; repeated rows are judged alike; other columns pass as they are."""
    found = decontam.scan(docs, "text", table(spark, sf_dir, "benchmark"), size=10)
    return found.where("n_hit = 0").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Id, language, source, number of tokens and digests of every row; a null or empty text has no token. Rows that
    repeat are encoded each; an empty table gives no rows; other columns are not looked at."""
    rows = bpe.digests(docs, vocabulary_path(), keep=F.struct("doc_id", "lang", "source"))
    return rows.select("row.*", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_frequent_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the ``documents`` of ``sf_dir``."""
    folder = work_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, f"{folder}/{number}-{name}")
    return docs
