"""One query for each operator over its whole table: the operator with production parameters, then the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, decontam, divergence, jaccard, langid, linededup, quality, ranked, secrets, suffix, toxicity, urls, warc
from corvane.llm.common import held_out, sha256_text, table, work_folder

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
VOCABULARY = "byte_bpe_50k.json"
RULES = (
    urls.Rule("org", "/", "allow"),
    urls.Rule("example.org", "/es/", "block"),
    urls.Rule("example.org", "/en/1", "block"),
    urls.Rule("com", "/fr/", "allow"),
    urls.Rule("com", "/de/", "block"),
)


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@query
def op1_warc(spark, d):
    folder = work_folder(spark, "warc")
    warc.write_archive(table(spark, d, "pages"), f"{folder}/raw")
    warc.deduplicate(spark, f"{folder}/raw", f"{folder}/deduplicated", folder, min_bytes=0)
    return warc.read_archive(spark, f"{folder}/deduplicated").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op2_langid(spark, d):
    docs = table(spark, d, "documents").withColumn("out", held_out(F.col("doc_id"), 4, 2))
    model = langid.fit(docs.where("NOT out AND doc_id IS NOT NULL"), F.col("text"), F.col("lang"))
    return langid.predict(docs, F.col("text"), model, keep=F.struct("doc_id", "out")).select(
        "row.doc_id", F.col("row.out").alias("held_out"), "lang_pred", "score"
    )


@query
def op3_toxicity(spark, d):
    docs = table(spark, d, "documents").withColumn("out", held_out(F.col("doc_id"), 3, 1))
    rows = toxicity.labelled(docs.where(~F.col("out")), table(spark, d, "labels"), "doc_id", "text", "toxic")
    scored = toxicity.score(docs, F.col("text"), toxicity.fit(rows), keep=F.struct("doc_id", "out"))
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return scored.select("row.doc_id", F.col("row.out").alias("held_out"), "score", predicted.alias("predicted"))


@query
def op4_line_dedup(spark, d):
    rows = linededup.drop_lines(table(spark, d, "documents").select("doc_id", "text"), "text", min_docs=10, min_chars=1)
    return rows.select("row.doc_id", "n_lines", "n_dropped", sha256_text(F.col("kept")).alias("kept_sha256"))


@query
def op5_decontam(spark, d):
    found = decontam.scan(table(spark, d, "documents"), F.col("text"), table(spark, d, "benchmark"), size=10, keep=F.struct("doc_id"))
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        sha256_text(F.array_join("items", ",")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op7_url_filter(spark, d):
    judged = urls.judge(table(spark, d, "pages"), F.col("url"), RULES, keep=F.struct("page_id"))
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


@query
def op9_quality(spark, d):
    judged = quality.judge(table(spark, d, "documents"), "doc_id", "text", "lang")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(F.col("id").alias("doc_id"), *names, "base_failed", "kept", "perplexity", "low", "high")


@query
def op10_bpe(spark, d):
    rows = bpe.digests(table(spark, d, "documents"), vocabulary_path(), keep=F.struct("doc_id"))
    return rows.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op6_jaccard(spark, d):
    linked = jaccard.link(table(spark, d, "documents"), "doc_id", "text", words=5, percent=75)
    return linked.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


@query
def op8_suffix(spark, d):
    found = suffix.repeats(table(spark, d, "documents").select("doc_id", "text"), "text", length=200, keep=F.struct("doc_id"))
    return suffix.remaining(found).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op11_divergence(spark, d):
    return divergence.audit(table(spark, d, "documents"), "text", "lang", "source", min_docs=10, top=10)


@query
def op12_secrets(spark, d):
    found = secrets.scan(table(spark, d, "documents"), F.col("text"), keep=F.struct("doc_id"))
    counts = [F.size(secrets.of_kinds(F.col("spans"), (k,))).cast("bigint").alias(f"n_{k}") for k in secrets.BASE_KINDS]
    base = sha256_text(secrets.listed(secrets.of_kinds(F.col("spans"), secrets.BASE_KINDS))).alias("base_sha256")
    return found.select("row.doc_id", *counts, base, secrets.listed(F.col("spans")).alias("spans"))


@query
def op13_ranked(spark, d):
    return ranked.search(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), top=10)
