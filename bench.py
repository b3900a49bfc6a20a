"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corvane.plans.queries import REGISTRY  # noqa: E402

HEADLINE = """catalog_commands element_ids json_commands json_properties triplet_utterances_wide weighted_sample packed_sample
pair_sampler_wide samples_type3 samples_type6 samples_type7 sample_corpus zip_resample cap_per_group unique_objects
single_object_apps single_object_eval distinct_text_index text_records_eval stale_refresh indel_pairs indel_pairs_native
paraphrase_scores first_sentences embed_hash knn_exact knn_streamed knn_within_parent knn_lsh match_hierarchy hit_at_5
exact_match_report prompt_rows_pairs""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("corvane-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One query first, so that the start of the JVM and of the Python workers is not charged to a headline query.
    for name in ("triplet_utterances", "paraphrase_scores"):
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    wanted = sys.argv[1:] or HEADLINE
    for name in wanted:
        start = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
