"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "negative_topics_pareto", "negative_topics_by_source", "sentiment_metrics", "score_linear", "detect_language",
    "hybrid_batch", "multilingual_batch", "direct_batch", "anonymize", "topic_document_frequency", "fit_tfidf",
    "fit_language_profiles", "train_test_leakage", "duplicate_audit", "label_conflicts", "router_sweep", "abstention_sweep",
    "variant_comparison", "report_facts", "selection_audit", "validate_table", "agreement", "request_schedule", "rate_audit",
    "latency_summary", "quality_gate", "pareto", "stream_scoring", "fit_logreg", "score_fitted", "language_posterior",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("vozlake-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        # a comment is slow to tokenise for its size, so scans are cut finer than the default
        .config("spark.sql.files.maxPartitionBytes", "4m").config("spark.sql.files.openCostInBytes", "512k")
        # the bench tables are one file of one row group each
        .config("vozlake.scan.partitions", cpus)
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from vozlake.plans import QUERIES

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    chosen = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]
    run(chosen[0])  # start-up and class loading are not the queries' cost
    times = {name: round(run(name), 3) for name in chosen}
    rows = spark.read.parquet(f"{folder}/documents.parquet").count()
    print(json.dumps({
        "metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "documents": rows, "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
