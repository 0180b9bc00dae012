"""Runs headline queries once over $BENCH_SF_DIR and prints one JSON line of seconds."""

import importlib.util
import json
import os
import time
from pathlib import Path

from pyspark.sql import SparkSession

NAMES = ["word_counts", "vocab_topk", "ngrams", "keyness_g2", "keyness_fisher", "collocates_window", "collocates_sentence", "kwic_right", "cooc_window", "ppmi", "yule_k", "mattr_50", "stylo_zscore", "stylo_predict", "reuse_islands", "cosine_topk", "coherence_npmi", "op1_line_dedup", "op2_mixing", "op3_html_extract", "op4_toxicity", "op5_packing", "op6_license_scan", "op7_language_id", "op8_embedding_pq", "op9_spotsigs", "op10_simhash"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spec = importlib.util.spec_from_file_location("__spark_entry__", Path(__file__).with_name("__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    queries, took = entry.queries(), {}
    for name in (n for n in NAMES if n in queries):
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
