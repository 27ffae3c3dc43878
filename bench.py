"""Time the queries: one JSON line with seconds per query.

``BENCH_SF_DIR`` names the data (default sf0.1), ``BENCH_CPUS`` the cores, and
``BENCH_QUERIES`` optionally a comma-separated list of queries.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import QUERIES  # noqa: E402
from gradus.shipping import ship  # noqa: E402
from gradus.storage import release  # noqa: E402

HEADLINE = [
    "src_text_blocks",
    "src_jsonl_mcqa",
    "src_json_array_mcqa",
    "src_nested_qa_bqa",
    "sink_dataset",
    "assign_ids",
    "dedup_items",
    "prompt_extract",
    "prompt_option_mcqa",
    "chat_messages_train",
    "generate_batch",
    "parse_extraction",
    "parse_option_analysis",
    "nesting_depth",
    "options_score",
    "raw_log_score",
    "layernorm_sigmoid",
    "score_items",
    "upsert_by_id",
    "attach_scores_positional",
    "histogram_uniform",
    "histogram_by_file",
    "select_per_bin",
    "error_rate_norm",
    "metrics_by_model",
    "classification_report",
    "order_by_score",
    "plan_weighted",
    "plan_staged",
    "plan_curriculum",
    "incremental_extract",
    "incremental_score",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 1))
    names = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    folder = tempfile.mkdtemp(prefix="gradus-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", folder)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark, os.path.join(os.path.dirname(os.path.abspath(__file__)), "checks"))
    spark.read.parquet(f"{sf_dir}/documents.parquet").write.format("noop").mode("overwrite").save()

    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        release(spark)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
