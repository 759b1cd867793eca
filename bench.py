"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

The corpus is derived from the documents once and written; that time is shown
as ``derive_corpus``. Every query is then executed in full (all rows, all
columns) into the no-op sink, after one warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from srcatlas.plans import bridge  # noqa: E402
from srcatlas.plans.catalog import QUERIES  # noqa: E402
from srcatlas.session import get_session  # noqa: E402

HEADLINE = [
    "language_stats", "language_stats_no_lines", "codebase_totals", "directory_rollup", "path_columns", "list_all",
    "gitignore_listing", "tracked_listing", "todos", "todos_by_marker", "symbols_by_language", "import_usage",
    "comment_first_line", "wrap_comments", "metadata_lines", "tree_prefix", "tree_preorder", "text_report",
    "text_report_full", "markdown_report", "json_records", "json_tree", "stream_todos",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "srcatlas-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    seconds: dict[str, float] = {}
    start = time.time()
    files = bridge.code_files(spark, sf_dir)
    seconds["derive_corpus"] = round(time.time() - start, 3)
    measured = files.selectExpr("count(*) AS files", "sum(size_bytes) AS bytes").first()
    QUERIES["extension_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    spark.stop()

    total = round(sum(seconds.values()), 3)
    extraction = seconds["metadata_lines"]
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "files": measured.files,
                "bytes": measured.bytes,
                "extraction_files_per_sec": round(measured.files / extraction, 1),
                "extraction_mb_per_sec": round(measured.bytes / 1e6 / extraction, 2),
            }
        )
    )


if __name__ == "__main__":
    main()
