"""Wall-clock time of the headline queries; prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS and BENCH_QUERIES (comma-separated, or "all")
change the defaults. Results go in full to the noop sink.
"""

import json
import os
import re
import statistics
import time

from checks import catalog
from orderlens.scratch import scratch_scope
from orderlens.session import build_session

HEADLINE = [
    "master_sql",
    "master_notebook",
    "quality_all_tables",
    "eda_pearson",
    "payment_describe",
    "spearman_scores",
    "delay_mann_whitney",
    "delivery_kruskal",
    "rfm_table",
    "order_sequence",
    "retention_wilson",
    "first_vs_repeat",
    "satisfaction_by_segment",
    "executive_summary",
]


def timed(name, spark, folder):
    with scratch_scope(spark):
        start = time.perf_counter()
        catalog.run(name, spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    picked = os.environ.get("BENCH_QUERIES", "")
    names = list(catalog.QUERIES) if picked == "all" else picked.split(",") if picked else HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        timed(name, spark, folder)
        seconds[name] = round(statistics.median(timed(name, spark, folder) for _ in range(runs)), 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else folder,
                "cpus": int(cpus),
                "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
