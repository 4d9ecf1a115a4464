"""Time the headline queries: prints one JSON line.

Each query gets a warm-up and then BENCH_RUNS timed runs, of which the median
counts. A run covers building the DataFrame, any iterative rounds and the whole
result, forced through the noop sink.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import tempfile
import time

from tallyspark.plans.catalogue import queries
from tallyspark.session import get_session

HEADLINE = (
    "daily_finances",
    "monthly_budget",
    "spend_vs_budget_month",
    "spend_vs_budget_quarter",
    "spend_vs_budget_year",
    "account_kpis",
    "saving_mix",
    "savings_series",
    "forward_budget",
    "habit_week",
    "scorecard_base",
    "avg_sleep",
    "task_table",
    "task_time_by_category",
)


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    work = tempfile.mkdtemp(prefix="bench-work-")
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.log.level": "ERROR",
            "spark.checkpoint.dir": work,
            # Call sites are recorded per Column operation for error messages only.
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    names = os.environ.get("BENCH_QUERIES", "")
    seconds = {}
    for name in names.split(",") if names else HEADLINE:
        run = queries()[name]
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            run(spark, directory).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 4)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()
    shutil.rmtree(work, ignore_errors=True)


if __name__ == "__main__":
    main()
