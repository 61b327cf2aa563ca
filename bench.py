"""Time every registered query and print one JSON line.

    BENCH_SF_DIR  test data folder, default /root/testdata/sf0.1
    BENCH_CPUS    local cores, default 8
    BENCH_QUERIES comma-separated names, default all
    BENCH_RUNS    runs of each query, of which the median counts, default 3

Each query is planned and executed in full, its rows going to Spark's no-op sink.
A few untimed queries warm up the JVM. The runs of a query are a round apart.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tillwise import registry  # noqa: E402
from tillwise.session import build_session  # noqa: E402

WARM_UP = ["kpi_summary", "state_performance", "trend_alerts", "churn_risk", "product_top30"]


def timed(df) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n]
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in WARM_UP:
        timed(registry.run(name, spark, sf_dir))
    runs: dict[str, list[float]] = {name: [] for name in names or registry.PLANS}
    for _ in range(int(os.environ.get("BENCH_RUNS", "3"))):
        for name, seconds in runs.items():
            began = time.perf_counter()
            timed(registry.run(name, spark, sf_dir))
            seconds.append(time.perf_counter() - began)
    times = {name: round(statistics.median(seconds), 3) for name, seconds in runs.items()}
    sf = Path(sf_dir).name.removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "all_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
