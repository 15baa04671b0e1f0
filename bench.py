"""Headline benchmark: seconds per query on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR``.

Prints one JSON line. Each query runs to the ``noop`` sink: once to warm up, then ``BENCH_RUNS``
times, of which the median counts. Building the DataFrame is timed too, since multi-symbol
queries compute their shared cube there. ``BENCH_ALL=1`` times every registered query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from workload.queries import QUERIES  # noqa: E402

HEADLINE = (
    "grt_global", "grt_reldiff", "grt_index", "scope2", "ci_elec", "sci_scope1", "sci_scope2",
    "sci_scope3", "trade_imports", "trade_net", "trade_share", "trade_scenario", "emis", "elec",
    "gdp_region", "tec_by_sector", "tec_exports", "ne_inputs_bd", "sd_2d", "steel_mix",
    "cement_mix", "fuel_shares", "liquids_mix", "fit_mix", "pivot_sum", "cht_stack_signed",
)


def seconds(spark: SparkSession, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="checkpoint-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for _ in range(3):  # the first queries of a session pay for class loading and compilation
        seconds(spark, names[0], sf_dir)
    timings = {}
    for name in names:
        seconds(spark, name, sf_dir)
        timings[name] = round(statistics.median(seconds(spark, name, sf_dir) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
