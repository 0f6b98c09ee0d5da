"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is planned and run to a noop sink: one warm-up, then the median of the timed runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from barloom import build_session
from barloom.catalog import QUERIES

HEADLINE = (
    "agg_01 prj_05 prj_09 win_01 win_02 win_06 win_12 win_20 win_21 win_22 win_34 win_44 win_45 jon_02 jon_03 jon_05 jon_08 "
    "agg_04 agg_08 mat_01 mat_03 mat_09 top_02 prp_01 prp_04 prp_07 prp_11 agg_25 evl_07 evl_08 evl_24 str_01"
).split()


def run_once(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", cores, int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        run_once(spark, name, folder)
        times[name] = round(statistics.median(run_once(spark, name, folder) for _ in range(repeats)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
