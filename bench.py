"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR is the folder of the tables, BENCH_CPUS the number of threads.
Each query's result is written to Spark's no-op sink, so all columns of all rows
are computed; one small query before the first warms the JVM up.
"""

from __future__ import annotations

import importlib
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: The first is the task that reference timings are published for: fourteen factors of daily bars.
HEADLINE = [
    "factor_benchmark",
    "flagship_mean_ratio",
    "roll_std_spine",
    "roll_corr",
    "factor_rank",
    "ema_span",
    "factor_wvma",
    "cs_rank",
    "cs_zscore_robust",
    "ic",
    "group_return",
    "brinson",
    "pit_mean2",
    "join_asof",
    "expr_filter_spans",
    "resample_mean",
    "session_bars",
    "ts_sample_list",
    "topk_dropout_backtest",
]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    from panelkite.session import local_session

    spark = local_session(cores=cpus, shuffles=int(cpus) if cpus.isdigit() else 8, memory="12g")
    queries = importlib.import_module("__spark_entry__").queries()
    names = HEADLINE + [q for q in ("op1_neardup", "op3_ngrams", "op5_mixing", "op6_lines", "op8_topk", "op10_pieces") if q in queries]
    queries["roll_mean"](spark, folder).limit(1).collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": scale}))


if __name__ == "__main__":
    main()
