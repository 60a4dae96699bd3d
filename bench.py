"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed completely through Spark's ``noop`` sink (every row
computed, nothing collected to the driver).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from laggard.plans.registry import QUERIES  # noqa: E402
from laggard.session import get_spark  # noqa: E402

HEADLINE = [
    "m0_delayed_errors",            # flagship: F1 -> K06 -> ST07 -> W01/W02
    "st01_st13_immediate_learner",
    "st06_w13_hedge_ensemble",
    "a23_a25_w11_scorecard",
    "a01_a02_a27_method_metrics",
    "w04_cont_latent",
    "w06_window_cont_latent",
    "w08_impute_missing",
    "p05_apply_bins",
    "k02_mask_cells",
    "b04_density_peaks",
    "b06_propagation_rounds",
    "f10_f19_fusion",
    "a03_a07_imputation_errors",
    # the costly part: streaming, mini-batches, window propagation
    "st07_live_replay",
    "st21_minibatch_ftrl",
    "b11_b12_two_view_propagation",
    "st08_delayed_ensemble",
    "st14_st15_speculative",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = os.environ.get("BENCH_QUERIES")
    names = only.split(",") if only else HEADLINE
    spark = get_spark(cores=cpus)
    # one-time session start-up (JVM JIT, Python worker launch) is reported separately: a
    # tiny job that touches no benchmark table and no headline query
    t0 = time.time()
    spark.range(10000).selectExpr("sum(id)").collect()
    spark.range(1000).mapInPandas(lambda it: it, "id long").count()
    warmup = round(time.time() - t0, 3)
    times: dict[str, float] = {}
    for name in names:
        fn = QUERIES[name]
        t0 = time.time()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus,
                      "session_warmup_sec": warmup}))


if __name__ == "__main__":
    main()
