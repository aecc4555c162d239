"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run twice and fully evaluated into a no-op sink; the second, warm time counts, the first is listed too.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tapeloom.plans.registry import all_queries  # noqa: E402
from tapeloom.session import build_session  # noqa: E402

HEADLINE = (
    "w02_sma", "w04_rsi", "w06_macd", "a01_group_stats", "a34_portfolio_risk", "v03_implied_vol", "v04_lattice_american", "j10_max_pain", "k01_top_opportunities", "q07_bar_anomalies", "m15_ks_drift", "t01_lexicon_score",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("OFF")
    found = all_queries()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    warm, cold = {}, {}
    for name in names:
        for times in (cold, warm):
            t0 = time.perf_counter()
            found[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        print(name, cold[name], warm[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, warm total", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "first_run": cold,
        "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus, "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
