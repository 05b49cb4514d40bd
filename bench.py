"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (input folder), BENCH_CPUS (local threads), BENCH_REPEAT (timed runs).
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

from tidemark.plans import load_all
from tidemark.plans.registry import QUERIES, forget_shared
from tidemark.session import build_session

HEADLINE = [
    "flagship_top_funds", "wn_price_metrics", "wn_forward_panel", "fe_customer_features",
    "cln_fill_within_key", "jn_priority_lookup", "rc_build_catalogue", "rc_recommend",
    "wn_clamp_band", "jn_attach_benchmark", "rc_recommend_by_horizon", "dr_detect_drift", "dr_population_drift", "ev_roc_auc_ovr", "ev_classification_report",
    "ag_describe_columns", "ag_correlation_matrix", "tx_redact_pii", "pv_robust_vector_mean", "st_ttl_dedupe",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    spark = build_session(
        "tidemark-bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=str(max(4, int(cpus))),
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="12g",
        spark__checkpoint__dir=f"file://{tempfile.mkdtemp(prefix='bench-')}")
    spark.sparkContext.setLogLevel("ERROR")
    load_all()

    def run(name: str) -> float:
        forget_shared()  # every run builds the stage tables it needs
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        run(name)  # warm-up: class loading and code generation
        seconds[name] = round(statistics.median(run(name) for _ in range(repeat)), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
