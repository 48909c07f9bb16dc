"""Times the headline queries and prints one JSON line. Every query is run in full into the noop sink.

Models are trained once in a session: m7_posterior_fit and m3_random_search hold the training (features included), the
queries after them score and evaluate with what is stored.
"""

from __future__ import annotations

import json
import os
import time

from riskframe.plans import catalog
from riskframe.session import build_session

HEADLINE = [
    "o1_chronological_split",
    "a1_split_summary",
    "a9_missingness_label",
    "a10_time_buckets",
    "w4_velocity_grid",
    "w4_velocity_bulk",
    "wx2_velocity_chunked",
    "e1_fit_amount",
    "e3_fit_address",
    "e9_behavioral_block",
    "e10_identity_block",
    "e11_all_features",
    "v9_metrics_matrix",
    "v11_uncertainty_summary",
    "v12_fn_recovery",
    "v14_disagreement",
    "m7_newton_step",
    "m8_posterior_predictive",
    "m7_posterior_fit",
    "m8_posterior_scores",
    "m3_random_search",
    "v19_full_evaluation",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus), app="riskframe-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    queries["a6_class_balance"](spark, folder).collect()  # starts the JVM and the Python workers
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
