"""Headline timings on one machine. Prints one JSON line.

Inputs of a stage are written to a temporary folder before it is timed, as on a
cluster where each stage reads a stored table; every timed query runs to the end.
``queries`` holds the second run of each query and ``first_run`` the first, which
also compiles its code.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from swipewatch.operators import behavior as B
    from swipewatch.operators import economics as E
    from swipewatch.operators import metrics as M
    from swipewatch.operators import monitor as N
    from swipewatch.operators import policy as P
    from swipewatch.operators import portfolio as R
    from swipewatch.operators import profiling as F
    from swipewatch.operators import quality as Q
    from swipewatch.operators import search as H
    from swipewatch.plans import tables as T
    from swipewatch.sources import readers

    work = tempfile.mkdtemp(prefix="swipewatch-bench-")
    seconds: dict[str, float] = {}
    first: dict[str, float] = {}

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    def timed(name, action):
        for record in (first, seconds):
            started = time.perf_counter()
            action()
            record[name] = round(time.perf_counter() - started, 3)

    def stored(df, name):
        df.write.mode("overwrite").parquet(f"{work}/{name}")
        return spark.read.parquet(f"{work}/{name}")

    txn = stored(T.model_splits(spark, SF_DIR).withColumnRenamed("split", "split_name"), "txn")
    rows = txn.count()
    T.raw_source(spark, SF_DIR).drop("source_row_id").write.mode("overwrite").option("header", True).csv(f"{work}/raw.csv")
    timed("csv_to_parquet", lambda: readers.csv_to_parquet(spark, f"{work}/raw.csv", f"{work}/raw_parquet"))
    timed("behavior_features", lambda: run(B.behavior_features(txn, rows=rows)))
    for family, columns in {
        "user_windows": [f"user_txn_count_{s}" for s in ("1h", "24h", "7d")] + ["user_prior_txn_count", "user_seconds_since_prev_txn"],
        "merchant_windows": ["merchant_prior_txn_count", "merchant_txn_count_1h", "merchant_txn_count_24h", "merchant_seconds_since_prev_txn"],
        "amount_windows": [f for f in B.FEATURES if "amount" in f],
    }.items():
        timed(family, lambda c=columns: run(B.behavior_features(txn, rows=rows).select("source_row_id", *c)))
    mart = stored(T.mart(spark, SF_DIR), "mart")
    scored = stored(T.scored(spark, SF_DIR), "scored")
    base = txn.withColumnRenamed("split_name", "split")
    dev = base.where("split = 'DEVELOPMENT'")
    config = P.PolicyConfig("BENCH", 0.55, 0.85, 0.01, "SCORE_ONLY")
    unlabeled = scored.drop("fraud_label")
    labels = scored.select("source_row_id", "fraud_label")
    timed("policy_pass", lambda: run(P.decide(unlabeled, config, rows=rows)))
    timed("policy_pass_exposure_rank", lambda: run(P.decide(unlabeled, P.PolicyConfig("B", 0.55, 0.85, 0.01, "EXPOSURE_WEIGHTED_RANK"), rows=rows)))
    timed("policy_evaluation", lambda: run(E.evaluate(E.join_labels(P.decide(unlabeled, config, rows=rows), labels))))
    # numbers are policies: 6 and 66 pairs of thresholds with six variants each, and allow-all
    timed("policy_grid_37", lambda: run(H.policy_grid(scored, H.quantile_thresholds(scored, rows=rows)[::3], rows=rows)))
    timed("policy_grid_397", lambda: run(H.policy_grid(scored, H.quantile_thresholds(scored, rows=rows), rows=rows)))
    timed("segment_priority", lambda: run(R.segment_priority(dev)))
    timed("concentration", lambda: [run(R.concentration(dev, e)) for e in R.ENTITIES])
    timed("quality_checks", lambda: run(Q.quality_checks(base)))
    timed("semantic_invariants", lambda: run(Q.semantic_invariants(mart)))
    timed("null_profile", lambda: run(F.null_profile(mart)))
    timed("numeric_signal", lambda: run(F.numeric_signal(mart)))
    timed("distribution_profile", lambda: run(F.distribution_profile(mart, rows=rows)))
    timed("ranking_metrics", lambda: run(M.ranking_metrics(scored, ["split_name"], rows=rows)))
    timed("top_k", lambda: run(M.top_k(scored, ["split_name"], rows=rows)))
    decided = stored(N.assign_windows(P.decide(unlabeled, config, rows=rows).withColumnRenamed("merchant_category_code", "MCC")), "decided")
    timed("baseline", lambda: [run(t) for t in N.build_baseline(decided, rows=rows).values()])
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "first_run": first, "sf": Path(SF_DIR).name, "rows": rows, "cpus": int(CPUS)}))
    spark.stop()


if __name__ == "__main__":
    main()
