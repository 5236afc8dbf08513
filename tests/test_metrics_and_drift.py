"""Closed-form cases for metrics, distances, monitors and alerts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from swipewatch.operators import drift as D
from swipewatch.operators import metrics as M
from swipewatch.operators import modeling as L
from swipewatch.operators import monitor as N
from swipewatch.operators import splits as S
from swipewatch.plans import tables as T

RANKED = [(0.9, 1), (0.8, 0), (0.8, 1), (0.4, 0), (0.3, 1), (0.1, 0)]


def labeled(spark, rows=RANKED):
    return spark.createDataFrame([(i, float(s), y) for i, (s, y) in enumerate(rows)], "source_row_id long, risk_score double, fraud_label int").withColumn("transaction_timestamp", F.lit("2020-01-01").cast("timestamp_ntz"))


def test_ranking_metrics(spark):
    m = M.ranking_metrics(labeled(spark), rows=6).first()
    # steps at .9, .8 (tie), .3: 1/3*1 + 1/3*2/3 + 1/3*3/5
    assert m["pr_auc"] == pytest.approx(1 / 3 + 2 / 9 + 1 / 5)
    wins = sum((a > b) + 0.5 * (a == b) for a, y in RANKED if y for b, z in RANKED if not z)
    assert m["roc_auc"] == pytest.approx(wins / 9)
    assert m["ks"] == pytest.approx(1 / 3) and m["ks_roc"] == pytest.approx(1 / 3)
    one_class = M.ranking_metrics(labeled(spark, [(0.2, 0), (0.4, 0)]), rows=2).first()
    assert one_class["pr_auc"] is None and one_class["roc_auc"] is None


def test_ks_forms_differ_for_a_reversed_score(spark):
    m = M.ranking_metrics(labeled(spark, [(0.1, 1), (0.2, 1), (0.8, 0), (0.9, 0)]), rows=4).first()
    assert m["ks"] == pytest.approx(1.0) and m["ks_roc"] == 0.0 and m["roc_auc"] == 0.0


def test_top_k_breaks_ties_by_time_and_id(spark):
    top = {r["top_k"]: r for r in M.top_k(labeled(spark), rates=(0.01, 0.34, 0.5), rows=6).collect()}
    assert (top[0.01]["selected_rows"], top[0.01]["fraud_captured"]) == (1, 1)
    # ceil(6 * .34) = 3: all of the tied pair
    assert (top[0.34]["selected_rows"], top[0.34]["fraud_captured"]) == (3, 2)
    two = M.top_k(labeled(spark), rates=(0.3,), rows=6).first()
    assert (two["selected_rows"], two["fraud_captured"]) == (2, 1)


def test_probability_metrics_and_reliability(spark):
    df = labeled(spark, [(0.1, 0), (0.1, 1), (0.3, 1), (1.0, 1), (0.0, 0)])
    p, y = np.array([0.1, 0.1, 0.3, 1.0, 0.0]), np.array([0, 1, 1, 1, 0])
    m = M.probability_metrics(df).first()
    c = np.clip(p, 1e-9, 1 - 1e-9)
    assert m["brier"] == pytest.approx(np.mean((c - y) ** 2)) and m["log_loss"] == pytest.approx(-np.mean(y * np.log(c) + (1 - y) * np.log(1 - c)))
    right = {r["bin"]: r["rows"] for r in M.reliability(df, closed="right").collect()}
    left = {r["bin"]: r["rows"] for r in M.reliability(df, closed="left").collect()}
    # linspace puts the fourth edge just above 0.3, so 0.3 stays in the third bin either way
    assert right == {0: 3, 2: 1, 9: 1} and left == {0: 1, 1: 2, 2: 1, 9: 1}
    assert M.calibration_monitor(df, "RANKING_ONLY").first()["status"] == "NOT_APPLICABLE"
    assert M.calibration_monitor(df, "PROBABILITY_USABLE").first()["status"] == "PASS"
    with pytest.raises(ValueError):
        M.calibration_monitor(df, "GUESS")
    assert M.calibration_audit(df, "PROBABILITY_USABLE").first()["status"] == "FAIL"


def test_equal_frequency_bins_match_quantile_cuts_of_the_rank(spark):
    import pandas as pd

    rows = [((i * 37 % 53) / 53, i % 2) for i in range(53)]
    got = {r["bin"]: r["rows"] for r in M.equal_frequency_bins(labeled(spark, rows), rows=53).collect()}
    want = pd.qcut(pd.Series([s for s, _ in rows]).rank(method="first"), q=10, labels=False).value_counts().to_dict()
    assert got == want


def test_performance_is_withheld_without_support(spark):
    df = labeled(spark, RANKED * 20).withColumn("g", F.when(F.col("source_row_id") < 12, "small").otherwise("large"))
    got = {r["g"]: r for r in M.performance_by(df, ["g"], rows=120).collect()}
    assert got["small"]["status"] == "INSUFFICIENT_SUPPORT" and got["small"]["pr_auc"] is None and got["small"]["prevalence"] == 0.5
    assert got["large"]["status"] == "PASS" and got["large"]["pr_auc"] is not None


def smooth(c):
    c = np.array(c, float)
    return (c + 1e-12) / (c.sum() + 1e-12 * len(c))


def test_count_distances(spark):
    a, b = [10, 20, 30, 0], [15, 15, 20, 10]
    p, q = smooth(a), smooth(b)
    m = (p + q) / 2
    arrays = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
    got = arrays.select(D.psi(F.col("a"), F.col("b")), D.jensen_shannon(F.col("a"), F.col("b")), D.total_variation(F.col("a"), F.col("b"))).first()
    assert got[0] == pytest.approx(np.sum((q - p) * np.log(q / p))) and got[2] == pytest.approx(0.5 * np.abs(p - q).sum())
    assert got[1] == pytest.approx(math.sqrt(0.5 * np.sum(p * np.log(p / m)) + 0.5 * np.sum(q * np.log(q / m))))
    assert spark.createDataFrame([([0, 0], [1, 2])], "a array<long>, b array<long>").select(D.psi(F.col("a"), F.col("b"))).first()[0] is None


def test_two_sample_distances(spark):
    rng = np.random.default_rng(3)
    x, y = np.round(rng.normal(0, 1, 60), 1), np.round(rng.normal(0.5, 1.5, 45), 1)
    to = lambda v: spark.createDataFrame([(float(i),) for i in v], "v double")
    got = D.two_sample(to(x), to(y), ["v"], rows=200).first()
    grid = np.unique(np.concatenate([x, y]))
    f, g = np.searchsorted(np.sort(x), grid, "right") / len(x), np.searchsorted(np.sort(y), grid, "right") / len(y)
    assert got["ks"] == pytest.approx(np.abs(f - g).max())
    assert got["wasserstein"] == pytest.approx(np.sum(np.abs(f - g)[:-1] * np.diff(grid)) / np.std(x))


def test_upper_gamma_at_whole_and_half_numbers(spark):
    """Whole numbers against the Poisson sum, half numbers against the error function's recursion."""
    def exact(a, x):
        if a == int(a):
            return math.exp(-x) * math.fsum(x**k / math.factorial(k) for k in range(int(a)))
        return math.erfc(math.sqrt(x)) + math.exp(-x) * math.fsum(x ** (k - 0.5) / math.gamma(k + 0.5) for k in range(1, int(a + 0.5)))

    cases = [(d / 2, x) for d in (1, 2, 3, 9, 30, 61) for x in (1e-9, 0.3, 1.5, 4.0, 15.0, 16.0, 40.0, 300.0)]
    df = spark.createDataFrame(cases, "a double, x double").withColumn("q", D.upper_gamma(F.col("a"), F.col("x")))
    for r in df.collect():
        assert r.q == pytest.approx(exact(r.a, r.x), rel=1e-9, abs=1e-14)
    edge = spark.createDataFrame([(None, 3), (2.0, 0), (0.0, 4)], "s double, d int").select(D.chi_squared_p(F.col("s"), F.col("d")).alias("p")).collect()
    assert math.isnan(edge[0].p) and [edge[1].p, edge[2].p] == [1.0, 1.0]


def test_chi_squared_tail(spark):
    def p_value(reference, current):
        df = spark.createDataFrame([(reference, current)], "a array<long>, b array<long>")
        return df.select(D.chi_squared_p(D.chi_squared_statistic(F.col("a"), F.col("b")), F.lit(len(reference) - 1))).first()[0]

    # exp(-x/2) is the exact tail at two degrees of freedom
    a, b = [10, 20, 30], [20, 20, 20]
    total, stat = 120, 0.0
    for row in (a, b):
        for v, column in zip(row, (30, 40, 50)):
            e = 60 * column / total
            stat += (v - e) ** 2 / e
    assert p_value(a, b) == pytest.approx(math.exp(-stat / 2), rel=1e-9)
    # one degree of freedom with Yates correction: erfc(sqrt(x / 2))
    e, gap = 15.0, 5.0 - 0.5
    assert p_value([10, 20], [20, 10]) == pytest.approx(math.erfc(math.sqrt(4 * gap * gap / e / 2)), rel=1e-9)
    assert math.isnan(p_value([0, 0], [1, 1]))


def test_frozen_bins_fallbacks(spark):
    to = lambda v: spark.createDataFrame([(float(i),) for i in v], "v double")
    one = D.frozen_bins(to([5.0] * 9), ["v"], rows=9)["v"]
    assert one == [-math.inf, 5.0 + 5e-6, math.inf]
    few = D.frozen_bins(to([0.0] * 99 + [1.0]), ["v"], rows=100)["v"]
    assert few == [-math.inf, 0.5, math.inf]
    many = D.frozen_bins(to([0.0] * 500 + [i / 40 for i in range(1, 21)]), ["v"], rows=520)["v"]
    assert len(many) == 11 and many[1] == pytest.approx(0.05) and many[0] == -math.inf
    normal = D.frozen_bins(to(range(101)), ["v"], rows=101)["v"]
    assert normal[1:-1] == pytest.approx([10 * i for i in range(1, 10)])
    with pytest.raises(ValueError, match="empty"):
        D.frozen_bins(to([]), ["v"], rows=0)


def test_same_frame_has_no_drift(spark):
    df = spark.range(500).select((F.col("id") % 97).cast("double").alias("x"), (F.col("id") % 4).cast("string").alias("c"))
    numeric = D.numeric_drift(df, D.numeric_reference(df, ["x"], rows=500), rows=500)
    cats = D.categorical_drift(df, D.category_reference(df, ["c"]), ["c"])
    assert all(abs(r["metric_value"]) < 1e-9 for r in numeric.collect() + cats.collect())
    shifted = df.withColumn("c", F.when(F.col("c") == "0", "new").otherwise(F.col("c")))
    new = {r["category"]: r for r in D.category_novelty(shifted, D.category_reference(df, ["c"]), ["c"]).collect()}
    assert new["new"]["is_new_category"] and new["new"]["reference_share"] == 0 and new["0"]["current_share"] == 0 and new["0"]["share_delta"] == -0.25


MONITORED = "w string, action string, candidate_action string, policy_version string, review_selected boolean, review_overflow boolean, bucket_capacity int, risk_score double, positive_exposure double"


def test_policy_and_review_monitors(spark):
    df = spark.createDataFrame([
        ("a", "REVIEW", "REVIEW", "P1", True, False, 1, 0.6, 10.0), ("a", "ALLOW", "REVIEW", "P1", False, True, 1, 0.5, 5.0),
        ("b", "DENY", "ALLOW", "P1", False, False, 1, 0.1, 1.0), ("c", "ALLOW", "ALLOW", "P1", False, False, 1, 0.1, 1.0), ("c", "ALLOW", "ALLOW", "P2", False, False, 2, 0.1, 1.0),
        ("d", "REVIEW", "REVIEW", "P1", True, False, 1, 0.6, 1.0), ("d", "REVIEW", "REVIEW", "P1", True, False, 1, 0.6, 1.0),
        ("e", "ALLOW", "REVIEW", "P1", False, False, 1, 0.6, 1.0)], MONITORED)
    policy = {r["window_id"]: r for r in N.policy_monitor(df, "w").collect()}
    assert policy["a"]["status"] == "PASS" and policy["a"]["review_rate"] == 0.5 and policy["b"]["reason"] == "Invalid actions" and policy["c"]["reason"].startswith("Multiple")
    review = {r["window_id"]: r for r in N.review_monitor(df, "w", rows=10).collect()}
    assert review["a"]["status"] == "PASS" and review["a"]["capacity_utilization"] == 1.0 and review["a"]["mean_review_score"] == 0.6 and review["a"]["mean_review_exposure"] == 10.0
    assert review["c"]["reason"].startswith("Inconsistent") and review["d"]["reason"].startswith("selected") and review["e"]["reason"].startswith("eligible")
    assert N.policy_monitor(df.drop("action"), "w").first()["status"] == "BLOCKED"


def test_graph_monitor(spark):
    df = spark.createDataFrame([("a", True, "G1", False), ("a", None, None, False), ("b", False, "G1", True), ("b", False, "G2", False)], "w string, pair_new boolean, graph_version string, graph_auto_block boolean")
    got = {r["window_id"]: r for r in N.graph_monitor(df, "w").collect()}
    assert got["a"]["pair_new_rate"] == 0.5 and got["a"]["graph_version"] == "G1" and got["a"]["graph_signal_missing_rate"] == 0.5 and got["a"]["status"] == "PASS"
    assert got["b"]["status"] == "FAIL" and got["b"]["graph_version"] == "MIXED"


def test_alert_severities_and_recommendations(spark):
    rows = [("w", "SCORE", "m", v, n, h) for v, n, h in ((0.5, 100, False), (0.15, 100, False), (0.05, 100, False), (0.5, 5, False), (None, 100, False), (0.01, 100, True))] + [("w", "GRAPH_CONTEXT", "other", 1.0, 100, False)]
    signals = spark.createDataFrame(rows, "window_id string, signal_family string, metric string, observed double, support long, hard_failure boolean")
    a = N.alerts(signals, {"m": (0.1, 0.2, 10)})
    got = sorted((r["metric"], r["severity"], r["observed"], r["support"]) for r in a.collect() if r["observed"] is not None)
    assert got == sorted([("m", "RED", 0.5, 100), ("m", "AMBER", 0.15, 100), ("m", "GREEN", 0.05, 100), ("m", "INSUFFICIENT_SUPPORT", 0.5, 5), ("m", "RED", 0.01, 100), ("other", "BLOCKED", 1.0, 100)])
    assert {r["severity"] for r in a.where("observed is null").collect()} == {"BLOCKED"}
    assert {r["recommendation"] for r in N.recommend(a).collect()} == {"INVESTIGATE", "GRAPH_REVIEW_RECOMMENDED"}
    for bad in ({}, {"m": (0.2, 0.1, 10)}, {"m": (0.1, None, 10)}, {"m": (0.1, 0.2, 0)}):
        with pytest.raises(ValueError):
            N.check_thresholds(bad)


def test_persistence(spark):
    h = spark.createDataFrame([("m", f"w{i}", b) for i, b in enumerate([True, True, False, False, True])], "metric string, window_id string, breach boolean")
    status = lambda rule: [r["persistent_status"] for r in N.persistence(h, rule).orderBy("window_id").collect()]
    assert status("2_of_3") == ["RED", "RED", "RED", "GREEN", "RED"]
    assert status("2_consecutive") == ["RED", "RED", "GREEN", "GREEN", "RED"]


def test_threshold_calibration_low_support(spark):
    few = spark.range(5).select(F.lit(0.5).alias("risk_score"), F.lit("VALIDATION").alias("split_name"), F.lit("D-1").alias("operational_window_id"))
    assert {r["status"] for r in N.calibrate_thresholds(few, rows=5).collect()} == {"INSUFFICIENT_SUPPORT"}
    one_window = spark.range(50).select((F.col("id") / 50).alias("risk_score"), F.lit("VALIDATION").alias("split_name"), F.lit("D-1").alias("operational_window_id"))
    assert {r["status"] for r in N.calibrate_thresholds(one_window, rows=50).collect()} == {"CANDIDATES_READY_LOW_SUPPORT"}
    only_final = one_window.withColumn("split_name", F.lit("FINAL_OOT"))
    assert {r["status"] for r in N.calibrate_thresholds(only_final, rows=50).collect()} == {"INSUFFICIENT_SUPPORT"}


def test_window_ids(spark):
    df = spark.createDataFrame([("2020-01-01 10:00:00",), ("2020-01-05 23:59:59",), ("2020-01-06 00:00:00",)], "t string").select(F.to_timestamp_ntz("t").alias("transaction_timestamp"))
    got = [tuple(r) for r in N.assign_windows(df).select("operational_window_id", "drift_window_id", "performance_window_id").collect()]
    assert got == [("D-2020-01-01", "W-2019-12-30_2020-01-05", "M-2020-01"), ("D-2020-01-05", "W-2019-12-30_2020-01-05", "M-2020-01"), ("D-2020-01-06", "W-2020-01-06_2020-01-12", "M-2020-01")]


def test_replay_reads_only_frozen_tables_and_hides_labels(spark, sf_dir, tmp_path):
    s = N.assign_windows(T.scored(spark, sf_dir).withColumnRenamed("merchant_category_code", "MCC")).persist()
    baseline = {}
    for name, table in N.build_baseline(s, rows=10_000).items():
        table.write.parquet(str(tmp_path / name))
        baseline[name] = spark.read.parquet(str(tmp_path / name))
    only_final = s.where("split_name = 'OUT_OF_TIME_OOT'")
    out = N.replay(only_final, baseline, rows=10_000)
    assert {"feature_drift", "novelty", "score", "alerts", "performance", "outcomes"} <= set(out)
    assert "performance" not in N.replay(only_final.drop("fraud_label"), baseline, rows=10_000)
    assert {r["severity"] for r in out["alerts"].collect()} == {"INSUFFICIENT_SUPPORT", "BLOCKED"}
    with pytest.raises(ValueError, match="observation"):
        N.replay(s.where("split_name = 'VALIDATION'"), baseline)
