"""Windowed monitors, alerts and the replay of a frozen baseline on new data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as X
from ..functions.scale import TASK_ROWS, quantiles, stored
from ..sources import contracts as C
from . import drift as D
from . import metrics as M
from .quality import text
from .splits import FINAL_SPLITS, observation_rows, reference_rows

WINDOWS = {"operational_window_id": "DAY", "drift_window_id": "WEEK", "performance_window_id": "MONTH"}
GRAPH_FLAGS = ("pair_new", "cold_card", "new_merchant", "cross_community")
# Fixed alert thresholds: amber, red, minimum support.
ALERT_THRESHOLDS = {"score_js": (0.16317, 0.16438, 10_000), "score_psi": (0.21624, 0.21950, 10_000), "channel_share": (0.57395, 0.57430, 10_000)}
SEVERITIES = ("GREEN", "AMBER", "RED", "BLOCKED", "INSUFFICIENT_SUPPORT", "NOT_APPLICABLE")
# Family part -> (incident, recommendation); the first part found in the family name decides.
RECOMMENDATIONS = {
    "DATA_QUALITY": ("DATA_INCIDENT", "DATA_QUALITY_REVIEW"), "PERFORMANCE": ("MODEL_HEALTH_INCIDENT", "MODEL_RETRAIN_REVIEW_RECOMMENDED"),
    "CALIBRATION": ("MODEL_HEALTH_INCIDENT", "CALIBRATION_REVIEW_RECOMMENDED"), "POLICY": ("POLICY_OPERATIONS_INCIDENT", "POLICY_REVIEW_RECOMMENDED"),
    "REVIEW": ("POLICY_OPERATIONS_INCIDENT", "POLICY_REVIEW_RECOMMENDED"), "GRAPH": ("GRAPH_CONTEXT_INCIDENT", "GRAPH_REVIEW_RECOMMENDED"),
}


def assign_windows(df: DataFrame, ts: str = "transaction_timestamp", windows: dict[str, str] = WINDOWS) -> DataFrame:
    return df.withColumns({name: X.monitoring_window(ts, frequency) for name, frequency in windows.items()})


def window_summary(df: DataFrame, window: str) -> DataFrame:
    return df.groupBy(window).agg(F.count("*").alias("row_count"))


def _exposure() -> Column:
    return X.dollars(F.sum(X.cents("positive_exposure")))


def window_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(*WINDOWS).agg(F.count("*").alias("row_count"))


def population_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("split_name", "channel").agg(F.count("*").alias("transactions"), _exposure().alias("exposure"))


def drift_inputs(df: DataFrame) -> DataFrame:
    missing = F.count_if(F.col("state_missing_flag").cast("int") == 1)
    return df.groupBy("drift_window_id", "channel").agg(
        F.count("*").alias("rows"), (F.sum(X.cents("amount")).cast("double") / (F.count("amount") * 100.0)).alias("mean_amount"), X.ratio(missing, F.count("*")).alias("state_missing_rate"))


def score_by_window(df: DataFrame, *, rows: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    q = quantiles(df, "risk_score", [0.5, 0.95], ["drift_window_id"], name="q", rows=rows, task_rows=task_rows)
    m = df.groupBy("drift_window_id").agg(F.count("*").alias("rows"), F.avg("risk_score").alias("mean_score"))
    return m.join(q, "drift_window_id", "left").select("drift_window_id", "rows", "mean_score", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"))


def action_mix(df: DataFrame) -> DataFrame:
    return df.groupBy("operational_window_id", "action").agg(F.count("*").alias("rows"))


def review_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("operational_window_id").agg(
        F.count_if(F.col("candidate_action") == "REVIEW").alias("review_candidates"), F.count_if(X.flag("review_selected")).alias("review_selected"), F.count_if(X.flag("review_overflow")).alias("review_overflow"))


def graph_rates(df: DataFrame) -> DataFrame:
    return df.groupBy("operational_window_id").agg(*[X.ratio(F.count_if(X.flag(g)), F.count("*")).alias(f"{g}_rate") for g in GRAPH_FLAGS])


def segment_means(df: DataFrame) -> DataFrame:
    return df.groupBy("drift_window_id", "channel").agg(
        F.count("*").alias("support"), (F.sum(X.cents("positive_exposure")).cast("double") / (F.count("positive_exposure") * 100.0)).alias("mean_exposure"), F.avg("risk_score").alias("mean_score"))


def matured_outcomes(df: DataFrame) -> DataFrame:
    hit = F.when(F.col("fraud_label") == 1, X.cents("positive_exposure")).otherwise(0)
    return df.groupBy("performance_window_id").agg(F.count("*").alias("transactions"), F.sum("fraud_label").cast("long").alias("fraud_count"), X.dollars(F.sum(hit)).alias("fraud_exposure"))


def daily_reconciliation(df: DataFrame) -> DataFrame:
    return df.groupBy("operational_window_id").agg(F.count("*").alias("assigned_rows"), F.count_if(F.col("operational_window_id").isNull()).alias("unassigned_rows"))


def window_reconciliation(df: DataFrame) -> DataFrame:
    per = daily_reconciliation(df)
    return per.agg(F.sum("assigned_rows").alias("mart_rows"), F.sum(F.col("assigned_rows") - F.col("unassigned_rows")).alias("assigned_window_rows"))


# --- monitors ---------------------------------------------------------------------------------------


def policy_monitor(df: DataFrame, window: str = "operational_window_id") -> DataFrame:
    """Action rates per window; FAIL on unknown actions or several policy versions, BLOCKED without actions."""
    if "action" not in df.columns:
        return df.groupBy(window).agg(F.count("*").alias("rows")).select(F.col(window).alias("window_id"), F.lit("BLOCKED").alias("status"), F.lit("Part 7 action evidence unavailable").alias("reason"))
    a = F.upper("action")
    version = F.col("policy_version") if "policy_version" in df.columns else F.lit(None).cast("string")
    counts = {v: F.count_if(a == v) for v in C.ACTIONS}
    cells = df.groupBy(F.col(window).alias("window_id")).agg(
        F.count("*").alias("_n"), F.count_if(~F.coalesce(a.isin(*C.ACTIONS), F.lit(False))).alias("_bad"), F.min(version).alias("_v1"), F.max(version).alias("_v2"), *[c.alias(f"{v.lower()}_count") for v, c in counts.items()])
    reason = F.when(F.col("_bad") > 0, "Invalid actions").when(F.col("_v1") != F.col("_v2"), "Multiple policy versions in one window")
    fine = reason.isNull()
    shown = lambda c: F.when(fine, c)
    return cells.select(
        "window_id", F.when(fine, "PASS").otherwise("FAIL").alias("status"), reason.alias("reason"), shown(F.col("_v1")).alias("policy_version"),
        *[shown(X.ratio(f"{v.lower()}_count", "_n")).alias(f"{v.lower()}_rate") for v in C.ACTIONS], *[shown(F.col(f"{v.lower()}_count")).alias(f"{v.lower()}_count") for v in C.ACTIONS])


def review_monitor(df: DataFrame, window: str = "operational_window_id", capacity: int | None = None, *, rows: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """Queue health per window, or per window and capacity bucket when rows carry a bucket."""
    split = capacity is None and "review_capacity_bucket" in df.columns
    window_id = F.concat_ws(":", F.col(window), F.col("review_capacity_bucket")) if split else F.col(window)
    a = F.upper("action")
    candidate = F.upper("candidate_action") == "REVIEW" if "candidate_action" in df.columns else a == "REVIEW"
    selected = X.flag("review_selected") if "review_selected" in df.columns else a == "REVIEW"
    overflow = X.flag("review_overflow") if "review_overflow" in df.columns else F.lit(False)
    cap_low, cap_high = (F.lit(capacity), F.lit(capacity)) if capacity is not None else (F.min("bucket_capacity"), F.max("bucket_capacity")) if "bucket_capacity" in df.columns else (F.lit(0), F.lit(0))
    marked = df.withColumns({"window_id": window_id, "_sel": selected})
    cells = marked.groupBy("window_id").agg(
        F.count("*").alias("_n"), F.count_if(candidate).alias("eligible_cases"), F.count_if("_sel").alias("selected_cases"), F.count_if(overflow).alias("overflow_cases"),
        cap_low.cast("long").alias("_low"), cap_high.cast("long").alias("capacity"), F.avg(F.when(F.col("_sel"), F.col("risk_score"))).alias("mean_review_score"),
        X.ratio(F.sum(F.when(F.col("_sel"), X.cents("positive_exposure"))), F.count_if("_sel") * 100).alias("mean_review_exposure"))
    q = quantiles(marked.where("_sel"), "risk_score", [0.9], ["window_id"], name="q", rows=rows, task_rows=task_rows)
    joined = cells.join(q, "window_id", "left")
    reason = (F.when(~F.col("_low").eqNullSafe(F.col("capacity")), "Inconsistent repeated bucket_capacity")
              .when(F.col("eligible_cases") != F.col("selected_cases") + F.col("overflow_cases"), "eligible != selected + overflow")
              .when((F.col("capacity") > 0) & (F.col("selected_cases") > F.col("capacity")), "selected reviews exceed capacity"))
    return joined.select(
        "window_id", F.when(reason.isNull(), "PASS").otherwise("FAIL").alias("status"), reason.alias("reason"), "eligible_cases", "selected_cases", "overflow_cases", "capacity",
        X.ratio("selected_cases", "capacity").alias("capacity_utilization"), X.ratio("eligible_cases", "_n").alias("candidate_rate"), X.ratio("selected_cases", "_n").alias("selected_rate"),
        X.ratio("overflow_cases", "_n").alias("overflow_rate"), "mean_review_score", F.col("q")[0].alias("p90_review_score"), "mean_review_exposure")


def graph_monitor(df: DataFrame, window: str = "operational_window_id") -> DataFrame:
    has = lambda c: c in df.columns
    rate = lambda c: X.ratio(F.count_if(X.flag(c)), F.count("*")) if has(c) else F.lit(0.0)
    version = F.col("graph_version").cast("string") if has("graph_version") else F.lit(None).cast("string")
    auto = F.coalesce(F.bool_or(X.flag("graph_auto_block")), F.lit(False)) if has("graph_auto_block") else F.coalesce(F.bool_or(F.lit(False)), F.lit(False))
    cells = df.groupBy(F.col(window).alias("window_id")).agg(
        *[rate(g).alias(f"{g}_rate") for g in GRAPH_FLAGS], F.min(version).alias("_a"), F.max(version).alias("_b"),
        X.ratio(F.count_if(version.isNull()), F.count("*")).alias("graph_signal_missing_rate"), auto.alias("graph_auto_block"))
    return cells.select(
        "window_id", F.when(F.col("graph_auto_block"), "FAIL").otherwise("PASS").alias("status"), F.when(F.col("_a") != F.col("_b"), "MIXED").otherwise(F.col("_a")).alias("graph_version"),
        *[f"{g}_rate" for g in GRAPH_FLAGS], "graph_signal_missing_rate", "graph_auto_block", F.lit("context_and_priority_only").alias("graph_governance"))


SEGMENT_TYPES = {"channel": "channel", "amount_band": "amount_band", "MCC": "MCC", "cold_start": "cold_card", "new_card_merchant_pair": "pair_new", "new_merchant": "new_merchant", "policy_action": "action", "risk_band": "risk_band"}


def add_segment_columns(df: DataFrame) -> DataFrame:
    if "amount" in df.columns:
        df = df.withColumn("amount_band", X.four_bands("amount", 25, 100, 500))
    if "risk_band" not in df.columns and "risk_score" in df.columns:
        df = df.withColumn("risk_band", X.four_bands("risk_score", 0.2, 0.5, 0.8))
    if "cold_start" not in df.columns and "cold_card" in df.columns:
        df = df.withColumn("cold_start", X.flag("cold_card"))
    return df


def segment_monitor(df: DataFrame, window_id: str = "") -> DataFrame:
    """Support, transaction share and exposure share of every segment value.

    Rows are summed per combination of segments before the unpivot.
    """
    s = add_segment_columns(df)
    present = {k: c for k, c in SEGMENT_TYPES.items() if c in s.columns}
    exposure = "positive_exposure" if "positive_exposure" in s.columns else "amount"
    combos = s.groupBy(*present.values()).agg(F.count("*").alias("n"), F.coalesce(F.sum(X.cents(exposure)), F.lit(0)).alias("x"))
    long = combos.selectExpr("n", "x", X.unpivot_stack([(text(k), X.segment_text(s, c)) for k, c in present.items()], ("segment_type", "segment")))
    cells = long.groupBy("segment_type", "segment").agg(F.sum("n").alias("support"), F.sum("x").alias("x"))
    every = Window.partitionBy("segment_type")
    return cells.select(F.lit(window_id).alias("window_id"), "segment_type", "segment", "support", X.ratio("support", F.sum("support").over(every)).alias("share_transactions"), X.ratio("x", F.sum("x").over(every)).alias("share_exposure"))


# --- thresholds and alerts --------------------------------------------------------------------------


def calibrate_thresholds(df: DataFrame, window: str = "operational_window_id", bins: int = 10, *, rows: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """Candidate amber/red limits: 95th and 99th percentile of per-window drift before the out-of-time split."""
    early = df.where(~F.upper(F.coalesce("split_name", F.lit("UNKNOWN"))).isin(*FINAL_SPLITS) & F.col("risk_score").isNotNull())
    spark = df.sparkSession
    schema = "metric string, candidate_amber double, candidate_red double, low double, middle double, high double, status string, candidate_support long"
    names = ("score_js", "score_psi", "channel_share")

    def low_support(status, support):
        return spark.createDataFrame([(n, None, None, None, None, None, status, support) for n in names], schema)

    if early.limit(20).count() < 20:
        return low_support("INSUFFICIENT_SUPPORT", 0)
    if window not in df.columns:
        return low_support("CANDIDATES_READY_LOW_SUPPORT", 0)
    edges = D.frozen_bins(early, ["risk_score"], bins, rows=rows, task_rows=task_rows)["risk_score"]
    per = early.groupBy(window).agg(F.count("*").alias("n"), D.histogram("risk_score", edges).alias("c"))
    usable = per.where("n >= 5")
    support = usable.count()
    if support < 3:
        return low_support("CANDIDATES_READY_LOW_SUPPORT", support)
    whole = early.agg(D.histogram("risk_score", edges).alias("all_c"), F.lit(1).alias("k"))
    both = usable.withColumn("k", F.lit(1)).join(F.broadcast(whole), "k")
    long = both.select(D.jensen_shannon(F.col("all_c"), F.col("c")).alias("js"), D.psi(F.col("all_c"), F.col("c")).alias("p")).selectExpr(X.unpivot_stack([("'score_js'", "js"), ("'score_psi'", "p")], ("metric", "v")))
    # One value per window: the calendar bounds this percentile.
    q = long.groupBy("metric").agg(F.percentile("v", F.array(*[F.lit(p) for p in (0.95, 0.99, 0.0, 0.5, 1.0)])).alias("q"))
    ready = q.select("metric", *[F.col("q")[i].alias(n) for i, n in enumerate(("candidate_amber", "candidate_red", "low", "middle", "high"))], F.lit("CANDIDATES_READY").alias("status"), F.lit(support).cast("long").alias("candidate_support"))
    return ready.unionByName(low_support("CANDIDATES_READY", support).where("metric = 'channel_share'"))


def check_thresholds(thresholds: dict[str, tuple[float, float, int]]) -> None:
    if not thresholds:
        raise ValueError("complete frozen alert thresholds are required")
    for name, (amber, red, support) in thresholds.items():
        if amber is None or red is None or red < amber or support <= 0:
            raise ValueError(f"frozen threshold of {name} is incomplete or out of order")


def severity(observed: Column, amber: Column, red: Column, support: Column, min_support: Column, hard_failure: Column) -> Column:
    short = support < F.coalesce(min_support, F.lit(0))
    unknown = observed.isNull() | amber.isNull() | red.isNull()
    return (F.when(hard_failure, "RED").when(short, "INSUFFICIENT_SUPPORT").when(unknown, "BLOCKED").when(observed >= red, "RED").when(observed >= amber, "AMBER").otherwise("GREEN"))


def alerts(signals: DataFrame, thresholds: dict[str, tuple[float, float, int]] = ALERT_THRESHOLDS) -> DataFrame:
    """Severity of each signal (window_id, signal_family, metric, observed, support [, hard_failure])."""
    limits = signals.sparkSession.createDataFrame([(k, *v) for k, v in thresholds.items()], "metric string, amber double, red double, min_support long")
    hard = X.flag("hard_failure") if "hard_failure" in signals.columns else F.lit(False)
    claim = F.col("claim_class") if "claim_class" in signals.columns else F.lit("EARLY_WARNING")
    joined = signals.join(F.broadcast(limits), "metric", "left")
    level = severity(F.col("observed"), F.col("amber"), F.col("red"), F.coalesce("support", F.lit(0)), F.col("min_support"), hard)
    return joined.select(
        F.concat(F.lit("P8-"), "metric", F.lit("-"), "window_id").alias("alert_id"), "window_id", F.coalesce("signal_family", F.lit("UNKNOWN")).alias("signal_family"), "metric", level.alias("severity"),
        "observed", F.col("red").alias("threshold"), F.coalesce("support", F.lit(0)).cast("long").alias("support"), claim.alias("claim_class"))


def alert_summary(alerted: DataFrame) -> DataFrame:
    return alerted.groupBy("severity", "signal_family").agg(F.count("*").alias("alerts"))


def persistence(history: DataFrame, rule: str = "2_of_3", key: Sequence[str] = ("metric",), order: str = "window_id", breach: str = "breach") -> DataFrame:
    """Confirmed status after each window: RED when the rule holds over the last windows, else the window's own status."""
    w = Window.partitionBy(*key).orderBy(order)
    own = F.when(F.col(breach), "RED").otherwise("GREEN")
    hit = F.when(F.col(breach), 1).otherwise(0)
    last = 2 if rule == "2_consecutive" else 3
    recent = F.sum(hit).over(w.rowsBetween(-(last - 1), 0))
    return history.withColumn("persistent_status", F.when(recent >= 2, "RED").otherwise(own))


def recommend(alerted: DataFrame) -> DataFrame:
    family = F.upper(F.coalesce("signal_family", F.lit("")))
    incident, action = F.lit("GOVERNANCE_INCIDENT"), F.lit("INVESTIGATE")
    for part, (i, a) in reversed(RECOMMENDATIONS.items()):
        hit = family.contains(part)
        incident, action = F.when(hit, i).otherwise(incident), F.when(hit, a).otherwise(action)
    body = F.to_json(F.struct(*sorted(alerted.columns)), {"ignoreNullFields": "false"})
    return alerted.select("window_id", incident.alias("incident_type"), action.alias("recommendation"), "severity",
                          F.lit("aggregate monitoring evidence requires owner review; no automatic model or policy mutation").alias("rationale"), F.sha2(body, 256).alias("evidence_hash"))


def root_cause(feature_drift: DataFrame, novelty: DataFrame, score: DataFrame, segments: DataFrame, top: int = 5) -> DataFrame:
    """The largest movements per evidence table; association, not cause."""
    part = lambda df, section, name, value: df.select(F.lit(section).alias("section"), name.alias("item"), F.col(value).cast("double").alias("value")).orderBy(F.desc_nulls_last("value"), "item").limit(top)
    return (
        part(feature_drift, "top_drifting_features", F.concat_ws(":", "feature_name", "metric_name"), "metric_value")
        .unionByName(part(novelty, "top_new_categories", F.concat_ws(":", "feature_name", "category"), "share_delta"))
        .unionByName(part(score, "score_shift", F.col("metric"), "observed"))
        .unionByName(part(segments, "segments_affected", F.concat_ws(":", "segment_type", F.coalesce("segment", F.lit("nan"))), "share_transactions")))


NUMERIC_MONITORED = ("amount", "risk_score", "state_missing_flag")
CATEGORICAL_MONITORED = ("channel", "MCC", "pair_new", "cold_card", "new_merchant", "cross_community")


def build_baseline(df: DataFrame, **bounds) -> dict[str, DataFrame]:
    """Frozen tables from the pre-out-of-time rows: numeric and category references and the score reference."""
    # Several tables are read from these rows, so they are written once.
    numeric = [c for c in NUMERIC_MONITORED if c in df.columns]
    categorical = [c for c in CATEGORICAL_MONITORED if c in df.columns]
    reference = stored(reference_rows(C.operational_view(df.drop("fraud_label"))).select(*numeric, *categorical))
    return {"numeric": D.numeric_reference(reference, numeric, **bounds), "categories": D.category_reference(reference, categorical), "score": D.score_reference(reference, **bounds)}


def replay(df: DataFrame, baseline: dict[str, DataFrame], thresholds: dict[str, tuple[float, float, int]] = ALERT_THRESHOLDS, *, written: bool = False, **bounds) -> dict[str, DataFrame]:
    """Every monitor on the out-of-time rows, from frozen tables only; outcome tables only if labels are there. ``written`` rows are read from
    files already."""
    check_thresholds(thresholds)
    # A dozen reports read the observation, a few columns each, so it is written once.
    observed = observation_rows(df) if written else stored(observation_rows(df))
    if observed.isEmpty():
        raise ValueError("replay requires an out-of-time observation scope")
    label = "FINAL_OOT"
    now = observed.drop("fraud_label")
    categorical = [c for c in CATEGORICAL_MONITORED if c in df.columns]
    numeric = D.numeric_drift(now, baseline["numeric"], label, **bounds)
    cats = D.categorical_drift(now, baseline["categories"], categorical, label)
    columns = ["window_id", "feature_name", "feature_type", "reference_n", "current_n", "metric_name", "metric_value"]
    out = {
        "windows": window_summary(now, "drift_window_id"), "quality": C.quality_profile(now), "feature_drift": numeric.select(*columns).unionByName(cats.select(*columns)),
        "novelty": D.category_novelty(now, baseline["categories"], [c for c in ("channel", "MCC") if c in df.columns], label), "score": D.score_drift(now, baseline["score"], label, **bounds),
        "policy": policy_monitor(now), "graph": graph_monitor(now), "segments": segment_monitor(now, label)}
    if "action" in df.columns:
        out["review"] = review_monitor(now, **bounds)
    support = now.count()
    signals = out["score"].select("window_id", F.lit("SCORE").alias("signal_family"), "metric", "observed", F.lit(support).cast("long").alias("support"), "claim_class")
    out["alerts"] = alerts(signals, thresholds)
    out["alert_summary"] = alert_summary(out["alerts"])
    out["recommendations"] = recommend(out["alerts"])
    out["root_cause"] = root_cause(out["feature_drift"], out["novelty"], out["score"], out["segments"])
    if "fraud_label" in df.columns:
        matured = C.matured_view(observed)
        out["performance"] = M.performance_by(matured, ["performance_window_id"], **bounds)
        out["outcomes"] = M.outcome_metrics(matured)
        out["calibration"] = M.calibration_monitor(matured)
    return out
