"""Ranking, probability and calibration metrics.

Rows are first reduced to one row per distinct score; every curve metric is then
an aggregate over running counts of that table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.scale import BROADCAST_ROWS, TASK_ROWS, cut, join_same, prefix, ranked, rows_at_most, stored

TOP_RATES = (0.005, 0.01, 0.02, 0.05, 0.10)


def score_table(df: DataFrame, by: Sequence[str] = (), score: str = "risk_score", label: str = "fraud_label", *, rows: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """(by, score) -> rows, frauds and their running totals from the highest score down."""
    valid = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    cells = valid.groupBy(*by, F.col(score).cast("double").alias("score")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    return running_scores(cells, by, rows=rows, task_rows=task_rows)


def running_scores(cells: DataFrame, by: Sequence[str] = (), *, rows: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    if rows is None or rows > task_rows:  # read again for their number and for the ranges
        cells = stored(cells)
    return prefix(cells, by, [F.desc("score")], {"cum_n": ("n", "sum"), "cum_pos": ("pos", "sum")}, rows=rows, task_rows=task_rows)


def _totals(table: DataFrame, by: Sequence[str]) -> DataFrame:
    return table.groupBy(*by).agg(F.sum("n").alias("total"), F.sum("pos").alias("total_pos"))


def _with_totals(table: DataFrame, by: Sequence[str]) -> DataFrame:
    if by:
        return join_same(table, _totals(table, by), by, "inner")
    one = F.broadcast(_totals(table, by).withColumn("_k", F.lit(1)))
    return table.withColumn("_k", F.lit(1)).join(one, "_k").drop("_k")


def ranking_metrics(df: DataFrame, by: Sequence[str] = (), score: str = "risk_score", label: str = "fraud_label", *, rows: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """Average precision, ROC-AUC and both KS forms, NULL where only one class is present.

    ``ks`` is the largest absolute gap of the two score distributions, ``ks_roc``
    the largest tpr - fpr.
    """
    return ranking_of_scores(score_table(df, by, score, label, rows=rows, task_rows=task_rows), by)


def ranking_of_scores(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same from a ``score_table``."""
    t = _with_totals(table, by)
    pos, neg = F.col("total_pos"), F.col("total") - F.col("total_pos")
    cum_neg = F.col("cum_n") - F.col("cum_pos")
    gap = X.ratio(F.col("cum_pos"), pos) - X.ratio(cum_neg, neg)
    exact = lambda c: c.cast("decimal(19,0)")
    won = exact(F.col("n") - F.col("pos")) * exact(2 * (F.col("cum_pos") - F.col("pos")) + F.col("pos"))
    per = t.groupBy(*by).agg(
        F.max("total").alias("rows"), F.max("total_pos").alias("fraud_rows"),
        F.sum(X.ratio("pos", pos) * X.ratio("cum_pos", "cum_n")).alias("_ap"),
        X.ratio(F.sum(won), F.lit(2.0) * F.max(pos).cast("double") * F.max(neg).cast("double")).alias("_auc"),
        F.max(F.abs(gap)).alias("_ks"), F.greatest(F.lit(0.0), F.max(gap)).alias("_ks_roc"))
    both = (F.col("fraud_rows") > 0) & (F.col("fraud_rows") < F.col("rows"))
    return per.select(
        *by, "rows", "fraud_rows", X.ratio("fraud_rows", "rows").alias("prevalence"), F.when(both, F.col("_ap")).alias("pr_auc"), F.when(both, F.col("_auc")).alias("roc_auc"),
        F.when(both, F.col("_ks")).alias("ks"), F.when(both, F.col("_ks_roc")).alias("ks_roc"))


def probability_metrics(df: DataFrame, by: Sequence[str] = (), probability: str = "risk_score", label: str = "fraud_label", eps: float = 1e-9) -> DataFrame:
    """Brier score and log loss of clipped probabilities."""
    p = F.least(F.greatest(F.col(probability), F.lit(eps)), F.lit(1 - eps))
    y = F.col(label)
    valid = df.where(F.col(probability).isNotNull() & y.isNotNull())
    return valid.groupBy(*by).agg(
        F.count("*").alias("rows"), F.avg((p - y) * (p - y)).alias("brier"),
        F.avg(-F.when(y == 1, F.ln(p)).otherwise(F.ln(1 - p))).alias("log_loss"))


def top_k(df: DataFrame, by: Sequence[str] = (), rates: Sequence[float] = TOP_RATES, score: str = "risk_score", label: str = "fraud_label",
          ties: Sequence[str] = ("transaction_timestamp", "source_row_id"), *, rows: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """Fraud captured in the best ceil(N x rate) rows, ties in time and id order.

    Rows are never ranked as a whole: running counts give the score at each cut,
    and only rows with exactly that score are put in order. The cuts, a few for
    each group, are written once and sent to the rows if their number allows it.
    """
    t = _with_totals(score_table(df, by, score, label, rows=rows, task_rows=task_rows), by)
    cuts = t.withColumn("top_k", F.explode(F.array(*[F.lit(float(r)) for r in rates])))
    k = F.greatest(F.lit(1), F.ceil(F.col("total") * F.col("top_k")))
    start = F.col("cum_n") - F.col("n")
    cuts = cuts.where((start < k) & (k <= F.col("cum_n"))).select(
        *by, "top_k", F.col("score").alias("_cut"), k.alias("selected_rows"), (k - start).alias("_need"), "n", "total", "total_pos", (F.col("cum_pos") - F.col("pos")).alias("_sure"), "pos")
    cuts = cut(cuts)
    split = cuts.where(F.col("_need") < F.col("n"))
    split = F.broadcast(split) if rows_at_most(cuts, BROADCAST_ROWS, None if by else len(rates)) else split
    tied = join_same(df.select(*by, F.col(score).cast("double").alias("_cut"), F.col(label).cast("long").alias("_y"), *ties).where(F.col("_y").isNotNull()),
                     split.select(*by, "_cut", "top_k", "_need"), [*by, "_cut"], "inner")
    placed = ranked(tied, [*by, "top_k"], list(ties), "_rank", rows=rows, task_rows=task_rows)
    some = placed.where(F.col("_rank") <= F.col("_need")).groupBy(*by, "top_k").agg(F.sum("_y").alias("_part"))
    done = join_same(cuts, some, [*by, "top_k"])
    captured = F.col("_sure") + F.when(F.col("_need") == F.col("n"), F.col("pos")).otherwise(F.coalesce("_part", F.lit(0)))
    return done.withColumn("fraud_captured", captured).select(
        *by, "top_k", "selected_rows", "fraud_captured", X.ratio("fraud_captured", "total_pos").alias("fraud_capture_rate"), X.ratio("fraud_captured", "selected_rows").alias("precision"),
        X.ratio(X.ratio("fraud_captured", "selected_rows"), X.ratio("total_pos", "total")).alias("lift"))


def equal_frequency_bins(df: DataFrame, bins: int = 10, probability: str = "risk_score", label: str = "fraud_label",
                         ties: Sequence[str] = ("transaction_timestamp", "source_row_id"), *, rows: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """Calibration by equal-frequency bins of the first rank."""
    valid = df.where(F.col(probability).isNotNull() & F.col(label).isNotNull()).select(probability, label, *ties)
    placed = ranked(valid, [], [probability, *ties], "_rank", rows=rows, task_rows=task_rows)
    one = F.broadcast(valid.agg(F.count("*").alias("_n"), F.lit(1).alias("_k")))
    sized = placed.withColumn("_k", F.lit(1)).join(one, "_k")
    q = F.least(F.lit(bins), F.col("_n"))
    step = F.greatest(F.col("_n") - 1, F.lit(1))
    number = F.greatest(F.lit(1), F.floor(((F.col("_rank") - 1) * q + step - 1) / step)) - 1
    return sized.groupBy(number.cast("int").alias("bin")).agg(
        F.count("*").alias("rows"), F.avg(probability).alias("mean_predicted_probability"), (F.sum(label).cast("double") / F.count("*")).alias("observed_fraud_rate"))


def width_bin(p: Column, bins: int, closed: str) -> Column:
    """Index of an equal-width bin of [0, 1], closed on the named side; both end points belong to a bin."""
    edges = np.linspace(0, 1, bins + 1)
    inner = edges[1:-1]
    out = F.when(p.isNull(), F.lit(None).cast("int"))
    for i, edge in enumerate(inner):
        out = out.when(p <= float(edge) if closed == "right" else p < float(edge), i)
    return out.otherwise(bins - 1)


def reliability(df: DataFrame, bins: int = 10, closed: str = "right", probability: str = "risk_score", label: str = "fraud_label") -> DataFrame:
    """Mean prediction against observed rate per equal-width bin; empty bins are left out."""
    p = F.col(probability).cast("double")
    valid = df.where(p.between(0, 1) & F.col(label).isNotNull())
    cells = valid.groupBy(width_bin(p, bins, closed).alias("bin")).agg(
        F.count("*").alias("rows"), F.avg(p).alias("mean_predicted_probability"), (F.sum(label).cast("double") / F.count("*")).alias("observed_fraud_rate"))
    return cells.withColumn("bin_gap", F.abs(F.col("mean_predicted_probability") - F.col("observed_fraud_rate")))


def calibration_audit(df: DataFrame, score_status: str = "RANKING_ONLY", calibration_version: str | None = None, bins: int = 10) -> DataFrame:
    """Brier, log loss and expected calibration error; no calibrator is fitted."""
    valid = df.where(F.col("risk_score").between(0, 1) & F.col("fraud_label").isNotNull())
    y, p = F.col("fraud_label"), F.col("risk_score")
    sure = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    one = valid.agg(F.count("*").alias("rows"), F.avg((p - y) * (p - y)).alias("brier_score"),
                    F.avg(-F.when(y == 1, F.ln(sure)).otherwise(F.ln(1 - sure))).alias("log_loss"), F.lit(1).alias("k"))
    table = reliability(df, bins, "right")
    ece = table.agg((F.sum(F.col("bin_gap") * F.col("rows")) / F.sum("rows")).alias("expected_calibration_error"), F.lit(1).alias("k"))
    ok = score_status == "RANKING_ONLY" or bool(calibration_version)
    return one.join(F.broadcast(ece), "k").select(
        "rows", "brier_score", "log_loss", "expected_calibration_error", F.when(F.col("rows") == 0, "FAIL").otherwise("PASS" if ok else "FAIL").alias("status"),
        F.lit(score_status == "PROBABILITY_USABLE" and bool(calibration_version)).alias("expected_value_enabled"))


def calibration_monitor(df: DataFrame, score_status: str = "RANKING_ONLY", bins: int = 10) -> DataFrame:
    """Matured calibration, only meaningful when scores are usable as probabilities."""
    if score_status not in ("RANKING_ONLY", "PROBABILITY_USABLE"):
        raise ValueError(f"unknown score status {score_status}")
    if score_status == "RANKING_ONLY":
        none = F.lit(None).cast("double")
        return df.agg(F.count("*").alias("support")).select(F.lit("NOT_APPLICABLE").alias("status"), none.alias("brier"), none.alias("log_loss"), none.alias("ece"), "support")
    clipped = df.withColumn("risk_score", F.least(F.greatest("risk_score", F.lit(0.0)), F.lit(1.0)))
    eps = float(np.finfo(np.float64).eps)
    one = probability_metrics(clipped, eps=0.0 + eps).withColumn("k", F.lit(1))
    table = reliability(clipped, bins, "left")
    ece = table.agg((F.sum(F.col("bin_gap") * F.col("rows")) / F.sum("rows")).alias("ece"), F.lit(1).alias("k"))
    return one.join(F.broadcast(ece), "k").select(F.when(F.col("rows") == 0, "INSUFFICIENT_SUPPORT").otherwise("PASS").alias("status"), "brier", "log_loss", "ece", F.col("rows").alias("support"))


def performance_by(df: DataFrame, by: Sequence[str], min_fraud: int = 30, rates: Sequence[float] = TOP_RATES, *, rows: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """Ranking metrics and top-K capture per group, withheld without enough fraud."""
    m = ranking_metrics(df, by, rows=rows, task_rows=task_rows)
    k = top_k(df, by, rates, rows=rows, task_rows=task_rows)
    wide = k.groupBy(*by).agg(*[F.max(F.when(F.col("top_k") == float(r), F.col("fraud_capture_rate"))).alias(f"top_{r:.3f}_capture".replace(".", "_")) for r in rates])
    joined = join_same(m, wide, by)
    enough = (F.col("fraud_rows") >= min_fraud) & (F.col("fraud_rows") > 0) & (F.col("fraud_rows") < F.col("rows"))
    shown = lambda c: F.when(enough, F.col(c))
    return joined.select(
        *by, F.col("rows").alias("support"), F.col("fraud_rows").alias("fraud_support"), F.when(enough, "PASS").otherwise("INSUFFICIENT_SUPPORT").alias("status"),
        shown("pr_auc").alias("pr_auc"), shown("roc_auc").alias("roc_auc"), shown("ks_roc").alias("ks"), "prevalence",
        *[shown(f"top_{r:.3f}_capture".replace(".", "_")).alias(f"top_{r:.3f}_capture".replace(".", "_")) for r in rates])


def outcome_metrics(df: DataFrame) -> DataFrame:
    y = F.coalesce(F.col("fraud_label").cast("long"), F.lit(0))
    x = F.greatest(F.coalesce(X.cents("amount"), F.lit(0)), F.lit(0))
    one = df.agg(F.count("*").alias("transactions"), F.sum(y).alias("fraud_count"), F.sum(F.when(y != 0, x).otherwise(0)).alias("_f"), F.sum(x).alias("_x"))
    return one.select("transactions", "fraud_count", X.ratio("fraud_count", "transactions").alias("fraud_rate"), X.dollars(F.col("_f")).alias("fraud_positive_exposure"), X.ratio("_f", "_x").alias("fraud_amount_rate"))
