"""Weighted logistic model, temporal validation and calibration: fits by sums of tasks, scores as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.contracts import CURRENT_CONTEXT, feature_violations
from . import metrics as M
from . import splits as S
from .behavior import FEATURES
from .isotonic import isotonic_blocks, isotonic_probability
from .logistic import Design, Logistic, Problem, fit_all, stacked, union_all

CATEGORICAL = ("use_chip", "merchant_category_code")
FEATURE_SETS = {
    "F0": list(CURRENT_CONTEXT),
    "F1": list(FEATURES),
    "F2": [*CURRENT_CONTEXT, *[f for f in FEATURES if f not in CURRENT_CONTEXT]],
}


def _checked(train: DataFrame, sets: dict[str, list[str]]) -> None:
    for features in sets.values():
        bad = feature_violations(train, features)
        if bad:
            raise ValueError(f"forbidden or missing model inputs {bad}")


def fit_sets(train: DataFrame, sets: dict[str, list[str]], weight: str = "sample_weight", c: float = 1.0, label: str = "fraud_label", *, rows: int | None = None) -> dict[str, Logistic]:
    """A model for each feature set, all in the same passes over ``train``.

    The constant 1 is an input like the others, so the intercept is penalised too. That is what the surveyed solver does; with its weight
    of one coefficient among many it hardly matters for ranking, but coefficients would differ without it.
    """
    _checked(train, sets)
    return fit_all(train, {n: Problem(tuple(f)) for n, f in sets.items()}, weight=weight, c=c, label=label, categorical=CATEGORICAL, rows=rows)


def fit(train: DataFrame, features: list[str], weight: str = "sample_weight", c: float = 1.0, label: str = "fraud_label") -> Logistic:
    return fit_sets(train, {"model": features}, weight, c, label)["model"]


def importance(model: Logistic, df: DataFrame, top: int = 15) -> DataFrame:
    """Largest coefficients by size, ties by name, without the intercept; their number is the width of the model, not of the data."""
    rows = [(n, float(b), abs(float(b)), "predictive association; not causal") for n, b in zip(model.design.names, model.coefficients, strict=True) if n != "intercept"]
    return df.sparkSession.createDataFrame(rows, "feature_name string, coefficient double, absolute_coefficient double, interpretation string").orderBy(F.desc("absolute_coefficient"), "feature_name").limit(top)


def fold_scopes(dev: DataFrame, folds: int = 3):
    """Conditions on the rows of each fold: (fold -> training rows, fold -> validation rows). Their number is that of the folds."""
    day, train, valid = F.to_date("transaction_timestamp"), {}, {}
    for r in S.temporal_folds(dev, folds).orderBy("fold").collect():
        train[r["fold"]] = day <= F.lit(r["train_end"])
        valid[r["fold"]] = day.between(F.lit(r["validation_start"]), F.lit(r["validation_end"]))
    return train, valid


def fit_folds(dev: DataFrame, sets: dict[str, list[str]], train: dict, weight: str = "sample_weight", label: str = "fraud_label", *, rows: int | None = None) -> dict[tuple[str, int], Logistic]:
    """A model for each feature set and fold. A step of all of them is one pass: a row adds to every fold that learns from it."""
    _checked(dev, sets)
    problems = {(n, k): Problem(tuple(f), str(k)) for n, f in sets.items() for k in train}
    return fit_all(dev, problems, scopes={str(k): s for k, s in train.items()}, weight=weight, label=label, categorical=CATEGORICAL, rows=rows)


def fold_metrics(scored: DataFrame, valid: dict, by: list[str], score: str = "score", **bounds) -> DataFrame:
    """Ranking metrics of the validation rows of each fold, LOW_SUPPORT without both classes."""
    inside = F.array_compact(F.array(*[F.when(s, F.lit(k)) for k, s in valid.items()]))
    placed = scored.withColumn("fold", F.explode(inside))
    return M.ranking_metrics(placed, [*by, "fold"], score=score, **bounds).select(
        *by, "fold", "rows", "fraud_rows", "pr_auc", "roc_auc", "ks", F.when(F.col("pr_auc").isNotNull(), "PASS").otherwise("LOW_SUPPORT").alias("status"))


def temporal_cv(dev: DataFrame, sets: dict[str, list[str]], folds: int = 3, weight: str = "sample_weight", *, rows: int | None = None) -> DataFrame:
    """Fit on the days up to each fold's end, measure on the block after it: (feature_set, fold, rows, ..., status)."""
    train, valid = fold_scopes(dev, folds)
    models = fit_folds(dev, sets, train, weight, rows=rows)
    each = [stacked(dev.where(valid[k]), {n: models[n, k].probability() for n in sets}, "feature_set").withColumn("fold", F.lit(k)).select("feature_set", "fold", "score", "fraud_label") for k in train]
    measured = M.ranking_metrics(union_all(each), ["feature_set", "fold"], score="score", rows=rows)
    return measured.select("feature_set", "fold", "rows", "fraud_rows", "pr_auc", "roc_auc", "ks", F.when(F.col("pr_auc").isNotNull(), "PASS").otherwise("LOW_SUPPORT").alias("status"))


def fit_sigmoid(calibration: DataFrame, score: str = "score", label: str = "fraud_label") -> Logistic:
    """Logistic regression of the label on the score as it is, the intercept free."""
    as_is = Design([score], {score: 0.0}, [], [0.0], [1.0], {}, {})
    rows = calibration.where(F.col(score).isNotNull() & ~F.isnan(score)).select(score, label)
    return fit_all(rows, {"sigmoid": Problem((score,))}, label=label, penalise_intercept=False, known={"sigmoid": as_is})["sigmoid"]


def calibrate(calibration: DataFrame, selection: DataFrame, method: str, score: str = "score", label: str = "fraud_label", *, rows: int | None = None) -> DataFrame:
    """Probability of the selection rows from a calibrator fitted on the calibration rows. Rows without a score have none."""
    if method == "uncalibrated":
        return selection.withColumn("probability", F.col(score))
    if method == "sigmoid":
        fitted = fit_sigmoid(calibration, score, label)
        known = F.col(score).isNotNull() & ~F.isnan(score)
        return selection.withColumn("probability", F.when(known, fitted.probability()))
    if method == "isotonic":
        return isotonic_probability(selection, isotonic_blocks(calibration, score, label), score, rows=rows)
    raise ValueError(f"unknown calibration method {method}")


def calibration_comparison(calibration: DataFrame, selection: DataFrame, methods: tuple[str, ...] = ("uncalibrated", "sigmoid", "isotonic"), score: str = "score", *, rows: int | None = None) -> DataFrame:
    """Ranking and probability metrics of the calibrators."""
    ranking = M.ranking_metrics(selection, score=score, rows=rows).select("rows", "fraud_rows", "pr_auc", "roc_auc", "ks", F.lit(1).alias("k"))
    measured = [M.probability_metrics(calibrate(calibration, selection, m, score, rows=rows), probability="probability").select(F.lit(m).alias("method"), "brier", "log_loss", F.lit(1).alias("k")) for m in methods]
    return ranking.join(F.broadcast(union_all(measured)), "k").drop("k").withColumn("status", F.lit("PASS"))


def champion(table: DataFrame) -> DataFrame:
    """Mark the feature set with the best average precision; ties go to the first name."""
    best = table.where("pr_auc is not null").orderBy(F.desc("pr_auc"), "feature_set").limit(1).select(F.col("feature_set").alias("_best"), F.lit(1).alias("k"))
    return table.withColumn("k", F.lit(1)).join(F.broadcast(best), "k", "left").drop("k").withColumn(
        "selection_status", F.when(F.col("feature_set") == F.col("_best"), "CHAMPION_CANDIDATE").otherwise("BASELINE")).drop("_best")


def incremental_value(table: DataFrame, base: str = "F0", richer: str = "F2") -> DataFrame:
    pick = lambda s, m: F.max(F.when(F.col("feature_set") == s, F.col(m)))
    return table.agg(*[(pick(richer, m) - pick(base, m)).alias(f"delta_{m}") for m in ("pr_auc", "roc_auc", "ks")])
