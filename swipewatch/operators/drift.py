"""Frozen reference statistics and drift against them.

A reference is two small tables: one row per numeric feature (bin edges, counts,
moments, quantiles) and one row per feature and category. Later frames are
compared with these tables alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import exprs as X
from ..functions.scale import TASK_ROWS, join_same, prefix, quantiles, stored
from .quality import join_same_outer, text

EPSILON = 1e-12
FEATURE_QUANTILES = (0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99)
SCORE_QUANTILES = (0.01, 0.05, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)
NUMERIC_SCHEMA = T.StructType([
    T.StructField("feature_name", T.StringType()), T.StructField("bin_edges", T.ArrayType(T.DoubleType())), T.StructField("bin_counts", T.ArrayType(T.LongType())),
    T.StructField("reference_n", T.LongType()), T.StructField("missing_n", T.LongType()), T.StructField("mean", T.DoubleType()), T.StructField("std", T.DoubleType()),
    T.StructField("quantiles", T.ArrayType(T.DoubleType()))])


# --- distances between two count arrays -------------------------------------------------------------


def proportions(counts: Column) -> Column:
    """Smoothed shares; NULL for an empty histogram."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c.cast("double"))
    k = F.size(counts)
    return F.when(total > 0, F.transform(counts, lambda c: (c.cast("double") + F.lit(EPSILON)) / (total + F.lit(EPSILON) * k)))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def psi(reference: Column, current: Column) -> Column:
    p, q = proportions(reference), proportions(current)
    return _total(F.zip_with(p, q, lambda a, b: (b - a) * F.ln(b / a)))


def jensen_shannon(reference: Column, current: Column) -> Column:
    p, q = proportions(reference), proportions(current)
    half = _total(F.zip_with(p, q, lambda a, b: (a * F.ln(2 * a / (a + b)) + b * F.ln(2 * b / (a + b))) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), half))


def total_variation(reference: Column, current: Column) -> Column:
    return _total(F.zip_with(proportions(reference), proportions(current), lambda a, b: F.abs(a - b))) / 2


def quantile_wasserstein(reference: Column, current: Column) -> Column:
    """Mean gap of two sorted vectors of equal length over the spread of the first."""
    n = F.size(reference).cast("double")
    mean = _total(reference) / n
    std = F.sqrt(_total(F.transform(reference, lambda v: (v - mean) * (v - mean))) / n)
    scale = F.when(std > EPSILON, std).otherwise(F.greatest(F.array_max(reference) - F.array_min(reference), F.lit(1.0)))
    return _total(F.zip_with(F.array_sort(reference), F.array_sort(current), lambda a, b: F.abs(a - b))) / n / scale


def chi_squared_statistic(reference: Column, current: Column) -> Column:
    """Pearson's statistic of a two-row contingency table of counts (Yates correction for two bins); NULL if a row is empty."""
    above = lambda c: F.transform(c, lambda v: v.cast("double") + EPSILON)
    a, b = _total(above(reference)), _total(above(current))
    yates = F.when(F.size(reference) == 2, 0.5).otherwise(0.0)

    def cell(count: Column, row: Column, column: Column) -> Column:
        expected = row * column / (a + b)
        gap = F.abs(count - expected)
        return F.pow(gap - F.least(yates, gap), F.lit(2)) / expected

    cells = F.zip_with(above(reference), above(current), lambda x, y: cell(x, a, x + y) + cell(y, b, x + y))
    filled = (_total(F.transform(reference, lambda v: v.cast("double"))) > 0) & (_total(F.transform(current, lambda v: v.cast("double"))) > 0)
    return F.when(filled, _total(cells))


#: Terms of the incomplete gamma series and steps of its continued fraction; both have long settled by then for up to some hundred degrees.
GAMMA_STEPS = 400


def _half_gamma_log(a: Column) -> Column:
    """ln of the gamma function at a whole or half number above 0, from gamma(a) = (a - 1) gamma(a - 1), gamma(1) = 1, gamma(1/2) = sqrt(pi)."""
    start = F.when(a == F.floor(a), F.lit(0.0)).otherwise(F.lit(0.5 * math.log(math.pi)))
    steps = (F.ceil(a) - 1).cast("int")
    return start + F.when(steps >= 1, F.aggregate(F.sequence(F.lit(1), steps), F.lit(0.0), lambda total, k: total + F.ln(a - k))).otherwise(0.0)


def upper_gamma(a: Column, x: Column, steps: int = GAMMA_STEPS) -> Column:
    """Regularised upper incomplete gamma function of whole or half ``a`` as one expression: a series below ``a + 1``, Lentz's continued
    fraction above."""
    front = F.exp(-x + a * F.ln(x) - _half_gamma_log(a))
    numbers = F.sequence(F.lit(1), F.lit(steps))
    series = F.aggregate(numbers, F.struct((1 / a).alias("term"), (1 / a).alias("total")),
                         lambda s, n: F.struct((s["term"] * x / (a + n)).alias("term"), (s["total"] + s["term"] * x / (a + n)).alias("total")), lambda s: s["total"])
    first = 1 / (x + 1 - a)

    def lentz(s: Column, i: Column) -> Column:
        step, b = -i * (i - a), s["b"] + 2
        d, c = 1 / (step * s["d"] + b), b + step / s["c"]
        return F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    fraction = F.aggregate(numbers, F.struct((x + 1 - a).alias("b"), F.lit(1e300).alias("c"), first.alias("d"), first.alias("h")), lentz, lambda s: s["h"])
    return F.when(x <= 0, 1.0).when(x < a + 1, F.greatest(F.lit(0.0), 1 - series * front)).otherwise(front * fraction)


def chi_squared_p(statistic: Column, degrees: Column) -> Column:
    """Upper tail of the chi-squared distribution; NaN without a statistic, 1 without degrees of freedom."""
    a = F.greatest(degrees, F.lit(1)).cast("double") / 2
    return F.when(statistic.isNull(), float("nan")).when(degrees < 1, 1.0).otherwise(upper_gamma(a, statistic / 2))


# --- bins and histograms ----------------------------------------------------------------------------


def _long(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.selectExpr(X.unpivot_stack([(text(f), f"cast({f} as double)") for f in features], ("feature_name", "v"))).where("v is not null and not isnan(v) and abs(v) <> double('infinity')")


def _open(inner: Sequence[float]) -> list[float]:
    return [-math.inf, *inner, math.inf]


def _places(df: DataFrame, features: Sequence[str], probs: Sequence[float], *, rows: int | None = None, task_rows: int = TASK_ROWS) -> dict[str, dict[float, float]]:
    """Exact quantiles of each feature that has values, by place: a row a feature, which the driver holds."""
    found = quantiles(_long(df, features), "v", list(probs), ["feature_name"], name="q", rows=rows, task_rows=task_rows)
    return {r["feature_name"]: dict(zip(probs, r["q"], strict=True)) for r in found.collect()}


def _shares(bins: int) -> list[float]:
    return [i / bins for i in range(bins + 1)]


def frozen_bins(df: DataFrame, features: Sequence[str], bins: int = 10, *, places: dict[str, dict[float, float]] | None = None, rows: int | None = None, task_rows: int = TASK_ROWS) -> dict[str, list[float]]:
    """Decile edges per feature with open ends. Only the edges, eleven numbers per feature, reach the driver; ``places`` has them if known.

    Fewer than three distinct deciles fall back to midpoints of a few values, or to equal widths.
    """
    long = _long(df, features)
    places = places or _places(df, features, _shares(bins), rows=rows, task_rows=task_rows)
    deciles = {f: [q[p] for p in _shares(bins)] for f, q in places.items()}
    plain = [f for f, q in deciles.items() if len(set(q)) < 3]
    values: dict[str, list[float]] = {f: [] for f in plain}
    if plain:  # at most bins + 2 values of each such feature
        order = Window.partitionBy("feature_name").orderBy("v")
        few = long.where(F.col("feature_name").isin(plain)).distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= bins + 2)
        for r in few.collect():
            values[r["feature_name"]].append(r["v"])
    edges = {}
    for f, q in deciles.items():
        seen = sorted(values.get(f, []))
        if f not in values:
            inner = sorted(set(q))[1:-1]
        elif len(seen) == 1:
            inner = [seen[0] + max(abs(seen[0]) * 1e-6, 1e-9)]
        elif len(seen) <= bins + 1:
            inner = [(x + y) / 2 for x, y in zip(seen, seen[1:])]
        else:
            inner = [q[0] + (q[-1] - q[0]) * i / bins for i in range(1, bins)]
        edges[f] = _open(inner)
    missing = [f for f in features if f not in edges]
    if missing:
        raise ValueError(f"reference distribution is empty for {missing}")
    return edges


def histogram(column: str, edges: Sequence[float]) -> Column:
    """Counts per half-open bin, as one aggregate; NULL, NaN and infinite values are left out."""
    v = F.col(column).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    counts = []
    for low, high in zip(edges, edges[1:]):
        inside = finite
        if low != -math.inf:
            inside = inside & (v >= F.lit(float(low)))
        if high != math.inf:
            inside = inside & (v < F.lit(float(high)))
        counts.append(F.count_if(inside))
    return F.array(*counts)


def _edges_literal(edges: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(e)) for e in edges])


def numeric_reference(df: DataFrame, features: Sequence[str], edges: dict[str, list[float]] | None = None, probs: Sequence[float] = FEATURE_QUANTILES, bins: int = 10, *, rows: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """Frozen statistics of numeric features, one row each. Deciles and quantiles are found together."""
    places = _places(df, features, sorted({*probs, *(() if edges else _shares(bins))}), rows=rows, task_rows=task_rows)
    edges = edges or frozen_bins(df, features, bins, places=places, rows=rows, task_rows=task_rows)
    aggs = []
    for f in features:
        v = F.col(f).cast("double")
        aggs.append(F.struct(
            F.lit(f).alias("feature_name"), _edges_literal(edges[f]).alias("bin_edges"), histogram(f, edges[f]).alias("bin_counts"), F.count(v).alias("reference_n"),
            F.count_if(v.isNull()).alias("missing_n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")).alias(f"s_{f}"))
    one = df.agg(*aggs)
    stats = one.select(F.inline(F.array(*[F.col(f"s_{f}") for f in features])))
    q = df.sparkSession.createDataFrame([(f, [at[p] for p in probs]) for f, at in places.items()], "feature_name string, quantiles array<double>")
    return stats.join(F.broadcast(q), "feature_name", "left").select(*[f.name for f in NUMERIC_SCHEMA.fields])


def category_reference(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Counts per feature and category, NULL as its own category."""
    long = df.selectExpr(X.unpivot_stack([(text(f), f"coalesce(cast({f} as string), '{X.CATEGORY_NULL}')") for f in features], ("feature_name", "category")))
    return long.groupBy("feature_name", "category").agg(F.count("*").alias("reference_count"))


def top_categories(df: DataFrame, feature: str, top: int | None = None) -> DataFrame:
    """Known categories with their share: all, or the ``top`` most frequent if only these are to count as known."""
    counted = df.groupBy(X.category(feature).alias("category")).agg(F.count("*").alias("n"))
    known = counted if top is None else counted.orderBy(F.desc("n"), "category").limit(top)
    total = F.broadcast(counted.agg(F.sum("n").alias("total"), F.lit(1).alias("k")))
    return known.withColumn("k", F.lit(1)).join(total, "k").select(F.lit(feature).alias("feature_name"), "category", X.ratio("n", "total").alias("reference_share"))


# --- drift ------------------------------------------------------------------------------------------


def numeric_drift(current: DataFrame, reference: DataFrame, window_id: str = "", probs: Sequence[float] = FEATURE_QUANTILES, *, rows: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """JS, PSI and quantile-Wasserstein against frozen rows; the rows (one per feature) are read by the driver for their edges."""
    frozen = {r["feature_name"]: list(r["bin_edges"]) for r in reference.select("feature_name", "bin_edges").collect()}
    features = [f for f in frozen if f in current.columns]
    return numeric_distances(numeric_reference(current, features, frozen, probs, rows=rows, task_rows=task_rows), reference, window_id)


def numeric_distances(current: DataFrame, reference: DataFrame, window_id: str = "") -> DataFrame:
    """The same from the statistics of the current rows, on the bins of the reference."""
    now = current.select(
        "feature_name", F.col("bin_counts").alias("now_counts"), F.col("reference_n").alias("current_n"), F.col("missing_n").alias("now_missing"), F.col("quantiles").alias("now_q"))
    both = reference.join(F.broadcast(now), "feature_name")
    frozen_stats, quantile_form = "FROZEN_SUFFICIENT_STATISTICS", "FROZEN_QUANTILE_REPRESENTATION"
    rated = both.select(
        F.lit(window_id).alias("window_id"), "feature_name", F.lit("numerical").alias("feature_type"), "reference_n", "current_n",
        X.ratio("missing_n", F.col("missing_n") + F.col("reference_n")).alias("missing_rate_reference"), X.ratio("now_missing", F.col("now_missing") + F.col("current_n")).alias("missing_rate_current"),
        jensen_shannon(F.col("bin_counts"), F.col("now_counts")).alias("js"), psi(F.col("bin_counts"), F.col("now_counts")).alias("psi_"), quantile_wasserstein(F.col("quantiles"), F.col("now_q")).alias("w"))
    keep = [c for c in rated.columns if c not in ("js", "psi_", "w")]
    return rated.selectExpr(*keep, X.unpivot_stack([("'jensen_shannon'", "js", text(frozen_stats)), ("'psi'", "psi_", text(frozen_stats)), ("'wasserstein'", "w", text(quantile_form))], ("metric_name", "metric_value", "reference_source")))


def categorical_drift(current: DataFrame, reference: DataFrame, features: Sequence[str], window_id: str = "") -> DataFrame:
    """JS and PSI over the frozen categories; categories unseen in the reference are not part of it."""
    return categorical_distances(category_reference(current, features), reference, features, window_id)


def categorical_distances(current: DataFrame, reference: DataFrame, features: Sequence[str], window_id: str = "") -> DataFrame:
    """The same from the category counts of the current rows."""
    now = current.withColumnRenamed("reference_count", "current_count")
    cells = join_same(reference.where(F.col("feature_name").isin(*features)), now, ["feature_name", "category"]).withColumn("current_count", F.coalesce("current_count", F.lit(0)))
    totals = cells.groupBy("feature_name").agg(F.sum("reference_count").alias("rn"), F.sum("current_count").alias("cn"), F.count("*").alias("k"))
    placed = cells.join(F.broadcast(totals), "feature_name")
    eps = F.lit(EPSILON)
    p = (F.col("reference_count") + eps) / (F.col("rn") + eps * F.col("k"))
    q = (F.col("current_count") + eps) / (F.col("cn") + eps * F.col("k"))
    js = (p * F.ln(2 * p / (p + q)) + q * F.ln(2 * q / (p + q))) / 2
    seen = now.groupBy("feature_name").agg(F.sum("current_count").alias("current_n"))
    both = placed.groupBy("feature_name").agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(js))).alias("js"), F.sum((q - p) * F.ln(q / p)).alias("psi_"), F.max("rn").alias("reference_n"), F.max("cn").alias("_cn"))
    rated = both.join(F.broadcast(seen), "feature_name").select(
        F.lit(window_id).alias("window_id"), "feature_name", F.lit("categorical").alias("feature_type"), "reference_n", "current_n",
        F.when(F.col("_cn") > 0, F.col("js")).alias("js"), F.when(F.col("_cn") > 0, F.col("psi_")).alias("psi_"))
    return rated.selectExpr("window_id", "feature_name", "feature_type", "reference_n", "current_n", X.unpivot_stack([("'jensen_shannon'", "js"), ("'psi'", "psi_")], ("metric_name", "metric_value")))


def two_sample(reference: DataFrame, current: DataFrame, features: Sequence[str], *, rows: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """Exact KS and Wasserstein-1 over the population spread of the reference.

    Both samples are reduced to counts per distinct value; distances are sums over
    neighbouring values of their running counts.
    """
    one = lambda df, a, b: _long(df, features).select("feature_name", "v", F.lit(a).alias("_a"), F.lit(b).alias("_b"))
    values = one(reference, 1, 0).unionByName(one(current, 0, 1)).groupBy("feature_name", "v").agg(F.sum("_a").alias("a"), F.sum("_b").alias("b"))
    if rows is None or rows > task_rows:  # read again for its size, its ranges and its totals
        values = stored(values)
    totals = values.groupBy("feature_name").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    before = prefix(values, ["feature_name"], ["v"], {"ca": ("a", "sum"), "cb": ("b", "sum"), "pv": ("v", "max")}, exclusive=True, rows=rows, task_rows=task_rows)
    placed = before.join(F.broadcast(totals), "feature_name")
    gap = lambda a, b: F.abs(a / F.col("ta") - b / F.col("tb"))
    left = gap(F.col("ca").cast("double"), F.col("cb").cast("double"))
    here = gap((F.col("ca") + F.col("a")).cast("double"), (F.col("cb") + F.col("b")).cast("double"))
    per = placed.groupBy("feature_name").agg(F.max(here).alias("ks"), F.sum(left * (F.col("v") - F.col("pv"))).alias("_w"))
    spread = _long(reference, features).groupBy("feature_name").agg(F.stddev_pop("v").alias("_std"), (F.max("v") - F.min("v")).alias("_range"))
    scale = F.when(F.col("_std") > EPSILON, F.col("_std")).otherwise(F.greatest("_range", F.lit(1.0)))
    return per.join(F.broadcast(spread), "feature_name").select("feature_name", "ks", (F.coalesce("_w", F.lit(0.0)) / scale).alias("wasserstein"))


def drift_from_frames(reference: DataFrame, current: DataFrame, numeric: Sequence[str], categorical: Sequence[str], window_id: str = "", **bounds) -> DataFrame:
    """Drift of two raw frames: binned distances plus exact KS and Wasserstein."""
    frozen = numeric_reference(reference, numeric, **bounds)
    binned = numeric_drift(current, frozen, window_id, **bounds).where("metric_name <> 'wasserstein'").select("window_id", "feature_name", "feature_type", "metric_name", "metric_value")
    exact = two_sample(reference, current, numeric, **bounds).selectExpr(
        f"{text(window_id)} as window_id", "feature_name", "'numerical' as feature_type", X.unpivot_stack([("'ks'", "ks"), ("'wasserstein'", "wasserstein")], ("metric_name", "metric_value")))
    out = binned.unionByName(exact)
    if categorical:
        cats = categorical_drift(current, category_reference(reference, categorical), categorical, window_id)
        out = out.unionByName(cats.select("window_id", "feature_name", "feature_type", "metric_name", "metric_value"))
    return out


def category_novelty(current: DataFrame, reference: DataFrame, features: Sequence[str], window_id: str = "") -> DataFrame:
    """Share of every category then and now; categories absent from the frozen counts are new."""
    return novelty_of_counts(category_reference(current, features), reference, features, window_id)


def novelty_of_counts(current: DataFrame, reference: DataFrame, features: Sequence[str], window_id: str = "") -> DataFrame:
    """The same from the category counts of the current rows."""
    now = current.withColumnRenamed("reference_count", "current_count")
    frozen = reference.where(F.col("feature_name").isin(*features))
    then_n = frozen.groupBy("feature_name").agg(F.sum("reference_count").alias("rn"))
    now_n = now.groupBy("feature_name").agg(F.sum("current_count").alias("cn"))
    cells = join_same_outer(frozen, now, ["feature_name", "category"]).join(F.broadcast(then_n), "feature_name", "left").join(F.broadcast(now_n), "feature_name", "left")
    share = lambda c, n: X.ratio(F.coalesce(F.col(c), F.lit(0)), n)
    new = F.col("reference_count").isNull()
    return cells.select(
        F.lit(window_id).alias("window_id"), "feature_name", "category", share("reference_count", "rn").alias("reference_share"), share("current_count", "cn").alias("current_share"),
        (share("current_count", "cn") - share("reference_count", "rn")).alias("share_delta"), new.alias("is_new_category"), new.alias("is_unknown_category"), F.lit("FROZEN_CATEGORICAL_SUFFICIENT_STATISTICS").alias("reference_source"))


# --- score ------------------------------------------------------------------------------------------


def score_summary(df: DataFrame, review: float | None = None, block: float | None = None, *, rows: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    v = F.col("risk_score").cast("double")
    above = lambda t: X.ratio(F.count_if(v >= t), F.count("*")) if t is not None else F.lit(None).cast("double")
    one = df.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), above(review).alias("share_above_review_threshold"), above(block).alias("share_above_block_threshold"), F.lit(1).alias("k"))
    q = quantiles(df, "risk_score", [0.5, 0.75, 0.9, 0.95, 0.99], name="q", rows=rows, task_rows=task_rows).withColumn("k", F.lit(1))
    at = lambda i, name: F.col("q")[i].alias(name)
    return one.join(F.broadcast(q), "k").select("n", "mean", at(0, "median"), "std", at(0, "p50"), at(1, "p75"), at(2, "p90"), at(3, "p95"), at(4, "p99"), "share_above_review_threshold", "share_above_block_threshold")


def score_reference(df: DataFrame, **bounds) -> DataFrame:
    return numeric_reference(df, ["risk_score"], probs=SCORE_QUANTILES, **bounds)


def score_drift(current: DataFrame, reference: DataFrame, window_id: str = "", score_status: str = "RANKING_ONLY", **bounds) -> DataFrame:
    return score_signals(numeric_drift(current, reference, window_id, SCORE_QUANTILES, **bounds), score_status)


def score_signals(d: DataFrame, score_status: str = "RANKING_ONLY") -> DataFrame:
    name = F.when(F.col("metric_name") == "jensen_shannon", "score_js").when(F.col("metric_name") == "psi", "score_psi").otherwise("score_wasserstein")
    return d.select("window_id", name.alias("metric"), F.col("metric_value").alias("observed"), F.lit(score_status).alias("score_status"), F.lit("EARLY_WARNING").alias("claim_class"), F.lit("FROZEN_SCORE_SUFFICIENT_STATISTICS").alias("reference_source"))


def chi_squared(reference: DataFrame, current: DataFrame, bins: dict[str, tuple[str, Sequence[float]]]) -> DataFrame:
    """Statistic, degrees of freedom and p-value for each entry of ``bins``, name -> (column, edges): one aggregation of each frame."""
    counted = lambda df, name: df.agg(*[histogram(c, e).alias(f"{name}{i}") for i, (c, e) in enumerate(bins.values())], F.lit(1).alias("k"))
    both = counted(reference, "a").join(F.broadcast(counted(current, "b")), "k")  # one row each
    entries = F.array(*[F.struct(F.lit(n).alias("feature_name"), F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b")) for i, n in enumerate(bins)])
    tests = both.select(F.explode(entries).alias("e")).select("e.feature_name", chi_squared_statistic(F.col("e.a"), F.col("e.b")).alias("statistic"), (F.size("e.a") - 1).alias("degrees"))
    return tests.withColumn("p_value", chi_squared_p(F.col("statistic"), F.col("degrees")))
