"""Replay by days: one pass turns rows into mergeable counts, and every report follows from counts of any days.

A cell counts the rows of a day with one value of one dimension (an action, a flag, a segment, a category, a score). Counts of different days
are added up, so a new day needs no old rows, and a day that is counted again replaces its own cells only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.scale import quantiles
from ..sources import contracts as C
from . import drift as D
from . import metrics as M
from . import monitor as N

DAY = "operational_window_id"
_KEYS = (DAY, "drift_window_id", "performance_window_id", "family", "key", "v")


def _entries(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> Column:
    """The cells that a row is counted in."""
    def cell(family: str, key: str = "null", v: str = "null") -> Column:
        return F.expr(f"named_struct('family', '{family}', 'key', cast({key} as string), 'v', cast({v} as double))")

    none = F.lit(None).cast("struct<family:string,key:string,v:double>")
    cells = [cell("all")]
    if "action" in df.columns:
        cells += [cell("action", "upper(action)"), cell("policy_version", "policy_version" if "policy_version" in df.columns else "null")]
    cells.append(cell("graph_version", "graph_version" if "graph_version" in df.columns else "null"))
    cells += [F.when(X.flag(g), cell("flag", f"'{g}'")).otherwise(none) for g in (*N.GRAPH_FLAGS, "graph_auto_block") if g in df.columns]
    cells += [cell(f"segment:{k}", X.segment_text(df, c)) for k, c in N.SEGMENT_TYPES.items() if c in df.columns]
    cells += [cell(f"category:{f}", f"coalesce(cast(`{f}` as string), '{X.CATEGORY_NULL}')") for f in categorical]
    cells += [cell(f"value:{f}", v=f"`{f}`") for f in numeric]
    return F.array_compact(F.array(*cells))


def day_cells(df: DataFrame) -> DataFrame:
    """(day, its week and month, family, key, v, n, x, fraud): counts, exposure in cents and frauds of each cell.

    ``df`` has decided rows with their windows (``assign_windows``); ``fraud`` is null without labels. Values of numeric inputs are cells too,
    since exact quantiles need them; all others have as many cells a day as the dimension has values. Rows are counted before the shuffle.
    """
    df = N.add_segment_columns(df)
    numeric, categorical = ([c for c in names if c in df.columns] for names in (N.NUMERIC_MONITORED, N.CATEGORICAL_MONITORED))
    exposure = "positive_exposure" if "positive_exposure" in df.columns else "amount"
    fraud = F.col("fraud_label").cast("long") if "fraud_label" in df.columns else F.lit(None).cast("long")
    spread = df.select(*_KEYS[:3], X.cents(exposure).alias("x"), fraud.alias("y"), F.explode(_entries(df, numeric, categorical)).alias("e")).select(*_KEYS[:3], "e.*", "x", "y")
    return spread.groupBy(*_KEYS).agg(F.count("*").alias("n"), F.coalesce(F.sum("x"), F.lit(0)).alias("x"), F.sum("y").alias("fraud"), F.count("y").alias("labelled"))


def merged(cells: DataFrame, new: DataFrame) -> DataFrame:
    """``cells`` with the days of ``new`` added; days that both have are those of ``new``."""
    days = new.select(DAY).distinct()
    return cells.join(F.broadcast(days) if _calendar(days) else days, DAY, "left_anti").unionByName(new)


def _calendar(days: DataFrame, most: int = 100_000) -> bool:
    return len(days.limit(most + 1).take(most + 1)) <= most


def _policy(cells: DataFrame) -> DataFrame:
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    action = F.col("family") == "action"
    version = F.when(F.col("family") == "policy_version", F.col("key"))
    known = F.coalesce(F.col("key").isin(*C.ACTIONS), F.lit(False))
    days = cells.where("family in ('action', 'policy_version')").groupBy(F.col(DAY).alias("window_id")).agg(
        n(action).alias("_n"), n(action & ~known).alias("_bad"), F.min(version).alias("_v1"), F.max(version).alias("_v2"), *[n(action & (F.col("key") == a)).alias(f"{a.lower()}_count") for a in C.ACTIONS])
    reason = F.when(F.col("_bad") > 0, "Invalid actions").when(F.col("_v1") != F.col("_v2"), "Multiple policy versions in one window")
    shown = lambda c: F.when(reason.isNull(), c)
    return days.select("window_id", F.when(reason.isNull(), "PASS").otherwise("FAIL").alias("status"), reason.alias("reason"), shown(F.col("_v1")).alias("policy_version"),
                       *[shown(X.ratio(f"{a.lower()}_count", "_n")).alias(f"{a.lower()}_rate") for a in C.ACTIONS], *[shown(F.col(f"{a.lower()}_count")).alias(f"{a.lower()}_count") for a in C.ACTIONS])


def _graph(cells: DataFrame) -> DataFrame:
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    version = F.col("family") == "graph_version"
    flag = lambda g: (F.col("family") == "flag") & (F.col("key") == g)
    days = cells.where("family in ('flag', 'graph_version')").groupBy(F.col(DAY).alias("window_id")).agg(
        n(version).alias("_n"), *[n(flag(g)).alias(g) for g in (*N.GRAPH_FLAGS, "graph_auto_block")], n(version & F.col("key").isNull()).alias("_missing"), F.min(F.when(version, F.col("key"))).alias("_a"), F.max(F.when(version, F.col("key"))).alias("_b"))
    auto = F.col("graph_auto_block") > 0
    return days.select("window_id", F.when(auto, "FAIL").otherwise("PASS").alias("status"), F.when(F.col("_a") != F.col("_b"), "MIXED").otherwise(F.col("_a")).alias("graph_version"),
                       *[X.ratio(g, "_n").alias(f"{g}_rate") for g in N.GRAPH_FLAGS], X.ratio("_missing", "_n").alias("graph_signal_missing_rate"), auto.alias("graph_auto_block"), F.lit("context_and_priority_only").alias("graph_governance"))


def _segments(cells: DataFrame, window_id: str) -> DataFrame:
    kinds = cells.where("family like 'segment:%'").groupBy(F.substring("family", 9, 100).alias("segment_type"), F.col("key").alias("segment")).agg(F.sum("n").alias("support"), F.sum("x").alias("x"))
    totals = kinds.groupBy(F.col("segment_type").alias("_t")).agg(F.sum("support").alias("_n"), F.sum("x").alias("_x"))
    return kinds.join(F.broadcast(totals), F.col("segment_type") == F.col("_t")).select(F.lit(window_id).alias("window_id"), "segment_type", "segment", "support", X.ratio("support", "_n").alias("share_transactions"), X.ratio("x", "_x").alias("share_exposure"))


def _statistics(cells: DataFrame, reference: DataFrame, probs: Sequence[float], *, rows: int | None = None) -> DataFrame:
    """Bin counts, row counts and quantiles of the values in cells, on the frozen bins of ``reference`` (a row a feature)."""
    edges = F.broadcast(reference.select("feature_name", "bin_edges"))
    values = cells.where("family like 'value:%'").groupBy(F.substring("family", 7, 100).alias("feature_name"), "v").agg(F.sum("n").alias("n")).join(edges, "feature_name")
    finite = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf"))
    place = F.size(F.filter("bin_edges", lambda e: e <= F.col("v"))) - 1
    binned = values.groupBy("feature_name", F.when(finite, F.least(place, F.size("bin_edges") - 2)).alias("bin")).agg(F.sum("n").alias("n"), F.any_value("bin_edges").alias("bin_edges"))
    by_bin = F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n"))))
    counts = binned.groupBy("feature_name").agg(by_bin.alias("_m"), F.any_value("bin_edges").alias("bin_edges")).select(
        "feature_name", F.transform(F.sequence(F.lit(0), F.size("bin_edges") - 2), lambda i: F.coalesce(F.element_at("_m", i), F.lit(0))).alias("bin_counts"))
    sizes = values.groupBy("feature_name").agg(F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("reference_n"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("missing_n"))
    q = quantiles(values.where(finite).select("feature_name", "v", "n"), "v", list(probs), ["feature_name"], name="quantiles", weight="n", rows=rows)
    return sizes.join(counts, "feature_name").join(q, "feature_name", "left")


def reports(cells: DataFrame, baseline: dict[str, DataFrame], window_id: str = "FINAL_OOT", *, thresholds: dict[str, tuple[float, float, int]] = N.ALERT_THRESHOLDS, rows: int | None = None) -> dict[str, DataFrame]:
    """The reports of ``replay`` that counts determine, from cells of any days. They equal those over the rows of these days.

    Left to the rows: distinct ids of the quality profile, queue health by bucket, and top-K capture, whose ties are broken by time.
    """
    N.check_thresholds(thresholds)
    categories = cells.where("family like 'category:%'").groupBy(F.substring("family", 10, 100).alias("feature_name"), F.col("key").alias("category")).agg(F.sum("n").alias("reference_count"))
    known = [f for f in N.CATEGORICAL_MONITORED]
    numeric = D.numeric_distances(_statistics(cells, baseline["numeric"], D.FEATURE_QUANTILES, rows=rows), baseline["numeric"], window_id)
    shared = ["window_id", "feature_name", "feature_type", "reference_n", "current_n", "metric_name", "metric_value"]
    score = D.score_signals(D.numeric_distances(_statistics(cells, baseline["score"], D.SCORE_QUANTILES, rows=rows), baseline["score"], window_id))
    everything = cells.where("family = 'all'")
    support = everything.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("support"), F.lit(1).alias("_k"))
    signals = score.withColumn("_k", F.lit(1)).join(F.broadcast(support), "_k").select("window_id", F.lit("SCORE").alias("signal_family"), "metric", "observed", "support", "claim_class")
    out = {
        "windows": everything.groupBy("drift_window_id").agg(F.sum("n").alias("row_count")), "policy": _policy(cells), "graph": _graph(cells), "segments": _segments(cells, window_id),
        "feature_drift": numeric.select(*shared).unionByName(D.categorical_distances(categories, baseline["categories"], known, window_id).select(*shared)),
        "novelty": D.novelty_of_counts(categories.where(F.col("feature_name").isin("channel", "MCC")), baseline["categories"], ["channel", "MCC"], window_id), "score": score, "alerts": N.alerts(signals, thresholds)}
    by_score = cells.where("family = 'value:risk_score' and v is not null").groupBy("performance_window_id", F.col("v").alias("score")).agg(F.sum("labelled").alias("n"), F.sum("fraud").alias("pos")).where("n > 0")
    out["ranking"] = M.ranking_of_scores(M.running_scores(by_score, ["performance_window_id"], rows=rows), ["performance_window_id"])
    return out


def as_measures(tables: dict[str, DataFrame]) -> DataFrame:
    """All reports as one table (report, item, measure, value): numbers of a row, named by its texts."""
    out = None
    for name, t in tables.items():
        kinds = {f.name: f.dataType.typeName() for f in t.schema.fields}
        numbers = [c for c, k in kinds.items() if k in ("long", "integer", "double")]
        words = [c for c, k in kinds.items() if k == "string"]
        item = F.array_join(F.array(*[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c), F.lit("null"))) for c in sorted(words)]), ", ")
        row = t.select(F.lit(name).alias("report"), item.alias("item"), F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in numbers])).alias("m")).select("report", "item", "m.*")
        out = row if out is None else out.unionByName(row)
    return out
