"""Segment risk, trends, concentration and priority tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as X
from ..functions.scale import quantiles
from .quality import rows_from, text

DISCOVERY = "DEVELOPMENT_DISCOVERY"
MIN_SUPPORT = 1000


def over_all():
    """One window over everything, only for aggregated tables: a row per segment, month or label."""
    return Window.partitionBy(F.lit(0))


SEGMENT_COLUMNS = {
    "channel": lambda: X.known_or_unknown("use_chip"),
    "amount_band": lambda: X.amount_band("amount"),
    "mcc": lambda: X.known_or_unknown("merchant_category_code"),
    "state": lambda: X.known_or_unknown("merchant_state"),
    "merchant_city": lambda: X.known_or_unknown("merchant_city"),
}


def _measures() -> list[Column]:
    fraud = F.col("fraud_label") == 1
    return [
        F.count("*").alias("transactions"), F.sum("fraud_label").cast("long").alias("fraud_transactions"),
        F.sum(X.cents("amount")).alias("_c"), F.sum(F.when(fraud, X.cents("amount"))).alias("_fc"),
    ]


def _share_columns(amounts: bool = True) -> list[Column]:
    """Rates against the whole portfolio, from one row per segment."""
    n, f = F.col("transactions"), F.col("fraud_transactions")
    every = lambda c: F.sum(c).over(over_all())
    rate = X.ratio(f, n)
    out = [
        n, X.ratio(n, every("transactions")).alias("transaction_share"), f, rate.alias("fraud_rate"),
        X.ratio(rate, X.ratio(every("fraud_transactions"), every("transactions"))).alias("fraud_lift"),
        X.ratio(f, every("fraud_transactions")).alias("fraud_capture_share"),
    ]
    if amounts:
        out += [
            X.dollars(F.col("_c")).alias("total_amount"), X.dollars(F.col("_fc")).alias("fraud_amount"),
            X.ratio("_fc", "_c").alias("fraud_amount_share"), X.ratio("_fc", every("_fc")).alias("fraud_amount_capture_share"),
        ]
    out.append(F.when(n >= MIN_SUPPORT, "SUFFICIENT").otherwise("LOW_SUPPORT").alias("support_status"))
    return out


def segment_risk(df: DataFrame, kind: str, segment: Column | None = None) -> DataFrame:
    """Risk table of one segmentation. Totals come from the segments, so the rows are read once."""
    key = segment if segment is not None else SEGMENT_COLUMNS[kind]()
    cells = df.groupBy(key.alias("segment_value")).agg(*_measures())
    return cells.select(F.lit(DISCOVERY).alias("analysis_scope"), F.lit(kind).alias("segment_type"), "segment_value", *_share_columns())


def interaction_risk(df: DataFrame) -> DataFrame:
    cells = df.groupBy(SEGMENT_COLUMNS["channel"]().alias("channel"), SEGMENT_COLUMNS["amount_band"]().alias("band")).agg(*_measures())
    return cells.select(F.lit(DISCOVERY).alias("analysis_scope"), F.lit("channel_x_amount_band").alias("interaction_type"),
                        F.concat("channel", F.lit(" × "), "band").alias("segment_value"), *_share_columns(amounts=False))


def _trend_columns() -> list[Column]:
    return [
        F.col("transactions"), F.col("fraud_transactions"), X.ratio("fraud_transactions", "transactions").alias("fraud_rate"),
        X.dollars(F.col("_c")).alias("total_amount"), X.dollars(F.col("_fc")).alias("fraud_amount"), X.ratio("_fc", "_c").alias("fraud_amount_share"),
    ]


def monthly_trend(df: DataFrame) -> DataFrame:
    months = df.groupBy(X.month_key("transaction_timestamp").alias("month")).agg(*_measures())
    baseline = X.ratio(F.sum("fraud_transactions").over(over_all()), F.sum("transactions").over(over_all()))
    return months.select(
        F.lit(DISCOVERY).alias("analysis_scope"), "month", F.lit("DEVELOPMENT").alias("split_name"), *_trend_columns(),
        X.ratio(X.ratio("fraud_transactions", "transactions"), baseline).alias("fraud_lift_vs_development_baseline"),
    ).orderBy("month")


def yearly_trend(df: DataFrame) -> DataFrame:
    years = df.groupBy(F.col("transaction_year").cast("int").alias("year")).agg(*_measures())
    return years.select(F.lit(DISCOVERY).alias("analysis_scope"), "year", *_trend_columns()).orderBy("year")


def portfolio_summary(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Totals, averages and exact medians of the Development part and of the full history."""
    fraud = F.col("fraud_label") == 1
    scoped = df.select(
        "fraud_label", "amount",
        F.explode(F.when(F.col("split") == "DEVELOPMENT", F.array(F.lit(DISCOVERY), F.lit("FULL_HISTORY_DESCRIPTIVE")))
                  .otherwise(F.array(F.lit("FULL_HISTORY_DESCRIPTIVE")))).alias("analysis_scope"))
    totals = scoped.groupBy("analysis_scope").agg(*_measures(), F.count("amount").alias("_n"), F.count(F.when(fraud, F.col("amount"))).alias("_fn"))
    keys = ["analysis_scope"]
    middle = quantiles(scoped, "amount", [0.5], keys, name="m", rows=rows)
    fraud_middle = quantiles(scoped.where(fraud), "amount", [0.5], keys, name="fm", rows=rows)
    # Two rows on each side of both joins.
    joined = totals.join(F.broadcast(middle), keys, "left").join(F.broadcast(fraud_middle), keys, "left")
    return joined.select(
        "analysis_scope", *_trend_columns(),
        (F.col("_c").cast("double") / (F.col("_n") * 100.0)).alias("avg_amount"), (F.col("_fc").cast("double") / (F.col("_fn") * 100.0)).alias("avg_fraud_amount"),
        F.col("m")[0].alias("median_amount"), F.col("fm")[0].alias("median_fraud_amount"),
    )


def amount_distribution(df: DataFrame, rows: int | None = None) -> DataFrame:
    group = F.when(F.col("fraud_label") == 1, "FRAUD_LABELED").when(F.col("fraud_label") == 0, "LEGITIMATE")
    grouped = df.select(group.alias("label_group"), "amount").where("label_group is not null")
    q = quantiles(grouped, "amount", [0.5, 0.75, 0.9, 0.95, 0.99], ["label_group"], name="q", rows=rows)
    names = ["median_amount", "p75_amount", "p90_amount", "p95_amount", "p99_amount"]
    return q.select(F.lit(DISCOVERY).alias("analysis_scope"), "label_group", *[F.col("q")[i].alias(n) for i, n in enumerate(names)])


ENTITIES = {
    "USER": lambda: F.col("user_id").cast("string"),
    "CARD": lambda: F.col("card_key"),
    "MERCHANT_IDENTIFIER": lambda: X.known_or_unknown("merchant_id_raw"),
}


def entity_table(df: DataFrame, entity: str) -> DataFrame:
    cells = df.groupBy(ENTITIES[entity]().alias("entity_value")).agg(*_measures())
    return cells.select("entity_value", "transactions", "fraud_transactions", X.dollars(F.col("_c")).alias("total_amount"), X.dollars(F.col("_fc")).alias("fraud_amount"))


def concentration(df: DataFrame, entity: str) -> DataFrame:
    """How much fraud the most affected entities hold.

    Entities with the same fraud count are interchangeable in every share, so the
    ranking runs over distinct fraud counts, not over entities.
    """
    per_entity = df.groupBy(ENTITIES[entity]().alias("e")).agg(F.sum("fraud_label").cast("long").alias("f"))
    levels = per_entity.groupBy("f").agg(F.count("*").alias("k"))
    above = over_all().orderBy(F.desc("f")).rowsBetween(Window.unboundedPreceding, -1)
    placed = levels.select("f", "k", F.coalesce(F.sum("k").over(above), F.lit(0)).alias("before"),
                           F.sum("k").over(over_all()).alias("entities"), F.sum(F.col("k") * F.col("f")).over(over_all()).alias("all_fraud"))

    def held(top: Column) -> Column:
        taken = F.greatest(F.lit(0), F.least(F.col("k"), top.cast("long") - F.col("before")))
        return X.ratio(F.sum(taken * F.col("f")), F.max("all_fraud"))

    # Shares of the entity count are rounded up, in hundredths to stay exact.
    percent = lambda p: F.ceil(F.col("entities") * F.lit(p) / F.lit(100))
    return placed.agg(
        F.max("entities").alias("total_entities"), F.coalesce(F.sum(F.when(F.col("f") >= 1, F.col("k"))), F.lit(0)).alias("fraud_affected_entities"),
        F.coalesce(F.sum(F.when(F.col("f") >= 2, F.col("k"))), F.lit(0)).alias("repeat_fraud_entities"), F.max("all_fraud").alias("entity_fraud_transactions"),
        held(F.lit(10)).alias("top_10_fraud_share"), held(F.lit(100)).alias("top_100_fraud_share"),
        held(percent(1)).alias("top_1pct_fraud_share"), held(percent(5)).alias("top_5pct_fraud_share"),
        X.ratio(F.sum(F.col("k") * F.col("f") * F.col("f")), F.max("all_fraud").cast("double") * F.max("all_fraud").cast("double")).alias("hhi_fraud_count"),
    ).select(F.lit(DISCOVERY).alias("analysis_scope"), F.lit(entity).alias("entity_type"), "*")


def concentration_bands(table: DataFrame) -> DataFrame:
    bands = ("top_10", "top_100", "top_1pct", "top_5pct")
    return table.selectExpr("analysis_scope", "entity_type", X.unpivot_stack([(text(b), f"{b}_fraud_share") for b in bands], ("rank_band", "fraud_capture_share")))


def priority_class() -> Column:
    lift, capture, money = F.col("fraud_lift"), F.col("fraud_capture_share"), F.col("fraud_amount_capture_share")
    return (
        F.when(F.col("support_status") == "LOW_SUPPORT", "LOW_PRIORITY")
        .when((lift >= 2) & ((capture >= 0.05) | (money >= 0.05)), "PRIORITY_1")
        .when((lift >= 1.25) | (capture >= 0.03) | (money >= 0.03), "PRIORITY_2").otherwise("MONITOR")
    )


PRIORITY_ORDER = {"PRIORITY_1": 1, "PRIORITY_2": 2, "MONITOR": 3, "LOW_PRIORITY": 4}


def _priority_rank() -> Column:
    rank = F.lit(None).cast("int")
    for name, place in PRIORITY_ORDER.items():
        rank = F.when(F.col("priority_class") == name, place).otherwise(rank)
    return rank


def segment_priority(df: DataFrame, kinds: tuple[str, ...] = ("channel", "amount_band", "mcc", "state")) -> DataFrame:
    """One ranked list over several segmentations."""
    tables = [segment_risk(df, k) for k in kinds]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return (
        out.drop("total_amount", "fraud_amount", "fraud_amount_share").withColumn("priority_class", priority_class())
        .orderBy(_priority_rank(), F.desc("fraud_capture_share"), F.desc("fraud_lift"), "segment_type", "segment_value")
    )


def attach_priority(table: DataFrame, priority: DataFrame) -> DataFrame:
    looked = priority.select("segment_type", "segment_value", "priority_class")
    return table.join(looked, ["segment_type", "segment_value"], "left")


def top_segments(table: DataFrame, order: list[Column], n: int) -> DataFrame:
    return table.where("support_status = 'SUFFICIENT'").orderBy(*order, "segment_type", "segment_value").limit(n)


def material_mcc(df: DataFrame) -> DataFrame:
    """Ten supported MCCs by lift, with their priority class."""
    risk = segment_risk(df, "mcc")
    top = top_segments(risk, [F.desc("fraud_lift"), F.desc("fraud_transactions")], 10)
    return attach_priority(top, risk.withColumn("priority_class", priority_class()))


def material_states(df: DataFrame) -> DataFrame:
    return top_segments(segment_risk(df, "state"), [F.desc("fraud_capture_share"), F.desc("fraud_transactions")], 10)


def priority_display(df: DataFrame) -> DataFrame:
    return top_segments(segment_priority(df), [_priority_rank(), F.desc("fraud_capture_share")], 12)


def split_stability(df: DataFrame) -> DataFrame:
    channel = F.lower(F.trim("use_chip"))
    shares = [X.ratio(F.count_if(channel == f"{c} transaction"), F.count("*")).alias(f"{c}_share") for c in ("online", "chip", "swipe")]
    cells = df.groupBy(F.col("split").alias("split_name")).agg(*_measures(), *shares)
    return cells.select(
        F.lit("SPLIT_STABILITY").alias("analysis_scope"), "split_name", "transactions", "fraud_transactions",
        X.ratio("fraud_transactions", "transactions").alias("fraud_rate"), X.ratio("_fc", "_c").alias("fraud_amount_share"),
        "online_share", "chip_share", "swipe_share")


def channel_state_dependency(df: DataFrame) -> DataFrame:
    cells = df.groupBy(
        F.coalesce("use_chip", F.lit("<NULL>")).alias("channel"),
        F.when(F.col("merchant_state").isNull(), "<MISSING>").otherwise("<PRESENT>").alias("state_status"),
    ).agg(F.count("*").alias("transactions"))
    return cells.withColumn("share", X.ratio("transactions", F.sum("transactions").over(over_all()))).orderBy(F.desc("transactions"), "channel", "state_status")


def share_checks(tables: dict[str, DataFrame]) -> DataFrame:
    """Shares of each segment table add up to one and its rows to the portfolio total."""
    out = None
    for name, t in tables.items():
        one = t.agg(F.round(F.sum("transaction_share"), 9).alias("share_sum"), F.sum("transactions").alias("transactions"), F.count("*").alias("segments"))
        one = one.select(F.lit(name).alias("table_name"), "share_sum", "transactions", "segments",
                         F.when(F.col("share_sum").between(0.999999, 1.000001), "PASS").otherwise("FAIL").alias("status"))
        out = one if out is None else out.unionByName(one)
    return out


def priority_recheck(stored: DataFrame) -> DataFrame:
    """Recompute the priority class of stored rows and report each disagreement count."""
    return stored.agg(F.count("*").alias("rows_checked"), F.count_if(~F.col("priority_class").eqNullSafe(priority_class())).alias("mismatches")).withColumn(
        "status", F.when(F.col("mismatches") == 0, "PASS").otherwise("FAIL"))


def bounds_check(priority: DataFrame, months: DataFrame) -> DataFrame:
    """Public rows stay inside their ranges and month keys are unique and well formed."""
    inside = lambda c: F.col(c).between(0, 1)
    bad = ~(inside("transaction_share") & inside("fraud_capture_share") & (F.col("fraud_transactions") >= 0) & (F.col("fraud_rate") >= 0) & (F.col("fraud_lift") >= 0) & F.col("priority_class").isin(*PRIORITY_ORDER))
    p = priority.agg(F.count("*").alias("n"), F.count_if(F.coalesce(bad, F.lit(True))).alias("bad"), F.lit("priority_rows_in_bounds").alias("check_name"))
    m = months.agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("month") + F.count_if(~F.col("month").rlike("^[0-9]{4}-[0-9]{2}$"))).alias("bad"),
                   F.lit("trend_months_ordered").alias("check_name"))
    return p.unionByName(m).select("check_name", F.col("n").alias("rows_checked"), F.col("bad").alias("violations"),
                                   F.when(F.col("bad") == 0, "PASS").otherwise("FAIL").alias("status"))
