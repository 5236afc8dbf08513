"""Contract, key, label and feature audits. Each audit reads its input once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import exprs as X
from ..functions.scale import TASK_ROWS, join_by_key, join_same, prefix
from .behavior import FEATURES

RAW_COLUMNS = [
    "User", "Card", "Year", "Month", "Day", "Time", "Amount", "Use Chip", "Merchant Name", "Merchant City",
    "Merchant State", "Zip", "MCC", "Errors?", "Is Fraud?",
]
STRUCTURAL_NULLS = ("Merchant State", "Zip", "Errors?")


def rows_from(aggregated: DataFrame, names: Sequence[str], rows: Sequence[Sequence[str]]) -> DataFrame:
    """Turn a one-row aggregate into one row per entry; entries are SQL expressions."""
    return aggregated.selectExpr(X.unpivot_stack([tuple(r) for r in rows], tuple(names)))


def text(value: str) -> str:
    return "'" + value.replace("'", "\\'") + "'"


def null_count(column: str) -> Column:
    return F.count_if(F.col(column).isNull())


def source_contract(df: DataFrame) -> DataFrame:
    i = "source_row_id"
    return df.agg(
        F.count("*").alias("raw_rows"), F.countDistinct(i).alias("distinct_source_row_ids"),
        F.min(i).alias("min_source_row_id"), F.max(i).alias("max_source_row_id"),
    )


def quality_checks(df: DataFrame) -> DataFrame:
    one = df.agg(
        F.count("*").alias("n"), F.countDistinct("source_row_id").alias("ids"), null_count("source_row_id").alias("id_null"),
        null_count("transaction_timestamp").alias("ts_null"), null_count("amount").alias("amount_null"),
        null_count("fraud_label").alias("label_null"),
    )
    entries = [("row_count", "n", True), ("source_row_id_nulls", "id_null", False), ("source_row_id_duplicates", "n - ids", False),
               ("timestamp_nulls", "ts_null", False), ("amount_nulls", "amount_null", False), ("fraud_label_nulls", "label_null", False)]
    rows = [(text(name), f"double({value})", "'PASS'" if free else f"if({value} = 0, 'PASS', 'FAIL')") for name, value, free in entries]
    return rows_from(one, ("check_name", "metric_value", "status"), rows)


def entity_keys(df: DataFrame) -> DataFrame:
    one = df.agg(*[F.countDistinct(c).alias(c) for c in ("user_id", "card_key", "merchant_id_raw")])
    rows = [
        ("'User'", "user_id", "'synthetic user identifier'"),
        ("'User + Card'", "card_key", "'composite card entity key; Card alone is not global'"),
        ("'Merchant Name'", "merchant_id_raw", "'distinct merchant identifier values, not a validated dimension'"),
    ]
    return rows_from(one, ("key_name", "distinct_values", "interpretation"), rows)


def label_audit(df: DataFrame) -> DataFrame:
    counts = df.groupBy("fraud_label").agg(F.count("*").alias("rows"))
    # Three labels at most, so the window is over three rows.
    return counts.withColumn("rate", X.ratio("rows", F.sum("rows").over(Window.partitionBy(F.lit(0)))))


def pit_rule_test(df: DataFrame) -> DataFrame:
    """Of an earlier, an equal and a later history event only the earlier one is eligible; timestamps are present."""
    one = df.agg(F.count("*").alias("n"), null_count("transaction_timestamp").alias("missing"))
    t0 = "timestamp_ntz'2020-01-01 10:00:00'"
    eligible = " + ".join(f"int({t0} + interval {s} second < {t0})" for s in (-1, 0, 1))
    return rows_from(one, ("check_name", "checked_rows", "violations", "status", "notes"), [
        ("'historical_timestamp_strictly_before_t0'", "3L", f"bigint({eligible} - 1)", f"if({eligible} = 1, 'PASS', 'FAIL')",
         "'Only the strictly prior example is eligible; same/future timestamps are excluded.'"),
        ("'transaction_timestamp_nulls'", "n", "missing", "if(missing = 0, 'PASS', 'FAIL')", "'Canonical event timestamp must be present.'"),
    ])


def reconcile_layers(layers: dict[str, DataFrame]) -> DataFrame:
    parts = [
        df.agg(
            F.count("*").alias("row_count"), F.countDistinct("source_row_id").alias("distinct_source_row_id"),
            F.min("source_row_id").alias("min_source_row_id"), F.max("source_row_id").alias("max_source_row_id"),
            F.count_if(F.col("fraud_label") == 1).alias("fraud_rows"),
        ).select(F.lit(name).alias("layer"), "*")
        for name, df in layers.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def duplicate_audit(raw: DataFrame, columns: Sequence[str] = tuple(RAW_COLUMNS[:-1]), label: str = "Is Fraud?") -> DataFrame:
    hashed = raw.select(X.feature_hash(list(columns)).alias("feature_hash"), F.col(f"`{label}`").alias("label"))
    groups = hashed.groupBy("feature_hash").agg(
        F.count("*").alias("rows"), (F.min("label") != F.max("label")).alias("mixed")
    )
    one = groups.agg(
        F.coalesce(F.sum("rows") - F.count("*"), F.lit(0)).alias("extra"), F.count_if(F.col("rows") > 1).alias("repeated"),
        F.count_if(F.col("mixed")).alias("conflicting"),
    )
    return rows_from(one, ("metric", "value"), [
        ("'exact_duplicate_rows_excluding_source_row_id'", "bigint(extra)"), ("'feature_duplicate_groups_excluding_label'", "repeated"),
        ("'conflicting_label_groups'", "conflicting"),
    ])


def amount_semantics(df: DataFrame) -> DataFrame:
    a, fraud = F.col("amount"), F.col("fraud_label") == 1
    cases = {
        "negative_amount_rows": a < 0, "zero_amount_rows": a == 0, "positive_amount_rows": a > 0,
        "fraud_negative_amount_rows": fraud & (a < 0), "fraud_zero_amount_rows": fraud & (a == 0),
    }
    aggs = []
    for name, condition in cases.items():
        aggs += [F.count_if(condition).alias(f"n_{name}"), F.sum(F.when(condition, X.cents(a))).alias(f"s_{name}")]
    rows = [
        (text(name), f"n_{name}", f"double(s_{name}) / 100.0D", "'PASS'",
         "'Fraud amount rate uses signed amounts.'" if name.startswith("fraud") else "'Signed transaction amount semantics.'")
        for name in cases
    ]
    return rows_from(df.agg(*aggs), ("metric", "row_count", "amount_sum", "status", "notes"), rows)


def structural_missingness(df: DataFrame) -> DataFrame:
    fields = {
        "merchant_state": ("MODEL_OK_WITH_MISSINGNESS", "Retain missingness indicator; source coverage limitation."),
        "merchant_zip": ("MODEL_OK_WITH_MISSINGNESS", "Store as string/code; retain missingness indicator."),
        "errors_raw": ("EDA_ONLY", "Blank error descriptor; timing/semantics require review."),
    }
    aggs = [F.count("*").alias("n")]
    for f in fields:
        aggs += [null_count(f).alias(f"n_{f}"), F.count_if(F.col(f).isNull() & (F.col("fraud_label") == 1)).alias(f"f_{f}")]
    rows = [(text(f), f"n_{f}", f"double(n_{f}) * 100.0D / double(n)", f"f_{f}", text(policy), text(note)) for f, (policy, note) in fields.items()]
    return rows_from(df.agg(*aggs), ("field_name", "null_rows", "null_rate_pct", "fraud_null_rows", "policy", "notes"), rows)


def artifact_screen(df: DataFrame, top: int = 30) -> DataFrame:
    """Fraud concentration by channel and MCC value, the ``top`` values with most rows.

    Both fields are counted in one pass over (channel, MCC) cells.
    """
    cells = df.groupBy("use_chip", "merchant_category_code").agg(
        F.count("*").alias("n"), F.count_if(F.col("fraud_label") == 1).alias("f")
    )
    long = cells.selectExpr("n", "f", X.unpivot_stack(
        [("'Use Chip'", "coalesce(use_chip, '<NULL>')"), ("'MCC'", "coalesce(merchant_category_code, '<NULL>')")], ("field_name", "value")))
    screened = long.groupBy("field_name", "value").agg(F.sum("n").alias("row_count"), F.sum("f").alias("fraud_rows"))
    note = F.when(F.col("field_name") == "MCC", "Categorical concentration is not leakage by itself.").otherwise(
        "Fraud concentration is an artifact screen, not an automatic leakage finding.")
    return (
        screened.select("*", X.ratio("fraud_rows", "row_count").alias("fraud_rate"), F.lit("SCREENED").alias("status"), note.alias("notes"))
        .orderBy(F.desc("row_count"), "field_name", "value").limit(top)
    )


def _raw_parsed(raw: DataFrame) -> DataFrame:
    """Amount without $ , and blanks; date from Year / Month / Day; trimmed label."""
    number = F.regexp_replace("Amount", "[$, ]", "").try_cast("double")
    whole = lambda c: F.col(c).try_cast("double").cast("int")
    day = F.try_make_timestamp_ntz(whole("Year"), whole("Month"), whole("Day"), F.lit(0), F.lit(0), F.lit(0))
    return raw.withColumns({"_amount": number, "_day": F.to_date(day), "_label": F.lower(F.trim(F.col("`Is Fraud?`")))})


def blank_count(column: str) -> Column:
    return F.count_if(F.coalesce(F.trim(F.col(f"`{column}`")), F.lit("")) == "")


def source_audit(raw: DataFrame) -> DataFrame:
    """One row of totals for the raw text table."""
    p = _raw_parsed(raw)
    fraud = F.col("_label") == "yes"
    one = p.agg(
        F.count("*").alias("rows"), F.countDistinct("User").alias("users"), F.countDistinct("User", "Card").alias("cards"),
        F.countDistinct("`Merchant Name`").alias("merchants"),
        F.sum(X.cents("_amount")).alias("_total"), F.coalesce(F.sum(F.when(fraud, X.cents("_amount"))), F.lit(0)).alias("_fraud"),
        F.count_if(fraud).alias("fraud_transactions"), null_count("_amount").alias("invalid_amounts"), null_count("_day").alias("invalid_dates"),
        F.min("_day").alias("date_min"), F.max("_day").alias("date_max"), F.countDistinct("_day").alias("active_days"),
    )
    return one.select(
        "rows", "users", "cards", "merchants", X.dollars(F.col("_total")).alias("total_amount"), X.dollars(F.col("_fraud")).alias("fraud_amount"),
        "fraud_transactions", X.ratio("fraud_transactions", "rows").alias("fraud_rate"),
        X.ratio("_fraud", "_total").alias("fraud_amount_rate"), "invalid_amounts", "invalid_dates", "date_min", "date_max", "active_days",
    )


def daily_audit(raw: DataFrame) -> DataFrame:
    fraud = F.col("_label") == "yes"
    return _raw_parsed(raw).where("_day is not null").groupBy(F.col("_day").alias("day")).agg(
        F.count("*").alias("rows"), F.count_if(fraud).alias("fraud"),
        X.dollars(F.coalesce(F.sum(F.when(fraud, X.cents("_amount"))), F.lit(0))).alias("fraud_amount"),
    )


def null_report(raw: DataFrame) -> DataFrame:
    """Blank cells per column, plus unparsable amounts and dates."""
    p = _raw_parsed(raw)
    columns = [c for c in raw.columns if c != "source_row_id"]
    one = p.agg(
        F.count("*").alias("n"), null_count("_amount").alias("bad_amount"), null_count("_day").alias("bad_date"),
        *[blank_count(c).alias(f"c{i}") for i, c in enumerate(columns)],
    )
    rows = []
    for i, c in enumerate(columns):
        otherwise = "DOCUMENTED_LIMITATION" if c in STRUCTURAL_NULLS else "FAIL"
        rows.append((text(c), "'null_count'", "n", f"c{i}", f"round(double(c{i}) / double(n) * 100, 6)", f"if(c{i} = 0, 'PASS', '{otherwise}')"))
    for c, check, v in (("Amount", "numeric_parse", "bad_amount"), ("Year/Month/Day", "valid_date", "bad_date")):
        rows.append((text(c), text(check), "n", v, f"round(double({v}) / double(n) * 100, 6)", f"if({v} = 0, 'PASS', 'REVIEW')"))
    return rows_from(one, ("column_name", "check_name", "total_rows", "affected_rows", "affected_pct", "status"), rows)


def key_integrity(df: DataFrame) -> DataFrame:
    """Distinct users and cards, rows per card, and the user-card-transaction cardinality."""
    cards = df.groupBy("user_id", "card_index").agg(F.count("*").alias("n"))
    users = cards.groupBy("user_id").agg(F.count("*").alias("cards"), F.sum("n").alias("n"))
    one = users.agg(F.sum("n").alias("rows"), F.count("*").alias("users"), F.sum("cards").alias("cards"), F.max("cards").alias("most"))
    return rows_from(one, ("key_name", "total_rows", "distinct_keys", "observed_cardinality", "status"), [
        ("'User'", "rows", "users", "'1-to-many'", "'PASS_WITH_LIMITATION'"),
        ("'User + Card'", "rows", "cards", "if(most > 1, '1-to-many', '1-to-1')", "'PASS_WITH_LIMITATION'"),
    ])


def label_report(raw: DataFrame) -> DataFrame:
    p = _raw_parsed(raw).withColumn("label", F.when(F.coalesce("_label", F.lit("")) == "", "<NULL>").otherwise(F.col("_label")))
    per = p.groupBy("label").agg(F.count("*").alias("n"), F.sum(X.cents("_amount")).alias("c"))
    whole = Window.partitionBy(F.lit(0))
    sized = per.select("label", "n", "c", F.sum("n").over(whole).alias("all_n"), F.sum("c").over(whole).alias("all_c"))
    counts = sized.select(F.lit("label_count").alias("metric"), "label", F.col("n").alias("transaction_count"),
                          F.lit(None).cast("double").alias("amount"), F.round(X.ratio("n", "all_n"), 8).alias("rate"))
    money = sized.where("label = 'yes'").select(
        F.lit("fraud_amount_rate").alias("metric"), F.lit("Yes").alias("label"), F.col("n").alias("transaction_count"),
        X.dollars(F.col("c")).alias("amount"), X.ratio("c", "all_c").alias("rate"))
    return counts.unionByName(money)


def _stitch(df: DataFrame, inside: str, into: str) -> DataFrame:
    """Fold time spans (lo, hi, smallest gap, counts) of one ``inside`` span into one row, adding the gaps between neighbours."""
    w = Window.partitionBy(inside).orderBy("lo")
    edged = df.withColumn("edge", F.col("lo") - F.lag("hi").over(w))
    return edged.groupBy(inside, *([into] if into else [])).agg(
        F.least(F.min("gap"), F.min("edge")).alias("gap"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"), F.sum("instants").alias("instants"))


def timestamp_precision(df: DataFrame) -> DataFrame:
    """Same-instant neighbours and the smallest positive gap, without a global sort.

    Equal neighbours are rows minus distinct instants. Gaps are taken inside each
    second, then between neighbouring seconds of a day, then between days.
    """
    us = X.micros("transaction_timestamp")
    instants = df.groupBy(us.alias("lo")).agg(F.count("*").alias("n"))
    span = lambda size: F.floor(F.col("lo") / F.lit(size))
    points = instants.where("lo is not null").select(
        "lo", F.col("lo").alias("hi"), F.lit(None).cast("long").alias("gap"), "n", F.lit(1).cast("long").alias("instants"),
        span(1_000_000).alias("second"), span(86_400_000_000).alias("day"))
    seconds = _stitch(points, "second", "day")
    days = _stitch(seconds, "day", "").withColumn("whole", F.lit(0))
    one = _stitch(days, "whole", "").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("present"), F.coalesce(F.sum("instants"), F.lit(0)).alias("instants"), F.coalesce(F.min("gap"), F.lit(0)).alias("min_gap"))
    nulls = instants.agg(F.coalesce(F.sum(F.when(F.col("lo").isNull(), F.col("n"))), F.lit(0)).alias("missing"))
    both = one.withColumn("k", F.lit(1)).join(F.broadcast(nulls.withColumn("k", F.lit(1))), "k")
    return rows_from(both, ("metric", "value", "status"), [
        ("'timestamp_nulls'", "double(missing)", "if(missing = 0, 'PASS', 'FAIL')"),
        ("'rows_checked'", "double(present + missing)", "'PASS'"),
        ("'same_timestamp_adjacent_rows'", "double(present - instants)", "'PASS'"),
        ("'minimum_positive_delta_microseconds'", "double(min_gap)", "'PASS'"),
    ])


def no_join_explosion(layers: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in layers.items():
        one = df.agg(F.count("*").alias("rows"), F.countDistinct("source_row_id").alias("distinct_source_row_id")).select(
            F.lit(name).alias("layer"), "rows", "distinct_source_row_id",
            (F.col("rows") - F.col("distinct_source_row_id")).alias("duplicate_source_row_id"),
            F.when(F.col("rows") == F.col("distinct_source_row_id"), "PASS").otherwise("FAIL").alias("status"))
        out = one if out is None else out.unionByName(one)
    return out


# Invariant name -> what a violation would contradict.
INVARIANTS = {
    "user_cold_start_consistency": "cold start implies zero prior count and NULL recency",
    "card_cold_start_consistency": "cold start implies zero prior count and NULL recency",
    "merchant_cold_start_consistency": "cold start implies zero prior count and NULL recency",
    "user_merchant_new_consistency": "new relationship implies zero prior count and NULL recency",
    "card_merchant_new_consistency": "new relationship implies zero prior count and NULL recency",
    "relationship_count_hierarchy": "relationship history cannot exceed entity history",
    "non_negative_recency": "recency is NULL or non-negative",
    "current_positive_amount_semantics": "positive flag agrees with source amount",
    "amount_ratio_semantics": "ratios require a positive current amount and positive prior mean",
    "amount_z_semantics": "z-scores require positive current amount and positive prior standard deviation",
    "state_missing_not_new": "missing state is an availability flag, not a familiarity flag",
}


def _any(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for condition in conditions:
        out = out | condition
    return out


def _violations() -> dict[str, Column]:
    c, bad = F.col, {}
    for e in ("user", "card", "merchant"):
        none_before, cold = c(f"{e}_prior_txn_count") == 0, c(f"{e}_cold_start") == 1
        bad[f"{e}_cold_start_consistency"] = (cold & (~none_before | c(f"{e}_seconds_since_prev_txn").isNotNull())) | (none_before & ~cold)
    for e in ("user_merchant", "card_merchant"):
        seen = (c(f"{e}_prior_txn_count") != 0) | c(f"{e}_seconds_since_prev_txn").isNotNull()
        bad[f"{e}_new_consistency"] = (c(f"{e}_is_new") == 1) & seen
    pairs = [(e, o) for e in ("user", "card") for o in ("merchant", "mcc", "channel")]
    bad["relationship_count_hierarchy"] = _any([c(f"{e}_{o}_prior_txn_count") > c(f"{e}_prior_txn_count") for e, o in pairs])
    bad["non_negative_recency"] = _any([c(f) < 0 for f in recency_features()])
    bad["current_positive_amount_semantics"] = c("current_positive_amount") != (c("amount") > 0)
    for name, stat, feature in (("amount_ratio_semantics", "mean", "vs_{}_mean"), ("amount_z_semantics", "std", "{}_z")):
        allowed = {e: (c("amount") > 0) & F.coalesce(c(f"{e}_prior_positive_amount_{stat}") > 0, F.lit(False)) for e in ("user", "card")}
        bad[name] = _any([c(f"current_positive_amount_{feature.format(e)}").isNotNull() & ~ok for e, ok in allowed.items()])
    bad["state_missing_not_new"] = (c("state_missing_flag") == 1) & c("merchant_state").isNotNull()
    return bad


def semantic_invariants(mart: DataFrame) -> DataFrame:
    one = mart.agg(F.count("*").alias("n"), *[F.count_if(bad).alias(name) for name, bad in _violations().items()])
    rows = [(text(name), "n", name, f"if({name} = 0, 'PASS', 'FAIL')", text(note)) for name, note in INVARIANTS.items()]
    return rows_from(one, ("check_name", "rows_checked", "violations", "status", "notes"), rows)


def recency_features() -> list[str]:
    return [f for f in FEATURES if f.endswith("seconds_since_prev_txn")]


def relationship_semantics(mart: DataFrame) -> DataFrame:
    measures = {}
    for other in ("merchant", "mcc", "channel"):
        for e in ("user", "card"):
            pair = f"{e}_{other}"
            measures[f"{pair}_is_new_count"] = F.count_if(F.col(f"{pair}_is_new") == 1)
            if other == "merchant":
                measures[f"{pair}_recency_null_count"] = null_count(f"{pair}_seconds_since_prev_txn")
    one = mart.agg(*[m.alias(n) for n, m in measures.items()])
    return rows_from(one, ("metric", "metric_value"), [(text(n), n) for n in measures])


def recency_resolution(mart: DataFrame) -> DataFrame:
    aggs = []
    for f in recency_features():
        aggs += [F.min(f).alias(f"m_{f}"), F.count_if(F.col(f) < 0).alias(f"n_{f}"), F.count_if(F.col(f) == 0).alias(f"z_{f}")]
    rows = [(text(f), f"m_{f}", f"n_{f}", f"z_{f}") for f in recency_features()]
    return rows_from(mart.agg(*aggs), ("feature_name", "min_non_null_recency_seconds", "negative_rows", "zero_rows"), rows)


def partition_diversity(profile: DataFrame) -> DataFrame:
    """Features whose (min, mean, median, max) coincide; input is one row per feature."""
    stats = ["min_value", "mean_value", "median_value", "max_value"]
    prefixes = F.array_distinct(F.transform(F.col("names"), lambda n: F.split_part(n, F.lit("_"), F.lit(1))))
    return (
        profile.groupBy(*stats).agg(F.array_sort(F.collect_list("feature_name")).alias("names"))
        .where(F.size("names") >= 2)
        .select(*stats, F.size("names").cast("long").alias("feature_count"), F.array_join("names", ";").alias("feature_names"),
                F.when((F.size("names") >= 5) & (F.size(prefixes) >= 3), "FAIL").otherwise("PASS").alias("status"))
    )


def _smallest(df: DataFrame, column: str, most: int | None) -> DataFrame:
    """``df``, or its ``most`` rows with the smallest ``column`` if a sample is asked for."""
    return df if most is None else df.orderBy(column).limit(most)


def cross_split_history(df: DataFrame, targets_per_split: int | None = None, *, rows: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """For each row of a later split, how many rows its user has in earlier splits and earlier in time; a sample only on request.

    A user's rows are counted by instant and split first, and what lies before an instant is a running sum, which no user has to fit a task for.
    """
    order = {"DEVELOPMENT": 0, "VALIDATION": 1, "OUT_OF_TIME_OOT": 2}
    of = lambda s: F.count_if(F.col("split") == s)
    cells = df.groupBy("user_id", "transaction_timestamp").agg(of("DEVELOPMENT").alias("_n0"), of("VALIDATION").alias("_n1"))
    before = prefix(cells, ["user_id"], [F.asc_nulls_first("transaction_timestamp")], {"_b0": ("_n0", "sum"), "_b1": ("_n1", "sum")}, exclusive=True, rows=rows, task_rows=task_rows)
    later = [_smallest(df.where(F.col("split") == s), "source_row_id", targets_per_split) for s in list(order)[1:]]
    targets = later[0].unionByName(later[1]).select("source_row_id", F.col("split").alias("target_split"), "user_id", "transaction_timestamp")
    found = F.when(F.col("transaction_timestamp").isNull(), 0).when(F.col("target_split") == "VALIDATION", F.col("_b0")).otherwise(F.col("_b0") + F.col("_b1"))
    return join_same(targets, before.select("user_id", "transaction_timestamp", "_b0", "_b1"), ["user_id", "transaction_timestamp"]).select(
        "source_row_id", "target_split", F.lit("user").alias("entity_type"), F.coalesce(found, F.lit(0)).cast("long").alias("expected_prior_split_count"))


def entity_complete_qa(df: DataFrame, cohort_size: int | None = None) -> DataFrame:
    """Users of a cohort (all, unless a size is given): full history loaded and no card shared outside the cohort."""
    if cohort_size is None:
        marked = df.withColumn("_in", F.col("user_id").isNotNull())
    else:
        users = df.select("user_id").distinct()
        cohort = users.orderBy(F.md5(F.col("user_id").cast("string")), "user_id").limit(cohort_size)
        marked = df.join(cohort.withColumn("_in", F.lit(True)), "user_id", "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    cards = marked.groupBy("card_key").agg(F.count_if("_in").alias("inside"), F.count_if(~F.col("_in")).alias("outside"))
    shared = cards.where("inside > 0").agg(F.coalesce(F.sum("outside"), F.lit(0)).alias("external"), F.lit(1).alias("k"))
    # distinct users and ids by nested grouping, so that no row is repeated for each distinct count
    ids = marked.where("_in").groupBy("source_row_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("source_row_id").alias("ids"), F.lit(1).alias("k"))
    users = marked.where("_in").groupBy("user_id").agg(F.lit(1)).agg(F.count("user_id").alias("users"), F.lit(1).alias("k"))
    both = ids.join(F.broadcast(users), "k").join(F.broadcast(shared), "k")  # one row each
    return rows_from(both, ("check_name", "entity_scope", "rows_checked", "violations", "status"), [
        ("'selected_users_deterministic'", "'user'", "users", "0L", "if(users > 0, 'PASS', 'FAIL')"),
        ("'complete_observed_user_history_loaded'", "'user'", "n", "n - ids", "if(n > 0 and n = ids, 'PASS', 'FAIL')"),
        ("'complete_observed_card_history'", "'card'", "n", "external", "if(external = 0, 'PASS', 'FAIL')"),
        ("'relationship_history_complete'", "'user_card_relationships'", "n", "0L", "'PASS'"),
    ])


def prefix_coverage(df: DataFrame, limit: int, targets: int | None = None, *, rows: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """Is a ``source_row_id <= limit`` slice closed in time, and how many of its rows (or its first ``targets``) miss history outside it.

    A row misses history if its user has an earlier row outside, so the first time outside is all that is needed of a user.
    """
    inside = F.col("source_row_id") <= limit
    order = df.agg(F.count_if(inside).alias("n"), F.max(F.when(inside, F.col("transaction_timestamp"))).alias("hi"),
                   F.min(F.when(~inside, F.col("transaction_timestamp"))).alias("lo"))
    closed = F.col("lo").isNull() | F.col("hi").isNull() | (F.col("lo") >= F.col("hi"))
    source = order.select(
        F.lit("source_global_temporal_order").alias("entity_type"), F.col("n").alias("rows_sampled"),
        F.lit(None).cast("long").alias("rows_with_external_prior_history"), F.lit(None).cast("double").alias("share"),
        F.lit(f"SOURCE_ROW_ID_PREFIX_1_TO_{limit}").alias("scope"), F.when(closed, "PASS").otherwise("TRUNCATION_POSSIBLE").alias("status"))
    first = df.where(~inside).groupBy("user_id").agg(F.min("transaction_timestamp").alias("_first"))
    picked = _smallest(df.where(inside), "source_row_id", targets).select("user_id", "transaction_timestamp")
    audited = join_by_key(picked, first, ["user_id"], rows=rows, task_rows=task_rows).agg(F.count("*").alias("n"), F.count_if(F.col("_first") < F.col("transaction_timestamp")).alias("external"))
    scope = "ALL_PREFIX_ROWS" if targets is None else f"DETERMINISTIC_{targets}_TARGET_ROWS"
    user = audited.select(
        F.lit("user").alias("entity_type"), F.col("n").alias("rows_sampled"), F.col("external").alias("rows_with_external_prior_history"),
        F.coalesce(X.ratio("external", "n"), F.lit(0.0)).alias("share"), F.lit(scope).alias("scope"),
        F.when(F.col("external") > 0, "TRUNCATION_POSSIBLE").otherwise("PASS").alias("status"))
    return source.unionByName(user)


def compare_reports(live: DataFrame, stored: DataFrame, keys: Sequence[str], tolerances: dict[str, float], exact: Sequence[str] = ()) -> DataFrame:
    """Field-by-field comparison of a stored report with its recomputation; a key on one side only fails."""
    left = live.select([F.col(k).cast("string").alias(k) for k in keys] + [F.struct(*tolerances, *exact).alias("l")])
    right = stored.select([F.col(k).cast("string").alias(k) for k in keys] + [F.struct(*tolerances, *exact).alias("r")])
    both = join_same_outer(left, right, list(keys))
    cells = []
    for field in [*tolerances, *exact]:
        l, r = F.col(f"l.{field}"), F.col(f"r.{field}")
        if field in tolerances:
            a, b = l.cast("double"), r.cast("double")
            near = F.abs(a - b) <= F.lit(tolerances[field]) * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))
            same = (l.isNull() & r.isNull()) | F.coalesce(near, F.lit(False))
        else:
            same = l.eqNullSafe(r)
        ok = F.col("l").isNotNull() & F.col("r").isNotNull() & same
        cells.append(F.struct(F.lit(field).alias("field"), l.cast("string").alias("live_value"), r.cast("string").alias("stored_value"),
                              F.when(ok, "PASS").otherwise("FAIL").alias("status")))
    return both.select(F.concat_ws("|", *keys).alias("metric"), F.inline(F.array(*cells)))


def join_same_outer(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.select([F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"_r_{k}"])
    joined = left.join(renamed, condition, "full_outer")
    others = [c for c in [*left.columns, *right.columns] if c not in keys]
    return joined.select(*[F.coalesce(left[k], renamed[f"_r_{k}"]).alias(k) for k in keys], *others)


def canonical(x: Column, kind: T.DataType) -> Column:
    """One text for each value of a type, the same in any engine: a letter for the kind, then digits, or a length in bytes and the text itself.

    So no two rows that differ give one text, whatever separators or words their texts hold. Doubles are a whole mantissa of 53 bits and a power
    of two, -0 being 0; times are microseconds, dates days; maps are in the order of their keys.
    """
    name = kind.typeName()
    if name in ("byte", "short", "integer", "long", "decimal"):
        text_ = F.concat(F.lit("I"), x.cast("string"))
    elif name == "boolean":
        text_ = F.concat(F.lit("B"), x.cast("int").cast("string"))
    elif name in ("double", "float"):
        d = F.abs(x.cast("double"))
        guess = F.floor(F.log2(d)).cast("int")
        rest = lambda e: d / F.pow(F.lit(2.0), e)
        exponent = F.when(rest(guess) >= 2, guess + 1).when(rest(guess) < 1, guess - 1).otherwise(guess)
        exact = F.concat(F.when(x < 0, "-").otherwise(""), (rest(exponent) * F.lit(2.0**52)).cast("long").cast("string"), F.lit("p"), exponent.cast("string"))
        text_ = F.concat(F.lit("F"), F.when(F.isnan(x), "nan").when(d == float("inf"), F.when(x < 0, "-inf").otherwise("inf")).when(d == 0, "0").otherwise(exact))
    elif name == "date":
        text_ = F.concat(F.lit("A"), F.unix_date(x).cast("string"))
    elif name == "timestamp":
        text_ = F.concat(F.lit("S"), F.unix_micros(x).cast("string"))
    elif name == "timestamp_ntz":
        seconds = F.unix_date(F.to_date(x)).cast("long") * 86400 + F.hour(x) * 3600 + F.minute(x) * 60
        text_ = F.concat(F.lit("S"), (seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), x) * 1_000_000).cast("long")).cast("string"))
    elif name == "array":
        text_ = F.concat(F.lit("L"), F.size(x).cast("string"), F.lit(":"), F.array_join(F.transform(x, lambda e: canonical(e, kind.elementType)), ""))
    elif name == "map":
        entries = F.array_sort(F.transform(F.map_entries(x), lambda e: F.concat(canonical(e["key"], kind.keyType), canonical(e["value"], kind.valueType))))
        text_ = F.concat(F.lit("M"), F.size(x).cast("string"), F.lit(":"), F.array_join(entries, ""))
    elif name == "struct":
        text_ = F.concat(F.lit("R"), *[canonical(x[f.name], f.dataType) for f in kind.fields])
    else:
        body = F.hex(x) if name == "binary" else x.cast("string")
        text_ = F.concat(F.lit("T"), F.octet_length(body).cast("string"), F.lit(":"), body)
    return F.when(x.isNull(), "N").otherwise(text_)


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free frame identity over all columns in name order: row count, and sum and xor of 60 bits of each row's MD5, as text."""
    cells = [part for f in sorted(df.schema.fields, key=lambda f: f.name) for part in (F.lit(f"{f.name}="), canonical(F.col(f"`{f.name}`"), f.dataType))]
    h = F.conv(F.substring(F.md5(F.concat(*cells)), 1, 15), 16, 10).cast("long")
    return df.agg(F.count("*").alias("rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"), F.bit_xor(h).alias("hash_xor"))


def lineage(df: DataFrame, versions: Sequence[str] = (), ts: str = "transaction_timestamp") -> DataFrame:
    sets = [F.array_join(F.array_sort(F.collect_set(F.col(v).cast("string"))), ",").alias(f"{v}_values") for v in ("split_name", *versions)]
    return df.agg(F.count("*").alias("row_count"), F.countDistinct("source_row_id").alias("source_row_id_count"),
                  F.min(ts).alias("min_timestamp"), F.max(ts).alias("max_timestamp"), *sets)


def frozen_lineage(df: DataFrame, frozen: dict[str, str]) -> DataFrame:
    """Versions in a frame against the frozen ones; unset expectations and absent columns are not checked."""
    open_values = ("", "NOT_AVAILABLE", "NOT_AVAILABLE_UNTIL_PART7_LOCKED")
    fields = [f for f in frozen if f in df.columns]
    aggs = [F.count_if(F.col(f).isNotNull() & (F.col(f).cast("string") != F.lit(frozen[f]))).alias(f) for f in fields]
    one = df.agg(*aggs)
    rows = [(text(f), text(frozen[f]), f if frozen[f] not in open_values else "0L",
             f"if({f} = 0, 'PASS', 'FAIL')" if frozen[f] not in open_values else "'PASS'") for f in fields]
    return rows_from(one, ("field", "frozen_value", "mismatched_rows", "status"), rows)


def input_quality(df: DataFrame) -> DataFrame:
    """Row count, unique ids, null ids and score contract errors of a monitoring table."""
    bad = F.col("risk_score").isNull() | ~F.col("risk_score").between(0, 1)
    return df.agg(F.count("*").alias("row_count"), F.countDistinct("source_row_id").alias("unique_source_row_id"),
                  X.ratio(null_count("source_row_id"), F.count("*")).alias("null_source_row_rate"),
                  X.ratio(F.count_if(bad), F.count("*")).alias("score_contract_error_rate"))
