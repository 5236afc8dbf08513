"""Column contracts, label firewalls and export guards at the edges of the engine."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X
from ..operators.quality import null_count, rows_from, text
from .readers import Field, conform

ACTIONS = ("ALLOW", "REVIEW", "BLOCK")
REQUIRED_COLUMNS = ("source_row_id", "transaction_timestamp", "amount", "risk_score", "split_name")
SCORE_STATUSES = ("PROBABILITY_USABLE", "RANKING_ONLY")

# Fixed name lists of the label firewall and of the public export guard.
FORBIDDEN_POLICY = {"fraud_label", "target", "chargeback", "investigation_outcome", "future_outcome"}
FORBIDDEN_OPERATIONAL = {"fraud_label", "future_outcome", "future_dispute", "review_case_id"}
FORBIDDEN_PUBLIC = FORBIDDEN_OPERATIONAL | {
    "source_row_id", "transaction_id", "transaction_timestamp", "risk_score", "primary_fraud_score", "amount", "positive_exposure",
    "action", "candidate_action", "reason_codes", "review_priority", "review_rank", "review_selected", "review_overflow",
    "bucket_selected", "overflow",
}
FORBIDDEN_FEATURE_TOKENS = (
    "fraud_label", "source_row_id", "user_id", "card_key", "merchant_id_raw", "split_name", "chargeback", "investigation",
    "post_event", "future_",
)
CURRENT_CONTEXT = ("amount", "use_chip", "merchant_category_code", "state_missing_flag")


def assert_policy_columns(columns: Iterable[str]) -> None:
    found = sorted(FORBIDDEN_POLICY & set(columns))
    if found:
        raise ValueError(f"label firewall: forbidden policy columns {found}")


def operational_view(df: DataFrame) -> DataFrame:
    """The rows as a monitor of current operations may see them: an outcome column stops it."""
    outcomes = sorted(FORBIDDEN_OPERATIONAL.intersection(df.columns))
    if outcomes:
        raise ValueError(f"outcome columns {outcomes} are not known while operations run")
    return df


# How labels were obtained and what may be claimed of them; and whether a clock runs on known outcomes.
LABEL_CLAIMS = {"RETROSPECTIVE_MATURED": "RETROSPECTIVE_MATURED", "SIMULATED_DELAY": "SIMULATED"}
CLOCK_HAS_OUTCOMES = {"OPERATIONS_NOW": False, "OUTCOMES_MATURED": True}


def matured_view(df: DataFrame, label_mode: str = "RETROSPECTIVE_MATURED") -> DataFrame:
    """Labelled rows with the mode of their labels and the claim that goes with it."""
    claim = LABEL_CLAIMS.get(label_mode)
    if claim is None:
        raise ValueError(f"label mode {label_mode} is none of {sorted(LABEL_CLAIMS)}")
    if "fraud_label" not in df.columns:
        raise ValueError("no outcomes without the column fraud_label")
    return df.select("*", F.lit(label_mode).alias("label_mode"), F.lit(claim).alias("label_claim_class"))


def assert_label_mode(mode: str, matured: bool) -> None:
    """A clock must agree with whether outcomes are at hand; clocks without a rule take either."""
    if CLOCK_HAS_OUTCOMES.get(mode, matured) is not bool(matured):
        raise ValueError(f"{mode} does not go {'with' if matured else 'without'} outcomes")


def missing_columns(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS) -> list[str]:
    return sorted(set(required) - set(df.columns))


def schema_check(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    """One row: PASS or FAIL, the missing columns and how many rows they concern."""
    gone = missing_columns(df, required)
    return df.agg(F.count("*").alias("rows")).select(
        F.lit("FAIL" if gone else "PASS").alias("status"), F.lit(",".join(gone)).alias("missing_columns"), F.lit(len(required)).alias("required_columns"), "rows")


def firewall_report(df: DataFrame, forbidden: set[str]) -> DataFrame:
    found = sorted(forbidden & set(df.columns))
    return df.agg(F.count("*").alias("rows")).select(
        F.lit(",".join(found)).alias("forbidden_columns"), F.lit("REJECTED" if found else "ACCEPTED").alias("status"), "rows")


def feature_violations(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Features absent from the table or carrying a forbidden token in their name."""
    bad = [f for f in features if f not in df.columns]
    return bad + [f for f in features if any(t in f.lower() for t in FORBIDDEN_FEATURE_TOKENS)]


def feature_contract(df: DataFrame, features: Sequence[str]) -> DataFrame:
    bad = set(feature_violations(df, features))
    present = df.agg(*[F.count(f).alias(f) for f in features if f in df.columns])
    rows = [(text(f), f if f in df.columns else "0L", "'FAIL'" if f in bad else "'PASS'") for f in features]
    return rows_from(present, ("feature_name", "present_values", "status"), rows)


def _leaf_names(dtype: T.DataType) -> list[str]:
    if isinstance(dtype, T.StructType):
        return [n for f in dtype.fields for n in [f.name, *_leaf_names(f.dataType)]]
    if isinstance(dtype, T.ArrayType):
        return _leaf_names(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _leaf_names(dtype.valueType)
    return []


def assert_public(df: DataFrame) -> DataFrame:
    """Refuse tables that carry row-level or sensitive names at any depth."""
    found = sorted({n.lower() for n in _leaf_names(df.schema)} & FORBIDDEN_PUBLIC)
    if found:
        raise ValueError(f"public export contains row-level fields {found}")
    return df


def export_report(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Ordered single-file CSV of a small aggregate report."""
    assert_public(df).orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def score_gate(df: DataFrame, score_status: str | None, calibration_version: str | None = None) -> DataFrame:
    """Nine named checks of a scored table, from one aggregation."""
    gone = missing_columns(df)
    first = f"'{'FAIL' if gone else 'PASS'}'"
    if gone:
        return rows_from(df.agg(F.count("*").alias("n")), ("check_name", "status", "notes"), [("'P7T01_required_columns'", first, text(f"missing={gone}"))])
    assert_policy_columns(df.columns)
    score, amount = F.col("risk_score").try_cast("double"), F.col("amount").try_cast("double")
    one = df.agg(
        F.count("*").alias("n"), F.countDistinct("source_row_id").alias("ids"), null_count("source_row_id").alias("id_null"),
        F.count_if(F.col("transaction_timestamp").try_cast("timestamp").isNull()).alias("ts_bad"),
        F.count_if(score.isNull() | F.isnan(score)).alias("score_bad"), F.count_if(~F.coalesce(score.between(0, 1), F.lit(False))).alias("range_bad"),
        F.count_if(amount.isNull() | F.isnan(amount)).alias("amount_bad"), null_count("split_name").alias("split_bad"))
    status = lambda bad: f"if({bad} = 0, 'PASS', 'FAIL')"
    explicit = score_status in SCORE_STATUSES
    calibrated = score_status == "RANKING_ONLY" or bool(calibration_version)
    calibration_note = ("Calibration version is required for probability use." if score_status == "PROBABILITY_USABLE" and not calibration_version
                        else "Ranking-only status disables expected-value interpretation.")
    return rows_from(one, ("check_name", "status", "notes"), [
        ("'P7T01_required_columns'", first, "'missing=[]'"),
        ("'P7T02_source_row_id_unique'", status("n - ids - if(id_null = 1, 1, 0)"), "'Decision input key must be unique.'"),
        ("'P7T03_timestamp_parse'", status("ts_bad"), "'Canonical transaction timestamp.'"),
        ("'P7T04_score_finite'", status("score_bad"), "'No null or non-finite score.'"),
        ("'P7T05_score_range'", status("range_bad"), "'Declared range [0, 1].'"),
        ("'P7T06_amount_finite'", status("amount_bad"), "'Signed amount is source input, not realized loss.'"),
        ("'P7T07_split_values'", status("split_bad"), "'Split artifact is required.'"),
        ("'P7T08_probability_status_explicit'", f"'{'PASS' if explicit else 'FAIL'}'", "'Expected-value formulas require an explicit status.'"),
        ("'P7T09_calibration_metadata'", f"'{'PASS' if calibrated else 'FAIL'}'", text(calibration_note)),
    ])


def gate_status(checks: DataFrame) -> DataFrame:
    return checks.agg(F.when(F.count_if(F.col("status") != "PASS") == 0, "SCORE_GATE_LOCKED").otherwise("INPUT_BLOCKED").alias("gate_status"), F.count("*").alias("checks"))


def lenient_boolean(c):
    """1/true/yes/y and 0/false/no/n in any case; NULL stays NULL; anything else is an error."""
    word = F.lower(F.trim(X.as_col(c).cast("string")))
    return (F.when(word.isNull(), F.lit(None).cast("boolean")).when(word.isin("1", "true", "yes", "y"), True)
            .when(word.isin("0", "false", "no", "n"), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), word)).cast("boolean")))


def decision_contract_violations(df: DataFrame) -> DataFrame:
    """Rows whose score or amount breaks the decision contract, by rule."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    score, amount = F.col("risk_score").cast("double"), F.col("amount").cast("double")
    one = df.agg(F.count("*").alias("n"), F.count_if(~(finite(score) & F.coalesce(score.between(0, 1), F.lit(False)))).alias("score"), F.count_if(~finite(amount)).alias("amount"),
                 null_count("source_row_id").alias("id"))
    return rows_from(one, ("rule", "rows_checked", "violations"), [
        ("'risk_score_finite_in_unit_interval'", "n", "score"), ("'amount_finite'", "n", "amount"), ("'source_row_id_present'", "n", "id")])


def monitoring_contract(df: DataFrame) -> DataFrame:
    """Violations of the monitoring input contract, by rule."""
    gone = missing_columns(df)
    if gone:
        raise ValueError(f"monitoring contract missing columns {gone}")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    amount, score = F.col("amount").try_cast("double"), F.col("risk_score").try_cast("double")
    action = F.count_if(~F.coalesce(F.upper("action").isin(*ACTIONS), F.lit(False))) if "action" in df.columns else F.lit(0).cast("long")
    one = df.agg(
        F.count("*").alias("n"), (F.count("*") - F.countDistinct("source_row_id")).alias("ids"),
        F.count_if(F.col("transaction_timestamp").try_cast("timestamp").isNull()).alias("ts"), F.count_if(~finite(amount)).alias("amount"),
        F.count_if(~F.coalesce(score.between(0, 1), F.lit(False))).alias("score"), action.alias("action"))
    rules = [("source_row_id_unique_non_null", "ids"), ("transaction_timestamp_parseable", "ts"), ("amount_finite", "amount"), ("risk_score_in_unit_interval", "score"), ("action_domain", "action")]
    return rows_from(one, ("rule", "rows_checked", "violations", "status"), [(text(r), "n", c, f"if({c} = 0, 'PASS', 'FAIL')") for r, c in rules])


def require_monitoring_contract(df: DataFrame) -> DataFrame:
    broken = monitoring_contract(df).where("violations > 0").collect()
    if broken:
        raise ValueError(f"monitoring contract broken: {[(r['rule'], r['violations']) for r in broken]}")
    return df


def quality_profile(df: DataFrame, known: dict[str, list[str]] | None = None, baseline_missing: dict[str, float] | None = None) -> DataFrame:
    """Scalar quality metrics, null rates, missingness deltas and category rates as one long table.

    ``known`` holds the frozen category lists, a few hundred values at most.
    """
    known, baseline_missing = known or {}, baseline_missing or {}
    share = lambda c: X.ratio(F.count_if(c), F.count("*"))
    score, amount = F.col("risk_score").try_cast("double"), F.col("amount").try_cast("double")
    has_action = "action" in df.columns
    aggs = {
        "row_count": F.count("*").cast("double"), "unique_source_row_id": F.countDistinct("source_row_id").cast("double"),
        "duplicate_row_rate": 1 - X.ratio(F.countDistinct("source_row_id"), F.count("*")),
        "timestamp_parse_error_rate": share(F.col("transaction_timestamp").try_cast("timestamp").isNull()),
        "future_timestamp_rate": F.max(F.lit(0.0)),
        "score_missing_rate": share(score.isNull()), "score_out_of_range_rate": share(~F.coalesce(score.between(0, 1), F.lit(False))),
        "amount_nonfinite_rate": share(amount.isNull() | F.isnan(amount) | (F.abs(amount) == float("inf"))),
    }
    scalar = list(aggs)
    for c in df.columns:
        aggs[f"null_rate.{c}"] = share(F.col(c).isNull())
    for c, values in known.items():
        inside = F.coalesce(F.col(c).cast("string").isin(*values), F.lit(False))
        aggs[f"unknown_category_rate.{c}"] = share(~inside)
        aggs[f"new_category_rate.{c}"] = F.coalesce(X.ratio(F.count_if(F.col(c).isNotNull() & ~inside), F.count(F.col(c))), F.lit(0.0))
    if has_action:
        aggs["_bad_action"] = F.count_if(~F.coalesce(F.upper("action").isin(*ACTIONS), F.lit(False))).cast("double")
    one = df.agg(*[v.alias(k.replace(".", "__")) for k, v in aggs.items()])
    issues = {"duplicate_row_rate": "DUPLICATE_SOURCE_ROW_ID", "timestamp_parse_error_rate": "TIMESTAMP_PARSE_FAILURE", "score_missing_rate": "SCORE_MISSING",
              "score_out_of_range_rate": "SCORE_OUT_OF_RANGE", "amount_nonfinite_rate": "AMOUNT_NONFINITE"}
    if has_action:
        issues["_bad_action"] = "ACTION_DOMAIN_FAILURE"
    found = F.array_compact(F.array(*[F.when(F.col(k) > 0, F.lit(v)) for k, v in issues.items()]))
    one = one.withColumn("_issues", F.array_join(found, ";"))
    rows = []
    for k in aggs:
        if k == "_bad_action":
            continue
        column = k.replace(".", "__")
        family, _, field = k.partition(".")
        rows.append((text("scalar" if k in scalar else family), text(k if k in scalar else field), column))
        if family == "null_rate":
            rows.append(("'structural_missingness_delta'", text(field), f"{column} - {baseline_missing[field]}D" if field in baseline_missing else f"{column} - {column}"))
    return one.selectExpr("_issues as critical_issues", "if(_issues = '', 'PASS', 'FAIL') as status", X.unpivot_stack(rows, ("family", "metric", "value")))


def _upper(c: Column, _) -> Column:
    return F.upper(c)


def _flag(c: Column, _) -> Column:
    return X.flag(c)


# The monitoring contract's names for what the queue calls otherwise.
DECIDED_FIELDS = (
    Field("candidate_action", read=_upper, required=True), Field("action", read=_upper, required=True),
    Field("review_selected", renames=("bucket_selected",), read=_flag, required=True), Field("review_overflow", renames=("overflow",), read=_flag, required=True),
    Field("bucket_capacity", default=lambda: F.lit(0)),
    Field("review_capacity_bucket", renames=("capacity_bucket",), copies=("operational_window_id",), read=lambda c, _: F.coalesce(c.cast("string"), F.lit("DEFAULT")), default=lambda: F.lit("DEFAULT")),
)


def adapt_decisions(df: DataFrame) -> DataFrame:
    """Decision table in the monitoring contract."""
    return conform(df, DECIDED_FIELDS)


def capacity_reconciliation(adapted: DataFrame) -> DataFrame:
    """Per bucket: one capacity, eligible = selected + overflow, selected within capacity."""
    cells = adapted.groupBy(F.col("review_capacity_bucket").alias("capacity_bucket")).agg(
        F.count_if(F.col("candidate_action") == "REVIEW").alias("eligible_cases"), F.count_if("review_selected").alias("selected_cases"),
        F.count_if("review_overflow").alias("overflow_cases"), F.max("bucket_capacity").cast("long").alias("bucket_capacity"), F.min("bucket_capacity").cast("long").alias("_low"))
    ok = (F.col("_low") == F.col("bucket_capacity")) & (F.col("eligible_cases") == F.col("selected_cases") + F.col("overflow_cases")) & (F.col("selected_cases") <= F.col("bucket_capacity"))
    return cells.select("capacity_bucket", "eligible_cases", "selected_cases", "overflow_cases", "bucket_capacity",
                        X.ratio("selected_cases", "bucket_capacity").alias("capacity_utilization"), F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL").alias("status"))


def require_reconciled(df: DataFrame) -> DataFrame:
    """Adapt and fail closed when a bucket does not reconcile."""
    adapted = adapt_decisions(df)
    broken = capacity_reconciliation(adapted).where("status = 'FAIL'").limit(5).collect()
    if broken:
        raise ValueError(f"capacity reconciliation failed in buckets {[r['capacity_bucket'] for r in broken]}")
    return adapted
