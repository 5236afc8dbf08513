"""Query registry: each entry pairs a Spark query with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Dates and times are compared as text, since clients differ in how they return them.
AS_TEXT = {
    "SRC12_inventory": ("date_min", "date_max"), "PRJ01_05_standardize": ("transaction_timestamp",), "PRJ06_09_dates_and_bands": ("transaction_date",),
    "PRJ10_current_context": ("transaction_timestamp",), "DQ11_source_audit": ("date_min", "date_max"), "DQ11_daily_audit": ("day",), "DQ37_lineage": ("min_timestamp", "max_timestamp"),
    "SPL01_chronological_split": ("transaction_date",), "SPL02_derived_splits": ("date_start", "date_end"), "SPL03_split_summary": ("date_start", "date_end"), "SPL04_quarter_counts": ("quarter_start",),
    "SPL07_scope_summary": ("date_start", "date_end"), "SPL08_evaluation_population": ("date_start", "date_end"), "SPL11_temporal_folds": ("train_end", "validation_start", "validation_end"),
    "SPL12_policy_scopes": ("start_at", "end_at"), "WIN19_behavioral_mart": ("transaction_timestamp",), "POL16_daily_action_metrics": ("date",), "SRC06_monitoring_input_aliases": ("transaction_timestamp",),
}


def query(name: str, sql: str | None = None):
    texts = AS_TEXT.get(name, ())

    def register(fn):
        def run(spark, sf_dir):
            df = fn(spark, sf_dir)
            return df.withColumns({c: df[c].cast("string") for c in texts}) if texts else df

        QUERIES[name] = run
        if sql is not None:
            replaced = ", ".join(f"cast({c} as varchar) as {c}" for c in texts)
            ORACLES[name] = f"select * replace ({replaced}) from (\n{sql}\n) as checked" if texts else sql
        return fn
    return register


# --- SQL building blocks -------------------------------------------------------------------------

TXN = """
txn as (
  select source_row_id, transaction_timestamp, user_id, card_index, concat(user_id, ':', card_index) as card_key,
    cast(l_suppkey as varchar) as merchant_id_raw,
    case when l_partkey % 13 <> 0 then concat('City ', l_suppkey % 37) end as merchant_city,
    case when l_partkey % 11 <> 0 then n_name end as merchant_state,
    case when l_partkey % 17 <> 0 then cast(10000 + l_partkey % 900 as varchar) end as merchant_zip,
    cast(5000 + l_partkey % 40 as varchar) as merchant_category_code,
    case when l_orderkey % 50 = 0 then 'Insufficient Balance' end as errors_raw,
    use_chip, amount,
    case when (source_row_id % 97 * 7919) % 97 < (case when use_chip = 'Online Transaction' then 6 else 2 end) then 1 else 0 end as fraud_label,
    cast((source_row_id % 2147483647 * 48271) % 2147483647 as double) / 2147483647 as base_score
  from (
    select *, (l_orderkey * 8 + l_linenumber) * 64 + rn - 1 as source_row_id, o_orderdate as transaction_timestamp, o_custkey as user_id,
      cast(l_suppkey % 3 as int) as card_index,
      case l_returnflag when 'A' then 'Swipe Transaction' when 'N' then 'Chip Transaction' when 'R' then 'Online Transaction' end as use_chip,
      case when l_linestatus = 'F' and l_quantity > 45 then -l_extendedprice
           when l_discount = 0 and l_quantity < 3 then cast(0 as double) else l_extendedprice end as amount
    from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_extendedprice, l_quantity,
        l_shipdate, l_returnflag, l_linestatus, l_discount, l_tax) as rn from lineitem) numbered join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey) t),
base as (
  select *, cast(transaction_timestamp as date) as transaction_date, cast(year(transaction_timestamp) as bigint) as transaction_year,
    cast(month(transaction_timestamp) as bigint) as transaction_month, cast(round(amount * 100) as bigint) as cents,
    case when fraud_label = 1 then cast(round(amount * 100) as bigint) end as fcents,
    case when cast(transaction_timestamp as date) <= date '1999-08-11' then 'DEVELOPMENT'
         when cast(transaction_timestamp as date) <= date '2000-08-06' then 'VALIDATION' else 'OUT_OF_TIME_OOT' end as split
  from txn),
dev as (select * from base where split = 'DEVELOPMENT')"""

BANDS = """case when amount < 0 then 'NEGATIVE / REFUND-LIKE' when amount = 0 then 'ZERO' when amount <= 25 then '>0–25'
  when amount <= 50 then '25–50' when amount <= 100 then '50–100' when amount <= 250 then '100–250'
  when amount <= 500 then '250–500' else '500+' end"""


def unknown(column: str) -> str:
    return f"coalesce(nullif(trim({column}), ''), '<UNKNOWN>')"


def _frame(keys: str) -> str:
    return f"partition by {keys} order by transaction_timestamp range between"


def _mart_sql() -> str:
    """Direct range frames per feature, the textbook form of the same features."""
    before = "and interval '1 microsecond' preceding"
    keys = {
        "user": "user_id", "card": "card_key", "merchant": "merchant_id_raw", "user_merchant": "user_id, merchant_id_raw",
        "card_merchant": "card_key, merchant_id_raw", "user_mcc": "user_id, merchant_category_code",
        "card_mcc": "card_key, merchant_category_code", "user_channel": "user_id, use_chip", "card_channel": "card_key, use_chip",
    }
    spans = {"1h": "1 hour", "24h": "24 hours", "7d": "7 days"}
    raw, out = [], []
    for e, k in keys.items():
        frame = f"({_frame(k)} unbounded preceding {before})"
        raw.append(f"count(*) over {frame} as {e}_n")
        out.append(f"{e}_n as {e}_prior_txn_count")
        kind = "cold_start" if e in ("user", "card", "merchant") else "is_new"
        out.append(f"case when {e}_n = 0 then 1 else 0 end as {e}_{kind}")
        if e in ("user", "card", "merchant", "user_merchant", "card_merchant"):
            raw.append(f"max(transaction_timestamp) over {frame} as {e}_last")
            out.append(f"cast(date_diff('second', {e}_last, transaction_timestamp) as bigint) as {e}_seconds_since_prev_txn")
        if e in ("user", "card", "merchant"):
            for s, interval in spans.items():
                if e == "merchant" and s == "7d":
                    continue
                raw.append(f"count(*) over ({_frame(k)} interval '{interval}' preceding {before}) as {e}_txn_count_{s}")
                out.append(f"{e}_txn_count_{s}")
        if e in ("user", "card"):
            for s in ("24h", "7d"):
                raw.append(f"coalesce(sum(pos) over ({_frame(k)} interval '{spans[s]}' preceding {before}), 0) as {e}_ps_{s}")
                out.append(f"cast({e}_ps_{s} as double) / 100 as {e}_positive_amount_sum_{s}")
            raw += [f"count(pos) over {frame} as {e}_k", f"sum(pos) over {frame} as {e}_s", f"sum(cast(pos as hugeint) * pos) over {frame} as {e}_q"]
    mean = lambda e: f"(cast({e}_s as double) / (cast({e}_k as double) * 100))"
    std = lambda e: f"(case when {e}_k > 1 then sqrt(cast({e}_k * {e}_q - {e}_s * {e}_s as double) / cast({e}_k * ({e}_k - 1) as double)) / 100 end)"
    second = []
    for e in ("user", "card"):
        second += [
            f"case when {e}_k > 0 then {mean(e)} end as {e}_prior_positive_amount_mean", f"{std(e)} as {e}_prior_positive_amount_std",
            f"case when amount > 0 and {e}_k > 0 and {mean(e)} > 0 then amount / {mean(e)} end as current_positive_amount_vs_{e}_mean",
            f"case when amount > 0 and {e}_k >= 5 and {std(e)} > 0 then (amount - {mean(e)}) / {std(e)} end as current_positive_amount_{e}_z",
        ]
    cols = ", ".join(out + second)
    return f"""
hist as (select *, {', '.join(raw)} from (select *, case when amount > 0 then cents end as pos from base) b),
mart as (
  select source_row_id, transaction_timestamp, split as split_name, user_id, card_key, merchant_id_raw, merchant_category_code, use_chip,
    merchant_state, amount, cents, fcents, base_score, {cols}, amount > 0 as current_positive_amount,
    case when merchant_state is null then 1 else 0 end as state_missing_flag, fraud_label
  from hist)"""


MART = TXN + "," + _mart_sql()

# Decision input with flags found by "no strictly earlier event", not by counting frames.
SCORED = TXN + """,
scored as (
  select source_row_id, transaction_timestamp, split as split_name, user_id, card_key, merchant_category_code, amount, fraud_label,
    least(cast(1.0 as double), base_score * cast(0.6 as double) + fraud_label * cast(0.3 as double)) as risk_score,
    greatest(amount, cast(0 as double)) as positive_exposure,
    case use_chip when 'Online Transaction' then 'ONLINE' when 'Swipe Transaction' then 'SWIPE' when 'Chip Transaction' then 'CHIP' else 'OTHER/UNKNOWN' end as channel,
    transaction_timestamp = min(transaction_timestamp) over (partition by card_key, merchant_id_raw) as pair_new,
    transaction_timestamp = min(transaction_timestamp) over (partition by card_key) as cold_card,
    transaction_timestamp = min(transaction_timestamp) over (partition by merchant_id_raw) as new_merchant,
    (user_id + cast(merchant_id_raw as bigint)) % 4 = 0 as cross_community,
    case when merchant_state is null then 1 else 0 end as state_missing_flag
  from base)"""


def with_(ctes: str, select: str) -> str:
    return f"with {ctes.strip()}\n{select}"
