"""Foundation, portfolio, feature and profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import behavior as B
from ..operators import portfolio as P
from ..operators import profiling as R
from ..operators import quality as Q
from ..operators import splits as S
from ..sources import readers
from . import tables as T
from .registry import BANDS, MART, TXN, query, unknown, with_

# --- sources and standardization ------------------------------------------------------------------


@query("SRC02_row_id", "select count(*) as rows, count(distinct id) as ids, min(id) as first_id, max(id) as last_id from (select row_number() over () as id from lineitem) t")
def _(spark, sf):
    numbered = readers.add_row_id(T.table(spark, sf, "lineitem").select("l_orderkey"))
    i = "source_row_id"
    return numbered.agg(F.count("*").alias("rows"), F.countDistinct(i).alias("ids"), F.min(i).alias("first_id"), F.max(i).alias("last_id"))


@query("SRC03_open_table", "select o_orderpriority, count(*) as rows from orders group by 1")
def _(spark, sf):
    readers.open_table(spark, f"{sf}/orders.parquet", "swipewatch_orders")
    return spark.sql("select o_orderpriority, count(*) as rows from swipewatch_orders group by 1")


@query("SRC04_load_by_suffix", "select c_mktsegment, count(*) as rows from customer group by 1")
def _(spark, sf):
    return readers.load(spark, f"{sf}/customer.parquet").groupBy("c_mktsegment").agg(F.count("*").alias("rows"))


@query("SRC09_every_row_kept", "select (select count(*) from lineitem) as lineitem_rows, (select count(*) from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey) as transactions, (select count(*) from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey) as ids")
def _(spark, sf):
    """Transactions are all lines that have an order and a supplier, each with an id of its own."""
    ids = T.transactions(spark, sf).groupBy("source_row_id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("transactions"), F.count("*").alias("ids"))
    return ids.withColumn("lineitem_rows", F.lit(T.row_bound(spark, sf)).cast("long"))


@query("SRC07_prefix_slice", with_(TXN, "select source_row_id, amount, fraud_label from txn where source_row_id <= 6400000"))
def _(spark, sf):
    return readers.prefix_slice(T.transactions(spark, sf), 6400000).select("source_row_id", "amount", "fraud_label")


@query("SRC12_inventory", with_(TXN, "select count(*) as row_count, cast(15 as bigint) as column_count, min(transaction_date) as date_min, max(transaction_date) as date_max from base"))
def _(spark, sf):
    return readers.inventory(T.raw_source(spark, sf).drop("source_row_id"))


_STANDARD = """select source_row_id, user_id, card_index, card_key, transaction_timestamp, amount, use_chip, merchant_id_raw, merchant_city,
  merchant_state, merchant_zip, merchant_category_code, errors_raw, fraud_label from txn"""


@query("PRJ01_05_standardize", with_(TXN, _STANDARD))
def _(spark, sf):
    return readers.standardize(T.raw_source(spark, sf))


@query("PRJ06_09_dates_and_bands", with_(TXN, f"""select source_row_id, transaction_date, transaction_year, transaction_month,
  strftime(transaction_timestamp, '%Y-%m') as month, {BANDS} as amount_band, {unknown('merchant_state')} as state from base"""))
def _(spark, sf):
    return T.model_splits(spark, sf).select(
        "source_row_id", "transaction_date", "transaction_year", "transaction_month", X.month_key("transaction_timestamp").alias("month"),
        X.amount_band("amount").alias("amount_band"), X.known_or_unknown("merchant_state").alias("state"))


@query("PRJ10_current_context", with_(TXN, """select source_row_id, transaction_timestamp, split as split_name, fraud_label, amount, use_chip,
  merchant_category_code, cast(merchant_state is null as int) as state_missing_flag from base"""))
def _(spark, sf):
    return T.model_splits(spark, sf).select(
        "source_row_id", "transaction_timestamp", F.col("split").alias("split_name"), "fraud_label", "amount", "use_chip",
        "merchant_category_code", F.col("merchant_state").isNull().cast("int").alias("state_missing_flag"))


_RAW_HASH = """md5(concat_ws(chr(31), cast(user_id as varchar), cast(card_index as varchar), cast(year(transaction_timestamp) as varchar),
  cast(month(transaction_timestamp) as varchar), cast(day(transaction_timestamp) as varchar), '00:00', printf('$%.2f', amount),
  use_chip, merchant_id_raw, coalesce(merchant_city, ' '), coalesce(merchant_state, ''), coalesce(merchant_zip, '<NULL>'),
  merchant_category_code, coalesce(errors_raw, '<NULL>')))"""


@query("PRJ17_feature_hash", with_(TXN, f"select source_row_id, {_RAW_HASH} as feature_hash from txn"))
def _(spark, sf):
    return T.raw_source(spark, sf).select("source_row_id", X.feature_hash(Q.RAW_COLUMNS[:-1]).alias("feature_hash"))


# --- quality --------------------------------------------------------------------------------------


@query("DQ01_source_contract", with_(TXN, """select count(*) as raw_rows, count(distinct source_row_id) as distinct_source_row_ids,
  min(source_row_id) as min_source_row_id, max(source_row_id) as max_source_row_id from txn"""))
def _(spark, sf):
    return Q.source_contract(T.transactions(spark, sf))


@query("DQ02_quality_checks", with_(TXN, """,c as (select cast(count(*) as double) as n, cast(count(*) - count(source_row_id) as double) as a,
   cast(count(*) - count(distinct source_row_id) as double) as b, cast(count(*) - count(transaction_timestamp) as double) as d,
   cast(count(*) - count(amount) as double) as e, cast(count(*) - count(fraud_label) as double) as f from txn)
  select k as check_name, v as metric_value, case when k = 'row_count' or v = 0 then 'PASS' else 'FAIL' end as status from (
   select unnest(['row_count','source_row_id_nulls','source_row_id_duplicates','timestamp_nulls','amount_nulls','fraud_label_nulls']) as k,
          unnest([n, a, b, d, e, f]) as v from c) t"""))
def _(spark, sf):
    return Q.quality_checks(T.transactions(spark, sf))


@query("DQ03_entity_keys", with_(TXN, """select 'User' as key_name, count(distinct user_id) as distinct_values, 'synthetic user identifier' as interpretation from txn
  union all select 'User + Card', count(distinct card_key), 'composite card entity key; Card alone is not global' from txn
  union all select 'Merchant Name', count(distinct merchant_id_raw), 'distinct merchant identifier values, not a validated dimension' from txn"""))
def _(spark, sf):
    return Q.entity_keys(T.transactions(spark, sf))


@query("DQ04_label_audit", with_(TXN, """select fraud_label, count(*) as rows, cast(count(*) as double) / (select count(*) from txn) as rate from txn group by fraud_label"""))
def _(spark, sf):
    return Q.label_audit(T.transactions(spark, sf))


@query("DQ05_pit_rule_test", with_(TXN, """select 'historical_timestamp_strictly_before_t0' as check_name, cast(3 as bigint) as checked_rows,
   cast(count(*) filter (where h < timestamp '2020-01-01 10:00:00') - 1 as bigint) as violations, 'PASS' as status,
   'Only the strictly prior example is eligible; same/future timestamps are excluded.' as notes
  from (values (timestamp '2020-01-01 09:59:59'), (timestamp '2020-01-01 10:00:00'), (timestamp '2020-01-01 10:00:01')) v(h)
  union all select 'transaction_timestamp_nulls', count(*), count(*) - count(transaction_timestamp),
   case when count(*) = count(transaction_timestamp) then 'PASS' else 'FAIL' end, 'Canonical event timestamp must be present.' from txn"""))
def _(spark, sf):
    return Q.pit_rule_test(T.transactions(spark, sf))


_LAYER = "select '{}' as layer, count(*) as row_count, count(distinct source_row_id) as distinct_source_row_id, min(source_row_id) as min_source_row_id, max(source_row_id) as max_source_row_id, count(*) filter (where fraud_label = 1) as fraud_rows from {}"


@query("DQ06_layer_reconciliation", with_(TXN, " union all ".join(_LAYER.format(n, t) for n, t in (("STANDARDIZED", "txn"), ("TRANSACTION_BASE", "base"), ("MODEL_SPLITS", "base")))))
def _(spark, sf):
    return Q.reconcile_layers({
        "STANDARDIZED": readers.standardize(T.raw_source(spark, sf)), "TRANSACTION_BASE": T.transactions(spark, sf),
        "MODEL_SPLITS": T.model_splits(spark, sf)})


@query("DQ07_duplicate_audit", with_(TXN, f""",h as (select {_RAW_HASH} as feature_hash, count(*) as n, count(distinct fraud_label) as labels from txn group by 1)
  select 'exact_duplicate_rows_excluding_source_row_id' as metric, cast(sum(n) - count(*) as bigint) as value from h
  union all select 'feature_duplicate_groups_excluding_label', count(*) filter (where n > 1) from h
  union all select 'conflicting_label_groups', count(*) filter (where labels > 1) from h"""))
def _(spark, sf):
    return Q.duplicate_audit(T.raw_source(spark, sf))


def _amount_case(name, where, note):
    return f"select '{name}' as metric, count(*) as row_count, cast(sum(cents) as double) / 100 as amount_sum, 'PASS' as status, '{note}' as notes from base where {where}"


_S, _A = "Signed transaction amount semantics.", "Fraud amount rate uses signed amounts."


@query("DQ08_amount_semantics", with_(TXN, " union all ".join([
    _amount_case("negative_amount_rows", "amount < 0", _S), _amount_case("zero_amount_rows", "amount = 0", _S),
    _amount_case("positive_amount_rows", "amount > 0", _S), _amount_case("fraud_negative_amount_rows", "amount < 0 and fraud_label = 1", _A),
    _amount_case("fraud_zero_amount_rows", "amount = 0 and fraud_label = 1", _A)])))
def _(spark, sf):
    return Q.amount_semantics(T.transactions(spark, sf))


def _missing(field, policy, note):
    return f"""select '{field}' as field_name, count(*) filter (where {field} is null) as null_rows,
      cast(count(*) filter (where {field} is null) as double) * 100 / count(*) as null_rate_pct,
      count(*) filter (where {field} is null and fraud_label = 1) as fraud_null_rows, '{policy}' as policy, '{note}' as notes from txn"""


@query("DQ09_structural_missingness", with_(TXN, " union all ".join([
    _missing("merchant_state", "MODEL_OK_WITH_MISSINGNESS", "Retain missingness indicator; source coverage limitation."),
    _missing("merchant_zip", "MODEL_OK_WITH_MISSINGNESS", "Store as string/code; retain missingness indicator."),
    _missing("errors_raw", "EDA_ONLY", "Blank error descriptor; timing/semantics require review.")])))
def _(spark, sf):
    return Q.structural_missingness(T.transactions(spark, sf))


@query("DQ10_artifact_screen", with_(TXN, """,u as (
   select 'Use Chip' as field_name, coalesce(use_chip, '<NULL>') as value, fraud_label, 'Fraud concentration is an artifact screen, not an automatic leakage finding.' as notes from txn
   union all select 'MCC', coalesce(merchant_category_code, '<NULL>'), fraud_label, 'Categorical concentration is not leakage by itself.' from txn)
  select field_name, value, count(*) as row_count, count(*) filter (where fraud_label = 1) as fraud_rows,
   cast(count(*) filter (where fraud_label = 1) as double) / count(*) as fraud_rate, 'SCREENED' as status, notes
  from u group by field_name, value, notes order by row_count desc, field_name, value limit 30"""))
def _(spark, sf):
    return Q.artifact_screen(T.transactions(spark, sf))


@query("DQ11_source_audit", with_(TXN, """select count(*) as rows, count(distinct user_id) as users, count(distinct card_key) as cards, count(distinct merchant_id_raw) as merchants,
  cast(sum(cents) as double) / 100 as total_amount, cast(sum(fcents) as double) / 100 as fraud_amount, sum(fraud_label)::bigint as fraud_transactions,
  cast(sum(fraud_label) as double) / count(*) as fraud_rate, cast(sum(fcents) as double) / cast(sum(cents) as double) as fraud_amount_rate,
  cast(0 as bigint) as invalid_amounts, cast(0 as bigint) as invalid_dates, min(transaction_date) as date_min, max(transaction_date) as date_max,
  count(distinct transaction_date) as active_days from base"""))
def _(spark, sf):
    return Q.source_audit(T.raw_source(spark, sf))


@query("DQ11_daily_audit", with_(TXN, """select transaction_date as day, count(*) as rows, sum(fraud_label)::bigint as fraud, cast(coalesce(sum(fcents), 0) as double) / 100 as fraud_amount from base group by 1"""))
def _(spark, sf):
    return Q.daily_audit(T.raw_source(spark, sf))


@query("DQ12_null_report", with_(TXN, """,n as (select count(*) as n, count(*) filter (where merchant_city is null) as city, count(*) filter (where merchant_state is null) as st,
   count(*) filter (where merchant_zip is null) as zip, count(*) filter (where errors_raw is null) as err from txn),
  r as (select unnest(['User','Card','Year','Month','Day','Time','Amount','Use Chip','Merchant Name','Merchant City','Merchant State','Zip','MCC','Errors?','Is Fraud?','Amount','Year/Month/Day']) as column_name,
   unnest([0,0,0,0,0,0,0,0,0,city,st,zip,0,err,0,0,0]) as affected_rows, generate_subscripts([0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0], 1) as i, n from n)
  select column_name, case i when 16 then 'numeric_parse' when 17 then 'valid_date' else 'null_count' end as check_name, n as total_rows, affected_rows,
   round(cast(affected_rows as double) / n * 100, 6) as affected_pct,
   case when affected_rows = 0 then 'PASS' when column_name in ('Merchant State','Zip','Errors?') then 'DOCUMENTED_LIMITATION' else 'FAIL' end as status from r"""))
def _(spark, sf):
    return Q.null_report(T.raw_source(spark, sf))


@query("DQ13_key_integrity", with_(TXN, """select 'User' as key_name, count(*) as total_rows, count(distinct user_id) as distinct_keys, '1-to-many' as observed_cardinality, 'PASS_WITH_LIMITATION' as status from txn
  union all select 'User + Card', count(*), count(distinct card_key), '1-to-many', 'PASS_WITH_LIMITATION' from txn"""))
def _(spark, sf):
    return Q.key_integrity(T.transactions(spark, sf))


@query("DQ14_label_report", with_(TXN, """select 'label_count' as metric, case fraud_label when 1 then 'yes' else 'no' end as label, count(*) as transaction_count, cast(null as double) as amount,
   round(cast(count(*) as double) / (select count(*) from txn), 8) as rate from txn group by 2
  union all select 'fraud_amount_rate', 'Yes', count(*) filter (where fraud_label = 1), cast(sum(fcents) as double) / 100, cast(sum(fcents) as double) / cast(sum(cents) as double) from base"""))
def _(spark, sf):
    return Q.label_report(T.raw_source(spark, sf))


@query("DQ23_timestamp_precision", """with o as (select ts, lag(ts) over (order by ts, event_id) as p from events)
  select 'timestamp_nulls' as metric, cast(count(*) - count(ts) as double) as value, case when count(*) = count(ts) then 'PASS' else 'FAIL' end as status from o
  union all select 'rows_checked', cast(count(*) as double), 'PASS' from o
  union all select 'same_timestamp_adjacent_rows', cast(count(*) filter (where ts = p) as double), 'PASS' from o
  union all select 'minimum_positive_delta_microseconds', cast(coalesce(min(date_diff('microsecond', p, ts)) filter (where ts > p), 0) as double), 'PASS' from o""")
def _(spark, sf):
    return Q.timestamp_precision(T.table(spark, sf, "events").withColumnRenamed("ts", "transaction_timestamp"))


@query("DQ23_timestamp_precision_ties", with_(TXN, """, o as (select transaction_timestamp as ts, lag(transaction_timestamp) over (order by transaction_timestamp, source_row_id) as p from txn)
  select 'timestamp_nulls' as metric, cast(count(*) - count(ts) as double) as value, 'PASS' as status from o
  union all select 'rows_checked', cast(count(*) as double), 'PASS' from o
  union all select 'same_timestamp_adjacent_rows', cast(count(*) filter (where ts = p) as double), 'PASS' from o
  union all select 'minimum_positive_delta_microseconds', cast(coalesce(min(date_diff('microsecond', p, ts)) filter (where ts > p), 0) as double), 'PASS' from o"""))
def _(spark, sf):
    return Q.timestamp_precision(T.transactions(spark, sf))


_NJE = "select '{0}' as layer, count(*) as rows, count(distinct source_row_id) as distinct_source_row_id, count(*) - count(distinct source_row_id) as duplicate_source_row_id, 'PASS' as status from base"


@query("DQ24_no_join_explosion", with_(TXN, " union all ".join(_NJE.format(n) for n in ("behavior_source", "behavioral_features_v1", "evaluation_view"))))
def _(spark, sf):
    mart = T.mart(spark, sf)
    return Q.no_join_explosion({
        "behavior_source": T.model_splits(spark, sf), "behavioral_features_v1": mart.drop("fraud_label"), "evaluation_view": mart})


_NJE_OF = """select '{0}' as layer, count(*) as rows, count(distinct source_row_id) as distinct_source_row_id, count(*) - count(distinct source_row_id) as duplicate_source_row_id,
   case when count(*) = count(distinct source_row_id) then 'PASS' else 'FAIL' end as status from {1}"""


@query("DQ24_no_join_explosion_all_layers", with_(MART, " union all ".join(
    [_NJE_OF.format("behavior_source", "base")] + [_NJE_OF.format(n, "mart") for n in (*B.LAYERS, "behavioral_features_v1", "evaluation_view")])))
def _(spark, sf):
    source, mart = T.model_splits(spark, sf), T.mart(spark, sf)
    return Q.no_join_explosion({
        "behavior_source": source, **B.feature_layers(source, rows=T.row_bound(spark, sf)), "behavioral_features_v1": mart.drop("fraud_label"), "evaluation_view": mart})


_INVARIANT_NAMES = ", ".join(f"'{n}'" for n in Q.INVARIANTS)
_INVARIANT_NOTES = ", ".join(f"'{n}'" for n in Q.INVARIANTS.values())


@query("DQ25_semantic_invariants", with_(MART, f"""select unnest([{_INVARIANT_NAMES}]) as check_name, n as rows_checked, unnest(bad) as violations,
   case when unnest(bad) = 0 then 'PASS' else 'FAIL' end as status, unnest([{_INVARIANT_NOTES}]) as notes from (select count(*) as n, [
   count(*) filter (where (user_cold_start = 1) <> (user_prior_txn_count = 0) or (user_cold_start = 1) <> (user_seconds_since_prev_txn is null)),
   count(*) filter (where (card_cold_start = 1) <> (card_prior_txn_count = 0) or (card_cold_start = 1) <> (card_seconds_since_prev_txn is null)),
   count(*) filter (where (merchant_cold_start = 1) <> (merchant_prior_txn_count = 0) or (merchant_cold_start = 1) <> (merchant_seconds_since_prev_txn is null)),
   count(*) filter (where user_merchant_is_new = 1 and (user_merchant_prior_txn_count > 0 or user_merchant_seconds_since_prev_txn is not null)),
   count(*) filter (where card_merchant_is_new = 1 and (card_merchant_prior_txn_count > 0 or card_merchant_seconds_since_prev_txn is not null)),
   count(*) filter (where greatest(user_merchant_prior_txn_count, user_mcc_prior_txn_count, user_channel_prior_txn_count) > user_prior_txn_count
      or greatest(card_merchant_prior_txn_count, card_mcc_prior_txn_count, card_channel_prior_txn_count) > card_prior_txn_count),
   count(*) filter (where least(user_seconds_since_prev_txn, card_seconds_since_prev_txn, merchant_seconds_since_prev_txn, user_merchant_seconds_since_prev_txn, card_merchant_seconds_since_prev_txn) < 0),
   count(*) filter (where current_positive_amount <> (amount > 0)),
   count(*) filter (where (current_positive_amount_vs_user_mean is not null and not (amount > 0 and coalesce(user_prior_positive_amount_mean, 0) > 0)) or (current_positive_amount_vs_card_mean is not null and not (amount > 0 and coalesce(card_prior_positive_amount_mean, 0) > 0))),
   count(*) filter (where (current_positive_amount_user_z is not null and not (amount > 0 and coalesce(user_prior_positive_amount_std, 0) > 0)) or (current_positive_amount_card_z is not null and not (amount > 0 and coalesce(card_prior_positive_amount_std, 0) > 0))),
   count(*) filter (where state_missing_flag = 1 and merchant_state is not null)] as bad from mart) t"""))
def _(spark, sf):
    return Q.semantic_invariants(T.mart(spark, sf))


@query("DQ26_relationship_semantics", with_(MART, " union all ".join(
    [f"select '{e}_{o}_is_new_count' as metric, count(*) filter (where {e}_{o}_is_new = 1) as metric_value from mart" for o in ("merchant", "mcc", "channel") for e in ("user", "card")]
    + [f"select '{e}_merchant_recency_null_count', count(*) - count({e}_merchant_seconds_since_prev_txn) from mart" for e in ("user", "card")])))
def _(spark, sf):
    return Q.relationship_semantics(T.mart(spark, sf))


@query("DQ27_recency_resolution", with_(MART, " union all ".join(
    f"select '{f}' as feature_name, min({f}) as min_non_null_recency_seconds, count(*) filter (where {f} < 0) as negative_rows, count(*) filter (where {f} = 0) as zero_rows from mart" for f in Q.recency_features())))
def _(spark, sf):
    return Q.recency_resolution(T.mart(spark, sf))


def _mean_sql(f: str) -> str:
    return f"round(avg({f}), 6)" if R._fractional(f) else f"cast(sum({f}) as double) / count({f})"


_DIST = " union all ".join(
    f"select '{f}' as feature_name, cast(min({f}) as double) as min_value, {_mean_sql(f)} as mean_value, median(cast({f} as double)) as median_value, cast(max({f}) as double) as max_value from mart" for f in B.FEATURES)


@query("DQ28_partition_diversity", with_(MART, f""",d as ({_DIST})
  select min_value, mean_value, median_value, max_value, count(*) as feature_count, string_agg(feature_name, ';' order by feature_name) as feature_names,
   case when count(*) >= 5 and count(distinct split_part(feature_name, '_', 1)) >= 3 then 'FAIL' else 'PASS' end as status
  from d group by all having count(*) >= 2"""))
def _(spark, sf):
    return Q.partition_diversity(R.distribution_profile(T.mart(spark, sf), rows=T.row_bound(spark, sf)))


@query("DQ29_cross_split_history", with_(TXN, """,t as (select * from base where split <> 'DEVELOPMENT')
  select t.source_row_id, t.split as target_split, 'user' as entity_type, count(h.source_row_id) as expected_prior_split_count
  from t left join base h on h.user_id = t.user_id and h.transaction_timestamp < t.transaction_timestamp
    and (h.split = 'DEVELOPMENT' or (h.split = 'VALIDATION' and t.split = 'OUT_OF_TIME_OOT')) group by 1, 2"""))
def _(spark, sf):
    return Q.cross_split_history(T.model_splits(spark, sf), rows=T.row_bound(spark, sf))


@query("DQ30_entity_complete_qa", with_(TXN, """,c as (select distinct user_id from txn),
  i as (select count(*) as n, count(distinct user_id) as u, count(distinct source_row_id) as d from txn where user_id in (select user_id from c)),
  e as (select count(*) as x from txn where user_id not in (select user_id from c) and card_key in (select card_key from txn where user_id in (select user_id from c)))
  select 'selected_users_deterministic' as check_name, 'user' as entity_scope, u as rows_checked, cast(0 as bigint) as violations, 'PASS' as status from i
  union all select 'complete_observed_user_history_loaded', 'user', n, n - d, case when n = d then 'PASS' else 'FAIL' end from i
  union all select 'complete_observed_card_history', 'card', n, x, case when x = 0 then 'PASS' else 'FAIL' end from i, e
  union all select 'relationship_history_complete', 'user_card_relationships', n, 0, 'PASS' from i"""))
def _(spark, sf):
    return Q.entity_complete_qa(T.transactions(spark, sf))


@query("DQ31_prefix_coverage", with_(TXN, """,o as (select count(*) filter (where source_row_id <= 3840000) as n, max(transaction_timestamp) filter (where source_row_id <= 3840000) as hi,
   min(transaction_timestamp) filter (where source_row_id > 3840000) as lo from txn),
  t as (select * from txn where source_row_id <= 3840000),
  x as (select count(*) as n, count(*) filter (where exists (select 1 from txn h where h.source_row_id > 3840000 and h.user_id = t.user_id and h.transaction_timestamp < t.transaction_timestamp)) as e from t)
  select 'source_global_temporal_order' as entity_type, n as rows_sampled, cast(null as bigint) as rows_with_external_prior_history, cast(null as double) as share,
   'SOURCE_ROW_ID_PREFIX_1_TO_3840000' as scope, case when lo is null or hi is null or lo >= hi then 'PASS' else 'TRUNCATION_POSSIBLE' end as status from o
  union all select 'user', n, e, cast(e as double) / n, 'ALL_PREFIX_ROWS', case when e > 0 then 'TRUNCATION_POSSIBLE' else 'PASS' end from x"""))
def _(spark, sf):
    return Q.prefix_coverage(T.transactions(spark, sf), 3840000, rows=T.row_bound(spark, sf))


_CMP = """,a as (select coalesce(use_chip, 'x') as segment_value, count(*) as n, cast(sum(fraud_label) as double) / count(*) as r from dev group by 1)"""


@query("DQ32_report_comparison", with_(TXN, _CMP + """
  select segment_value as metric, unnest(['transactions', 'fraud_rate', 'support_status']) as field, 'PASS' as status from a"""))
def _(spark, sf):
    dev = T.development(spark, sf)
    live = P.segment_risk(dev, "channel")
    stored = dev.groupBy(F.col("use_chip").alias("segment_value")).agg(
        F.count("*").alias("transactions"), F.avg("fraud_label").alias("fraud_rate"),
        F.when(F.count("*") >= 1000, "SUFFICIENT").otherwise("LOW_SUPPORT").alias("support_status"))
    return Q.compare_reports(live, stored, ["segment_value"], {"transactions": 0.0, "fraud_rate": 1e-12}, ["support_status"]).select("metric", "field", "status")


@query("DQ33_share_checks", with_(TXN, " union all ".join(
    f"select '{k}' as table_name, cast(1.0 as double) as share_sum, count(*) as transactions, count(distinct {e}) as segments, 'PASS' as status from dev"
    for k, e in (("channel", unknown("use_chip")), ("amount_band", BANDS), ("mcc", unknown("merchant_category_code")), ("state", unknown("merchant_state")), ("merchant_city", unknown("merchant_city"))))))
def _(spark, sf):
    dev = T.development(spark, sf)
    return P.share_checks({k: P.segment_risk(dev, k) for k in P.SEGMENT_COLUMNS})


_SEGMENTS = {"channel": unknown("use_chip"), "amount_band": BANDS, "mcc": unknown("merchant_category_code"), "state": unknown("merchant_state"), "merchant_city": unknown("merchant_city")}


def _risk_sql(kind: str) -> str:
    return f"""select 'DEVELOPMENT_DISCOVERY' as analysis_scope, '{kind}' as segment_type, g as segment_value, n as transactions, cast(n as double) / bn as transaction_share,
   f as fraud_transactions, cast(f as double) / n as fraud_rate, (cast(f as double) / n) / (cast(bf as double) / bn) as fraud_lift, cast(f as double) / bf as fraud_capture_share,
   cast(c as double) / 100 as total_amount, cast(fc as double) / 100 as fraud_amount, cast(fc as double) / nullif(cast(c as double), 0) as fraud_amount_share,
   cast(fc as double) / cast(bfc as double) as fraud_amount_capture_share, case when n >= 1000 then 'SUFFICIENT' else 'LOW_SUPPORT' end as support_status
  from (select {_SEGMENTS[kind]} as g, count(*) as n, cast(sum(fraud_label) as bigint) as f, cast(sum(cents) as bigint) as c, cast(sum(fcents) as bigint) as fc from dev group by 1) s,
       (select count(*) as bn, sum(fraud_label) as bf, sum(fcents) as bfc from dev) b"""


_PRIORITY = """case when support_status = 'LOW_SUPPORT' then 'LOW_PRIORITY' when fraud_lift >= 2 and (fraud_capture_share >= 0.05 or fraud_amount_capture_share >= 0.05) then 'PRIORITY_1'
  when fraud_lift >= 1.25 or fraud_capture_share >= 0.03 or fraud_amount_capture_share >= 0.03 then 'PRIORITY_2' else 'MONITOR' end"""
_FOUR = ", ".join(f"r{i} as ({_risk_sql(k)})" for i, k in enumerate(("channel", "amount_band", "mcc", "state")))
_PRIO = f""", {_FOUR}, prio as (select * exclude (total_amount, fraud_amount, fraud_amount_share), {_PRIORITY} as priority_class from
  (select * from r0 union all select * from r1 union all select * from r2 union all select * from r3) u)"""


@query("DQ34_priority_recheck", with_(TXN, _PRIO + " select count(*) as rows_checked, cast(0 as bigint) as mismatches, 'PASS' as status from prio"))
def _(spark, sf):
    return P.priority_recheck(P.segment_priority(T.development(spark, sf)))


@query("DQ35_bounds_check", with_(TXN, _PRIO + """ select 'priority_rows_in_bounds' as check_name, count(*) as rows_checked, cast(0 as bigint) as violations, 'PASS' as status from prio
  union all select 'trend_months_ordered', count(distinct strftime(transaction_timestamp, '%Y-%m')), 0, 'PASS' from dev"""))
def _(spark, sf):
    dev = T.development(spark, sf)
    return P.bounds_check(P.segment_priority(dev), P.monthly_trend(dev))


# Columns whose text form is the same in both engines; names in order.
_PRINTED = ("card_index", "errors_raw", "fraud_label", "merchant_category_code", "merchant_city", "merchant_id_raw", "merchant_state", "merchant_zip", "source_row_id", "use_chip", "user_id")


def _cell_sql(column: str, kind: str) -> str:
    d = f"abs(cast({column} as double))"
    guess = f"cast(floor(log2({d})) as int)"
    exponent = f"(case when {d} / pow(2::double, {guess}) >= 2 then {guess} + 1 when {d} / pow(2::double, {guess}) < 1 then {guess} - 1 else {guess} end)"
    forms = {
        "I": f"'I' || {column}", "S": f"'S' || epoch_us({column})", "T": f"'T' || strlen({column}) || ':' || {column}",
        "F": f"'F' || case when {d} = 0 then '0' else case when {column} < 0 then '-' else '' end || cast({d} / pow(2::double, {exponent}) * 4503599627370496::double as bigint) || 'p' || {exponent} end"}
    return f"case when {column} is null then 'N' else {forms[kind]} end"


_KINDS = {"amount": "F", "base_score": "F", "card_index": "I", "card_key": "T", "errors_raw": "T", "fraud_label": "I", "merchant_category_code": "T", "merchant_city": "T", "merchant_id_raw": "T", "merchant_state": "T", "merchant_zip": "T",
          "source_row_id": "I", "transaction_timestamp": "S", "use_chip": "T", "user_id": "I"}


def _fingerprint_sql(columns) -> str:
    row = " || ".join(f"'{c}=' || {_cell_sql(c, _KINDS[c])}" for c in sorted(columns))
    return with_(TXN, f", h as (select ('0x' || substr(md5({row}), 1, 15))::bigint as h from txn) select count(*) as rows, cast(sum(cast(h as hugeint)) as varchar) as hash_sum, bit_xor(h) as hash_xor from h")


@query("DQ36_fingerprint", _fingerprint_sql(_PRINTED))
def _(spark, sf):
    return Q.fingerprint(T.transactions(spark, sf).select(*_PRINTED))


@query("DQ36_fingerprint_all_columns", _fingerprint_sql(_KINDS))
def _(spark, sf):
    return Q.fingerprint(T.transactions(spark, sf))


@query("DQ37_lineage", with_(TXN, """select count(*) as row_count, count(distinct source_row_id) as source_row_id_count, min(transaction_timestamp) as min_timestamp,
  max(transaction_timestamp) as max_timestamp, 'DEVELOPMENT,OUT_OF_TIME_OOT,VALIDATION' as split_name_values from base"""))
def _(spark, sf):
    return Q.lineage(T.model_splits(spark, sf).withColumnRenamed("split", "split_name"))


# --- splits and sampling --------------------------------------------------------------------------


@query("SPL01_chronological_split", with_(TXN, "select source_row_id, transaction_date, split from base"))
def _(spark, sf):
    return T.model_splits(spark, sf).select("source_row_id", "transaction_date", "split")


@query("SPL02_derived_splits", with_(TXN, """,d as (select transaction_date as d, count(*) as n, sum(fraud_label) as f from base group by 1),
  o as (select *, row_number() over (order by d) - 1 as i, count(*) over () as k from d)
  select case when i < greatest(1, floor(k * cast(0.70 as double))) then 'DEVELOPMENT' when i < greatest(greatest(1, floor(k * cast(0.70 as double))) + 1, floor(k * cast(0.85 as double))) then 'VALIDATION' else 'OUT_OF_TIME_OOT' end as split_name,
   min(d) as date_start, max(d) as date_end, cast(sum(n) as bigint) as row_count, cast(sum(f) as bigint) as fraud_count from o group by 1"""))
def _(spark, sf):
    return S.derive_splits(T.transactions(spark, sf))


@query("SRC08_ordered_export", with_(TXN, "select row_number() over (order by amount desc, merchant_city desc nulls last, source_row_id) as position, source_row_id, user_id, merchant_city, use_chip, amount from base"))
def _(spark, sf):
    """All transactions written in order to a shared folder and read back with their places."""
    from uuid import uuid4

    from ..functions.scale import ensure_checkpoint_dir
    from ..sources.ordered import read_ordered, write_ordered

    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/ordered-{uuid4().hex}"
    rows = T.transactions(spark, sf).select("source_row_id", "user_id", "merchant_city", "use_chip", "amount")
    write_ordered(rows, path, [F.desc("amount"), F.desc_nulls_last("merchant_city"), "source_row_id"])
    return read_ordered(spark, path, rows.schema)


@query("SPL03_split_summary", with_(TXN, "select split as split_name, min(transaction_date) as date_start, max(transaction_date) as date_end, count(*) as row_count, cast(sum(fraud_label) as bigint) as fraud_count from base group by 1"))
def _(spark, sf):
    return S.split_summary(T.model_splits(spark, sf))


def _splits_named(spark, sf):
    return T.model_splits(spark, sf).withColumnRenamed("split", "split_name")


@query("SPL04_quarter_counts", with_(TXN, "select cast(date_trunc('quarter', transaction_timestamp) as timestamp) as quarter_start, cast(sum(fraud_label) as bigint) as fraud_rows, cast(sum(1 - fraud_label) as bigint) as legitimate_rows from dev group by 1"))
def _(spark, sf):
    return S.quarter_counts(_splits_named(spark, sf))


_TRAIN = """,q as (select *, date_trunc('quarter', transaction_timestamp) as qs from dev),
 ranked as (select q.*, row_number() over (partition by qs order by md5(concat(source_row_id, ':20260830'))) as rk from q where fraud_label = 0),
 quota as (select qs, 20 * greatest(sum(fraud_label), 1) as quota from q group by 1),
 train as (select source_row_id, 'DEVELOPMENT_TRAIN' as modeling_scope from q where fraud_label = 1
   union all select source_row_id, 'DEVELOPMENT_TRAIN' from ranked join quota using (qs) where rk <= quota)"""


@query("SPL05_sample_negatives", with_(TXN, _TRAIN + " select * from train"))
def _(spark, sf):
    return S.sample_negatives(_splits_named(spark, sf)).select("source_row_id", "modeling_scope")


@query("SPL05_sample_negatives_tight", with_(TXN, _TRAIN.replace("20 * greatest", "2 * greatest") + " select * from train"))
def _(spark, sf):
    return S.sample_negatives(_splits_named(spark, sf), ratio=2).select("source_row_id", "modeling_scope")


def _eval_sql(origin: str) -> str:
    return f""",bd as (select split, min(transaction_timestamp) as lo, max(transaction_timestamp) as hi from base group by 1),
 ev as (select source_row_id, case when b.split = 'OUT_OF_TIME_OOT' then 'OOT_EVALUATION_WINDOW' when transaction_timestamp < {origin} + interval 182 days then 'VALIDATION_CALIBRATION' else 'VALIDATION_SELECTION' end as modeling_scope
  from base b join bd on b.split = bd.split where b.split <> 'DEVELOPMENT' and transaction_timestamp >= hi - interval 365 days)"""


_LATE = "greatest(lo, hi - interval 365 days)"


@query("SPL06_evaluation_windows", with_(TXN, _eval_sql("lo") + " select * from ev"))
def _(spark, sf):
    return S.evaluation_windows(_splits_named(spark, sf)).select("source_row_id", "modeling_scope")


@query("SPL06_evaluation_windows_from_window_start", with_(TXN, _eval_sql(_LATE) + " select * from ev"))
def _(spark, sf):
    return S.evaluation_windows(_splits_named(spark, sf), anchor="window_start").select("source_row_id", "modeling_scope")


@query("SPL07_scope_summary", with_(TXN, _TRAIN + _eval_sql("lo") + """ select modeling_scope as scope, min(transaction_timestamp) as date_start, max(transaction_timestamp) as date_end, count(*) as rows,
  cast(sum(fraud_label) as bigint) as fraud_rows, cast(sum(1 - fraud_label) as bigint) as legitimate_rows, cast(sum(fraud_label) as double) / count(*) as natural_prevalence,
  case when modeling_scope = 'DEVELOPMENT_TRAIN' then 'all_fraud_plus_deterministic_quarter_hash_20_to_1' else 'fixed_calendar_window_natural_prevalence' end as sampling_method,
  case when modeling_scope = 'DEVELOPMENT_TRAIN' then 20 end as sample_ratio, modeling_scope = 'DEVELOPMENT_TRAIN' as weighted
  from (select * from train union all select * from ev) s join base using (source_row_id) group by modeling_scope"""))
def _(spark, sf):
    return S.scope_summary(S.modeling_population(_splits_named(spark, sf)))


@query("SPL08_evaluation_population", with_(TXN, """select split as split_name, count(*) as rows, cast(sum(fraud_label) as bigint) as fraud_rows, cast(count(*) - sum(fraud_label) as bigint) as legitimate_rows,
  min(transaction_timestamp) as date_start, max(transaction_timestamp) as date_end, cast(sum(fraud_label) as double) / count(*) as natural_prevalence from base where split <> 'DEVELOPMENT' group by 1"""))
def _(spark, sf):
    return S.evaluation_population(_splits_named(spark, sf))


@query("SPL09_development_profile", with_(TXN, "select cast(sum(fraud_label) as bigint) as development_fraud_rows, cast(sum(1 - fraud_label) as bigint) as development_legitimate_rows, cast(sum(fraud_label) as double) / count(*) as development_fraud_rate from dev"))
def _(spark, sf):
    return S.development_profile(_splits_named(spark, sf))


@query("SPL10_sample_weights", with_(TXN, _TRAIN + """,k as (select count(*) filter (where fraud_label = 0) as full_n from dev),
  m as (select b.source_row_id, b.fraud_label, count(*) filter (where b.fraud_label = 0) over () as sampled from train join base b using (source_row_id))
  select source_row_id, case when fraud_label = 0 then greatest(1.0, cast(full_n as double) / sampled) else cast(1.0 as double) end as sample_weight from m, k"""))
def _(spark, sf):
    named = _splits_named(spark, sf)
    sampled = S.sample_negatives(named)
    return S.with_sample_weight(sampled, named.where("split_name = 'DEVELOPMENT'")).select("source_row_id", "sample_weight")


@query("SPL11_temporal_folds", with_(TXN, """,d as (select distinct transaction_date as d from dev), o as (select d, row_number() over (order by d) - 1 as i, count(*) over () as n from d),
  f as (select k, n, greatest(0, cast(round_even(n * (0.5::double + k * 0.15::double), 0) as int) - 1) as te, case when k = 2 then n - 1 else cast(round_even(n * (0.65::double + k * 0.15::double), 0) as int) - 1 end as ve
    from (select distinct n from o) x, (values (0), (1), (2)) v(k))
  select cast(k + 1 as int) as fold, a.d as train_end, b.d as validation_start, c.d as validation_end, a.d < b.d as chronology_pass
  from f join o a on a.i = te join o b on b.i = te + 1 join o c on c.i = ve"""))
def _(spark, sf):
    return S.temporal_folds(T.development(spark, sf)).withColumn("fold", F.col("fold").cast("int"))


@query("SPL12_policy_scopes", with_(TXN, """select case split when 'DEVELOPMENT' then 'P7_POLICY_TUNE' when 'VALIDATION' then 'P7_POLICY_CONFIRM' else 'FINAL_OOT' end as policy_scope,
  min(transaction_timestamp) as start_at, max(transaction_timestamp) as end_at, count(*) as rows from base group by 1"""))
def _(spark, sf):
    return S.policy_scope_ranges(_splits_named(spark, sf))


@query("SPL13_reference_and_observation", with_(TXN, "select split as split_name, case split when 'VALIDATION' then 'reference' else 'observation' end as role, count(*) as rows from base where split <> 'DEVELOPMENT' group by 1, 2"))
def _(spark, sf):
    named = _splits_named(spark, sf)
    both = S.reference_rows(named).withColumn("role", F.lit("reference")).unionByName(S.observation_rows(named).withColumn("role", F.lit("observation")))
    return both.groupBy("split_name", "role").agg(F.count("*").alias("rows"))


# --- portfolio ------------------------------------------------------------------------------------


def _totals_sql(scope: str, table: str) -> str:
    return f"""select '{scope}' as analysis_scope, count(*) as transactions, cast(sum(fraud_label) as bigint) as fraud_transactions, cast(sum(fraud_label) as double) / count(*) as fraud_rate,
   cast(sum(cents) as double) / 100 as total_amount, cast(sum(fcents) as double) / 100 as fraud_amount, cast(sum(fcents) as double) / cast(sum(cents) as double) as fraud_amount_share,
   cast(sum(cents) as double) / (count(*) * 100.0::double) as avg_amount, cast(sum(fcents) as double) / (count(fcents) * 100.0::double) as avg_fraud_amount,
   median(amount) as median_amount, median(amount) filter (where fraud_label = 1) as median_fraud_amount from {table}"""


@query("AGG01_portfolio_summary", with_(TXN, _totals_sql("DEVELOPMENT_DISCOVERY", "dev") + " union all " + _totals_sql("FULL_HISTORY_DESCRIPTIVE", "base")))
def _(spark, sf):
    return P.portfolio_summary(T.model_splits(spark, sf), rows=T.row_bound(spark, sf))


_TREND = """count(*) as transactions, cast(sum(fraud_label) as bigint) as fraud_transactions, cast(sum(fraud_label) as double) / count(*) as fraud_rate, cast(sum(cents) as double) / 100 as total_amount,
 cast(sum(fcents) as double) / 100 as fraud_amount, cast(sum(fcents) as double) / nullif(cast(sum(cents) as double), 0) as fraud_amount_share"""


@query("AGG02_monthly_trend", with_(TXN, f"""select 'DEVELOPMENT_DISCOVERY' as analysis_scope, strftime(transaction_timestamp, '%Y-%m') as month, 'DEVELOPMENT' as split_name, {_TREND},
  (cast(sum(fraud_label) as double) / count(*)) / (select cast(sum(fraud_label) as double) / count(*) from dev) as fraud_lift_vs_development_baseline from dev group by 2"""))
def _(spark, sf):
    return P.monthly_trend(T.development(spark, sf))


@query("AGG03_yearly_trend", with_(TXN, f"select 'DEVELOPMENT_DISCOVERY' as analysis_scope, cast(transaction_year as int) as year, {_TREND} from dev group by 2"))
def _(spark, sf):
    return P.yearly_trend(T.development(spark, sf))


for _id, _kind in (("AGG05_channel_risk", "channel"), ("AGG06_amount_band_risk", "amount_band"), ("AGG07_mcc_risk", "mcc"), ("AGG08_state_risk", "state"), ("AGG09_merchant_city_risk", "merchant_city")):
    query(_id, with_(TXN, _risk_sql(_kind)))(lambda spark, sf, kind=_kind: P.segment_risk(T.development(spark, sf), kind))


@query("AGG10_interaction_risk", with_(TXN, f"""select 'DEVELOPMENT_DISCOVERY' as analysis_scope, 'channel_x_amount_band' as interaction_type, concat(c, ' × ', b) as segment_value, n as transactions, cast(n as double) / bn as transaction_share,
  f as fraud_transactions, cast(f as double) / n as fraud_rate, (cast(f as double) / n) / (cast(bf as double) / bn) as fraud_lift, cast(f as double) / bf as fraud_capture_share, case when n >= 1000 then 'SUFFICIENT' else 'LOW_SUPPORT' end as support_status
  from (select {unknown('use_chip')} as c, {BANDS} as b, count(*) as n, cast(sum(fraud_label) as bigint) as f from dev group by 1, 2) s, (select count(*) as bn, sum(fraud_label) as bf from dev) t"""))
def _(spark, sf):
    return P.interaction_risk(T.development(spark, sf))


@query("AGG11_amount_distribution", with_(TXN, """select 'DEVELOPMENT_DISCOVERY' as analysis_scope, case fraud_label when 1 then 'FRAUD_LABELED' else 'LEGITIMATE' end as label_group, round(median(amount), 6) as median_amount,
  round(quantile_cont(amount, 0.75), 6) as p75_amount, round(quantile_cont(amount, 0.90), 6) as p90_amount, round(quantile_cont(amount, 0.95), 6) as p95_amount, round(quantile_cont(amount, 0.99), 6) as p99_amount from dev group by 2"""))
def _(spark, sf):
    q = P.amount_distribution(T.development(spark, sf), rows=T.row_bound(spark, sf))
    return q.select("analysis_scope", "label_group", *[F.round(c, 6).alias(c) for c in q.columns if c.endswith("_amount")])


_ENTITY = {"USER": "cast(user_id as varchar)", "CARD": "card_key", "MERCHANT_IDENTIFIER": unknown("merchant_id_raw")}


@query("AGG12_entity_tables", with_(TXN, " union all ".join(
    f"select '{e}' as entity_type, {x} as entity_value, count(*) as transactions, cast(sum(fraud_label) as bigint) as fraud_transactions, cast(sum(cents) as double) / 100 as total_amount, cast(sum(fcents) as double) / 100 as fraud_amount from dev group by 2" for e, x in _ENTITY.items())))
def _(spark, sf):
    dev = T.development(spark, sf)
    out = None
    for e in P.ENTITIES:
        t = P.entity_table(dev, e).withColumn("entity_type", F.lit(e))
        out = t if out is None else out.unionByName(t)
    return out


def _conc_sql(e: str) -> str:
    return f"""select 'DEVELOPMENT_DISCOVERY' as analysis_scope, '{e}' as entity_type, max(k) as total_entities, count(*) filter (where f >= 1) as fraud_affected_entities, count(*) filter (where f >= 2) as repeat_fraud_entities,
   cast(max(af) as bigint) as entity_fraud_transactions, cast(sum(f) filter (where rk <= 10) as double) / max(af) as top_10_fraud_share, cast(sum(f) filter (where rk <= 100) as double) / max(af) as top_100_fraud_share,
   cast(sum(f) filter (where rk <= ceil(k * 0.01)) as double) / max(af) as top_1pct_fraud_share, cast(sum(f) filter (where rk <= ceil(k * 0.05)) as double) / max(af) as top_5pct_fraud_share,
   cast(sum(f * f) as double) / (cast(max(af) as double) * max(af)) as hhi_fraud_count
  from (select f, row_number() over (order by f desc, e) as rk, count(*) over () as k, sum(f) over () as af from (select {_ENTITY[e]} as e, cast(sum(fraud_label) as bigint) as f from dev group by 1) g) r"""


_CONC = " union all ".join(_conc_sql(e) for e in _ENTITY)


def _concentrations(spark, sf):
    dev = T.development(spark, sf)
    out = None
    for e in P.ENTITIES:
        t = P.concentration(dev, e)
        out = t if out is None else out.unionByName(t)
    return out


query("AGG13_concentration", with_(TXN, _CONC))(_concentrations)


@query("AGG14_rank_bands", with_(TXN, f", c as ({_CONC}) select analysis_scope, entity_type, unnest(['top_10','top_100','top_1pct','top_5pct']) as rank_band, unnest([top_10_fraud_share, top_100_fraud_share, top_1pct_fraud_share, top_5pct_fraud_share]) as fraud_capture_share from c"))
def _(spark, sf):
    return P.concentration_bands(_concentrations(spark, sf))


@query("AGG15_segment_priority", with_(TXN, _PRIO + " select * from prio"))
def _(spark, sf):
    return P.segment_priority(T.development(spark, sf))


@query("AGG16_split_stability", with_(TXN, """select 'SPLIT_STABILITY' as analysis_scope, split as split_name, count(*) as transactions, cast(sum(fraud_label) as bigint) as fraud_transactions, cast(sum(fraud_label) as double) / count(*) as fraud_rate,
  cast(sum(fcents) as double) / cast(sum(cents) as double) as fraud_amount_share, cast(count(*) filter (where lower(trim(use_chip)) = 'online transaction') as double) / count(*) as online_share,
  cast(count(*) filter (where lower(trim(use_chip)) = 'chip transaction') as double) / count(*) as chip_share, cast(count(*) filter (where lower(trim(use_chip)) = 'swipe transaction') as double) / count(*) as swipe_share from base group by 2"""))
def _(spark, sf):
    return P.split_stability(T.model_splits(spark, sf))


@query("AGG17_material_mcc", with_(TXN, _PRIO + f", m as ({_risk_sql('mcc')}) select m.*, p.priority_class from m join prio p using (segment_type, segment_value) where m.support_status = 'SUFFICIENT' order by m.fraud_lift desc, m.fraud_transactions desc, segment_type, segment_value limit 10"))
def _(spark, sf):
    return P.material_mcc(T.development(spark, sf))


@query("AGG17_material_states", with_(TXN, f", m as ({_risk_sql('state')}) select * from m where support_status = 'SUFFICIENT' order by fraud_capture_share desc, fraud_transactions desc, segment_type, segment_value limit 10"))
def _(spark, sf):
    return P.material_states(T.development(spark, sf))


@query("AGG17_priority_display", with_(TXN, _PRIO + " select * from prio where support_status = 'SUFFICIENT' order by case priority_class when 'PRIORITY_1' then 0 when 'PRIORITY_2' then 1 else 2 end, fraud_capture_share desc, segment_type, segment_value limit 12"))
def _(spark, sf):
    return P.priority_display(T.development(spark, sf))


@query("AGG18_channel_state_dependency", with_(TXN, "select coalesce(use_chip, '<NULL>') as channel, case when merchant_state is null then '<MISSING>' else '<PRESENT>' end as state_status, count(*) as transactions, cast(count(*) as double) / (select count(*) from base) as share from base group by 1, 2"))
def _(spark, sf):
    return P.channel_state_dependency(T.transactions(spark, sf))


# --- features -------------------------------------------------------------------------------------

# Square roots are compared to six digits, their quotients to nine.
_ROUNDED = [f for f in B.FEATURES if f.endswith(("_std", "_z")) or "_vs_" in f]


def _feature_query(name: str, features: list[str], extra: tuple[str, ...] = ()):
    digits = lambda f: 6 if f.endswith("_std") else 9
    shown = ", ".join([f"round({f}, {digits(f)}) as {f}" if f in _ROUNDED else f for f in features])
    tail = "".join(f", {e}" for e in extra)

    def run(spark, sf):
        cols = [F.round(f, digits(f)).alias(f) if f in _ROUNDED else F.col(f) for f in features]
        return T.mart(spark, sf).select("source_row_id", *cols, *extra)

    query(name, with_(MART, f"select source_row_id, {shown}{tail} from mart"))(run)


for _n, _e in (("WIN01_03_user_history", "user"), ("WIN04_06_card_history", "card"), ("WIN07_09_merchant_history", "merchant")):
    _feature_query(_n, [f"{_e}_prior_txn_count", f"{_e}_cold_start", f"{_e}_seconds_since_prev_txn", *[f"{_e}_txn_count_{s}" for s in B.COUNT_LOOKBACKS[_e]]])
_feature_query("WIN10_amount_velocity", [f for f in B.FEATURES if "positive_amount_sum" in f])
_feature_query("WIN11_amount_baseline", [f for f in B.FEATURES if "prior_positive_amount" in f])
_feature_query("WIN12_13_amount_deviation", [f for f in B.FEATURES if f.startswith("current_")])
_feature_query("WIN14_15_merchant_familiarity", [f for f in B.FEATURES if "_merchant_" in f])
_feature_query("WIN16_17_mcc_familiarity", [f for f in B.FEATURES if "_mcc_" in f])
_feature_query("WIN18_channel_familiarity", [f for f in B.FEATURES if "_channel_" in f])
_feature_query("WIN19_behavioral_mart", B.FEATURES, ("transaction_timestamp", "split_name", "user_id", "card_key", "amount", "current_positive_amount", "state_missing_flag", "fraud_label"))


@query("WIN20_graph_context_flags", with_(TXN, """select source_row_id, transaction_timestamp = min(transaction_timestamp) over (partition by card_key, merchant_id_raw) as pair_new,
  transaction_timestamp = min(transaction_timestamp) over (partition by card_key) as cold_card, transaction_timestamp = min(transaction_timestamp) over (partition by merchant_id_raw) as new_merchant from base"""))
def _(spark, sf):
    return T.scored(spark, sf).select("source_row_id", "pair_new", "cold_card", "new_merchant")


def events_view(spark, sf):
    """Events as transactions: microsecond times, so the sub-day lookbacks are not empty."""
    e = T.table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("source_row_id"), F.col("ts").alias("transaction_timestamp"), "user_id",
        F.concat_ws(":", "user_id", F.col("event_id") % 2).alias("card_key"), F.get_json_object("props", "$.k").alias("merchant_id_raw"),
        F.lit("5411").alias("merchant_category_code"), F.col("event_type").alias("use_chip"), F.lit(None).cast("string").alias("merchant_state"),
        F.round(F.col("value"), 2).alias("amount"))


@query("WIN02_08_event_velocity", """with e as (select event_id as source_row_id, ts as transaction_timestamp, user_id, concat(user_id, ':', event_id % 2) as card_key, json_extract_string(props, '$.k') as merchant_id_raw, event_type as use_chip, cast(round(round(value, 2) * 100) as bigint) as cents from events)
  select source_row_id, count(*) over (partition by user_id order by transaction_timestamp range between interval '1 hour' preceding and interval '1 microsecond' preceding) as user_txn_count_1h,
   count(*) over (partition by user_id order by transaction_timestamp range between interval '24 hours' preceding and interval '1 microsecond' preceding) as user_txn_count_24h,
   count(*) over (partition by card_key order by transaction_timestamp range between interval '7 days' preceding and interval '1 microsecond' preceding) as card_txn_count_7d,
   count(*) over (partition by merchant_id_raw order by transaction_timestamp range between interval '1 hour' preceding and interval '1 microsecond' preceding) as merchant_txn_count_1h,
   count(*) over (partition by merchant_id_raw order by transaction_timestamp range between interval '24 hours' preceding and interval '1 microsecond' preceding) as merchant_txn_count_24h,
   cast(date_diff('second', lag(transaction_timestamp) over (partition by user_id order by transaction_timestamp), transaction_timestamp) as bigint) as user_seconds_since_prev_txn,
   cast(coalesce(sum(case when cents > 0 then cents end) over (partition by user_id order by transaction_timestamp range between interval '7 days' preceding and interval '1 microsecond' preceding), 0) as double) / 100 as user_positive_amount_sum_7d,
   count(*) over (partition by user_id, use_chip order by transaction_timestamp range between unbounded preceding and interval '1 microsecond' preceding) as user_channel_prior_txn_count from e""")
def _(spark, sf):
    bound = T.table(spark, sf, "events").count()
    return B.behavior_features(events_view(spark, sf), rows=bound).select(
        "source_row_id", "user_txn_count_1h", "user_txn_count_24h", "card_txn_count_7d", "merchant_txn_count_1h", "merchant_txn_count_24h",
        "user_seconds_since_prev_txn", "user_positive_amount_sum_7d", "user_channel_prior_txn_count")


# --- profiling ------------------------------------------------------------------------------------


@query("PRO01_null_profile", with_(MART, " union all ".join(f"select '{f}' as feature_name, count(*) as row_count, count(*) - count({f}) as null_rows, cast(count(*) - count({f}) as double) / count(*) as null_rate from mart" for f in B.FEATURES)))
def _(spark, sf):
    return R.null_profile(T.mart(spark, sf))


@query("PRO02_distribution_profile", with_(MART, f", d as ({_DIST}) select feature_name, round(min_value, 9) as min_value, round(mean_value, 6) as mean_value, round(median_value, 9) as median_value, round(max_value, 9) as max_value from d"))
def _(spark, sf):
    p = R.distribution_profile(T.mart(spark, sf), rows=T.row_bound(spark, sf))
    return p.select("feature_name", *[F.round(c, 6 if c == "mean_value" else 9).alias(c) for c in ("min_value", "mean_value", "median_value", "max_value")])


_SUPPORT = "cast(1000 as int) as support_threshold, case when count(*) >= 1000 then 'INTERPRETABLE' else 'LOW_SUPPORT' end as support_status"
_RATE = "count(*) as transactions, cast(sum(fraud_label) as bigint) as fraud_transactions, cast(sum(fraud_label) as double) / count(*) as fraud_rate"


@query("PRO03_binary_signal", with_(MART, " union all ".join(f"select '{f}' as feature_name, cast({f} as int) as bin_order, cast({f} as varchar) as bin, cast({f} as varchar) as feature_value, {_RATE}, {_SUPPORT} from mart where split_name = 'DEVELOPMENT' group by {f}" for f in R.BINARY_SIGNALS)))
def _(spark, sf):
    return R.binary_signal(T.mart(spark, sf))


def _bin_sql(f: str) -> str:
    edges, labels, null_bin = R.bins_for(f)
    start = 1 if null_bin else 0
    cases = "".join(f" when {f} < {e} then {start + i}" for i, e in enumerate(edges))
    order = f"case when {f} is null then 0{cases} else {start + len(edges)} end"
    names = ", ".join("'" + n + "'" for n in (["NULL", *labels] if null_bin else labels))
    return f"""select '{f}' as feature_name, cast(o as int) as bin_order, [{names}][cast(o as int) + 1] as bin, cast(null as varchar) as feature_value, {_RATE}, {_SUPPORT}
      from (select {order} as o, fraud_label from mart where split_name = 'DEVELOPMENT') t group by o"""


@query("PRO04_numeric_signal", with_(MART, " union all ".join(_bin_sql(f) for f in R.NUMERIC_SIGNALS)))
def _(spark, sf):
    return R.numeric_signal(T.mart(spark, sf))


@query("PRO05_cold_start_profile", with_(MART, " union all ".join(f"select '{e}' as entity, cast({e}_cold_start as varchar) as cold_start, {_RATE} from mart group by 2" for e in ("user", "card", "merchant"))))
def _(spark, sf):
    return R.cold_start_profile(T.mart(spark, sf))


@query("PRO06_cardinality_profile", with_(TXN, " union all ".join(f"select '{k}' as field_name, count(distinct {k}) as distinct_values, count(*) - count({k}) as null_rows from base" for k in ("user_id", "card_key", "merchant_id_raw", "merchant_category_code", "use_chip"))))
def _(spark, sf):
    return R.cardinality_profile(T.transactions(spark, sf))


@query("PRO07_feature_dependency", with_(MART, """select 'user_history_to_card_history' as dependency, round(corr(user_prior_txn_count, card_prior_txn_count), 9) as metric_value, 'Descriptive structural check; not model importance.' as notes from mart
  union all select 'current_positive_to_user_mean_ratio', round(nullif(corr(case when current_positive_amount then 1 else 0 end, current_positive_amount_vs_user_mean), 'nan'::double), 9), 'NULL-aware exploratory dependency.' from mart"""))
def _(spark, sf):
    return R.feature_dependency(T.mart(spark, sf))


@query("PRO08_family_summary", with_(MART, ", l as (" + " union all ".join(f"select '{fam}' as feature_family, count({f}) as c from mart" for f, fam in B.FEATURE_FAMILIES.items()) + ") select feature_family, count(*) as feature_count, cast(sum(c) as bigint) as present_values from l group by 1"))
def _(spark, sf):
    return R.family_summary(T.mart(spark, sf))


@query("PRJ11_subgroup_labels", with_(MART, """select source_row_id, case use_chip when 'Online Transaction' then 'Online' when 'Swipe Transaction' then 'Swipe' when 'Chip Transaction' then 'Chip' else 'Other/Unknown' end as channel_group,
  if(card_cold_start = 1, 'cold_start_card', 'established_card') as card_history_group, if(card_merchant_is_new = 1, 'new_card_merchant', 'known_card_merchant') as relationship_group from mart"""))
def _(spark, sf):
    return readers.subgroups(T.mart(spark, sf)).select("source_row_id", "channel_group", "card_history_group", "relationship_group")
