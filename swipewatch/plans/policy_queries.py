"""Decision, economics, policy search and bootstrap queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.scale import stored
from ..operators import bootstrap as B
from ..operators import economics as E
from ..operators import policy as P
from ..operators import quality as Q
from ..operators import search as H
from ..sources import contracts as C
from ..sources import documents, readers
from . import tables as T
from .registry import SCORED, query, with_

REVIEW, BLOCK, CAPACITY = 0.55, 0.85, 0.10
DAY = "strftime(transaction_timestamp, '%Y-%m-%d')"


def features_only(spark, sf):
    return T.scored(spark, sf).drop("fraud_label")


def config(method: str, capacity: float = CAPACITY) -> P.PolicyConfig:
    return P.PolicyConfig(f"TEST_{method}", REVIEW, BLOCK, capacity, method)


def decided(spark, sf, method="EXPOSURE_WEIGHTED_RANK", calibrated=False, source=None, **options):
    features = features_only(spark, sf) if source is None else source.drop("fraud_label")
    return P.decide(features, config(method), calibrated, rows=T.row_bound(spark, sf), **options)


_EVALUATED = ("source_row_id", "transaction_timestamp", "risk_score", "positive_exposure", "fraud_label")


def scored_once(spark, sf, more=()):
    """Scored rows with what a queue that looks at no flag reads, and ``more``, written once: the decision reads them several times, and so do the labels."""
    return stored(T.scored(spark, sf, more).select(*_EVALUATED, *more))


def evaluated(spark, sf, method="EXPOSURE_WEIGHTED_RANK", scored=None):
    scored = scored_once(spark, sf) if scored is None else scored
    return E.join_labels(decided(spark, sf, method, source=scored), scored.select("source_row_id", "fraud_label"), rows=T.row_bound(spark, sf))


_FACTOR = " * ".join(f"(case when {f} then cast({w} as double) else cast(1 as double) end)" for f, w in P.GRAPH_WEIGHTS.items())
PRIORITY = {
    "SCORE_ONLY": "risk_score", "EXPOSURE_WEIGHTED_PROBABILITY": "risk_score * positive_exposure", "EXPOSURE_WEIGHTED_RANK": "pct * positive_exposure",
    "GRAPH_NOVELTY": f"risk_score * ({_FACTOR})", "AMOUNT_GRAPH": f"risk_score * positive_exposure * ({_FACTOR})"}


def decide_sql(method: str, review=REVIEW, block=BLOCK, capacity=CAPACITY, source="scored", name="dec", bucket=DAY, fixed=None, overflow="ALLOW", code="RC011") -> str:
    """Row-level policy in SQL: capacity from all rows of the bucket, rank among its candidates."""
    cap = f"cast({fixed} as bigint)" if fixed is not None else f"cast(floor(count(*) over (partition by {bucket}) * cast({capacity} as double)) as bigint)"
    exposure = method in P.EXPOSURE_METHODS
    graph = method in P.GRAPH_METHODS
    return f"""
{name}_c as (select *, {bucket} as capacity_bucket, {cap} as bucket_capacity, case when risk_score >= {block} then 'BLOCK' when risk_score >= {review} then 'REVIEW' else 'ALLOW' end as candidate_action from {source}),
{name}_p as (select *, (rank() over (partition by candidate_action order by risk_score) + (count(*) over (partition by candidate_action, risk_score) - 1) / cast(2 as double)) / count(*) over (partition by candidate_action) as pct from {name}_c),
{name}_r as (select *, case when candidate_action = 'REVIEW' then {PRIORITY[method]} end as review_priority from {name}_p),
{name}_k as (select *, case when candidate_action = 'REVIEW' then row_number() over (partition by capacity_bucket, candidate_action order by review_priority desc, risk_score desc, positive_exposure desc, transaction_timestamp, source_row_id) end as review_rank from {name}_r),
{name} as (select *, coalesce(review_rank <= bucket_capacity, false) as bucket_selected, candidate_action = 'REVIEW' and not coalesce(review_rank <= bucket_capacity, false) as overflow,
   case when candidate_action = 'REVIEW' and review_rank > bucket_capacity then '{overflow}' else candidate_action end as action,
   concat_ws(';', case candidate_action when 'BLOCK' then 'RC001' when 'REVIEW' then 'RC002' end, case when candidate_action = 'REVIEW' then (case when review_rank <= bucket_capacity then 'RC010' else '{code}' end) end,
     case when candidate_action = 'REVIEW' and {exposure} then 'RC003' end, case when candidate_action = 'REVIEW' and {graph} then 'RC012' end) as reason_codes from {name}_k)"""


SHOWN = ["source_row_id", "candidate_action", "action", "capacity_bucket", "review_priority", "review_rank", "bucket_capacity", "bucket_selected", "overflow", "reason_codes"]
STANDARD = SCORED + "," + decide_sql("EXPOSURE_WEIGHTED_RANK")

# --- input contracts --------------------------------------------------------------------------------


@query("SRC05_decision_input_aliases", with_(SCORED, "select source_row_id, risk_score, split_name, case channel when 'ONLINE' then 'ONLINE' when 'CHIP' then 'CHIP' when 'SWIPE' then 'SWIPE' else 'OTHER / UNKNOWN' end as channel from scored"))
def _(spark, sf):
    s = T.scored(spark, sf).select("source_row_id", F.col("risk_score").alias("PRIMARY_FRAUD_SCORE"), F.col("split_name").alias("split"), F.initcap("channel").alias("use_chip"))
    return readers.decision_input(s).select("source_row_id", "risk_score", "split_name", "channel")


@query("PRJ12_cold_start_segment", with_(SCORED, """select source_row_id, case when cold_card and new_merchant then 'BOTH_NODES_UNSEEN' when cold_card then 'NEW_CARD_ONLY' when new_merchant then 'NEW_MERCHANT_ONLY'
  when pair_new then 'WARM_PAIR_NEW' else 'WARM_PAIR_SEEN' end as cold_start_segment from scored"""))
def _(spark, sf):
    return T.scored(spark, sf).select("source_row_id", X.cold_start_segment("cold_card", "new_merchant", "pair_new").alias("cold_start_segment"))


@query("PRJ13_exposure_bases", with_(SCORED, "select source_row_id, amount as signed_amount, case when amount > 0 then amount else 0 end as positive_exposure, abs(amount) as absolute_exposure, case when amount > 0 then amount else 0 end as economic_exposure_proxy from scored"))
def _(spark, sf):
    return T.transactions(spark, sf).select(
        "source_row_id", F.col("amount").alias("signed_amount"), X.positive_part("amount").alias("positive_exposure"), F.abs("amount").alias("absolute_exposure"), X.positive_part("amount").alias("economic_exposure_proxy"))


@query("PRJ14_queue_buckets", """select event_id, strftime(ts, '%Y-%m-%d') as day_bucket, strftime(ts, '%Y-%m-%dT%H') as hour_bucket,
  concat(strftime(ts, '%Y-%m-%d'), 'T', case when hour(ts) < 8 then '00-08' when hour(ts) < 16 then '08-16' else '16-24' end) as shift_bucket,
  concat(strftime(date_trunc('week', ts), '%Y-%m-%d'), '/', strftime(date_trunc('week', ts) + interval 6 days, '%Y-%m-%d')) as week_bucket from events""")
def _(spark, sf):
    return T.table(spark, sf, "events").select("event_id", *[X.queue_bucket("ts", k).alias(f"{k.lower()}_bucket") for k in ("DAY", "HOUR", "SHIFT", "WEEK")])


@query("DQ15_score_gate", with_(SCORED, """select unnest(['P7T01_required_columns','P7T02_source_row_id_unique','P7T03_timestamp_parse','P7T04_score_finite','P7T05_score_range','P7T06_amount_finite','P7T07_split_values','P7T08_probability_status_explicit','P7T09_calibration_metadata']) as check_name,
  unnest([ 'PASS', if(count(*) = count(distinct source_row_id), 'PASS', 'FAIL'), if(count(*) = count(transaction_timestamp), 'PASS', 'FAIL'), if(count(*) = count(risk_score), 'PASS', 'FAIL'), if(bool_and(risk_score between 0 and 1), 'PASS', 'FAIL'), if(count(*) = count(amount), 'PASS', 'FAIL'), if(count(*) = count(split_name), 'PASS', 'FAIL'), 'PASS', 'PASS']) as status from scored"""))
def _(spark, sf):
    return C.score_gate(features_only(spark, sf), "RANKING_ONLY").select("check_name", "status")


@query("DQ15_gate_status", with_(SCORED, "select case when count(*) = count(distinct source_row_id) and bool_and(risk_score between 0 and 1) then 'INPUT_BLOCKED' end as gate_status, cast(9 as bigint) as checks from scored"))
def _(spark, sf):
    return C.gate_status(C.score_gate(features_only(spark, sf), "PROBABILITY_USABLE"))


@query("DQ16_policy_firewall", with_(SCORED, "select 'fraud_label' as forbidden_columns, 'REJECTED' as status, count(*) as rows from scored union all select '', 'ACCEPTED', count(*) from scored"))
def _(spark, sf):
    return C.firewall_report(T.scored(spark, sf), C.FORBIDDEN_POLICY).unionByName(C.firewall_report(features_only(spark, sf), C.FORBIDDEN_POLICY))


@query("DQ17_decision_contract", with_(SCORED, """select unnest(['risk_score_finite_in_unit_interval', 'amount_finite', 'source_row_id_present']) as rule, count(*) as rows_checked,
  unnest([count(*) filter (where risk_score is null or risk_score not between 0 and 1), count(*) filter (where amount is null), count(*) - count(source_row_id)]) as violations from scored"""))
def _(spark, sf):
    return C.decision_contract_violations(T.scored(spark, sf))


@query("DQ17_lenient_booleans", with_(SCORED, "select source_row_id, pair_new, cold_card from scored"))
def _(spark, sf):
    words = T.scored(spark, sf).select("source_row_id", F.when(F.col("pair_new"), " Yes").otherwise("0").alias("a"), F.when(F.col("cold_card"), "TRUE").otherwise("n").alias("b"))
    return words.select("source_row_id", C.lenient_boolean("a").alias("pair_new"), C.lenient_boolean("b").alias("cold_card"))


@query("DQ38_decision_input_reconciliation", with_(SCORED, """select unnest(['source_rows','unique_source_row_id','timestamp_parse','amount_finite','split_values','score_non_null','score_finite','score_range','tune_rows','confirm_rows','final_oot_rows','oot_not_globally_unseen']) as check_name,
  unnest([count(*), count(distinct source_row_id), 1, 1, 1, 1, 1, 1, count(*) filter (where split_name = 'DEVELOPMENT'), count(*) filter (where split_name = 'VALIDATION'), count(*) filter (where split_name = 'OUT_OF_TIME_OOT'), 1]) as value, 'PASS' as status from scored"""))
def _(spark, sf):
    from ..operators.splits import policy_scope

    s = T.scored(spark, sf).withColumn("_scope", policy_scope())
    ok = lambda c: F.min(F.when(c, 1).otherwise(0)).cast("long")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    scope = lambda v: F.count_if(F.col("_scope") == v)
    one = s.agg(
        F.count("*").alias("source_rows"), F.countDistinct("source_row_id").alias("unique_source_row_id"), ok(F.col("transaction_timestamp").isNotNull()).alias("timestamp_parse"),
        ok(finite("amount")).alias("amount_finite"), ok(F.col("split_name").isNotNull()).alias("split_values"), ok(F.col("risk_score").isNotNull()).alias("score_non_null"),
        ok(finite("risk_score")).alias("score_finite"), ok(F.coalesce(F.col("risk_score").between(0, 1), F.lit(False))).alias("score_range"),
        scope("P7_POLICY_TUNE").alias("tune_rows"), scope("P7_POLICY_CONFIRM").alias("confirm_rows"), scope("FINAL_OOT").alias("final_oot_rows"), F.lit(1).cast("long").alias("oot_not_globally_unseen"))
    good = {"unique_source_row_id": "unique_source_row_id = source_rows", "final_oot_rows": "final_oot_rows > 0"}
    good |= {c: f"{c} = 1" for c in ("timestamp_parse", "amount_finite", "split_values", "score_non_null", "score_finite", "score_range")}
    return Q.rows_from(one, ("check_name", "value", "status"), [(f"'{c}'", c, f"if({good.get(c, 'true')}, 'PASS', '{'REVIEW' if c == 'final_oot_rows' else 'FAIL'}')") for c in one.columns])


# --- decisions --------------------------------------------------------------------------------------


@query("POL01_candidate_actions", with_(STANDARD, "select source_row_id, candidate_action from dec"))
def _(spark, sf):
    return T.scored(spark, sf).select("source_row_id", P.candidate_action(REVIEW, BLOCK).alias("candidate_action"))


for _m in P.METHODS:
    def _run(spark, sf, m=_m):
        return decided(spark, sf, m, calibrated=True).select(*SHOWN)
    query(f"POL03_06_queue_{_m.lower()}", with_(SCORED + "," + decide_sql(_m), f"select {', '.join(SHOWN)} from dec"))(_run)


@query("POL04_graph_overlay", with_(SCORED, f"select source_row_id, risk_score * ({_FACTOR}) as overlay_priority from scored"))
def _(spark, sf):
    s = T.scored(spark, sf)
    return s.select("source_row_id", (F.col("risk_score") * P.graph_factor(s.columns, P.GRAPH_WEIGHTS)).alias("overlay_priority"))


@query("POL06_fixed_weekly_capacity", with_(SCORED + "," + decide_sql("SCORE_ONLY", fixed=3, bucket="concat(strftime(date_trunc('week', transaction_timestamp), '%Y-%m-%d'), '/', strftime(date_trunc('week', transaction_timestamp) + interval 6 days, '%Y-%m-%d'))"), f"select {', '.join(SHOWN)} from dec"))
def _(spark, sf):
    return decided(spark, sf, "SCORE_ONLY", queue=P.QueueConfig(bucket="WEEK", fixed_cases=3)).select(*SHOWN)


@query("POL07_overflow_to_review", with_(SCORED + "," + decide_sql("SCORE_ONLY", overflow="REVIEW"), f"select {', '.join(SHOWN)} from dec"))
def _(spark, sf):
    return decided(spark, sf, "SCORE_ONLY", queue=P.QueueConfig(overflow_action="REVIEW")).select(*SHOWN)


@query("POL09_full_reason_codes", with_(SCORED + "," + decide_sql("AMOUNT_GRAPH"), """select source_row_id, concat_ws(';', case candidate_action when 'BLOCK' then 'RC001' when 'REVIEW' then 'RC002' end, 'RC003', if(pair_new, 'RC004', null), if(cold_card, 'RC005', null), if(new_merchant, 'RC006', null),
  if(cross_community, 'RC007', null), if(channel = 'ONLINE', 'RC008', null), if(positive_exposure >= 90000, 'RC009', null), if(bucket_selected, 'RC010', null), if(overflow, 'RC011', null), if(candidate_action = 'REVIEW', 'RC012', null)) as codes from dec"""))
def _(spark, sf):
    d = decided(spark, sf, "AMOUNT_GRAPH", high_amount_cutoff=90000.0)
    return d.select("source_row_id", P.full_reason_codes(d.columns).alias("codes"))


@query("POL10_reason_summary", with_(STANDARD, "select code as reason_code, count(*) as rows from (select unnest(string_split(reason_codes, ';')) as code from dec) t where code <> '' group by 1"))
def _(spark, sf):
    return P.reason_summary(decided(spark, sf))


@query("SRC11_decision_trace", with_(STANDARD, """select source_row_id, candidate_action, action as final_action, nullif(split_part(reason_codes, ';', 1), '') as primary_reason_code,
  case when reason_codes like '%;%' then substr(reason_codes, strpos(reason_codes, ';') + 1) else '' end as secondary_reason_codes, 'EXPOSURE_WEIGHTED_RANK' as priority_method, 'S1' as score_version, cast(null as varchar) as calibration_version from dec"""))
def _(spark, sf):
    trace = P.decision_trace(decided(spark, sf), {"score_version": "S1", "policy_version": "P"})
    return trace.select("source_row_id", "candidate_action", "final_action", "primary_reason_code", "secondary_reason_codes", "priority_method", "score_version", "calibration_version")


@query("SRC10_decision_adapter", with_(STANDARD, """select capacity_bucket, count(*) filter (where candidate_action = 'REVIEW') as eligible_cases, count(*) filter (where bucket_selected) as selected_cases, count(*) filter (where overflow) as overflow_cases,
  max(bucket_capacity) as bucket_capacity, cast(count(*) filter (where bucket_selected) as double) / nullif(max(bucket_capacity), 0) as capacity_utilization, 'PASS' as status from dec group by 1"""))
def _(spark, sf):
    return C.capacity_reconciliation(C.adapt_decisions(decided(spark, sf)))


@query("POL13_comparators", with_(SCORED, """select 'allow_all' as policy, 'ALLOW' as action, count(*) as rows from scored union all select 'single_block', case when risk_score >= 0.8 then 'BLOCK' else 'ALLOW' end, count(*) from scored group by 2"""))
def _(spark, sf):
    s = T.scored(spark, sf)
    both = P.allow_all(s).select(F.lit("allow_all").alias("policy"), "action").unionByName(P.single_block(s, 0.8).select(F.lit("single_block").alias("policy"), "action"))
    return both.groupBy("policy", "action").agg(F.count("*").alias("rows"))


@query("POL14_action_reconciliation", with_(STANDARD, "select count(*) as transactions, count(*) filter (where action = 'ALLOW') as allow_count, count(*) filter (where action = 'REVIEW') as review_count, count(*) filter (where action = 'BLOCK') as block_count, cast(0 as bigint) as invalid_actions from dec"))
def _(spark, sf):
    return P.action_reconciliation(decided(spark, sf))


_EXPO = "cast(sum(cast(round(positive_exposure * 100) as bigint) * fraud_label) as double) / 100 as fraud_exposure"


@query("POL15_action_metrics", with_(STANDARD, f"select action, count(*) as rows, cast(sum(fraud_label) as bigint) as fraud_rows, {_EXPO} from dec group by 1"))
def _(spark, sf):
    return P.metrics_by(evaluated(spark, sf), ["action"])


@query("POL16_daily_action_metrics", with_(STANDARD, f"select cast(transaction_timestamp as date) as date, action, count(*) as rows, cast(sum(fraud_label) as bigint) as fraud_rows, {_EXPO} from dec group by 1, 2"))
def _(spark, sf):
    return P.metrics_by(evaluated(spark, sf), [F.to_date("transaction_timestamp").alias("date"), "action"])


@query("POL17_queue_diagnostics", with_(STANDARD, """,g as (select capacity_bucket, count(*) filter (where candidate_action = 'REVIEW') as c, count(*) filter (where bucket_selected) as s, max(bucket_capacity) as k from dec group by 1)
  select capacity_bucket, c as candidate_review_count, s as selected_review_count, k as bucket_capacity, coalesce(cast(s as double) / nullif(k, 0), 0) as queue_utilization, greatest(c - k, 0) as overflow_count,
   coalesce(cast(greatest(c - k, 0) as double) / nullif(c, 0), 0) as overflow_rate, s <= k as capacity_proxy_met from g"""))
def _(spark, sf):
    return P.queue_diagnostics(decided(spark, sf))


@query("POL18_shadow_transitions", with_(STANDARD, "select concat('ALLOW → ', action) as transition, count(*) as rows from dec group by 1"))
def _(spark, sf):
    return P.shadow_transitions(P.allow_all(features_only(spark, sf)), decided(spark, sf))


# --- economics --------------------------------------------------------------------------------------

MONEY = ("simulated_missed_fraud_cost", "simulated_review_cost", "simulated_false_block_cost", "simulated_total_cost")


def economics_sql(source: str, keys: str = "", a: E.Assumptions = E.Assumptions(), prevalence: float = 1.0) -> str:
    """Row-by-row cost model, the direct form of the closed sums."""
    lost = f"positive_exposure * {a.fraud_loss_fraction}::double * {prevalence}::double"
    friction = f"({a.false_block_fixed_friction_cost}::double + positive_exposure * {a.false_block_amount_friction_rate}::double)"
    missed = f"case when action = 'ALLOW' and y then {lost} else 0 end"
    blocked_fraud = f"case when action = 'BLOCK' and y then {lost} * (1 - {a.block_effectiveness}::double) else 0 end"
    blocked_legit = f"case when action = 'BLOCK' and not y then {friction} else 0 end"
    review = f"""case when action = 'REVIEW' then {a.review_cost_per_case + a.review_delay_cost}::double + (case when y then {lost} * (1 - {a.review_fraud_detection_rate}::double) else {a.review_legitimate_false_reject_rate}::double * {friction} end) else 0 end"""
    f = lambda cond: f"count(*) filter (where {cond})"
    c = lambda cond: f"cast(coalesce(sum(cast(round(positive_exposure * 100) as bigint)) filter (where {cond}), 0) as double)"
    share = lambda top, bottom: f"cast({top} as double) / nullif({bottom}, 0)"
    n = "count(*)"
    cols = [f"{n} as transactions", f"{f('y')} as fraud_rows"]
    for v in ("ALLOW", "REVIEW", "BLOCK"):
        cols += [f"""{f(f"action = '{v}'")} as {v.lower()}_count""", f"""coalesce({share(f(f"action = '{v}'"), n)}, 0) as {v.lower()}_rate"""]
    for v, name in (("ALLOW", "allowed"), ("REVIEW", "reviewed"), ("BLOCK", "blocked")):
        hit = f"y and action = '{v}'"
        cols += [f"{f(hit)} as fraud_{name}", f"{c(hit)} / 100 as {name}_fraud_exposure"]
    allowed, block_legit = "y and action = 'ALLOW'", "not y and action = 'BLOCK'"
    fx = c("y")
    cols += [
        f"1 - {share(f(allowed), f('y'))} as fraud_capture", f"""{share(f("y and action = 'REVIEW'"), f('y'))} as review_fraud_capture""", f"""{share(f("y and action = 'BLOCK'"), f('y'))} as block_fraud_capture""",
        f"""{f("not y and action = 'REVIEW'")} as legitimate_reviewed""", f"{f(block_legit)} as legitimate_blocked", f"coalesce({share(f(block_legit), f('not y'))}, 0) as legitimate_block_rate",
        f"""coalesce({share(f("not y and action <> 'ALLOW'"), n)}, 0) as legitimate_intervention_rate""", f"coalesce({share(f(block_legit), n)}, 0) as false_block_rate",
        f"{c('true')} / 100 as total_positive_exposure", f"{fx} / 100 as fraud_positive_exposure", f"1 - {c(allowed)} / nullif({fx}, 0) as fraud_exposure_capture",
        f"round(sum({missed}), 6) as simulated_missed_fraud_cost", f"round(sum({review}), 6) as simulated_review_cost", f"round(sum({blocked_legit}), 6) as simulated_false_block_cost",
        f"round(sum({missed} + {review} + {blocked_legit} + {blocked_fraud}), 6) as simulated_total_cost"]
    lead = f"{keys}, " if keys else ""
    tail = " group by all" if keys else ""
    return f"select {lead}{', '.join(cols)} from (select *, fraud_label = 1 as y from {source}) e{tail}"


def rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if c in MONEY else F.col(c) for c in df.columns])


@query("ECO01_economics", with_(STANDARD, economics_sql("dec")))
def _(spark, sf):
    return rounded(E.evaluate(evaluated(spark, sf)))


@query("POL12_evaluate_allow_all", with_(SCORED, economics_sql("(select *, 'ALLOW' as action from scored)")))
def _(spark, sf):
    s = T.scored(spark, sf)
    return rounded(E.evaluate(E.join_labels(P.allow_all(s), s.select("source_row_id", "fraud_label"))))


@query("ECO02_daily_economics", with_(STANDARD, economics_sql("dec", f"{DAY} as date")))
def _(spark, sf):
    return rounded(E.daily(evaluated(spark, sf)))


_SEG = """,seg as (select *, case when cold_card and new_merchant then 'BOTH_NODES_UNSEEN' when cold_card then 'NEW_CARD_ONLY' when new_merchant then 'NEW_MERCHANT_ONLY' when pair_new then 'WARM_PAIR_NEW' else 'WARM_PAIR_SEEN' end as css from dec),
 long as (select *, 'channel' as segment_type, channel as segment from seg union all select *, 'pair_seen', if(pair_new, 'True', 'False') from seg union all select *, 'cold_start', if(cold_card, 'True', 'False') from seg
  union all select *, 'merchant_novelty', if(new_merchant, 'True', 'False') from seg union all select *, 'cold_start_segment', css from seg) """


@query("ECO03_segment_economics", with_(STANDARD, _SEG + economics_sql("long", "segment_type, segment")))
def _(spark, sf):
    return rounded(E.by_segment(evaluated(spark, sf, scored=scored_once(spark, sf, ("channel", "pair_new", "cold_card", "new_merchant")))))


# --- search -----------------------------------------------------------------------------------------

_Q = ", ".join(str(q) for q in H.SCORE_QUANTILES)
DEV_SCORED = SCORED + ",tune as (select * from scored where split_name = 'DEVELOPMENT'), confirm as (select * from scored where split_name = 'VALIDATION')"


def tune(spark, sf):
    return T.scored(spark, sf, splits=("DEVELOPMENT",))


def confirm(spark, sf):
    return T.scored(spark, sf, splits=("VALIDATION",))


@query("ECO04_quantile_thresholds", with_(DEV_SCORED, f"select distinct round(q, 10) as threshold from (select unnest(quantile_cont(risk_score, [{_Q}])) as q from tune) t"))
def _(spark, sf):
    return H.threshold_table(tune(spark, sf), rows=T.row_bound(spark, sf))


@query("ECO05_high_amount_cutoff", with_(DEV_SCORED, "select round(quantile_cont(positive_exposure, 0.9), 6) as high_amount_cutoff from tune"))
def _(spark, sf):
    return H.high_amount_cutoff(tune(spark, sf), rows=T.row_bound(spark, sf)).select(F.round("high_amount_cutoff", 6).alias("high_amount_cutoff"))


# Fixed thresholds and wide capacities, so that the grid has feasible and infeasible entries.
GRID_THRESHOLDS = (0.40, 0.50, 0.55, 0.65, 0.80)
GRID_CAPACITIES = (0.01, 0.05)


def grid(spark, sf, capacities=GRID_CAPACITIES):
    """The grid reads the rows of Validation several times, so they are written once."""
    return H.policy_grid(stored(confirm(spark, sf)), GRID_THRESHOLDS, capacities, rows=T.row_bound(spark, sf))


def grid_sql(capacities=GRID_CAPACITIES) -> str:
    ctes, parts = [], []
    tried = [(r, b, c, *kind) for r in GRID_THRESHOLDS for b in GRID_THRESHOLDS if r < b for c in capacities for kind in (
        ("P2", "SCORE_ONLY", ""), ("P3", "SCORE_ONLY", "_c"), ("P4", "EXPOSURE_WEIGHTED_RANK", "_c_m"), ("P4", "SCORE_ONLY", "_c_m"), ("P5", "GRAPH_NOVELTY", "_c_m"), ("P5", "AMOUNT_GRAPH", "_c_m"))]
    for i, (r, b, c, variant, method, tail) in enumerate(tried):
        version = f"PART7_{variant}_{r:.6f}_{b:.6f}" + {"": "", "_c": f"_{c:.4f}", "_c_m": f"_{c:.4f}_{method}"}[tail]
        c = 1.0 if variant == "P2" else c
        ctes.append(decide_sql(method, r, b, c, "confirm", f"d{i}"))
        keys = f"cast({i} as int) as policy, '{variant}' as variant, '{version}' as policy_version, '{method}' as priority_method, cast({r} as double) as review_threshold, cast({b} as double) as block_threshold, cast({c} as double) as review_capacity, true as feasible"
        parts.append(economics_sql(f"d{i}", keys))
    zero = "cast(-1 as int) as policy, 'P0' as variant, 'PART7_P0_ALLOW_ALL' as policy_version, 'SCORE_ONLY' as priority_method, cast(null as double) as review_threshold, cast(null as double) as block_threshold, cast(0 as double) as review_capacity, true as feasible"
    parts.append(economics_sql("(select *, 'ALLOW' as action from confirm)", zero))
    return DEV_SCORED + "," + ",".join(ctes) + ", grid as (" + " union all ".join(parts) + ")"


GRID = grid_sql()


@query("ECO06_policy_grid", with_(GRID, "select * from grid"))
def _(spark, sf):
    return rounded(grid(spark, sf))


_ORDER = {
    "growth": ("legitimate_intervention_rate, simulated_total_cost, review_rate, block_rate, policy", " and priority_method in ('SCORE_ONLY','GRAPH_NOVELTY')"),
    "balanced": ("simulated_total_cost, legitimate_block_rate, review_rate, fraud_exposure_capture desc, policy", ""),
    "conservative": ("fraud_exposure_capture desc, fraud_capture desc, simulated_total_cost, policy", "")}


@query("ECO07_08_profile_selection", with_(GRID, " union all ".join(
    f"(select *, '{n}' as profile from grid where review_rate <= {p.max_review_rate} and block_rate <= {p.max_block_rate} and legitimate_block_rate <= {p.max_legitimate_block_rate}{_ORDER[n][1]} order by {_ORDER[n][0]} limit 1)" for n, p in H.PROFILES.items())))
def _(spark, sf):
    return H.compare_profiles(rounded(grid(spark, sf)))


_FRONT = """front as (select * from grid g where not exists (select 1 from grid o where o.simulated_total_cost <= g.simulated_total_cost and o.fraud_capture >= g.fraud_capture and o.legitimate_intervention_rate <= g.legitimate_intervention_rate
  and (o.simulated_total_cost < g.simulated_total_cost or o.fraud_capture > g.fraud_capture or o.legitimate_intervention_rate < g.legitimate_intervention_rate)))"""


@query("ECO09_nondominated", with_(GRID, f", {_FRONT} select policy, policy_version, simulated_total_cost, fraud_capture, legitimate_intervention_rate, true as non_dominated from front"))
def _(spark, sf):
    return H.nondominated(rounded(grid(spark, sf))).select("policy", "policy_version", "simulated_total_cost", "fraud_capture", "legitimate_intervention_rate", "non_dominated")


@query("ECO10_frontier", with_(GRID, f""", {_FRONT} select policy_version, 'legitimate_intervention_rate' as x_metric, 'fraud_capture' as y_metric, legitimate_intervention_rate as value_x, fraud_capture as value_y, true as non_dominated from front
  union all select policy_version, 'review_rate', 'fraud_exposure_capture', review_rate, fraud_exposure_capture, true from front union all select policy_version, 'simulated_total_cost', 'fraud_capture', simulated_total_cost, fraud_capture, true from front"""))
def _(spark, sf):
    return H.frontier(rounded(grid(spark, sf)))


@query("ECO11_marginal_review_value", with_(GRID, """, p3 as (select *, row_number() over (order by review_capacity, fraud_capture desc, policy) as rn from grid where variant = 'P3')
  select a.policy_version, a.review_capacity, a.review_count, a.review_count - b.review_count as incremental_reviews, coalesce(a.fraud_blocked - b.fraud_blocked, 0) + coalesce(a.fraud_reviewed - b.fraud_reviewed, 0) as incremental_fraud,
   cast(coalesce(a.fraud_blocked - b.fraud_blocked, 0) + coalesce(a.fraud_reviewed - b.fraud_reviewed, 0) as double) / nullif(a.review_count - b.review_count, 0) * 1000 as fraud_per_1000_incremental_reviews from p3 a left join p3 b on b.rn = a.rn - 1"""))
def _(spark, sf):
    return H.marginal_review_value(grid(spark, sf)).select("policy_version", "review_capacity", "review_count", "incremental_reviews", "incremental_fraud", "fraud_per_1000_incremental_reviews")


@query("ECO12_amount_and_graph_subsets", with_(GRID, "select 'amount_aware' as subset, policy_version, fraud_capture from grid where variant = 'P4' union all select 'graph_review', policy_version, fraud_capture from grid where variant = 'P5'"))
def _(spark, sf):
    g = grid(spark, sf)
    pick = lambda name, t: t.select(F.lit(name).alias("subset"), "policy_version", "fraud_capture")
    return pick("amount_aware", H.amount_aware(g)).unionByName(pick("graph_review", H.graph_review(g)))


@query("ECO15_stability_matrix", with_(GRID, "select 'BASE_P7_POLICY_CONFIRM' as scenario_id, 'PART7_ECONOMICS_v1.0' as assumption_hash, review_capacity, policy_version, review_threshold, block_threshold, allow_rate, review_rate, block_rate, fraud_capture, fraud_exposure_capture, legitimate_block_rate, simulated_total_cost from grid"))
def _(spark, sf):
    return H.stability_matrix(rounded(grid(spark, sf)))


def _capacity_sql() -> str:
    ctes = [decide_sql("SCORE_ONLY", REVIEW, BLOCK, c, "confirm", f"k{i}") for i, c in enumerate(H.CAPACITY_GRID)]
    parts = [f"select cast({c} as double) as review_capacity, count(*) filter (where action = 'REVIEW') as review_count, count(*) filter (where action = 'REVIEW' and fraud_label = 1) as fraud_reviewed from k{i}" for i, c in enumerate(H.CAPACITY_GRID)]
    return with_(DEV_SCORED + "," + ",".join(ctes), " union all ".join(parts))


@query("ECO16_capacity_scenarios", _capacity_sql())
def _(spark, sf):
    g = H.policy_grid(confirm(spark, sf), (REVIEW, BLOCK), H.CAPACITY_GRID, rows=T.row_bound(spark, sf))
    return g.where("variant = 'P3'").select("review_capacity", "review_count", "fraud_reviewed")


_BASE = E.Assumptions()


def _sensitivity_sql() -> str:
    ctes = [decide_sql("SCORE_ONLY", REVIEW, BLOCK, c, "confirm", f"s{i}") for i, c in enumerate((CAPACITY, 0.005, 0.01))]
    parts = [economics_sql("s0", f"'{n}' as scenario_id", a, w) for n, (a, w) in E.scenarios(_BASE).items()]
    parts += [economics_sql(f"s{i}", f"'CAPACITY_{c:.4f}' as scenario_id") for i, c in ((1, 0.005), (2, 0.01))]
    return with_(DEV_SCORED + "," + ",".join(ctes) + ", u as (" + " union all ".join(parts) + ")", f"select scenario_id, {', '.join(H.SENSITIVITY_METRICS)} from u")


@query("ECO13_sensitivity", _sensitivity_sql())
def _(spark, sf):
    return rounded(H.sensitivity(confirm(spark, sf), config("SCORE_ONLY"), rows=T.row_bound(spark, sf)))


@query("POL19_metric_delta", with_(STANDARD, f""", c as ({economics_sql('dec')}), b as ({economics_sql("(select *, 'ALLOW' as action from scored)")})
  select unnest(['simulated_total_cost', 'fraud_capture', 'fraud_exposure_capture', 'review_rate', 'legitimate_block_rate']) as metric, unnest([b.simulated_total_cost, b.fraud_capture, b.fraud_exposure_capture, b.review_rate, b.legitimate_block_rate]) as baseline,
   unnest([c.simulated_total_cost, c.fraud_capture, c.fraud_exposure_capture, c.review_rate, c.legitimate_block_rate]) as challenger,
   unnest([c.simulated_total_cost - b.simulated_total_cost, c.fraud_capture - b.fraud_capture, c.fraud_exposure_capture - b.fraud_exposure_capture, c.review_rate - b.review_rate, c.legitimate_block_rate - b.legitimate_block_rate]) as delta from b, c"""))
def _(spark, sf):
    s = scored_once(spark, sf)
    base = E.evaluate(s.withColumn("action", F.lit("ALLOW")))
    return H.metric_delta(rounded(E.evaluate(evaluated(spark, sf, scored=s))), rounded(base))


FROZEN = {"policy_version": "FROZEN", "review_threshold": REVIEW, "block_threshold": BLOCK, "review_capacity": CAPACITY, "priority_method": "GRAPH_NOVELTY"}


@query("POL20_frozen_replay", with_(SCORED + ",oot as (select * from scored where split_name = 'OUT_OF_TIME_OOT')," + decide_sql("GRAPH_NOVELTY", source="oot"), economics_sql("dec")))
def _(spark, sf):
    oot = T.scored(spark, sf).where("split_name = 'OUT_OF_TIME_OOT'")
    actions = P.replay(oot, FROZEN, rows=T.row_bound(spark, sf))
    return rounded(E.evaluate(E.join_labels(actions, oot.select("source_row_id", "fraud_label"))))


# --- bootstrap --------------------------------------------------------------------------------------


def _boot_sides(spark, sf):
    c = confirm(spark, sf)
    champion = E.join_labels(P.decide(c.drop("fraud_label"), config("SCORE_ONLY"), rows=T.row_bound(spark, sf)), c.select("source_row_id", "fraud_label"))
    return champion, c.withColumn("action", F.lit("ALLOW"))


_WEEK = "concat(strftime(date_trunc('week', transaction_timestamp), '%Y-%m-%d'), '/', strftime(date_trunc('week', transaction_timestamp) + interval 6 days, '%Y-%m-%d'))"


@query("ECO14_weekly_statistics", with_(DEV_SCORED + "," + decide_sql("SCORE_ONLY", source="confirm"), f""", e as ({economics_sql('dec', f'{_WEEK} as week')}) select week, transactions as rows, fraud_rows as fraud, transactions - fraud_rows as legit, simulated_total_cost as cost,
  fraud_allowed as allowed_fraud, allowed_fraud_exposure, fraud_positive_exposure as fraud_exposure, legitimate_reviewed + legitimate_blocked as legit_touched, legitimate_blocked as legit_blocked, review_count as reviewed from e"""))
def _(spark, sf):
    return B.weekly_stats(_boot_sides(spark, sf)[0]).withColumn("cost", F.round("cost", 6))


def _side_sql(side: str, source: str) -> str:
    parts = {"rows": "transactions", "fraud": "fraud_rows", "legit": "transactions - fraud_rows", "cost": "simulated_total_cost", "allowed_fraud": "fraud_allowed", "allowed_fraud_exposure": "allowed_fraud_exposure",
             "fraud_exposure": "fraud_positive_exposure", "legit_touched": "legitimate_reviewed + legitimate_blocked", "legit_blocked": "legitimate_blocked", "reviewed": "review_count"}
    return f"{side}w as (select week, {', '.join(f'{v} as {side}_{k}' for k, v in parts.items())} from ({economics_sql(source, f'{_WEEK} as week')}) e)"


_RATES = {"delta_cost": "{s}_cost", "delta_capture": "coalesce(({s}_fraud - {s}_allowed_fraud) / nullif({s}_fraud, 0), 0)", "delta_exposure_capture": "coalesce(({s}_fraud_exposure - {s}_allowed_fraud_exposure) / nullif({s}_fraud_exposure, 0), 0)",
          "delta_legitimate_block_rate": "coalesce({s}_legit_blocked / nullif({s}_legit, 0), 0)", "delta_review_rate": "coalesce({s}_reviewed / nullif({s}_rows, 0), 0)", "delta_legitimate_intervention": "coalesce({s}_legit_touched / nullif({s}_rows, 0), 0)"}


@query("ECO14_bootstrap_intervals", with_(DEV_SCORED + "," + decide_sql("SCORE_ONLY", source="confirm") + ", " + _side_sql("a", "dec") + ", " + _side_sql("b", "(select *, 'ALLOW' as action from confirm)") + f""",
 weeks as (select *, row_number() over (order by week) - 1 as position, count(*) over () as n from aw join bw using (week)),
 picks as (select draw, cast(concat('0x', substr(md5(concat({B.SEED}, ':', draw, ':', place)), 1, 15)) as bigint) % n as position from range(1000) d(draw), (select distinct n from weeks) s, lateral unnest(range(n)) p(place)),
 sums as (select draw, {', '.join(f'sum(cast({s}_{n} as double)) as {s}_{n}' for s in "ab" for n in B.STATS)} from picks join weeks using (position) group by draw),
 deltas as (select unnest([{', '.join(f"'{d}'" for d in B.DELTAS)}]) as metric, unnest([{', '.join(f"{_RATES[d].format(s='b')} - {_RATES[d].format(s='a')}" for d in B.DELTAS)}]) as v from sums)""", f"""
 select metric, count(*) as draws, round(avg(v), 6) as estimate, round(quantile_cont(v, 0.025), 6) as ci_lower, round(quantile_cont(v, 0.975), 6) as ci_upper, 'weekly_paired_block_bootstrap' as method, {B.SEED} as seed, 'PASS' as status from deltas group by metric"""))
def _(spark, sf):
    t = B.weekly_paired_bootstrap(*_boot_sides(spark, sf), draws=1000)
    return t.withColumns({c: F.round(c, 6) for c in ("estimate", "ci_lower", "ci_upper")})


# --- configuration documents ------------------------------------------------------------------------
# Documents written from customers' keys, many of them broken in one way or several.

_METHODS6 = [*P.METHODS, "BEST_GUESS"]
_K = "c_custkey"


def _policy_texts(spark, sf):
    """JSON for even keys, YAML for odd ones."""
    parts = {
        "policy_version": f"if({_K} % 17 = 0, '\"\"', concat('\"P', {_K}, '\"'))", "review_threshold": f"if({_K} % 23 = 0, null, string({_K} % 7 / 10))", "block_threshold": f"if({_K} % 29 = 0, '\"high\"', string({_K} % 11 / 10))",
        "review_capacity": f"string({_K} % 13 / 10)", "priority_method": f"concat('\"', element_at(array({', '.join(repr(m) for m in _METHODS6)}), int({_K} % 6) + 1), '\"')"}
    entries = "filter(array(" + ", ".join(f"concat('{q}{n}{q}: ', {v})" for n, v in parts.items() for q in ['{q}']) + "), x -> x is not null)"
    json = f"if({_K} % 19 = 0, concat('{{ broken ', {_K}), concat('{{', array_join({entries.replace('{q}', chr(34))}, ', '), '}}'))"
    yaml = f"if({_K} % 19 = 0, 'a: b: {{', concat('# a policy', char(10), array_join({entries.replace('{q}', '')}, char(10))))"
    customers = spark.read.parquet(f"{sf}/customer.parquet")
    texts = customers.selectExpr(f"{_K} as document", f"if({_K} % 2 = 0, {json}, {yaml}) as text")
    return texts.where("document % 2 = 0").unionByName(documents.yaml_to_json(texts.where("document % 2 = 1")))


_NUMBERS_OK = f"{_K} % 23 <> 0 and {_K} % 29 <> 0"
_POLICY_RULES = {documents.HAS_VERSION: f"{_K} % 17 <> 0", documents.NUMBERS: _NUMBERS_OK, documents.ORDERED: f"not ({_NUMBERS_OK}) or ({_K} % 7 < {_K} % 11 and {_K} % 11 <= 10)", documents.SHARE: f"{_K} % 13 <= 10", documents.METHOD: f"{_K} % 6 <> 5"}


@query("POL02_policy_documents", f"select {_K} as document, '{documents.ONE_OBJECT}' as rule from customer where {_K} % 19 = 0 " + " ".join(f"union all select {_K}, '{n}' from customer where {_K} % 19 <> 0 and not ({c})" for n, c in _POLICY_RULES.items()))
def _(spark, sf):
    """Every broken rule of every policy document."""
    return documents.broken_rules(documents.policy_documents(_policy_texts(spark, sf)))


@query("POL02_policies", f"select {_K} as document, 'P' || {_K} as policy_version, cast({_K} % 7 as double) / 10 as review_threshold, cast({_K} % 11 as double) / 10 as block_threshold, cast({_K} % 13 as double) / 10 as review_capacity, {_METHODS6}[cast({_K} % 6 as int) + 1] as priority_method from customer where {_K} % 19 <> 0 and " + " and ".join(f"({c})" for c in _POLICY_RULES.values()))
def _(spark, sf):
    """The typed policies of the documents that keep all rules."""
    return documents.policy_documents(_policy_texts(spark, sf)).where(F.size("broken") == 0).drop("broken")


def _weight_texts(spark, sf):
    spec = lambda enabled, weight: f"concat('{{', array_join(filter(array({enabled}, {weight}), x -> x is not null), ', '), '}}')"
    first = spec(f"if({_K} % 19 = 0, null, '\"enabled\": true')", f"if({_K} % 17 = 0, null, concat('\"weight\": ', {_K} % 7))")
    second = spec(f"concat('\"enabled\": ', if({_K} % 3 = 0, 'false', 'true'))", "'\"weight\": 1.5'")
    name = f"if({_K} % 13 = 0, 'lucky_star', 'cold_card')"
    priority = f"if({_K} % 11 = 0, '{{}}', concat('{{\"pair_new\": ', {first}, ', \"', {name}, '\": ', {second}, '}}'))"
    text = f"if({_K} % 29 = 0, '[1, 2]', concat('{{\"automatic_block_override\": {{\"enabled\": ', if({_K} % 10 = 0, 'true', 'false'), '}}, \"review_priority\": ', {priority}, '}}'))"
    return spark.read.parquet(f"{sf}/customer.parquet").selectExpr(f"{_K} as document", f"{text} as text")


_SOME = f"{_K} % 11 <> 0"
_WEIGHT_RULES = {documents.NO_OVERRIDE: f"{_K} % 10 <> 0", documents.SOME_WEIGHTS: _SOME, documents.KNOWN_FIELDS: f"not ({_SOME}) or {_K} % 13 <> 0", documents.DECLARED: f"not ({_SOME}) or ({_K} % 19 <> 0 and {_K} % 17 <> 0)", documents.POSITIVE: f"not ({_SOME}) or {_K} % 17 = 0 or {_K} % 7 > 0"}


@query("POL05_weight_documents", f"select {_K} as document, '{documents.ONE_OBJECT}' as rule from customer where {_K} % 29 = 0 " + " ".join(f"union all select {_K}, '{n}' from customer where {_K} % 29 <> 0 and not ({c})" for n, c in _WEIGHT_RULES.items()))
def _(spark, sf):
    return documents.broken_rules(documents.weight_documents(_weight_texts(spark, sf)))


@query("POL05_weights", f"select {_K} as document, cast({_K} % 7 as double) as pair_new, case when {_K} % 3 <> 0 then 1.5::double end as cold_card from customer where {_K} % 29 <> 0 and " + " and ".join(f"({c})" for c in _WEIGHT_RULES.values()))
def _(spark, sf):
    """The enabled weights of the documents that keep all rules."""
    fine = documents.weight_documents(_weight_texts(spark, sf)).where(F.size("broken") == 0)
    return fine.select("document", F.element_at("weights", "pair_new").alias("pair_new"), F.element_at("weights", "cold_card").alias("cold_card"))
