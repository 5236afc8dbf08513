"""Monitoring, drift and alert queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.scale import dealt, stored
from ..operators import drift as D
from ..operators import monitor as N
from ..operators import quality as Q
from ..operators import splits as S
from ..sources import contracts as C
from ..sources import readers
from . import tables as T
from .policy_queries import decide_sql, decided, scored_once
from .registry import ORACLES, SCORED, query, with_

MON = SCORED + "," + decide_sql("SCORE_ONLY") + """,
mon as (select *, merchant_category_code as MCC, bucket_selected as review_selected, overflow as review_overflow, capacity_bucket as review_capacity_bucket,
  concat('D-', strftime(transaction_timestamp, '%Y-%m-%d')) as operational_window_id,
  concat('W-', strftime(date_trunc('week', transaction_timestamp), '%Y-%m-%d'), '_', strftime(date_trunc('week', transaction_timestamp) + interval 6 days, '%Y-%m-%d')) as drift_window_id,
  concat('M-', strftime(transaction_timestamp, '%Y-%m')) as performance_window_id from dec),
ref as (select * from mon where split_name = 'VALIDATION'), cur as (select * from mon where split_name = 'OUT_OF_TIME_OOT')"""


def adapted(spark, sf, source=None):
    return C.adapt_decisions(decided(spark, sf, "SCORE_ONLY", source=source).withColumnRenamed("merchant_category_code", "MCC"))


def placed(d):
    """Adapted rows with their windows and versions."""
    return N.assign_windows(d).withColumns({"policy_version": F.lit("P1"), "graph_version": F.lit("G1")})


def monitored(spark, sf):
    """Decided rows in the monitoring contract, without labels."""
    return placed(adapted(spark, sf))


_QUEUE = ("operational_window_id", "review_capacity_bucket", "candidate_action", "action", "review_selected", "review_overflow", "bucket_capacity", "risk_score", "positive_exposure")


def reviewed(spark, sf):
    """Monitored rows with what a review monitor reads, written once; the decision reads scored rows that are written once."""
    return stored(placed(adapted(spark, sf, scored_once(spark, sf))).select(*_QUEUE))


def scored_windows(spark, sf, columns=None, splits=()):
    return N.assign_windows(T.scored(spark, sf, columns, splits).withColumnRenamed("merchant_category_code", "MCC"))


_COMPARED = (S.VALIDATION, S.OUT_OF_TIME)


def both(spark, sf, columns):
    """Reference and observed rows with ``columns``, written once because both are read several times. Development rows are read only if they
    are the reference."""
    made = lambda splits: stored(scored_windows(spark, sf, columns, splits).select("split_name", *columns))
    s = made(_COMPARED)
    if s.where(S.is_reference()).isEmpty():
        s = made(())
    return S.reference_rows(s), S.observation_rows(s)


def bound(spark, sf):
    return {"rows": T.row_bound(spark, sf)}


def rounded(df, *names, digits=9):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


# --- inputs and contracts ---------------------------------------------------------------------------


@query("SRC06_monitoring_input_aliases", with_(SCORED, "select source_row_id, transaction_timestamp, risk_score, split_name, case when amount > 0 then amount else 0 end as positive_exposure, case when risk_score >= 0.5 then 'REVIEW' else 'ALLOW' end as action from scored"))
def _(spark, sf):
    s = T.scored(spark, sf).select(
        "source_row_id", F.date_format("transaction_timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("risk_score").alias("score"), F.col("split_name").alias("split"), "amount",
        F.when(F.col("risk_score") >= 0.5, "review").otherwise("Allow").alias("action"))
    m = readers.monitoring_input(s)
    return m.select("source_row_id", F.col("transaction_timestamp").cast("timestamp_ntz").alias("transaction_timestamp"), "risk_score", "split_name", "positive_exposure", "action")


@query("PRJ15_monitoring_windows", with_(MON, "select source_row_id, operational_window_id, drift_window_id, performance_window_id from mon"))
def _(spark, sf):
    return scored_windows(spark, sf).select("source_row_id", "operational_window_id", "drift_window_id", "performance_window_id")


_BANDS = "case when amount <= 25 then 'LOW' when amount <= 100 then 'MEDIUM' when amount <= 500 then 'HIGH' else 'VERY_HIGH' end as amount_band, case when risk_score <= 0.2 then 'LOW' when risk_score <= 0.5 then 'MEDIUM' when risk_score <= 0.8 then 'HIGH' else 'VERY_HIGH' end as risk_band"


@query("PRJ16_segment_columns", with_(SCORED, f"select source_row_id, {_BANDS}, cold_card as cold_start from scored"))
def _(spark, sf):
    return N.add_segment_columns(T.scored(spark, sf)).select("source_row_id", "amount_band", "risk_band", "cold_start")


@query("PRJ18_category_coercion", with_(SCORED.replace("select source_row_id, transaction_timestamp, split as", "select merchant_state, source_row_id, transaction_timestamp, split as"), "select source_row_id, coalesce(merchant_state, '__NULL__') as category from scored"))
def _(spark, sf):
    return T.transactions(spark, sf).select("source_row_id", X.category("merchant_state").alias("category"))


@query("DQ18_label_views", with_(SCORED, "select 'RETROSPECTIVE_MATURED' as label_mode, 'RETROSPECTIVE_MATURED' as label_claim_class, count(*) as rows from scored union all select 'SIMULATED_DELAY', 'SIMULATED', count(*) from scored"))
def _(spark, sf):
    s = T.scored(spark, sf)
    views = C.matured_view(s).unionByName(C.matured_view(s, "SIMULATED_DELAY"))
    return views.groupBy("label_mode", "label_claim_class").agg(F.count("*").alias("rows"))


_RULES = "unnest(['source_row_id_unique_non_null','transaction_timestamp_parseable','amount_finite','risk_score_in_unit_interval','action_domain']) as rule"


@query("DQ19_monitoring_contract", with_(MON, f"select {_RULES}, count(*) as rows_checked, unnest([count(*) - count(distinct source_row_id), count(*) - count(transaction_timestamp), count(*) - count(amount), count(*) filter (where risk_score not between 0 and 1), count(*) filter (where action not in ('ALLOW','REVIEW','BLOCK'))]) as violations, 'PASS' as status from mon"))
def _(spark, sf):
    return C.monitoring_contract(monitored(spark, sf))


@query("DQ20_schema_check", with_(SCORED, "select 'PASS' as status, '' as missing_columns, cast(5 as int) as required_columns, count(*) as rows from scored union all select 'FAIL', 'risk_score,split_name', 5, count(*) from scored"))
def _(spark, sf):
    s = T.scored(spark, sf)
    return C.schema_check(s).unionByName(C.schema_check(s.drop("risk_score", "split_name")))


_QP_COLS = ["source_row_id", "transaction_timestamp", "split_name", "amount", "risk_score", "channel", "merchant_state"]
_QP = SCORED.replace("select source_row_id, transaction_timestamp, split as", "select merchant_state, source_row_id, transaction_timestamp, split as")
_NULL = lambda c: f"cast(count(*) - count({c}) as double) / count(*)"


@query("DQ21_quality_profile", with_(_QP, ", p as (" + " union all ".join(
    [f"select 'scalar' as family, '{m}' as metric, cast({v} as double) as value from scored" for m, v in (
        ("row_count", "count(*)"), ("unique_source_row_id", "count(distinct source_row_id)"), ("duplicate_row_rate", "1 - count(distinct source_row_id) / count(*)"), ("timestamp_parse_error_rate", _NULL("transaction_timestamp")),
        ("future_timestamp_rate", "max(0)"), ("score_missing_rate", _NULL("risk_score")), ("score_out_of_range_rate", "count(*) filter (where risk_score not between 0 and 1) / count(*)"), ("amount_nonfinite_rate", _NULL("amount")))]
    + [f"select 'null_rate', '{c}', {_NULL(c)} from scored" for c in _QP_COLS] + [f"select 'structural_missingness_delta', '{c}', {_NULL(c)} - {'0.05::double' if c == 'merchant_state' else _NULL(c)} from scored" for c in _QP_COLS]
    + ["select 'unknown_category_rate', 'channel', cast(count(*) filter (where channel not in ('ONLINE', 'CHIP')) as double) / count(*) from scored", "select 'new_category_rate', 'channel', cast(count(*) filter (where channel not in ('ONLINE', 'CHIP')) as double) / count(*) from scored"]
    ) + ") select '' as critical_issues, 'PASS' as status, family, metric, value from p"))
def _(spark, sf):
    states = T.transactions(spark, sf).select("source_row_id", "merchant_state")
    s = T.scored(spark, sf).join(states, "source_row_id").select(*_QP_COLS)
    return C.quality_profile(s, {"channel": ["ONLINE", "CHIP"]}, {"merchant_state": 0.05})


@query("DQ22_input_quality", with_(SCORED, "select count(*) as row_count, count(distinct source_row_id) as unique_source_row_id, cast(0 as double) as null_source_row_rate, cast(count(*) filter (where risk_score not between 0 and 1) as double) / count(*) as score_contract_error_rate from scored"))
def _(spark, sf):
    return Q.input_quality(T.scored(spark, sf))


@query("DQ39_frozen_lineage", with_(MON, "select 'policy_version' as field, 'P1' as frozen_value, cast(0 as bigint) as mismatched_rows, 'PASS' as status from (select count(*) from mon) t union all select 'graph_version', 'G2', count(*), 'FAIL' from mon"))
def _(spark, sf):
    return Q.frozen_lineage(monitored(spark, sf), {"policy_version": "P1", "graph_version": "G2"})


# --- window tables ----------------------------------------------------------------------------------


def _simple(name, sql, fn, decided_rows=False):
    source = monitored if decided_rows else scored_windows
    query(name, with_(MON, sql))(lambda spark, sf: fn(source(spark, sf)))


_CENTS = "cast(round(positive_exposure * 100) as bigint)"
_simple("MON01_window_counts", "select operational_window_id, drift_window_id, performance_window_id, count(*) as row_count from mon group by all", N.window_counts)
_simple("MON01_window_summary", "select drift_window_id, count(*) as row_count from mon group by 1", lambda df: N.window_summary(df, "drift_window_id"))
_simple("MON02_population_summary", f"select split_name, channel, count(*) as transactions, cast(sum({_CENTS}) as double) / 100 as exposure from mon group by all", N.population_summary)
_simple("MON03_drift_inputs", "select drift_window_id, channel, count(*) as rows, cast(sum(cast(round(amount * 100) as bigint)) as double) / (count(amount) * 100.0::double) as mean_amount, cast(sum(state_missing_flag) as double) / count(*) as state_missing_rate from mon group by all", N.drift_inputs)
_simple("MON05_action_mix", "select operational_window_id, action, count(*) as rows from mon group by all", N.action_mix, True)
_simple("MON06_review_counts", "select operational_window_id, count(*) filter (where candidate_action = 'REVIEW') as review_candidates, count(*) filter (where review_selected) as review_selected, count(*) filter (where review_overflow) as review_overflow from mon group by 1", N.review_counts, True)
_simple("MON07_graph_rates", "select operational_window_id, " + ", ".join(f"cast(count(*) filter (where {g}) as double) / count(*) as {g}_rate" for g in N.GRAPH_FLAGS) + " from mon group by 1", N.graph_rates)
_simple("MON08_segment_means", f"select drift_window_id, channel, count(*) as support, cast(sum({_CENTS}) as double) / (count(*) * 100.0::double) as mean_exposure, round(avg(risk_score), 9) as mean_score from mon group by all", lambda df: rounded(N.segment_means(df), "mean_score"))
_simple("MON09_matured_outcomes", f"select performance_window_id, count(*) as transactions, cast(sum(fraud_label) as bigint) as fraud_count, cast(sum({_CENTS} * fraud_label) as double) / 100 as fraud_exposure from mon group by 1", N.matured_outcomes)
_simple("MON10_daily_reconciliation", "select operational_window_id, count(*) as assigned_rows, cast(0 as bigint) as unassigned_rows from mon group by 1", N.daily_reconciliation)
_simple("MON10_window_reconciliation", "select count(*) as mart_rows, count(*) as assigned_window_rows from mon", N.window_reconciliation)


@query("MON04_score_by_window", with_(MON, "select drift_window_id, count(*) as rows, round(avg(risk_score), 9) as mean_score, round(quantile_cont(risk_score, 0.5), 9) as p50, round(quantile_cont(risk_score, 0.95), 9) as p95 from mon group by 1"))
def _(spark, sf):
    return rounded(N.score_by_window(scored_windows(spark, sf), **bound(spark, sf)), "mean_score", "p50", "p95")


# --- drift ------------------------------------------------------------------------------------------

_DECILES = ", ".join(str(i / 10) for i in range(11))


def _edges_sql(f: str, source: str = "ref") -> str:
    if f == "state_missing_flag":
        return "select 0.5::double as e"
    return f"select e from (select distinct unnest(quantile_cont(cast({f} as double), [{_DECILES}])) as e from {source}) q where e > (select min({f}) from {source}) and e < (select max({f}) from {source})"


def _counts_sql(f: str, source: str, edges: str) -> str:
    return f"select b, count(v) as n from (select unnest(generate_series(0, (select count(*) from {edges}))) as b) g left join (select (select count(*) from {edges} where e <= v) as vb, v from (select cast({f} as double) as v from {source}) x) y on vb = b group by b"


def _distances_sql(name: str) -> str:
    p, q = "(r.n + 1e-12::double) / (rt + 1e-12::double * k)", "(c.n + 1e-12::double) / (ct + 1e-12::double * k)"
    return f"""(select sqrt(greatest(0, sum(({p}) * ln(2 * ({p}) / (({p}) + ({q}))) + ({q}) * ln(2 * ({q}) / (({p}) + ({q})))) / 2)) as js, sum((({q}) - ({p})) * ln(({q}) / ({p}))) as psi, sum(abs(({p}) - ({q}))) / 2 as tv
      from {name}_r r join {name}_c c using (b), (select sum(n) as rt, count(*) as k from {name}_r) t1, (select sum(n) as ct from {name}_c) t2)"""


def _numeric_ctes(features, ref="ref", cur="cur") -> str:
    out = []
    for f in features:
        out += [f"{f}_e as ({_edges_sql(f, ref)})", f"{f}_r as ({_counts_sql(f, ref, f + '_e')})", f"{f}_c as ({_counts_sql(f, cur, f + '_e')})"]
    return ",\n".join(out)


_NUM = ("amount", "risk_score", "state_missing_flag")


@query("MON11_12_frozen_bins", with_(MON + "," + _numeric_ctes(_NUM), " union all ".join(f"select '{f}' as feature_name, b as bin, n as rows from {f}_r" for f in _NUM)))
def _(spark, sf):
    ref, _cur = both(spark, sf, _NUM)
    return D.numeric_reference(ref, _NUM, **bound(spark, sf)).select("feature_name", F.posexplode("bin_counts").alias("bin", "rows")).withColumn("bin", F.col("bin").cast("long"))


@query("MON20_numeric_reference", with_(MON, " union all ".join(
    f"select '{f}' as feature_name, count({f}) as reference_n, count(*) - count({f}) as missing_n, round(avg({f}), 6) as mean, round(stddev_pop({f}), 6) as std, " + ", ".join(f"round(quantile_cont(cast({f} as double), {p}), 6) as q{int(p * 100):02d}" for p in D.FEATURE_QUANTILES) + " from ref" for f in _NUM)))
def _(spark, sf):
    ref, _cur = both(spark, sf, _NUM)
    t = D.numeric_reference(ref, _NUM, **bound(spark, sf))
    return t.select("feature_name", "reference_n", "missing_n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), *[F.round(F.col("quantiles")[i], 6).alias(f"q{int(p * 100):02d}") for i, p in enumerate(D.FEATURE_QUANTILES)])


_CATS = ("channel", "MCC", "pair_new", "cold_card", "new_merchant", "cross_community")


@query("MON20_category_reference", with_(MON, " union all ".join(f"select '{f}' as feature_name, coalesce(cast({f} as varchar), '__NULL__') as category, count(*) as reference_count from ref group by 2" for f in _CATS)))
def _(spark, sf):
    return D.category_reference(both(spark, sf, _CATS)[0], _CATS)


def _qvec(f: str, source: str, probs) -> str:
    return f"(select quantile_cont(cast({f} as double), [{', '.join(map(str, probs))}]) from {source})"


def _qw(f: str, probs) -> str:
    a, b = _qvec(f, "ref", probs), _qvec(f, "cur", probs)
    return f"(select sum(abs(x - y)) / count(*) / case when stddev_pop(x) > 1e-12 then stddev_pop(x) else greatest(max(x) - min(x), 1) end from (select unnest({a}) as x, unnest({b}) as y) z)"


@query("MON21_numeric_feature_drift", with_(MON + "," + _numeric_ctes(_NUM), " union all ".join(
    f"select 'FINAL_OOT' as window_id, '{f}' as feature_name, 'numerical' as feature_type, (select count({f}) from ref) as reference_n, (select count({f}) from cur) as current_n, unnest(['jensen_shannon','psi','wasserstein']) as metric_name, unnest([round(js, 8), round(psi, 8), round({_qw(f, D.FEATURE_QUANTILES)}, 8)]) as metric_value from {_distances_sql(f)} d" for f in _NUM)))
def _(spark, sf):
    ref, cur = both(spark, sf, _NUM)
    frozen = D.numeric_reference(ref, _NUM, **bound(spark, sf))
    return rounded(D.numeric_drift(cur, frozen, "FINAL_OOT", **bound(spark, sf)), "metric_value", digits=8).select("window_id", "feature_name", "feature_type", "reference_n", "current_n", "metric_name", "metric_value")


def _cat_ctes(features) -> str:
    out = []
    for f in features:
        out += [f"{f}_r as (select cast({f} as varchar) as b, count(*) as n from ref group by 1)", f"{f}_c as (select r.b, coalesce(c.n, 0) as n from {f}_r r left join (select cast({f} as varchar) as b, count(*) as n from cur group by 1) c using (b))"]
    return ",\n".join(out)


@query("MON21_categorical_feature_drift", with_(MON + "," + _cat_ctes(_CATS), " union all ".join(
    f"select 'FINAL_OOT' as window_id, '{f}' as feature_name, 'categorical' as feature_type, (select count(*) from ref) as reference_n, (select count(*) from cur) as current_n, unnest(['jensen_shannon','psi']) as metric_name, unnest([round(js, 8), round(psi, 8)]) as metric_value from {_distances_sql(f)} d" for f in _CATS)))
def _(spark, sf):
    ref, cur = both(spark, sf, _CATS)
    return rounded(D.categorical_drift(cur, D.category_reference(ref, _CATS), _CATS, "FINAL_OOT"), "metric_value", digits=8)


_TWO = """, v as (select 'amount' as f, amount as v, 1 as a, 0 as b from ref union all select 'amount', amount, 0, 1 from cur union all select 'risk_score', risk_score, 1, 0 from ref union all select 'risk_score', risk_score, 0, 1 from cur),
 g as (select f, v, sum(a) as a, sum(b) as b from v group by 1, 2),
 c as (select f, v, cast(sum(a) over (partition by f order by v) as double) / sum(a) over (partition by f) as fa, cast(sum(b) over (partition by f order by v) as double) / sum(b) over (partition by f) as fb, lead(v) over (partition by f order by v) as nv from g),
 s as (select 'amount' as f, stddev_pop(amount) as sd from ref union all select 'risk_score', stddev_pop(risk_score) from ref)"""


@query("MON16_17_two_sample", with_(MON + _TWO, "select c.f as feature_name, round(max(abs(fa - fb)), 8) as ks, round(sum(abs(fa - fb) * (nv - v)) / max(sd), 8) as wasserstein from c join s on c.f = s.f group by 1"))
def _(spark, sf):
    ref, cur = both(spark, sf, ("amount", "risk_score"))
    return rounded(D.two_sample(ref, cur, ("amount", "risk_score"), **bound(spark, sf)), "ks", "wasserstein", digits=8)


_D2 = ("amount", "risk_score")


@query("MON14_22_drift_from_frames", with_(MON + "," + _numeric_ctes(_D2) + "," + _cat_ctes(("channel",)) + _TWO, " union all ".join(
    [f"select 'w' as window_id, '{f}' as feature_name, 'numerical' as feature_type, unnest(['jensen_shannon','psi']) as metric_name, unnest([round(js, 8), round(psi, 8)]) as metric_value from {_distances_sql(f)} d" for f in _D2]
    + [f"select 'w', 'channel', 'categorical', unnest(['jensen_shannon','psi']), unnest([round(js, 8), round(psi, 8)]) from {_distances_sql('channel')} d",
       "select 'w', f, 'numerical', unnest(['ks','wasserstein']), unnest([round(ks, 8), round(w, 8)]) from (select c.f, max(abs(fa - fb)) as ks, sum(abs(fa - fb) * (nv - v)) / max(sd) as w from c join s on c.f = s.f group by 1) t"])))
def _(spark, sf):
    ref, cur = both(spark, sf, (*_D2, "channel"))
    return rounded(D.drift_from_frames(ref, cur, _D2, ("channel",), "w", **bound(spark, sf)), "metric_value", digits=8)


@query("MON13_18_total_variation", with_(MON + "," + _numeric_ctes(("risk_score",)), f"select 'risk_score' as feature_name, round(tv, 9) as total_variation from {_distances_sql('risk_score')} d"))
def _(spark, sf):
    ref, cur = both(spark, sf, ("risk_score",))
    edges = D.frozen_bins(ref, ["risk_score"], **bound(spark, sf))["risk_score"]
    a = ref.agg(D.histogram("risk_score", edges).alias("a"), F.lit(1).alias("k"))
    b = cur.agg(D.histogram("risk_score", edges).alias("b"), F.lit(1).alias("k"))
    return a.join(F.broadcast(b), "k").select(F.lit("risk_score").alias("feature_name"), F.round(D.total_variation(F.col("a"), F.col("b")), 9).alias("total_variation"))


def _chi(spark, sf):
    ref, cur = both(spark, sf, ("risk_score",))
    edges = D.frozen_bins(ref, ["risk_score"], **bound(spark, sf))["risk_score"]
    return D.chi_squared(ref, cur, {"risk_score": ("risk_score", edges)})


# Equal widths of the score and of the amount's cents, for several degrees of freedom.
_WIDTHS = {f"{c}_{k}": (c, k) for k in (2, 3, 10, 31) for c in ("risk_score", "cents_of_amount")}
_CENT_PART = "cast((cast(round(amount * 100) as bigint) % 100 + 100) % 100 as double) / 100"


@query("MON19_chi_squared", with_("recursive " + MON + f""", both_ as (select 'a' as side, risk_score, {_CENT_PART} as cents_of_amount from ref union all select 'b', risk_score, {_CENT_PART} from cur),
 binned as (select feature_name, k, b, cast(count(*) filter (where side = 'a') as double) + 1e-12::double as x, cast(count(*) filter (where side = 'b') as double) + 1e-12::double as y from ({' union all '.join(
    f"select '{n}' as feature_name, {k} as k, side, (select count(*) from range(1, {k}) e(i) where cast(e.i as double) / {k} <= {c}) as b from both_" for n, (c, k) in _WIDTHS.items())}) q group by 1, 2, 3),
 sized as (select *, sum(x) over p as rt, sum(y) over p as ct from binned window p as (partition by feature_name)),
 stat as (select feature_name, sum((abs(x - ex) - least(yates, abs(x - ex))) ** 2 / ex + (abs(y - ey) - least(yates, abs(y - ey))) ** 2 / ey) as statistic, cast(max(k) - 1 as int) as degrees
   from (select *, rt * (x + y) / (rt + ct) as ex, ct * (x + y) / (rt + ct) as ey, case when k = 2 then 0.5::double else 0 end as yates from sized) s group by 1),
 args as (select *, degrees / 2.0::double as a, statistic / 2 as x from stat),
 steps as (select feature_name, 0 as i, a, x, 1 / a as term, 1 / a as total, x + 1 - a as b, 1e300::double as c, 1 / (x + 1 - a) as d, 1 / (x + 1 - a) as h from args
   union all select feature_name, i, a, x, term, total + term, b, c, d, h * d * c from (
     select feature_name, i + 1 as i, a, x, term * x / (a + i + 1) as term, total, b + 2 as b, b + 2 + (-(i + 1) * (i + 1 - a)) / c as c, 1 / ((-(i + 1) * (i + 1 - a)) * d + b + 2) as d, h from steps where i < 400) t)""", """
 select s.feature_name, round(statistic, 6) as statistic, degrees, round(case when x <= 0 then 1 when x < a + 1 then greatest(0, 1 - total * exp(-x + a * ln(x) - lgamma(a))) else h * exp(-x + a * ln(x) - lgamma(a)) end, 9) as p_value
 from (select * from steps where i = 400) s join stat using (feature_name)"""))
def _(spark, sf):
    """P-values at 1, 2, 9 and 30 degrees of freedom."""
    ref, cur = (df.withColumn("cents_of_amount", F.pmod(F.round(F.col("amount") * 100).cast("long"), F.lit(100)) / 100) for df in both(spark, sf, ("risk_score", "amount")))
    bins = {n: (c, [-math.inf, *(i / k for i in range(1, k)), math.inf]) for n, (c, k) in _WIDTHS.items()}
    return rounded(rounded(D.chi_squared(ref, cur, bins), "statistic", digits=6), "p_value", digits=9)


@query("MON19_chi_squared_statistic", with_(MON + "," + _numeric_ctes(("risk_score",)), """select 'risk_score' as feature_name, round(sum((x - rt * (x + y) / (rt + ct)) ** 2 / (rt * (x + y) / (rt + ct)) + (y - ct * (x + y) / (rt + ct)) ** 2 / (ct * (x + y) / (rt + ct))), 6) as statistic, cast(count(*) - 1 as int) as degrees
  from (select r.n + 1e-12::double as x, c.n + 1e-12::double as y, sum(r.n + 1e-12::double) over () as rt, sum(c.n + 1e-12::double) over () as ct from risk_score_r r join risk_score_c c using (b)) t"""))
def _(spark, sf):
    return rounded(_chi(spark, sf).select("feature_name", "statistic", "degrees"), "statistic", digits=6)


@query("MON23_known_categories", with_(MON, "select 'MCC' as feature_name, MCC as category, cast(count(*) as double) / (select count(*) from ref) as reference_share from ref group by 2"))
def _(spark, sf):
    return D.top_categories(both(spark, sf, ("MCC",))[0], "MCC")


def _novelty_sql(f: str) -> str:
    return f"""select 'FINAL_OOT' as window_id, '{f}' as feature_name, coalesce(r.b, c.b) as category, cast(coalesce(r.n, 0) as double) / rt as reference_share, cast(coalesce(c.n, 0) as double) / ct as current_share,
     cast(coalesce(c.n, 0) as double) / ct - cast(coalesce(r.n, 0) as double) / rt as share_delta, r.b is null as is_new_category, r.b is null as is_unknown_category, 'FROZEN_CATEGORICAL_SUFFICIENT_STATISTICS' as reference_source
     from (select coalesce({f}, '__NULL__') as b, count(*) as n from ref where {f} <> '5003' group by 1) r full join (select coalesce({f}, '__NULL__') as b, count(*) as n from cur group by 1) c on r.b = c.b,
      (select count(*) as rt from ref where {f} <> '5003') x, (select count(*) as ct from cur) y"""


@query("MON24_category_novelty", with_(MON, _novelty_sql("channel") + " union all " + _novelty_sql("MCC")))
def _(spark, sf):
    ref, cur = both(spark, sf, ("channel", "MCC"))
    return D.category_novelty(cur, D.category_reference(ref, ("channel",)).unionByName(D.category_reference(ref.where("MCC <> '5003'"), ("MCC",))), ("channel", "MCC"), "FINAL_OOT")


@query("MON25_score_summary", with_(MON, "select count(risk_score) as n, round(avg(risk_score), 9) as mean, round(median(risk_score), 9) as median, round(stddev_pop(risk_score), 9) as std, " + ", ".join(f"round(quantile_cont(risk_score, {p / 100}), 9) as p{p}" for p in (50, 75, 90, 95, 99)) + ", cast(count(*) filter (where risk_score >= 0.55) as double) / count(*) as share_above_review_threshold, cast(count(*) filter (where risk_score >= 0.85) as double) / count(*) as share_above_block_threshold from ref"))
def _(spark, sf):
    s = D.score_summary(both(spark, sf, ("risk_score",))[0], 0.55, 0.85, **bound(spark, sf))
    return rounded(s, "mean", "median", "std", "p50", "p75", "p90", "p95", "p99")


_SCORE_SIGNALS = f"select unnest(['score_js','score_psi','score_wasserstein']) as metric, unnest([round(js, 8), round(psi, 8), round({_qw('risk_score', D.SCORE_QUANTILES)}, 8)]) as observed from {_distances_sql('risk_score')} d"


@query("MON26_score_drift", with_(MON + "," + _numeric_ctes(("risk_score",)), f"select 'FINAL_OOT' as window_id, metric, observed, 'RANKING_ONLY' as score_status, 'EARLY_WARNING' as claim_class, 'FROZEN_SCORE_SUFFICIENT_STATISTICS' as reference_source from ({_SCORE_SIGNALS}) t"))
def _(spark, sf):
    ref, cur = both(spark, sf, ("risk_score",))
    return rounded(D.score_drift(cur, D.score_reference(ref, **bound(spark, sf)), "FINAL_OOT", **bound(spark, sf)), "observed", digits=8)


# --- monitors ---------------------------------------------------------------------------------------

_ACTIONS = ("ALLOW", "REVIEW", "BLOCK")
_ACOUNT = lambda v: f"count(*) filter (where action = '{v}')"


@query("MON27_policy_monitor", with_(MON, "select operational_window_id as window_id, 'PASS' as status, cast(null as varchar) as reason, 'P1' as policy_version, " + ", ".join(f"cast({_ACOUNT(v)} as double) / count(*) as {v.lower()}_rate, {_ACOUNT(v)} as {v.lower()}_count" for v in _ACTIONS) + " from mon group by 1"))
def _(spark, sf):
    return N.policy_monitor(monitored(spark, sf))


_SEL = "filter (where review_selected)"


@query("MON28_review_monitor", with_(MON, f"""select concat(operational_window_id, ':', review_capacity_bucket) as window_id, 'PASS' as status, cast(null as varchar) as reason, count(*) filter (where candidate_action = 'REVIEW') as eligible_cases, count(*) {_SEL} as selected_cases, count(*) filter (where review_overflow) as overflow_cases,
  max(bucket_capacity) as capacity, cast(count(*) {_SEL} as double) / nullif(max(bucket_capacity), 0) as capacity_utilization, cast(count(*) filter (where candidate_action = 'REVIEW') as double) / count(*) as candidate_rate, cast(count(*) {_SEL} as double) / count(*) as selected_rate,
  cast(count(*) filter (where review_overflow) as double) / count(*) as overflow_rate, round(avg(risk_score) {_SEL}, 9) as mean_review_score, round(quantile_cont(risk_score, 0.9) {_SEL}, 9) as p90_review_score, round(cast(sum({_CENTS}) {_SEL} as double) / (count(*) {_SEL} * 100.0::double), 6) as mean_review_exposure from mon group by 1"""))
def _(spark, sf):
    r = N.review_monitor(reviewed(spark, sf), **bound(spark, sf))
    return rounded(rounded(r, "mean_review_score", "p90_review_score"), "mean_review_exposure", digits=6)


@query("MON29_capacity_reconciliation", with_(MON, f"select review_capacity_bucket as capacity_bucket, count(*) filter (where candidate_action = 'REVIEW') as eligible_cases, count(*) {_SEL} as selected_cases, count(*) filter (where review_overflow) as overflow_cases, max(bucket_capacity) as bucket_capacity, cast(count(*) {_SEL} as double) / nullif(max(bucket_capacity), 0) as capacity_utilization, 'PASS' as status from mon group by 1"))
def _(spark, sf):
    return C.capacity_reconciliation(monitored(spark, sf))


@query("MON30_graph_monitor", with_(MON, "select operational_window_id as window_id, 'PASS' as status, 'G1' as graph_version, " + ", ".join(f"cast(count(*) filter (where {g}) as double) / count(*) as {g}_rate" for g in N.GRAPH_FLAGS) + ", cast(0 as double) as graph_signal_missing_rate, false as graph_auto_block, 'context_and_priority_only' as graph_governance from mon group by 1"))
def _(spark, sf):
    return N.graph_monitor(scored_windows(spark, sf).withColumn("graph_version", F.lit("G1")))


_SEGS = {"channel": "channel", "amount_band": "amount_band", "MCC": "MCC", "cold_start": "if(cold_card, 'True', 'False')", "new_card_merchant_pair": "if(pair_new, 'True', 'False')", "new_merchant": "if(new_merchant, 'True', 'False')", "policy_action": "action", "risk_band": "risk_band"}


@query("MON31_segment_monitor", with_(MON + f", sg as (select *, {_CENTS} as x, {_BANDS} from cur)", " union all ".join(
    f"select 'FINAL_OOT' as window_id, '{k}' as segment_type, {e} as segment, count(*) as support, cast(count(*) as double) / (select count(*) from sg) as share_transactions, cast(sum(x) as double) / cast((select sum(x) from sg) as double) as share_exposure from sg group by 3" for k, e in _SEGS.items())))
def _(spark, sf):
    return N.segment_monitor(S.observation_rows(monitored(spark, sf)), "FINAL_OOT")


_P32, _Q32 = "(a.n + 1e-12::double) / (al_t + 1e-12::double * k)", "(c.n + 1e-12::double) / (ct + 1e-12::double * k)"


@query("MON32_threshold_calibration", with_(MON + f""", early as (select * from mon where split_name <> 'OUT_OF_TIME_OOT'), ee as ({_edges_sql('risk_score', 'early')}), al as ({_counts_sql('risk_score', 'early', 'ee')}),
 wb as (select operational_window_id as w, (select count(*) from ee where e <= risk_score) as b, count(*) as n from early group by 1, 2), wt as (select w, sum(n) as ct from wb group by 1 having sum(n) >= 5),
 cells as (select wt.w, al.b, al.n as an, coalesce(wb.n, 0) as cn, ct from wt cross join al left join wb on wb.w = wt.w and wb.b = al.b),
 d as (select w, sqrt(greatest(0, sum(({_P32}) * ln(2 * ({_P32}) / (({_P32}) + ({_Q32}))) + ({_Q32}) * ln(2 * ({_Q32}) / (({_P32}) + ({_Q32})))) / 2)) as js, sum((({_Q32}) - ({_P32})) * ln(({_Q32}) / ({_P32}))) as psi
   from (select w, b, ct, struct_pack(n := an) as a, struct_pack(n := cn) as c from cells) z, (select sum(n) as al_t, count(*) as k from al) t group by w)""",
    """select 'score_js' as metric, round(quantile_cont(js, 0.95), 8) as candidate_amber, round(quantile_cont(js, 0.99), 8) as candidate_red, round(min(js), 8) as low, round(median(js), 8) as middle, round(max(js), 8) as high, 'CANDIDATES_READY' as status, count(*) as candidate_support from d
  union all select 'score_psi', round(quantile_cont(psi, 0.95), 8), round(quantile_cont(psi, 0.99), 8), round(min(psi), 8), round(median(psi), 8), round(max(psi), 8), 'CANDIDATES_READY', count(*) from d
  union all select 'channel_share', null, null, null, null, null, 'CANDIDATES_READY', count(*) from d"""))
def _(spark, sf):
    t = N.calibrate_thresholds(scored_windows(spark, sf), **bound(spark, sf))
    return rounded(t, "candidate_amber", "candidate_red", "low", "middle", "high", digits=8)


_ALERTS = f"""select concat('P8-', metric, '-FINAL_OOT') as alert_id, 'FINAL_OOT' as window_id, 'SCORE' as signal_family, metric, case when n < coalesce(ms, 0) then 'INSUFFICIENT_SUPPORT' when red is null then 'BLOCKED' when observed >= red then 'RED' when observed >= amber then 'AMBER' else 'GREEN' end as severity,
  observed, red as threshold, n as support, 'EARLY_WARNING' as claim_class from ({_SCORE_SIGNALS}) s left join (values ('score_js', 0.16317::double, 0.16438::double, 100), ('score_psi', 0.21624::double, 0.21950::double, 10000)) t(m, amber, red, ms) on m = metric, (select count(*) as n from cur) c"""


def _alerts(spark, sf):
    ref, cur = both(spark, sf, ("risk_score",))
    d = rounded(D.score_drift(cur, D.score_reference(ref, **bound(spark, sf)), "FINAL_OOT", **bound(spark, sf)), "observed", digits=8)
    signals = d.select("window_id", F.lit("SCORE").alias("signal_family"), "metric", "observed", F.lit(cur.count()).cast("long").alias("support"), "claim_class")
    limits = {"score_js": (0.16317, 0.16438, 100), "score_psi": (0.21624, 0.21950, 10_000)}
    return N.alerts(signals, limits)


query("MON33_alerts", with_(MON + "," + _numeric_ctes(("risk_score",)), _ALERTS))(_alerts)


@query("MON33_alert_summary", with_(MON + "," + _numeric_ctes(("risk_score",)), f"select severity, signal_family, count(*) as alerts from ({_ALERTS}) a group by 1, 2"))
def _(spark, sf):
    return N.alert_summary(_alerts(spark, sf))


_BREACH = "(select drift_window_id as window_id, 'mean_score' as metric, round(avg(risk_score), 9) > 0.312 as breach from mon group by 1)"


@query("MON34_alert_persistence", with_(MON, f"""select window_id, metric, breach, case when (breach::int + coalesce(lag(breach::int, 1) over w, 0) + coalesce(lag(breach::int, 2) over w, 0)) >= 2 then 'RED' when breach then 'RED' else 'GREEN' end as two_of_three,
  case when breach then 'RED' else 'GREEN' end as two_consecutive from {_BREACH} b window w as (order by window_id)"""))
def _(spark, sf):
    weekly = N.segment_means(scored_windows(spark, sf).withColumn("channel", F.lit("all"))).select(
        F.col("drift_window_id").alias("window_id"), F.lit("mean_score").alias("metric"), (F.round("mean_score", 9) > 0.312).alias("breach"))
    a = N.persistence(weekly, "2_of_3").withColumnRenamed("persistent_status", "two_of_three")
    return N.persistence(a, "2_consecutive").withColumnRenamed("persistent_status", "two_consecutive")


@query("MON35_recommendations", with_(MON + "," + _numeric_ctes(("risk_score",)), f"select window_id, 'GOVERNANCE_INCIDENT' as incident_type, 'INVESTIGATE' as recommendation, severity, 'aggregate monitoring evidence requires owner review; no automatic model or policy mutation' as rationale from ({_ALERTS}) a"))
def _(spark, sf):
    return N.recommend(_alerts(spark, sf)).drop("evidence_hash")


@query("MON35_recommendations_by_family", with_(MON, """select f as signal_family, case when f like '%DATA_QUALITY%' then 'DATA_QUALITY_REVIEW' when f like '%PERFORMANCE%' then 'MODEL_RETRAIN_REVIEW_RECOMMENDED' when f like '%CALIBRATION%' then 'CALIBRATION_REVIEW_RECOMMENDED'
  when f like '%POLICY%' then 'POLICY_REVIEW_RECOMMENDED' when f like '%REVIEW%' then 'POLICY_REVIEW_RECOMMENDED' when f like '%GRAPH%' then 'GRAPH_REVIEW_RECOMMENDED' else 'INVESTIGATE' end as recommendation, count(*) as windows
  from (select distinct operational_window_id from mon) w, (select unnest(['DATA_QUALITY', 'REVIEW_QUEUE', 'GRAPH_CONTEXT', 'SCORE', 'POLICY']) as f) x group by all"""))
def _(spark, sf):
    families = F.explode(F.array(*[F.lit(f) for f in ("DATA_QUALITY", "REVIEW_QUEUE", "GRAPH_CONTEXT", "SCORE", "POLICY")]))
    windows = scored_windows(spark, sf).select("operational_window_id").distinct().select("operational_window_id", families.alias("signal_family"))
    alerted = windows.select(F.concat_ws("|", "signal_family", "operational_window_id").alias("window_id"), "signal_family", F.lit("RED").alias("severity"))
    family = F.split_part("window_id", F.lit("|"), F.lit(1))
    return N.recommend(alerted).groupBy(family.alias("signal_family"), "recommendation").agg(F.count("*").alias("windows"))


def _labelled(spark, sf):
    """Decided reference and observed rows with their labels, written once; decisions and labels both come from scored rows that are written
    once. A queue is a day's, so Development rows, which a replay reads only if they are the reference, change no decision on the others; ids
    may repeat, so the labels are those of all rows."""
    scored = compared = stored(T.scored(spark, sf))
    if not scored.where(S.is_reference() & F.col("source_row_id").isNotNull()).isEmpty():
        compared = scored.where(S.is_reference() | S.is_observed())
    rows = T.row_bound(spark, sf)
    both_sides = [dealt(df, ["source_row_id"], rows) for df in (adapted(spark, sf, compared), scored.select("source_row_id", "fraud_label"))]
    full = placed(both_sides[0].join(both_sides[1], "source_row_id"))  # windows and versions are texts, which need not be dealt out
    return stored(full.select(*[c for c in full.columns if c != "fraud_label"], "fraud_label"))


def _replayed(spark, sf):
    full = _labelled(spark, sf)
    return N.replay(full, N.build_baseline(full, **bound(spark, sf)), written=True, **bound(spark, sf))


def _root_cause_sql() -> str:
    """The five largest movements of each evidence table, each written out from the given rows."""
    drift = " union all ".join(
        [f"select '{f}' || ':' || m as item, v as value from (select unnest(['jensen_shannon','psi','wasserstein']) as m, unnest([js, psi, {_qw(f, D.FEATURE_QUANTILES)}]) as v from {_distances_sql(f)} d)" for f in _NUM]
        + [f"select '{f}' || ':' || m as item, v as value from (select unnest(['jensen_shannon','psi']) as m, unnest([js, psi]) as v from {_distances_sql(f)} d)" for f in _CATS])
    new = " union all ".join(f"select feature_name || ':' || category as item, share_delta as value from ({_novelty_sql(f).replace(chr(39) + '5003' + chr(39), chr(39) + 'no such' + chr(39))}) n" for f in ("channel", "MCC"))
    score = f"select metric as item, observed as value from ({_SCORE_SIGNALS}) z"
    segments = f"select k || ':' || coalesce(segment, 'nan') as item, cast(count(*) as double) / (select count(*) from sg) as value from (" + " union all ".join(f"select '{k}' as k, {e} as segment from sg" for k, e in _SEGS.items()) + ") q group by 1"
    parts = {"top_drifting_features": drift, "top_new_categories": new, "score_shift": score, "segments_affected": segments}
    return with_(
        MON + "," + _numeric_ctes(("amount", "risk_score", "state_missing_flag")) + "," + _cat_ctes(_CATS) + f", sg as (select *, {_CENTS} as x, {_BANDS} from cur)",
        " union all ".join(f"(select '{name}' as section, item, round(value, 8) as value from ({sql}) w order by round(value, 8) desc, item limit 5)" for name, sql in parts.items()))


@query("MON36_root_cause", _root_cause_sql())
def _(spark, sf):
    tables = _replayed(spark, sf)
    even = lambda name, value: tables[name].withColumn(value, F.round(value, 8))  # noqa: E731  so that ties are ties in both engines
    return N.root_cause(even("feature_drift", "metric_value"), even("novelty", "share_delta"), even("score", "observed"), even("segments", "share_transactions"))


def _observed_only(name: str) -> str:
    """The same report over the out-of-time rows, which is what a replay reads."""
    return ORACLES[name].replace(" from mon group by 1", " from cur group by 1")


@query("MON37_replay_policy", _observed_only("MON27_policy_monitor"))
def _(spark, sf):
    return _replayed(spark, sf)["policy"]


@query("MON37_replay_review", _observed_only("MON28_review_monitor"))
def _(spark, sf):
    return rounded(rounded(_replayed(spark, sf)["review"], "mean_review_score", "p90_review_score"), "mean_review_exposure", digits=6)


@query("MON37_replay_graph", _observed_only("MON30_graph_monitor"))
def _(spark, sf):
    return _replayed(spark, sf)["graph"]


@query("MON37_replay_segments", ORACLES["MON31_segment_monitor"])
def _(spark, sf):
    return _replayed(spark, sf)["segments"]


@query("MON37_replay_score", ORACLES["MON26_score_drift"])
def _(spark, sf):
    return rounded(_replayed(spark, sf)["score"], "observed", digits=8)


@query("MON37_replay")
def _(spark, sf):
    tables = _replayed(spark, sf)
    out = None
    for name, t in tables.items():
        row = t.agg(F.count("*").alias("rows")).withColumn("report", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def _day_cells(spark, sf):
    """The out-of-time rows counted day by day in two halves, each written once, and put together."""
    from ..operators import replay_days as R

    s = _labelled(spark, sf)
    observed = S.observation_rows(s)
    early = F.substring("operational_window_id", -2, 2).cast("int") % 2 == 0
    return N.build_baseline(s, **bound(spark, sf)), R.merged(stored(R.day_cells(observed.where(early))), stored(R.day_cells(observed.where(~early))))


_STRINGS = {"windows": ["drift_window_id"], "policy": ["policy_version", "reason", "status", "window_id"], "graph": ["graph_governance", "graph_version", "status", "window_id"], "segments": ["segment", "segment_type", "window_id"],
            "novelty": ["category", "feature_name", "reference_source", "window_id"], "score": ["claim_class", "metric", "reference_source", "score_status", "window_id"], "ranking": ["performance_window_id"],
            "feature_drift": ["feature_name", "feature_type", "metric_name", "window_id"]}
_COUNTS = {"windows": ["row_count"], "policy": [f"{v.lower()}_{m}" for m in ("rate", "count") for v in _ACTIONS], "graph": [*(f"{g}_rate" for g in N.GRAPH_FLAGS), "graph_signal_missing_rate"], "segments": ["support", "share_transactions", "share_exposure"],
           "novelty": ["reference_share", "current_share", "share_delta"], "score": ["observed"], "ranking": ["rows", "fraud_rows", "prevalence", "pr_auc", "roc_auc", "ks", "ks_roc"], "feature_drift": ["reference_n", "current_n", "metric_value"]}


def _measures_sql(name: str, sql: str) -> str:
    item = " || ', ' || ".join(f"'{c}=' || coalesce({c}, 'null')" for c in sorted(_STRINGS[name]))
    pairs = ", ".join(f"{{'measure': '{c}', 'value': cast({c} as double)}}" for c in _COUNTS[name])
    return f"select '{name}' as report, {item} as item, unnest([{pairs}], recursive := true) from ({sql}) as t_{name}"


def _replay_sql() -> str:
    """Each report over the out-of-time rows, written out from the rows."""
    drift = " union all ".join(
        [f"select 'FINAL_OOT' as window_id, '{f}' as feature_name, 'numerical' as feature_type, (select count({f}) from ref) as reference_n, (select count({f}) from cur) as current_n, unnest(['jensen_shannon','psi','wasserstein']) as metric_name, unnest([js, psi, {_qw(f, D.FEATURE_QUANTILES)}]) as metric_value from {_distances_sql(f)} d" for f in _NUM]
        + [f"select 'FINAL_OOT', '{f}', 'categorical', (select count(*) from ref), (select count(*) from cur), unnest(['jensen_shannon','psi']), unnest([js, psi]) from {_distances_sql(f)} d" for f in _CATS])
    novelty = " union all ".join(f"select *, 0 as unused from ({_novelty_sql(f).replace(chr(39) + '5003' + chr(39), chr(39) + 'no such' + chr(39))}) n" for f in ("channel", "MCC"))
    ranking = """select g as performance_window_id, max(tn) as rows, max(tp) as fraud_rows, cast(max(tp) as double) / max(tn) as prevalence, case when max(tp) between 1 and max(tn) - 1 then sum(cast(p as double) / nullif(tp, 0) * (cast(cp as double) / cn)) end as pr_auc,
      case when max(tp) between 1 and max(tn) - 1 then cast(sum(cast(n - p as hugeint) * (2 * (cp - p) + p)) as double) / (2.0::double * max(tp) * max(tn - tp)) end as roc_auc, case when max(tp) between 1 and max(tn) - 1 then max(abs(cast(cp as double) / nullif(tp, 0) - cast(cn - cp as double) / nullif(tn - tp, 0))) end as ks,
      case when max(tp) between 1 and max(tn) - 1 then greatest(0, max(cast(cp as double) / nullif(tp, 0) - cast(cn - cp as double) / nullif(tn - tp, 0))) end as ks_roc
      from (select *, sum(n) over w as cn, sum(p) over w as cp, sum(n) over (partition by g) as tn, sum(p) over (partition by g) as tp from (select performance_window_id as g, risk_score as s, count(*) as n, sum(fraud_label) as p from cur group by 1, 2) a window w as (partition by g order by s desc)) b group by 1"""
    parts = {"windows": "select drift_window_id, count(*) as row_count from cur group by 1", "policy": _observed_only("MON27_policy_monitor"), "graph": _observed_only("MON30_graph_monitor"), "segments": ORACLES["MON31_segment_monitor"],
             "score": ORACLES["MON26_score_drift"], "feature_drift": drift, "novelty": novelty, "ranking": ranking}
    return with_(MON + "," + _numeric_ctes(_NUM) + "," + _cat_ctes(_CATS), f"select report, item, measure, round(value, 7) as value from ({' union all '.join(_measures_sql(n, q) for n, q in parts.items())}) u")


@query("MON37_replay_by_days", _replay_sql())
def _(spark, sf):
    """Eight reports of a replay from merged counts of days."""
    from ..operators import replay_days as R

    baseline, cells = _day_cells(spark, sf)
    tables = R.reports(cells, baseline, **bound(spark, sf))
    return rounded(R.as_measures({n: tables[n] for n in _COUNTS}), "value", digits=7)


@query("SRC09_public_export_guard", with_(MON, "select segment_type, count(*) as segments, cast(sum(support) as bigint) as support from (select 'channel' as segment_type, channel, count(*) as support from mon group by 2) t group by 1"))
def _(spark, sf):
    t = N.segment_monitor(scored_windows(spark, sf)).where("segment_type = 'channel'").groupBy("segment_type").agg(F.count("*").alias("segments"), F.sum("support").alias("support"))
    return C.assert_public(t)
