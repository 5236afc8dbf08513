"""Ranking metrics, calibration and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import modeling as L
from ..operators import splits as S
from ..operators.behavior import FEATURES
from ..operators.logistic import Problem, designs, union_all
from ..sources import contracts as C
from . import tables as T
from .portfolio_queries import _LATE, _TRAIN, _eval_sql
from .registry import MART, SCORED, query, with_

SCORES = SCORED + """,
st as (select split_name as g, risk_score as s, count(*) as n, sum(fraud_label) as p from scored group by 1, 2),
cu as (select *, sum(n) over w as cn, sum(p) over w as cp, sum(n) over (partition by g) as tn, sum(p) over (partition by g) as tp from st window w as (partition by g order by s desc)),
rm as (select g as split_name, cast(max(tn) as bigint) as rows, cast(max(tp) as bigint) as fraud_rows, cast(max(tp) as double) / max(tn) as prevalence,
  sum(cast(p as double) / tp * (cast(cp as double) / cn)) as pr_auc, cast(sum(cast(n - p as hugeint) * (2 * (cp - p) + p)) as double) / (2.0::double * max(tp) * max(tn - tp)) as roc_auc,
  max(abs(cast(cp as double) / tp - cast(cn - cp as double) / (tn - tp))) as ks, greatest(0, max(cast(cp as double) / tp - cast(cn - cp as double) / (tn - tp))) as ks_roc from cu group by 1)"""


def _round(df, names=("pr_auc", "roc_auc", "ks", "ks_roc"), digits=9):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


@query("MET01_03_ranking_metrics", with_(SCORES, "select split_name, rows, fraud_rows, prevalence, round(pr_auc, 9) as pr_auc, round(roc_auc, 9) as roc_auc, round(ks, 9) as ks, round(ks_roc, 9) as ks_roc from rm"))
def _(spark, sf):
    return _round(M.ranking_metrics(T.scored(spark, sf), ["split_name"], rows=T.row_bound(spark, sf)))


@query("MET04_05_probability_metrics", with_(SCORED, """select split_name, count(*) as rows, round(avg((risk_score - fraud_label) ** 2), 9) as brier,
  round(avg(-(fraud_label * ln(greatest(risk_score, 1e-9::double)) + (1 - fraud_label) * ln(greatest(1 - risk_score, 1e-9::double)))), 9) as log_loss from scored group by 1"""))
def _(spark, sf):
    return _round(M.probability_metrics(T.scored(spark, sf), ["split_name"]), ("brier", "log_loss"))


_TOP = """,o as (select *, row_number() over (partition by split_name order by risk_score desc, transaction_timestamp, source_row_id) as rk, count(*) over (partition by split_name) as n, sum(fraud_label) over (partition by split_name) as f from scored),
 k as (select *, greatest(1, ceil(n * top_k)) as k from o, (select unnest([0.005::double, 0.01::double, 0.02::double, 0.05::double, 0.1::double]) as top_k) r),
 tk as (select split_name, top_k, cast(max(k) as bigint) as selected_rows, cast(sum(fraud_label) filter (where rk <= k) as bigint) as fraud_captured, max(n) as n, max(f) as f from k group by 1, 2)"""


@query("MET06_top_k", with_(SCORED, _TOP + " select split_name, top_k, selected_rows, fraud_captured, cast(fraud_captured as double) / f as fraud_capture_rate, cast(fraud_captured as double) / selected_rows as precision, (cast(fraud_captured as double) / selected_rows) / (cast(f as double) / n) as lift from tk"))
def _(spark, sf):
    return M.top_k(T.scored(spark, sf), ["split_name"], rows=T.row_bound(spark, sf))


_TIED = SCORED + ", coarse as (select * replace (floor(risk_score * 10) / 10 as risk_score) from scored)"


@query("MET06_top_k_with_ties", with_(_TIED + _TOP.replace("from scored)", "from coarse)"), "select split_name, top_k, selected_rows, fraud_captured from tk"))
def _(spark, sf):
    coarse = T.scored(spark, sf).withColumn("risk_score", F.floor(F.col("risk_score") * 10) / 10)
    return M.top_k(coarse, ["split_name"], rows=T.row_bound(spark, sf)).select("split_name", "top_k", "selected_rows", "fraud_captured")


@query("MET07_equal_frequency_bins", with_(SCORED, """,r as (select risk_score, fraud_label, row_number() over (order by risk_score, transaction_timestamp, source_row_id) as rk, count(*) over () as n from scored where split_name = 'VALIDATION')
  select cast(greatest(1, ceil(cast((rk - 1) * 10 as double) / (n - 1))) - 1 as int) as bin, count(*) as rows, round(avg(risk_score), 9) as mean_predicted_probability, cast(sum(fraud_label) as double) / count(*) as observed_fraud_rate from r group by 1"""))
def _(spark, sf):
    t = M.equal_frequency_bins(T.scored(spark, sf).where("split_name = 'VALIDATION'"), rows=T.row_bound(spark, sf))
    return _round(t, ("mean_predicted_probability",))


def _rel_sql(right: bool) -> str:
    op = "<" if right else "<="
    return f"""(select (select count(*) from (values (0.1::double), (0.2::double), (0.30000000000000004::double), (0.4::double), (0.5::double), (0.6000000000000001::double), (0.7000000000000001::double), (0.8::double), (0.9::double)) e(x) where x {op} risk_score) as bin, risk_score, fraud_label from scored)"""


@query("MET08_reliability_right_closed", with_(SCORED, f"select cast(bin as int) as bin, count(*) as rows, round(avg(risk_score), 9) as mean_predicted_probability, cast(sum(fraud_label) as double) / count(*) as observed_fraud_rate, round(abs(avg(risk_score) - cast(sum(fraud_label) as double) / count(*)), 9) as bin_gap from {_rel_sql(True)} b group by 1"))
def _(spark, sf):
    return _round(M.reliability(T.scored(spark, sf)), ("mean_predicted_probability", "bin_gap"))


_ECE = "(select sum(gap * rows) / sum(rows) from (select count(*) as rows, abs(avg(risk_score) - avg(fraud_label)) as gap from {} b group by bin) g)"


@query("MET08_calibration_audit", with_(SCORED, f"""select count(*) as rows, round(avg((risk_score - fraud_label) ** 2), 9) as brier_score, round(avg(-(fraud_label * ln(risk_score) + (1 - fraud_label) * ln(1 - risk_score))), 9) as log_loss,
  round({_ECE.format(_rel_sql(True))}, 9) as expected_calibration_error, 'PASS' as status, false as expected_value_enabled from scored"""))
def _(spark, sf):
    return _round(M.calibration_audit(T.scored(spark, sf)), ("brier_score", "log_loss", "expected_calibration_error"))


@query("MET09_calibration_monitor", with_(SCORED, f"""select 'PASS' as status, round(avg((risk_score - fraud_label) ** 2), 9) as brier, round(avg(-(fraud_label * ln(risk_score) + (1 - fraud_label) * ln(1 - risk_score))), 9) as log_loss, round({_ECE.format(_rel_sql(False))}, 9) as ece, count(*) as support from scored
  union all select 'NOT_APPLICABLE', null, null, null, count(*) from scored"""))
def _(spark, sf):
    s = T.scored(spark, sf)
    return _round(M.calibration_monitor(s, "PROBABILITY_USABLE").unionByName(M.calibration_monitor(s, "RANKING_ONLY")), ("brier", "log_loss", "ece"))


_CAPS = ", ".join(f"max(cast(fraud_captured as double) / f) filter (where top_k = {r}::double) as top_{str(f'{r:.3f}').replace('.', '_')}_capture" for r in M.TOP_RATES)


def _perf_sql(key: str, label: str) -> str:
    src = f"(select * replace ({key} as split_name) from scored)"
    ctes = SCORES.replace("from scored group by 1, 2)", f"from {src} q group by 1, 2)") + _TOP.replace("from scored)", f"from {src} q)")
    names = [f"top_{str(f'{r:.3f}').replace('.', '_')}_capture" for r in M.TOP_RATES]
    shown = ", ".join(f"case when fraud_rows >= 30 then {n} end as {n}" for n in names)
    return with_(ctes + f", w as (select split_name, {_CAPS} from tk group by 1)", f"""select split_name as {label}, rows as support, fraud_rows as fraud_support, case when fraud_rows >= 30 then 'PASS' else 'INSUFFICIENT_SUPPORT' end as status, case when fraud_rows >= 30 then round(pr_auc, 9) end as pr_auc,
      case when fraud_rows >= 30 then round(roc_auc, 9) end as roc_auc, case when fraud_rows >= 30 then round(ks_roc, 9) end as ks, prevalence, {shown} from rm join w using (split_name)""")


@query("MET10_performance_by_window", _perf_sql("concat('M-', strftime(transaction_timestamp, '%Y-%m'))", "performance_window_id"))
def _(spark, sf):
    from ..functions import exprs as X

    s = T.scored(spark, sf).withColumn("performance_window_id", X.monitoring_window("transaction_timestamp", "MONTH"))
    return _round(M.performance_by(s, ["performance_window_id"], rows=T.row_bound(spark, sf)))


@query("MET11_outcome_metrics", with_(SCORED, """,x as (select *, cast(round(greatest(amount, 0) * 100) as bigint) as c from scored) select count(*) as transactions, cast(sum(fraud_label) as bigint) as fraud_count, cast(sum(fraud_label) as double) / count(*) as fraud_rate,
  cast(sum(c * fraud_label) as double) / 100 as fraud_positive_exposure, cast(sum(c * fraud_label) as double) / cast(sum(c) as double) as fraud_amount_rate from x"""))
def _(spark, sf):
    return M.outcome_metrics(T.scored(spark, sf))


@query("MET12_subgroup_performance", _perf_sql("channel", "channel"))
def _(spark, sf):
    return _round(M.performance_by(T.scored(spark, sf), ["channel"], rows=T.row_bound(spark, sf)))


# --- models -----------------------------------------------------------------------------------------


_ROW = ["source_row_id", "transaction_timestamp", "split_name", "fraud_label", "base_score"]


def model_rows(spark, sf, features, splits=("DEVELOPMENT",)):
    """Rows of the mart with the inputs that a model reads, written once: samples, windows and weights are all taken from them."""
    from ..functions.scale import stored

    wanted = T.mart(spark, sf, [f for f in FEATURES if f in features], splits)
    return stored(wanted.select(*dict.fromkeys([*_ROW, *features])))


def sampled(rows):
    """Sampled Development rows with their weights, written once because the fit reads them repeatedly."""
    from ..functions.scale import stored

    return S.with_sample_weight(stored(S.sample_negatives(rows)), rows.where("split_name = 'DEVELOPMENT'"))


def training(spark, sf, features=L.FEATURE_SETS["F2"]):
    return sampled(model_rows(spark, sf, features))


def training_and_windows(spark, sf, features=L.FEATURE_SETS["F2"]):
    """Training rows, and the windows of Validation, from one evaluation of the mart."""
    rows = model_rows(spark, sf, features, ("DEVELOPMENT", "VALIDATION"))
    return sampled(rows), windows(rows)


def windows(rows):
    from ..functions.scale import stored

    scopes = stored(S.evaluation_windows(rows, "window_start").where("split_name = 'VALIDATION'"))
    return scopes.where("modeling_scope = 'VALIDATION_CALIBRATION'"), scopes.where("modeling_scope = 'VALIDATION_SELECTION'")


@query("MOD01_feature_sets", with_(MART, " union all ".join(f"select '{n}' as feature_set, '{f}' as feature_name, count({f}) as present_values, 'PASS' as status from mart" for n, fs in L.FEATURE_SETS.items() for f in fs)))
def _(spark, sf):
    """Every input of every feature set, its values counted once."""
    t = C.feature_contract(T.mart(spark, sf), sorted({f for fs in L.FEATURE_SETS.values() for f in fs}))
    sets = F.array_compact(F.array(*[F.when(F.col("feature_name").isin(fs), F.lit(n)) for n, fs in L.FEATURE_SETS.items()]))
    return t.select(F.explode(sets).alias("feature_set"), *t.columns)


@query("DQ40_feature_contract", with_(SCORED, "select 'amount' as feature_name, count(amount) as present_values, 'PASS' as status from scored union all select 'user_id', count(user_id), 'FAIL' from scored union all select 'absent_feature', 0, 'FAIL'"))
def _(spark, sf):
    return C.feature_contract(T.scored(spark, sf), ["amount", "user_id", "absent_feature"])


# Sampled Development rows with weights, in each fold's training days and (fold 0) all of them.
_FOLDED = MART + _TRAIN + """,k as (select count(*) filter (where fraud_label = 0) as full_n from dev),
 tr as (select t.*, case when fraud_label = 0 then greatest(1.0::double, cast(full_n as double) / sampled) else 1.0::double end as w
   from (select mart.*, count(*) filter (where fraud_label = 0) over () as sampled from train join mart using (source_row_id)) t, k),
 dd as (select distinct cast(transaction_timestamp as date) as d from tr), oo as (select d, row_number() over (order by d) - 1 as i, count(*) over () as n from dd),
 places as (select g + 1 as fold, greatest(0, cast(round_even(n * (0.5::double + g * 0.15::double), 0) as int) - 1) as te, case when g = 2 then n - 1 else cast(round_even(n * (0.65::double + g * 0.15::double), 0) as int) - 1 end as ve
   from (select distinct n from oo) x, (values (0), (1), (2)) v(g)),
 folds as (select fold, a.d as train_end, b.d as validation_start, c.d as validation_end from places join oo a on a.i = te join oo b on b.i = te + 1 join oo c on c.i = greatest(ve, te + 1)),
 scoped as (select fold, tr.* from tr join (select fold, train_end from folds union all select 0, date '9999-12-31') f on cast(transaction_timestamp as date) <= train_end)"""

_NUMERIC = [f for f in L.FEATURE_SETS["F2"] if f not in L.CATEGORICAL]
_MEASURED = _FOLDED + f""",
 long as (select fold, fraud_label * w as wy, unnest([{', '.join(f"{{'f': '{f}', 'v': cast({f} as double)}}" for f in _NUMERIC)}], recursive := true) from scoped),
 st as (select fold, f, coalesce(median(v), 0) as med from long group by 1, 2),
 im as (select fold, f, wy, coalesce(v, med) as x, case when v is null then 1.0::double else 0 end as miss from long join st using (fold, f)),
 ms as (select fold, f, avg(x) as mean, stddev_pop(x) as sd, avg(miss) as mm, stddev_pop(miss) as msd from im group by 1, 2),
 sizes as (select fold, f, mean, case when sd <= 1e-9 * greatest(1, abs(mean)) then 1.0::double else sd end as sd, mm, case when msd = 0 then 1.0::double else msd end as msd from ms),
 moments as (select fold, f as coefficient, f as input, sum(wy * (x - mean) / sd) as moment from im join sizes using (fold, f) group by 1, 2
   union all select fold, 'missing_' || f, f, sum(wy * (miss - mm) / msd) from im join sizes using (fold, f) where mm > 0 group by 1, 2, 3
   {' '.join(f"union all select fold, '{f}=' || {f}, '{f}', sum(fraud_label * w) from scoped group by 1, 2" for f in L.CATEGORICAL)}
   union all select fold, 'intercept', 'intercept', sum(fraud_label * w) from scoped group by 1)"""
_SETS = "(values " + ", ".join(f"('{n}', '{f}')" for n in ("F0", "F2") for f in [*L.FEATURE_SETS[n], "intercept"]) + ") s(feature_set, input)"
SETS = {n: L.FEATURE_SETS[n] for n in ("F0", "F2")}


@query("MOD02_design", with_(_MEASURED, "select f as feature_name, round(med, 6) as median_value, mm > 0 as flagged, round(mean, 6) as mean, round(sd, 6) as scale from sizes join st using (fold, f) where fold = 0"))
def _(spark, sf):
    """What missing values become and how inputs are standardised, from the rows that a model learns from."""
    d = designs(training(spark, sf), {"F2": Problem(tuple(L.FEATURE_SETS["F2"]))}, {None: None}, L.CATEGORICAL, rows=T.row_bound(spark, sf))["F2"]
    rows = [(f, d.middle[f], f in d.flagged, m, s) for f, m, s in zip(d.numeric, d.centre, d.scale, strict=False)]
    return _round(spark.createDataFrame(rows, "feature_name string, median_value double, flagged boolean, mean double, scale double"), ("median_value", "mean", "scale"), 6)


def _moments(models: dict, rows_of, weight="sample_weight", c=1.0):
    """One table of the moments of several models over their own training rows."""
    return union_all([m.moments(rows_of(k), weight, c).select(F.lit(k[0]).alias("feature_set"), F.lit(k[1]).alias("fold"), "coefficient", F.round("moment", 5).alias("moment")) for k, m in models.items()])


@query("MOD03_logistic_moments", with_(_MEASURED, f"select feature_set, coefficient, round(moment, 5) as moment from moments join {_SETS} using (input) where fold = 0"))
def _(spark, sf):
    """The fit of both sets, seen by what must hold at the optimum: for each coefficient, the expected and the seen sum over frauds agree."""
    train = training(spark, sf)
    models = L.fit_sets(train, SETS, rows=T.row_bound(spark, sf))
    return _moments({(n, 0): m for n, m in models.items()}, lambda _: train).drop("fold")


@query("MOD04_fold_moments", with_(_MEASURED, f"select feature_set, fold, coefficient, round(moment, 5) as moment from moments join {_SETS} using (input) where fold > 0"))
def _(spark, sf):
    """The same for every fold's models, each with medians, scales and levels of its own training days."""
    train = training(spark, sf)
    inside, _ = L.fold_scopes(train)
    return _moments(L.fit_folds(train, SETS, inside, rows=T.row_bound(spark, sf)), lambda k: train.where(inside[k[1]]))


@query("MOD04_fold_sizes", with_(_FOLDED, """select fold, count(*) filter (where cast(transaction_timestamp as date) <= train_end) as train_rows, cast(sum(fraud_label) filter (where cast(transaction_timestamp as date) <= train_end) as bigint) as train_fraud_rows,
  count(*) filter (where cast(transaction_timestamp as date) between validation_start and validation_end) as validation_rows from tr, folds group by fold"""))
def _(spark, sf):
    train = training(spark, sf, ())
    inside, valid = L.fold_scopes(train)
    counted = train.agg(*[e.alias(f"{n}{k}") for k in inside for n, e in (("t", F.count_if(inside[k])), ("f", F.sum(F.when(inside[k], F.col("fraud_label").cast("long")))), ("v", F.count_if(valid[k])))])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(k).alias("fold"), F.col(f"t{k}").alias("train_rows"), F.col(f"f{k}").alias("train_fraud_rows"), F.col(f"v{k}").alias("validation_rows")) for k in inside])).alias("e")).select("e.*")


_GIVEN_CV = SCORES.replace("from scored group by 1, 2)", "from given group by 1, 2)").replace("st as (", """given as (select 'V' || fold || '-' || feature_set as split_name, score as risk_score, fraud_label
   from (select fold, fraud_label, unnest([{'feature_set': 'F0', 'score': base_score}, {'feature_set': 'F2', 'score': base_score * 0.75::double + fraud_label * 0.25::double}], recursive := true) from tr join folds on cast(transaction_timestamp as date) between validation_start and validation_end) x),
 st as (""")


@query("MOD04_fold_metrics", with_(_FOLDED + "," + _GIVEN_CV[_GIVEN_CV.index("given as"):], """select substr(split_name, 4) as feature_set, cast(substr(split_name, 2, 1) as int) as fold, rows, fraud_rows, round(pr_auc, 9) as pr_auc, round(roc_auc, 9) as roc_auc, round(ks, 9) as ks, 'PASS' as status from rm"""))
def _(spark, sf):
    """Fold metrics of two given scores."""
    train = training(spark, sf, ())
    given = {"F0": F.col("base_score"), "F2": F.col("base_score") * 0.75 + F.col("fraud_label") * F.lit(0.25)}
    return _round(L.fold_metrics(L.stacked(train, given, "feature_set"), L.fold_scopes(train)[1], ["feature_set"], rows=T.row_bound(spark, sf)))


@query("MOD02_03_logistic_scores")
def _(spark, sf):
    train, (_, selection) = training_and_windows(spark, sf)
    model = L.fit(train, L.FEATURE_SETS["F2"])
    return M.ranking_metrics(model.score(selection), score="score", rows=T.row_bound(spark, sf))


@query("MOD04_temporal_cv")
def _(spark, sf):
    return L.temporal_cv(training(spark, sf), SETS, rows=T.row_bound(spark, sf))


# Calibration and selection rows of the given score; coarse scores tie.
_WINDOWED = SCORED + _eval_sql(_LATE) + """,
 cal as (select floor(risk_score * 1000) / 1000 as s, fraud_label as y from scored join ev using (source_row_id) where modeling_scope = 'VALIDATION_CALIBRATION'),
 sel as (select risk_score as s, fraud_label as y from scored join ev using (source_row_id) where modeling_scope = 'VALIDATION_SELECTION'),
 ds as (select s, count(*) as n, sum(y) as p, row_number() over (order by s) as i from cal group by s),
 ac as (select *, sum(n) over (order by i) as cn, sum(p) over (order by i) as cp from ds),
 mm as (select j.i as j, k.i as k, min(cast(k.cp - j.cp + j.p as double) / (k.cn - j.cn + j.n)) over (partition by j.i order by k.i desc) as least from ac j join ac k on k.i >= j.i),
 iso as (select i, s, max(least) as g from ds join mm on j <= i and k = i group by 1, 2)"""


def given_windows(spark, sf):
    """Calibration rows (coarse scores) and selection rows of the given score, written once."""
    from ..functions.scale import cut

    scopes = cut(S.evaluation_windows(T.scored(spark, sf, ("risk_score",), ("VALIDATION",)), "window_start").where("split_name = 'VALIDATION'").select("source_row_id", "risk_score", "fraud_label", "modeling_scope"))
    coarse = F.floor(F.col("risk_score") * 1000) / 1000
    return scopes.where("modeling_scope = 'VALIDATION_CALIBRATION'").withColumn("score", coarse), scopes.where("modeling_scope = 'VALIDATION_SELECTION'").withColumn("score", F.col("risk_score"))


@query("MOD05_isotonic_fit", with_(_WINDOWED, "select s as score, round(g, 9) as probability from iso"))
def _(spark, sf):
    """The calibrated probability of every distinct calibration score. SQL takes the largest of the least mean rates around each score."""
    calibration, _ = given_windows(spark, sf)
    asked = calibration.select("score").distinct()
    return _round(L.isotonic_probability(asked, L.isotonic_blocks(calibration), rows=T.row_bound(spark, sf)), ("probability",))


@query("MOD05_isotonic_selection", with_(_WINDOWED, """,q as (select s, y, (select max(i) from iso b where b.s <= sel.s) as a, (select min(i) from iso b where b.s >= sel.s) as b from sel),
  pr as (select y, case when q.a is null then hi.g when q.b is null or hi.s = lo.s then lo.g else lo.g + (hi.g - lo.g) * ((q.s - lo.s) / (hi.s - lo.s)) end as p from q left join iso lo on lo.i = q.a left join iso hi on hi.i = q.b)
  select count(*) as rows, round(avg((p - y) ** 2), 9) as brier, round(avg(-(y * ln(greatest(p, 1e-9::double)) + (1 - y) * ln(greatest(1 - least(p, 1 - 1e-9::double), 1e-9::double)))), 9) as log_loss from pr"""))
def _(spark, sf):
    """Selection rows between calibration scores get probabilities on the line between them."""
    calibration, selection = given_windows(spark, sf)
    return _round(M.probability_metrics(L.calibrate(calibration, selection, "isotonic", rows=T.row_bound(spark, sf)), probability="probability"), ("brier", "log_loss"))


@query("MOD05_sigmoid_moments", with_(_WINDOWED, "select 'score' as coefficient, round(sum(y * s), 6) as moment from cal union all select 'intercept', cast(sum(y) as double) from cal"))
def _(spark, sf):
    """The sigmoid fit at its optimum; its intercept is free, so probabilities add up to the frauds."""
    calibration, _ = given_windows(spark, sf)
    fitted = L.fit_sigmoid(calibration)
    free = F.when(F.col("coefficient") == "intercept", float(fitted.coefficients[-1])).otherwise(0.0)  # not penalised, so not part of its moment
    return fitted.moments(calibration.withColumn("_one", F.lit(1.0)), "_one", 1.0).select("coefficient", F.round(F.col("moment") - free, 6).alias("moment"))


@query("MOD05_calibration_comparison")
def _(spark, sf):
    train, (calibration, selection) = training_and_windows(spark, sf)
    models = L.fit_sets(train, SETS, rows=T.row_bound(spark, sf))
    return union_all([L.calibration_comparison(m.score(calibration), m.score(selection), rows=T.row_bound(spark, sf)).withColumn("feature_set", F.lit(n)) for n, m in models.items()])


@query("MOD06_importance")
def _(spark, sf):
    train = training(spark, sf)
    models = L.fit_sets(train, SETS, rows=T.row_bound(spark, sf))
    return union_all([L.importance(m, train).withColumn("feature_set", F.lit(n)) for n, m in models.items()])


@query("MOD02_medians", with_(MART, ", ".join(["select 'F2' as feature_set, * from (" + " union all ".join(f"select '{f}' as feature_name, count({f}) as present, median(cast({f} as double)) as median_value from mart where split_name = 'DEVELOPMENT'" for f in L.FEATURE_SETS["F2"] if f not in L.CATEGORICAL) + ") t"])))
def _(spark, sf):
    """The exact medians that missing values of a model input are filled with, over all Development rows."""
    from ..functions import exprs as X
    from ..functions.scale import quantiles, stored

    numeric = [f for f in L.FEATURE_SETS["F2"] if f not in L.CATEGORICAL]
    long = stored(T.mart(spark, sf, [f for f in FEATURES if f in numeric], ("DEVELOPMENT",)).select(*numeric)).selectExpr(X.unpivot_stack([(f"'{f}'", f"double({f})") for f in numeric], ("feature_name", "v")))
    present = long.groupBy("feature_name").agg(F.count("v").alias("present"))
    middle = quantiles(long, "v", [0.5], ["feature_name"], name="q", rows=T.row_bound(spark, sf))
    return present.join(F.broadcast(middle), "feature_name", "left").select(F.lit("F2").alias("feature_set"), "feature_name", "present", F.col("q")[0].alias("median_value"))


def _judged(table):
    """The champion of a table of metrics; what the full set adds stands beside both rows."""
    table = L.champion(table)
    return table.withColumn("_k", F.lit(1)).join(F.broadcast(L.incremental_value(table).withColumn("_k", F.lit(1))), "_k").drop("_k")


@query("MOD07_champion")
def _(spark, sf):
    train, (_, selection) = training_and_windows(spark, sf)
    models = L.fit_sets(train, SETS, rows=T.row_bound(spark, sf))
    scored = L.stacked(selection, {n: m.probability() for n, m in models.items()}, "feature_set")
    return _judged(M.ranking_metrics(scored, ["feature_set"], score="score", rows=T.row_bound(spark, sf)))


_GIVEN = SCORES.replace("from scored group by 1, 2)", "from given group by 1, 2)").replace("st as (", """given as (select feature_set as split_name, score as risk_score, fraud_label
   from (select fraud_label, unnest([{'feature_set': 'F0', 'score': floor(risk_score * 20) / 20}, {'feature_set': 'F2', 'score': risk_score}], recursive := true) from scored where split_name = 'VALIDATION') x),
 st as (""")


@query("MOD07_champion_of_given_scores", with_(_GIVEN + ", d as (select max(pr_auc) filter (where split_name = 'F2') - max(pr_auc) filter (where split_name = 'F0') as delta_pr_auc, max(roc_auc) filter (where split_name = 'F2') - max(roc_auc) filter (where split_name = 'F0') as delta_roc_auc, max(ks) filter (where split_name = 'F2') - max(ks) filter (where split_name = 'F0') as delta_ks from rm)", """
  select split_name as feature_set, rows, fraud_rows, prevalence, round(pr_auc, 9) as pr_auc, round(roc_auc, 9) as roc_auc, round(ks, 9) as ks, round(ks_roc, 9) as ks_roc,
    case when row_number() over (order by pr_auc desc, split_name) = 1 then 'CHAMPION_CANDIDATE' else 'BASELINE' end as selection_status, round(delta_pr_auc, 9) as delta_pr_auc, round(delta_roc_auc, 9) as delta_roc_auc, round(delta_ks, 9) as delta_ks from rm, d"""))
def _(spark, sf):
    """The choice between a coarse and a fine given score."""
    s = T.scored(spark, sf).where("split_name = 'VALIDATION'")
    scored = L.stacked(s, {"F0": F.floor(F.col("risk_score") * 20) / 20, "F2": F.col("risk_score")}, "feature_set")
    table = _judged(M.ranking_metrics(scored, ["feature_set"], score="score", rows=T.row_bound(spark, sf)))
    return _round(table, ("pr_auc", "roc_auc", "ks", "ks_roc", "delta_pr_auc", "delta_roc_auc", "delta_ks"))
