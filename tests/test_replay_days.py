"""Reports from merged counts of days equal those from the rows of all days."""

import pytest
from pyspark.sql import functions as F

from swipewatch.functions.scale import quantiles
from swipewatch.operators import metrics as M
from swipewatch.operators import monitor as N
from swipewatch.operators import replay_days as R
from swipewatch.operators import splits as S
from swipewatch.plans import monitor_queries as Q
from swipewatch.plans import tables as T


def table(df):
    columns = sorted(df.columns)
    return sorted((tuple(round(r[c], 8) if isinstance(r[c], float) else r[c] for c in columns) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    s = Q.monitored(spark, sf_dir).join(T.scored(spark, sf_dir).select("source_row_id", "fraud_label"), "source_row_id").where("source_row_id % 3 <> 1")
    pair = F.pmod(F.xxhash64("source_row_id"), F.lit(400))
    odd = pair < 40
    # nulls, NaN and infinite values, an unknown action and a second policy version
    s = s.withColumns({
        "amount": F.when(odd & (pair % 4 == 0), float("nan")).when(odd & (pair % 4 == 1), float("inf")).when(odd, None).otherwise(F.col("amount")),
        "channel": F.when(odd, None).otherwise(F.col("channel")), "pair_new": F.when(odd, None).otherwise(F.col("pair_new")), "graph_auto_block": pair % 20 == 1,
        "action": F.when(F.col("source_row_id") % 301 == 0, "maybe").otherwise(F.col("action")), "policy_version": F.when(F.col("source_row_id") % 211 == 0, "P2").otherwise("P1")})
    return s.cache()


def test_days_add_up_to_the_whole(spark, rows):
    baseline = {k: v.cache() for k, v in N.build_baseline(rows, rows=10_000).items()}
    observed = S.observation_rows(rows)
    whole = N.replay(rows, baseline, rows=10_000)
    days = [r[0] for r in observed.select(R.DAY).distinct().orderBy(R.DAY).collect()]
    third = len(days) // 3
    cells = R.day_cells(observed.where(F.col(R.DAY) < days[third])).cache()
    cells = R.merged(cells, R.day_cells(observed.where(F.col(R.DAY).between(days[third], days[2 * third])))).cache()
    cells = R.merged(cells, R.day_cells(observed.where(F.col(R.DAY) >= days[2 * third]))).cache()  # one day is counted again
    by_days = R.reports(cells, baseline, rows=10_000)
    for name in ("windows", "policy", "graph", "segments", "feature_drift", "novelty", "score", "alerts"):
        assert table(by_days[name].select(*whole[name].columns)) == table(whole[name]), name
    assert {r.status for r in by_days["policy"].collect()} == {"PASS", "FAIL"} and by_days["graph"].where("graph_auto_block").count() > 0
    assert table(by_days["ranking"]) == table(M.ranking_metrics(observed, ["performance_window_id"], rows=10_000))
    assert set(R.as_measures(by_days).columns) == {"report", "item", "measure", "value"}


def test_without_labels_or_actions_and_without_rows(spark, rows):
    observed = S.observation_rows(rows).drop("fraud_label", "action", "candidate_action", "policy_version")
    cells = R.day_cells(observed)
    assert cells.where("fraud is not null or labelled <> 0").count() == 0 and cells.where("family in ('action', 'policy_version')").count() == 0
    baseline = N.build_baseline(rows, rows=10_000)
    assert R.reports(cells, baseline, rows=10_000)["ranking"].count() == 0
    none = R.reports(R.day_cells(observed.limit(0)), baseline, rows=10_000)
    assert all(none[name].count() == 0 for name in ("windows", "policy", "graph", "segments"))


def test_weighted_quantiles_count_rows_as_often_as_told(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 2.0, 1), ("a", 9.0, 2), ("b", 5.0, 4), ("b", None, 7)], "g string, v double, n long")
    plain = df.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    want = {r.g: r.q for r in quantiles(plain, "v", [0.1, 0.5, 0.77], ["g"], name="q", rows=100).collect()}
    for bounds in ({"rows": 100}, {"task_rows": 0}):
        assert {r.g: pytest.approx(r.q) for r in quantiles(df, "v", [0.1, 0.5, 0.77], ["g"], name="q", weight="n", **bounds).collect()} == want
