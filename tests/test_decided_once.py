"""Decided rows: scored rows are written once, labels meet decisions in tasks by the number of rows, ranks are joined once a score."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from swipewatch.functions import scale
from swipewatch.operators import economics as E
from swipewatch.operators import policy as P
from swipewatch.plans import all_queries
from swipewatch.plans import monitor_queries as Q
from swipewatch.plans import policy_queries as K
from swipewatch.plans import tables as T
from test_dealt import DAYS, plan_of, write


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("decided"), [(o, o % 3, day) for o, day in enumerate([*DAYS.values()] * 20, 1)])


@pytest.mark.parametrize("name", ["POL15_action_metrics", "POL16_daily_action_metrics", "POL19_metric_delta", "ECO01_economics", "ECO02_daily_economics", "ECO03_segment_economics", "MON28_review_monitor"])
def test_scored_rows_are_made_once(spark, given, monkeypatch, name):
    asked, kept = [], []
    monkeypatch.setattr(T, "scored", lambda spark, sf, columns=None, splits=(), real=T.scored: asked.append(columns) or real(spark, sf, columns, splits))
    monkeypatch.setattr(K, "stored", lambda df: kept.append(df.columns) or scale.stored(df))
    all_queries().QUERIES[name](spark, given).collect()
    more = ("channel", "pair_new", "cold_card", "new_merchant") if name.startswith("ECO03") else ()
    assert asked == [more] and kept == [[*K._EVALUATED, *more]]


def test_queues_of_narrow_rows_equal_those_of_all_columns(spark, given):
    wide = K.decided(spark, given)
    narrow = K.evaluated(spark, given)
    shown = ["source_row_id", "action", "bucket_selected", "overflow", "review_rank"]
    assert sorted(narrow.select(*shown).collect()) == sorted(wide.select(*shown).collect()) and {"REVIEW", "ALLOW"} <= {r["candidate_action"] for r in wide.collect()}
    reviewed = Q.reviewed(spark, given)
    assert sorted(map(repr, reviewed.collect())) == sorted(map(repr, Q.monitored(spark, given).select(*reviewed.columns).collect()))


def test_labels_meet_decisions_in_tasks_by_the_number_of_rows(spark):
    at = dt.datetime(1998, 1, 1)
    decisions = spark.createDataFrame([(i, at, "ALLOW", 1.0) for i in range(5)], "source_row_id long, transaction_timestamp timestamp_ntz, action string, positive_exposure double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "source_row_id long, fraud_label int")
    many = E.join_labels(decisions, labels, rows=9 * scale.DEALT_ROWS)
    assert plan_of(many).count(", 9), REPARTITION_BY_NUM") == 2
    assert sorted(many.collect()) == sorted(E.join_labels(decisions, labels).collect())
    with pytest.raises(Exception, match="exactly once"):
        E.join_labels(decisions, labels.limit(3), rows=9 * scale.DEALT_ROWS).collect()


def test_ranks_are_not_repeated_to_join_them(spark):
    df = spark.range(300).select("id", (F.when(F.col("id") < 200, 7) .otherwise(F.col("id"))).cast("double").alias("risk_score"))
    found = P.with_rank(df, [], task_rows=50, most=10)
    assert "explode" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sorted(found.select("id", "_pct").collect()) == sorted(P.with_rank(df, [], rows=300).select("id", "_pct").collect())
