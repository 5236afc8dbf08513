"""The mart with the features and splits that a query reads, and what is made from it once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from swipewatch.operators import behavior as B
from swipewatch.operators import drift as D
from swipewatch.plans import monitor_queries as Q
from swipewatch.plans import tables as T


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    """Small tables with orders in every split, one without a time and two of one number; parts, customers and flags are missing in places, and
    the ids of line 9 are those of line 1 of the next order."""
    at = str(tmp_path_factory.mktemp("given"))
    days = [dt.datetime(1999, 8, 9) + dt.timedelta(days=30 * i) for i in range(18)]
    orders = [(i, i % 3 if i % 7 else None, d) for i, d in enumerate(days)] + [(18, 1, None), (3, 2, days[4])]
    line = [(o, 10 + (o * 5 + n) % 30 if n % 4 else None, (o + n) % 4, n, float(n * 12), 100.5 * n, 0.0 if n % 2 else 0.05, 0.01, ("A", "N", "R", "X", None)[(o + n) % 5], "FO"[n % 2], days[0]) for o in range(19) for n in (1, 2, 3, 4, 9)]
    tables = {
        "lineitem": (line, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"), "supplier": ([(i, i % 2) for i in range(4)], "s_suppkey long, s_nationkey long"), "nation": ([(0, "A"), (1, None)], "n_nationkey long, n_name string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return at


def rows_of(df, *columns):
    return sorted(map(repr, df.select(*columns).collect()))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("splits", [("DEVELOPMENT",), ("VALIDATION",), ("DEVELOPMENT", "VALIDATION"), ("OUT_OF_TIME_OOT",)])
def test_rows_after_the_wanted_splits_change_nothing(spark, given, splits):
    whole, part = T.mart(spark, given), T.mart(spark, given, splits=splits)
    assert whole.columns == part.columns
    wanted = rows_of(whole.where(F.col("split_name").isin(*splits)), *whole.columns)
    assert wanted and rows_of(part, *whole.columns) == wanted


def test_codes_keep_the_groups_of_their_texts(spark, given):
    """Features over codes equal those over the named columns."""
    named = B.behavior_features(T.model_splits(spark, given), rows=1000)
    assert rows_of(T.mart(spark, given), "source_row_id", *B.FEATURES, "state_missing_flag") == rows_of(named, "source_row_id", *B.FEATURES, "state_missing_flag")


def test_some_features_equal_those_of_all(spark, given):
    some = ["card_cold_start", "user_merchant_prior_txn_count", "current_positive_amount_user_z"]
    assert rows_of(T.mart(spark, given, some), "source_row_id", *some) == rows_of(T.mart(spark, given), "source_row_id", *some)
    timed = T._coded(spark, given).where("transaction_timestamp is not null")
    assert rows_of(B.behavior_features(timed, task_rows=1, features=some), "source_row_id", *some) == rows_of(B.behavior_features(timed, rows=1000), "source_row_id", *some)
    assert all(B.keys_of(f) in B.FAMILIES for f in B.FEATURES) and B.keys_of("user_merchant_is_new") == "user_merchant"


def test_rows_are_not_dealt_out_for_features_that_nothing_reads(spark, given):
    score = T.scored(spark, given, ("risk_score",))
    assert "RepartitionByExpression" not in plan(score.select("split_name", "risk_score")) and "pair_new" not in score.columns
    assert "RepartitionByExpression" in plan(T.mart(spark, given).select("split_name", "base_score"))  # what a query that names nothing pays
    assert rows_of(score, "source_row_id", "risk_score", "state_missing_flag") == rows_of(T.scored(spark, given), "source_row_id", "risk_score", "state_missing_flag")


def test_labels_meet_rows_that_a_replay_reads(spark, given):
    labelled = Q._labelled(spark, given)
    assert {r["split_name"] for r in labelled.select("split_name").distinct().collect()} == {"VALIDATION", "OUT_OF_TIME_OOT"}  # Development rows too before
    scored = T.scored(spark, given)
    joined = scored.where("split_name <> 'DEVELOPMENT'").drop("fraud_label").join(scored.select("source_row_id", "fraud_label"), "source_row_id")
    assert joined.count() > joined.distinct().count() or joined.count() > scored.where("split_name <> 'DEVELOPMENT'").count()  # ids repeat
    assert rows_of(labelled, "source_row_id", "amount", "fraud_label") == rows_of(joined, "source_row_id", "amount", "fraud_label")


def test_a_reference_finds_its_quantiles_once(spark, monkeypatch):
    df = spark.createDataFrame([(float(i * i % 97), i % 2) for i in range(300)], "risk_score double, flag int")
    asked = []
    found = D.quantiles
    monkeypatch.setattr(D, "quantiles", lambda df, value, probs, *rest, **more: asked.append(list(probs)) or found(df, value, probs, *rest, **more))
    got = {r["feature_name"]: r for r in D.numeric_reference(df, ["risk_score", "flag"], rows=300).collect()}
    assert len(asked) == 1
    monkeypatch.undo()
    assert [got["risk_score"]["bin_edges"], got["flag"]["bin_edges"]] == [D.frozen_bins(df, ["risk_score", "flag"], rows=300)[f] for f in ("risk_score", "flag")]
    exact = df.select(F.percentile("risk_score", F.array(*[F.lit(p) for p in D.FEATURE_QUANTILES]))).first()[0]
    assert got["risk_score"]["quantiles"] == pytest.approx(exact)
