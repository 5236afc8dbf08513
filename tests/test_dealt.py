"""Rows dealt out by size: what a task sorts does not grow with the input, and lines are sorted once before they meet their order."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from swipewatch.functions import scale
from swipewatch.operators import behavior as B
from swipewatch.operators import metrics as M
from swipewatch.plans import tables as T

DAYS = {"DEVELOPMENT": dt.datetime(1998, 3, 1), "VALIDATION": dt.datetime(2000, 1, 1), "OUT_OF_TIME_OOT": dt.datetime(2001, 1, 1)}


def write(spark, folder, orders):
    """Three lines of each order, two of them with one number."""
    at = dt.datetime(1998, 1, 1)
    lines = [(o, 5 + i, 1, 1 + i // 2, 4.0, 10.0 * (i + 1), 0.0, 0.1, "A", "O", at) for o in sorted({o for o, _, _ in orders}) for i in range(3)]
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame(lines, columns).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(1, 1)], "s_suppkey long, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame([(1, "here")], "n_nationkey int, n_name string").write.parquet(f"{folder}/nation.parquet")
    return str(folder)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dealt_takes_more_tasks_for_more_rows(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 10)
    assert scale.dealt(df, ["k"], 100, dealt_rows=5).rdd.getNumPartitions() == 20
    assert "REPARTITION_BY_COL" in plan_of(scale.dealt(df, ["k"], 100)) and "REPARTITION_BY_COL" in plan_of(scale.dealt(df, ["k"]))
    assert sorted(scale.dealt(df, ["k"], 100, dealt_rows=5).collect()) == sorted(df.collect())


def test_lines_are_sorted_once_and_dealt_by_their_number(spark, tmp_path, monkeypatch):
    folder = write(spark, tmp_path, [(o, 7, DAYS["DEVELOPMENT"]) for o in range(1, 5)])
    monkeypatch.setattr(T, "row_bound", lambda *_: 100 * scale.DEALT_ROWS)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(T.transactions(spark, folder).select("source_row_id", "user_id"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "hashpartitioning(l_orderkey" in plan and ", 100), REPARTITION_BY_NUM" in plan
    assert sum("Sort [l_orderkey" in line for line in plan.splitlines()) == 1


@pytest.mark.parametrize("copies", [1, 2])
def test_ids_are_different_whether_orders_repeat_or_not(spark, tmp_path, copies):
    folder = write(spark, tmp_path, [(o, 7, DAYS["DEVELOPMENT"]) for o in (1, 2)] * copies)
    found = sorted(r["source_row_id"] for r in T.transactions(spark, folder).collect())
    assert found == sorted((o * 8 + number) * T.LINES_A_PAIR + i for o in (1, 2) for number, lines in ((1, 2), (2, 1)) for i in range(lines * copies))


def test_users_are_dealt_by_the_number_of_rows(spark):
    rows = [(i, dt.datetime(1998, 1, 1 + i), 1, 0, 1, "x", 1, 1, 2.0) for i in range(3)]
    df = spark.createDataFrame(rows, "source_row_id long, transaction_timestamp timestamp_ntz, user_id long, card_key int, merchant_id_raw long, merchant_state string, merchant_category_code int, use_chip int, amount double")
    made = B.behavior_features(df, rows=scale.TASK_ROWS, features=["card_merchant_is_new", "merchant_cold_start"])
    plan = plan_of(made)
    assert 8 * scale.DEALT_ROWS > scale.TASK_ROWS and "REPARTITION_BY_COL" in plan
    few = B.behavior_features(df, rows=scale.DEALT_ROWS * 9, task_rows=scale.DEALT_ROWS * 9, features=["card_merchant_is_new", "merchant_cold_start"])
    assert plan_of(few).count(", 9), REPARTITION_BY_NUM") == 2
    assert sorted(few.select(*made.columns).collect()) == sorted(made.collect())


def test_score_cells_are_made_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(M, "stored", lambda df: kept.append(1) or scale.stored(df))
    df = spark.createDataFrame([("a", 0.1 * i, i % 2) for i in range(9)], "g string, risk_score double, fraud_label int")
    assert M.ranking_metrics(df, ["g"], task_rows=2).collect() == M.ranking_metrics(df, ["g"], rows=9).collect()
    assert len(kept) == 1
