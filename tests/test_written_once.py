"""What is dealt out or written, and how often: orders with their lines, ranges in compressed columns, rows of a replay."""

from pyspark.sql import functions as F

from swipewatch.functions import scale
from swipewatch.operators import monitor as N
from swipewatch.plans import monitor_queries as Q
from swipewatch.plans import tables as T
from test_dealt import DAYS, plan_of, write


def test_orders_are_dealt_once_as_their_lines(spark, tmp_path, monkeypatch):
    folder = write(spark, tmp_path, [(o, 7, DAYS["DEVELOPMENT"]) for o in range(1, 5)])
    monkeypatch.setattr(T, "row_bound", lambda *_: 100 * scale.DEALT_ROWS)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(T.transactions(spark, folder).select("source_row_id", "user_id"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    dealt = [line for line in plan.splitlines() if "hashpartitioning(o_orderkey" in line]
    assert len(dealt) == 1 and ", 100)" in dealt[0]


def test_ranges_are_written_in_compressed_columns(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(scale, "stored", lambda df, real=scale.stored: kept.append(df.columns) or real(df))
    df = spark.range(90).select(F.when(F.col("id") % 7 != 0, F.col("id") % 3).alias("k"), F.col("id"), (F.col("id") % 10).cast("decimal(38,0)").alias("v"))
    args = (["k"], [F.desc("id")], {"s": ("v", "sum"), "m": ("id", "max")})
    plain, ranged = scale.prefix(df, *args, rows=90), scale.prefix(df, *args, task_rows=5)
    assert sorted(plain.collect(), key=str) == sorted(ranged.collect(), key=str)
    assert kept == [["k", "id", "v", "_range"]]


def test_rows_of_a_replay_are_written_once(spark, tmp_path, monkeypatch):
    folder = write(spark, tmp_path, [(o, 7, DAYS[s]) for o, s in enumerate(("VALIDATION", "OUT_OF_TIME_OOT"), 1)])
    written = []
    monkeypatch.setattr(N, "stored", lambda df: written.append(df.columns) or scale.stored(df))
    tables = Q._replayed(spark, folder)
    assert len(written) == 1 and "action" not in written[0]  # the reference's inputs
    full = Q._labelled(spark, folder)
    again = N.replay(full, N.build_baseline(full, rows=6), rows=6)
    assert {n: sorted(t.collect(), key=str) for n, t in tables.items()} == {n: sorted(t.collect(), key=str) for n, t in again.items()}


def test_windows_of_labelled_rows_are_not_dealt_out(spark, tmp_path, monkeypatch):
    folder = write(spark, tmp_path, [(o, 7, DAYS[s]) for o, s in enumerate(("VALIDATION", "OUT_OF_TIME_OOT"), 1)])
    sides = []
    monkeypatch.setattr(Q, "dealt", lambda df, *rest: sides.append(df.columns) or scale.dealt(df, *rest))
    found = Q._labelled(spark, folder)
    assert "operational_window_id" not in sides[0] and {"operational_window_id", "drift_window_id", "performance_window_id", "policy_version"} < set(found.columns)
    assert found.columns == ["source_row_id", *[c for c in Q.monitored(spark, folder).columns if c != "source_row_id"], "fraud_label"]
