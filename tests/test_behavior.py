"""Golden point-in-time case and invariances of the features."""

from helpers import by_id
from pyspark.sql import functions as F

from swipewatch.operators import behavior as B
from swipewatch.operators import quality as Q
from swipewatch.plans import tables as T

PIT = [
    (1, "2020-01-01 09:00:00", 1, "1:0", "M1", "5411", "Swipe", "CA", 10.0), (2, "2020-01-01 09:59:59", 1, "1:0", "M1", "5411", "Swipe", "CA", 20.0),
    (3, "2020-01-01 10:00:00", 1, "1:0", "M1", "5411", "Swipe", "CA", 30.0), (4, "2020-01-01 10:00:00", 1, "1:0", "M2", "5999", "Online", None, 0.0),
    (5, "2020-01-01 10:00:01", 1, "1:0", "M3", "5732", "Online", "NY", -5.0), (6, "2020-01-01 11:00:00", 1, "1:0", "M4", "5311", "Online", "CA", 40.0),
    (7, "2020-01-01 11:00:01", 1, "1:0", "M5", "5812", "Online", "CA", 50.0), (8, "2020-01-02 10:00:00", 1, "1:0", "M1", "5411", "Swipe", "CA", 60.0),
    (9, "2020-01-02 10:00:00", 2, "2:0", "M9", "5411", "Online", None, 15.0), (10, "2020-01-02 10:00:00", 2, "2:0", "M10", "5812", "Online", None, 15.0),
]
COLUMNS = ["source_row_id", "ts", "user_id", "card_key", "merchant_id_raw", "merchant_category_code", "use_chip", "merchant_state", "amount"]


def pit(spark):
    return spark.createDataFrame(PIT, COLUMNS).withColumn("transaction_timestamp", F.to_timestamp_ntz("ts")).drop("ts")


def check_golden(features):
    f = {r["source_row_id"]: r for r in features.collect()}
    assert [f[i]["user_prior_txn_count"] for i in range(1, 7)] == [0, 1, 2, 2, 4, 5]
    assert [f[i]["user_txn_count_1h"] for i in range(1, 8)] == [0, 1, 2, 2, 3, 3, 2]
    assert f[1]["user_cold_start"] == 1 and f[1]["user_seconds_since_prev_txn"] is None
    assert f[4]["user_merchant_is_new"] == 1 and f[4]["user_channel_prior_txn_count"] == 0
    assert f[5]["current_positive_amount"] is False and f[4]["current_positive_amount"] is False
    assert f[4]["state_missing_flag"] == 1 and f[8]["user_merchant_prior_txn_count"] == 3
    assert f[6]["user_positive_amount_sum_24h"] == 60.0 and f[6]["user_prior_positive_amount_mean"] == 20.0
    assert f[6]["user_prior_positive_amount_std"] == 10.0 and f[6]["current_positive_amount_vs_user_mean"] == 2.0
    assert f[6]["current_positive_amount_user_z"] is None
    assert abs(f[8]["current_positive_amount_user_z"] - (60 - 30) / 15.811388300841896) < 1e-12
    # Both events of user 2 share an instant, so neither sees the other.
    assert f[9]["user_prior_txn_count"] == f[10]["user_prior_txn_count"] == 0


def test_golden_case(spark):
    check_golden(B.behavior_features(pit(spark), rows=10))


def test_golden_case_when_every_key_is_hot(spark):
    check_golden(B.behavior_features(pit(spark), task_rows=1))


def test_there_are_43_features_in_ten_families():
    assert len(B.FEATURES) == 43 and len(set(B.FEATURES)) == 43 and len(set(B.FEATURE_FAMILIES.values())) == 10


def test_later_rows_do_not_change_earlier_features(spark, sf_dir):
    source = T.model_splits(spark, sf_dir)
    early = source.where("transaction_timestamp < timestamp_ntz'1998-06-01 00:00:00'")
    alone = by_id(B.behavior_features(early, rows=10_000), *B.FEATURES)
    whole = by_id(B.behavior_features(source, rows=10_000).where("transaction_timestamp < timestamp_ntz'1998-06-01 00:00:00'"), *B.FEATURES)
    assert alone and alone == whole


def test_invariants_hold(spark, sf_dir):
    assert [r["check_name"] for r in Q.semantic_invariants(T.mart(spark, sf_dir)).where("violations > 0").collect()] == []


def test_label_is_not_needed(spark):
    assert "fraud_label" not in B.behavior_features(pit(spark), rows=10).columns


def test_every_feature_layer_is_checked_for_repeated_rows(spark):
    layers = B.feature_layers(pit(spark))
    assert len(layers) == 9 and sorted(f for x in layers.values() for f in x.columns[1:]) == sorted(B.FEATURES)
    mart = by_id(B.behavior_features(pit(spark)), *B.FEATURES)
    for task_rows in (1, 1000):  # 1: every key is hot
        for layer in B.feature_layers(pit(spark), task_rows=task_rows).values():
            own = layer.columns[1:]
            assert by_id(layer, *own) == {i: tuple(r[B.FEATURES.index(f)] for f in own) for i, r in mart.items()}
        twice = pit(spark).unionByName(pit(spark).where("source_row_id <= 3"))
        found = Q.no_join_explosion(B.feature_layers(twice, task_rows=task_rows)).collect()
        assert len(found) == 9 and {(r["rows"], r["distinct_source_row_id"], r["duplicate_source_row_id"], r["status"]) for r in found} == {(13, 10, 3, "FAIL")}


def test_all_twelve_layers_equal_sql(spark, sf_dir):
    import __spark_entry__ as entry
    from oracle_check import compare, duck

    name = "DQ24_no_join_explosion_all_layers"
    ok, note, _ = compare(spark, duck(sf_dir), sf_dir, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok and note == "12 rows", note
