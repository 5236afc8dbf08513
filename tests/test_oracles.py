"""A query of each area against its SQL on the smallest tables; ``oracle_check.py`` runs all of them."""

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry

SAMPLE = [
    "PRJ01_05_standardize", "DQ07_duplicate_audit", "DQ10_artifact_screen", "SPL05_sample_negatives_tight", "SPL11_temporal_folds", "AGG05_channel_risk", "AGG13_concentration",
    "AGG15_segment_priority", "WIN02_08_event_velocity", "PRO04_numeric_signal", "MET06_top_k_with_ties", "POL03_06_queue_amount_graph", "ECO03_segment_economics", "MON21_numeric_feature_drift", "MON31_segment_monitor",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf_dir, name):
    ok, note, _ = compare(spark, duck(sf_dir), sf_dir, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 200


def test_entry_is_the_feature_mart(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "card_merchant_is_new" in df.columns
