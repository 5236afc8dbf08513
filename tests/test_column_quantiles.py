"""Quantiles of many columns without a row for each column and value."""

import math

import pytest
from pyspark.sql import functions as F

from swipewatch.functions import scale
from swipewatch.operators import profiling as R
from swipewatch.operators.behavior import FEATURES


def table(spark, n=3000):
    """Continuous, tied, skewed, half missing, missing, infinite and whole columns in three groups, one without a name."""
    i = F.col("id")
    return spark.range(n).select(
        F.when(i % 3 > 0, (i % 3).cast("string")).alias("g"), ((i * 7919) % 10007 / 7).alias("a"), (i % 2).cast("int").alias("b"), F.exp((i * 31 % 997) / 50).alias("c"),
        F.when(i % 2 == 0, -(i * 17 % 101).cast("double")).otherwise(F.when(i % 5 == 0, float("nan"))).alias("d"), F.lit(None).cast("double").alias("e"),
        F.when(i % 10 < 6, float("inf")).otherwise(-math.inf).alias("f"), F.when((i % 3 == 1) & (i < 7), i).alias("h"), *[(i * (j + 3) % 19).alias(f"x{j}") for j in range(12)])


def by_hand(values, prob):
    at = prob * (len(values) - 1)
    a, b = values[math.floor(at)], values[math.ceil(at)]
    return a if a == b else a + (b - a) * (at - math.floor(at))


@pytest.mark.parametrize("sketch", [5, 10**6])
@pytest.mark.parametrize("prob", [0.0, 0.37, 0.5, 1.0])
def test_equal_to_sorted_values(spark, monkeypatch, sketch, prob):
    """A sketch of five rows gives bounds that miss; counts notice."""
    df, names = table(spark), ["a", "b", "c", "d", "e", "f", "h", *[f"x{j}" for j in range(12)]]
    monkeypatch.setattr(scale, "SKETCH_ROWS", sketch)
    rows = df.collect()
    for by in ([], ["g"]):
        found = scale.column_quantiles(df, names, prob, by, more=lambda c: {"top": F.max(c)})
        groups = {tuple(r[b] for b in by) for r in rows}
        assert set(found) == {(*g, c) for g in groups for c in names}
        for key, got in found.items():
            mine = [float(r[key[-1]]) for r in rows if tuple(r[b] for b in by) == key[:-1] and r[key[-1]] is not None]
            mine = [v for v in mine if not math.isnan(v)]
            assert got["k"] == len(mine) and got["n"] == sum(tuple(r[b] for b in by) == key[:-1] for r in rows)
            assert got["q"] == (pytest.approx(by_hand(sorted(mine), prob), rel=1e-9) if mine else None)


def test_no_rows(spark):
    assert scale.column_quantiles(table(spark).limit(0), ["a"], 0.5) == {("a",): {"n": 0, "k": 0, "q": None}}
    assert scale.column_quantiles(table(spark).limit(0), ["a"], 0.5, ["g"]) == {}


def test_a_profile_repeats_no_row_for_each_feature(spark, monkeypatch):
    mart = spark.range(500).select(*[F.when(F.col("id") % (i + 2) > 0, (F.col("id") * (i + 3)) % 97 / (i % 3 + 1)).alias(f) if R._fractional(f) else ((F.col("id") * (i + 3)) % 97).alias(f) for i, f in enumerate(FEATURES)])
    plain = R.distribution_profile(mart, rows=500)
    monkeypatch.setattr(R, "quantiles", None)  # the long form
    assert sorted(map(repr, R.distribution_profile(mart, rows=500, task_rows=1).collect())) == sorted(map(repr, plain.collect()))
