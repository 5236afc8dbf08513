"""Newton fits against plain numpy, isotonic fits against the min-max formula."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from swipewatch.operators import logistic as G
from swipewatch.operators import metrics as M
from swipewatch.operators import modeling as L
from swipewatch.operators import policy as P
from swipewatch.operators import splits as S
from swipewatch.operators.isotonic import isotonic_blocks, isotonic_probability


def rows(spark, n=400):
    return spark.range(n).select(
        F.col("id").alias("source_row_id"), F.when(F.col("id") % 4 == 0, None).otherwise((F.col("id") % 100).cast("double")).alias("amount"),
        F.when(F.col("id") % 2 == 0, "Online Transaction").when(F.col("id") % 7 != 1, "Chip Transaction").alias("use_chip"), F.lit("5411").alias("merchant_category_code"),
        (F.col("id") % 5 == 0).cast("int").alias("state_missing_flag"), ((F.col("id") % 100 > 70) & (F.col("id") % 2 == 0) | (F.col("id") % 37 == 5)).cast("int").alias("fraud_label"),
        F.date_add(F.lit("2020-01-01"), (F.col("id") % 40).cast("int")).cast("timestamp_ntz").alias("transaction_timestamp"))


def weighted(df, w=3.0):
    return df.withColumn("sample_weight", F.when(F.col("fraud_label") == 0, w).otherwise(1.0))


def by_hand(table, use, c=1.0):
    """The same model from first principles: matrix, plain Newton."""
    amount = np.array([np.nan if r.amount is None else r.amount for r in table])
    filled = np.where(np.isnan(amount), np.nanmedian(amount), amount)
    z = lambda x: (x - x.mean()) / (x.std() or 1)
    chips = [r.use_chip for r in table]
    seen = [v for v in chips if v]
    common = max(sorted(set(seen)), key=seen.count)
    x = np.column_stack([z(filled), z(np.array([float(r.state_missing_flag) for r in table])), z(np.isnan(amount).astype(float)), *[[float((v or common) == level) for v in chips] for level in sorted(set(seen))], np.ones(len(table)), np.ones(len(table))])
    y, w = np.array([r.fraud_label for r in table], float), np.array([r.sample_weight for r in table])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        b -= np.linalg.solve(np.eye(len(b)) + c * x.T @ (x * (w * p * (1 - p))[:, None]), b + c * x.T @ (w * (p - y)))
    return b, 1 / (1 + np.exp(-x @ b))


@pytest.mark.parametrize("parts", [1, 40])
def test_newton_steps_over_tasks_find_the_optimum(spark, parts):
    df = weighted(rows(spark)).repartition(parts)
    model = L.fit(df, L.FEATURE_SETS["F0"], c=0.7)
    table = df.orderBy("source_row_id").collect()
    b, p = by_hand(table, L.FEATURE_SETS["F0"], 0.7)
    assert np.allclose(model.coefficients, b, atol=1e-8) and model.movement <= G.STEP_AT_MOST and model.design.flagged == ["amount"]
    got = [r.score for r in model.score(df).orderBy("source_row_id").collect()]
    assert np.allclose(got, p, atol=1e-9)
    seen = dict(zip(model.design.names, np.round(_moments_by_hand(table, model), 6), strict=True))
    assert {r.coefficient: round(r.moment, 6) for r in model.moments(df, "sample_weight", 0.7).collect()} == pytest.approx(seen)


def _moments_by_hand(table, model):
    numbers = {f: np.array([np.nan if r[f] is None else float(r[f]) for r in table]) for f in model.design.numeric}
    words = {f: (np.arange(len(table)), [r[f] for r in table]) for f in model.design.levels}
    return model.design.matrix(numbers, words).T @ np.array([r.fraud_label * r.sample_weight for r in table])


def test_a_separable_table_converges_by_halved_steps(spark):
    df = spark.range(60).select((F.col("id") * 1e6).alias("amount"), (F.col("id") > 30).cast("int").alias("fraud_label"), F.lit(1.0).alias("sample_weight"))
    model = G.fit_all(df, {"a": G.Problem(("amount",))}, weight="sample_weight", c=1e6)["a"]
    assert M.ranking_metrics(model.score(df), score="score", rows=60).first()["roc_auc"] == 1.0


def test_folds_and_sets_share_passes_and_equal_separate_fits(spark):
    df = weighted(rows(spark)).repartition(5)
    inside, valid = L.fold_scopes(df)
    assert len(inside) == len(valid) == 3
    together = L.fit_folds(df, {"F0": L.FEATURE_SETS["F0"], "one": ["amount"]}, inside)
    for k in inside:
        alone = L.fit(df.where(inside[k]), L.FEATURE_SETS["F0"])
        assert together["F0", k].design.names == alone.design.names and np.allclose(together["F0", k].design.scale, alone.design.scale)
        assert np.allclose(together["F0", k].coefficients, alone.coefficients, atol=1e-9)
    cv = L.temporal_cv(df, {"F0": L.FEATURE_SETS["F0"], "one": ["amount"]}).collect()
    assert {(r.feature_set, r.fold) for r in cv} == {(s, k) for s in ("F0", "one") for k in (1, 2, 3)}
    assert all(r.rows == df.where(valid[r.fold]).count() for r in cv)


def test_odd_inputs(spark):
    df = weighted(rows(spark))
    model = L.fit(df, L.FEATURE_SETS["F0"])
    assert model.score(df.limit(3).withColumn("use_chip", F.lit("Never Seen"))).where("score between 0 and 1").count() == 3
    assert model.score(df.limit(3).withColumn("amount", F.lit(float("nan")))).where("score between 0 and 1").count() == 3
    names = [r["feature_name"] for r in L.importance(model, df).collect()]
    assert "missing_amount" in names and "use_chip=Online Transaction" in names and "intercept" not in names
    with pytest.raises(ValueError, match="forbidden"):
        L.fit(df, ["amount", "fraud_label"])
    empty = L.fit(df.limit(0), L.FEATURE_SETS["F0"])
    assert not empty.coefficients.any() and {r.score for r in empty.score(df).collect()} == {0.5}
    unlabelled = df.unionByName(df.limit(5).withColumn("fraud_label", F.lit(None).cast("int")))
    assert np.allclose(L.fit(unlabelled, L.FEATURE_SETS["F0"]).coefficients, model.coefficients, atol=1e-9)


def test_weights_stand_for_the_rows_left_out(spark):
    df = rows(spark)
    kept = df.where("fraud_label = 1 or source_row_id % 3 = 0")
    got = {(r.fraud_label, r.sample_weight) for r in S.with_sample_weight(kept, df).collect()}
    share = df.where("fraud_label = 0").count() / kept.where("fraud_label = 0").count()
    assert got == {(1, 1.0), (0, share)}
    for wrong in (df.where("fraud_label = 1"), df.unionByName(df)):
        with pytest.raises(Exception, match="legitimate rows"):
            S.with_sample_weight(wrong, df).collect()


def minmax(pairs):
    s = sorted({x for x, _ in pairs})
    n, p = [sum(x == v for x, _ in pairs) for v in s], [sum(y for x, y in pairs if x == v) for v in s]
    mean = lambda j, k: sum(p[j : k + 1]) / sum(n[j : k + 1])
    return {v: max(min(mean(j, k) for k in range(i, len(s))) for j in range(i + 1)) for i, v in enumerate(s)}


@pytest.mark.parametrize(("parts", "task_rows"), [(1, 1000), (9, 1000), (9, 0)])
def test_isotonic_fit_is_the_same_over_any_ranges(spark, parts, task_rows):
    r = np.random.default_rng(4)
    pairs = [(float(x), int(r.random() < 0.1 + x / 40)) for x in r.integers(0, 30, 300)] + [(-1.0, 1), (31.0, 0), (31.0, 0)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame([*pairs, (None, 1), (float("nan"), 1), (3.0, None)], "score double, fraud_label int").repartition(3)
        blocks = isotonic_blocks(df)
        got = {x.score: x.probability for x in isotonic_probability(df.where("score is not null and not isnan(score)").distinct(), blocks, task_rows=task_rows).collect()}
        want = minmax(pairs)
        assert got == pytest.approx(want)
        found = sorted(blocks.collect())
        assert sum(b.n for b in found) == len(pairs) and all(a.high < b.low and a.pos * b.n < b.pos * a.n for a, b in zip(found, found[1:], strict=False))
        xs = sorted(want)
        asked = [-5.0, 99.0, *[(a + b) / 2 for a, b in zip(xs, xs[1:], strict=False)], None, float("nan")]
        line = isotonic_probability(spark.createDataFrame([(x, i) for i, x in enumerate(asked)], "score double, i int"), blocks, task_rows=task_rows).orderBy("i").collect()
        assert [x.probability for x in line[:-2]] == pytest.approx([float(np.interp(x, xs, [want[v] for v in xs])) for x in asked[:-2]]) and [x.probability for x in line[-2:]] == [None, None]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_isotonic_without_rows_and_all_methods(spark):
    none = spark.createDataFrame([], "score double, fraud_label int")
    some = spark.createDataFrame([(0.1, 0), (0.9, 1), (0.5, 1)], "score double, fraud_label int")
    assert [r.probability for r in L.calibrate(none, some, "isotonic").collect()] == [None] * 3
    for method in ("uncalibrated", "sigmoid", "isotonic"):
        assert L.calibrate(some, some, method).where("probability between 0 and 1").count() == 3
    with pytest.raises(ValueError, match="unknown"):
        L.calibrate(some, some, "guess")
    b = L.fit_sigmoid(some).coefficients
    p = 1 / (1 + np.exp(-(b[0] * np.array([0.1, 0.9, 0.5]) + b[1])))
    assert p.sum() == pytest.approx(2, abs=1e-8) and (p @ [0.1, 0.9, 0.5]) + b[0] == pytest.approx(1.4, abs=1e-8)


@pytest.mark.parametrize("most", [10**6, 0])
def test_rank_of_a_common_score_is_joined_alike_on_every_branch(spark, most):
    df = spark.range(500).select("id", F.when(F.col("id") < 400, 0.5).otherwise(F.col("id") / 1000).alias("risk_score"), (F.col("id") % 2).alias("pair"))
    want = {(r.id, r._pct) for r in P.with_rank(df, ["pair"], rows=500).collect()}
    assert {(r.id, r._pct) for r in P.with_rank(df, ["pair"], most=most).collect()} == want and len(want) == 500
