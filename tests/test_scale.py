"""The range-partitioned forms must equal the plain ones, also with one key holding a third of the rows."""

import pytest
from pyspark.sql import functions as F

from swipewatch.functions import scale as K
from swipewatch.operators import behavior as B
from swipewatch.operators import drift as D
from swipewatch.operators import metrics as M
from swipewatch.operators import policy as P
from swipewatch.operators import search as H
from swipewatch.operators import splits as S
from swipewatch.plans import tables as T
from swipewatch.plans.portfolio_queries import events_view

SMALL = {"task_rows": 50}


def rows(df, digits=9):
    fix = lambda v: round(v, digits) if isinstance(v, float) else v
    return sorted((tuple(fix(v) for v in r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def skewed(spark):
    """600 rows, a third on key 0, one instant with many rows."""
    return spark.range(600).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("k"), F.when(F.col("id") % 5 == 0, 7).otherwise(F.pmod(F.col("id") * 37, F.lit(101))).alias("v"))


@pytest.mark.parametrize("exclusive", [False, True])
def test_prefix_by_ranges_equals_window(skewed, exclusive):
    measures = {"total": ("v", "sum"), "most": ("v", "max"), "least": ("v", "min")}
    args = (["k"], ["v", "id"], measures)
    plain = K.prefix(skewed, *args, exclusive=exclusive, rows=600)
    ranged = K.prefix(skewed, *args, exclusive=exclusive, **SMALL)
    assert rows(plain) == rows(ranged)


def test_prefix_with_null_key_and_descending_order(skewed):
    nulled = skewed.withColumn("k", F.when(F.col("k") != 0, F.col("k")))
    args = (["k"], [F.desc("v"), "id"], {"n": ("v", "sum")})
    assert rows(K.prefix(nulled, *args, rows=600)) == rows(K.prefix(nulled, *args, **SMALL))


@pytest.mark.parametrize("by", [[], ["k"]])
def test_quantiles_by_counts_equal_percentile(skewed, by):
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    one, many = K.quantiles(skewed, "v", probs, by, rows=600), K.quantiles(skewed, "v", probs, by, **SMALL)
    flat = lambda df: {tuple(r[b] for b in by): [round(x, 9) for x in r["quantiles"]] for r in df.collect()}
    assert flat(one) == flat(many)


def test_hot_keys_are_found_and_split(skewed):
    hot = K.hot_keys(skewed, ["k"], task_rows=100)
    assert [r["k"] for r in hot.collect()] == [0]
    cold, rest = K.split_hot(skewed, hot, ["k"])
    assert cold.count() + rest.count() == 600 and rest.select("k").distinct().count() == 1
    assert K.hot_keys(skewed, ["k"], task_rows=600) is None


def test_features_of_hot_keys_equal_window_features(spark, sf_dir):
    source = events_view(spark, sf_dir)
    # A third of all events on one user, and every fourth on a NULL merchant.
    source = source.withColumn("user_id", F.when(F.col("source_row_id") % 3 == 0, F.lit(1)).otherwise(F.col("user_id"))).withColumn(
        "merchant_id_raw", F.when(F.col("source_row_id") % 4 == 0, F.lit(None).cast("string")).otherwise(F.col("merchant_id_raw"))).withColumn(
        "card_key", F.concat_ws(":", "user_id", F.col("source_row_id") % 2))
    source = source.withColumn("transaction_timestamp", F.date_trunc("minute", "transaction_timestamp").cast("timestamp_ntz"))
    plain = B.behavior_features(source, rows=10_000)
    hot = B.behavior_features(source, task_rows=60)
    columns = ["source_row_id", *B.FEATURES]
    assert rows(plain.select(*columns)) == rows(hot.select(*columns))


def test_ranking_metrics_and_top_k_by_ranges(spark, sf_dir):
    s = T.scored(spark, sf_dir).withColumn("risk_score", F.round("risk_score", 2)).persist()
    assert rows(M.ranking_metrics(s, ["channel"], rows=10_000)) == rows(M.ranking_metrics(s, ["channel"], **SMALL))
    assert rows(M.top_k(s, ["channel"], rows=10_000)) == rows(M.top_k(s, ["channel"], **SMALL))
    assert rows(M.equal_frequency_bins(s, rows=10_000)) == rows(M.equal_frequency_bins(s, **SMALL))


@pytest.mark.parametrize("method", ["SCORE_ONLY", "EXPOSURE_WEIGHTED_RANK", "AMOUNT_GRAPH"])
def test_queue_with_one_huge_bucket(spark, sf_dir, method):
    s = T.scored(spark, sf_dir).drop("fraud_label").withColumn(
        "transaction_timestamp", F.when(F.col("source_row_id") % 3 == 0, F.to_timestamp_ntz(F.lit("2000-01-01 00:00:00"))).otherwise(F.col("transaction_timestamp"))).persist()
    config = P.PolicyConfig("X", 0.2, 0.9, 0.25, method)
    shown = ["source_row_id", "action", "review_rank", "bucket_capacity", "review_priority", "reason_codes"]
    assert rows(P.decide(s, config, rows=10_000).select(*shown)) == rows(P.decide(s, config, **SMALL).select(*shown))


def test_grid_by_ranges(spark, sf_dir):
    s = T.scored(spark, sf_dir).persist()
    args = (s, (0.3, 0.5, 0.7), (0.05,))
    assert rows(H.policy_grid(*args, rows=10_000), 6) == rows(H.policy_grid(*args, **SMALL), 6)


def test_two_sample_by_ranges(spark, sf_dir):
    s = T.scored(spark, sf_dir).persist()
    a, b = s.where("split_name = 'DEVELOPMENT'"), s.where("split_name <> 'DEVELOPMENT'")
    assert rows(D.two_sample(a, b, ["amount", "risk_score"], rows=20_000)) == rows(D.two_sample(a, b, ["amount", "risk_score"], **SMALL))
    assert D.frozen_bins(a, ["amount"], rows=20_000) == D.frozen_bins(a, ["amount"], **SMALL)


def test_sampling_does_not_depend_on_digit_groups(spark, sf_dir):
    named = T.model_splits(spark, sf_dir).withColumnRenamed("split", "split_name").persist()
    wide = S.sample_negatives(named, ratio=3, prefix_digits=1).select("source_row_id")
    fine = S.sample_negatives(named, ratio=3, prefix_digits=4).select("source_row_id")
    assert rows(wide) == rows(fine)


def test_mart_needs_one_exchange_per_entity(spark, sf_dir):
    """All user, card and pair windows share the exchange on user_id."""
    plan = B.behavior_features(events_view(spark, sf_dir), rows=1000)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 2 and any("user_id" in e for e in exchanges) and any("merchant_id_raw" in e for e in exchanges)


def test_checkpoint_folder_of_the_session_is_kept(spark, tmp_path):
    K.ensure_checkpoint_dir(spark)
    first = spark.sparkContext.getCheckpointDir()
    K.ensure_checkpoint_dir(spark)
    assert first is not None and spark.sparkContext.getCheckpointDir() == first


@pytest.mark.parametrize("task_rows", [10**6, 0])
def test_history_audits_are_the_same_for_hot_users(spark, task_rows):
    import datetime as dt

    from swipewatch.operators import quality as Q

    splits = ["DEVELOPMENT", "VALIDATION", "OUT_OF_TIME_OOT"]
    start = dt.datetime(2020, 1, 1)
    rows = [(i, None if i % 31 == 0 else i % 3, splits[min(i // 40, 2)], None if i % 53 == 0 else start + dt.timedelta(hours=i // 2 * (1 if i % 7 else -1))) for i in range(150)]
    df = spark.createDataFrame(rows, "source_row_id long, user_id int, split string, transaction_timestamp timestamp_ntz")
    early = lambda a, b: a is None or a < b  # noqa: E731  rows without a time come first
    want = {}
    for i, user, split, at in rows:
        if split != "DEVELOPMENT":
            want[i] = sum(u == user and splits.index(s) < splits.index(split) and at is not None and early(t, at) for _, u, s, t in rows)
    got = Q.cross_split_history(df, task_rows=task_rows).collect()
    assert {r.source_row_id: r.expected_prior_split_count for r in got} == want
    outside = {}
    for i, user, _, at in rows:
        if i > 60 and at is not None and user is not None:
            outside[user] = min(outside.get(user, at), at)
    missing = sum(i <= 60 and at is not None and user in outside and outside[user] < at for i, user, _, at in rows)
    row = Q.prefix_coverage(df, 60, task_rows=task_rows).where("entity_type = 'user'").first()
    assert (row.rows_sampled, row.rows_with_external_prior_history) == (61, missing) and missing > 0


def test_quantiles_by_ranges_are_exact_for_ties_infinities_and_null_groups(spark):
    value = """case when id % 7 = 0 then 0.0D when id % 11 = 0 then null when id % 13 = 0 then double('nan') when id = 17 then double('infinity') when id = 18 then -double('infinity')
      when id % 3 = 0 then exp(rand(1) * 200 - 100) when id % 3 = 1 then -exp(rand(2) * 20) else -0.0D end"""
    df = spark.range(4000).selectExpr("case id % 5 when 0 then null when 1 then 'a' else 'b' end as g", f"{value} as v").localCheckpoint()
    for by in ([], ["g"]):
        for probs in ([0.5], [0.0, 0.1, 0.25, 0.99, 1.0]):
            got, want = ({tuple(r[b] for b in by): list(r.q) for r in K.quantiles(df, "v", probs, by, name="q", **bounds).collect()} for bounds in ({"task_rows": 50}, {"rows": 4000}))
            assert got.keys() == want.keys() and len(got) == (3 if by else 1)
            for key, values in want.items():
                assert all(x == y or abs(x - y) <= 1e-12 * abs(y) for x, y in zip(got[key], values, strict=True)), (by, probs, key)


def test_quantiles_shuffle_values_near_the_positions_only(spark):
    import tempfile
    from pathlib import Path

    kept = []

    def seen(df):
        path = tempfile.mkdtemp(prefix="seen-")
        df.write.parquet(f"{path}/t")
        kept.append(df.sparkSession.read.parquet(f"{path}/t").count())
        return df.sparkSession.read.parquet(str(Path(path, "t")))

    old, K.cut = K.cut, seen
    try:
        got = K.quantiles(spark.range(200_000).selectExpr("double(id * 7919 % 200000) as v"), "v", [0.5], name="q", task_rows=1000).first().q
    finally:
        K.cut = old
    assert got == [99_999.5]
    assert kept and max(kept) < 2_000  # all 200,000 distinct values were written before


def test_stored_rows_and_types_are_those_of_the_table(spark):
    df = spark.sql("select id, if(id % 2 = 0, null, 'x') as s, timestamp_ntz'2001-02-03 04:05:06' as t, cast(id as decimal(38,0)) as d from range(5)")
    back = K.stored(df)
    assert back.dtypes == df.dtypes and sorted(back.collect()) == sorted(df.collect())


def test_user_features_share_one_exchange(spark):
    df = spark.sql("select id as source_row_id, timestamp_ntz'2001-02-03 04:05:06' as transaction_timestamp, id % 7 as user_id, '1:1' as card_key, cast(id % 5 as string) as merchant_id_raw, '5000' as merchant_category_code, 'Chip Transaction' as use_chip, 1.5D as amount, 'CA' as merchant_state from range(100)")
    plan = B.behavior_features(df, rows=100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(user_id") == 1  # one for each pair of keys before


def test_tables_that_are_read_often_are_written_once(spark, sf_dir):
    from swipewatch.plans import model_queries, monitor_queries

    frames = [*monitor_queries.both(spark, sf_dir, ("amount",)), monitor_queries._labelled(spark, sf_dir), model_queries.training(spark, sf_dir, ())]
    assert all(f.inputFiles() and all("/stored-" in x for x in f.inputFiles()) for f in frames)  # lineitem and others before
