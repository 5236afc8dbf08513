"""The given tables read as a card-transaction table.

Labels and scores are integer arithmetic on the rows. They exercise the
operators and mean nothing about fraud.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as X
from ..functions.scale import DEALT_ROWS, dealt
from ..operators.behavior import FEATURES, behavior_features
from ..operators.splits import OUT_OF_TIME, VALIDATION, chronological_split

DEVELOPMENT_END = "1999-08-11"
VALIDATION_END = "2000-08-06"
LINES_A_PAIR = 64
LINE_COLUMNS = [
    "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_returnflag", "l_linestatus",
    "l_discount", "l_tax",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_bound(spark: SparkSession, sf_dir: str) -> int:
    """No transaction view has more rows than lineitem; counting it reads no columns."""
    return table(spark, sf_dir, "lineitem").count()


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with short codes in place of texts, one code a value: rows are dealt out and sorted like this, and named afterwards."""
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # Order and line number are not unique, so rows of one pair are numbered; an id has room for LINES_A_PAIR of them. Lines are numbered before
    # they meet their order: the join then needs no sort of its own. Of several orders with one key, each has all lines, numbered in turn.
    same, order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*LINE_COLUMNS), Window.partitionBy("o_orderkey")
    rows, lines = row_bound(spark, sf_dir), line.where(F.col("l_orderkey").isNotNull())
    if rows > DEALT_ROWS:  # by order for both, the window and the join
        lines, orders = dealt(lines, ["l_orderkey"], rows), dealt(orders, ["o_orderkey"], rows)
    lines = lines.withColumn("_line", F.row_number().over(same) - 1)
    orders = orders.select("*", (F.row_number().over(order.orderBy("o_orderdate", "o_custkey")) - 1).alias("_order"), F.count("*").over(order).alias("_orders"))
    number = F.col("_line") * F.col("_orders") + F.col("_order")
    joined = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("_number", F.when(number < LINES_A_PAIR, number).otherwise(F.raise_error(F.lit("more rows of one order line than an id has room for"))))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    )
    amount = (
        F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 45), -F.col("l_extendedprice"))
        .when((F.col("l_discount") == 0) & (F.col("l_quantity") < 3), F.lit(0.0))
        .otherwise(F.col("l_extendedprice"))
    )
    return joined.select(
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * LINES_A_PAIR + F.col("_number")).alias("source_row_id"),
        F.col("o_orderdate").alias("transaction_timestamp"),
        F.col("o_custkey").alias("user_id"),
        (F.col("l_suppkey") % 3).cast("int").alias("card_key"),  # a user's card
        F.col("l_suppkey").alias("merchant_id_raw"),
        F.when(F.col("l_partkey") % 11 != 0, F.col("n_name")).alias("merchant_state"),
        (F.col("l_partkey") % 40).cast("int").alias("merchant_category_code"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).when(F.col("l_returnflag") == "R", 3).alias("use_chip"),
        amount.alias("amount"),
        F.col("l_partkey").alias("_part"),
        (F.col("l_orderkey") % 50 == 0).alias("_short"),
    )


def _named(coded: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The transaction columns of coded rows, then ``extra`` as they are."""
    part, merchant = F.col("_part"), F.col("merchant_id_raw")
    channel = F.when(F.col("use_chip") == 1, "Swipe Transaction").when(F.col("use_chip") == 2, "Chip Transaction").when(F.col("use_chip") == 3, "Online Transaction")
    online_bar = F.when(F.col("use_chip") == 3, 6).otherwise(2)
    return coded.select(
        "source_row_id", "transaction_timestamp", "user_id",
        F.col("card_key").alias("card_index"),
        F.concat_ws(":", F.col("user_id"), F.col("card_key")).alias("card_key"),
        merchant.cast("string").alias("merchant_id_raw"),
        F.when(part % 13 != 0, F.concat(F.lit("City "), (merchant % 37).cast("string"))).alias("merchant_city"),
        "merchant_state",
        F.when(part % 17 != 0, (10000 + part % 900).cast("string")).alias("merchant_zip"),
        (5000 + F.col("merchant_category_code")).cast("string").alias("merchant_category_code"),
        F.when(F.col("_short"), F.lit("Insufficient Balance")).alias("errors_raw"),
        channel.alias("use_chip"),
        "amount",
        F.when((F.col("source_row_id") % 97 * 7919) % 97 < online_bar, 1).otherwise(0).alias("fraud_label"),
        (((F.col("source_row_id") % 2147483647 * 48271) % 2147483647).cast("double") / 2147483647).alias("base_score"),
        *extra,
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(_coded(spark, sf_dir))


def _dated(named: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    ts = F.col("transaction_timestamp")
    return chronological_split(named.select(
        *[c for c in named.columns if c not in extra],
        F.to_date(ts).alias("transaction_date"),
        F.year(ts).cast("long").alias("transaction_year"),
        F.month(ts).cast("long").alias("transaction_month"),
        *extra,
    ), DEVELOPMENT_END, VALIDATION_END)


def model_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with date parts and the chronological split."""
    return _dated(transactions(spark, sf_dir))


def development(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_splits(spark, sf_dir).where("split = 'DEVELOPMENT'")


def raw_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows in the 15-text-column layout of the source file."""
    ts = F.col("transaction_timestamp")
    money = F.concat(F.lit("$"), F.format_string("%.2f", "amount"))
    return transactions(spark, sf_dir).select(
        "source_row_id",
        F.col("user_id").cast("string").alias("User"),
        F.col("card_index").cast("string").alias("Card"),
        F.year(ts).cast("string").alias("Year"),
        F.month(ts).cast("string").alias("Month"),
        F.dayofmonth(ts).cast("string").alias("Day"),
        F.date_format(ts, "HH:mm").alias("Time"),
        money.alias("Amount"),
        F.col("use_chip").alias("Use Chip"),
        F.col("merchant_id_raw").alias("Merchant Name"),
        F.coalesce("merchant_city", F.lit(" ")).alias("Merchant City"),
        F.coalesce("merchant_state", F.lit("")).alias("Merchant State"),
        F.col("merchant_zip").alias("Zip"),
        F.col("merchant_category_code").alias("MCC"),
        F.col("errors_raw").alias("Errors?"),
        F.when(F.col("fraud_label") == 1, "Yes").otherwise("No").alias("Is Fraud?"),
    )


def mart(spark: SparkSession, sf_dir: str, features: Sequence[str] = FEATURES, splits: Sequence[str] = ()) -> DataFrame:
    """Behavioral mart with the label joined after the features (kept beside them).

    ``features`` names those that are wanted, ``splits`` the splits whose rows are. No feature looks ahead, so rows later than the last wanted
    split are left out before the features are made; rows without a time sort before all others and stay.
    """
    coded = _coded(spark, sf_dir)
    if splits and OUT_OF_TIME not in splits:
        end = VALIDATION_END if VALIDATION in splits else DEVELOPMENT_END
        coded = coded.where(F.col("transaction_timestamp").isNull() | (F.to_date("transaction_timestamp") <= F.to_date(F.lit(end))))
    made = behavior_features(coded, rows=row_bound(spark, sf_dir), features=features)
    extra = made.columns[len(coded.columns):]
    dated = _dated(_named(made, extra), extra)
    named = [c for c in dated.columns if c not in extra and c != "split"]
    whole = dated.select(*named, F.col("split").alias("split_name"), *extra)
    return whole.where(F.col("split_name").isin(*splits)) if splits else whole


_NOVELTY = {"pair_new": "card_merchant_is_new", "cold_card": "card_cold_start", "new_merchant": "merchant_cold_start"}


def scored(spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None, splits: Sequence[str] = ()) -> DataFrame:
    """Decision input: score, exposure, graph flags and the label in its own column; of the graph flags only those in ``columns`` if given."""
    flags = [c for c in _NOVELTY if columns is None or c in columns]
    m = mart(spark, sf_dir, [_NOVELTY[c] for c in flags], splits)
    score = F.least(F.lit(1.0), F.col("base_score") * 0.6 + F.col("fraud_label") * F.lit(0.3))
    return m.select(
        "source_row_id", "transaction_timestamp", "split_name", "user_id", "card_key", "merchant_category_code", "amount",
        score.alias("risk_score"),
        X.positive_part("amount").alias("positive_exposure"),
        F.upper(X.channel_group("use_chip")).alias("channel"),
        *[(F.col(_NOVELTY[c]) == 1).alias(c) for c in flags],
        ((F.col("user_id") + F.col("merchant_id_raw").cast("long")) % 4 == 0).alias("cross_community"),
        "state_missing_flag", "fraud_label",
    )
