"""Sources and the typed standardization of the raw table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import exprs as X
from ..functions.scale import BROADCAST_ROWS, cut
from ..operators.quality import RAW_COLUMNS

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy", "MM/dd/yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")
DATE_HINTS = ("timestamp", "datetime", "date", "time", "trans_date")


def read_raw_csv(spark: SparkSession, path: str, contract: Sequence[str] = tuple(RAW_COLUMNS)) -> DataFrame:
    """CSV scan that fails unless the header equals the contract, names and order: the first file's at once, any other's when it is read."""
    header = spark.read.option("encoding", "UTF-8").option("mode", "PERMISSIVE").option("header", True).csv(path).columns
    header = [h.lstrip("﻿") for h in header]
    if header != list(contract):
        raise ValueError(f"source header {header} differs from the contract {list(contract)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in contract])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("encoding", "UTF-8").csv(path)


def add_row_id(df: DataFrame, name: str = "source_row_id", scan: bool = True) -> DataFrame:
    """Contiguous 1..N ids in scan order, from one count per scan partition and no global window.

    Both passes must see the same partitions. A file scan with at most row-wise
    steps on it gives them; anything else (``scan=False``) is written first.
    """
    if not scan:
        df = cut(df)
    tagged = df.withColumn("_m", F.monotonically_increasing_id())
    part = F.shiftright("_m", 33)
    counts = tagged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row per scan partition.
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    if df.rdd.getNumPartitions() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    position = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = tagged.withColumn("_part", part).join(offsets, "_part")
    return numbered.select((F.col("_offset") + position + 1).alias(name), *[F.col(f"`{c}`") for c in df.columns])


def csv_to_parquet(spark: SparkSession, source: str, target: str) -> None:
    add_row_id(read_raw_csv(spark, source)).write.mode("overwrite").option("compression", "zstd").parquet(target)


def open_table(spark: SparkSession, path: str, view: str) -> DataFrame:
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(view)
    return df


def load(spark: SparkSession, path: str) -> DataFrame:
    """CSV or Parquet by suffix; anything else is refused."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".csv":
        return spark.read.option("header", True).csv(path)
    if suffix in (".parquet", ".pq"):
        return spark.read.parquet(path)
    raise ValueError(f"unsupported input format {suffix!r}; use CSV or Parquet")


def prefix_slice(df: DataFrame, limit: int) -> DataFrame:
    return df.where(F.col("source_row_id") <= limit)


def standardize(raw: DataFrame) -> DataFrame:
    """Raw text columns to the typed transaction row."""
    keep = ["source_row_id"] if "source_row_id" in raw.columns else []
    return raw.select(
        *keep,
        F.col("User").cast("long").alias("user_id"), F.col("Card").cast("int").alias("card_index"),
        F.concat_ws(":", F.col("User").cast("string"), F.col("Card").cast("string")).alias("card_key"),
        X.parse_event_time("Year", "Month", "Day", "Time").alias("transaction_timestamp"), X.parse_currency("Amount").alias("amount"),
        X.blank_to_null("Use Chip").alias("use_chip"), X.blank_to_null("Merchant Name").alias("merchant_id_raw"),
        X.blank_to_null("Merchant City").alias("merchant_city"), X.blank_to_null("Merchant State").alias("merchant_state"),
        X.blank_to_null("Zip").alias("merchant_zip"), F.col("MCC").cast("string").alias("merchant_category_code"),
        X.blank_to_null(F.col("`Errors?`")).alias("errors_raw"), X.decode_label(F.col("`Is Fraud?`")).alias("fraud_label"),
    )


@dataclass(frozen=True)
class Field:
    """A column of an input contract: where it may come from, how it is read, and what it is if nothing has it."""

    name: str
    renames: tuple[str, ...] = ()  # other names of the same column
    copies: tuple[str, ...] = ()  # columns it is derived from, which stay
    read: Callable[[Column, T.DataType], Column] = lambda c, _: c
    default: Callable[[], Column] | None = None
    required: bool = False


def conform(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """``df`` in one select with every field that it has a source for, or a default; other columns stay."""
    types = {f.name: f.dataType for f in df.schema.fields}
    source = {f.name: next((c for c in (f.name, *f.renames, *f.copies) if c in types), None) for f in fields}
    if gone := [f.name for f in fields if f.required and source[f.name] is None]:
        raise ValueError(f"input misses columns {gone}")
    read = {f.name: f.read(F.col(c), types[c]) if (c := source[f.name]) else f.default() for f in fields if source[f.name] or f.default}
    used = {source[f.name] for f in fields if source[f.name] in f.renames}
    kept = [read.pop(c).alias(c) if c in read else F.col(f"`{c}`") for c in df.columns if c not in used]
    return df.select(*kept, *[column.alias(name) for name, column in read.items()])


def _as_time(c: Column, kind: T.DataType) -> Column:
    return F.try_to_timestamp(c) if isinstance(kind, T.StringType) else c.cast("timestamp")


def _as_exposure(c: Column, kind: T.DataType) -> Column:
    amount = c.try_cast("double")
    return F.when(amount.isNotNull(), X.positive_part(amount))


def _as_channel(c: Column, _: T.DataType) -> Column:
    return F.when(c.isin("Online", "Chip", "Swipe"), F.upper(c)).otherwise("OTHER / UNKNOWN")


# The names that scored, monitored and decided tables go by.
DECISION_FIELDS = (Field("risk_score", copies=("PRIMARY_FRAUD_SCORE",)), Field("split_name", copies=("split",)))
MONITORING_FIELDS = (
    Field("risk_score", copies=("PRIMARY_FRAUD_SCORE", "score")), Field("split_name", copies=("split",)),
    Field("transaction_timestamp", copies=("timestamp",), read=_as_time), Field("action", read=lambda c, _: F.upper(c.cast("string"))),
)


def decision_input(df: DataFrame) -> DataFrame:
    """Column aliases of a scored table brought to the decision contract."""
    channel = () if "channel" in df.columns else (Field("channel", copies=("use_chip",), read=_as_channel),)
    return conform(df, (*DECISION_FIELDS, *channel))


def monitoring_input(df: DataFrame) -> DataFrame:
    """Column aliases, exposure, upper-case actions and UTC time of a monitoring table."""
    exposure = () if "positive_exposure" in df.columns else (Field("positive_exposure", copies=("amount",), read=_as_exposure),)
    return conform(df, (*MONITORING_FIELDS, *exposure))


def inventory(df: DataFrame) -> DataFrame:
    """Rows, columns and date range, from Year/Month/Day or the first date-like column."""
    if {"Year", "Month", "Day"} <= set(df.columns):
        part = lambda c: F.col(c).try_cast("double").cast("int")
        day = F.to_date(F.try_make_timestamp_ntz(part("Year"), part("Month"), part("Day"), F.lit(0), F.lit(0), F.lit(0)))
    else:
        dated = [c for c in df.columns if any(h in c.lower() for h in DATE_HINTS)]
        text = F.trim(F.col(f"`{dated[0]}`").cast("string")) if dated else F.lit(None).cast("string")
        day = F.to_date(F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]))
    return df.agg(F.count("*").alias("row_count"), F.lit(len(df.columns)).cast("long").alias("column_count"),
                  F.min(day).alias("date_min"), F.max(day).alias("date_max"))


def subgroups(mart: DataFrame) -> DataFrame:
    return mart.withColumns({
        "channel_group": X.channel_group("use_chip"),
        "card_history_group": F.when(F.col("card_cold_start") == 1, "cold_start_card").otherwise("established_card"),
        "relationship_group": F.when(F.col("card_merchant_is_new") == 1, "new_card_merchant").otherwise("known_card_merchant"),
    })
