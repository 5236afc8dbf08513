"""Ordered text export: files in the order of their names hold the rows in order, and reading gives each row its place again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows of a file; a file is read by one task.
FILE_ROWS = 1_000_000

# RFC 4180: quotes inside quotes are doubled, line ends may stand inside quotes.
_FORMAT = {"header": True, "encoding": "UTF-8", "quote": '"', "escape": '"', "multiLine": True, "lineSep": "\n", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
           "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


# What a quoted empty text reads as before it becomes empty: a bare one is null.
_EMPTY = "\u0001\u0001"


def write_ordered(df: DataFrame, path: str, order: Sequence[Column | str], *, file_rows: int = FILE_ROWS, mode: str = "errorifexists") -> None:
    """Write ``df`` as CSV in ``order`` (ties by a hash of the row), every file with a header.

    Rows go to ranges of the order, so no task sorts or writes them all, and a very common key is divided between ranges. Files appear when all
    are written: a failed task leaves none. Nulls and empty texts stay apart.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    tie = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in df.columns])
    ranged = df.repartitionByRange(*order, tie).sortWithinPartitions(*order, tie)
    ranged.write.mode(mode).options(**_FORMAT).option("maxRecordsPerFile", file_rows).csv(path)


def read_ordered(spark: SparkSession, path: str, schema: T.StructType | str, position: str = "position") -> DataFrame:
    """The rows with their 1-based place. The job fails if the header of any file is not the schema's; a byte order mark is no part of it.

    Places come from one count per file and a running sum over the files, not from a sort of the rows. A text of exactly two U+0001 reads as empty.
    """
    raw = spark.read.schema(schema).options(**_FORMAT).option("emptyValue", _EMPTY).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    texts = {f.name: F.when(F.col(f"`{f.name}`") == _EMPTY, "").otherwise(F.col(f"`{f.name}`")) for f in raw.schema.fields if f.dataType.typeName() == "string"}
    tagged = raw.select(*[texts.get(c, F.col(f"`{c}`")).alias(c) for c in raw.columns], F.col("_metadata.file_name").alias("_file"), F.monotonically_increasing_id().alias("_id"))
    files = tagged.groupBy("_file").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    starts = files.select("_file", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return tagged.join(starts, "_file").select((F.col("_before") + F.col("_id") - F.col("_first") + 1).alias(position), *[F.col(f"`{c}`") for c in raw.columns])
