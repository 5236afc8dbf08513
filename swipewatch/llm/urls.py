"""URL filters: a blocked Bloom filter lets possible hits through to an exact hash join with the list."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, mixed

#: The filter takes this many bits a rule, and at most MAX_FILTER_BYTES; a longer list only lets more false positives through.
BITS_PER_RULE = 12
MAX_FILTER_BYTES = 16_000_000
#: A list of at most this many rules is broadcast to the exact join; a longer one is shuffled.
BROADCAST_RULES = 100_000

#: Odd multipliers that pick one bit in each of a block's eight 32-bit words.
_PICK = (np.random.default_rng(8).integers(1, 2**31, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)


def _bits(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Each hash's block and its mask of eight words."""
    h = mixed(hashes.view(np.uint64))
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    with np.errstate(over="ignore"):
        shift = (h.astype(np.uint32)[:, None] * _PICK[None, :]) >> np.uint32(27)
    return block.astype(np.int64), np.uint32(1) << shift


def bloom_filter(keys: DataFrame, hashed: str, blocks: int) -> np.ndarray:
    """The filter's words, (blocks, 8); each task builds its part and parts of a block are or-ed, so no task sees all keys."""
    schema = T.StructType([T.StructField("block", T.LongType()), *[T.StructField(f"w{i}", T.LongType()) for i in range(8)]])

    def part(batches):
        for batch in batches:
            block, mask = _bits(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), blocks)
            mine, back = np.unique(block, return_inverse=True)
            words = np.zeros((len(mine), 8), np.uint32)
            np.bitwise_or.at(words, back, mask)
            yield pa.RecordBatch.from_arrays([pa.array(mine), *[pa.array(words[:, i].astype(np.int64)) for i in range(8)]], schema.fieldNames())

    rows = keys.select(hashed).mapInArrow(part, schema).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)]).toArrow()
    out = np.zeros((blocks, 8), np.uint32)
    if rows.num_rows:
        out[rows.column(0).to_numpy()] = np.stack([rows.column(i + 1).to_numpy() for i in range(8)], 1).astype(np.uint32)
    return out


def host_and_path(url) -> tuple:
    """Host: behind the first :// up to /, ?, # or the end, A-Z lower-cased. Path: from there up to ?, # or the end. Else both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, upper.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` of the longest rule that fits, else null and ``otherwise``.

    ``rules`` has host, path and verdict; repeated rules count once, and of contradicting ones block wins. A rule fits its host and all
    subdomains if the path starts with the rule's. Rules of equal length cannot both fit, unless they divide the same text differently
    into host and path; then the longer host wins. Rules with a null fit nothing. Null urls and urls without :// have an empty host and path.
    Rows keep their columns, repeats included; new columns get underscores in front where a name is taken. An empty list lets all through.
    """
    keys = rules.where("host is not null and path is not null and verdict is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    keys = keys.select("*", F.xxhash64("host", "path").alias("h"))
    # Which key shapes occur at all: numbers of dots in hosts, lengths of paths. Their number is bounded by the longest rule.
    shape = keys.agg(F.count("*").alias("n"), F.collect_set(F.length("host") - F.length(F.replace("host", F.lit("."), F.lit("")))).alias("dots"), F.collect_set(F.length("path")).alias("lengths")).first()
    dots, lengths = frozenset(shape["dots"]), sorted(shape["lengths"])
    blocks = max(1, min(MAX_FILTER_BYTES // 32, -(-shape["n"] * BITS_PER_RULE // 256)))
    words = pages.sparkSession.sparkContext.broadcast(bloom_filter(keys, "h", blocks))

    names = {c: free_name(pages, c) for c in ("host", "path", "rule", "verdict")}
    host, path = host_and_path(F.col(url))
    ends = F.lit(None).cast("array<string>")
    if shape["n"]:
        labels = F.split("_host", r"\.")
        counts = [int(d) for d in sorted(dots)]
        hosts = F.array_compact(F.array(*[F.when(F.size(labels) == d + 1, F.col("_host")).when(F.size(labels) > d + 1, F.substring_index("_host", ".", -(d + 1))) for d in counts]))
        paths = F.array_compact(F.array(*[F.when(F.length("_path") >= n, F.substring("_path", 1, n)) for n in lengths]))
        ends = F.flatten(F.transform(hosts, lambda a: F.transform(paths, lambda b: F.struct(a.alias("host"), b.alias("path"), F.xxhash64(a, b).alias("h")))))
    rest = F.struct(F.lit(True).alias("_there"), *[F.col(f"`{c}`") for c in pages.columns])
    each = pages.select(rest.alias("_rest"), host.alias("_host"), path.alias("_path"))
    if not shape["n"]:
        return each.select("_rest.*", F.col("_host").alias(names["host"]), F.col("_path").alias(names["path"]), F.lit(None).cast("string").alias(names["rule"]), F.lit(otherwise).alias(names["verdict"])).drop("_there")

    @F.pandas_udf("boolean")
    def possible(hashes):
        block, mask = _bits(hashes.to_numpy(np.int64), blocks)
        import pandas as pd

        return pd.Series(((words.value[block] & mask) == mask).all(1))

    # judged once for each distinct pair of host and path
    exact = each.select("_host", "_path").distinct().select("_host", "_path", ends.alias("_t")).select("_host", "_path", F.explode("_t").alias("_t")).where(possible("_t.h"))
    listed = keys.select("host", "path", "verdict")
    exact = exact.join(F.broadcast(listed) if shape["n"] <= BROADCAST_RULES else listed.hint("shuffle_hash"), (F.col("_t.host") == F.col("host")) & (F.col("_t.path") == F.col("path")))
    best = exact.groupBy("_host", "_path").agg(F.max(F.struct(F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("m"), F.concat("host", "path").alias("rule"), F.col("verdict"))).alias("_best"))
    return each.join(best, ["_host", "_path"], "left").select(
        "_rest.*", F.col("_host").alias(names["host"]), F.col("_path").alias(names["path"]), F.col("_best.rule").alias(names["rule"]),
        F.coalesce("_best.verdict", F.lit(otherwise)).alias(names["verdict"])).drop("_there")


#: The rules that the query judges by.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op8_url_filters(spark, sf_dir):
    from .common import table

    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    out = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return out.select("page_id", "host", "path", "rule", "verdict")


SQL = """
with rules (rhost, rpath, rverdict) as (values """ + ", ".join(str(r) for r in RULES) + r"""),
rest as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
parts as (select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest),
fits as (select page_id, arg_max(rhost || rpath, length(rhost || rpath)) as rule, arg_max(rverdict, length(rhost || rpath)) as verdict
  from parts join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by page_id)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parts left join fits using (page_id)"""
