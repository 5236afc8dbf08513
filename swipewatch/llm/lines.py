"""Line dedup with DataFrame functions only: lines that many documents share go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name

#: A table of at most this many 16-byte keys is broadcast; a larger one is joined by shuffle, with the same rows.
BROADCAST_KEYS = 500_000

_SPACE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _UPPER.lower())


def _hashed(key: Column) -> Column:
    """128 bits, so that two keys of a corpus of any size do not meet by chance; null for the empty key, which is never shared."""
    return F.when(key != "", F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b")))


def drop_shared_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``docs`` with shared lines removed from ``text``, plus ``n_lines`` (before) and ``n_dropped``.

    A line's key must have a character and be in ``min_docs`` rows of ``docs`` (each row is a document, also if rows repeat). All lines
    with such a key go, the first too. Null and empty texts are one empty line and come back as an empty text. An empty table gives
    an empty table. Other columns are kept; if they are called n_lines or n_dropped, the new ones get underscores in front.
    """
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    keys = docs.select(F.explode(F.array_distinct(F.transform(lines, lambda x: _hashed(line_key(x))))).alias("k")).where("k is not null")
    shared = cut(keys.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select(F.col("k.a").alias("_a"), F.col("k.b").alias("_b")))
    few = shared.count() <= broadcast_keys

    others = [c for c in docs.columns if c != text]
    each = docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(F.lit(True).alias("_there"), *[F.col(f"`{c}`") for c in others]).alias("_rest"), lines.alias("_lines"))
    each = each.select("_row", "_rest", F.posexplode("_lines").alias("_pos", "_line"))
    each = each.select("_row", "_pos", "_line", F.when(F.col("_pos") == 0, F.col("_rest")).alias("_rest"), _hashed(line_key(F.col("_line"))).alias("_k"))
    hit = (F.col("_k.a") == F.col("_a")) & (F.col("_k.b") == F.col("_b"))
    each = each.join(F.broadcast(shared) if few else shared, hit, "left")
    again = each.groupBy("_row").agg(
        F.count("*").alias("_n"), F.count("_a").alias("_d"), F.first("_rest", ignorenulls=True).alias("_rest"),
        F.array_sort(F.collect_list(F.when(F.col("_a").isNull(), F.struct("_pos", "_line")))).alias("_kept"))
    n_lines, n_dropped = free_name(docs, "n_lines"), free_name(docs, "n_dropped")
    kept = F.array_join(F.transform("_kept", lambda x: x["_line"]), "\n")
    return again.select(*[(kept if c == text else F.col(f"_rest.`{c}`")).alias(c) for c in docs.columns], F.col("_n").alias(n_lines), F.col("_d").alias(n_dropped))


def op6_line_dedup(spark, sf_dir):
    from .common import table

    out = drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
keyed as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
shared as (select k from keyed where k <> '' group by k having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(*) filter (where s.k is not null) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where s.k is null), '')) as kept_sha256
from keyed left join shared s using (k) group by doc_id"""
