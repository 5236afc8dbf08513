"""Prefix trie of conversations: what conversations with common beginnings would save if each beginning were stored once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scale import BROADCAST_ROWS, cut, rows_at_most
from .chat import _filled, _rows
from .common import table
from .parens import Trie

#: Turns and conversations that one trie of a task holds at most, besides what a single conversation needs.
SHARD = 100_000

#: Letters of a turn's code: base64 of 15 bytes of its SHA-256.
CODE = 20

NO_ENDS = hashlib.sha256(b"").hexdigest()

_SCHEMA = pa.schema([
    ("spine", pa.bool_()), ("shard", pa.int64()), ("leftmost", pa.bool_()), ("rightmost", pa.bool_()), ("depth", pa.int64()), ("hash", pa.string()), ("above", pa.string()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("times", pa.int64()), ("once", pa.int64()), ("weight", pa.int64()), ("upto", pa.int64()), ("tip", pa.int64()), ("ends", pa.string())])
_DDL = "spine boolean, shard long, leftmost boolean, rightmost boolean, depth long, hash string, above string, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, times long, once long, weight long, upto long, tip long, ends string"


def coded(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, codes, sizes): a code of fixed width for each turn of a conversation, in order, and the code points of its text.

    Order is by turn (null first), ties by code. Null roles and texts are empty; rows without an id belong to no conversation. Texts are
    not shuffled, only codes and sizes; those of one conversation meet in a row.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    code = F.base64(F.substring(F.unhex(F.sha2(F.concat(F.char_length(empty(role)).cast("string"), F.lit(":"), empty(role), empty(text)), 256)), 1, 15))
    turns = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("c"), F.col(turn).isNotNull().alias("known"), F.col(turn).alias("t"), code.alias("code"), F.char_length(empty(text)).alias("size"))
    listed = turns.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("known", F.coalesce("t", F.lit(0)).alias("t"), "code", "size"))).alias("l"))
    return listed.select("c", F.col("l.code").alias("codes"), F.col("l.size").alias("sizes"))


def rebuilt(rows: DataFrame) -> DataFrame:
    """(c, codes, sizes) of the contract's conversations: some first turns come from conversation ``c - c % 100``."""
    most = 5  # of crc32 % 6
    own, bases = coded(rows), coded(rows.where("conv_id % 100 = 0")).select(F.col("c").alias("b"), F.slice("codes", 1, most).alias("first"), F.slice("sizes", 1, most).alias("first_sizes"))
    h = (F.crc32(F.col("c").cast("string")) % 6).cast("int")
    joined = own.join(bases, F.col("b") == F.col("c") - F.col("c") % 100, "left").withColumn("h", h)
    spliced = lambda a, b: F.concat(F.coalesce(F.slice(a, F.lit(1), F.col("h")), F.slice(b, 1, 0)), F.slice(b, F.col("h") + 1, F.size(b)))
    return joined.select("c", spliced("first", "codes").alias("codes"), spliced("first_sizes", "sizes").alias("sizes"))


def _chain(codes: list[bytes]) -> list[str]:
    """Names of the prefixes of a path, the empty one first."""
    out = [""]
    for code in codes:
        out.append(hashlib.blake2b(out[-1].encode() + code, digest_size=16).hexdigest())
    return out


def _nodes(paths: list[tuple[int, str, list[int]]], shard: int) -> Iterator[tuple]:
    """The nodes of a shard's trie. Those on its first and last path may go on in the next shards, so they keep what merging needs."""
    ids = np.array([p[0] for p in paths])
    codes = np.frombuffer("".join(p[1] for p in paths).encode(), f"S{CODE}")
    sizes = np.array([len(p[2]) for p in paths])
    t = Trie(codes, sizes, np.fromiter((x for p in paths for x in p[2]), np.int64, len(codes)), ids)
    name, upto = {}, {}
    for side in (t.left, t.right):
        for node, h, size in zip(side.tolist(), _chain(codes[t.step[side[1:]]].tolist()), np.cumsum(t.weight[side]).tolist(), strict=True):
            name[node], upto[node] = h, size
    left, right, tip = set(t.left.tolist()), set(t.right.tolist()), int(sizes[-1])
    place = np.searchsorted(t.end, np.arange(len(t.depth) + 1))
    columns = zip(*(x.tolist() for x in (t.depth, t.parent, t.smallest, t.members, t.children, t.leaves, t.times, t.once, t.weight, place[:-1], place[1:])), strict=True)
    for node, (depth, parent, smallest, members, children, leaves, times, once, weight, a, b) in enumerate(columns):
        ends = ",".join(map(str, ids[a:b].tolist()))
        if node in name:
            yield (True, shard, node in left, node in right, depth, name[node], name.get(parent), smallest, None, members, children, leaves, times, once, weight, upto[node], tip, ends)
        else:
            above = name.get(parent)
            yield (False, shard, None, None, depth, None, above, smallest, None if above is not None else int(t.smallest[parent]), members, children, leaves, times, once, None, None, None, hashlib.sha256(ends.encode()).hexdigest() if ends else NO_ENDS)


def trie(paths: DataFrame, shard: int = SHARD) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node of the trie of ``paths``.

    ``paths`` has (c, codes, sizes) as ``coded`` gives them, one row an id. Equal paths share all nodes, a path without turns ends at the root,
    and no paths at all have no nodes.

    Paths are put into lexicographic order over ranges (copies of a path by id, so that they spread too) and a task makes tries of at most
    ``shard`` turns, each encoded as balanced parentheses. Only nodes on the first and last path of a trie can have parts elsewhere. All that
    is counted is a sum over conversations or over nodes, so these parts are added up, less what neighbouring tries both hold: the nodes on the
    common beginning of one's last and the other's first path. Spines are as many nodes as there are tries, times their depth.
    """
    flat = paths.select("c", F.array_join("codes", "").alias("path"), "sizes")
    ordered = flat.repartitionByRange("path", "c").sortWithinPartitions("path", "c").withColumn("p", F.spark_partition_id().cast("long"))

    def built(batches):
        def shards():
            held, weight, number = [], 0, 0
            for c, path, sizes, p in _rows(batches, ["c", "path", "sizes", "p"]):
                held.append((c, path, sizes))
                weight += 1 + len(sizes)
                if weight >= shard:
                    yield held, (p << 32) + number
                    held, weight, number = [], 0, number + 1
            if held:
                yield held, (p << 32) + number

        return _filled((node for held, number in shards() for node in _nodes(held, number)), _SCHEMA, lambda row: 200 + len(row[-1]), 2_000_000)

    nodes = cut(ordered.mapInArrow(built, _DDL))
    spine = nodes.where("spine")
    last = Window.orderBy("shard")  # one row a shard
    before = spine.where("depth = 0").select("shard", F.lag("shard").over(last).alias("was"), F.lag("tip").over(last).alias("was_tip"))
    lefts = spine.where("leftmost").join(before, "shard")
    ends = spine.where("rightmost").select(F.col("shard").alias("was"), "depth", "hash")
    shared = lefts.join(ends, ["was", "depth", "hash"]).groupBy("shard").agg(F.max("depth").alias("common"), F.max_by("upto", "depth").alias("common_upto"), F.first("was_tip").alias("was_tip"))
    doubled = F.col("leftmost") & (F.col("depth") <= F.col("common"))
    less = lambda c, x: (F.col(c) - F.when(doubled, x).otherwise(0)).alias(c)
    single = spine.join(shared, "shard", "left").select(
        "depth", "hash", "above", "conv_id", "n_convs", "times", less("n_children", (F.col("depth") < F.col("common")).cast("long")), less("n_leaves", (F.col("common") == F.col("was_tip")).cast("long")),
        less("once", F.col("common_upto") - F.col("upto") + F.col("weight")))
    sums = single.groupBy("hash", "depth", "above").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "times", "once")])
    digest = pa.schema([("h", pa.string()), ("ends", pa.string())])

    def digested(batches):
        state, name = None, None
        out = []
        for h, text in _rows(batches, ["hash", "ends"]):
            if h != name:
                if state is not None:
                    out.append((name, state.hexdigest()))
                state, name = hashlib.sha256(), h
            else:
                state.update(b",")
            state.update(text.encode())
        if state is not None:
            out.append((name, state.hexdigest()))
        yield from _filled(iter(out), digest)

    texts = spine.where("ends <> ''").select("hash", "shard", "ends").repartition("hash").sortWithinPartitions("hash", "shard")
    closed = texts.select("hash", "ends").mapInArrow(digested, "h string, ends string")
    merged = cut(sums.join(closed, F.col("h") == F.col("hash"), "left").drop("h").withColumn("ends", F.coalesce("ends", F.lit(NO_ENDS))))
    parents = merged.select(F.col("hash").alias("h"), F.col("conv_id").alias("parent_conv_id"))
    if rows_at_most(parents, BROADCAST_ROWS):
        parents = F.broadcast(parents)
    result = lambda df: df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("times") - F.col("once")).alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
    inner = nodes.where("not spine")
    below = inner.where("above is not null").drop("parent_conv_id").join(parents, F.col("h") == F.col("above"))
    tops = merged.join(parents, F.col("h") == F.col("above"), "left")
    return result(inner.where("above is null")).unionByName(result(below)).unionByName(result(tops))


def op12_conversation_trie(spark, sf_dir):
    return trie(rebuilt(table(spark, sf_dir, "conversations")))


#: Nodes as texts of digests; each is spread over all its beginnings.
SQL = """with crc as (select list(v order by i) as tab from (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) g(i))),
turns as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, role, text) as n from conversations where conv_id is not null),
ids as (select conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(conv_id as varchar), ''), lambda x: cast(ord(x) as bigint))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 6 as h
  from (select distinct conv_id from conversations where conv_id is not null) i, crc),
made as (select i.conv_id, n, role, text from ids i join turns t on t.conv_id = i.conv_id - i.conv_id % 100 and n <= h
  union all select i.conv_id, n + 1000000, role, text from ids i join turns t on t.conv_id = i.conv_id and n > h),
paths as (select i.conv_id, coalesce(list(md5(role || chr(31) || text) order by n) filter (where n is not null), []) as codes, list(length(text) order by n) as sizes from ids i left join made m on m.conv_id = i.conv_id group by i.conv_id),
steps as (select conv_id, d as depth, array_to_string(codes[1:d], '') as key, len(codes) = d as ends, case when d > 0 then sizes[d] else 0 end as size from paths, lateral unnest(range(len(codes) + 1)) u(d)),
nodes as (select depth, key, min(conv_id) as conv_id, count(*) as n_convs, max(size) as size, coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where ends), '') as ends from steps group by depth, key),
kids as (select left(key, 32 * (depth - 1)) as key, count(*) as n from nodes where depth > 0 group by 1),
own as (select n.*, coalesce(k.n, 0) as n_children from nodes n left join kids k on k.key = n.key),
subtrees as (select left(key, 32 * d) as key, sum(case when n_children = 0 then 1 else 0 end) as n_leaves, sum((n_convs - 1) * size) as saved from own, lateral unnest(range(depth + 1)) u(d) group by 1)
select o.conv_id, o.depth, p.conv_id as parent_conv_id, o.n_convs, o.n_children, cast(n_leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, sha256(o.ends) as ends_sha256
from own o join subtrees s on s.key = o.key left join own p on o.depth > 0 and p.key = left(o.key, 32 * (o.depth - 1))"""
