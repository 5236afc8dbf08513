"""Suffix-array dedup by prefix-free parsing: bytes that a long enough repeated string covers are removed.

Parsing. A rolling hash picks triggers: the trigger of a string of LENGTH bytes is the leftmost smallest hash among its first SPREAD starts,
so every such string has one and it depends on nothing but the string. Strings that start at consecutive bytes and have the same trigger form
a phrase: the bytes from the first of these starts to the end of the last string. Two equal strings have equal triggers at equal offsets, so
they lie in phrases that agree on the KEY bytes behind the trigger, which each string of a phrase holds in any case.

Dictionary. Phrases are counted by these bytes and by all their bytes. A phrase that occurs twice has only repeated strings. One whose key no
other phrase has, has none. Only different phrases with a common key are left, each once, however often it occurs.

Order. Their suffixes are put into corpus order as far as LENGTH bytes: a suffix array of each part of the dictionary, by prefix doubling,
shows which neighbours share LENGTH bytes; ranks beyond them are not needed, so none are computed. Equal strings have a common key and so a
common part, but for keys with very many phrases, which are dealt over parts whose strings are then added up by their fingerprints.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Rolling, ensure_checkpoint_dir, free_name, texts

LENGTH = 200
SPREAD = 128
#: Bytes that a trigger's hash covers.
TRIGGER = 12
#: Bytes of a text that are parsed at once; neighbouring pieces overlap by a string.
PIECE = 1_000_000
#: Bytes of dictionary that one suffix array is built over.
ARRAY_BYTES = 2_000_000
#: Different phrases of one key that are left in one part.
PART_PHRASES = 3_000

_A, _B = Rolling(21), Rolling(22)


def phrases(data: np.ndarray, length: int = LENGTH, spread: int = SPREAD) -> tuple[np.ndarray, ...]:
    """Of a text's bytes: first start and last start of each phrase, its key and its fingerprint."""
    n = len(data) - length + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    width = min(TRIGGER, length - spread + 1)
    key = length - spread + 1
    sums = _A.load(data)
    at = np.arange(n + spread - 1)
    # hash above, place below: ties go to the leftmost
    least = (_A.of(sums, at, at + width) & ~np.uint64(0xFFFFFF)) | at.astype(np.uint64)
    done = 1
    while done < spread:  # minima of ever longer runs of starts
        step = min(done, spread - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    trigger = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    low = np.flatnonzero(np.diff(trigger, prepend=-1))
    high = np.append(low[1:], n) - 1
    t = trigger[low]
    # the fingerprint also tells where in the phrase the trigger is; it has to differ among phrases of one key only
    return low, high, _A.of(sums, t, t + key), _B.of(_B.load(data), low, high + length) ^ (t - low).astype(np.uint64)


def pieces(blob: bytes, length: int, piece: int = PIECE):
    """(offset, bytes) so that every string of ``length`` bytes lies whole in exactly one piece."""
    for at in range(0, max(1, len(blob) - length + 1), piece):
        yield at, np.frombuffer(blob, np.uint8, min(len(blob), at + piece + length - 1) - at, at)


def order(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Ranks of the strings of ``length`` bytes at ``starts``, equal for equal strings: prefix doubling over all of ``data``."""
    rank, width = data.astype(np.int64), 1
    while width * 2 <= length:
        pair = rank[:-width] * (int(rank.max()) + 1) + rank[width:]
        rank, width = np.unique(pair, return_inverse=True)[1], 2 * width
    if width < length:
        rest = length - width
        return np.unique(rank[starts] * (int(rank.max()) + 1) + rank[starts + rest], return_inverse=True)[1]
    return np.unique(rank[starts], return_inverse=True)[1]




def _parse(blob: bytes, length: int, spread: int) -> tuple[np.ndarray, ...]:
    """``phrases`` of a whole text, piece by piece."""
    out = []
    for offset, data in pieces(blob, length):
        low, high, k, a = phrases(data, length, spread)
        out.append((low + offset, high + offset, k, a))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, which cuts its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _dictionary(marked: DataFrame, length: int, spread: int) -> DataFrame:
    """Rows (kind, uid, c, a, k, sure): kind 0 says that all strings of phrase ``a`` of a text repeat; kind 1 lists, once each, the different
    phrases that share a key, ``sure`` if the phrase itself occurs twice."""
    def parsed(batches):
        for batch in batches:
            uid, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            seen: dict[bytes, int] = {}
            for i, blob in enumerate(texts(batch.column(2))):
                seen.setdefault(blob, i)
            copies = np.bincount([seen[b] for b in texts(batch.column(2))], minlength=len(uid))
            found = [(i, _parse(blob, length, spread)) for blob, i in seen.items() if len(blob) >= length]
            if not found:
                continue
            k, a = (np.concatenate([f[j] for _, f in found]) for j in (2, 3))
            text = np.repeat([i for i, _ in found], [len(f[2]) for _, f in found])
            order = np.lexsort((text, a, k))
            k, a, text = k[order], a[order], text[order]
            first = np.append(True, (k[1:] != k[:-1]) | (a[1:] != a[:-1]))
            number = np.cumsum(first) - 1
            many = (np.bincount(number, copies[text]) >= 2)[number]
            new_text = np.append(True, text[1:] != text[:-1]) | first
            # once a phrase for the batch; for its other texts it is known already that it repeats, so they need not meet anywhere
            keep = first | many & new_text
            k, a, text, first, many = k[keep], a[keep], text[keep], first[keep], many[keep]
            spread_out = (a * np.uint64(0x9E3779B97F4A7C15)) ^ uid[text].view(np.uint64)
            g = np.where(first, k, spread_out).view(np.int64)
            for at in range(0, len(g), 50_000):
                part = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(x[part]) for x in (g, a.view(np.int64), uid[text], c[text], first, many)], ["g", "a", "uid", "c", "first", "many"])

    rows = marked.select("uid", "c", "_text").mapInArrow(parsed, "g long, a long, uid long, c int, first boolean, many boolean")

    def grouped(batches):
        names = ["kind", "uid", "c", "a", "k", "sure"]

        def packed(kind, uid, c, a, k, sure):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(uid), kind, np.int32)), pa.array(uid), pa.array(c), pa.array(a), pa.array(k), pa.array(sure)], names)

        held: list[np.ndarray] = []  # rows of the last key so far, one for each different phrase, sorted by phrase
        for batch in _with_end(batches):
            if batch is None:
                now, rest = held, None
            else:
                cols = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
                known = ~cols[4]
                if known.any():
                    yield packed(0, *[x[known] for x in (cols[2], cols[3], cols[1], cols[0])], cols[5][known])
                cols = [x[cols[4]] for x in cols]
                if held:
                    cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
                if not len(cols[0]):
                    continue
                end = np.searchsorted(cols[0], cols[0][-1])
                now, rest = [x[:end] for x in cols], [x[end:] for x in cols]
                if rest is not None and len(rest[0]):
                    # of an unfinished key, what is settled goes out and one row of each phrase is held
                    rest, out = _settled(rest)
                    if len(out[0]):
                        yield packed(0, *out)
            if now and len(now[0]):
                now, out = _settled(now)
                if len(out[0]):
                    yield packed(0, *out)
                g, a, uid, c, _, many = now
                if many.any():
                    yield packed(0, uid[many], c[many], a[many], g[many], many[many])
                different = np.append(True, g[1:] != g[:-1])
                shared = (np.bincount(np.cumsum(different) - 1) >= 2)[np.cumsum(different) - 1]
                if shared.any():
                    yield packed(1, uid[shared], c[shared], a[shared], g[shared], many[shared])
            held = rest

    return rows.repartition("g").sortWithinPartitions("g", "a").mapInArrow(grouped, "kind int, uid long, c int, a long, k long, sure boolean")


def _with_end(batches):
    yield from batches
    yield None


def _settled(rows: list[np.ndarray]) -> tuple[list[np.ndarray], tuple]:
    """Of rows sorted by key and phrase: the first of each phrase, ``many`` if there are several, and (uid, c, a, k, sure) of the others."""
    g, a, uid, c, first, many = rows
    new = np.append(True, (g[1:] != g[:-1]) | (a[1:] != a[:-1]))
    number = np.cumsum(new) - 1
    many = (np.bincount(number, 1 + many) >= 2)[number]
    other = ~new
    return [x[new] for x in (g, a, uid, c, first, many)], (uid[other], c[other], a[other], g[other], many[other])


def _order(bodies: DataFrame, length: int) -> DataFrame:
    """Rows (kind, uid, c, lo, hi, f1, f2, n): kind 0 are ranges of starts of repeated strings; kind 1 are strings of keys that are dealt over
    several parts, with how often the part has them."""
    names = ["kind", "uid", "c", "lo", "hi", "f1", "f2", "n"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def array(rows):
        """Suffix array of a block that holds whole parts."""
        uid, c, lo, sure, split, body = (list(x) for x in zip(*rows, strict=True))
        size = np.array([len(b) for b in body])
        data = np.frombuffer(b"".join(body), np.uint8)
        begin = np.cumsum(size) - size
        count = size - length + 1
        owner = np.repeat(np.arange(len(body)), count)
        off = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        starts = begin[owner] + off
        rank = order(data, starts, length)
        sure, split = np.array(sure), np.array(split)
        times = np.bincount(rank, np.where(sure[owner], 2, 1))
        hit = (times[rank] >= 2) & ~sure[owner]
        edge = np.flatnonzero(np.diff(np.append(np.append(0, hit.astype(np.int8)), 0)))
        new = np.append(True, owner[1:] != owner[:-1])
        out = [[] for _ in names]

        def add(kind, o, lo_, hi_, f1=None, f2=None, n=None):
            k = len(o)
            zero = np.zeros(k, np.int64)
            for x, y in zip(out, (np.full(k, kind), uid_a[o], c_a[o], lo_, hi_, zero if f1 is None else f1, zero if f2 is None else f2, zero if n is None else n), strict=True):
                x.append(y)

        uid_a, c_a, lo_a = np.array(uid, np.int64), np.array(c, np.int64), np.array(lo, np.int64)
        inner = np.flatnonzero(new & hit & np.append(False, hit[:-1]))  # a run may go on into the next phrase's starts
        edge = np.sort(np.concatenate([edge, inner, inner]))
        a, b = edge[::2], edge[1::2] - 1
        add(0, owner[a], lo_a[owner[a]] + off[a], lo_a[owner[a]] + off[b])
        if split.any():
            some = split[owner]
            # strings that the part settles need a row only once, the others each
            once = np.zeros(len(rank), bool)
            once[np.unique(rank, return_index=True)[1]] = True
            w = np.flatnonzero(some & (once | (~hit & ~sure[owner])))
            one, two = _A.load(data), _B.load(data)
            f1, f2 = (h.of(x, starts[w], starts[w] + length).view(np.int64) for h, x in ((_A, one), (_B, two)))
            add(1, owner[w], lo_a[owner[w]] + off[w], lo_a[owner[w]] + off[w], f1, f2, times[rank[w]].astype(np.int64))
        return [np.concatenate(x) for x in out]

    def ordered(batches):
        def blocks():
            now, size, last = [], 0, None
            for batch in batches:
                for k, part, *row in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                    if size > ARRAY_BYTES and (k, part) != last:
                        yield now
                        now, size = [], 0
                    now.append(row)
                    size += len(row[-1])
                    last = (k, part)
            if now:
                yield now

        for block in blocks():
            out = array(block)
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x).cast(t) for x, t in zip(out, kinds, strict=True)], names)

    return bodies.mapInArrow(ordered, "kind int, uid long, c int, lo int, hi int, f1 long, f2 long, n long")


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, spread: int = SPREAD, part_phrases: int = PART_PHRASES) -> DataFrame:
    """``docs`` with ``spans`` (byte ranges [start, end) of the UTF-8 text that repeated strings of ``length`` bytes cover, each as long as
    can be) and ``kept`` (the remaining bytes, joined).

    A string repeats if it also starts anywhere else, in the same text or another; repeated rows are different texts, so they lose all that
    is long enough. Overlaps count, and matches never cross texts. Null and empty texts have no bytes. Rows keep their columns; a taken name
    gets underscores in front. An empty table gives an empty table.
    """
    if not 0 < spread <= length:
        raise ValueError("spread must be from 1 to length")
    whole = F.coalesce(F.col(text), F.lit(""))
    marked = docs.select(F.xxhash64(whole).alias("uid"), F.crc32(whole.cast("binary")).bitwiseAND(0x3FFFFFFF).cast("int").alias("c"), whole.alias("_text"), F.struct(F.lit(True).alias("_there"), *[F.col(f"`{x}`") for x in docs.columns if x != text], F.col(text).isNull().alias("_null")).alias("_rest"))
    found = _written(_dictionary(marked, length, spread))
    shared = found.where("kind = 1")
    parts = shared.groupBy("k").agg(F.ceil(F.count("*") / part_phrases).cast("int").alias("parts")).where("parts > 1")
    shared = shared.join(parts, "k", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    shared = shared.select("uid", "c", "a", "k", "sure", (F.col("parts") > 1).alias("split"), F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    wanted = shared.groupBy("uid", "c").agg(F.collect_list(F.struct("a", "k", "part", "sure", "split")).alias("wanted"))  # at most a text's phrases

    def cut_out(batches):
        names = ["k", "part", "uid", "c", "lo", "sure", "split", "body"]
        for batch in batches:
            uid, c = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = [[] for _ in names]
            for i, (blob, want) in enumerate(zip(texts(batch.column(2)), batch.column(3).to_pylist(), strict=True)):
                low, high, _, a = _parse(blob, length, spread)
                place = dict(zip(a.view(np.int64).tolist(), zip(low.tolist(), high.tolist(), strict=True), strict=True))
                for w in want:
                    lo, hi = place[w["a"]]
                    for x, y in zip(out, (w["k"], w["part"], uid[i], c[i], lo, w["sure"], w["split"], blob[lo : hi + length]), strict=True):
                        x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()), strict=True)], names)

    bodies = marked.join(wanted, ["uid", "c"]).select("uid", "c", "_text", "wanted", "_rest").drop("_rest").mapInArrow(cut_out, "k long, part int, uid long, c int, lo int, sure boolean, split boolean, body binary")
    ordered = _written(_order(bodies.repartition("k", "part").sortWithinPartitions("k", "part"), length))
    strings = ordered.where("kind = 1")
    again = strings.groupBy("f1", "f2").agg(F.sum("n").alias("all")).where("all >= 2").drop("all")
    ranges = ordered.where("kind = 0").select("uid", "c", "lo", "hi").union(strings.join(again, ["f1", "f2"]).select("uid", "c", "lo", "hi"))
    none = F.lit(None)
    told = found.where("kind = 0").select("uid", "c", "a", none.cast("struct<lo:int,hi:int>").alias("r")).union(ranges.select("uid", "c", none.cast("long"), F.struct("lo", "hi")))
    told = told.groupBy("uid", "c").agg(F.collect_set("a").alias("whole"), F.collect_list("r").alias("some"))  # at most a text's phrases and ranges

    names = [free_name(docs, x) for x in ("spans", "kept")]
    rows = marked.join(told, ["uid", "c"], "left").select("_text", "whole", "some", "_rest")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = T.StructType([T.StructField("_text", T.StringType()), rows.schema["_rest"], T.StructField("_s", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("_k", T.BinaryType())])

    def removed(batches):
        for batch in batches:
            out_s, out_k = [], []
            for blob, whole_, some in zip(texts(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not whole_ and not some:
                    out_s.append([])
                    out_k.append(blob)
                    continue
                depth = np.zeros(len(blob) + 1, np.int32)
                lo, hi = np.array([(r["lo"], r["hi"]) for r in some], np.int64).reshape(-1, 2).T
                if whole_:
                    low, high, _, a = _parse(blob, length, spread)
                    at = np.isin(a.view(np.int64), np.array(whole_, np.int64))
                    lo, hi = np.append(lo, low[at]), np.append(hi, high[at])
                np.add.at(depth, lo, 1)
                np.add.at(depth, hi + length, -1)
                gone = np.cumsum(depth)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                out_s.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
                out_k.append(np.frombuffer(blob, np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(out_s, span), pa.array(out_k, pa.binary())], schema.fieldNames())

    out = rows.mapInArrow(removed, schema)
    own = F.when(~F.col("_rest._null"), F.col("_text"))
    return out.select(*[(own if x == text else F.col(f"_rest.`{x}`")).alias(x) for x in docs.columns], F.col("_s").alias(names[0]), F.col("_k").alias(names[1]))


def op2_suffix_array_dedup(spark, sf_dir):
    from .common import table

    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return out.select("doc_id", n.alias("n_bytes"), (n - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
