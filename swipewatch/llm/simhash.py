"""SimHash near-dedup by anchor-point covering.

Anchors are the words of a covering code. A pair of fingerprints that differ in at most THRESHOLD bits differ in at most a third of that
(rounded down) in one of three blocks of the 64 bits. On a block, each fingerprint has a home, the nearest code word of each part, at most
the covering radius away; whatever links to it lies within radius plus threshold of that home. So a fingerprint goes to its home and, as a
visitor, to every anchor within radius plus threshold, and homes are compared with visitors, anchor by anchor. The search is exact.
"""

from __future__ import annotations

from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, cut, free_name, texts

SHINGLE = 4
THRESHOLD = 4
SEED = 42
#: Comparisons that one cell of an anchor may need; homes of a fuller anchor are dealt over several cells.
CELL_PAIRS = 20_000_000
_SHINGLES_AT_ONCE = 100_000

#: Generator polynomials of the perfect binary codes, as (length, polynomial, covering radius).
GOLAY = (23, 0b101011100011, 3)
HAMMING = (15, 0b10011, 1)
#: All words of a few bits: radius 0.
RAW3 = (3, 1, 0)
#: Parts of the three blocks, from the lowest bit on.
BLOCKS = ((GOLAY,), (GOLAY,), (HAMMING, RAW3))


def fingerprint(blob: bytes, words_each: int = SHINGLE) -> int:
    """A bit is 1 if more than half of the shingles' hashes have it; no words: 0. A shorter text is one shingle."""
    words = blob.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words)))
    ends = [e + i for i, e in enumerate(ends)]
    starts = [0, *[e + 1 for e in ends[:-1]]]
    k = min(words_each, len(words))
    bounds, n, digest = list(zip(starts, ends[k - 1 :])), len(words) - k + 1, xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _SHINGLES_AT_ONCE):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in bounds[at : at + _SHINGLES_AT_ONCE]], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for part in range(0, len(bits), 255):
            ones += bits[part : part + 255].sum(0, dtype=np.uint8)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@cache
def _coset(code: tuple, extra: int):
    """Of a code: each bit's syndrome, and by syndrome all error patterns up to ``extra`` over the radius with their excess."""
    length, poly, radius = code
    check = poly.bit_length() - 1

    def remainder(x: int) -> int:
        while x.bit_length() > check:
            x ^= poly << (x.bit_length() - 1 - check)
        return x

    bit = [remainder(1 << i) for i in range(length)]
    found: list[list[tuple[int, int]]] = [[] for _ in range(1 << check)]
    for weight in range(radius + extra + 1):
        for places in combinations(range(length), weight):
            s = 0
            for p in places:
                s ^= bit[p]
            found[s].append((max(0, weight - radius), sum(1 << p for p in places)))
    for f in found:
        f.sort()
    sizes = np.array([len(f) for f in found])
    flat = np.array([x for f in found for x in f], np.int64).reshape(-1, 2)
    return np.array(bit, np.int64), sizes, np.cumsum(sizes) - sizes, flat


def _near(code: tuple, values: np.ndarray, extra: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code word, excess) for all words within radius plus ``extra`` of each value; the nearest comes first."""
    bit, sizes, first, flat = _coset(code, extra)
    s = np.zeros(len(values), np.int64)
    for i, b in enumerate(bit):
        s ^= ((values >> i) & 1) * b
    n = sizes[s]
    row = np.repeat(np.arange(len(values)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[s], n)
    return row, values[row] ^ flat[at, 1], flat[at, 0]


def anchors(prints: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) of 64-bit fingerprints; anchors of different blocks differ."""
    out, shift, extra = [], 0, threshold // len(BLOCKS)
    for number, parts in enumerate(BLOCKS):
        row, word, over, home, width = np.arange(len(prints)), np.zeros(len(prints), np.int64), np.zeros(len(prints), np.int64), np.ones(len(prints), bool), 0
        for code in parts:
            value = ((prints >> np.uint64(shift)) & np.uint64((1 << code[0]) - 1)).astype(np.int64)
            near_row, near_word, near_over = _near(code, value, extra)
            n = np.bincount(near_row, minlength=len(prints))
            begin = np.cumsum(n) - n
            mine = np.repeat(np.arange(len(row)), n[row])
            k = np.arange(len(mine)) - np.repeat(np.cumsum(n[row]) - n[row], n[row])
            at = begin[row[mine]] + k
            row, word, over, home = row[mine], word[mine] | (near_word[at] << width), over[mine] + near_over[at], home[mine] & (k == 0)
            keep = over <= extra
            row, word, over, home = row[keep], word[keep], over[keep], home[keep]
            shift, width = shift + code[0], width + code[0]
        out.append((row, word | (number << 60), home))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _forest(homes: np.ndarray, visitors: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is linked between ``homes`` and ``visitors`` directly or over others, one fewer than each connected group has members."""
    root = np.arange(len(visitors))
    where = np.searchsorted(visitors, homes)  # each home also visits its own anchor
    a, b = [], []

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    step = max(1, 4_000_000 // max(1, len(visitors)))
    for at in range(0, len(homes), step):
        close = np.bitwise_count(homes[at : at + step, None] ^ visitors[None, :]) <= threshold
        for i in np.flatnonzero(close.sum(1) > 1):
            mine = top(where[at + i])
            near = np.flatnonzero(close[i])
            for j in near[root[near] != mine]:
                other = top(j)
                if other != mine:
                    a.append(visitors[where[at + i]])
                    b.append(visitors[j])
                    root[other] = mine
    return np.array(a, np.uint64), np.array(b, np.uint64)


def links(prints: DataFrame, threshold: int = THRESHOLD, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``) that connect all those at ``threshold`` or fewer differing bits."""
    schema = "fp long, anchor long, home boolean"

    def dealt(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
            for at in range(0, len(fp), 50_000):
                row, anchor, home = anchors(fp[at : at + 50_000], threshold)
                yield pa.RecordBatch.from_arrays([pa.array(fp[at + row].view(np.int64)), pa.array(anchor), pa.array(home)], ["fp", "anchor", "home"])

    rows = prints.select("fp").mapInArrow(dealt, schema)
    # An anchor with many comparisons is dealt over cells: its homes by hash, its visitors to each cell. Anchors are few (BLOCKS), so are their counts.
    sizes = rows.groupBy("anchor").agg(F.count("*").alias("v"), F.count_if("home").alias("h"))
    full = sizes.select("anchor", F.ceil(F.col("v") * F.col("h") / cell_pairs).cast("int").alias("cells")).where("cells > 1")
    rows = rows.join(full, "anchor", "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int")
    rows = rows.select("anchor", "fp", F.when(F.col("home"), mine).otherwise(-1).alias("own"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
    rows = rows.select("anchor", "cell", "fp", (F.col("own") == F.col("cell")).alias("home"))

    def compared(batches):
        def group(parts):
            fp, home = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(fp)
            fp, home = fp[order], home[order]
            return _forest(fp[home], fp, threshold) if home.any() and len(fp) > 1 else (np.empty(0, np.uint64),) * 2

        def grouped():
            now, parts = None, []
            for batch in batches:
                key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)])
                fp, home = batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), key.shape[1]]
                for s, e in zip(cuts, cuts[1:]):
                    if s == e:
                        continue
                    if now is not None and (key[:, s] != now).any():
                        yield group(parts)
                        parts = []
                    now = key[:, s]
                    parts.append((fp[s:e], home[s:e]))
            if parts:
                yield group(parts)

        for a, b in grouped():
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return rows.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell").mapInArrow(compared, "a long, b long").distinct()


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", columns: list[str] | None = None, words_each: int = SHINGLE, threshold: int = THRESHOLD, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """``columns`` (all) of ``docs`` with ``fingerprint`` (16 hex digits), ``component_id`` and ``component`` (a number that all rows of a component share).

    Documents link if their fingerprints differ in at most ``threshold`` bits; ``component_id`` is the smallest ``key`` reachable, nulls
    aside; null if all are null. Null, empty and blank texts have fingerprint zero and link like any other. Repeated rows are kept and
    link to each other. New columns get underscores in front where a name is taken. An empty table gives an empty table.
    """
    kept = docs.columns if columns is None else columns
    names = [free_name(docs, c) for c in ("fingerprint", "component_id", "component")]
    rows = docs.select(F.col(text).alias("_text"), F.col(key).alias("_key"), F.struct(F.lit(True).alias("_there"), *[F.col(f"`{c}`") for c in kept]).alias("_rest"))
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("_fp", T.LongType())])

    def printed(batches):
        for batch in batches:
            got = np.array([fingerprint(x, words_each) for x in texts(batch.column(0))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(got)], schema.fieldNames())

    marked = cut(rows.mapInArrow(printed, schema))
    classes = cut(marked.groupBy(F.col("_fp").alias("fp")).agg(F.min("_key").alias("least")))
    group = components(links(classes, threshold, cell_pairs), "a", "b")
    of = classes.join(group, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    of = of.select("fp", "component").join(least, "component")
    out = marked.join(of.select(F.col("fp").alias("_fp"), "component", "component_id"), "_fp")
    return out.select(*[F.col(f"_rest.`{c}`").alias(c) for c in kept], F.lpad(F.lower(F.hex("_fp")), 16, "0").alias(names[0]), F.col("component_id").alias(names[1]), F.col("component").alias(names[2]))


def one_of_each_group(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with the row of the smallest ``key`` of each near-duplicate group, columns as before."""
    marked = near_groups(docs, key)
    component_id, component = marked.columns[-2:]
    return marked.where(F.col(key).eqNullSafe(F.col(component_id))).dropDuplicates([component]).select(*docs.columns)


def op5_simhash_near_dedup(spark, sf_dir):
    from .common import table

    return near_groups(table(spark, sf_dir, "documents"), columns=["doc_id"]).select("doc_id", "fingerprint", "component_id")
