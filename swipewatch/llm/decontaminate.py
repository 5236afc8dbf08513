"""Benchmark decontamination with suffix arrays over shards of the training documents.

Each task builds word suffix arrays over blocks of its documents and looks up every window of the benchmark in them by binary search: the
suffixes that start a full window, cut to it, and shorter items whole. Hits that go on together in document and item are one longest verbatim
match, with its places in both. Nothing is shuffled: the benchmark, whose size is checked, goes to the documents, in as many parts as it needs.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, Rolling, byte_class, cut, free_name, spans, steps, texts

WINDOW = 13
#: Bytes of benchmark text (estimated from a count, not from a sample) that one pass over the documents searches for.
PASS_BYTES = 2_000_000

_WORD = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
_HASH = Rolling(3)


def word_ids(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words and their first bytes' positions."""
    data = LOWER[np.frombuffer(blob, np.uint8)]
    start, end = spans(data, _WORD)
    return _HASH.of(_HASH.load(data), start, end), start


class Patterns:
    """All suffixes of the benchmark items, cut to the window, as rows of word numbers; equal ones are one pattern with its places in items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        hashes = [word_ids((text or "").encode())[0] for _, text in items]
        size = np.array([len(h) for h in hashes], np.int64)
        every = np.concatenate([*hashes, np.empty(0, np.uint64)])
        self.words = np.unique(every)
        self.window = window
        self.names = [name for name, _ in items]
        count = np.where(size > 0, np.maximum(1, size - window + 1), 0)
        item = np.repeat(np.arange(len(items)), count)
        offset = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        ids = np.append(np.searchsorted(self.words, every) + 1, np.zeros(window, np.int64)).astype(np.int32)
        length = np.minimum(size[item], window)
        begin = (np.cumsum(size) - size)[item] + offset
        rows = np.stack([np.where(length > d, ids[np.minimum(begin + d, len(ids) - 1)], 0) for d in range(window)], 1) if len(item) else np.zeros((0, window), np.int32)
        order = np.lexsort(rows.T[::-1])
        rows = rows[order]
        new = np.flatnonzero(np.append(np.ones(min(1, len(rows)), bool), (rows[1:] != rows[:-1]).any(1)))
        self.rows, self.lengths = rows[new], length[order][new]
        self.first = np.append(new, len(order))  # of pattern k, places first[k] to first[k + 1]
        self.item, self.offset = item[order].astype(np.int32), offset[order]
        # a small direct table answers for most words that they are not in the benchmark
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.words >> np.uint64(42)).astype(np.int64)] = True

    def places(self, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index in ``pattern``, place in ``item`` and ``offset``) of all places of the patterns."""
        size = self.first[pattern + 1] - self.first[pattern]
        at = np.repeat(np.arange(len(pattern)), size)
        return at, np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size) + self.first[pattern][at]

    def number(self, h: np.ndarray) -> np.ndarray:
        """Words as numbers from 1; 0 for those that no item has."""
        out = np.zeros(len(h), np.int64)
        if len(self.words):
            at = np.flatnonzero(self.maybe[(h >> np.uint64(42)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.words, h[at]), len(self.words) - 1)
            out[at] = np.where(self.words[k] == h[at], k + 1, 0)
        return out

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, pattern) of all occurrences in ``ids``, where 0 also stands between documents."""
        none = np.empty(0, np.int64)
        if not len(self.rows) or not len(ids):
            return none, none
        shortest = min(int(self.lengths.min()), self.window)
        # suffixes that hold a foreign word before the shortest pattern ends match no pattern and stay out of the array
        foreign = np.flatnonzero(np.append(ids, 0) == 0)
        begin = np.flatnonzero(ids)
        run = foreign[np.searchsorted(foreign, begin)] - begin
        begin = begin[run >= shortest]
        if not len(begin):
            return none, none
        array, keys = suffix_array(ids, begin, self.window)
        # binary search of every pattern: one word further each round, inside the interval found so far
        column = keys(0)
        low, high = (np.searchsorted(column, self.rows[:, 0], side) for side in ("left", "right"))
        on = np.flatnonzero(low < high)
        for d in range(1, self.window):
            on = on[(self.lengths[on] > d) & (low[on] < high[on])]
            if not len(on):
                break
            column, want = keys(d), self.rows[on, d]
            low[on], high[on] = _bound(column, want, low[on], high[on], "left"), _bound(column, want, low[on], high[on], "right")
        size = high - low
        which = np.repeat(np.arange(len(size)), size)
        return array[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)], which


def _bound(column: np.ndarray, want: np.ndarray, low: np.ndarray, high: np.ndarray, side: str) -> np.ndarray:
    """Vectorised bisection: each wanted value in its own sorted interval of ``column``."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        value = column[np.minimum(mid, len(column) - 1)]
        right = open_ & ((value < want) if side == "left" else (value <= want))
        low = np.where(right, mid + 1, low)
        high = np.where(open_ & ~right, mid, high)
    return low


def suffix_array(ids: np.ndarray, begin: np.ndarray, depth: int):
    """``begin`` in the order of the suffixes there, compared over ``depth`` words, and their d-th words in that order."""
    padded = np.append(ids, np.zeros(depth, np.int64))
    wide = max(1, int(ids.max())).bit_length()
    each = max(1, 62 // wide)
    packed = []
    for d in range(0, depth, each):
        key = np.zeros(len(begin), np.int64)
        for k in range(each):
            key = (key << wide) | (padded[begin + d + k] if d + k < depth else 0)
        packed.append(key)
    order = np.lexsort(packed[::-1])
    array = begin[order]
    return array, lambda d: padded[array + d]


def contamination(
    docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, pass_bytes: int = PASS_BYTES, matches: bool = False
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items`` (sorted ids of items with occurring windows) and ``places`` (word ranges hit).

    With ``matches`` also the longest verbatim matches of at least a window (or a shorter item), sorted: item, its first word's ``start`` in
    the document and ``item_start`` in the item, and ``length`` in words. An item that repeats a passage gives one match for each.

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased. A window is ``window`` consecutive words of an
    item; a shorter item, unless empty, is one window. Null and empty texts have no words and no hits; items without words occur nowhere;
    an item whose id is null counts as the empty id. Repeated items count once, repeated documents each. ``places`` are [start, end) in words,
    united where they overlap or meet. A very long text is a block of its own and takes some fifty bytes of memory a word. Rows keep their
    columns; new columns get underscores in front where a name is taken. An empty table gives an empty table.
    """
    names = [free_name(docs, c) for c in ("n_words", "n_hit", "items", "places", *(["matches"] if matches else []))]
    found = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t")).distinct()
    total = found.agg(F.coalesce(F.sum(F.octet_length("t") + F.octet_length("i") + 16), F.lit(0))).first()[0]
    parts = max(1, -(-total // pass_bytes))

    whole = [("item", T.StringType(), pa.string()), *[(c, T.LongType(), pa.int64()) for c in ("start", "item_start", "length")]]
    types = [T.LongType(), T.LongType(), T.ArrayType(T.StringType()), _RANGES, T.ArrayType(T.StructType([T.StructField(c, t) for c, t, _ in whole]))]
    new = [T.StructField(c, t) for c, t in zip(names, types, strict=False)]
    arrow = [pa.int64(), pa.int64(), pa.list_(pa.string()), _ARROW_RANGES, pa.list_(pa.struct([(c, t) for c, _, t in whole]))]

    def searched(frame: DataFrame, patterns) -> DataFrame:
        def search(batches):
            known = patterns.value
            for batch in batches:
                rows = [r for blobs in _blocks(texts(batch.column(text))) for r in _hits(blobs, known, matches)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([r[k] for r in rows], arrow[k]) for k in range(len(names))]], [*batch.schema.names, *names])

        return frame.mapInArrow(search, T.StructType([*frame.schema.fields, *new]))

    context = docs.sparkSession.sparkContext
    if parts == 1:
        return searched(docs, context.broadcast(Patterns([tuple(r) for r in found.toLocalIterator()], window)))
    # A larger benchmark is searched part by part, of which driver and tasks hold one at a time; what is found depends on the text alone, and
    # a text's ranges and items are then united.
    part = F.pmod(F.xxhash64("i", "t"), F.lit(parts))
    rows = docs.select(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("_row"), "*")
    passes = []
    for k in range(parts):
        patterns = context.broadcast(Patterns([tuple(r) for r in found.where(part == k).toLocalIterator()], window))
        passes.append(cut(searched(rows.select("_row", text), patterns).select("_row", *names).dropDuplicates(["_row"])))
        patterns.unpersist()
    lists = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(names[2])))), *[F.array_sort(F.flatten(F.collect_list(c))) for c in names[3:]]]
    merged = reduce(DataFrame.union, passes).groupBy("_row").agg(F.max(names[0]).alias(names[0]), *[x.alias(c) for x, c in zip(lists, names[2:], strict=True)])
    merged = united(merged, names[3])
    hit = F.aggregate(names[3], F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return rows.join(merged, "_row").select(*docs.columns, names[0], hit.alias(names[1]), *names[2:])


_RANGES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def united(frame: DataFrame, column: str) -> DataFrame:
    """``frame`` with the sorted ranges of ``column`` united where they overlap or meet."""

    def unite(batches):
        for batch in batches:
            ranges = batch.column(column)
            size = pa.compute.list_value_length(ranges).to_numpy(zero_copy_only=False).astype(np.int64)
            low, high = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in ranges.flatten().flatten())
            row = np.repeat(np.arange(len(size)), size)
            far = np.int64(high.max(initial=0) + 2)  # keeps rows apart in one running maximum
            reach = np.maximum.accumulate(high + row * far)
            begins = np.append(np.ones(min(1, len(row)), bool), (low + row * far)[1:] > reach[:-1])
            new = np.flatnonzero(begins)
            end = reach[np.append(new[1:], len(row)) - 1] - row[new] * far if len(new) else new
            offsets = np.append(0, np.cumsum(np.bincount(row[new], minlength=len(size))))
            made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(low[new]), pa.array(end)], ["start", "end"]))
            yield batch.set_column(batch.schema.get_field_index(column), column, made)

    return frame.mapInArrow(unite, frame.schema)


def _blocks(blobs: list[bytes]):
    for a, b in steps([len(x) for x in blobs]):
        yield blobs[a:b]


def _hits(blobs: list[bytes], known: Patterns, matches: bool = False) -> list[tuple]:
    """(n_words, n_hit, items, places, matches) of each text of a block."""
    if not blobs:
        return []
    joined = b"\n".join(blobs)
    h, at = word_ids(joined)
    ends = np.cumsum([len(x) + 1 for x in blobs])
    doc = np.searchsorted(ends, at, "right")
    n_words = np.bincount(doc, minlength=len(blobs))
    first = np.cumsum(n_words) - n_words
    # a 0 between documents keeps matches inside them
    ids = np.zeros(len(h) + len(blobs), np.int64)
    ids[np.arange(len(h)) + doc] = known.number(h)
    position, pattern = known.search(ids)
    out = [(int(n), 0, [], [], []) for n in n_words]
    if not len(position):
        return out
    owner = np.searchsorted(first + n_words + np.arange(len(blobs)), position, "right")
    order = np.lexsort((position, owner))
    position, pattern, owner = position[order], pattern[order], owner[order]
    cuts = np.flatnonzero(np.diff(owner, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(owner)], strict=True):
        d = int(owner[a])
        start = position[a:b] - first[d] - d
        end = np.maximum.accumulate(start + known.lengths[pattern[a:b]])
        new = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
        low, high = start[new], end[np.append(new[1:] - 1, len(end) - 1)]
        items = sorted({known.names[i] for i in np.unique(known.item[known.places(np.unique(pattern[a:b]))[1]])})
        ranges = [{"start": int(x), "end": int(y)} for x, y in zip(low, high, strict=True)]
        out[d] = (int(n_words[d]), int((high - low).sum()), items, ranges, _chains(start, pattern[a:b], known) if matches else [])
    return out


def _chains(start: np.ndarray, pattern: np.ndarray, known: Patterns) -> list[dict]:
    """Longest verbatim matches: hits of one item whose places in document and item go on together, word by word."""
    at, place = known.places(pattern)
    begin, item, offset, size = start[at], known.item[place], known.offset[place], known.lengths[pattern[at]]
    order = np.lexsort((begin, begin - offset, item))
    begin, item, offset, size = begin[order], item[order], offset[order], size[order]
    new = np.flatnonzero(np.append(True, (np.diff(item) != 0) | (np.diff(begin - offset) != 0) | (np.diff(begin) != 1)))
    last = np.append(new[1:], len(begin)) - 1
    found = sorted((known.names[item[a]], int(begin[a]), int(offset[a]), int(begin[z] + size[z] - begin[a])) for a, z in zip(new, last, strict=True))
    return [dict(zip(("item", "start", "item_start", "length"), x, strict=True)) for x in found]


def is_contaminated(n_words, n_hit):
    """At least a twentieth of the words are hit."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without contaminated documents, columns as before."""
    marked = contamination(docs, items)
    new = [c for c in marked.columns if c not in docs.columns]
    return marked.where(~is_contaminated(F.col(new[0]), F.col(new[1]))).select(*docs.columns)


def op3_benchmark_decontamination(spark, sf_dir):
    from .common import table

    out = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"))


def brute_force(text: str | None, items: list[tuple]) -> tuple:
    """The same columns for one document, found word by word."""
    import re

    cut = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    words, hit, names = cut(text), set(), set()
    for name, t in items:
        w = cut(t)
        for i in range(max(1, len(w) - WINDOW + 1) if w else 0):
            p = w[i : i + WINDOW]
            for k in range(len(words) - len(p) + 1):
                if words[k : k + len(p)] == p:
                    hit |= set(range(k, k + len(p)))
                    names.add(str(name))
    joined = ",".join(sorted(names))
    return len(words), len(hit), len(names), hashlib.sha256(joined.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)
