"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are fitted on a bounded sample of labelled documents and flattened into arrays; scoring walks all trees of a batch of documents at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, Rolling, byte_class, free_name, spans, steps, texts

#: Labelled documents that the trees are fitted on, at most: those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
ROUNDS, DEPTH, RATE, BINS, LEAST_WEIGHT, SHRINK = 120, 4, 0.1, 64, 2.0, 1.0

_HASH = Rolling(1)
_SPACE = byte_class((9, 13), (32, 32))
_LETTER = byte_class((65, 90), (97, 122), (128, 255))
#: Groups of bytes whose shares are statistics.
_GROUPS = {
    "upper": byte_class((65, 90)), "lower": byte_class((97, 122)), "digit": byte_class((48, 57)), "other": byte_class((128, 255)), "space": _SPACE, "line": byte_class((10, 10)),
    "bar": byte_class((124, 124)), "bang": byte_class((33, 33), (63, 63)), "stop": byte_class((44, 44), (46, 46), (58, 59)), "sign": byte_class((35, 38), (42, 43), (61, 61), (64, 64), (94, 96), (126, 126)),
    "bracket": byte_class((40, 41), (60, 60), (62, 62), (91, 93), (123, 123), (125, 125)), "rest": byte_class((0, 8), (14, 31), (34, 34), (39, 39), (45, 45), (47, 47), (127, 127)),
}
NAMES = [
    "log_bytes", "log_words", "word_length", "word_length_spread", "long_words", "short_words", "bytes_a_line", "repeated_bytes", "distinct_words", "repeated_pairs", "repeated_lines",
    "words_without_letters", "signs_in_words", "capital_words", "ends_of_sentences", *_GROUPS,
]
_CLASS = np.zeros(256, np.uint8)
for _i, _g in enumerate(_GROUPS.values()):
    _CLASS[_g] = _i


def statistics(blobs: list[bytes]) -> np.ndarray:
    """A row of NAMES for each text; whole texts count. An empty text has zeros."""
    out = np.zeros((len(blobs), len(NAMES)))
    for a, b in steps([len(x) for x in blobs]):
        out[a:b] = _statistics(blobs[a:b])
    return out


def _statistics(blobs: list[bytes]) -> np.ndarray:
    n = len(blobs)
    size = np.array([len(x) for x in blobs])
    raw = np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)
    ends = np.cumsum(size + 1)
    doc = np.repeat(np.arange(n, dtype=np.int32), size + 1)
    count = lambda ids, weights=None: np.bincount(ids, weights, n)[:n]
    shares = np.bincount(doc.astype(np.int64) * 16 + _CLASS[raw], minlength=16 * n).reshape(n, 16)[:, : len(_GROUPS)].astype(float)
    for g in ("space", "line"):  # the line end behind each text is not its own; a line end is counted as "line" alone
        shares[:, list(_GROUPS).index(g)] -= 1 if _CLASS[10] == list(_GROUPS).index(g) else 0
    start, end = spans(raw, ~_SPACE)
    of, length = doc[start], (end - start).astype(float)
    words = count(of)
    lower = LOWER[raw]
    sums = _HASH.load(lower)
    h = _HASH.of(sums, start, end)
    letters = np.concatenate([[0], np.cumsum(_LETTER[raw], dtype=np.int64)])
    uppers = np.concatenate([[0], np.cumsum(_GROUPS["upper"][raw], dtype=np.int64)])
    in_word, up = letters[end] - letters[start], uppers[end] - uppers[start]
    last = raw[end - 1] if len(end) else np.empty(0, np.uint8)
    line_start, line_end = spans(raw, ~_GROUPS["line"])
    line_doc = doc[line_start]

    def repeated(owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """How many of each document's keys have come before in it."""
        if not len(keys):
            return np.zeros(n)
        k = np.sort((keys >> np.uint64(24)) | (owner.astype(np.uint64) << np.uint64(40)))
        again = k[1:] == k[:-1]
        return count((k[1:][again] >> np.uint64(40)).astype(np.int64))

    same = (raw[1:] == raw[:-1]) & ~_SPACE[raw[1:]]
    pair = (of[1:] == of[:-1]) if len(of) else np.empty(0, bool)
    pairs = (h[1:] * np.uint64(0x9E3779B97F4A7C15) ^ h[:-1])[pair] if len(of) else np.empty(0, np.uint64)
    w, s, lines = np.maximum(words, 1), np.maximum(size, 1), np.maximum(count(line_doc), 1)
    mean = count(of, length) / w
    columns = [
        np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(0, count(of, length**2) / w - mean**2)), count(of, length >= 14) / w, count(of, length <= 2) / w, size / lines,
        count(doc[1:], same) / s, 1 - repeated(of, h) / w, repeated(of[1:][pair], pairs) / w, repeated(line_doc, _HASH.of(sums, line_start, line_end)) / lines,
        count(of, in_word == 0) / w, count(of, length - in_word > 1) / w, count(of, (in_word > 1) & (up == in_word)) / w, count(of, last == 46) / w,
    ]
    return np.where((size > 0)[:, None], np.concatenate([np.stack(columns, 1), shares / s[:, None]], 1), 0.0)


@dataclass
class Trees:
    """Complete trees of equal depth in arrays: node k has children 2k+1 and 2k+2; leaves are numbered from the left."""

    base: float
    feature: np.ndarray  # (trees, inner nodes)
    bound: np.ndarray
    leaf: np.ndarray  # (trees, leaves)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        trees, inner = self.feature.shape
        if trees and len(x):
            t = np.arange(trees)
            for a in range(0, len(x), 4096):
                part = x[a : a + 4096]
                at = np.zeros((len(part), trees), np.int64)
                row = np.arange(len(part))[:, None]
                while at[0, 0] < inner:
                    at = 2 * at + 1 + (part[row, self.feature[t, at]] > self.bound[t, at])
                total[a : a + 4096] += self.leaf[t, at - inner].sum(1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH) -> Trees:
    """Logistic boosting over binned statistics. Without both labels the score is the share of 1, and 0.5 without any."""
    inner, leaves = 2**depth - 1, 2**depth
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    model = Trees(float(np.log(share / (1 - share))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if len(np.unique(y)) < 2:
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    flat = binned + np.arange(x.shape[1]) * BINS  # one histogram holds all statistics
    raw, features, bounds, values = np.full(len(y), model.base), [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, bound = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            cells = ((node - first)[:, None] * flat.shape[1] * BINS + flat).ravel()
            g, h = (np.bincount(cells, np.repeat(v, flat.shape[1]), width * flat.shape[1] * BINS).reshape(width, -1, BINS).cumsum(2) for v in (grad, hess))
            all_g, all_h = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + SHRINK) + (all_g - g) ** 2 / (all_h - h + SHRINK) - all_g**2 / (all_h + SHRINK)
            gain[(h < LEAST_WEIGHT) | (all_h - h < LEAST_WEIGHT)] = 0
            best = gain.reshape(width, -1).argmax(1)
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            f, b = best // BINS, best % BINS
            for k in np.flatnonzero(good):
                feature[first + k], bound[first + k] = f[k], edges[f[k]][b[k]]
            cut_at = np.where(good, b, BINS)
            k = node - first
            node = 2 * node + 1 + (binned[np.arange(len(y)), f[k]] > cut_at[k])
        at = node - inner
        leaf = RATE * np.bincount(at, grad, leaves) / (np.bincount(at, hess, leaves) + SHRINK)
        raw += leaf[at]
        features.append(feature), bounds.append(bound), values.append(leaf)
    return Trees(model.base, np.array(features), np.array(bounds), np.array(values))


def held_out(key: str) -> Column:
    """A fifth of all ids, by CRC-32 of their text; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS) -> Trees:
    """Trees from at most ``rows`` labelled documents that are not held out. Rows with null ids or labels other than 0 and 1 teach nothing;
    a document labelled twice takes the smaller label."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("_k")).agg(F.min(label).cast("double").alias("_y"))
    known = known.orderBy(F.xxhash64("_k"), "_k").limit(rows)
    sample = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(known), "_k").select("_t", "_y")  # at most ``rows`` ids

    def measured(batches):
        for batch in batches:
            x = statistics(texts(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    got = sample.mapInArrow(measured, "x array<double>, y double").toArrow()
    if not got.num_rows:
        return fit(np.empty((0, len(NAMES))), np.empty(0))
    x, y = np.array(got["x"].to_pylist()), got["y"].to_numpy()
    order = np.lexsort((*x.T, y))  # sums do not depend on the order in which rows arrive
    return fit(x[order], y[order])


def scored(docs: DataFrame, model: Trees, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` (all) of ``docs`` with ``score`` from 0 to 1; null texts score as empty ones. Repeated rows are kept; a taken name gets an
    underscore in front."""
    kept = docs.columns if columns is None else columns
    rows = docs.select(F.col(text).alias("_text"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(kept)])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("_s", T.DoubleType())])

    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sent.value.score(statistics(texts(batch.column(0)))))], schema.fieldNames())

    name = free_name(docs, "score")
    return rows.mapInArrow(score, schema).toDF(*kept, name)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score below the threshold, columns as before."""
    out = scored(docs, train(docs, labels))
    return out.where(F.col(out.columns[-1]) >= THRESHOLD).select(*docs.columns)


def op1_quality_classifier(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")), columns=["doc_id"])
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
