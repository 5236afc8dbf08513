"""Mixing to target weights with soft membership.

A classifier learned from a labelled table gives each document probabilities of domains. Projected-gradient least squares, with one Spark
job a step, fits a rate from 0 on for each document so that expected token totals of the domains meet their targets. It goes on until they
are within CLOSE of them, or until steps gain no more because no rates reach them; the distance left is part of the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, Rolling, byte_class, cut, free_name, spans, steps, texts

#: Labelled documents that the classifier learns from, at most: those with the smallest hash of their id.
SAMPLE_ROWS = 10_000
#: Shares of tokens that the mix should have.
TARGETS = {"clean": 0.96, "poor": 0.03, "toxic": 0.01}
#: Distance of a domain's share from its target at which the fit ends.
CLOSE = 1e-5
#: Weight of staying near the rates of the last round beside the squared distance, which gives each round one solution; a round that lowers
#: the squared distance by less than a thousandth ends the fit, since no rates come closer.
PULL, GAIN = 1e-6, 1e-3
#: Lengths of a step, all tried in one job.
LENGTHS = (1.0, 0.5, 0.25, 0.125, 1 / 32, 1 / 256)

#: A word teaches if the labelled documents with it differ so much in their domains from all of them, by a likelihood-ratio test of one
#: domain against the others: for a domain with a tenth of the documents, three that are all of that domain are enough.
TELLING = 12.0
DECAY = 1e-5
_BITS = 18
_BUCKETS = 1 << _BITS
_WORD = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
_HASH = Rolling(4)


def features(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value), sorted by text: each different word once, by hash, and each ASCII sign or capital by how common it is.
    Last, each text's tokens: its words and signs."""
    out, tokens = [], np.zeros(len(blobs), np.int64)
    for a, b in steps([len(x) for x in blobs]):
        part = blobs[a:b]
        size = np.array([len(x) for x in part])
        raw = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
        doc = np.repeat(np.arange(len(part), dtype=np.int64), size + 1)
        data = LOWER[raw]
        start, end = spans(data, _WORD)
        h = (_HASH.of(_HASH.load(data), start, end) >> np.uint64(64 - _BITS)).astype(np.int64)
        keys = np.unique(doc[start] * _BUCKETS + h)
        mark = ~_WORD[raw]
        sign = ~_WORD[data] & (raw > 32)
        tokens[a:b] = np.bincount(np.append(doc[start], doc[sign]), minlength=len(part))
        mark[np.cumsum(size + 1) - 1] = False
        signs, n = np.unique(doc[mark] * 128 + raw[mark], return_counts=True)
        share = n / np.maximum(size[signs // 128], 1)
        out.append((a + np.append(keys // _BUCKETS, signs // 128), np.append(keys % _BUCKETS, _BUCKETS + signs % 128), np.append(np.ones(len(keys)), np.minimum(1, 8 * share) * 8)))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), tokens
    text, feature, value = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(text, kind="stable")
    return text[order], feature[order], value[order], tokens


@dataclass
class Classifier:
    domains: list[str]
    place: np.ndarray  # by feature, its row in the next two, -1 without
    scale: np.ndarray
    weights: np.ndarray  # (kept features, domains)
    bias: np.ndarray

    def read(self, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's tokens and its probabilities of the domains."""
        text, feature, value, tokens = features(blobs)
        text, row, value = _kept(text, self.place[feature], value)
        return tokens, _softmax(_scores(text, row, _scaled(text, row, value, self.scale, len(blobs)), self.weights, len(blobs)) + self.bias)


def _kept(text, row, value):
    there = row >= 0
    return text[there], row[there], value[there]


def _scaled(text, feature, value, scale, n):
    v = value * scale[feature]
    return v / np.sqrt(np.maximum(np.bincount(text, v**2, n), 1e-12))[text]


def _scores(text, feature, value, weights, n):
    return np.stack([np.bincount(text, value * w[feature], n)[:n] for w in weights.T], 1)


def _softmax(z):
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _telling(text: np.ndarray, feature: np.ndarray, want: np.ndarray, size: int) -> np.ndarray:
    """The largest likelihood-ratio statistic of a feature's presence over the domains, each against all others."""
    n, often, best = len(want), np.bincount(feature, minlength=size), np.zeros(size)
    for mine in want.T:
        inside = np.bincount(feature, mine[text], size)
        share = mine.sum() / n
        cells = [(inside, often * share), (often - inside, often * (1 - share)), (mine.sum() - inside, (n - often) * share), (n - mine.sum() - (often - inside), (n - often) * (1 - share))]
        best = np.maximum(best, 2 * sum(np.where(got > 0, got * np.log(np.maximum(got, 0.5) / np.maximum(due, 1e-9)), 0.0) for got, due in cells))
    return best


def learn(blobs: list[bytes], domains: list[str], known: list[str], rounds: int = 200) -> Classifier:
    """Softmax regression, full gradients with a step of its own for each weight. Without examples every text gets equal probabilities."""
    return _learn(*features(blobs)[:3], domains, known, rounds)


def _learn(text: np.ndarray, feature: np.ndarray, value: np.ndarray, domains: list[str], known: list[str], rounds: int = 200) -> Classifier:
    n, size, k = len(known), _BUCKETS + 128, len(domains)
    model = Classifier(domains, np.full(size, -1), np.ones(0), np.zeros((0, k)), np.zeros(k))
    if not n:
        return model
    want = np.array([[d == x for d in domains] for x in known], float)
    keep = _telling(text, feature, want, size) >= TELLING  # other words only teach the sample by heart
    keep[_BUCKETS:] = True
    scale = np.log((1 + n) / (1 + np.bincount(feature, minlength=size))) + 0.1
    scale[_BUCKETS:] = 1.0
    size = int(keep.sum())
    model.place[keep] = np.arange(size)
    model.scale, model.weights = scale[keep], np.zeros((size, k))
    text, feature, value = _kept(text, model.place[feature], value)
    value = _scaled(text, feature, value, model.scale, n)
    model.bias = np.log(want.mean(0) + 1e-3)
    seen, bias_seen = np.full((size, k), 1e-8), np.full(k, 1e-8)
    for _ in range(rounds):
        miss = (_softmax(_scores(text, feature, value, model.weights, n) + model.bias) - want) / n
        grad = np.stack([np.bincount(feature, value * miss[text, j], size) for j in range(k)], 1) + DECAY * model.weights
        seen += grad**2
        bias_seen += miss.sum(0) ** 2
        model.weights -= 0.5 * grad / np.sqrt(seen)
        model.bias -= 0.1 * miss.sum(0) / np.sqrt(bias_seen)
    return model


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> Classifier:
    """From ``labelled`` (``key``, ``domain``), at most ``rows`` documents; null ids and other domains teach nothing, of several labels the first
    counts, and of several texts of an id the one with the smallest hash."""
    known = labelled.where(F.col("domain").isin(domains) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min("domain").alias("_d"))
    known = known.orderBy(F.xxhash64("_k"), "_k").limit(rows)
    every = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(known), "_k").withColumn("_h", F.xxhash64("_t"))  # at most ``rows`` ids
    chosen = every.groupBy("_k").agg(F.min("_h").alias("_h"))
    found = every.join(F.broadcast(chosen), ["_k", "_h"]).dropDuplicates(["_k", "_h"]).select("_t", "_h", "_d")

    def measured(batches):
        for batch in batches:
            n = batch.num_rows
            at, feature, value, _ = features(texts(batch.column(0)))
            offsets = pa.array(np.searchsorted(at, np.arange(n + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (feature.astype(np.int32), value)]
            yield pa.RecordBatch.from_arrays([*lists, *batch.columns[1:]], ["f", "v", "_h", "_d"])

    got = found.mapInArrow(measured, "f array<int>, v array<double>, _h long, _d string").toArrow()
    if not got.num_rows:
        return learn([], domains, [])
    label = got["_d"].to_pylist()
    order = np.lexsort((np.unique(label, return_inverse=True)[1], got["_h"].to_numpy()))  # sums do not depend on the order in which rows arrive
    got = got.take(pa.array(order))
    f, v = (got[c].combine_chunks() for c in "fv")
    size = np.diff(f.offsets.to_numpy())
    return _learn(np.repeat(np.arange(len(f)), size), f.flatten().to_numpy(), v.flatten().to_numpy(), domains, [label[i] for i in order])


def rates(p: np.ndarray, push: np.ndarray, most: float | None = None) -> np.ndarray:
    """What a push a domain makes of the rate 1, put back into 0 to ``most``: all that a document needs to know of the others."""
    return np.clip(1 + p @ push, 0, most)


@dataclass
class Fit:
    push: np.ndarray  # by domain
    distance: float  # of the shares reached from the targets, the largest one
    jobs: int


def fit_rates(members: DataFrame, targets: np.ndarray, tokens: str = "_n", posteriors: str = "_p", most: float | None = None, close: float = CLOSE) -> Fit:
    """Rates from 0 to ``most`` (no bound) by projected-gradient least squares, ``close`` to the targets or as near as they get.

    Distances are measured in the metric of the domains' second moments. A step moves the rates of all documents against the gradient of
    the squared distance, scaled by the second moments of the documents whose rates are free, and projects them into their range. As rates
    start at 1 and the gradient of a document is its posteriors times one number a domain, the sum of the steps is one number a domain too,
    and no rates are stored. One job tries a step at several lengths and sums one row for each task; its size depends on the domains alone.
    """
    k = len(targets)
    each = 1 + k + k * k
    top = np.inf if most is None else most

    def sums(tried: list[np.ndarray]) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """All tokens, and for every push tried its cost, the distances by domain and the second moments of documents with free rates."""
        names = ["w", *[f"s{i}" for i in range(each * len(tried))]]

        def part(batches):
            total = np.zeros(len(names))
            for batch in batches:
                n = batch.column(0).to_numpy().astype(float)
                p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(n), k)
                total[0] += n.sum()
                for i, y in enumerate(tried):
                    bare = 1 + p @ y
                    rate = np.clip(bare, 0, most)
                    free = n * ((bare > 0) & (bare < top))
                    total[1 + i * each : 1 + (i + 1) * each] += np.concatenate([[n @ (rate * bare - rate * rate / 2)], (n * rate) @ p, ((p * free[:, None]).T @ p).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names)

        rows = members.select(tokens, posteriors).mapInArrow(part, ", ".join(f"{x} double" for x in names))
        got = np.array([x or 0.0 for x in rows.agg(*[F.sum(x) for x in names]).first()])
        whole, got = got[0], got[1:].reshape(len(tried), each) / max(got[0], 1.0)
        return whole, got[:, 0] - np.array(tried) @ targets, got[:, 1 : k + 1] - targets, got[:, k + 1 :].reshape(len(tried), k, k)

    push = anchor = np.zeros(k)
    whole, costs, offs, seconds = sums([push])
    cost, off, free, jobs = costs[0], offs[0], seconds[0], 1
    if not whole:
        return Fit(push, float(np.abs(targets).max()), jobs)
    moments = free + 1e-12 * np.eye(k)  # for domains that no document has
    last = np.inf
    while np.abs(off).max() > close:
        gradient = off + PULL * moments @ (push - anchor)
        if np.abs(gradient).max() <= close / 2:  # the end of a round
            squared = off @ np.linalg.solve(moments, off)
            if squared > (1 - GAIN) * last:
                break
            last, anchor, gradient = squared, push, off
        step = np.linalg.lstsq(free + PULL * moments, -gradient, 1e-12)[0]  # posteriors of all documents may be alike
        tried = [push + x * step for x in LENGTHS]
        _, costs, offs, seconds = sums(tried)
        jobs += 1
        held = [PULL / 2 * (x - anchor) @ moments @ (x - anchor) for x in (push, *tried)]
        best = int(np.argmin(costs + held[1:]))
        if not costs[best] + held[best + 1] < cost + held[0]:  # below what sums of doubles can tell
            break
        push, cost, off, free = tried[best], costs[best], offs[best], seconds[best]
    return Fit(push, float(np.abs(off).max()), jobs)


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, key: str = "doc_id", text: str = "text", columns: list[str] | None = None, most: float | None = None) -> DataFrame:
    """``columns`` (all) of ``docs`` with ``n_words`` (words and signs, which stand for tokens), ``posteriors`` (by domain), ``rate``, ``copies`` (the
    rate, rounded up or down by a hash of id and text) and ``distance`` (of the mix from its targets, the same in all rows).

    ``labelled`` has ``key`` and ``domain``. Targets are shares of the tokens there are now. Rates have no bound unless ``most`` is given, so
    the few documents of a rare domain with a large target get large ones; targets that no rates reach are met as closely as least squares
    do. Null and empty texts have no tokens and a rate like any other, and so have very long ones, which are measured whole. Repeated rows get equal rates. New columns get
    underscores in front where a name is taken. An empty table gives an empty table.
    """
    targets = targets or TARGETS
    kept = docs.columns if columns is None else columns
    domains = sorted(targets)
    total = sum(targets.values())
    shares = np.array([targets[d] / total for d in domains])
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labelled, domains, key, text))
    rows = docs.select(F.col(text).alias("_text"), F.xxhash64(F.col(key).cast("string"), text).alias("_h"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(kept)])
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("_n", T.LongType()), T.StructField("_p", T.ArrayType(T.DoubleType()))])

    def described(batches):
        for batch in batches:
            n, p = model.value.read(texts(batch.column(0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], schema.fieldNames())

    members = cut(rows.mapInArrow(described, schema))
    fit = fit_rates(members, shares, most=most)

    names = [free_name(docs, c) for c in ("n_words", "posteriors", "rate", "copies", "distance")]
    bare = sum((F.element_at("_p", i + 1) * float(x) for i, x in enumerate(fit.push)), F.lit(1.0))
    out = members.withColumn("_r", F.greatest(F.lit(0.0), bare) if most is None else F.least(F.lit(float(most)), F.greatest(F.lit(0.0), bare)))
    chance = (F.col("_h").bitwiseAND(0xFFFFFFFF)).cast("double") / 2.0**32
    posteriors: Column = F.struct(*[F.element_at("_p", i + 1).alias(d) for i, d in enumerate(domains)])
    return out.select(
        *[F.col(f"_{i}").alias(c) for i, c in enumerate(kept)], F.col("_n").alias(names[0]), posteriors.alias(names[1]), F.col("_r").alias(names[2]),
        F.floor(F.col("_r") + chance).cast("long").alias(names[3]), F.lit(fit.distance).alias(names[4]))


def label_domains(labels: DataFrame) -> DataFrame:
    """The labelled table as domains: toxic, else poor or clean by quality; rows without both labels have none."""
    domain = F.when(F.col("toxic") == 1, "toxic").when((F.col("toxic") == 0) & (F.col("quality") == 0), "poor").when((F.col("toxic") == 0) & (F.col("quality") == 1), "clean")
    return labels.select("doc_id", domain.alias("domain")).where("domain is not null")


def op4_mixing_to_target_weights(spark, sf_dir):
    from .common import table

    out = mixed(table(spark, sf_dir, "documents").select("doc_id", "text"), label_domains(table(spark, sf_dir, "labels")), columns=["doc_id"])
    return out.select("doc_id", "n_words", *[F.col(f"posteriors.{d}").alias(f"p_{d}") for d in sorted(TARGETS)], "rate", "copies", "distance")
