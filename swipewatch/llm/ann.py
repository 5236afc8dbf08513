"""Approximate nearest neighbours by cosine: a forest of random-projection trees searched through one shared priority queue.

The forest is fitted on a bounded sample; every vector is then put into a leaf of each tree. A query takes leaves in the order of how far it
lies beyond the splits on the way, over all trees together, until they hold enough vectors, and these are ranked by their exact cosine.
Equal vectors are handled as one with its smallest ids, so a very common vector fills no leaf.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

TREES = 8
#: Vectors a leaf should hold; leaves follow the number of vectors as long as the sample leaves SAMPLE_LEAF of its own in each.
LEAF = 128
SAMPLE_LEAF = 16
#: The forest is fitted on at most this much of the table, as doubles: the vectors with the smallest hashes.
SAMPLE_BYTES = 32_000_000
#: Leaves taken for a query hold this share of all vectors, counted with repetition between trees. Vectors without any structure (as uniform
#: directions) need a large share; for clustered ones a small one is enough.
SHARE = 1.2
#: A leaf with more vectors is divided into cells, and queries for it go to each.
CELL = 4096
#: Queries whose best vectors a task merges at a time before they are shuffled.
KEPT = 50_000


@dataclass
class Forest:
    """Complete trees: node k of tree t splits by ``normals[t, k] . x > bounds[t, k]`` into 2k+1 and 2k+2."""

    normals: np.ndarray
    bounds: np.ndarray
    depth: int

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of each vector in each tree."""
        out = np.empty((len(x), len(self.normals)), np.int64)
        for t, (w, b) in enumerate(zip(self.normals, self.bounds, strict=True)):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (np.einsum("ij,ij->i", x, w[at]) > b[at])
            out[:, t] = at - (2**self.depth - 1)
        return out

    def search(self, x: np.ndarray, sizes: np.ndarray, least: float) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the queue until the leaves hold ``least`` vectors."""
        inner, found, total = 2**self.depth - 1, [], 0
        side = np.einsum("tkd,d->tk", self.normals, x) - self.bounds
        queue = [(0.0, t, 0) for t in range(len(self.normals))]
        while queue and total < least:
            far, t, k = heapq.heappop(queue)
            while k < inner:
                s = side[t, k]
                heapq.heappush(queue, (far + s * s, t, 2 * k + 2 - int(s > 0)))
                k = 2 * k + 1 + int(s > 0)
            if sizes[t, k - inner]:
                found.append((t, k - inner))
                total += sizes[t, k - inner]
        return found


def fit(sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 10) -> Forest:
    """Random directions; each node splits the sample's vectors there at their median."""
    draw, inner = np.random.default_rng(seed), 2**depth - 1
    normals = draw.normal(size=(trees, inner, sample.shape[1]))
    normals /= np.linalg.norm(normals, axis=2, keepdims=True)
    bounds = np.zeros((trees, inner))
    for t in range(trees):
        at = np.zeros(len(sample), np.int64)
        for level in range(depth):
            p = np.einsum("ij,ij->i", sample, normals[t, at])
            order = np.lexsort((p, at))
            k, first, n = np.unique(at[order], return_index=True, return_counts=True)
            bounds[t, k] = p[order[first + (n - 1) // 2]]
            at = 2 * at + 1 + (p > bounds[t, at])
    return Forest(normals, bounds, depth)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64) if len(column) else np.empty((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distinct_vectors(vectors: DataFrame, query, most: int) -> DataFrame:
    """(v, ids, q): each different vector with its ``most`` smallest ids and whether a query has it. Tasks and then salted groups combine first."""
    def combined(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, v, q = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
            x = np.ascontiguousarray(_matrix(v) + 0.0)
            order = np.argsort(ids, kind="stable")
            _, first, back = np.unique(x[order].view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
            lists: list[list[int]] = [[] for _ in first]
            for g, i in zip(back.tolist(), ids[order].tolist(), strict=True):
                if len(lists[g]) < most and (not lists[g] or lists[g][-1] != i):
                    lists[g].append(i)
            asked = np.zeros(len(first), bool)
            np.logical_or.at(asked, back, q[order])
            yield pa.RecordBatch.from_arrays([v.take(pa.array(order[first])), pa.array(lists, pa.list_(pa.int64())), pa.array(asked)], ["v", "ids", "q"])

    kind = vectors.schema["v"].dataType.simpleString()
    part = vectors.select("i", "v", query.alias("q")).mapInArrow(combined, f"v {kind}, ids array<bigint>, q boolean")
    smallest = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, most)
    part = part.groupBy("v", F.pmod(F.element_at("ids", 1), F.lit(61)).alias("salt")).agg(smallest("ids").alias("ids"), F.bool_or("q").alias("q"))
    return part.groupBy("v").agg(smallest("ids").alias("ids"), F.bool_or("q").alias("q"))


def usable(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(i, v) of the rows that take part: an id, and a vector that is not zero and has finite components only. Vectors of another length than
    most (of equally frequent lengths the largest) take no part."""
    rows = table.select(F.col(key).cast("long").alias("i"), F.col(vector).alias("v")).where("i is not null and v is not null")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (length["n"] if length else 0))


def _lists(best: dict[int, dict[int, float]], most: int) -> pa.RecordBatch:
    rows = [(q, i, far) for q, mine in best.items() for i, far in sorted(mine.items(), key=lambda n: (n[1], n[0]))[:most]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["q", "id", "far"])


def nearest(table: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 5, share: float = SHARE, leaf: int = LEAF, cell: int = CELL) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row (``is_query`` of its id) its ``k`` nearest found rows of another id.

    Nearest first by exact cosine in doubles, ties to the smaller id; with at most ``k`` other rows all of them. Rows that are not ``usable``
    neither ask nor answer. Repeated rows count once; an id with several vectors asks with each of them. Other columns do not matter.
    An empty table has no result.
    """
    rows = usable(table, key, vector)
    most = k + 1  # a query's own id may be among them
    known = cut(distinct_vectors(rows, is_query("i"), most))
    total, width = known.count(), known.select(F.max(F.size("v"))).first()[0]
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return table.sparkSession.createDataFrame([], schema)
    sample = known.select(F.element_at("ids", 1).alias("i"), "v").orderBy(F.xxhash64("i"), "i").limit(max(1, SAMPLE_BYTES // (8 * width))).toArrow()
    points = _unit(_matrix(sample["v"].combine_chunks()))
    depth = max(0, int(np.log2(max(1, min(total / leaf, len(points) / SAMPLE_LEAF)))))
    context = table.sparkSession.sparkContext
    forest = context.broadcast(fit(points, depth))

    def placed(batches):
        for batch in batches:
            at = forest.value.leaves(_unit(_matrix(batch.column(0))))
            n, trees = at.shape
            row = pa.array(np.repeat(np.arange(n), trees))
            where = at + (np.arange(trees) << 32)
            yield pa.RecordBatch.from_arrays([pa.array(where.ravel()), batch.column(0).take(row), batch.column(1).take(row)], ["leaf", "v", "ids"])

    kind = known.schema["v"].dataType.simpleString()
    homes = known.select("v", "ids").mapInArrow(placed, f"leaf long, v {kind}, ids array<bigint>")
    sizes = np.zeros((TREES, 2**depth), np.int64)  # a number for each leaf of the forest, which SAMPLE_BYTES bounds
    for r in known.select("v", "ids").mapInArrow(placed, f"leaf long, v {kind}, ids array<bigint>").groupBy("leaf").count().collect():
        sizes[r["leaf"] >> 32, r["leaf"] & 0xFFFFFFFF] = r["count"]
    counted = context.broadcast(sizes)
    cells = F.lit(1) if sizes.max() <= cell else F.ceil(F.element_at(F.lit(np.maximum(sizes, 1).ravel().tolist()), (F.shiftright("leaf", 32) * 2**depth + F.col("leaf").bitwiseAND(0xFFFFFFFF) + 1).cast("int")) / cell).cast("int")

    def asked(batches):
        for batch in batches:
            x = _unit(_matrix(batch.column(0)))
            found = [forest.value.search(q, counted.value, share * total) for q in x]
            row = pa.array(np.repeat(np.arange(len(x)), [len(f) for f in found]))
            where = np.array([(t << 32) + n for f in found for t, n in f], np.int64)
            for a in range(0, len(where), 10_000):
                r = row[a : a + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(where[a : a + 10_000]), batch.column(0).take(r), batch.column(1).take(r)], ["leaf", "v", "q"])

    queries = known.where("q").select("v", F.element_at("ids", 1).alias("q")).mapInArrow(asked, f"leaf long, v {kind}, q long")
    homes = homes.select("leaf", F.pmod(F.xxhash64(F.element_at("ids", 1)), cells).cast("int").alias("cell"), "v", "ids")
    queries = queries.select("leaf", F.explode(F.sequence(F.lit(0), cells - 1)).alias("cell"), "v", "q")
    near = pa.list_(pa.struct([("far", pa.float64()), ("id", pa.int64())]))

    def ranked(here: pa.Table, there: pa.Table) -> pa.Table:
        if not here.num_rows or not there.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "near": pa.array([], near)})
        x, y = _matrix(here["v"].combine_chunks()), _matrix(there["v"].combine_chunks())
        x_norm, y_norm, ids, out = np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", y, y)), here["ids"].to_pylist(), []
        for a in range(0, len(y), 512):
            rough = (y[a : a + 512] @ x.T) / x_norm
            keep = min(2 * most + 6, len(x))
            edge = np.partition(rough, len(x) - keep, axis=1)[:, len(x) - keep]
            for i, (line, least) in enumerate(zip(rough, edge, strict=True), a):
                best = np.flatnonzero(line >= least)
                exact = np.einsum("ij,j->i", x[best], y[i]) / (x_norm[best] * y_norm[i])
                pairs = sorted((-float(s), g) for s, b in zip(exact, best, strict=True) for g in ids[b])[:most]
                out.append([{"far": f, "id": g} for f, g in pairs])
        return pa.table({"q": there["q"], "near": pa.array(out, near)})

    pairs = homes.groupBy("leaf", "cell").cogroup(queries.groupBy("leaf", "cell")).applyInArrow(ranked, "q long, near array<struct<far double, id bigint>>")
    def shortened(batches):
        """One list a query from those of many leaves, as far as they lie in the same stretch of a task."""
        best: dict[int, dict[int, float]] = {}
        for batch in batches:
            for q, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = best.setdefault(q, {})
                for n in found:
                    mine[n["id"]] = n["far"]
                if len(mine) > 4 * most:
                    best[q] = dict(sorted(mine.items(), key=lambda n: (n[1], n[0]))[:most])
            if len(best) >= KEPT:
                yield _lists(best, most)
                best = {}
        if best:
            yield _lists(best, most)

    each = pairs.mapInArrow(shortened, "q long, id long, far double").groupBy("q", "id").agg(F.min("far").alias("far"))  # a vector is as far from a query in every leaf
    best = each.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "id"))), 1, most).alias("near"))
    best = known.where("q").select("v", F.element_at("ids", 1).alias("g")).join(best, F.col("g") == F.col("q")).select("v", "near")
    own = rows.where(is_query("i")).distinct().join(best, "v")
    listed = own.select("i", F.posexplode(F.slice(F.filter("near", lambda x: x["id"] != F.col("i")), 1, k)).alias("p", "n"))
    return listed.select(F.col("i").alias("query_id"), (F.col("p") + 1).alias("rank"), F.col("n.id").alias("vec_id"), (-F.col("n.far")).alias("score"))


def op10_nearest_neighbours(spark, sf_dir):
    from .common import table

    return nearest(table(spark, sf_dir, "embeddings"), lambda c: F.col(c) % 50 == 0)
