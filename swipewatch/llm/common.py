"""Helpers that several operators share: texts as numpy buffers, word fingerprints, checkpoints, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scale import cut, ensure_checkpoint_dir  # noqa: F401

#: Bytes of text that one vectorised step works on, besides what a single text needs.
STEP_BYTES = 1_000_000

#: Upper bound on the bytes of a table that is broadcast on purpose.
BROADCAST_BYTES = 32_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with underscores in front until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def texts(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def steps(sizes: list[int], most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` bytes together, at least one text each."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if sizes:
        yield start, len(sizes)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """64-bit fingerprints of any substring in constant time, from prefix sums of a polynomial over random byte codes. All have one base, so
    that a worker keeps its powers once."""

    base = int(np.random.default_rng(0).integers(2**62, 2**63)) | 1
    up = down = np.ones(1, np.uint64)

    def __init__(self, seed: int):
        self.codes = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)

    def load(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums; ``data`` holds bytes."""
        if len(Rolling.up) <= len(data):
            n = 1 << int(len(data)).bit_length()
            powers = [np.full(n, x, np.uint64) for x in (self.base, pow(self.base, -1, 2**64))]
            for p in powers:
                p[0] = 1
            Rolling.up, Rolling.down = (np.multiply.accumulate(p) for p in powers)
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.codes[data] * self.up[: len(data)], out=sums[1:])
        return sums

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def spans(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that ``inside`` (a table of 256 booleans) marks."""
    flags = np.zeros(len(data) + 2, np.int8)
    flags[1:-1] = inside[data]
    change = np.diff(flags)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components as (node, component), the component being its smallest node.

    Rounds of large-star and small-star over a checkpointed link table until it stays as it is. Each round takes a minimum per
    node with map-side combine and joins it back, so no neighbourhood is gathered anywhere.
    """
    def norm(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges = cut(norm(links.select(F.col(a).alias("u"), F.col(b).alias("v"))))
    last = state(edges)
    while last[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = norm(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(norm(small.select("e.u", "e.v")))
        now = state(edges)
        if now == last:
            break
        last = now
    both = edges.union(edges.select("v", "v"))
    return both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
