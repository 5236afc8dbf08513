import numpy as np
import pytest
from pyspark.sql import functions as F

from swipewatch.llm.ann import nearest, op10_nearest_neighbours


def exact(rows, k=5):
    """All pairs; ids of the queries are divisible by 50."""
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 4 and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    out = {}
    for q, x in rows:
        if q % 50 == 0:
            near = sorted({(-round(float(x @ y / np.sqrt((x @ x) * (y @ y))), 12), i) for i, y in rows if i != q})[:k]
            out[q] = [(r, i, -s) for r, (s, i) in enumerate(near, 1)]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 12)))
    return out


is_query = lambda c: F.col(c) % 50 == 0


@pytest.mark.parametrize("cell", [4096, 3])
def test_small_tables_are_exact(frame, cell):
    draw = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in draw.integers(-2, 3, 4)]) for i in range(120)] + [(200 + i, [1.0, 2.0, 0.0, -1.0]) for i in range(60)]
    rows += [(250, None), (300, [0.0] * 4), (350, [1.0, None, 0.0, 0.0]), (400, [float("nan"), 1.0, 1.0, 1.0]), (450, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (500, [1.0, 2.0]), (550, [2.0, 4.0, 0.0, -2.0]), rows[0], rows[150]]
    got = found(nearest(frame(rows, "vec_id long, embedding array<float>"), is_query, cell=cell))
    assert got == exact(rows)
    split = nearest(frame(rows, "vec_id long, embedding array<float>"), is_query, leaf=8, cell=cell, share=50.0)  # many leaves, all of them searched
    assert found(split) == exact(rows)


def test_few_rows(frame):
    assert nearest(frame([], "vec_id long, embedding array<float>"), is_query).count() == 0
    assert nearest(frame([(50, [1.0])], "vec_id long, embedding array<float>"), is_query).count() == 0
    two = nearest(frame([(50, [1.0, 0.0], "a"), (7, [1.0, 1.0], "b")], "vec_id long, embedding array<float>, Rank string"), is_query).collect()
    assert [tuple(r)[:3] for r in two] == [(50, 1, 7)]


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.stack(rows.embedding.to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = rows.vec_id.to_numpy()
    got = found(op10_nearest_neighbours(spark, sf))
    hits = []
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        s[q] = -2
        want = set(ids[np.argsort(-s)[:5]])
        assert [r for r, _, _ in got[ids[q]]] == [1, 2, 3, 4, 5]
        assert all(abs(c - s[np.searchsorted(ids, i)]) < 1e-12 for _, i, c in got[ids[q]])
        hits.append(len(want & {i for _, i, _ in got[ids[q]]}) / 5)
    assert np.mean(hits) >= 0.9
