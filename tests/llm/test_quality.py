import zlib

import numpy as np

from swipewatch.llm.quality import NAMES, THRESHOLD, fit, keep_good, op1_quality_classifier, scored, statistics, train


def by_walking(model, x):
    """The same scores, tree by tree and node by node."""
    out = []
    for row in x:
        total = model.base
        for f, b, leaf in zip(model.feature, model.bound, model.leaf, strict=True):
            k = 0
            while k < len(f):
                k = 2 * k + (2 if row[f[k]] > b[k] else 1)
            total += leaf[k - len(f)]
        out.append(1 / (1 + np.exp(-total)))
    return np.array(out)


def test_trees():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(600, 5)).round(1)
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = fit(x, y, rounds=30)
    s = model.score(x)
    assert np.allclose(s, by_walking(model, x)) and ((s > 0.5) == (y == 1)).mean() > 0.97
    assert (fit(x, np.ones(600)).score(x) > 0.99).all() and (fit(x[:0], y[:0]).score(x) == 0.5).all()
    assert np.isfinite(fit(np.ones((9, 2)), np.arange(9.0) % 2).score(np.ones((3, 2)))).all()


def test_statistics():
    blobs = [b"", b" \n ", b"Ab cd. ab\nAb cd. ab", "é!!! 12".encode(), b"x" * 5_000_000]
    x = statistics(blobs)
    of = lambda i, name: x[i, NAMES.index(name)]
    assert np.isfinite(x).all() and not x[0].any()
    assert np.allclose([of(2, n) for n in ("repeated_lines", "distinct_words", "upper", "line")], [0.5, 2 / 6, 2 / 19, 1 / 19])
    assert of(3, "other") == 2 / 8 and of(3, "bang") == 3 / 8 and of(3, "digit") == 2 / 8
    assert all(np.allclose(statistics([b])[0], row) for b, row in zip(blobs, x, strict=True))  # neighbours in a batch do not matter


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in op1_quality_classifier(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(out) == 1000 and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= THRESHOLD) for i, r in out.items())
    held = [i for i in labels if out[i].held_out]
    assert np.mean([out[i].predicted == labels[i] for i in held]) > 0.93


def test_tables(frame):
    docs = frame([(1, None, "q"), (1, None, "q"), (None, "", None), (2, "Some words here.", "z")], "doc_id long, text string, SCORE string")
    for labels in ([], [(1, 1, 0), (1, 0, 0), (None, 1, None), (2, None, 0), (7, 1, 1), (2, 5, 0)]):
        known = frame(labels, "doc_id long, quality int, toxic int")
        out = scored(docs, train(docs, known))
        assert out.columns == ["doc_id", "text", "SCORE", "_score"] and out.count() == 4
        assert all(0 <= r._score <= 1 for r in out.collect())
        assert keep_good(docs, known).columns == docs.columns
    assert keep_good(frame([], "doc_id long, text string"), known).count() == 0
