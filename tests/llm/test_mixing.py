import numpy as np
import pytest
from pyspark.sql import functions as F

from swipewatch.llm.mixing import CLOSE, TARGETS, features, fit_rates, label_domains, learn, mixed, op4_mixing_to_target_weights, rates


def plain(p, w, targets, most, steps=5_000):
    """Plain projected gradient on the least squares that fit_rates solves, dense."""
    metric = np.linalg.inv((p * w[:, None]).T @ p + 1e-9 * np.eye(len(targets)))
    r = np.ones(len(w))
    for _ in range(steps):
        r = np.clip(r - p @ (metric @ ((w * r) @ p - targets)), 0, most)
    off = (w * r) @ p - targets
    return off @ metric @ off, metric


# reached with room, reached with rates far above 1, not reached for a bound, not reached at all
@pytest.mark.parametrize("targets, most", [([0.2, 0.3, 0.5], None), ([0.02, 0.03, 2.0], None), ([0.01, 0.01, 0.98], 1.5), ([1.0, 0.0, 0.0], None)])
def test_rates_equal_plain_projected_gradient(spark, targets, most):
    draw = np.random.default_rng(3)
    p, n = draw.dirichlet([0.4, 0.3, 0.2], 400), draw.integers(0, 300, 400)
    p = np.maximum(p, 1e-3) / np.maximum(p, 1e-3).sum(1, keepdims=True)
    targets, w = np.array(targets), n / n.sum()
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "_n long, _p array<double>").repartition(4)
    fit = fit_rates(members, targets, most=most)
    rate = rates(p, fit.push, most)
    assert rate.min() >= 0 and (most is None or rate.max() <= most) and fit.jobs < 60
    off = (w * rate) @ p - targets
    assert np.isclose(np.abs(off).max(), fit.distance, atol=1e-9)
    goal, metric = plain(p, w, targets, most)
    assert off @ metric @ off < goal * 1.02 + 1e-8
    if most is None and targets[0] < 1:
        assert fit.distance <= CLOSE


def test_a_rare_domain_with_a_large_target_gets_large_rates(spark):
    p, n = np.tile([0.97, 0.02, 0.01], (5000, 1)), np.full(5000, 100)
    p[:3], p[3:2000] = [0.02, 0.97, 0.01], [0.998, 0.001, 0.001]
    fit = fit_rates(spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "_n long, _p array<double>"), np.array([0.8, 0.15, 0.05]))
    assert fit.distance > CLOSE and rates(p, fit.push).max() > 4  # third domain: at most one of fifty for each of the second's
    fit = fit_rates(spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "_n long, _p array<double>"), np.array([0.94, 0.055, 0.005]))
    assert fit.distance <= CLOSE and rates(p, fit.push)[:3].min() > 4


def test_features_and_learning():
    text, feature, value, tokens = features([b"", b"One two, one!", b"x"])
    assert set(text) == {1, 2} and tokens.tolist() == [0, 5, 1] and (value > 0).all()
    clean, bad = [b"alpha beta gamma %d" % i for i in range(60)], [b"alpha beta omega %d" % i for i in range(60)]
    p = learn(clean + bad, ["a", "b"], ["a"] * 60 + ["b"] * 60).read([b"beta omega", b"gamma", b""])[1]
    assert p[0, 1] > 0.8 and p[1, 0] > 0.8 and np.allclose(p.sum(1), 1)
    assert np.allclose(learn([], ["a", "b"], []).read([b"x"])[1], 0.5)


def test_query_meets_targets(spark):
    sf = "/root/testdata/sf0.01"
    out = op4_mixing_to_target_weights(spark, sf).toPandas()
    assert len(out) == 1000 and out.rate.min() >= 0 and np.allclose(out[[f"p_{d}" for d in sorted(TARGETS)]].sum(axis=1), 1)
    got = np.array([(out.n_words * out.rate * out[f"p_{d}"]).sum() for d in sorted(TARGETS)]) / out.n_words.sum()
    off = np.abs(got - [TARGETS[d] for d in sorted(TARGETS)]).max()
    assert off <= CLOSE and np.allclose(out.distance, off, atol=1e-8)
    assert ((out.copies - out.rate).abs() < 1).all() and abs((out.copies - out.rate).mean()) < 0.06


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 0, 0), (None, 1, 1), (4, None, 0), (1, 0, 1)]])
def test_tables(frame, labels):
    known = label_domains(frame(labels, "doc_id long, quality int, toxic int"))
    docs = frame([(1, None, 5), (1, None, 5), (None, "", 6), (2, "Some words here. " * 20_000, 7), (9, "Other words", 8)], "doc_id long, text string, RATE int")
    out = mixed(docs, known)
    assert out.columns == ["doc_id", "text", "RATE", "n_words", "posteriors", "_rate", "copies", "distance"]
    rows = out.collect()
    assert len(rows) == 5 and sum(r.n_words for r in rows) == 80_002 and all(r._rate >= 0 for r in rows)
    assert len({(r._rate, r.copies) for r in rows if r.doc_id == 1}) == 1
    empty = mixed(frame([], "doc_id long, text string"), known)
    assert empty.count() == 0 and F.col


def test_rare_words_mark_a_small_domain():
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.1"
    docs, labels = (pq.read_table(f"{sf}/{n}.parquet").to_pandas() for n in ("documents", "labels"))
    rows = labels.merge(docs, on="doc_id").drop_duplicates("text").sort_values("doc_id")
    held = (rows.doc_id * 2654435761 % 2**32 < 2**30).to_numpy()
    domain = np.where(rows.toxic == 1, "toxic", np.where(rows.quality == 0, "poor", "clean"))
    blobs = [(x or "").encode() for x in rows.text]
    model = learn([b for b, h in zip(blobs, held, strict=True) if not h], sorted(TARGETS), domain[~held].tolist())
    p = model.read([b for b, h in zip(blobs, held, strict=True) if h])[1][:, 2]
    for english, least in ((True, 0.85), (False, 0.7)):
        mine = ((rows.lang == "en") == english).to_numpy()[held] & (domain[held] == "toxic")
        assert mine.sum() > 25 and (p[mine] > 0.5).mean() > least
    assert (p[domain[held] != "toxic"] > 0.5).mean() < 0.03


def test_sample_rows_and_features_from_tasks(frame):
    from swipewatch.llm.mixing import SAMPLE_ROWS, train

    assert SAMPLE_ROWS >= 10_000
    rows = [(i, None if i == 5 else f"{'alpha' if i % 3 else 'omega'} Beta! {i % 7} w{i}") for i in range(90)]
    named = {i: "a" if i % 3 else "b" for i, _ in rows}
    made = train(frame(rows, "doc_id long, text string"), frame(list(named.items()), "doc_id long, domain string"), ["a", "b"])
    blobs = [(t or "").encode() for _, t in rows]
    whole = learn(blobs, ["a", "b"], list(named.values()))
    assert (made.place == whole.place).all() and np.allclose(made.read(blobs)[1], whole.read(blobs)[1], atol=1e-6)


def test_repeated_ids_teach_once(frame):
    from swipewatch.llm.mixing import train

    rows = [(i, f"{'alpha' if i % 3 else 'omega'} Beta! {i % 7} w{i}") for i in range(90)]
    named = frame([(i, "a" if i % 3 else "b") for i, _ in rows], "doc_id long, domain string")
    once = train(frame(rows, "doc_id long, text string"), named, ["a", "b"])
    more = train(frame(rows + rows[:5] * 400, "doc_id long, text string"), named, ["a", "b"])
    assert (once.place == more.place).all() and np.allclose(once.weights, more.weights)
