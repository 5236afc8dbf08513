import random

from swipewatch.llm.decontaminate import brute_force, contamination, drop_contaminated, op3_benchmark_decontamination


def derived(df):
    return {r.doc_id: (r.n_words, r.n_hit, len(r["items"]), sorted(r["items"])) for r in df.collect()}


def test_query_equals_brute_force(spark, sf_dir):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    out = op3_benchmark_decontamination(spark, sf_dir).collect()
    assert len(out) == len(docs) and any(r.contaminated for r in out)
    hit = [r for r in out if r.n_hit][:8]
    for r in hit + [r for r in out if not r.n_hit][:8]:
        assert tuple(r)[1:] == brute_force(docs[r.doc_id], items)


def test_random_small_alphabet(frame):
    draw = random.Random(5)
    words = lambda n: " ".join(draw.choice(["a", "B", "c3", "é"]) for _ in range(n))
    items = [(i, words(draw.choice([0, 1, 3, 14, 20]))) for i in range(12)] + [(None, "a b c"), (3, None), (7, "zz-top")]
    docs = [(i, words(draw.choice([0, 5, 60, 200]))) for i in range(30)] + [(40, None), (41, ""), (42, "x ZZ,top y"), (40, None)]
    for size in (10**6, 150):  # one pass, and a benchmark in several parts
        got = contamination(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string"), pass_bytes=size)
        rows = got.collect()
        assert len(rows) == len(docs)
        for r in rows:
            want = brute_force(r.text, [("" if i is None else i, t) for i, t in items])
            assert (r.n_words, r.n_hit, len(r["items"])) == want[:3]
            assert r.n_hit == sum(p.end - p.start for p in r.places)


def test_tables(frame):
    docs = frame([(1, "q w e r t y", 9, "k")], "doc_id long, text string, N_HIT int, items string")
    none = frame([], "item_id long, text string")
    out = contamination(docs, none)
    assert out.columns == ["doc_id", "text", "N_HIT", "items", "n_words", "_n_hit", "_items", "places"] and out.first()._n_hit == 0
    assert drop_contaminated(docs, none).collect() == docs.collect()
    assert drop_contaminated(docs, frame([(1, "W e R")], "item_id long, text string")).count() == 0
    assert contamination(frame([], "text string"), frame([(1, "W e R")], "item_id long, text string")).count() == 0


def longest(text, items, window=13):
    """All verbatim matches that go on in neither direction, found word by word."""
    import re

    cut = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    words, found = cut(text), set()
    for name, t in items:
        other = cut(t)
        for i in range(len(words)):
            for j in range(len(other)):
                if i and j and words[i - 1] == other[j - 1]:
                    continue
                n = 0
                while i + n < len(words) and j + n < len(other) and words[i + n] == other[j + n]:
                    n += 1
                if n and n >= min(window, len(other)):
                    found.add(("" if name is None else str(name), i, j, n))
    return sorted(found)


def test_longest_matches(frame):
    draw = random.Random(8)
    words = lambda n: " ".join(draw.choice(["a", "B", "é"]) for _ in range(n))
    items = [(i, words(draw.choice([0, 1, 3, 20, 40]))) for i in range(9)] + [(None, "a b b"), (3, None)]
    docs = [(i, words(draw.choice([0, 30, 120]))) for i in range(8)] + [(20, f"x {items[0][1]} y {items[1][1]}"), (21, None)]
    for size in (10**6, 150):
        for r in contamination(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string"), pass_bytes=size, matches=True).collect():
            assert [(m["item"], m.start, m.item_start, m.length) for m in r.matches] == longest(r.text, items)


def test_a_large_benchmark_and_a_very_long_text():
    import time

    import numpy as np

    from swipewatch.llm.decontaminate import PASS_BYTES, Patterns, _hits

    draw = np.random.default_rng(1)
    words = np.array([f"w{i}" for i in range(60_000)])
    items = [(str(i), " ".join(draw.choice(words, 160))) for i in range(1800)]
    assert sum(len(t) for _, t in items) > 0.9 * PASS_BYTES
    known = Patterns(items, 13)
    block = (" ".join(draw.choice(words, 160_000)) + " " + items[5][1]).encode()
    begun = time.process_time()
    (n_words, n_hit, names, _, matches), = _hits([block], known, True)
    assert time.process_time() - begun < 2  # rows of patterns are made once, not for each block
    assert (n_words, n_hit, names) == (160_160, 160, ["5"]) and [m["length"] for m in matches] == [160]
