import hashlib
import random

import numpy as np
import pytest

from swipewatch.llm.suffix_dedup import op2_suffix_array_dedup, order, phrases, remove_repeats


def brute(blobs, length):
    """Bytes that a repeated string covers, from a table of all strings."""
    seen = {}
    for b in blobs:
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            seen[s] = seen.get(s, 0) + 1
    out = []
    for b in blobs:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[:-1].astype(np.int8), [0]])))
        out.append((list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)), bytes(x for x, g in zip(b, gone, strict=False) if not g)))
    return out


def test_phrases_cover_each_start_once():
    draw = random.Random(1)
    for text in (b"", b"a" * 199, b"a" * 200, b"ab" * 500, bytes(draw.choice(b"abc ") for _ in range(5000))):
        low, high, *_ = phrases(np.frombuffer(text, np.uint8))
        starts = [i for a, b in zip(low, high, strict=True) for i in range(a, b + 1)]
        assert starts == list(range(max(0, len(text) - 199))) and (high - low < 128).all()


def test_order_is_the_corpus_order():
    draw = random.Random(2)
    for length in (5, 8, 13):
        data = bytes(draw.choice(b"ab") for _ in range(300))
        starts = np.arange(300 - length + 1)
        rank = order(np.frombuffer(data, np.uint8), starts, length)
        strings = [data[i : i + length] for i in starts]
        assert rank.tolist() == [sorted(set(strings)).index(s) for s in strings]


def texts(draw):
    word = lambda n: "".join(draw.choice("abcdé ") for _ in range(n))
    passages = [word(draw.randint(8, 80)) for _ in range(12)]
    out = ["".join(draw.choice([draw.choice(passages), word(draw.randint(0, 30))]) for _ in range(draw.randint(0, 8))) for _ in range(60)]
    near = word(300)
    out += [near[:i] + "#" + near[i + 1 :] for i in range(0, 300, 7)]  # many different phrases with a common key
    return [*out, "", "a" * 500, "ab" * 200, out[0], out[1], out[1], None]


@pytest.mark.parametrize(("length", "spread", "part"), [(20, 12, 3000), (20, 12, 2), (13, 13, 3), (30, 1, 3000)])
def test_equals_table_of_all_strings(frame, length, spread, part):
    draw = random.Random(length + part)
    rows = list(enumerate(texts(draw)))
    out = remove_repeats(frame(rows, "doc_id long, text string", 4), length=length, spread=spread, part_phrases=part).collect()
    assert len(out) == len(rows)
    want = brute([(t or "").encode() for _, t in rows], length)
    for r in out:
        assert r.text == rows[r.doc_id][1]
        assert ([(s.start, s.end) for s in r.spans], bytes(r.kept)) == want[r.doc_id]


def test_query(spark, sf_dir):
    rows = {r[0]: (r[1] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    want = dict(zip(rows, brute(list(rows.values()), 200), strict=True))
    out = op2_suffix_array_dedup(spark, sf_dir).collect()
    assert len(out) == len(rows) and any(r.n_removed for r in out)
    for r in out:
        spans, kept = want[r.doc_id]
        assert tuple(r)[1:] == (len(rows[r.doc_id]), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())


def test_tables(frame):
    long = "some words of a long text that goes on and on, and on. " * 30_000
    out = remove_repeats(frame([(None, long, 1), (5, None, 2), (5, "x", None)], "doc_id long, text string, SPANS int"))
    assert out.columns == ["doc_id", "text", "SPANS", "_spans", "kept"]
    got = {r.doc_id if r.SPANS else "x": (len(r._spans), len(r.kept)) for r in out.collect()}
    assert got == {None: (1, 0), 5: (0, 0), "x": (0, 1)}
    assert remove_repeats(frame([], "doc_id long, text string")).count() == 0
