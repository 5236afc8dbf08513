import hashlib
import random
import zlib

import numpy as np
import pytest

from swipewatch.llm.parens import BLOCK, Parens
from swipewatch.llm.prefix_trie import coded, op12_conversation_trie, rebuilt, trie

SCHEMA = "conv_id long, turn long, role string, text string, c int, path string, shard int"


def sequences(rows):
    found = {}
    for c, t, r, x in rows:
        if c is not None:
            found.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in found.items()}


def spliced(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + turns[h:]
    return out


def expected(paths):
    """Every node by its whole sequence."""
    members, ends = {}, {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(tuple(p[:d]), []).append(c)
        ends.setdefault(tuple(p), []).append(c)
    rows = []
    for node, inside in members.items():
        below = [m for m in members if m[: len(node)] == node]
        kids = sum(len(m) == len(node) + 1 for m in below)
        leaves = sum(not any(len(o) > len(m) and o[: len(m)] == m for o in below) for m in below)
        saved = sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m)
        text = ",".join(map(str, sorted(ends.get(node, []))))
        rows.append((min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), kids, leaves, saved, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(rows, key=str)


def lines(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def odd():
    r = random.Random(2)
    texts = ["a", "b", "", None, "ñ𝒳", "a" * 4000]
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(texts)) for c in (*range(0, 40), *range(100, 130), 305, -7, None) for t in range(r.randrange(1, 6))]
    rows += [(c, t, "user", "same") for c in range(500, 560) for t in range(7)]  # copies, after the first turns
    rows += [(900, t, "user", f"{t % 40}") for t in range(150)]
    return rows + [(7, None, "user", "z")] * 2 + [(101, 2, "user", "tie"), (101, 2, "user", "tie")]


@pytest.mark.parametrize("n", [1, 3, BLOCK, 5 * BLOCK, 3000])
def test_closing_parentheses(n):
    r = random.Random(n)
    signs, depth = [1], 1
    while len(signs) < 2 * n - 1:
        up = depth == 1 or (r.random() < 0.52 and len(signs) + depth < 2 * n - 1)
        signs.append(1 if up else -1)
        depth += signs[-1]
    signs += [-1] * depth
    stack, want = [], {}
    for i, s in enumerate(signs):
        if s == 1:
            stack.append(i)
        else:
            want[stack.pop()] = i
    p = Parens(np.array(signs, np.int8))
    assert dict(zip(p.opens.tolist(), p.find_close(p.opens).tolist(), strict=True)) == want


@pytest.mark.parametrize("shard", [1, 4, 30, 100_000])
@pytest.mark.parametrize("partitions", [1, 8, 60])
def test_nodes_equal_brute_force_however_it_is_cut(spark, frame, shard, partitions):
    rows = odd()
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = frame([(*r, 1, "clash", 2) for r in rows], SCHEMA)
        assert lines(trie(rebuilt(df), shard)) == expected(spliced(sequences(rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_copies_alone_and_conversations_without_turns(spark, frame):
    rows = [(c, t, "user", "same") for c in range(50) for t in range(3)]
    df = frame([(*r, 1, "clash", 2) for r in rows], SCHEMA)
    for shard in (1, 7, 1000):
        assert lines(trie(coded(df), shard)) == expected(sequences(rows))
    # 205 % 6 and the like give first turns of a conversation that is not there
    gone = [c for c in range(1001, 1100) if zlib.crc32(str(c).encode()) % 6 > 1][:5]
    df = frame([(c, 0, "user", "own", 1, "clash", 2) for c in gone], SCHEMA)
    for shard in (1, 1000):
        assert lines(trie(rebuilt(df), shard)) == expected({c: [] for c in gone})


def test_empty_table(frame):
    assert trie(rebuilt(frame([], SCHEMA))).count() == 0


def test_given_tables(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert lines(op12_conversation_trie(spark, sf_dir)) == expected(spliced(sequences(rows)))
