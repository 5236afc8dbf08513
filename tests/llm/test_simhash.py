import random

import numpy as np
import xxhash

from swipewatch.llm.common import components
from swipewatch.llm.simhash import anchors, fingerprint, links, near_groups, one_of_each_group, op5_simhash_near_dedup


def plain_print(text):
    import re

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(prints):
    """Smallest index reachable, by all pairs."""
    p, label = np.array(prints, np.uint64), list(range(len(prints)))
    close = np.bitwise_count(p[:, None] ^ p[None, :]) <= 4
    while True:
        new = [min(label[j] for j in np.flatnonzero(close[i])) for i in range(len(p))]
        if new == label:
            return label
        label = new


def test_fingerprint():
    for t in (None, "", " \t ", "One", "a b\vc D", "x y z é É w W " * 400, "a b a b a b a b"):
        assert fingerprint((t or "").encode()) == plain_print(t)


def test_every_close_pair_meets_at_a_home():
    draw = random.Random(1)
    for _ in range(300):
        x = draw.getrandbits(64)
        y = x
        for b in draw.sample(range(64), draw.randint(0, 4)):
            y ^= 1 << b
        row, anchor, home = anchors(np.array([x, y], np.uint64))
        assert home[row == 0].sum() == 3
        assert set(anchor[(row == 0) & home]) & set(anchor[row == 1])


def test_links_give_the_same_groups(spark):
    draw = random.Random(2)
    prints = [draw.getrandbits(64) for _ in range(40)]
    for _ in range(300):  # chains and dense balls
        p = draw.choice(prints[:8] + prints[-20:])
        for b in draw.sample(range(64), draw.randint(1, 5)):
            p ^= 1 << b
        prints.append(p)
    prints = sorted(set(prints))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    want = groups(prints)
    for cell in (10**7, 50):  # one cell an anchor, and many
        found = components(links(spark.createDataFrame([(p,) for p in signed], "fp long").repartition(5), cell_pairs=cell), "a", "b")
        of = {r.node: r.component for r in found.collect()}
        got = [of.get(p, p) for p in signed]
        assert len({*zip(want, got, strict=True)}) == len(set(want)) == len(set(got))


def test_components_of_a_long_path(spark):
    n = 300
    order = list(range(n))
    random.Random(3).shuffle(order)
    got = {r.node: r.component for r in components(spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (5000, 5000)], "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(n)}, 1000: 1000, 1001: 1000}


def test_table(frame):
    long = "one two three four five six seven eight nine ten " * 900
    rows = [(5, long, 1), (3, long.upper(), 2), (3, long.upper(), 2), (None, "", 3), (9, None, 4), (8, " \n", 5), (None, "alone in the world", 6)]
    docs = frame(rows, "doc_id long, text string, Component int")
    out = near_groups(docs)
    assert out.columns == ["doc_id", "text", "Component", "fingerprint", "component_id", "_component"]
    got = sorted((r.Component, r.fingerprint, r.component_id) for r in out.collect())
    assert got == sorted((c, f"{plain_print(t):016x}", {1: 3, 2: 3, 3: 8, 4: 8, 5: 8, 6: None}[c]) for _, t, c in rows)
    assert sorted(r.Component for r in one_of_each_group(docs).collect()) == [2, 5, 6]
    assert near_groups(frame([], "doc_id long, text string")).count() == 0


def test_query_equals_all_pairs(spark, sf_dir):
    docs = dict(sorted((r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()))
    prints = [plain_print(t) for t in docs.values()]
    ids = list(docs)
    want = {i: (f"{p:016x}", ids[g]) for i, p, g in zip(ids, prints, groups(prints), strict=True)}
    out = {r.doc_id: (r.fingerprint, r.component_id) for r in op5_simhash_near_dedup(spark, sf_dir).collect()}
    assert out == want
