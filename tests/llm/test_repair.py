import hashlib
import itertools
import random
import re
import zlib

import pytest

from swipewatch.llm import audit as A
from swipewatch.llm.repair import SPACES, digests, damaged, op11_conversation_repair, repair

SCHEMA = "conv_id long, turn long, role string, text string, c int, piece string, repaired int"


def least(rows):
    """All edits of a few (role, bad, truncated) rows, tried one by one: (cost, audit) of the best."""
    inserts = [""] + [i for n in (1, 2) for i in map("".join, itertools.product("ua", repeat=n))]
    best = None
    for edits in itertools.product(*(["D"] if bad else "D K Ru Ra".split() for _, bad, _ in rows)):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            roles, letters, cost = gaps[0], "I" * len(gaps[0]), 2 * sum(map(len, gaps))
            for (role, _, cut), edit, gap in zip(rows, edits, gaps[1:], strict=True):
                cost += 3 if edit == "D" else cut + (0 if edit == "K" else 2)
                roles += {"D": "", "K": role}.get(edit, edit[-1]) + gap
                letters += edit[0] + "I" * len(gap)
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, letters) < best):
                best = cost, letters
    return best


def whole(rows, size):
    cells = [(0, ""), None, None, None]
    for a in range(0, len(rows), size):
        cells, _ = A.joined(cells, [A.paths(rows[a : a + size], s, a == 0 and s == 0) for s in range(4)])
    if not rows:
        cells = A.paths(rows, 0)
    return min(cells[s] for s in A.ENDS if cells[s] is not None)


@pytest.mark.parametrize("modulus", [2**61 - 1, 7, 1])
def test_cheapest_edits_with_ties_equal_all_edits(monkeypatch, modulus):
    """A small modulus makes hashes collide; results stay."""
    monkeypatch.setattr(A, "_MODULUS", modulus)
    r = random.Random(modulus)
    for n in (0, 1, 2, 3, 3, 3):
        for _ in range(4 if n < 3 else 2):
            rows = [(r.choice("suax"), r.random() < 0.25, r.random() < 0.4) for _ in range(n)]
            assert whole(rows, 100) == whole(rows, 1) == whole(rows, 2) == least(rows)
    for _ in range(30):
        rows = [(r.choice("suaua"), r.random() < 0.2, r.random() < 0.3) for _ in range(r.randrange(40))]
        assert whole(rows, 100) == whole(rows, 7) == whole(rows, 1)


def test_colliding_hashes_are_found_out(monkeypatch):
    monkeypatch.setattr(A, "_MODULUS", 1)
    t = A.Trails()
    r, nodes = random.Random(3), [0]
    for _ in range(200):
        nodes.append(t.add(r.choice(nodes), r.choice("DIKR")))
    for a, b in itertools.product(r.sample(nodes, 40), repeat=2):
        assert t.less(a, b) == (t.text(a) < t.text(b))


def _lines(rows):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows.collect()}


def expected(rows):
    """The contract in plain Python, with a table of strings."""
    by, out = {}, {}
    for c, t, r, x in rows:
        kept = by.setdefault(c, [])
        r, x, k = " " if r is None else r, " " if x is None else x, zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        kept += [(t is not None, t or 0, "user" if k == 4 else r, x)] * {0: 0, 3: 2}.get(k, 1)
    for c, kept in by.items():
        seen, flags, n = set(), [], [0, 0, 0]
        for _, _, r, x in sorted(kept):
            bare = x.strip(SPACES)
            f = 0 if not bare else 1 if (r, x) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((r, x))
            flags.append((r[:1], f in (0, 1), f == 2))
            if f is not None:
                n[f] += 1
        cells = {"": (0, "", "")}

        def closed(cells):
            for _ in range(3):
                for a, b in (("", "u"), ("s", "u"), ("a", "u"), ("u", "a")):
                    if a in cells:
                        cost, way, text = cells[a]
                        cells[b] = min(cells.get(b, (9e9,)), (cost + 2, way + "I", f"{text}\n{'user' if b == 'u' else 'assistant'}:"))
            return cells

        cells = closed(cells)
        for (_, _, r, x), (i, bad, cut) in zip(sorted(kept), flags, strict=True):
            new = {}
            for s, (cost, way, text) in cells.items():
                ways = [(s, cost + 3, "D", "")]
                if not bad:
                    after = {"": "su", "s": "u", "u": "a", "a": "u"}[s]
                    ways += [(i, cost + cut, "K", f"\n{r}:{x}")] if i and i in after else []
                    ways.append((after[-1], cost + cut + 2, "R", f"\n{'user' if after[-1] == 'u' else 'assistant'}:{x}"))
                for end, price, letter, line in ways:
                    new[end] = min(new.get(end, (9e9,)), (price, way + letter, text + line))
            cells = closed(new)
        cost, way, text = min(cells[s] for s in ("", "a") if s in cells)
        turns = {t for known, t, _, _ in kept if known}
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(flags, flags[1:], strict=False))
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *n, illegal, cost, way, hashlib.sha256(text[1:].encode()).hexdigest())
    return out


def odd():
    r = random.Random(5)
    words = ["Yes.", "No!", "why?  \n", "cut off", "", " \t", None, "Yes.", "é.", "x" * 3000 + "."]
    rows = [(c, r.choice([None, *range(6)]), r.choice(["user", "assistant", "system", "User", "", None, "umpire"]), r.choice(words)) for c in (*range(25), None, -3) for _ in range(r.randrange(1, 9))]
    return rows + [(77, t, r.choice(["user", "assistant"]), f"line {t % 90}" + r.choice(".!? ")) for t in range(400)] + [(78, 1, "user", "same.")] * 150 + rows[:5]


@pytest.mark.parametrize(("segment", "task_turns"), [(2000, 100_000), (3, 100_000), (2000, 5), (4, 0)])
def test_odd_conversations_whole_segmented_and_spread(frame, segment, task_turns):
    rows = odd()
    got = _lines(digests(repair(damaged(frame([(*r, 1, "clash", 2) for r in rows], SCHEMA, 7)), segment=segment, task_turns=task_turns)))
    assert got == expected(rows)


def test_repaired_rows_alternate_and_empty_tables_are_empty(frame):
    rows = damaged(frame([(*r, 1, "clash", 2) for r in odd()], SCHEMA))
    for r in repair(rows).collect():
        assert re.fullmatch("(s?(ua)+)?", "".join(p.role[:1] for p in r.repaired))
    none = damaged(frame([], SCHEMA))
    assert repair(none).count() == 0 and digests(repair(none)).columns[-1] == "repaired_sha256"


def test_given_tables(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert _lines(op11_conversation_repair(spark, sf_dir)) == expected(rows)
