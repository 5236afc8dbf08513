"""The cheapest edits that give a conversation its alternating form, with ties between equally cheap edits settled by their letters.

States of the form ``(s?(ua)+)?`` are what was written last: nothing, a system turn, a user turn, an assistant turn. Each row is deleted, kept
or given another role, and empty turns may be inserted anywhere. The letters of the edits, in order, are an audit: D, I, K, R.
"""

from __future__ import annotations

from collections.abc import Sequence

NOTHING, SYSTEM, USER, ASSISTANT = range(4)

#: A conversation may end after nothing or after an assistant's turn.
ENDS = (NOTHING, ASSISTANT)

#: Costs of the edits; a truncated row that stays costs one more.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1

#: Where a turn of the user or the assistant may follow, and where a kept row of an initial may.
_TURN = ((NOTHING, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT))
_KEEP = {"s": ((NOTHING, SYSTEM),), "u": _TURN[:3], "a": _TURN[3:]}

_MODULUS, _BASE = 2**61 - 1, 1_000_003


class Trails:
    """Audits as nodes that share their beginnings: a node is its parent's audit and one letter more.

    A node knows its ancestors 1, 2, 4, ... letters back and a rolling hash of its audit, so two audits are compared by a binary search for
    their longest common prefix. Equal hashes are not trusted: the prefixes found equal are walked through until they meet in one node, and
    nodes once proven equal are remembered as one.
    """

    def __init__(self):
        self.letter, self.depth, self.hash, self.up, self.same = [""], [0], [0], [[]], [0]

    def add(self, node: int, letter: str) -> int:
        new, up, k = len(self.letter), [node], 0
        while len(self.up[up[k]]) > k:
            up.append(self.up[up[k]][k])
            k += 1
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * _BASE + ord(letter)) % _MODULUS)
        self.up.append(up)
        self.same.append(new)
        return new

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def lifted(self, node: int, depth: int) -> int:
        """The ancestor with ``depth`` letters."""
        over = self.depth[node] - depth
        while over:
            k = over.bit_length() - 1
            node, over = self.up[node][k], over - (1 << k)
        return node

    def root(self, node: int) -> int:
        while self.same[node] != node:
            self.same[node] = node = self.same[self.same[node]]
        return node

    def equal(self, a: int, b: int) -> bool:
        """Whether two audits of one length are the same, by their letters."""
        walked = []
        while (a := self.root(a)) != (b := self.root(b)):
            if self.letter[a] != self.letter[b]:
                return False
            walked.append((a, b))
            a, b = self.up[a][0], self.up[b][0]
        for x, y in walked:
            self.same[self.root(max(x, y))] = self.root(min(x, y))
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether the audit of ``a`` comes before that of ``b`` in ASCII."""
        most = min(self.depth[a], self.depth[b])
        x, y = self.lifted(a, most), self.lifted(b, most)
        if self.hash[x] == self.hash[y] and self.equal(x, y):
            return self.depth[a] < self.depth[b]
        if self.hash[x] != self.hash[y]:
            for k in reversed(range(len(self.up[x]))):
                if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                    x, y = self.up[x][k], self.up[y][k]
            if self.equal(self.up[x][0], self.up[y][0]):
                return self.letter[x] < self.letter[y]
        return self.text(a) < self.text(b)  # hashes collided


Cell = tuple[int, int] | None


def _closed(cells: list[Cell], trails: Trails) -> list[Cell]:
    """Insertions after the last row; a cheaper cell is final before it leads to dearer ones."""
    done: set[int] = set()
    while len(done) < sum(c is not None for c in cells):
        at = min((s for s in range(4) if cells[s] is not None and s not in done), key=lambda s: cells[s][0])
        done.add(at)
        for start, end in _TURN:
            if start == at and end not in done:
                cost = cells[at][0] + INSERT
                if cells[end] is None or cost <= cells[end][0]:
                    node = trails.add(cells[at][1], "I")
                    if cells[end] is None or cost < cells[end][0] or trails.less(node, cells[end][1]):
                        cells[end] = (cost, node)
    return cells


def paths(rows: Sequence[tuple[str, bool, bool]], start: int, first: bool = True) -> list[tuple[int, str] | None]:
    """For each state that the rows may end in, coming from ``start``: the least cost and, of the audits that cost so much, the first.

    A row is (initial of its role, whether it must be deleted, whether it is truncated). Insertions before the rows count only if ``first``.

    The first audit of a state stays the first whatever follows: equally dear audits of the same rows are never prefixes of each other, since
    the longer one would have insertions more and so cost more.
    """
    trails = Trails()
    cells: list[Cell] = [None] * 4
    cells[start] = (0, 0)
    if first:
        cells = _closed(cells, trails)
    for initial, bad, truncated in rows:
        found: list[list[tuple[int, int, str]]] = [[], [], [], []]
        for state, cell in enumerate(cells):
            if cell is not None:
                found[state].append((cell[0] + DELETE, cell[1], "D"))
        if not bad:
            for moves, cost, letter in ((_KEEP.get(initial, ()), 0, "K"), (_TURN, REROLE, "R")):
                for a, b in moves:
                    if cells[a] is not None:
                        found[b].append((cells[a][0] + cost + TRUNCATED * truncated, cells[a][1], letter))
        cells = [None] * 4
        for state, options in enumerate(found):
            if options:
                least = min(o[0] for o in options)
                best = None
                for cost, node, letter in options:
                    if cost == least:
                        node = trails.add(node, letter)
                        if best is None or trails.less(node, best):
                            best = node
                cells[state] = (least, best)
        cells = _closed(cells, trails)
    return [None if c is None else (c[0], trails.text(c[1])) for c in cells]


def joined(before: list[tuple[int, str] | None], after: list[list[tuple[int, str] | None]]) -> tuple[list[tuple[int, str] | None], list[int]]:
    """What ``before`` reaches, continued by the paths ``after[start][end]`` of the next rows; and the start that each end comes from."""
    cells, starts = [], []
    for end in range(4):
        ways = [(b[0] + a[end][0], b[1] + a[end][1], s) for s, (b, a) in enumerate(zip(before, after, strict=True)) if b is not None and a is not None and a[end] is not None]
        best = min(ways, default=None)
        cells.append(best and best[:2])
        starts.append(best[2] if best else -1)
    return cells, starts


def applied(audit: str, rows: Sequence[tuple[str, str]], state: int = NOTHING) -> list[tuple[str, str]]:
    """The repaired (role, text) rows; an audit leaves no choice of roles once the state before it is known."""
    out, at = [], 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[at]
        at += edit != "I"
        if edit == "D":
            continue
        if edit == "K" and role[:1] == "s":
            state = SYSTEM
        else:
            if edit != "K":
                role = "assistant" if state == USER else "user"
            state = ASSISTANT if state == USER else USER
        out.append((role, text))
    return out
