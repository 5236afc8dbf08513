"""A trie of sorted paths as balanced parentheses, with range minima of the excess to find where subtrees close."""

from __future__ import annotations

import numpy as np

#: Parentheses of a block; each block keeps its least excess, and so do pairs, fours, eights ... of blocks.
BLOCK = 64

_NEVER = np.iinfo(np.int64).max


class Parens:
    """Balanced parentheses (+1 opens, -1 closes) in preorder of a tree."""

    def __init__(self, signs: np.ndarray):
        self.signs, self.opens = signs, np.flatnonzero(signs == 1)
        excess = np.cumsum(signs, dtype=np.int64)
        blocks = 1 << max(0, int(np.ceil(len(signs) / BLOCK)) - 1).bit_length()
        self.excess = np.full(blocks * BLOCK, _NEVER)
        self.excess[: len(signs)] = excess
        self.least = [self.excess.reshape(blocks, BLOCK).min(1)]
        while len(self.least[-1]) > 1:
            self.least.append(self.least[-1].reshape(-1, 2).min(1))

    def _within(self, start: np.ndarray, end: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First position from ``start`` and before ``end`` (one block's) with an excess of at most ``target``, or -1."""
        out = np.empty(len(start), np.int64)
        for a in range(0, len(start), 4096):
            at = start[a : a + 4096, None] + np.arange(BLOCK)
            inside = at < end[a : a + 4096, None]
            hit = inside & (self.excess[np.where(inside, at, 0)] <= target[a : a + 4096, None])
            first = hit.argmax(1)
            out[a : a + 4096] = np.where(hit.any(1), start[a : a + 4096] + first, -1)
        return out

    def find_close(self, opened: np.ndarray) -> np.ndarray:
        """The closing positions of opening positions: in the block itself, else in the next block whose least excess is low enough, which
        is found by going up and down the minima."""
        target = self.excess[opened] - 1
        block = opened // BLOCK
        out = self._within(opened + 1, (block + 1) * BLOCK, target)
        left = np.flatnonzero(out < 0)
        if not len(left):
            return out
        target, at, level = target[left], block[left] + 1, np.full(len(left), -1)
        for k, least in enumerate(self.least):
            going = level < 0
            look = going & ((at % 2 == 1) | (len(least) == 1))
            hit = look & (least[np.minimum(at, len(least) - 1)] <= target)
            level[hit] = k
            up = going & ~hit
            at[up] = (at[up] + (at[up] % 2)) // 2
        for k in range(len(self.least) - 1, 0, -1):
            down = level == k
            child = at[down] * 2
            at[down] = child + (self.least[k - 1][child] > target[down])
            level[down] = k - 1
        out[left] = self._within(at * BLOCK, (at + 1) * BLOCK, target)
        return out


class Trie:
    """The trie of paths in lexicographic order, as arrays over its nodes in preorder; node 0 is the root.

    ``codes`` holds the steps of all paths one after the other, ``sizes`` how many each path has, ``weights`` a number for each step (that of
    a node is its last step's) and ``ids`` a number for each path.
    """

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, weights: np.ndarray, ids: np.ndarray):
        n, start = len(sizes), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        both = np.minimum(sizes[1:], sizes[:-1])
        j = np.arange(both.sum()) - np.repeat(np.cumsum(both) - both, both)
        differs = codes[np.repeat(start[1:], both) + j] != codes[np.repeat(start[:-1], both) + j]
        shared = np.zeros(n, np.int64)
        shared[1:] = both
        pair = np.repeat(np.arange(1, n), both)
        np.minimum.at(shared, pair[differs], j[differs])
        new = sizes - shared
        runs = np.empty(2 * n + 1, np.int64)
        runs[0], runs[2:-1:2], runs[-1], runs[1::2] = 0, sizes[:-1] - shared[1:], sizes[-1] + 1, new
        signs = np.ones(2 * n + 1, np.int8)
        signs[::2] = -1
        self.parens = Parens(np.concatenate([[1], np.repeat(signs, runs)]))
        opened = self.parens.opens
        closed = self.parens.find_close(opened)
        count, first = len(opened), 1 + np.cumsum(new) - new
        node, after = np.arange(count), np.arange(count) + (closed - opened + 1) // 2
        owner = np.repeat(np.arange(n), new)
        step = np.arange(count - 1) - np.repeat(first - 1, new) + shared[owner]
        self.depth = np.concatenate([[0], step + 1])
        self.weight = np.concatenate([[0], weights[start[owner] + step]])
        #: flat position of each node's last step
        self.step = np.concatenate([[-1], start[owner] + step])
        self.end = np.maximum.accumulate(np.where(new > 0, first + new - 1, 0))
        low, high = np.searchsorted(self.end, node), np.searchsorted(self.end, after)
        self.members = high - low
        self.smallest = np.minimum.reduceat(np.append(ids, _NEVER), np.stack([low, high], 1).ravel())[::2]
        pairs = np.cumsum((self.parens.signs[:-1] == 1) & (self.parens.signs[1:] == -1))
        self.leaves = pairs[closed - 1] - np.where(opened > 0, pairs[opened - 1], 0)
        total = lambda x: np.concatenate([[0], np.cumsum(x)])
        within = lambda x: total(x)[after] - total(x)[node]
        #: Sums over subtrees, themselves included: weights times members, and weights.
        self.times, self.once = within(self.members * self.weight), within(self.weight)
        self.parent = np.arange(-1, count - 1)
        path = [0]
        for i in np.flatnonzero(new).tolist():
            self.parent[first[i]] = path[shared[i]]
            path[shared[i] + 1 :] = range(int(first[i]), int(first[i] + new[i]))
        #: Nodes of the first and of the last path, which neighbouring tries may share.
        self.left, self.right = np.arange(sizes[0] + 1), np.array(path, np.int64)
        self.children = np.bincount(self.parent[1:], minlength=count)
