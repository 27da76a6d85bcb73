"""Recompression: one run-length grammar over the texts of a block, and exact extensions from it.

A sequence of symbols is rewritten in levels. On a level with equal neighbours, each
maximal stretch of one symbol becomes one block (block compression); on the others the
symbols are split into left and right ones by a hash, and a left one followed by a right
one becomes a pair (pair compression). Equal results get equal names, so equal stretches
of the sequence are rewritten alike but for their edges: two places are compared by
climbing to the highest equal symbols that begin there and going down where they differ.

All nodes of all levels lie in flat arrays. Each knows its parent, its first child, the
length it stands for and, if it is a block, how many equal children it has.
"""

from __future__ import annotations

import numpy as np

from lacuna.llm.text import mix


def _named(keys: np.ndarray) -> np.ndarray:
    """Numbers from 1 for equal keys."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int64) + 1


class Grammar:
    """Over ``symbols``: positive numbers, and 0 for a border that no stretch crosses; the first and the last are borders."""

    def __init__(self, symbols: np.ndarray):
        symbols = np.asarray(symbols, dtype=np.int64)
        self.n = len(symbols)
        names, counts, children, parents, lengths = [], [], [], [], []
        level, base, turn = symbols.copy(), 0, 0
        size = np.ones(self.n, dtype=np.int64)
        names.append(level)
        lengths.append(size)
        children.append(np.full(self.n, -1, dtype=np.int64))
        counts.append(np.ones(self.n, dtype=np.int64))
        while True:
            inner = (level[1:] != 0) & (level[:-1] != 0)
            equal = inner & (level[1:] == level[:-1])
            if inner.sum() <= (level == 0).sum() // 8:  # the texts are single symbols, all but a few
                break
            if equal.any():  # block compression
                begins = np.flatnonzero(np.concatenate([[True], ~equal]))
                count = np.diff(np.append(begins, len(level)))
                keys = level[begins] * (int(count.max()) + 1) + count
            else:  # pair compression
                turn += 1
                side = mix(level.astype(np.uint64) ^ np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(63) == 1
                tied = inner & side[:-1] & ~side[1:]
                begins = np.flatnonzero(np.concatenate([[True], ~tied]))
                count = np.ones(len(begins), dtype=np.int64)
                second = np.where(np.append(tied, False)[begins], np.append(level[1:], 0)[begins], 0)
                keys = level[begins] * (int(level.max()) + 1) + second
            higher = np.where(level[begins] == 0, 0, _named(keys))
            parent = np.zeros(len(level), dtype=np.int64)
            parent[begins[1:]] = 1
            parents.append(np.cumsum(parent) + base + len(level))
            children.append(begins + base)
            size = np.add.reduceat(size, begins)
            base += len(level)
            level = higher
            names.append(level)
            counts.append(count)
            lengths.append(size)
        parents.append(np.full(len(level), -1, dtype=np.int64))
        children.append(np.array([base]))  # behind the last node: where the children of the highest level end
        kind = np.int32 if sum(map(len, names)) < 1 << 31 else np.int64
        self.name, self.count, self.child, self.parent, self.length = (np.concatenate(x).astype(kind) for x in (names, counts, children, parents, lengths))

    def _climb(self, a: np.ndarray, b: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
        """From pairs of equal nodes up to equal parents, as long as both are first (or last) children."""
        live = np.arange(len(a))
        while len(live):
            x, y = self.parent[a[live]], self.parent[b[live]]
            ok = (x >= 0) & (y >= 0)
            ok &= self.name[x] == self.name[y]
            ok &= self.name[x] != 0
            if last:
                ok &= (self.child[x + 1] - 1 == a[live]) & (self.child[y + 1] - 1 == b[live])
            else:
                ok &= (self.child[x] == a[live]) & (self.child[y] == b[live])
            live = live[ok]
            a[live], b[live] = x[ok], y[ok]
        return a, b

    def extend(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from ``a`` on equal those from ``b`` on (places of the sequence, ``a < b``)."""
        return self._walk(a, b, False)

    def extend_back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols up to ``a`` equal those up to ``b``, both included."""
        return self._walk(a, b, True)

    def _walk(self, a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
        a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        found, live, step = np.zeros(len(a), dtype=np.int64), np.arange(len(a)), -1 if back else 1
        while len(live):
            x, y = a[live], b[live]
            same = (self.name[x] == self.name[y]) & (self.name[x] != 0)
            up, own = np.flatnonzero(same), live[same]
            if len(up):
                p, q = self._climb(x[up], y[up], back)
                found[own] += self.length[p]
                x[up], y[up] = p + step, q + step
            down = np.flatnonzero(~same)
            p, q = x[down], y[down]
            stop = (self.child[p] < 0) | (self.name[p] == 0) | (self.name[q] == 0)
            inner = down[~stop]
            p, q = x[inner], y[inner]
            first_p, first_q = self.child[p], self.child[q]
            if back:
                first_p, first_q = self.child[p + 1] - 1, self.child[q + 1] - 1
            # Two blocks of one symbol: the shorter one is passed at once.
            blocks = np.where(self.name[first_p] == self.name[first_q], np.minimum(self.count[p], self.count[q]), 0)
            blocks = np.where((self.count[p] > 1) | (self.count[q] > 1), blocks, 0)
            found[live[inner]] += blocks * self.length[first_p]
            x[inner], y[inner] = first_p + step * blocks, first_q + step * blocks
            a[live], b[live] = x, y
            over = np.zeros(len(live), dtype=bool)
            over[down[stop]] = True
            live = live[~over]
        return found
