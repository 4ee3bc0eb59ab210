"""Longest common extensions by a suffix tree, an Euler tour and range minima."""

from __future__ import annotations

import numpy as np

from .common import U, mix


def ukkonen(symbols: list[int], size: int) -> tuple[dict[int, int], list[int], list[int]]:
    """Edges (node * size + first symbol -> child) and where each node's edge starts and ends.

    Ukkonen's construction from left to right; the last symbol is 0 and occurs once.
    A leaf's edge ends at the end of the text.
    """
    n = len(symbols)
    edges: dict[int, int] = {}
    start, end, link = [0], [0], [0]
    node = edge = length = waiting = 0  # the active point, and suffixes still implicit
    get = edges.get
    for i, c in enumerate(symbols):
        waiting += 1
        fresh = 0
        while waiting:
            if not length:
                edge = i
            key = node * size + symbols[edge]
            child = get(key)
            if child is None:
                edges[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                if fresh:
                    link[fresh] = node
                    fresh = 0
            else:
                first = start[child]
                span = (end[child] if end[child] <= i else i + 1) - first
                if length >= span:
                    edge += span
                    length -= span
                    node = child
                    continue
                if symbols[first + length] == c:
                    length += 1
                    if fresh:
                        link[fresh] = node
                    break
                inner = len(start)
                edges[key] = inner
                start += [first, i]
                end += [first + length, n]
                link += [0, 0]
                start[child] = first + length
                edges[inner * size + symbols[first + length]] = child
                edges[inner * size + c] = inner + 1
                if fresh:
                    link[fresh] = inner
                fresh = inner
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - waiting + 1
    return edges, start, end


class RangeMinimum:
    """Least values of ranges in constant time each."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        width = 1
        while 2 * width <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Over low..high, both included."""
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), self.levels[0].dtype)
        for k in np.unique(level):
            at = level == k
            table = self.levels[k]
            out[at] = np.minimum(table[low[at]], table[high[at] + 1 - (1 << int(k))])
        return out


class SuffixTree:
    """Common extensions and the order of the suffixes of ``symbols``, numbers from 1 on."""

    def __init__(self, symbols: np.ndarray):
        held = [*symbols.tolist(), 0]
        self.n = len(held)
        size = max(held) + 1
        edges, start, end = ukkonen(held, size)
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        children = np.fromiter(edges.values(), np.int64, len(edges))
        order = np.argsort(keys)  # by node, then symbol
        parents = keys[order] // size
        self.closing = (keys[order] % size == 0).tolist()  # edges that begin with the end symbol
        self.children = children[order].tolist()
        self.cuts = np.searchsorted(parents, np.arange(len(start) + 1)).tolist()
        self.edge = (np.array(end) - np.array(start)).tolist()
        self._tour()

    def _tour(self) -> None:
        """Depths along the Euler tour, and where each suffix comes first in it."""
        n, cuts, children, edge = self.n, self.cuts, self.children, self.edge
        depth = [0] * len(edge)
        tour: list[int] = []
        first, rank, leaves = [0] * n, [0] * n, 0
        todo = [0]
        while todo:
            node = todo.pop()
            if node < 0:
                tour.append(depth[~node])
                continue
            d = depth[node]
            a, b = cuts[node], cuts[node + 1]
            if a == b:
                first[n - d] = len(tour)
                rank[n - d] = leaves
                leaves += 1
            else:
                for k in range(b - 1, a - 1, -1):
                    child = children[k]
                    depth[child] = d + edge[child]
                    todo.append(child)
                    if k > a:
                        todo.append(~node)
            tour.append(d)
        self.first, self.rank = np.array(first), rank
        self.least = RangeMinimum(np.array(tour, np.int32))

    def ranks(self, backward: bool) -> list[int]:
        """Places of the suffixes in order; ``backward`` turns the order of symbols, prefixes stay first."""
        if not backward:
            return self.rank
        n, cuts, children, edge = self.n, self.cuts, self.children, self.edge
        rank, place = [0] * n, 0
        todo = [(0, 0)]
        while todo:
            node, d = todo.pop()
            a, b = cuts[node], cuts[node + 1]
            if a == b:
                rank[n - d] = place
                place += 1
                continue
            todo += [(c, d + edge[c]) for c in children[a:b]]
            if self.closing[a]:  # the suffix that ends here stays first
                todo.append(todo.pop(a - b))
        return rank

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the common extensions to the right of two different places."""
        a, b = self.first[i], self.first[j]
        return self.least(np.minimum(a, b), np.maximum(a, b))


class HashedSuffixes:
    """The same answers for long sequences in linear memory: prefix hashes and doubled ranks."""

    AT_ONCE = 1 << 20

    def __init__(self, symbols: np.ndarray):
        self.symbols = np.append(symbols.astype(np.int64), 0)
        self.n = len(self.symbols)
        base = 0x9E3779B97F4A7C15
        self.powers = np.concatenate([np.ones(1, U), np.cumprod(np.full(self.n, U(base)))])
        self.back = np.concatenate([np.ones(1, U), np.cumprod(np.full(self.n, U(pow(base, -1, 1 << 64))))])
        self.sums = np.zeros(self.n + 1, U)
        np.cumsum(mix(self.symbols.astype(U) + U(0x632BE59B)) * self.powers[:self.n], out=self.sums[1:])

    def ranks(self, backward: bool) -> np.ndarray:
        symbols = self.symbols
        if backward:
            symbols = np.where(symbols > 0, symbols.max() + 1 - symbols, 0)
        rank, width = np.unique(symbols, return_inverse=True)[1].astype(np.int64), 1
        while int(rank.max()) + 1 < self.n:
            after = np.zeros(self.n, np.int64)
            after[:self.n - width] = rank[width:] + 1
            rank, width = np.unique(rank * (self.n + 1) + after, return_inverse=True)[1].astype(np.int64), width * 2
        return rank

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *[
            self._common(i[k:k + self.AT_ONCE], j[k:k + self.AT_ONCE]) for k in range(0, len(i), self.AT_ONCE)]])

    def _hash(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.back[at]

    def _common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        found, most = np.zeros(len(i), np.int64), self.n - np.maximum(i, j)
        for b in range(self.n.bit_length(), -1, -1):
            more = found + (1 << b)
            fits = np.flatnonzero(more <= most)
            same = fits[self._hash(i[fits], more[fits]) == self._hash(j[fits], more[fits])]
            found[same] = more[same]
        return found
