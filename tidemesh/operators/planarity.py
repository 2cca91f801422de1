"""Left-right planarity test, and the planar maximally filtered graph."""

from __future__ import annotations

import sys
from collections.abc import Sequence


class _Tester:
    """One test, after Brandes' exposition of the left-right criterion.

    Edges are numbered as they are oriented by the first search. A conflict
    pair is a list [left low, left high, right low, right high] of edge
    numbers, -1 where an interval is empty.
    """

    def __init__(self, n: int, adjacent: Sequence[Sequence[int]]):
        self.n, self.adjacent = n, adjacent
        self.height = [-1] * n
        self.up = [-1] * n
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.source: list[int] = []
        self.target: list[int] = []
        self.low: list[int] = []
        self.low2: list[int] = []
        self.nest: list[int] = []
        self.done: set[tuple[int, int]] = set()
        self.stack: list[list[int]] = []

    def planar(self) -> bool:
        edges = sum(map(len, self.adjacent)) // 2
        if self.n < 5 or edges < 9:
            return True
        if edges > 3 * self.n - 6:
            return False
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, 10 * self.n + 1000))
        try:
            roots = []
            for v in range(self.n):
                if self.height[v] < 0:
                    self.height[v] = 0
                    roots.append(v)
                    self._orient(v)
            for v in range(self.n):
                self.out[v].sort(key=self.nest.__getitem__)
            m = len(self.source)
            self.ref = [-1] * m
            self.low_edge = list(range(m))
            self.bottom: list[list[int] | None] = [None] * m
            return all(self._test(v) for v in roots)
        finally:
            sys.setrecursionlimit(limit)

    def _orient(self, v: int) -> None:
        e = self.up[v]
        for w in self.adjacent[v]:
            if (w, v) in self.done or (v, w) in self.done:
                continue
            self.done.add((v, w))
            k = len(self.source)
            self.source.append(v)
            self.target.append(w)
            self.low.append(self.height[v])
            self.low2.append(self.height[v])
            self.nest.append(0)
            self.out[v].append(k)
            if self.height[w] < 0:
                self.up[w], self.height[w] = k, self.height[v] + 1
                self._orient(w)
            else:
                self.low[k] = self.height[w]
            self.nest[k] = 2 * self.low[k] + (self.low2[k] < self.height[v])
            if e >= 0:
                a, b = self.low[k], self.low[e]
                if a < b:
                    self.low2[e] = min(b, self.low2[k])
                    self.low[e] = a
                elif a > b:
                    self.low2[e] = min(self.low2[e], a)
                else:
                    self.low2[e] = min(self.low2[e], self.low2[k])

    def _test(self, v: int) -> bool:
        e = self.up[v]
        for nth, k in enumerate(self.out[v]):
            self.bottom[k] = self.stack[-1] if self.stack else None
            if self.up[self.target[k]] == k:
                if not self._test(self.target[k]):
                    return False
            else:
                self.stack.append([-1, -1, k, k])
            if self.low[k] < self.height[v]:
                if nth == 0:
                    self.low_edge[e] = self.low_edge[k]
                elif not self._constrain(k, e):
                    return False
        if e >= 0:
            self._trim(e)
        return True

    def _conflicts(self, high: int, k: int) -> bool:
        return high >= 0 and self.low[high] > self.low[k]

    def _constrain(self, k: int, e: int) -> bool:
        p = [-1, -1, -1, -1]
        while True:
            q = self.stack.pop()
            if q[0] >= 0:
                q[:] = q[2:] + q[:2]
            if q[0] >= 0:
                return False
            if self.low[q[2]] > self.low[e]:
                if p[2] < 0:
                    p[3] = q[3]
                else:
                    self.ref[p[2]] = q[3]
                p[2] = q[2]
            else:
                self.ref[q[2]] = self.low_edge[e]
            if (self.stack[-1] if self.stack else None) is self.bottom[k]:
                break
        while self.stack and (self._conflicts(self.stack[-1][1], k) or self._conflicts(self.stack[-1][3], k)):
            q = self.stack.pop()
            if self._conflicts(q[3], k):
                q[:] = q[2:] + q[:2]
            if self._conflicts(q[3], k):
                return False
            if p[2] >= 0:
                self.ref[p[2]] = q[3]
            if q[2] >= 0:
                p[2] = q[2]
            if p[0] < 0:
                p[1] = q[1]
            else:
                self.ref[p[0]] = q[1]
            p[0] = q[0]
        if p[0] >= 0 or p[2] >= 0:
            self.stack.append(p)
        return True

    def _lowest(self, p: list[int]) -> int:
        return min(self.low[x] for x in (p[0], p[2]) if x >= 0)

    def _trim(self, e: int) -> None:
        u = self.source[e]
        while self.stack and self._lowest(self.stack[-1]) == self.height[u]:
            self.stack.pop()
        if self.stack:
            p = self.stack[-1]
            for a, b in ((0, 2), (2, 0)):
                while p[a + 1] >= 0 and self.target[p[a + 1]] == u:
                    p[a + 1] = self.ref[p[a + 1]]
                if p[a + 1] < 0 and p[a] >= 0:
                    self.ref[p[a]] = p[b]
                    p[a] = -1
        if self.low[e] < self.height[u] and self.stack:
            left, right = self.stack[-1][1], self.stack[-1][3]
            self.ref[e] = left if left >= 0 and (right < 0 or self.low[left] > self.low[right]) else right


def is_planar(n: int, edges: Sequence[tuple[int, int]]) -> bool:
    """Whether a simple graph on nodes 0 .. n - 1 can be drawn without crossings."""
    adjacent: list[list[int]] = [[] for _ in range(n)]
    for a, b in edges:
        adjacent[a].append(b)
        adjacent[b].append(a)
    return _Tester(n, adjacent).planar()


def filtered_graph(n: int, edges: Sequence[tuple[int, int]]) -> list[int]:
    """Positions of the edges, in the order given, that stay: each that keeps the graph planar, until it is maximal.

    An edge that joins two components never breaks planarity and isn't tested.
    """
    most = 3 * n - 6 if n > 2 else n * (n - 1) // 2
    adjacent: list[list[int]] = [[] for _ in range(n)]
    root = list(range(n))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    kept: list[int] = []
    for k, (a, b) in enumerate(edges):
        if len(kept) >= most:
            break
        adjacent[a].append(b)
        adjacent[b].append(a)
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
        elif not _Tester(n, adjacent).planar():
            adjacent[a].pop()
            adjacent[b].pop()
            continue
        kept.append(k)
    return kept
