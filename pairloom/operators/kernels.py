"""Matching within one connected component, on arrays. Written from Edmonds 1965, Gabow 1976 (bases by union-find), and the
phases of Hopcroft and Karp 1973. Everything is iterative, neighbours ascend, so results are fixed by the input.
"""

from __future__ import annotations

from collections import deque

import numpy as np

FREE, EVEN, ODD = 0, 1, 2


class Graph:
    """Neighbour lists of vertices 0 to n - 1."""

    def __init__(self, n: int, u: np.ndarray, v: np.ndarray):
        a, b = np.concatenate([u, v]), np.concatenate([v, u])
        order = np.lexsort((b, a))
        self.n = n
        ends = np.cumsum(np.bincount(a, minlength=n)).tolist()
        flat = b[order].tolist()
        self.near = [flat[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)] if n else []


def first_fit(g: Graph, mate: list[int]) -> None:
    """Vertices in order take their first free neighbour."""
    for v in range(g.n):
        if mate[v] < 0:
            for w in g.near[v]:
                if mate[w] < 0:
                    mate[v], mate[w] = w, v
                    break


def least_degree(g: Graph, mate: list[int]) -> None:
    """Vertices by (degree, id) take the free neighbour of the smallest (degree, id)."""
    rank = [0] * g.n
    order = sorted(range(g.n), key=lambda v: (len(g.near[v]), v))
    for k, v in enumerate(order):
        rank[v] = k
    for v in order:
        if mate[v] < 0:
            w = min((x for x in g.near[v] if mate[x] < 0), key=rank.__getitem__, default=-1)
            if w >= 0:
                mate[v], mate[w] = w, v


class Search:
    """An alternating forest. `back[x]` is the vertex before x on the way to its root, through blossoms too; `base` leads
    to the base of the blossom that holds a vertex."""

    def __init__(self, g: Graph, mate: list[int], eager: bool = False):
        self.g, self.mate, self.eager = g, mate, eager
        self.stamp, self.mark = 0, [0] * g.n
        self.reset()

    def reset(self) -> None:
        n = self.g.n
        self.label, self.back, self.base, self.root = [FREE] * n, [-1] * n, list(range(n)), [-1] * n
        self.queue: deque[int] = deque()
        self.dead: set[int] = set()

    def plant(self, v: int) -> None:
        self.label[v], self.root[v] = EVEN, v
        self.queue.append(v)

    def find(self, v: int) -> int:
        base = self.base
        while base[v] != v:
            base[v] = base[base[v]]
            v = base[v]
        return v

    def meet(self, u: int, v: int) -> int:
        """The first common base on the two ways to the root."""
        self.stamp += 1
        x, y = self.find(u), self.find(v)
        while True:
            if x >= 0:
                if self.mark[x] == self.stamp:
                    return x
                self.mark[x] = self.stamp
                x = -1 if self.mate[x] < 0 else self.find(self.back[self.mate[x]])
            x, y = y, x

    def contract(self, base: int, u: int, v: int) -> None:
        """Takes the way from u to the base into the blossom closed by the edge u v; odd vertices become even."""
        while self.find(u) != base:
            self.back[u] = v
            v = self.mate[u]
            if self.label[v] == ODD:
                self.label[v] = EVEN
                self.queue.append(v)
            for x in (u, v):
                if self.base[x] == x:
                    self.base[x] = base
            u = self.back[v]

    def flip(self, v: int, to: int) -> None:
        """Matches v to `to`, and shifts the matching on the way from v to its root."""
        while True:
            nxt = self.mate[v]
            self.mate[v] = to
            self.mate[to] = v
            if nxt < 0:
                return
            v = self.back[nxt]
            to = nxt

    def grow(self, many: bool) -> int:
        """Grows the forest till nothing is left, or one path (many: disjoint paths, one a tree) has been augmented."""
        g, mate, label, found = self.g, self.mate, self.label, 0
        while self.queue:
            u = self.queue.popleft()
            if self.root[u] in self.dead:
                continue
            for v in g.near[u]:
                if label[v] == FREE:
                    w = mate[v]
                    if w < 0:  # a free vertex that is no root
                        self.root[v] = v
                        self._augment(u, v)
                        found += 1
                        if not many:
                            return found
                        break
                    label[v], self.back[v], label[w] = ODD, u, EVEN
                    self.root[v] = self.root[w] = self.root[u]
                    self.queue.append(w)
                elif label[v] == EVEN and self.root[v] not in self.dead:
                    if self.root[v] != self.root[u]:
                        self._augment(u, v)
                        found += 1
                        if not many:
                            return found
                        break
                    if self.find(u) != self.find(v):
                        b = self.meet(u, v)
                        self.contract(b, u, v)
                        self.contract(b, v, u)
                        if self.eager:
                            self.base = [self.find(x) for x in range(g.n)]
        return found

    def _augment(self, u: int, v: int) -> None:
        self.dead |= {self.root[u], self.root[v]}
        x, y = u, v
        nu, nv = self.mate[x], self.mate[y]
        self.mate[x], self.mate[y] = y, x
        for nxt in (nu, nv):
            if nxt >= 0:
                self.flip(self.back[nxt], nxt)


def solve(n: int, u: np.ndarray, v: np.ndarray, strategy: str = "phased", init: str = "greedy-md", mate: list[int] | None = None) -> tuple[list[int], list[int]]:
    """Mates (-1: none) of a maximum matching, and the labels of the last forest: EVEN (with all of their blossoms), ODD, FREE.

    Strategies: single_root (a search from each free vertex; a tree without a path is never entered again), forest (all free
    vertices, one path a search, bases of all vertices renewed at once), forest_uf (same, bases by union-find), phased (the
    search of forest_uf that goes on after a path: disjoint paths, one a tree, till a phase finds none; there are no buckets by
    level and no contracted graph, and late paths of a phase need not be shortest), phased_ddfs (phases whose trees grow level by
    level on both sides of a bridge before it is crossed)."""
    g = Graph(n, u, v)
    mate = [-1] * n if mate is None else list(mate)
    if init == "greedy":
        first_fit(g, mate)
    elif init == "greedy-md":
        least_degree(g, mate)
    elif init != "none":
        raise ValueError(f"unknown init {init!r}")
    if strategy == "single_root":
        s = Search(g, mate)
        for r in range(n):
            if mate[r] < 0:
                # vertices of failed searches keep their labels and are not entered again
                before = (list(s.label), list(s.back), list(s.base), list(s.root))
                s.queue.clear()
                s.dead = {x for x in range(n) if mate[x] < 0 and s.label[x] == EVEN}
                s.plant(r)
                if s.grow(many=False):
                    s.label, s.back, s.base, s.root = before
        return mate, s.label
    if strategy not in ("forest", "forest_uf", "phased", "phased_ddfs"):
        raise ValueError(f"unknown strategy {strategy!r}")
    s = Search(g, mate, eager=strategy == "forest")
    while True:
        s.reset()
        for x in range(n):
            if mate[x] < 0:
                s.plant(x)
        if strategy == "phased_ddfs":
            if not levels(s):
                return mate, s.label
        elif not s.grow(many=strategy == "phased"):
            return mate, s.label


def levels(s: Search) -> int:
    """One phase by levels: first all vertices at the next distance are labelled, then the bridges closed by them are tried,
    shortest paths first, so that every tree has grown alike before a path is taken."""
    g, mate, label, found = s.g, s.mate, s.label, 0
    depth = [0] * g.n
    level, at = list(s.queue), 0
    bridges: dict[int, list[tuple[int, int]]] = {}
    s.queue.clear()
    while level or bridges:
        nxt: list[int] = []
        for u in level:
            if s.root[u] in s.dead:
                continue
            for v in g.near[u]:
                if label[v] == FREE and mate[v] >= 0:
                    w = mate[v]
                    label[v], s.back[v], label[w] = ODD, u, EVEN
                    s.root[v] = s.root[w] = s.root[u]
                    depth[w] = depth[u] + 1
                    nxt.append(w)
                elif label[v] == EVEN and mate[u] != v:
                    bridges.setdefault(depth[u] + depth[v], []).append((u, v))
        while bridges and min(bridges) <= 2 * at:
            for u, v in bridges.pop(min(bridges)):
                if s.root[u] in s.dead or s.root[v] in s.dead or label[v] != EVEN:
                    continue
                if s.root[u] != s.root[v]:
                    s._augment(u, v)
                    found += 1
                elif s.find(u) != s.find(v):
                    b = s.meet(u, v)
                    s.contract(b, u, v)
                    s.contract(b, v, u)
                    for x in s.queue:
                        depth[x] = at + 1
                        nxt.append(x)
                    s.queue.clear()
        level, at = nxt, at + 1
        if not level and bridges:
            at = max(at, (min(bridges) + 1) // 2)
    return found


def solve_bipartite(nl: int, nr: int, l: np.ndarray, r: np.ndarray, init: str = "greedy-md", mates: tuple[list[int], list[int]] | None = None) -> tuple[list[int], list[int], list[bool], list[bool]]:  # noqa: E741
    """Mates of left and right vertices (-1: none), and which of either side an alternating path from a free left vertex
    reaches. Layers from all free left vertices, then disjoint shortest paths through them, till no path is left."""
    order = np.lexsort((r, l))
    ends = np.cumsum(np.bincount(l, minlength=nl)).tolist()
    flat = r[order].tolist()
    near = [flat[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)] if nl else []
    ml, mr = (list(mates[0]), list(mates[1])) if mates else ([-1] * nl, [-1] * nr)
    if init in ("greedy", "greedy-md"):
        rows = list(range(nl))
        key = list(range(nr))
        if init == "greedy-md":
            rows.sort(key=lambda v: (len(near[v]), v))
            deg = np.bincount(r, minlength=nr).tolist()
            for k, v in enumerate(sorted(range(nr), key=lambda v: (deg[v], v))):
                key[v] = k
        for v in rows:
            if ml[v] < 0:
                w = min((x for x in near[v] if mr[x] < 0), key=key.__getitem__, default=-1)
                if w >= 0:
                    ml[v], mr[w] = w, v
    elif init != "none":
        raise ValueError(f"unknown init {init!r}")
    while True:
        dist = [-1] * nl
        level = [v for v in range(nl) if ml[v] < 0]
        for v in level:
            dist[v] = 0
        reached, k, open_ = [False] * nr, 0, False
        while level and not open_:
            k += 1
            nxt = []
            for v in level:
                for w in near[v]:
                    if not reached[w]:
                        reached[w] = True
                        x = mr[w]
                        if x < 0:
                            open_ = True
                        elif dist[x] < 0:
                            dist[x] = k
                            nxt.append(x)
            level = nxt
        if not open_:
            return ml, mr, [d >= 0 for d in dist], reached
        at = [0] * nl
        for root in range(nl):
            if ml[root] >= 0:
                continue
            path = [root]
            while path:
                v = path[-1]
                if at[v] == len(near[v]):
                    path.pop()
                    continue
                w = near[v][at[v]]
                at[v] += 1
                x = mr[w]
                if x < 0:
                    if dist[v] != k - 1:
                        continue
                    for y in reversed(path):
                        ml[y], w = w, ml[y]
                        mr[ml[y]] = y
                    break
                if dist[x] == dist[v] + 1:
                    path.append(x)
    return ml, mr, [], []
