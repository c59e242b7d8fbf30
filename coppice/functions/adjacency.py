"""Walks over one graph that fits a worker, by adjacency lists: time and memory grow with its edges.

Vertices are 0..n-1.  Unlike the bit sets of ``graphs`` these hold sparse graphs of many vertices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Lists:
    """Out- and in-neighbours as lists, without repeats; an undirected graph has both equal.  ``loops``: vertices with one."""

    def __init__(self, edges: list[tuple[int, int]], directed: bool):
        self.ids = sorted({v for e in edges for v in e})
        at = {v: i for i, v in enumerate(self.ids)}
        n = len(self.ids)
        self.n, self.directed = n, directed
        out: list[set[int]] = [set() for _ in range(n)]
        into: list[set[int]] = [set() for _ in range(n)] if directed else out
        self.loops: set[int] = set()
        for a, b in edges:
            a, b = at[a], at[b]
            if a == b:
                self.loops.add(a)
                continue
            out[a].add(b)
            into[b].add(a)
        self.out = [list(x) for x in out]
        self.into = [list(x) for x in into] if directed else self.out


def core_numbers(g: Lists) -> list[int]:
    """Core number of each vertex of an undirected graph: the vertex of least degree goes next, from buckets by degree."""
    degree = [len(x) for x in g.out]
    buckets: list[list[int]] = [[] for _ in range(max(degree, default=0) + 1)]
    for v, d in enumerate(degree):
        buckets[d].append(v)
    core, done, k, d = [0] * g.n, [False] * g.n, 0, 0
    while d < len(buckets):
        if not buckets[d]:
            d += 1
            continue
        v = buckets[d].pop()
        if done[v] or degree[v] != d:
            continue  # an entry from before a neighbour went
        k = max(k, d)
        core[v], done[v] = k, True
        for w in g.out[v]:
            if not done[w]:
                degree[w] -= 1
                buckets[degree[w]].append(w)
                d = min(d, degree[w])
    return core


class Arrays:
    """The edges of one undirected graph, without loops and repeats, taken in part by part: about 12 bytes each, and 64 a vertex.

    Vertices are numbered as they come.  An edge is one 64-bit number, of its ends' numbers; sorted by
    the first end these are the lists of later ends, and sorted by the second those of earlier ones.
    """

    #: Edges numbered at once, and neighbours looked at at once.
    PART = 1 << 19
    #: Neighbours up to which a plain loop is quicker than array operations.
    FEW = 64

    def __init__(self):
        self.known, self.number = np.empty(0, np.int64), np.empty(0, np.int32)
        self.pairs, self.m = np.empty(0, np.int64), 0

    def _numbers(self, ids: np.ndarray) -> np.ndarray:
        found, back = np.unique(ids, return_inverse=True)
        at = np.searchsorted(self.known, found)
        old = at < len(self.known)
        old[old] = self.known[at[old]] == found[old]
        if not old.all():
            n, more = len(self.known), np.count_nonzero(~old)
            self.known = np.insert(self.known, at[~old], found[~old])
            self.number = np.insert(self.number, at[~old], np.arange(n, n + more, dtype=np.int32))
            at = np.searchsorted(self.known, found)
        return self.number[at][back]

    def take(self, src: np.ndarray, dst: np.ndarray) -> None:
        for i in range(0, len(src), self.PART):
            a, b = self._numbers(src[i : i + self.PART]), self._numbers(dst[i : i + self.PART])
            if self.m + len(a) > len(self.pairs):
                self.pairs.resize(self.m + max(len(a), self.m // 16), refcheck=False)  # grows in place where there is room
            self.pairs[self.m : self.m + len(a)] = (a.astype(np.int64) << 32) | b
            self.m += len(a)

    def close(self) -> None:
        """All edges are in: ``ways`` gets the places and neighbours of every vertex, later ends and earlier ones."""
        self.pairs.resize(self.m, refcheck=False)
        places = np.arange(len(self.known) + 1, dtype=np.int64) << 32
        ends = self.pairs.view("<i4")[::2]  # the second end of each
        self.pairs.sort()
        later = (np.searchsorted(self.pairs, places), ends.copy())
        for i in range(0, self.m, self.PART):
            part = self.pairs[i : i + self.PART]
            part[:] = (part << 32) | (part >> 32)
        self.pairs.sort()
        self.ways = (later, (np.searchsorted(self.pairs, places), ends))

    def ids(self) -> np.ndarray:
        """The id of each number."""
        out = np.empty(len(self.known), np.int64)
        out[self.number] = self.known
        return out

    def near(self, vs: np.ndarray) -> Iterator[np.ndarray]:
        """All neighbours of ``vs``, at most ``PART`` at a time."""
        for k in range(0, len(vs), self.PART):
            some = vs[k : k + self.PART]
            for places, ends in self.ways:
                first = places[some]
                upto = np.cumsum(places[some + 1] - first)
                shift = first - np.append(0, upto[:-1])
                for i in range(0, int(upto[-1]), self.PART):
                    at = np.arange(i, min(i + self.PART, int(upto[-1])))
                    yield ends[at + shift[np.searchsorted(upto, at, side="right")]]


def core_array(g: Arrays) -> np.ndarray:
    """Core number of each vertex: those of least degree go together, then those that this brings down to it, and so on."""
    degree = sum(np.diff(places).astype(np.int32) for places, _ in g.ways)
    core, gone, left = np.zeros(len(degree), np.int32), np.zeros(len(degree), bool), np.arange(len(degree), dtype=np.int32)
    while len(left):
        k = degree[left].min()
        going = left[degree[left] == k]
        core[going], gone[going] = k, True
        while len(going):
            following = []
            if len(going) <= g.FEW and sum(int(places[v + 1] - places[v]) for v in going for places, _ in g.ways) <= g.FEW:
                for v in going:
                    for places, ends in g.ways:
                        for w in ends[places[v] : places[v + 1]].tolist():
                            if not gone[w]:
                                degree[w] -= 1
                                if degree[w] <= k:
                                    core[w], gone[w] = k, True
                                    following.append(w)
                going = np.array(following, np.int32)
                continue
            for met in g.near(going):
                met, n = np.unique(met[~gone[met]], return_counts=True)
                degree[met] -= n
                met = met[degree[met] <= k]
                core[met], gone[met] = k, True
                following.append(met)
            going = np.concatenate(following)
        left = left[~gone[left]]
    return core


def plain_components(g: Lists) -> list[int]:
    """Smallest vertex that each is joined to, whatever the directions."""
    root = list(range(g.n))

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = v = root[root[v]]
        return v

    for v, near in enumerate(g.out):
        for w in near:
            a, b = find(v), find(w)
            if a != b:
                root[max(a, b)] = min(a, b)
    return [find(v) for v in range(g.n)]


def strong_components(g: Lists) -> list[int]:
    """Smallest vertex of each one's strong component: Tarjan's walk with a stack of its own."""
    index, low, label = [-1] * g.n, [0] * g.n, [-1] * g.n
    stack: list[int] = []
    count = 0
    for start in range(g.n):
        if index[start] >= 0:
            continue
        index[start] = low[start] = count
        count += 1
        stack.append(start)
        work = [(start, iter(g.out[start]))]
        while work:
            v, following = work[-1]
            for w in following:
                if index[w] < 0:
                    index[w] = low[w] = count
                    count += 1
                    stack.append(w)
                    work.append((w, iter(g.out[w])))
                    break
                if label[w] < 0:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    at = len(stack) - 1
                    while stack[at] != v:
                        at -= 1
                    part = stack[at:]
                    del stack[at:]
                    least = min(part)
                    for w in part:
                        label[w] = least
    return label


def peeled(g: Lists, sinks: bool = False) -> list[bool]:
    """Which vertices are left when sources (and sinks) or leaves are taken off again and again; a loop holds its vertex."""
    left = [True] * g.n
    before, after = [len(x) for x in g.into], [len(x) for x in g.out]

    def free(v: int) -> bool:
        if v in g.loops:
            return False
        return before[v] == 0 or (sinks and after[v] == 0) if g.directed else after[v] <= 1

    ready = [v for v in range(g.n) if free(v)]
    while ready:
        v = ready.pop()
        if not left[v]:
            continue
        left[v] = False
        if g.directed:
            for w in g.out[v]:
                before[w] -= 1
            for w in g.into[v]:
                after[w] -= 1
            near = g.out[v] + g.into[v] if sinks else g.out[v]
        else:
            near = g.out[v]
            for w in near:
                after[w] -= 1
        ready += [w for w in near if left[w] and free(w)]
    return left


def any_cycle(g: Lists) -> list[int]:
    """Some cycle, empty if there is none: walk back inside what peeling leaves until a vertex repeats."""
    if g.loops:
        return [min(g.loops)]
    left = peeled(g)
    start = next((v for v in range(g.n) if left[v]), None)
    if start is None:
        return []
    v, before, seen, order = start, -1, {}, []
    while v not in seen:
        seen[v] = len(order)
        order.append(v)
        before, v = v, next(w for w in g.into[v] if left[w] and (g.directed or w != before))
    found = order[seen[v] :]
    return found[::-1] if g.directed else found


def levels(g: Lists) -> list[int | None]:
    """The round in which each vertex of a directed graph has no predecessor left; None behind a cycle."""
    level: list[int | None] = [None] * g.n
    before = [len(x) + (v in g.loops) for v, x in enumerate(g.into)]
    ready, at = [v for v in range(g.n) if not before[v]], 0
    while ready:
        following = []
        for v in ready:
            level[v] = at
            for w in g.out[v]:
                before[w] -= 1
                if not before[w]:
                    following.append(w)
        ready, at = following, at + 1
    return level
