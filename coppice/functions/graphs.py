"""Searches on one graph that fits a worker: pure Python over adjacency bit sets.

Vertices are 0..n-1 and a set of vertices is an int.  A loop is a cycle everywhere.
"""

from __future__ import annotations

import random
import time
from collections.abc import Iterable, Iterator


def bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


class OutOfTime(Exception):
    """A search has used up its time; ``bound`` is what it had proved by then."""

    bound = 0


class Clock:
    """A deadline that searches look at now and then; without seconds it never comes."""

    def __init__(self, seconds: float | None = None):
        self.end = None if seconds is None else time.monotonic() + seconds

    @property
    def over(self) -> bool:
        return self.end is not None and time.monotonic() > self.end

    def check(self) -> None:
        if self.over:
            raise OutOfTime


NO_CLOCK = Clock()


class Graph:
    """Out- and in-neighbours as bit sets; an undirected graph has both equal."""

    def __init__(self, n: int, edges: Iterable[tuple[int, int]], directed: bool):
        self.n, self.directed = n, directed
        self.out = [0] * n
        self.into = [0] * n
        for a, b in edges:
            self.out[a] |= 1 << b
            self.into[b] |= 1 << a
            if not directed:
                self.out[b] |= 1 << a
                self.into[a] |= 1 << b

    @property
    def all(self) -> int:
        return (1 << self.n) - 1


def acyclic(g: Graph, alive: int) -> bool:
    """Peel sources (directed) or leaves (undirected); what stays holds a cycle."""
    return not core(g, alive)


def core(g: Graph, alive: int) -> int:
    """What peeling leaves: empty exactly where there is no cycle."""
    if g.directed:
        ready = [v for v in bits(alive) if not g.into[v] & alive]
        while ready:
            v = ready.pop()
            alive &= ~(1 << v)
            ready += [w for w in bits(g.out[v] & alive) if not g.into[w] & alive]
        return alive

    def leaf(v: int) -> bool:
        return not g.out[v] >> v & 1 and (g.out[v] & alive).bit_count() <= 1

    ready = [v for v in bits(alive) if leaf(v)]
    while ready:
        v = ready.pop()
        if not alive >> v & 1:
            continue
        near = g.out[v] & alive & ~(1 << v)
        alive &= ~(1 << v)
        ready += [w for w in bits(near) if leaf(w)]
    return alive


def shortest_cycle(g: Graph, alive: int) -> list[int]:
    """A cycle of the fewest vertices, empty if there is none."""
    best: list[int] = []
    for v in bits(alive):
        if g.out[v] >> v & 1:
            return [v]
    for root in bits(alive):
        limit = len(best) or g.n + 1
        parent, depth, layer = {root: -1}, 1, [root]
        while layer and not (g.directed and depth >= limit) and not (not g.directed and 2 * depth - 1 >= limit):
            following: list[int] = []
            for v in layer:
                for w in bits(g.out[v] & alive):
                    if g.directed:
                        if w == root:
                            path = _path(parent, v)
                            if not best or len(path) < len(best):
                                best = path
                            following = []
                            break
                        if w not in parent:
                            parent[w] = v
                            following.append(w)
                    elif w == parent[v]:
                        continue
                    elif w in parent:
                        cycle = _joined(_path(parent, v), _path(parent, w))
                        if cycle and (not best or len(cycle) < len(best)):
                            best = cycle
                    else:
                        parent[w] = v
                        following.append(w)
                else:
                    continue
                break
            layer, depth = following, depth + 1
            limit = len(best) or g.n + 1
        if len(best) == (2 if g.directed else 3):
            break
    return best


def _path(parent: dict[int, int], v: int) -> list[int]:
    out = []
    while v >= 0:
        out.append(v)
        v = parent[v]
    return out


def _joined(a: list[int], b: list[int]) -> list[int]:
    """The cycle that two root paths close, above the vertex where they meet."""
    while len(a) > 1 and len(b) > 1 and a[-2] == b[-2]:
        a, b = a[:-1], b[:-1]
    return a + b[-2::-1] if len(a) + len(b) > 3 else []


def any_cycle(g: Graph, alive: int) -> list[int]:
    """Some cycle: walk backwards (or onwards) inside what peeling leaves until a vertex repeats."""
    left = core(g, alive)
    if not left:
        return []
    v, before, seen, order = next(bits(left)), -1, {}, []
    while v not in seen:
        seen[v] = len(order)
        order.append(v)
        options = (g.into[v] if g.directed else g.out[v]) & left
        if not g.directed and before >= 0 and not options >> v & 1:
            options &= ~(1 << before)
        if options >> v & 1:
            return [v]
        before, v = v, next(bits(options))
    found = order[seen[v] :]
    return found[::-1] if g.directed else found


def components(g: Graph, alive: int) -> list[int]:
    """Strong (directed) or plain components; each a set, directed ones by an iterative Tarjan walk."""
    if not g.directed:
        out, left = [], alive
        while left:
            part = grown = left & -left
            while grown:
                near = 0
                for v in bits(grown):
                    near |= g.out[v]
                grown = near & alive & ~part
                part |= grown
            out.append(part)
            left &= ~part
        return out
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    on, stack, out = 0, [], []
    for root in bits(alive):
        if root in index:
            continue
        work = [(root, bits(g.out[root] & alive))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on |= 1 << root
        while work:
            v, following = work[-1]
            for w in following:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on |= 1 << w
                    work.append((w, bits(g.out[w] & alive)))
                    break
                if on >> w & 1:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = 0
                    while True:
                        w = stack.pop()
                        on &= ~(1 << w)
                        part |= 1 << w
                        if w == v:
                            break
                    out.append(part)
    return out


# ---------------------------------------------------------------- reduction


def reduced(g: Graph, alive: int, forbidden: int = 0) -> tuple[Graph, int, int] | None:
    """Rules to a fixpoint on the part ``alive``: the reduced graph, its vertices, and the forced ones.

    Numbers stay those of ``g``.  A solution may not use ``forbidden`` vertices: None if
    one of them has a loop, and a vertex is passed over in favour of a neighbour only if
    that one may be used.
    """
    h = Graph(g.n, (), g.directed)
    for v in bits(alive):
        h.out[v], h.into[v] = g.out[v] & alive, g.into[v] & alive
    forced, again = 0, True

    def drop(v: int) -> None:
        nonlocal alive
        alive &= ~(1 << v)
        for w in bits(h.out[v]):
            h.into[w] &= ~(1 << v)
        for w in bits(h.into[v]):
            h.out[w] &= ~(1 << v)
        h.out[v] = h.into[v] = 0

    while again:
        again = False
        for v in list(bits(alive)):
            ins, outs = h.into[v], h.out[v]
            if outs >> v & 1:
                if forbidden >> v & 1:
                    return None
                forced |= 1 << v
                drop(v)
            elif g.directed and (not ins or not outs):
                drop(v)
            elif g.directed and (ins.bit_count() == 1 or outs.bit_count() == 1):
                # every cycle through v has its only neighbour on one side
                only = ins if ins.bit_count() == 1 else outs
                if not forbidden >> v & 1 and only & forbidden and not (outs.bit_count() == 1 and not outs & forbidden):
                    continue
                drop(v)
                for a in bits(ins):
                    h.out[a] |= outs
                for b in bits(outs):
                    h.into[b] |= ins
            elif not g.directed and outs.bit_count() <= 1:
                drop(v)
            elif not g.directed and outs.bit_count() == 2:
                a, b = bits(outs)
                if h.out[a] >> b & 1:
                    continue  # a parallel edge could not be held
                if not forbidden >> v & 1 and outs & ~forbidden == 0:
                    continue
                drop(v)
                h.out[a] |= 1 << b
                h.into[b] |= 1 << a
                h.out[b] |= 1 << a
                h.into[a] |= 1 << b
            else:
                continue
            again = True
        if g.directed and not again:
            for part in components(h, alive):
                if part.bit_count() == 1 and not h.out[v := next(bits(part))] >> v & 1:
                    drop(v)
                    again = True
    return h, alive, forced


def kernelize(g: Graph) -> tuple[Graph, int, int]:
    """``reduced`` for the whole graph, nothing forbidden."""
    return reduced(g, g.all)


def kernel_pieces(g: Graph, alive: int | None = None) -> tuple[list[tuple[Graph, int]], int]:
    """Reduced components as (graph, vertices), none of which reduces or splits further, and the forced vertices."""
    todo, forced, out = [(g, g.all if alive is None else alive)], 0, []
    while todo:
        h, left, more = reduced(*todo.pop())
        forced |= more
        parts = components(h, left)
        if len(parts) == 1:
            out.append((h, left))
        else:
            # without the edges between components the rules may reach further
            todo += [(h, part) for part in parts]
    return out, forced


# ---------------------------------------------------------------- exact search


def packing_bound(g: Graph, alive: int, most: int | None = None) -> int:
    """Disjoint cycles found greedily, up to ``most``: a lower bound on any solution."""
    count = 0
    while (most is None or count < most) and (cycle := shortest_cycle(g, core(g, alive))):
        count += 1
        for v in cycle:
            alive &= ~(1 << v)
    return count


def degree_bound(g: Graph, alive: int) -> int:
    """For an undirected graph without loops: what is taken out must leave fewer edges than vertices in each part."""
    degrees = sorted(((g.out[v] & alive).bit_count() for v in bits(alive)), reverse=True)
    over, taken = sum(degrees) // 2 - len(degrees) + 1, 0
    for d in degrees:
        if over <= 0:
            break
        over -= d - 1
        taken += 1
    return taken


def lower_bound(g: Graph, alive: int, most: int | None = None) -> int:
    found = packing_bound(g, alive, most)
    return found if g.directed else max(found, degree_bound(g, alive))


def branch(g: Graph, alive: int, k: int, forbidden: int = 0, clock: Clock = NO_CLOCK) -> int | None:
    """A solution of at most ``k`` vertices outside ``forbidden``, or None: reduce, split, branch on a shortest cycle."""
    clock.check()
    rest = reduced(g, alive, forbidden)
    if rest is None:
        return None
    h, alive, found = rest
    k -= found.bit_count()
    if k < 0:
        return None
    if not alive:
        return found
    parts = components(h, alive)
    if len(parts) > 1:
        for part in sorted(parts, key=int.bit_count):
            for size in range(lower_bound(h, part, k + 1), k + 1):
                if (piece := branch(h, part, size, forbidden, clock)) is not None:
                    break
            else:
                return None
            found |= piece
            k -= piece.bit_count()
        return found
    if k == 0 or lower_bound(h, alive, k + 1) > k:
        return None
    cycle = [v for v in shortest_cycle(h, alive) if not forbidden >> v & 1]
    cycle.sort(key=lambda v: -(h.out[v].bit_count() + h.into[v].bit_count()))
    tried = forbidden
    for v in cycle:
        more = branch(h, alive & ~(1 << v), k - 1, tried, clock)
        if more is not None:
            return found | more | 1 << v
        tried |= 1 << v  # a solution with v would have been found
    return None


def solve_bst(g: Graph, alive: int | None = None, clock: Clock = NO_CLOCK) -> int:
    """Least solution by bounded search with growing bound, one component at a time."""
    parts = components(g, core(g, g.all if alive is None else alive))
    bounds = [lower_bound(g, part) for part in parts]
    total = 0
    for i, part in enumerate(parts):
        try:
            while (found := branch(g, part, bounds[i], 0, clock)) is None:
                bounds[i] += 1
        except OutOfTime as e:
            e.bound = sum(bounds)
            raise
        bounds[i] = found.bit_count()
        total |= found
    return total


def compress(g: Graph, alive: int, old: int, clock: Clock = NO_CLOCK) -> int | None:
    """A solution smaller than ``old`` (a solution of ``alive``), or None: guess what of it stays."""
    members = list(bits(old))
    for kept in range(1 << len(members)):
        clock.check()
        keep = sum(1 << v for i, v in enumerate(members) if kept >> i & 1)
        free = old & ~keep
        if not free or not acyclic(g, free):
            continue
        found = branch(g, alive & ~keep, free.bit_count() - 1, free, clock)
        if found is not None:
            return keep | found
    return None


def solve_ic(g: Graph, alive: int | None = None, clock: Clock = NO_CLOCK) -> int:
    """Least solution by iterative compression: vertices come in by falling degree."""
    alive = g.all if alive is None else alive
    order = sorted(bits(alive), key=lambda v: (-(g.out[v].bit_count() + g.into[v].bit_count()), v))
    seen = solution = 0
    try:
        for v in order:
            seen |= 1 << v
            if acyclic(g, seen & ~solution):
                continue
            solution |= 1 << v
            while (smaller := compress(g, seen, solution, clock)) is not None:
                solution = smaller
    except OutOfTime as e:
        # what is left of a graph without vertices needs no larger solution
        e.bound = max(0, solution.bit_count() - 1)
        raise
    return solution


def _subsets(n: int, size: int) -> Iterator[int]:
    """Sets of ``size`` of the numbers 0..n-1, in rising order as numbers."""
    x = (1 << size) - 1
    while x < 1 << n:
        yield x
        if not x:
            return
        low = x & -x
        up = x + low
        x = up | ((x ^ up) // low) >> 2


def solve_brute(g: Graph, alive: int | None = None, clock: Clock = NO_CLOCK) -> int:
    """Least solution over all subsets by size; of one size, the smallest number."""
    alive = core(g, g.all if alive is None else alive)
    vs = list(bits(alive))
    for size in range(len(vs) + 1):
        for m in _subsets(len(vs), size):
            if size and clock.over:
                late = OutOfTime()
                late.bound = size
                raise late
            chosen = sum(1 << vs[i] for i in bits(m))
            if acyclic(g, alive & ~chosen):
                return chosen
    return alive


# ---------------------------------------------------------------- heuristics


def minimal(g: Graph, solution: int, order: Iterable[int] | None = None, alive: int | None = None) -> int:
    """Drop vertices that are not needed, in the given order; one pass leaves none."""
    alive = g.all if alive is None else alive
    for v in list(bits(solution)) if order is None else order:
        if solution >> v & 1 and acyclic(g, alive & ~(solution & ~(1 << v))):
            solution &= ~(1 << v)
    return solution


def solve_greedy(g: Graph, alive: int | None = None, by: str = "degree") -> int:
    """Take the largest residual degree (or out-degree, or min(in, out)) until acyclic; ties to the larger id."""
    alive, chosen = g.all if alive is None else alive, 0
    weigh = {
        "degree": lambda v: (g.out[v] & alive).bit_count() + ((g.into[v] & alive).bit_count() if g.directed else (g.out[v] >> v & 1)),
        "out": lambda v: (g.out[v] & alive).bit_count(),
        "least": lambda v: min((g.out[v] & alive).bit_count(), (g.into[v] & alive).bit_count()),
    }[by]
    while not acyclic(g, alive):
        v = max(bits(alive), key=lambda v: (weigh(v), v))
        chosen |= 1 << v
        alive &= ~(1 << v)
    return chosen


def repair(g: Graph, chosen: int, alive: int) -> int:
    return chosen | solve_greedy(g, alive & ~chosen)


def solve_memetic(
    g: Graph, seed: int = 42, population: int = 20, generations: int = 100, patience: int = 20, alive: int | None = None, clock: Clock = NO_CLOCK
) -> int:
    """Steady-state memetic search; members are valid and minimal, so the best one always is, also when time is up."""
    alive = core(g, g.all if alive is None else alive)
    if not alive:
        return 0
    r, vs = random.Random(seed), list(bits(alive))

    def polished(x: int) -> int:
        x = repair(g, x & alive, alive)
        order = list(bits(x))
        r.shuffle(order)
        return minimal(g, x, order, alive)

    members = [minimal(g, solve_greedy(g, alive, by), None, alive) for by in (("least", "out") if g.directed else ("degree",))]
    while len(members) < population and not clock.over:
        members.append(polished(sum(1 << v for v in vs if r.random() < 0.5)))
    best, still = min(x.bit_count() for x in members), 0
    for _ in range(generations):
        if clock.over:
            break
        a, b = (min(r.sample(members, min(3, len(members))), key=int.bit_count) for _ in range(2))
        mask = sum(1 << v for v in vs if r.random() < 0.5)
        child = (a & mask) | (b & ~mask)
        for v in vs:
            if r.random() < 1 / len(vs):
                child ^= 1 << v
        child = polished(child)
        worst = max(range(len(members)), key=lambda i: members[i].bit_count())
        if child not in members and child.bit_count() <= members[worst].bit_count():
            members[worst] = child
        now = min(x.bit_count() for x in members)
        best, still = (now, 0) if now < best else (best, still + 1)
        if still >= patience:
            break
    return min(members, key=lambda x: (x.bit_count(), x))


def solve_kma(g: Graph, seed: int = 42, population: int = 20, generations: int = 100, patience: int = 20, clock: Clock = NO_CLOCK) -> int:
    """Kernel first, memetic search on what is left."""
    h, alive, forced = kernelize(g)
    return minimal(g, forced | solve_memetic(h, seed, population, generations, patience, alive, clock))


def consensus(members: list[int], share: float, n: int) -> int:
    """Vertices in at least ``share`` of the members; if they are over half of n, the first 30% by (count, id)."""
    need = -(-int(share * len(members) * 1_000_000) // 1_000_000)
    counts = {v: sum(x >> v & 1 for x in members) for v in range(n)}
    chosen = sorted((v for v, c in counts.items() if c >= max(1, need)), key=lambda v: (-counts[v], v))
    if len(chosen) > n / 2:
        chosen = chosen[: max(1, int(0.3 * n))]
    return sum(1 << v for v in chosen)


def residual_degree(g: Graph, alive: int) -> int:
    """Largest degree among ``alive``; a loop counts twice."""
    return max(((g.out[v] & alive).bit_count() + ((g.into[v] & alive).bit_count() if g.directed else g.out[v] >> v & 1) for v in bits(alive)), default=0)


def swap_gain(g: Graph, solution: int, alive: int, clock: Clock = NO_CLOCK) -> int:
    """Swaps as long as they help: one vertex for one where that lowers the residual degree or frees others, two for one.

    Each turn makes the pair of size and residual degree smaller, so the search ends by itself.
    """
    solution = minimal(g, solution, None, alive)
    while not clock.over:
        here = (solution.bit_count(), residual_degree(g, alive & ~solution))
        better = next((x for x in _swaps(g, solution, alive, clock) if (x.bit_count(), residual_degree(g, alive & ~x)) < here), None)
        if better is None:
            break
        solution = better
    return solution


def _swaps(g: Graph, solution: int, alive: int, clock: Clock) -> Iterator[int]:
    inside, outside = list(bits(solution)), list(bits(alive & ~solution))
    for out in [1 << a for a in inside] + [1 << a | 1 << b for i, a in enumerate(inside) for b in inside[:i]]:
        if clock.over:
            return
        for c in outside:
            x = (solution & ~out) | 1 << c
            if acyclic(g, alive & ~x):
                yield minimal(g, x, None, alive)


def diversify(g: Graph, alive: int, r: random.Random, ordered: bool = True) -> int:
    """A solution from a grown acyclic set: vertices in a random order or, with ``ordered``, without predecessors first.

    With ``ordered`` the next vertex is a random one of those with the fewest
    predecessors (neighbours, if undirected) still to come, as a topological order would have it.
    """
    left, kept = alive, 0
    order = list(bits(alive))
    r.shuffle(order)
    while left:
        if ordered:
            fewest = min((g.into[v] & left).bit_count() for v in bits(left))
            v = next(v for v in order if left >> v & 1 and (g.into[v] & left).bit_count() == fewest)
        else:
            v = next(v for v in order if left >> v & 1)
        left &= ~(1 << v)
        if acyclic(g, kept | 1 << v):
            kept |= 1 << v
    return alive & ~kept


def random_population(alive: int, size: int, r: random.Random) -> list[int]:
    """Sets in which each vertex is with a chance drawn for the set from 0.05 to 0.20; mostly no solutions."""
    out = []
    for _ in range(size):
        p = r.uniform(0.05, 0.20)
        out.append(sum(1 << v for v in bits(alive) if r.random() < p))
    return out


def prune_by_degree(g: Graph, solution: int, alive: int) -> int:
    """``minimal`` with the vertices of lowest degree tried first, ties to the smaller id."""
    order = sorted(bits(solution), key=lambda v: ((g.out[v] & alive).bit_count() + (g.into[v] & alive).bit_count(), v))
    return minimal(g, solution, order, alive)


def fitness(g: Graph, x: int, alive: int) -> int:
    """Size, and n more where a cycle is left: lower is better, and a solution beats what is none."""
    return x.bit_count() + (0 if acyclic(g, alive & ~x) else g.n)


def one_generation(g: Graph, members: list[int], alive: int, r: random.Random, clock: Clock = NO_CLOCK) -> list[int]:
    """Children keep what both parents have and take of what only one has by chance; repaired, pruned, and ranked with their parents."""
    children = []
    for _ in range(len(members)):
        if clock.over:
            break
        a, b = r.choice(members), r.choice(members)
        child = (a & b) | sum(1 << v for v in bits(a ^ b) if r.random() < 0.5)
        if r.random() < 0.3 and alive:
            child ^= 1 << r.choice(list(bits(alive)))
        children.append(prune_by_degree(g, repair(g, child & alive, alive), alive))
    ranked = sorted(dict.fromkeys([*members, *children]), key=lambda x: (fitness(g, x, alive), x))
    return ranked[: len(members)]


def solve_dkma(
    g: Graph,
    seed: int = 42,
    rounds: int = 4,
    share: float = 0.6,
    population: int = 12,
    generations: int = 40,
    patience: int = 10,
    gain: bool = True,
    diverse: bool = True,
    clock: Clock = NO_CLOCK,
) -> int:
    """Kernel, then rounds of generations; what most of the best agree on is committed, and the rest reduced again.

    Ranked by validity first, so a small set that leaves a cycle never is the answer.
    When time is up the best solution so far is repaired and returned.
    """
    h, alive, forced = kernelize(g)
    if not alive:
        return minimal(g, forced)
    r, committed, rest = random.Random(seed), 0, alive
    best = minimal(h, solve_greedy(h, alive), None, alive)
    inner, gone = h, 0  # what is left to search, and what its reduction has forced
    for _ in range(rounds):
        members = [prune_by_degree(inner, repair(inner, x, rest), rest) for x in random_population(rest, population, r)]
        members += [solve_memetic(inner, r.randrange(1 << 30), population, generations, patience, rest, clock)]
        if diverse:
            members += [minimal(inner, diversify(inner, rest, r, ordered), None, rest) for ordered in (True, False)]
        for _ in range(generations // 5):
            members = one_generation(inner, members, rest, r, clock)
        for x in members:
            whole = prune_by_degree(h, committed | gone | x, alive)
            if acyclic(h, alive & ~whole) and whole.bit_count() < best.bit_count():
                best = whole
        agreed = consensus(members[: max(3, population // 2)], share, max(1, rest.bit_length())) & rest
        if not agreed or clock.over:
            break
        committed |= agreed
        inner, rest, more = reduced(inner, rest & ~agreed)
        gone |= more
        if not rest:
            whole = prune_by_degree(h, committed | gone, alive)
            best = min(best, whole, key=lambda x: (fitness(h, x, alive), x))
            break
    best = prune_by_degree(h, repair(h, best, alive), alive)
    return minimal(g, forced | (swap_gain(h, best, alive, clock) if gain else best))


SOLVERS = {
    "bst": solve_bst,
    "ic": solve_ic,
    "brute": solve_brute,
    "greedy": solve_greedy,
    "ma": solve_memetic,
    "kma": solve_kma,
    "kme": solve_kma,
    "dkma": solve_dkma,
}

#: Searches that reduce the graph before anything else.
KERNEL_FIRST = ("kma", "kme", "dkma")
