"""Worker-side searches on golden graphs and random ones."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from coppice.functions import graphs as G

GOLDEN = {
    # name: directed, n, edges, least solution
    "triangle": (False, 3, "01 12 20", 1),
    "path4": (False, 4, "01 12 23", 0),
    "bowtie": (False, 5, "01 12 20 03 34 40", 1),
    "two_triangles": (False, 6, "01 12 20 34 45 53", 2),
    "k4": (False, 4, "01 02 03 12 13 23", 2),
    "k5": (False, 5, "01 02 03 04 12 13 14 23 24 34", 3),
    "grid3x3": (False, 9, "01 12 34 45 67 78 03 14 25 36 47 58", 2),
    "petersen": (False, 10, "01 12 23 34 40 05 16 27 38 49 57 79 96 68 85", 3),
    "loop_u": (False, 2, "00 01", 1),
    "c3": (True, 3, "01 12 20", 1),
    "dag": (True, 4, "01 02 13 23", 0),
    "two_scc": (True, 5, "01 10 12 23 34 42", 2),
    "fig8": (True, 5, "01 12 20 03 34 40", 1),
    "complete4": (True, 4, "01 02 03 10 12 13 20 21 23 30 31 32", 3),
    "loop_d": (True, 2, "00 01", 1),
    "cycle_tail": (True, 4, "01 10 23", 1),
}


def golden(name):
    directed, n, edges, least = GOLDEN[name]
    return G.Graph(n, [(int(a), int(b)) for a, b in edges.split()], directed), least


@pytest.mark.parametrize("name", GOLDEN)
@pytest.mark.parametrize("algo", ["bst", "ic", "brute"])
def test_exact_solvers_reach_the_least_size(name, algo):
    g, least = golden(name)
    x = G.SOLVERS[algo](g)
    assert x.bit_count() == least
    assert G.acyclic(g, g.all & ~x)


@pytest.mark.parametrize("name", GOLDEN)
@pytest.mark.parametrize("algo", ["greedy", "ma", "kma", "dkma"])
def test_heuristics_are_valid(name, algo):
    g, least = golden(name)
    x = G.SOLVERS[algo](g)
    assert G.acyclic(g, g.all & ~x)
    assert x.bit_count() >= least
    if algo != "greedy":
        assert G.minimal(g, x) == x


graph = st.integers(1, 8).flatmap(
    lambda n: st.tuples(st.just(n), st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), max_size=18), st.booleans())
)


@settings(max_examples=150, deadline=None)
@given(graph)
def test_exact_solvers_agree_and_kernels_keep_the_size(spec):
    g = G.Graph(*spec)
    least = G.solve_brute(g).bit_count()
    assert G.solve_bst(g).bit_count() == least == G.solve_ic(g).bit_count()
    assert G.packing_bound(g, g.all) <= least
    h, alive, forced = G.kernelize(g)
    assert forced.bit_count() + G.solve_brute(h, alive).bit_count() == least


@settings(max_examples=150, deadline=None)
@given(graph)
def test_cycles_exist_where_peeling_leaves_something(spec):
    g = G.Graph(*spec)
    some, short = G.any_cycle(g, g.all), G.shortest_cycle(g, g.all)
    assert bool(some) == bool(short) == (not G.acyclic(g, g.all))
    if some:
        assert len(short) <= len(some)
        for a, b in zip(some, some[1:] + some[:1]):
            assert g.out[a] >> b & 1 or g.out[b] >> a & 1


def test_memetic_search_is_reproducible():
    g, _ = golden("petersen")
    assert G.solve_memetic(g, seed=5) == G.solve_memetic(g, seed=5)


def test_consensus_is_capped():
    assert G.consensus([0b111111, 0b111111], 0.6, 6) == 0b1
    assert G.consensus([0b11, 0b01, 0b01], 0.6, 9) == 0b1


@settings(max_examples=150, deadline=None)
@given(graph, st.integers(0, 255))
def test_branching_respects_forbidden_vertices(spec, forbidden):
    """With reductions inside, the bounded search finds what trying all subsets of the other vertices finds."""
    g = G.Graph(*spec)
    forbidden &= g.all
    free = [v for v in range(g.n) if not forbidden >> v & 1]
    sets = (sum(1 << v for i, v in enumerate(free) if m >> i & 1) for m in range(1 << len(free)))
    least = min((x.bit_count() for x in sets if G.acyclic(g, g.all & ~x)), default=None)
    for k in range(g.n + 1):
        found = G.branch(g, g.all, k, forbidden)
        assert (found is not None) == (least is not None and least <= k)
        if found is not None:
            assert not found & forbidden and found.bit_count() <= k and G.acyclic(g, g.all & ~found)


@settings(max_examples=150, deadline=None)
@given(graph)
def test_bounds_are_below_the_least_size(spec):
    g = G.Graph(*spec)
    pieces, forced = G.kernel_pieces(g)
    least = G.solve_brute(g).bit_count()
    assert forced.bit_count() + sum(G.lower_bound(h, part) for h, part in pieces) <= least
    assert forced.bit_count() + sum(G.solve_bst(h, part).bit_count() for h, part in pieces) == least


@settings(max_examples=80, deadline=None)
@given(graph, st.integers(0, 99))
def test_parts_of_the_memetic_search(spec, seed):
    import random

    g, r = G.Graph(*spec), random.Random(seed)
    for ordered in (True, False):
        x = G.diversify(g, g.all, r, ordered)
        assert G.acyclic(g, g.all & ~x)
    population = G.random_population(g.all, 6, r)
    assert len(population) == 6 and all(x & ~g.all == 0 for x in population)
    start = [G.prune_by_degree(g, G.repair(g, x, g.all), g.all) for x in population]
    after = G.one_generation(g, start, g.all, r)
    assert min(G.fitness(g, x, g.all) for x in after) <= min(G.fitness(g, x, g.all) for x in start)
    assert all(G.acyclic(g, g.all & ~x) and G.minimal(g, x) == x for x in start)
    better = G.swap_gain(g, start[0], g.all)
    assert G.acyclic(g, g.all & ~better) and better.bit_count() <= start[0].bit_count()


@settings(max_examples=150, deadline=None)
@given(graph)
def test_lists_agree_with_bit_sets(spec):
    from coppice.functions import adjacency as L

    n, edges, directed = spec
    every = [*edges, *((v, v) for v in range(n))]  # a loop for each, so that all are numbered alike
    g, lists = G.Graph(n, edges, directed), L.Lists(every, directed)
    label = L.strong_components(lists) if directed else L.plain_components(lists)
    assert sorted(label) == sorted(next(G.bits(p)) for p in G.components(g, g.all) for _ in G.bits(p))
    bare = L.Lists(edges, directed)
    left = {bare.ids[v] for v, x in enumerate(L.peeled(bare)) if x}
    assert left == set(G.bits(G.core(g, g.all)))
    found = [bare.ids[v] for v in L.any_cycle(bare)]
    assert bool(found) == (not G.acyclic(g, g.all))
    for a, b in zip(found, found[1:] + found[:1]):
        assert g.out[a] >> b & 1
    flat = L.Lists(every, False)
    core = L.core_numbers(flat)
    both = G.Graph(n, [(a, b) for a, b in edges if a != b], False)
    for k in range(1, n):
        alive, before = both.all, -1
        while alive != before:
            before = alive
            alive = sum(1 << v for v in G.bits(alive) if (both.out[v] & alive).bit_count() >= k)
        assert {v for v in range(n) if core[v] >= k} == set(G.bits(alive))
