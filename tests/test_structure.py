"""DataFrame operators: both ways of each agree, goldens hold, odd inputs do not crash."""

import random

import pytest
from pyspark.sql import functions as F

from coppice.operators import edges as E
from coppice.operators import generate, kernels, runner, scoring, solvers
from coppice.operators import structure as S


def table(spark, edges, graph=0):
    return spark.createDataFrame([(graph, a, b) for a, b in edges], "graph_id long, src long, dst long")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def mixed(spark):
    r = random.Random(4)
    data = [(g, r.randrange(9), r.randrange(9)) for g in range(6) for _ in range(5 + 3 * g)]
    return spark.createDataFrame(data, "graph_id long, src long, dst long").cache()


def test_strong_components_agree(mixed):
    assert rows(S.strong_components(mixed, "worker")) == rows(S.strong_components(mixed, "frames"))


@pytest.mark.parametrize("directed", [True, False])
def test_peeling_agrees(mixed, directed):
    assert rows(S.peel(mixed, directed, directed, "worker")) == rows(S.peel(mixed, directed, directed, "frames"))


def test_core_numbers_agree(mixed):
    assert rows(S.core_numbers(mixed, "worker")) == rows(S.core_numbers(mixed, "frames"))


def test_cores_in_a_worker_need_no_row_of_a_whole_graph(mixed):
    """One row with all edges of a graph of 35 million overran an executor's heap."""
    e = S.core_numbers(mixed, "worker")
    assert "collect_list" not in e._jdf.queryExecution().toString()


def _batches(data, size):
    import pyarrow as pa

    for i in range(0, len(data), size):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*data[i : i + size])], ["graph_id", "src", "dst"])


@pytest.mark.parametrize("few, part", [(64, 1 << 19), (0, 1 << 19), (0, 3), (5, 3)])
def test_cores_of_arrays_are_those_of_lists(monkeypatch, few, part):
    """Graphs cut by batches anywhere, without an id, with ids beyond 32 bits; by arrays from the first, the eighth or no edge on."""
    from coppice.functions import adjacency as L

    monkeypatch.setattr(L.Arrays, "FEW", few)
    monkeypatch.setattr(L.Arrays, "PART", part)
    r = random.Random(8)
    for _ in range(20):
        data, want = [], []
        for g in [None, -1, 0, 7]:
            n, wide = r.randint(2, 30), r.choice([1, 10**12])
            ends = ((r.randrange(n) * wide - 5, r.randrange(n)) for _ in range(r.randint(1, 80)))
            es = list({(min(a, b), max(a, b)) for a, b in ends if a != b})
            data += [(g, a, b) for a, b in es]
            lists = L.Lists(es, False)
            want += [(g, lists.ids[v], k) for v, k in enumerate(L.core_numbers(lists))]
        for most in (0, 7, 10**6):
            monkeypatch.setattr(S, "WORKER_EDGES", most)
            got = [tuple(x.values()) for b in S._core_rows(_batches(data, r.choice([1, 4, 50]))) for x in b.to_pylist()]
            assert sorted(got, key=str) == sorted(want, key=str)


def test_arrays_take_12_bytes_an_edge():
    import tracemalloc

    import numpy as np

    from coppice.functions import adjacency as L

    pairs = np.unique(np.random.default_rng(1).integers(0, 10**10, 3_000_000))
    tracemalloc.start()
    try:
        g = L.Arrays()
        for i in range(0, len(pairs), 10_000):
            g.take(pairs[i : i + 10_000] // 100_000, pairs[i : i + 10_000] % 100_000 + 100_000)
        g.close()
        core = L.core_array(g)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(core) == 200_000 and peak < 12 * len(pairs) + 64 * len(core) + 32 * L.Arrays.PART


def test_cores_of_graphs_beyond_a_worker(spark, mixed, monkeypatch):
    """A graph that a worker cannot hold is worked on by joins, also where the worker is asked for."""
    monkeypatch.setattr(S, "WORKER_EDGES", 5)
    held = rows(S.core_numbers(mixed, "worker"))
    monkeypatch.setattr(S, "HELD_BYTES", 100)
    beyond = S.core_numbers(mixed, "worker")
    assert "MapInArrow" not in beyond._jdf.queryExecution().toString()
    assert rows(beyond) == held


@pytest.mark.parametrize("directed", [True, False])
def test_kernels_keep_the_least_size(spark, mixed, directed):
    ids = mixed.select("graph_id").distinct()
    before = dict(rows(solvers.solve(mixed, directed, "bst", ids).select("graph_id", "fvs_size")))
    for how in ("worker", "frames"):
        k, forced = kernels.kernel(mixed, directed, how)
        after = dict(rows(solvers.solve(k, directed, "bst", ids).select("graph_id", "fvs_size")))
        n = dict(rows(forced.groupBy("graph_id").count()))
        assert {g: s + n.get(g, 0) for g, s in after.items()} == before


def test_sizes_add_up_over_components(mixed):
    ids = mixed.select("graph_id").distinct()
    whole = rows(solvers.solve(mixed, True, "bst", ids).select("graph_id", "fvs_size"))
    assert rows(solvers.solve_by_component(mixed, True, "bst", ids).select("graph_id", "fvs_size")) == whole


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_agree(spark, seed):
    r = random.Random(seed)
    data = [(g, r.randrange(60), r.randrange(60)) for g in range(4) for _ in range((10, 25, 40, 80)[g])]
    data += [(5, i, i + 1) for i in range(20)] + [(6, 3, 3), (7, None, 1)]
    e = spark.createDataFrame(data, "graph_id long, src long, dst long")
    whole = e.where("src is not null")
    assert rows(S.connected(e.where("graph_id < 7"), how="worker")) == rows(S.connected(e.where("graph_id < 7"), how="frames"))
    from coppice.operators.components import component_labels

    assert rows(component_labels(e, keys=("graph_id",))) == rows(component_labels(whole, keys=("graph_id",)))


def test_greedy_is_a_solution(mixed):
    ids = mixed.select("graph_id").distinct()
    for directed in (True, False):
        x = solvers.greedy(mixed, directed)
        assert all(r["valid"] for r in S.is_solution(mixed, x, ids, directed).collect())


def test_verifier_sees_the_triangle(spark):
    """A triangle with nothing removed is no forest."""
    e = table(spark, [(0, 1), (1, 2), (2, 0)])
    nothing = e.select("graph_id", F.col("src").alias("v")).limit(0)
    assert rows(S.is_solution(e, nothing, e, directed=False)) == [(0, False)]


def test_loops_are_cycles(spark):
    e = table(spark, [(0, 0), (0, 1)])
    for directed in (True, False):
        assert rows(S.has_cycle(e, e, directed)) == [(0, True)]
        assert solvers.solve(e, directed).first()["fvs_size"] == 1


def test_walks_on_a_directed_triangle(spark):
    e = table(spark, [(0, 1), (1, 2), (2, 0)])
    p = S.return_probabilities(e, E.vertices(e), True, (2, 3))
    assert {(r["step"], r["p"]) for r in p.collect()} == {(2, 0.0), (3, 1.0)}


def test_isolated_vertices_never_return(spark):
    e = table(spark, [(0, 1), (1, 0)])
    of = spark.createDataFrame([(0, v) for v in range(4)], "graph_id long, v long")
    p = S.return_probabilities(e, of, True, (2,))
    assert rows(p.where("v >= 2").select("v", "p")) == [(2, 0.0), (3, 0.0)]


def test_empty_tables(spark):
    e = table(spark, [])
    ids = spark.createDataFrame([(7,)], "graph_id long")
    assert rows(solvers.solve(e, True, "bst", ids).select("graph_id", "fvs_size")) == [(7, 0)]
    assert rows(S.has_cycle(e, ids, True)) == [(7, False)]
    assert rows(S.strong_components(e, "frames")) == []
    assert rows(S.triangles(e)) == rows(S.four_cycles(e)) == []


def test_relabel_and_lift(spark):
    e = table(spark, [(10, 2), (2, 30)])
    labels = E.dense_labels(E.vertices(e))
    assert rows(E.relabel(e, labels)) == [(0, 0, 2), (0, 1, 0)]
    assert rows(E.lift(spark.createDataFrame([(0, 1)], "graph_id long, v long"), labels)) == [(0, 10)]
    assert [r["v"] for r in E.dense_labels(E.vertices(e), as_text=True).orderBy("new_v").collect()] == [10, 2, 30]


def test_candidates_follow_the_rules(spark):
    def pick(probs, **kw):
        t = spark.createDataFrame([(0, i, p) for i, p in enumerate(probs)], "graph_id long, v long, prob double")
        return [r["v"] for r in scoring.candidates(t, **kw).orderBy("v").collect()]

    assert pick([0.1] * 100) == []
    assert pick([0.9, 0.8] + [0.1] * 98) == [0, 1]
    assert pick([0.9] * 50 + [0.1] * 50) == list(range(8))
    assert pick([0.9] + [0.1] * 999, least=0.005) == []


def test_split_is_stratified(spark):
    t = spark.createDataFrame([(i, "a" if i < 20 else "b" if i < 40 else "c") for i in range(50)], "id long, family string")
    n = {(r["family"], r["split"]): r["count"] for r in scoring.stratified_split(t, ["family"], "id").groupBy("family", "split").count().collect()}
    assert n == {("a", "val"): 4, ("a", "train"): 16, ("b", "val"): 4, ("b", "train"): 16, ("c", "val"): 2, ("c", "train"): 8}


def test_learning_rate_rises_then_falls():
    rates = [scoring.learning_rate(i, 5, 50) for i in range(50)]
    assert rates[:5] == [0.2, 0.4, 0.6, 0.8, 1.0]
    assert rates[5:] == sorted(rates[5:], reverse=True)


def test_generators(spark):
    assert generate.grown(spark, "tree", [30]).count() == 29
    for family in ("ba", "ws", "ego", "scale_free", "molecule"):
        g = generate.grown(spark, family, [30, 40], seed=1)
        assert rows(g.where("graph_id = 1")) == rows(generate.grown(spark, family, [10, 40], seed=1).where("graph_id = 1"))
    assert not S.has_cycle(generate.dag(spark, 20, 200), generate.dag(spark, 20, 200), True).first()["has_cycle"]


def test_runner_resumes_by_the_whole_key(spark):
    work = spark.createDataFrame([("exact", "a.txt"), ("heuristic", "a.txt")], "track string, file string")
    done = work.where("track = 'exact'")
    assert rows(runner.remaining(work, done, ["track", "file"])) == [("heuristic", "a.txt")]


def test_logistic_model_learns(spark):
    t = spark.createDataFrame([(i / 100.0, int(i > 50)) for i in range(100)], "x double, y int")
    model = scoring.train_logistic(t, ["x"])
    assert model.coefficients[0] > 0


def _cliques(g, size, copies):
    return [(g, size * i + a, size * i + b) for i in range(copies) for a in range(size) for b in range(a)]


def test_exact_searches_of_large_graphs_stay_exact(spark):
    """Whatever its size a graph is reduced, split and solved by the algorithm that was asked for."""
    wheel = [(3, 0, i) for i in range(1, 71)] + [(3, i, i % 70 + 1) for i in range(1, 71)]
    graphs = [(1, i, (i + 1) % 70) for i in range(70)] + _cliques(2, 4, 20) + wheel
    e = spark.createDataFrame(graphs, "graph_id long, src long, dst long")
    columns = ["graph_id", "fvs_size", "bound", "status"]
    for search in (solvers.solve, solvers.solve_by_component):
        for algo in ("bst", "ic"):
            assert rows(search(e, False, algo).select(columns)) == [(1, 1, 1, "EXACT"), (2, 40, 40, "EXACT"), (3, 2, 2, "EXACT")]
    both = spark.createDataFrame([(g, a, b) for g, x, y in graphs for a, b in ((x, y), (y, x))], "graph_id long, src long, dst long")
    found = solvers.solve(both.where("graph_id = 2"), True, "ic")
    assert found.select("fvs_size", "valid", "minimal", "status").first() == (60, True, True, "EXACT")


@pytest.mark.parametrize("algo", ["bst", "ic", "brute"])
def test_time_that_is_up_is_told(spark, algo):
    """No solution is passed off as a least one; what reduction alone solves needs no time."""
    e = spark.createDataFrame(_cliques(1, 7, 1) + [(2, 0, 1), (2, 1, 2)], "graph_id long, src long, dst long")
    for search in (solvers.solve, solvers.solve_by_component):
        late, done = search(e, False, algo, seconds=-1.0).orderBy("graph_id").select("fvs_size", "bound", "status").collect()
        assert late["fvs_size"] is None and late["status"] == "TIMEOUT" and 0 <= late["bound"] <= 5
        assert tuple(done) == (0, 0, "EXACT")
    heuristic = solvers.solve(e, False, "kma", seconds=-1.0).where("graph_id = 1").first()
    assert heuristic["valid"] and heuristic["status"] == "HEURISTIC"


@pytest.mark.parametrize("directed", [True, False])
def test_large_graphs_are_solved_by_their_kernels(spark, mixed, directed):
    """Reduced by joins and searched by component, the sizes are those of whole graphs in workers."""
    ids = mixed.select("graph_id").unionByName(spark.createDataFrame([(77,)], "graph_id long")).distinct()
    columns = ["graph_id", "n", "m", "fvs_size", "valid", "bound", "status"]
    one = rows(solvers.solve(mixed, directed, "bst", ids, how="worker").select(columns))
    two = solvers.solve(mixed, directed, "bst", ids, how="frames")
    assert two.columns == [x.split()[0] for x in solvers.SOLUTION.split(", ")] and rows(two.select(columns)) == one
    hard = mixed.unionByName(spark.createDataFrame([(8, x, y) for _, a, b in _cliques(8, 7, 1) for x, y in ((a, b), (b, a))], mixed.schema))
    late = solvers.solve(hard, directed, "bst", hard, seconds=-1.0, how="frames").collect()
    assert {r["status"] for r in late} >= {"TIMEOUT"}
    assert all((r["fvs_size"] is None) == (r["status"] == "TIMEOUT") == (r["solution"] is None) for r in late)
    best = {r[0]: r[3] for r in one} | {8: 6 if directed else 5}
    assert all(r["bound"] <= best[r["graph_id"]] for r in late)
    assert all(r["valid"] for r in solvers.solve(mixed, directed, "kma", ids, how="frames").collect())


@pytest.mark.parametrize("directed", [True, False])
def test_cycles_found_over_tables_are_cycles(spark, mixed, directed):
    ring = [(20, i, (i + 1) % 37) for i in range(37)] + [(20, 5, 50), (20, 50, 51)]
    # two rings joined by a path, which a walk goes along both ways
    ring += [(21, a, b) for a, b in ((0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 6), (6, 4))] + [(22, 0, 1), (22, 1, 2)]
    e = mixed.unionByName(spark.createDataFrame(ring, mixed.schema))
    for some in (e, e.where("src <> dst")):
        known = {(r["graph_id"], r["src"], r["dst"]) for r in some.collect()}
        known |= set() if directed else {(g, b, a) for g, a, b in known}
        one, two = ({r["graph_id"]: r["cycle"] for r in S.find_cycle(some, directed, how=how).collect()} for how in ("worker", "frames"))
        assert set(one) == set(two) and 20 in two and 22 not in two
        for found in (one, two):
            for g, c in found.items():
                assert len(set(c)) == len(c) and (directed or len(c) != 2)
                assert all((g, a, b) in known for a, b in zip(c, c[1:] + c[:1]))
        assert len(two[20]) == 37


@pytest.mark.parametrize("directed", [True, False])
def test_girths_agree(spark, mixed, directed, monkeypatch):
    ring = [(20, i, (i + 1) % 9) for i in range(9)] + [(20, 5, 50)] + [(21, i, (i + 1) % 8) for i in range(8)] + [(22, 0, 1), (22, 1, 2)]
    e = mixed.unionByName(spark.createDataFrame(ring, mixed.schema))
    for some in (e, e.where("src <> dst")):
        one = rows(S.girth(some, directed, "worker"))
        assert rows(S.girth(some, directed, "frames")) == one and (20, 9) in one and (21, 8) in one
    monkeypatch.setattr(S, "WALK_STARTS", 12)
    assert rows(S.girth(some, directed, "frames")) == one


def test_greedy_and_levels_agree(mixed, spark):
    for directed in (True, False):
        for by in ("degree", "out") if directed else ("degree",):
            assert rows(solvers.greedy(mixed, directed, by, how="worker")) == rows(solvers.greedy(mixed, directed, by, how="frames"))
    of = E.vertices(mixed).unionByName(spark.createDataFrame([(0, 50), (9, 1)], "graph_id long, v long"))
    some = mixed.where("src < dst or (src = 5 and dst = 2)")
    assert rows(S.topological_levels(some, of, how="worker")) == rows(S.topological_levels(some, of, how="frames"))


def test_budgets_of_kernels(spark):
    e = spark.createDataFrame([(1, 0, 0), (1, 1, 1)] + _cliques(2, 4, 1) + [(3, 0, 1)], "graph_id long, src long, dst long")
    k, forced = kernels.kernel(e, False)
    budgets = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "graph_id long, k long")
    assert rows(kernels.within_budget(k, forced, budgets)) == [(1, -1, False), (2, 0, False), (3, 0, True)]
    more = spark.createDataFrame([(1, 2), (2, 2)], "graph_id long, k long")
    assert rows(kernels.within_budget(k, forced, more)) == [(1, 0, True), (2, 2, True)]


def test_jobs_end_at_their_time_limit(spark):
    import time

    from coppice.plans.fixpoint import time_limit

    def slow(batches):
        for pdf in batches:
            time.sleep(30)
            yield pdf

    start = time.monotonic()
    with pytest.raises(TimeoutError), time_limit(spark, 1.5):
        spark.range(4).mapInPandas(slow, "id long").count()
    assert time.monotonic() - start < 20
    with time_limit(spark, 60):
        assert spark.range(9).count() == 9
    with pytest.raises(ZeroDivisionError), time_limit(spark, 60):
        1 / 0


def test_runs_tell_sizes_and_times(spark):
    e = spark.createDataFrame(_cliques(1, 5, 2) + [(1, 9, 10)], "graph_id long, src long, dst long")
    r = runner.run(e, e, ["bst", "kma"], False).collect()
    assert [(x["algo"], x["n"], x["m"], x["fvs_size"], x["status"]) for x in r] == [("bst", 11, 21, 6, "EXACT"), ("kma", 11, 21, 6, "HEURISTIC")]
    assert all(x["runtime_ms"] >= 0 and x["kernel_n"] <= 10 and x["kernel_s"] >= 0 and x["search_s"] >= 0 and x["executed_at"] for x in r)


def test_suite_appends_what_is_missing(spark, tmp_path):
    e = spark.createDataFrame([(g, a, b) for g in (1, 2) for a, b in ((0, 1), (1, 2), (2, 0))], "graph_id long, src long, dst long")
    graphs = spark.createDataFrame([(1, "directed", "exact", "ego", "a_000000.txt"), (2, "undirected", "heuristic", "ba", "a_000000.txt")], "graph_id long, family string, track string, category string, file string")
    path = str(tmp_path / "suite")
    assert runner.suite(graphs.where("graph_id = 1"), e, ["bst"], path) == 1
    assert runner.suite(graphs, e, ["bst", "greedy"], path) == 3
    assert runner.suite(graphs, e, ["bst", "greedy"], path) == 0
    # other options are other results
    assert runner.suite(graphs, e, ["bst"], path, seconds=60.0) == 2
    stored = spark.read.parquet(path)
    assert stored.columns == runner.SUITE and stored.where("fvs_size = 1 and valid").count() == 6


@pytest.mark.parametrize("directed", [True, False])
def test_walks_agree(mixed, directed, monkeypatch):
    of = E.vertices(mixed)

    def walks(how):
        found = S.return_probabilities(mixed, of, directed, (2, 3, 5, 8), how).collect()
        return {(r["graph_id"], r["v"], r["step"]): r["p"] for r in found}

    small = walks("worker")
    assert small == pytest.approx(walks("frames"))
    monkeypatch.setattr(S, "WALK_STARTS", 5)
    assert small == pytest.approx(walks("frames"))


@pytest.mark.parametrize("directed", [True, False])
@pytest.mark.parametrize("make", ["v2", "v3"])
def test_features_agree(spark, mixed, make, directed):
    from coppice.operators import features

    of = E.vertices(mixed).unionByName(spark.createDataFrame([(0, 77), (8, 1)], "graph_id long, v long"))
    one, two = (sorted(map(tuple, getattr(features, make)(mixed, of, directed, how).collect())) for how in ("worker", "frames"))
    assert len(one) == len(two) == of.distinct().count()
    for a, b in zip(one, two):
        assert a == pytest.approx(b)


def test_hubs_do_not_square(spark):
    """A hub of 100,000 neighbours with few triangles: its pairs of neighbours are never listed."""
    n = 100_000
    star = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("graph_id"), F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    ring = spark.createDataFrame([(0, i, i % 6 + 1) for i in range(1, 7)], "graph_id long, src long, dst long")
    e = star.unionByName(ring)
    assert dict(rows(S.triangles(e).select("v", "triangles"))) == {0: 6} | {i: 2 for i in range(1, 7)}
    assert rows(S.four_cliques(e)) == []
    # around the hub every cycle of four has a chord, save those over a ring vertex that is skipped: none
    assert rows(S.four_cycles(e)) == []
    assert dict(rows(S.core_numbers(e).where("v <= 7").select("v", "core"))) == {i: 3 for i in range(7)} | {7: 1}


def test_large_graphs_in_a_worker_take_time_by_their_edges():
    import time

    from coppice.functions import adjacency as L

    r, start = random.Random(1), time.monotonic()
    edges = [(r.randrange(100_000), r.randrange(100_000)) for _ in range(200_000)]
    g = L.Lists(edges, True)
    assert len(L.core_numbers(L.Lists(edges, False))) == g.n
    assert len(set(L.strong_components(g))) > 1 and any(L.peeled(g, True))
    assert L.any_cycle(g)
    assert time.monotonic() - start < 20


def test_loops_over_tables_end_with_an_error(spark, mixed):
    with pytest.raises(RuntimeError, match="kernel"):
        kernels.kernel(mixed, True, "frames", max_iter=1)
    with pytest.raises(RuntimeError, match="greedy"):
        solvers.greedy(mixed, True, max_iter=1, how="frames")


def test_a_sample_takes_as_many_layers_as_it_needs(spark):
    path = spark.createDataFrame([(1, i, i + 1) for i in range(14)] + [(2, 0, 1), (2, 5, 6)], "graph_id long, src long, dst long")
    got = rows(S.bfs_sample(path, 15).groupBy("graph_id").count())
    assert got == [(1, 15), (2, 4)]


def test_cut_tables_go_with_their_scope(spark):
    import os

    from coppice.plans import fixpoint

    def there(df):
        return [f for f in df.inputFiles() if os.path.exists(f.removeprefix("file:").replace("///", "/"))]

    with fixpoint.scope():
        inner = fixpoint.cut(spark.range(5))
        assert inner.count() == 5 and there(inner)
    assert not there(inner)
    seen = []
    outer = fixpoint.cut_of(lambda: seen.append(fixpoint.cut(spark.range(7))) or seen[0].where("id > 2"), "outer")
    assert outer.count() == 4 and there(outer) and not there(seen[0])


def test_scopes_of_threads_are_apart(spark):
    import threading

    from coppice.plans import fixpoint

    made, go, done = [], threading.Event(), threading.Event()

    def other():
        made.append(fixpoint.cut(spark.range(3)))
        go.set()
        done.wait(60)

    with fixpoint.scope():
        t = threading.Thread(target=other)
        t.start()
        assert go.wait(60)
    assert made[0].count() == 3
    done.set()
    t.join()


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from coppice.plans import fixpoint

    conf = SimpleNamespace(get=lambda key, default=None: default)
    for master, fails in (("spark://host:7077", True), ("local-cluster[2,1,1024]", True), ("yarn", True), ("local[4]", False)):
        made = []
        sc = SimpleNamespace(master=master, getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append)
        session = SimpleNamespace(sparkContext=sc, conf=conf)
        if fails:
            with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
                fixpoint.shared_dir(session)
        else:
            assert fixpoint.shared_dir(session) == made[0]


def test_levels_over_the_limit_are_an_error(spark):
    path = spark.createDataFrame([(1, i, i + 1) for i in range(4)], "graph_id long, src long, dst long")
    of = spark.createDataFrame([(1, i) for i in range(5)], "graph_id long, v long")
    assert rows(S.topological_levels(path, of, max_iter=5, how="frames")) == [(1, i, i) for i in range(5)]
    with pytest.raises(RuntimeError, match="4 levels"):
        S.topological_levels(path, of, max_iter=4, how="frames")
