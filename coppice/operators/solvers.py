"""Feedback vertex sets: exact and heuristic searches, one graph or component per row.

A search is not relational, so it runs in workers, keyed by graph or, with
``solve_by_component``, by components, whose least sizes add up.  An exact algorithm is
never exchanged for another: ``bst`` and ``ic`` take a graph by the components of its
kernel, whatever their size, and with ``seconds`` a search that is not done by then ends
with status TIMEOUT, no solution, and the lower bound that it had reached.  Heuristics
stop at that time with the best solution so far; without it they stop by generations.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.functions import graphs as G
from coppice.operators.edges import KEYS, both_ways, canonical, in_out_degrees, without_vertices
from coppice.operators.kernels import confluent_kernel
from coppice.operators.structure import connected, graph_rows, is_small, is_solution, numbered, peel, per_graph, strong_components
from coppice.plans.fixpoint import cut

EXACT = ("bst", "ic", "brute")
#: Edges of a graph that a worker takes vertices from one by one.
GREEDY_EDGES = 5_000
SOLUTION = (
    "graph_id long, n long, m long, fvs_size long, solution array<long>, valid boolean, minimal boolean, bound long, status string, "
    "kernel_n long, kernel_s double, search_s double"
)


def _exactly(graph: G.Graph, algo: str, clock: G.Clock) -> tuple[int | None, int, int, float]:
    """Solution (None if time is up), lower bound, vertices searched, seconds of the reduction."""
    start = time.monotonic()
    # over all subsets, the first solution is of the graph itself, so it is not reduced
    pieces, x = ([(graph, G.core(graph, graph.all))], 0) if algo == "brute" else G.kernel_pieces(graph)
    kernel_s, bound, whole = time.monotonic() - start, x.bit_count(), True
    for h, part in pieces:
        try:
            found = G.SOLVERS[algo](h, alive=part, clock=clock)
            bound += found.bit_count()
            x |= found
        except G.OutOfTime as late:
            whole = False
            bound += max(late.bound, G.lower_bound(h, part))
    return (x if whole else None), bound, sum(part.bit_count() for _, part in pieces), kernel_s


def _solve(directed: bool, algo: str, options: dict, seconds: float | None):
    def work(g: int, edges: list[tuple[int, int]]) -> list[tuple]:
        start = time.monotonic()
        (graph, ids), clock = numbered(edges, directed), G.Clock(seconds)
        if algo in EXACT:
            x, bound, kernel_n, kernel_s = _exactly(graph, algo, clock)
            status = "TIMEOUT" if x is None else "EXACT"
        else:
            kernel_n, kernel_s, status = graph.n, 0.0, "HEURISTIC"
            if algo in G.KERNEL_FIRST:
                kernel_n = G.kernelize(graph)[1].bit_count()
                kernel_s = time.monotonic() - start
            x = G.SOLVERS[algo](graph, **({} if algo == "greedy" else options | {"clock": clock}))
            bound = G.packing_bound(graph, graph.all)
        search_s = time.monotonic() - start - kernel_s
        if x is None:
            return [(g, graph.n, len(edges), None, None, None, None, bound, status, kernel_n, kernel_s, search_s)]
        valid = G.acyclic(graph, graph.all & ~x)
        minimal = valid and G.minimal(graph, x) == x
        return [(g, graph.n, len(edges), x.bit_count(), [ids[v] for v in G.bits(x)], valid, minimal, bound, status, kernel_n, kernel_s, search_s)]

    return work


def solve(
    edges: DataFrame, directed: bool, algo: str = "bst", ids: DataFrame | None = None, seconds: float | None = None, how: str = "auto", **options
) -> DataFrame:
    """``SOLUTION`` rows, one per graph (of ``ids``, if given: graphs without edges have size 0).

    ``status`` is EXACT, HEURISTIC or TIMEOUT; with TIMEOUT size, solution and flags are
    null and ``bound`` is a lower bound.  ``n`` counts vertices with an edge, ``kernel_n``
    those that the search is left with.  ``seconds`` holds for each graph.

    A table of graphs that fit a worker is searched graph by graph.  Where one does not, or
    with ``how="frames"``, all are reduced by joins and searched by the components of their
    kernels, ``seconds`` holds for each component, and ``minimal`` is null: it is not tried.
    """
    e = canonical(edges, directed, loops=True)
    if how == "worker" or (how == "auto" and is_small(e)):
        return per_graph(graph_rows(e, ids), _solve(directed, algo, options, seconds), SOLUTION)
    e = cut(e, "edges")
    ids = cut((e if ids is None else ids).select("graph_id").distinct(), "ids")
    return _solve_by_kernel(e, directed, algo, ids, seconds, options)


def _solve_by_kernel(e: DataFrame, directed: bool, algo: str, ids: DataFrame, seconds: float | None, options: dict) -> DataFrame:
    start = time.monotonic()
    k, forced = confluent_kernel(e, directed, "frames")
    k, forced = cut(k, "kernel"), cut(forced, "forced")
    kernel_s = time.monotonic() - start
    parts = cut(_searched(k, directed, algo, seconds, options, "frames"), "parts")
    found = parts.where("status <> 'TIMEOUT'").select("graph_id", F.explode("solution").alias("v")).unionByName(forced.select("graph_id", "v"))
    late = parts.where("status = 'TIMEOUT'").select("graph_id").distinct()
    chosen = cut(found.join(late, "graph_id", "left_anti"), "chosen")
    lists = chosen.groupBy("graph_id").agg(F.array_sort(F.collect_list("v")).alias("solution"))
    fixed = forced.groupBy("graph_id").agg(F.count(F.lit(1)).alias("forced"))
    sums = parts.groupBy("graph_id").agg(F.max("status").alias("status"), F.sum("bound").alias("bound"), F.sum("n").alias("kernel_n"), F.max("search_s").alias("search_s"))
    ends = e.select("graph_id", F.explode(F.array("src", "dst")).alias("v")).groupBy("graph_id").agg(F.count_distinct("v").alias("n"))
    whole = ids.join(ends, "graph_id", "left").join(e.groupBy("graph_id").agg(F.count(F.lit(1)).alias("m")), "graph_id", "left")
    for more in (is_solution(e, chosen, ids, directed, "frames"), lists, fixed, sums):
        whole = whole.join(more, "graph_id", "left")
    zero = F.lit(0).cast("long")
    status = F.coalesce("status", F.lit("EXACT" if algo in EXACT else "HEURISTIC"))
    done, none = status != "TIMEOUT", F.array().cast("array<long>")
    columns = {
        "n": F.coalesce("n", zero),
        "m": F.coalesce("m", zero),
        "fvs_size": F.when(done, F.coalesce(F.size("solution").cast("long"), zero)),
        "solution": F.when(done, F.coalesce("solution", none)),
        "valid": F.when(done, F.col("valid")),
        "minimal": F.lit(None).cast("boolean"),
        "bound": F.coalesce("bound", zero) + F.coalesce("forced", zero),
        "status": status,
        "kernel_n": F.coalesce("kernel_n", zero),
        "kernel_s": F.lit(kernel_s),
        "search_s": F.coalesce("search_s", F.lit(0.0)),
    }
    # F.size of a null array is -1 or null, by a setting: the list is made whole first
    whole = whole.withColumn("solution", F.coalesce("solution", none))
    return whole.select("graph_id", *(c.alias(n) for n, c in columns.items()))


def _searched(kernel: DataFrame, directed: bool, algo: str, seconds: float | None, options: dict, how: str) -> DataFrame:
    """``SOLUTION`` rows of the strong or plain components of a table, ``graph_id`` repeated for each."""
    labels = strong_components(kernel, how).withColumnRenamed("scc", "component") if directed else connected(kernel, how=how)
    labels = cut(labels, "labels")
    inner = kernel.join(labels.select("graph_id", F.col("v").alias("src"), F.col("component").alias("piece")), ["graph_id", "src"])
    if directed:
        b = labels.select("graph_id", F.col("v").alias("dst"), F.col("component").alias("other"))
        inner = inner.join(b, ["graph_id", "dst"]).where("piece = other")
    rows = inner.groupBy("graph_id", "piece").agg(F.collect_list(F.struct("src", "dst")).alias("edges")).select(F.struct("graph_id", "piece").alias("k"), "edges")
    found = per_graph(rows.select(F.to_json("k").alias("graph_id"), "edges"), _solve(directed, algo, options, seconds), SOLUTION.replace("graph_id long", "graph_id string"))
    return found.withColumn("graph_id", F.get_json_object("graph_id", "$.graph_id").cast("long"))


def solve_by_component(
    edges: DataFrame, directed: bool, algo: str = "bst", ids: DataFrame | None = None, how: str = "auto", seconds: float | None = None, **options
) -> DataFrame:
    """``(graph_id, fvs_size, pieces, bound, status)``: sums of the pieces' sizes and bounds; each strong or plain component
    is a task's row.  ``seconds`` holds for each piece; ``status`` is EXACT where all pieces are, and TIMEOUT, with
    a null size, where one is."""
    e = cut(canonical(edges, directed, loops=True), "edges")
    e = cut(peel(e, directed, sinks=directed, how=how), "peeled")
    parts = _searched(e, directed, algo, seconds, options, how).select("graph_id", "fvs_size", "bound", "status")
    # of the three words TIMEOUT is the largest one, then HEURISTIC
    sizes = parts.groupBy("graph_id").agg(F.sum("fvs_size").alias("fvs_size"), F.count(F.lit(1)).alias("pieces"), F.sum("bound").alias("bound"), F.max("status").alias("status"))
    if ids is None:
        ids = edges.select("graph_id").distinct()
    zero = F.lit(0).cast("long")
    counts = (F.coalesce(name, zero).alias(name) for name in ("pieces", "bound"))
    j = ids.select("graph_id").distinct().join(sizes, "graph_id", "left").withColumn("status", F.coalesce("status", F.lit("EXACT")))
    return j.select("graph_id", F.when(F.col("status") != "TIMEOUT", F.coalesce("fvs_size", zero)).alias("fvs_size"), *counts, "status")


def greedy(edges: DataFrame, directed: bool, by: str = "degree", max_iter: int = 100_000, how: str = "auto") -> DataFrame:
    """``(graph_id, v)``: take the largest residual degree (``out``: out-degree), ties to the larger id, until acyclic.

    Every turn takes one vertex from each graph that still has a cycle: a table of many
    graphs needs as many turns as its largest solution has vertices.  More than
    ``max_iter`` are an error.  Graphs of up to ``GREEDY_EDGES`` edges take theirs in workers.
    """
    e = cut(canonical(edges, directed, loops=True), "edges")
    if how == "worker" or (how == "auto" and is_small(e, GREEDY_EDGES)):

        def work(g: int, es: list[tuple[int, int]]) -> list[tuple]:
            graph, ids = numbered(es, directed)
            return [(g, ids[v]) for v in G.bits(G.solve_greedy(graph, by=by))]

        return per_graph(graph_rows(e), work, "graph_id long, v long")
    taken = []
    while True:
        cyclic = cut(peel(e, directed).select("graph_id").distinct(), "cyclic")
        if cyclic.isEmpty():
            break
        if len(taken) >= max_iter:
            raise RuntimeError(f"greedy: cycles left after {max_iter} turns")
        e = cut(e.join(cyclic, "graph_id", "left_semi"), "edges")
        if directed:
            d = in_out_degrees(e).withColumn("d", F.col("out_degree") if by == "out" else F.col("in_degree") + F.col("out_degree"))
        else:
            ends = e.select("graph_id", F.explode(F.array("src", "dst")).alias("v"))
            d = ends.groupBy("graph_id", "v").agg(F.count(F.lit(1)).alias("d"))
        top = cut(d.groupBy("graph_id").agg(F.max(F.struct("d", "v")).alias("x")).select("graph_id", F.col("x.v").alias("v")), "top")
        taken.append(top)
        e = cut(without_vertices(e, top), "edges")
    out = taken[0] if taken else e.select("graph_id", F.col("src").alias("v")).limit(0)
    for more in taken[1:]:
        out = out.unionByName(more)
    return out


def consensus(population: DataFrame, n: DataFrame, share: float = 0.6) -> DataFrame:
    """Vertices to commit from ``population (graph_id, member, v)``: in at least ``ceil(share * members)``
    members; where these are over half of the graph's ``n``, the first 30% of n by (count, id)."""
    from pyspark.sql import Window

    members = population.groupBy("graph_id").agg(F.count_distinct("member").alias("members"))
    counts = population.groupBy("graph_id", "v").agg(F.count_distinct("member").alias("c")).join(members, "graph_id").join(n, "graph_id")
    chosen = counts.where(F.col("c") >= F.ceil(F.lit(share) * F.col("members")))
    w = Window.partitionBy("graph_id")
    chosen = chosen.withColumn("k", F.count(F.lit(1)).over(w)).withColumn("r", F.row_number().over(w.orderBy(F.col("c").desc(), "v")))
    cap = F.when(F.col("k") > F.col("n") / 2, F.greatest(F.lit(1), F.floor(F.col("n") * 0.3))).otherwise(F.col("k"))
    return chosen.where(F.col("r") <= cap).select("graph_id", "v")


def best_of(solutions: DataFrame, order: dict[str, int] | None = None) -> DataFrame:
    """Per graph the valid solution of least size; ties to the first algorithm by name or by ``order``."""
    place = F.lit(0) if not order else F.create_map(*(F.lit(x) for kv in order.items() for x in kv))[F.col("algo")]
    return solutions.where("valid").groupBy("graph_id").agg(F.min(F.struct("fvs_size", place.alias("place"), "algo")).alias("b")).select("graph_id", "b.algo", "b.fvs_size")


def neighbours(edges: DataFrame, keys=KEYS) -> DataFrame:
    """``(keys, v, near)``: adjacency as sorted arrays."""
    return both_ways(canonical(edges)).groupBy(*keys, F.col("src").alias("v")).agg(F.array_sort(F.collect_set("dst")).alias("near"))
