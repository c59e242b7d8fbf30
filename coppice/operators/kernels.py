"""Reduction rules that keep the least solution size, to a fixpoint.

Undirected: U0 a vertex with a loop is forced; U1 degree at most one goes; U2 a vertex of
degree two whose neighbours are not adjacent is replaced by an edge.  Directed: D0 loop
forced; D1 sources and sinks go; D2/D3 a vertex with one predecessor or one successor is
bypassed; D4 what lies in no component with a cycle goes.  U0, U1, D0, D1 and D4 give one
kernel in any order; the others give one of several, with forced vertices to match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.functions import graphs as G
from coppice.operators.edges import KEYS, both_ways, canonical, in_out_degrees, induced, self_loops, without_vertices
from coppice.operators.structure import graph_rows, is_small, nontrivial_scc, numbered, peel, per_graph
from coppice.plans.fixpoint import cut, signature


def confluent_kernel(edges: DataFrame, directed: bool, how: str = "auto") -> tuple[DataFrame, DataFrame]:
    """Kernel edges and forced vertices by the rules whose result does not depend on their order."""
    e = cut(canonical(edges, directed, loops=True), "edges")
    forced = self_loops(e)
    rest = without_vertices(e, forced)
    if directed:
        # cycles lie within components; peeling first makes the component search small
        inner = cut(peel(rest, True, sinks=True, how=how), "peeled")
        return _within_components(inner, how), forced
    return peel(rest, False, how=how), forced


def _within_components(edges: DataFrame, how: str) -> DataFrame:
    from coppice.operators.structure import strong_components

    s = strong_components(edges, how)
    a = s.select("graph_id", F.col("v").alias("src"), F.col("scc").alias("a"))
    b = s.select("graph_id", F.col("v").alias("dst"), F.col("scc").alias("b"))
    return edges.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"]).where("a = b").select("graph_id", "src", "dst")


def scc_prune(edges: DataFrame, how: str = "auto") -> DataFrame:
    """Edges between vertices of components of more than one vertex."""
    return induced(canonical(edges, True, loops=True), nontrivial_scc(edges, how, loops=False))


def _independent(candidates: DataFrame, adjacent: DataFrame) -> DataFrame:
    """Candidates without a smaller candidate among their neighbours."""
    near = adjacent.join(candidates.select("graph_id", F.col("v").alias("src")), ["graph_id", "src"], "left_semi")
    near = near.join(candidates.select("graph_id", F.col("v").alias("dst")), ["graph_id", "dst"], "left_semi")
    beaten = near.where("dst < src").select("graph_id", F.col("src").alias("v")).distinct()
    return candidates.join(beaten, ["graph_id", "v"], "left_anti")


def contract_once(edges: DataFrame) -> DataFrame:
    """One round of U2 on an independent set with at most one vertex for each pair of neighbours."""
    both = both_ways(edges)
    two = both.groupBy("graph_id", F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("d"), F.min("dst").alias("a"), F.max("dst").alias("b"))
    two = two.where("d = 2").select("graph_id", "v", "a", "b")
    two = two.join(edges.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b")), ["graph_id", "a", "b"], "left_anti")
    two = two.groupBy("graph_id", "a", "b").agg(F.min("v").alias("v"))
    chosen = cut(_independent(two, both), "chosen")
    return without_vertices(edges, chosen).unionByName(chosen.select("graph_id", F.col("a").alias("src"), F.col("b").alias("dst"))).distinct()


def bypass_once(edges: DataFrame) -> DataFrame:
    """One round of D2/D3 on an independent set of vertices without a loop."""
    d = in_out_degrees(edges).where("in_degree >= 1 and out_degree >= 1 and (in_degree = 1 or out_degree = 1)").select("graph_id", "v")
    d = d.join(self_loops(edges), ["graph_id", "v"], "left_anti")
    both = edges.select("graph_id", "src", "dst").unionByName(edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    chosen = cut(_independent(d, both), "chosen")
    into = edges.join(chosen.withColumnRenamed("v", "dst"), ["graph_id", "dst"]).select("graph_id", F.col("dst").alias("v"), "src")
    out = edges.join(chosen.withColumnRenamed("v", "src"), ["graph_id", "src"]).select("graph_id", F.col("src").alias("v"), "dst")
    new = into.join(out, ["graph_id", "v"]).select("graph_id", "src", "dst")
    return without_vertices(edges, chosen).unionByName(new).distinct()


def kernel(edges: DataFrame, directed: bool, how: str = "auto", max_iter: int = 500) -> tuple[DataFrame, DataFrame]:
    """Kernel edges and forced vertices by all rules; more than ``max_iter`` turns over tables are an error."""
    e = canonical(edges, directed, loops=True)
    if how == "worker" or (how == "auto" and is_small(e)):

        def work(g: int, es: list[tuple[int, int]]) -> list[tuple]:
            graph, ids = numbered(es, directed)
            h, alive, forced = G.kernelize(graph)
            rows = [(g, ids[a], ids[b], False) for a in G.bits(alive) for b in G.bits(h.out[a]) if directed or a <= b]
            return rows + [(g, ids[v], None, True) for v in G.bits(forced)]

        done = cut(per_graph(graph_rows(e), work, "graph_id long, src long, dst long, forced boolean"), "kernel")
        return done.where("not forced").select("graph_id", "src", "dst"), done.where("forced").select("graph_id", F.col("src").alias("v"))
    forced, before = None, None
    for _ in range(max_iter):
        e, more = confluent_kernel(e, directed, how)
        more = cut(more, "forced")
        forced = more if forced is None else forced.unionByName(more)
        e = cut((bypass_once if directed else contract_once)(cut(e, "kernel")), "kernel")
        now = signature(e)
        if now == before:
            return e, forced
        before = now
    raise RuntimeError(f"kernel: no fixpoint after {max_iter} turns")


def within_budget(kernel_edges: DataFrame, forced: DataFrame, budgets: DataFrame) -> DataFrame:
    """``(graph_id, left, feasible)`` for ``budgets (graph_id, k)``: what a bounded search may still take out.

    Not feasible is a graph whose rules force more than ``k`` vertices, or exactly ``k``
    while its kernel still has an edge.
    """
    n = forced.groupBy("graph_id").agg(F.count_distinct("v").alias("forced"))
    some = kernel_edges.select("graph_id").distinct().withColumn("open", F.lit(True))
    j = budgets.join(n, "graph_id", "left").join(some, "graph_id", "left")
    left = F.col("k") - F.coalesce("forced", F.lit(0))
    return j.select("graph_id", left.alias("left"), ((left > 0) | ((left == 0) & F.col("open").isNull())).alias("feasible"))


def rekernel(edges: DataFrame, committed: DataFrame, directed: bool, how: str = "auto") -> tuple[DataFrame, DataFrame]:
    """Take ``committed`` out and reduce what is left; forced vertices keep their ids and include ``committed``."""
    e, forced = kernel(without_vertices(canonical(edges, directed, loops=True), committed), directed, how)
    return e, forced.unionByName(committed.select(*KEYS, "v")).distinct()
