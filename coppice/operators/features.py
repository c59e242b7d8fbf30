"""Vertex features in three generations, as one column per channel.

Denominators are guarded as ``max(n - 1, 1)``; ``of`` lists all vertices, so isolated
ones get zero rows; ``n`` is the number of vertices of a graph.  What the second and third
generation are made of has two ways with equal results: graphs of up to ``SMALL_VERTICES``
vertices are read once each, in workers; larger ones go through joins and aggregates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.functions import adjacency as L
from coppice.functions import graphs as G
from coppice.operators.edges import canonical, degrees, in_out_degrees
from coppice.operators.structure import (
    clustering,
    connected,
    core_numbers,
    dense_walks,
    four_cliques,
    four_cycles,
    graph_rows,
    is_small,
    per_graph,
    return_probabilities,
    strong_components,
    triangles,
)
from coppice.plans.fixpoint import cut

EPS = 1e-8
#: Vertices of a graph whose features one worker makes in one pass.
SMALL_VERTICES = 300


def _with_n(of: DataFrame) -> DataFrame:
    return of.select("graph_id", "v").distinct().withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("graph_id")))


def _joined(base: DataFrame, parts: list[DataFrame]) -> DataFrame:
    out = reduce(lambda a, b: a.join(b, ["graph_id", "v"], "left"), parts, base)
    return out.select("graph_id", "v", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in out.columns if c not in ("graph_id", "v")))


def _once(edges: DataFrame, of: DataFrame, directed: bool) -> tuple[DataFrame, DataFrame]:
    """Both tables written once, since many parts read them."""
    return cut(canonical(edges, directed), "edges"), cut(of.select("graph_id", "v").distinct(), "vertices")


def _rest(n: str) -> Column:
    return F.greatest(F.col(n) - 1, F.lit(1)).cast("double")


def _log_norm(c: str) -> Column:
    """``log(c + 1) / log(n + 1)``, 0 for a single vertex."""
    return F.when(F.col("n") <= 1, F.lit(0.0)).otherwise(F.log1p(F.col(c)) / F.log1p(F.col("n")))


def _max_norm(c: str) -> Column:
    top = F.max(c).over(Window.partitionBy("graph_id"))
    return F.when(top > 0, F.col(c) / top).otherwise(0.0)


def _walks(edges: DataFrame, of: DataFrame, directed: bool, steps: tuple[int, ...]) -> DataFrame:
    p = return_probabilities(edges, of, directed, steps)
    return p.groupBy("graph_id", "v").pivot("step", list(steps)).agg(F.first("p")).select("graph_id", "v", *(F.col(str(k)).alias(f"rwse_{k}") for k in steps))


def undirected_v1(edges: DataFrame, of: DataFrame) -> DataFrame:
    """``degree_ratio, clustering, degree_log``."""
    e = canonical(edges)
    j = _joined(_with_n(of), [degrees(e), clustering(e)])
    return j.select("graph_id", "v", (F.col("degree") / _rest("n")).alias("degree_ratio"), F.col("clustering").cast("double").alias("clustering"), _log_norm("degree").alias("degree_log"))


def directed_v1(edges: DataFrame, of: DataFrame) -> DataFrame:
    """``in_ratio, out_ratio, least_ratio``; loops count."""
    j = _joined(_with_n(of), [in_out_degrees(canonical(edges, True, loops=True))])
    return j.select(
        "graph_id",
        "v",
        (F.col("in_degree") / _rest("n")).alias("in_ratio"),
        (F.col("out_degree") / _rest("n")).alias("out_ratio"),
        (F.least("in_degree", "out_degree") / _rest("n")).alias("least_ratio"),
    )


_RAW = ("n", "in_degree", "out_degree", "degree", "triangles", "cycles", "cliques", "core", "component_size")


def _motif_counts(g: G.Graph) -> tuple[list[int], list[int], list[int]]:
    """Triangles, cycles of four without a chord, and complete fours at each vertex of an undirected graph."""
    near = [x & ~(1 << v) for v, x in enumerate(g.out)]
    three, cycles, four = [0] * g.n, [0] * g.n, [0] * g.n
    for v in range(g.n):
        above = -1 << v + 1
        for w in G.bits(near[v]):
            three[v] += (near[v] & near[w]).bit_count()
        three[v] //= 2
        for w in G.bits(~near[v] & above & g.all):
            common = near[v] & near[w]
            n = sum((common & ~near[p] & ~(1 << p)).bit_count() for p in G.bits(common)) // 2
            cycles[v] += n
            cycles[w] += n
        for w in G.bits(near[v] & above):
            common = near[v] & near[w] & (-1 << w + 1)
            for x in G.bits(common):
                last = common & near[x] & (-1 << x + 1)
                for y in (v, w, x):
                    four[y] += last.bit_count()
                for y in G.bits(last):
                    four[y] += 1
    return three, cycles, four


def _raw_in_workers(edges: DataFrame, of: DataFrame, directed: bool, steps: tuple[int, ...], motifs: bool) -> DataFrame:
    # a vertex without edges travels as an edge that leads nowhere
    rows = graph_rows(edges.select("graph_id", "src", "dst").unionByName(of.select("graph_id", F.col("v").alias("src"), F.lit(None).cast("long").alias("dst"))))

    def work(g: int, pairs: list[tuple[int, int | None]]) -> list[tuple]:
        ids = sorted({a for a, b in pairs if b is None})
        at = {v: i for i, v in enumerate(ids)}
        es = [(at[a], at[b]) for a, b in pairs if b is not None and a != b and a in at and b in at]
        both = G.Graph(len(ids), es, False)
        arcs = G.Graph(len(ids), es, directed)
        # every vertex has a loop, so that the lists hold them all under the same numbers
        plain = [(v, v) for v in range(len(ids))]
        flat = L.Lists(es + plain, False)
        lists = L.Lists(es + plain, True) if directed else flat
        label = L.strong_components(lists) if directed else L.plain_components(flat)
        size = [0] * len(ids)
        for c in label:
            size[c] += 1
        core = L.core_numbers(flat)
        three, cycles, four = _motif_counts(both) if motifs else ([x // 2 for x in _closed(both)], [0] * len(ids), [0] * len(ids))
        walk = dense_walks(lists, steps)
        return [
            (
                g, v, len(ids), arcs.into[i].bit_count(), arcs.out[i].bit_count(), both.out[i].bit_count(),
                three[i], cycles[i], four[i], core[i], size[label[i]], [walk[k][i] for k in steps],
            )
            for i, v in enumerate(ids)
        ]

    return per_graph(rows, work, "graph_id long, v long, " + ", ".join(f"{c} long" for c in _RAW) + ", walks array<double>")


def _closed(g: G.Graph) -> list[int]:
    return [sum((g.out[v] & g.out[w]).bit_count() for w in G.bits(g.out[v])) for v in range(g.n)]


def _raw(edges: DataFrame, of: DataFrame, directed: bool, steps: tuple[int, ...], motifs: bool, how: str) -> DataFrame:
    """``graph_id, v``, the counts of ``_RAW`` and ``rwse_k`` for each vertex of ``of``; loops are left out."""
    edges, of = _once(edges, of, directed)
    largest = of.groupBy("graph_id").count().agg(F.max("count")).first()[0] or 0
    if how == "worker" or (how == "auto" and largest <= SMALL_VERTICES and is_small(edges)):
        raw = _raw_in_workers(edges, of, directed, steps, motifs)
        return raw.select("graph_id", "v", *_RAW, *(F.col("walks")[i].alias(f"rwse_{k}") for i, k in enumerate(steps)))
    flat = canonical(edges)
    d = degrees(flat)
    if directed:
        d = in_out_degrees(edges).join(d, ["graph_id", "v"], "left")
        c = strong_components(edges).withColumnRenamed("scc", "component")
    else:
        d = d.withColumns({"in_degree": F.col("degree"), "out_degree": F.col("degree")})
        c = connected(edges)
    size = F.count(F.lit(1)).over(Window.partitionBy("graph_id", "component"))
    c = c.withColumn("component_size", size).select("graph_id", "v", "component_size")
    parts = [d, c, triangles(flat), core_numbers(flat), _walks(edges, of, directed, steps)] + ([four_cycles(flat), four_cliques(flat)] if motifs else [])
    j = _joined(_with_n(of), parts)
    for name in _RAW:
        if name not in j.columns:
            j = j.withColumn(name, F.lit(0))
    return j.withColumn("component_size", F.greatest("component_size", F.lit(1))).select("graph_id", "v", *_RAW, *(f"rwse_{k}" for k in steps))


def _ratio(c: str) -> Column:
    return F.col(c) / _rest("n")


def v2(edges: DataFrame, of: DataFrame, directed: bool, how: str = "auto") -> DataFrame:
    """11 channels: v1, return probabilities of steps 2 to 5, three motif counts and the core number.

    Directed degrees leave loops out; motifs and cores are those of the undirected projection.
    """
    raw = _raw(edges, of, directed, (2, 3, 4, 5), True, how)
    if directed:
        first = [_ratio("in_degree").alias("in_ratio"), _ratio("out_degree").alias("out_ratio"), (F.least("in_degree", "out_degree") / _rest("n")).alias("least_ratio")]
    else:
        pairs = F.col("degree") * (F.col("degree") - 1)
        closed = F.when(F.col("degree") >= 2, 2.0 * F.col("triangles") / pairs).otherwise(0.0)
        first = [_ratio("degree").alias("degree_ratio"), closed.alias("clustering"), _log_norm("degree").alias("degree_log")]
    return raw.select(
        "graph_id",
        "v",
        *first,
        *(f"rwse_{k}" for k in (2, 3, 4, 5)),
        _log_norm("triangles").alias("triangles_log"),
        _log_norm("cycles").alias("cycles_log"),
        _log_norm("cliques").alias("cliques_log"),
        _max_norm("core").alias("core_ratio"),
    )


V3_STEPS = (2, 3, 4, 6, 8, 12, 16)


def v3(edges: DataFrame, of: DataFrame, directed: bool, how: str = "auto") -> DataFrame:
    """16 channels: three degree ratios, in-out balance, seven return probabilities, component size and
    whether it holds a cycle by more than one vertex, cycle score, triangles and core number, each by its maximum."""
    j = _raw(edges, of, directed, V3_STEPS, False, how)
    j = j.withColumn("score", F.col("in_degree") * F.col("out_degree") / (F.col("n") * F.col("component_size")))
    ratio = F.col("in_degree") / (F.col("in_degree") + F.col("out_degree") + EPS) if directed else F.lit(0.5)
    return j.select(
        "graph_id",
        "v",
        _ratio("in_degree").alias("in_ratio"),
        _ratio("out_degree").alias("out_ratio"),
        (F.least("in_degree", "out_degree") / _rest("n")).alias("least_ratio"),
        ratio.alias("balance"),
        *(f"rwse_{k}" for k in V3_STEPS),
        (F.log1p("component_size") / F.greatest(F.lit(1.0), F.log1p("n"))).alias("component_log"),
        (F.col("component_size") > 1).cast("double").alias("nontrivial"),
        _max_norm("score").alias("cycle_score"),
        _max_norm("triangles").alias("triangle_ratio"),
        _max_norm("core").alias("core_ratio"),
    )
