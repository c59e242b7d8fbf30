"""Cycles, components, cores, motifs and walks.

Operators that are joins and aggregates run as such on graphs of any size.  Those that
need a walk have two ways with equal results: tables of small graphs are searched in
workers, one row per graph; a graph of more than ``WORKER_EDGES`` edges is worked on by
fixpoint loops over DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coppice.functions import adjacency as L
from coppice.functions import graphs as G
from coppice.operators.components import component_labels
from coppice.operators.edges import KEYS, both_ways, canonical, in_out_degrees, induced, vertices, without_vertices
from coppice.plans.fixpoint import cut, cut_of, drop_cut, fixpoint

#: A graph with more edges than this is not handed to one worker.
WORKER_EDGES = 200_000
#: Bytes that the arrays of large graphs may take in a worker that is asked for by name.
HELD_BYTES = 512 << 20
#: Rows of a worker's answer that are sent at once.
OUT_ROWS = 1 << 16
#: Vertices of a graph whose walks a worker takes as a dense matrix.
DENSE_VERTICES = 1_000
#: Start vertices of a large graph whose walks are followed at once.
WALK_STARTS = 2_000


def graph_rows(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``(graph_id, edges)``: one row per graph; with ``ids`` also for graphs without edges."""
    rows = edges.groupBy("graph_id").agg(F.collect_list(F.struct("src", "dst")).alias("edges"))
    if ids is None:
        return rows
    empty = F.array().cast("array<struct<src:bigint,dst:bigint>>")
    return ids.select("graph_id").distinct().join(rows, "graph_id", "left").select("graph_id", F.coalesce("edges", empty).alias("edges"))


def per_graph(rows: DataFrame, work: Callable[[int, list[tuple[int, int]]], list[tuple]], schema: str) -> DataFrame:
    """Apply ``work(graph_id, edges)`` to each row of ``graph_rows``; it returns result rows."""
    names = [x.strip().split()[0] for x in schema.split(",")]
    target = rows.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(target)
        for b in batches:
            out: list[tuple] = []
            for g, edges in zip(b.column("graph_id").to_pylist(), b.column("edges").to_pylist()):
                out += work(g, [(e["src"], e["dst"]) for e in edges])
            columns = zip(*out) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, kinds)], schema=kinds)

    return rows.mapInArrow(run, schema)


def numbered(edges: list[tuple[int, int]], directed: bool) -> tuple[G.Graph, list[int]]:
    """A worker graph over dense numbers, and the ids in their order."""
    ids = sorted({v for e in edges for v in e})
    at = {v: i for i, v in enumerate(ids)}
    return G.Graph(len(ids), ((at[a], at[b]) for a, b in edges), directed), ids


def is_small(edges: DataFrame, most: int = WORKER_EDGES) -> bool:
    """Whether no graph of the table has more than ``most`` edges."""
    largest = edges.groupBy("graph_id").count().agg(F.max("count")).first()[0]
    return (largest or 0) <= most


# ---------------------------------------------------------------- components


def _component_rows(g: int, edges: list[tuple[int, int]]) -> list[tuple]:
    graph = L.Lists(edges, True)
    return [(g, graph.ids[v], graph.ids[c]) for v, c in enumerate(L.plain_components(graph))]


def connected(edges: DataFrame, of: DataFrame | None = None, keys=KEYS, how: str = "auto") -> DataFrame:
    """``(keys, v, component)``: smallest vertex reachable; vertices of ``of`` without edges are their own."""
    if tuple(keys) == KEYS and (how == "worker" or (how == "auto" and is_small(edges))):
        labels = per_graph(graph_rows(edges.select(*KEYS, "src", "dst").distinct()), _component_rows, "graph_id long, v long, component long")
    else:
        labels = component_labels(edges, keys=tuple(keys))
    if of is None:
        of = vertices(edges, keys)
    return of.join(labels, [*keys, "v"], "left").select(*keys, "v", F.coalesce("component", "v").alias("component"))


def largest_component(edges: DataFrame, keys=KEYS) -> DataFrame:
    """``(keys, v)`` of the largest component, ties to the smaller label."""
    labels = cut(connected(edges, keys=keys), "labels")
    sizes = labels.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("component")).alias("c"))).alias("top"))
    top = top.select(*keys, (-F.col("top.c")).alias("component"))
    return labels.join(top, [*keys, "component"], "left_semi").select(*keys, "v")


def _scc_rows(g: int, edges: list[tuple[int, int]]) -> list[tuple]:
    graph = L.Lists(edges, True)
    return [(g, graph.ids[v], graph.ids[c]) for v, c in enumerate(L.strong_components(graph))]


def strong_components(edges: DataFrame, how: str = "auto") -> DataFrame:
    """``(graph_id, v, scc)``: smallest vertex that can be reached and reaches back."""
    edges = canonical(edges, directed=True, loops=True)
    if how == "worker" or (how == "auto" and is_small(edges)):
        return per_graph(graph_rows(edges), _scc_rows, "graph_id long, v long, scc long")
    return _strong_by_colour(edges)


def _spread(edges: DataFrame, start: DataFrame, label: str) -> DataFrame:
    """Smallest label that reaches each vertex along the edges, to a fixpoint."""

    def step(s: DataFrame) -> DataFrame:
        sent = edges.join(s.withColumnRenamed("v", "src"), ["graph_id", "src"]).select("graph_id", F.col("dst").alias("v"), label)
        return s.unionByName(sent).groupBy("graph_id", "v").agg(F.min(label).alias(label))

    return fixpoint(start, step, name="spread")


def _strong_by_colour(edges: DataFrame) -> DataFrame:
    """Forward colours, then backward reach within each colour; what is settled leaves, and so on."""
    left = cut(edges.where("src <> dst"), "left")
    alone = vertices(edges)
    done = []
    while not left.isEmpty():
        vs = vertices(left)
        colour = _spread(left, vs.withColumn("scc", F.col("v")), "scc")
        a = colour.select("graph_id", F.col("v").alias("src"), F.col("scc").alias("ca"))
        b = colour.select("graph_id", F.col("v").alias("dst"), F.col("scc").alias("cb"))
        inner = left.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"]).where("ca = cb")
        back = cut(inner.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst")), "back")
        roots = colour.where("v = scc")
        found = cut(_spread(back, roots, "scc"), "found")
        done.append(found)
        left, old = cut(without_vertices(left, found), "left"), left
        drop_cut(old)
    labels = done[0] if done else alone.withColumn("scc", F.col("v")).limit(0)
    for more in done[1:]:
        labels = labels.unionByName(more)
    return alone.join(labels, ["graph_id", "v"], "left").select("graph_id", "v", F.coalesce("scc", "v").alias("scc"))


def nontrivial_scc(edges: DataFrame, how: str = "auto", loops: bool = True) -> DataFrame:
    """Vertices of components of more than one vertex, and with ``loops`` those that have one."""
    s = strong_components(edges, how)
    size = F.count(F.lit(1)).over(Window.partitionBy("graph_id", "scc"))
    big = s.withColumn("n", size).where("n > 1").select("graph_id", "v")
    if not loops:
        return big
    return big.unionByName(edges.where("src = dst").select("graph_id", F.col("src").alias("v"))).distinct()


# ---------------------------------------------------------------- cycles


def peel(edges: DataFrame, directed: bool, sinks: bool = False, how: str = "auto") -> DataFrame:
    """Edges left when vertices that lie on no cycle are peeled off: sources (and sinks), or leaves."""
    e = canonical(edges, directed, loops=True)
    if how == "worker" or (how == "auto" and is_small(e)):

        def work(g: int, es: list[tuple[int, int]]) -> list[tuple]:
            graph = L.Lists(es, directed)
            left = L.peeled(graph, sinks)
            inside = {graph.ids[v] for v in range(graph.n) if left[v]}
            return [(g, a, b) for a, b in es if a in inside and b in inside]

        return per_graph(graph_rows(e), work, "graph_id long, src long, dst long")

    def step(s: DataFrame) -> DataFrame:
        if directed:
            d = in_out_degrees(s)
            return induced(s, d.where("in_degree > 0 and out_degree > 0" if sinks else "in_degree > 0"))
        ends = s.select("graph_id", F.explode(F.array("src", "dst")).alias("v"))
        return induced(s, ends.groupBy("graph_id", "v").agg(F.count(F.lit(1)).alias("d")).where("d > 1"))

    return fixpoint(e, step, name="peel")


def has_cycle(edges: DataFrame, ids: DataFrame, directed: bool, how: str = "auto") -> DataFrame:
    """``(graph_id, has_cycle)`` for every graph of ``ids``; a loop is a cycle."""
    cyclic = peel(edges, directed, how=how).select("graph_id").distinct().withColumn("c", F.lit(True))
    return ids.select("graph_id").distinct().join(cyclic, "graph_id", "left").select("graph_id", F.coalesce("c", F.lit(False)).alias("has_cycle"))


def is_solution(edges: DataFrame, removed: DataFrame, ids: DataFrame, directed: bool, how: str = "auto") -> DataFrame:
    """``(graph_id, valid)``: whether no cycle is left once ``removed`` is."""
    left = has_cycle(without_vertices(edges, removed), ids, directed, how)
    return left.select("graph_id", (~F.col("has_cycle")).alias("valid"))


def verify_answers(edges: DataFrame, answers: DataFrame, of: DataFrame, directed: bool, how: str = "auto") -> DataFrame:
    """``(graph_id, unique, in_range, valid)`` for answers ``(graph_id, v)`` to the graphs with the vertices ``of``.

    An answer must name no vertex twice and none that the graph does not have, and
    without it no cycle may be left; ``valid`` is all three.
    """
    ids = of.select("graph_id").distinct()
    known = answers.join(of.select("graph_id", "v").distinct().withColumn("known", F.lit(True)), ["graph_id", "v"], "left")
    told = known.groupBy("graph_id").agg((F.count(F.lit(1)) == F.count_distinct("v")).alias("unique"), F.bool_and(F.coalesce("known", F.lit(False))).alias("in_range"))
    acyclic = is_solution(edges, answers.select("graph_id", "v").distinct(), ids, directed, how).withColumnRenamed("valid", "acyclic")
    j = acyclic.join(told, "graph_id", "left").select("graph_id", *(F.coalesce(c, F.lit(True)).alias(c) for c in ("unique", "in_range")), "acyclic")
    return j.select("graph_id", "unique", "in_range", (F.col("unique") & F.col("in_range") & F.col("acyclic")).alias("valid"))


def _walked_cycle(e: DataFrame, directed: bool) -> DataFrame:
    """``(graph_id, cycle, length)`` by pointer doubling, for graphs of any size without loops.

    In what peeling leaves every vertex can be walked on from: against the edges, or, if
    undirected, along them without turning back.  One step is a pointer from arc to arc.
    Doubled often enough, pointers only lead to arcs that the walk comes back to; from the
    smallest of these the walk is taken in doubling strides until it closes, and cut where
    a vertex comes again soonest.
    """
    left = cut(peel(e, directed, how="frames"), "left")
    if directed:
        # an arc is named by its end, since of each vertex only one predecessor is taken
        step = left.groupBy("graph_id", F.col("dst").alias("v")).agg(F.min("src").alias("w"))
        arc = step.select("graph_id", F.struct(F.col("v").alias("x"), F.lit(0).cast("long").alias("y")).alias("a"), F.struct(F.col("w").alias("x"), F.lit(0).cast("long").alias("y")).alias("b"))
    else:
        both = both_ways(left).select("graph_id", F.col("src").alias("x"), F.col("dst").alias("y"))
        two = Window.partitionBy("graph_id", "x").orderBy("y")
        first = both.withColumn("place", F.row_number().over(two)).where("place <= 2").groupBy("graph_id", F.col("x").alias("y")).agg(F.min("y").alias("one"), F.max("y").alias("other"))
        onward = both.join(first, ["graph_id", "y"]).withColumn("z", F.when(F.col("one") == F.col("x"), F.col("other")).otherwise(F.col("one")))
        arc = onward.select("graph_id", F.struct("x", "y").alias("a"), F.struct(F.col("y").alias("x"), F.col("z").alias("y")).alias("b"))
    jump = [cut(arc, "step")]
    most = jump[0].groupBy("graph_id").count().agg(F.max("count")).first()[0] or 0
    while 1 << len(jump) - 1 < most:
        far = jump[-1].select("graph_id", F.col("a").alias("b"), F.col("b").alias("c"))
        jump.append(cut(jump[-1].join(far, ["graph_id", "b"]).select("graph_id", "a", F.col("c").alias("b")), "jump"))
    walk = jump[-1].groupBy("graph_id").agg(F.min("b").alias("a")).withColumn("d", F.lit(0).cast("long"))
    for k, stride in enumerate(jump):
        more = walk.join(stride, ["graph_id", "a"]).select("graph_id", F.col("b").alias("a"), (F.col("d") + (1 << k)).alias("d"))
        walk = cut(walk.unionByName(more).groupBy("graph_id", "a").agg(F.min("d").alias("d")), "walk")
    # once round, and the first arc again at its end
    n = walk.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    again = walk.where("d = 0").join(n, "graph_id").select("graph_id", "a", F.col("n").alias("d"))
    seen = walk.unionByName(again).select("graph_id", F.col("a.x").alias("v"), "d")
    since = F.lag("d").over(Window.partitionBy("graph_id", "v").orderBy("d"))
    gap = seen.withColumn("start", since).where("start is not null").groupBy("graph_id").agg(F.min(F.struct((F.col("d") - F.col("start")).alias("length"), "start")).alias("g"))
    inside = seen.join(gap, "graph_id").where("d >= g.start and d < g.start + g.length")
    order = F.array_sort(F.collect_list(F.struct((-F.col("d") if directed else F.col("d")).alias("d"), "v")))
    found = inside.groupBy("graph_id").agg(order.alias("c"))
    return found.select("graph_id", F.transform("c", lambda x: x["v"]).alias("cycle"), F.size("c").cast("long").alias("length"))


def find_cycle(edges: DataFrame, directed: bool, shortest: bool = False, how: str = "auto") -> DataFrame:
    """``(graph_id, cycle, length)`` for each graph that has one.

    A shortest one is looked for in workers, from every vertex in turn.  Some cycle of a
    graph that does not fit a worker is found over tables, in turns by the logarithm of its size.
    """
    e = canonical(edges, directed, loops=True)
    if not shortest and not (how == "worker" or (how == "auto" and is_small(e))):
        e = cut(e, "edges")
        loop = e.where("src = dst").groupBy("graph_id").agg(F.min("src").alias("v")).select("graph_id", F.array("v").alias("cycle"), F.lit(1).cast("long").alias("length"))
        plain = cut(e.join(loop, "graph_id", "left_anti"), "plain")
        return loop.unionByName(_walked_cycle(plain, directed))

    def work(g: int, es: list[tuple[int, int]]) -> list[tuple]:
        if shortest:
            graph, ids = numbered(es, directed)
            found = G.shortest_cycle(graph, graph.all)
        else:
            lists = L.Lists(es, directed)
            found, ids = L.any_cycle(lists), lists.ids
        return [(g, [ids[v] for v in found], len(found))] if found else []

    return per_graph(graph_rows(e), work, "graph_id long, cycle array<long>, length long")


def _girth_from(starts: DataFrame, arcs: DataFrame, best: DataFrame, directed: bool) -> DataFrame:
    """``best (graph_id, girth)`` improved by layers around some start vertices; a graph's layers end where they cannot improve it."""
    front = cut(starts.select("graph_id", F.col("v").alias("s"), "v"), "front")
    seen, depth = front, 0
    while True:
        least = depth + 1 if directed else 2 * depth + 1
        front = front.join(best.where(F.col("girth") <= least).select("graph_id"), "graph_id", "left_anti")
        near = cut(front.join(arcs.select("graph_id", F.col("src").alias("v"), F.col("dst").alias("w")), ["graph_id", "v"]).select("graph_id", "s", F.col("w").alias("v")), "near")
        fresh = near.join(seen, ["graph_id", "s", "v"], "left_anti")
        if directed:
            found = near.where("v = s").select("graph_id", F.lit(least).cast("long").alias("girth"))
        else:
            # an edge within the layer, or a vertex of the next one that two of this one lead to
            level = near.join(front, ["graph_id", "s", "v"], "left_semi").select("graph_id", F.lit(least).cast("long").alias("girth"))
            twice = fresh.groupBy("graph_id", "s", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            found = level.unionByName(twice.select("graph_id", F.lit(least + 1).cast("long").alias("girth")))
        best = cut(best.unionByName(found).groupBy("graph_id").agg(F.min("girth").alias("girth")), "best")
        front = cut(fresh.distinct(), "front")
        if front.isEmpty():
            return best
        seen = cut(seen.unionByName(front), "seen")
        depth += 1


def girth(edges: DataFrame, directed: bool, how: str = "auto") -> DataFrame:
    """``(graph_id, girth)``: length of a shortest cycle of each graph that has one.

    Graphs that fit a worker are searched there.  On larger ones ``WALK_STARTS`` vertices
    of what peeling leaves are the middle of layers at a time; the shortest cycle so far
    bounds all that follow.
    """
    e = canonical(edges, directed, loops=True)
    if how == "worker" or (how == "auto" and is_small(e)):
        return find_cycle(edges, directed, shortest=True, how="worker").select("graph_id", F.col("length").alias("girth"))
    e = cut(e, "edges")
    best = cut(e.where("src = dst").select("graph_id", F.lit(1).cast("long").alias("girth")).distinct(), "best")
    left = cut(peel(e.join(best, "graph_id", "left_anti"), directed, sinks=directed, how="frames"), "left")
    arcs = left if directed else cut(both_ways(left), "arcs")
    starts = arcs.select("graph_id", F.col("src").alias("v")).distinct()
    blocks = max(1, -(-starts.count() // WALK_STARTS))
    starts = cut(starts.withColumn("block", F.pmod(F.xxhash64("graph_id", "v"), F.lit(blocks))), "starts")
    for block in range(blocks):
        mine = starts.where(F.col("block") == block)
        best = cut_of(lambda mine=mine, best=best: _girth_from(mine, arcs, best, directed), "best")
    return best


def topological_levels(edges: DataFrame, of: DataFrame, max_iter: int = 10_000, how: str = "auto") -> DataFrame:
    """``(graph_id, v, level)``: the round in which a vertex has no predecessor left; those behind a cycle do not appear.

    Graphs that fit a worker are walked there, whatever their levels; over tables, more
    than ``max_iter`` of them are an error.
    """
    if how == "worker" or (how == "auto" and is_small(edges)):

        def work(g: int, es: list[tuple[int, int]]) -> list[tuple]:
            graph = L.Lists(es, True)
            return [(g, graph.ids[v], k) for v, k in enumerate(L.levels(graph)) if k is not None]

        found = per_graph(graph_rows(canonical(edges, directed=True, loops=True)), work, "graph_id long, v long, level long")
        # vertices without an edge are free from the start
        alone = of.select("graph_id", "v").distinct().join(vertices(edges), ["graph_id", "v"], "left_anti")
        named = found.join(of.select("graph_id", "v").distinct(), ["graph_id", "v"], "left_semi")
        return named.unionByName(alone.withColumn("level", F.lit(0).cast("long")))
    left, level, done = cut(of.select("graph_id", "v").distinct(), "level"), 0, []
    e = cut(canonical(edges, directed=True, loops=True), "edges")
    while True:
        blocked = e.select("graph_id", F.col("dst").alias("v")).distinct()
        free = cut(left.join(blocked, ["graph_id", "v"], "left_anti").withColumn("level", F.lit(level).cast("long")), "free")
        if free.isEmpty():
            break
        if level >= max_iter:
            raise RuntimeError(f"topological_levels: vertices still free after {max_iter} levels")
        done.append(free)
        left = cut(left.join(free, ["graph_id", "v"], "left_anti"), "level")
        e = cut(e.join(free.select("graph_id", F.col("v").alias("src")), ["graph_id", "src"], "left_anti"), "edges")
        level += 1
    out = done[0] if done else left.withColumn("level", F.lit(0).cast("long")).limit(0)
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def random_unit(*columns, seed: int):
    """A number in [0, 1) that depends on the columns and the seed alone."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns))), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 48))


def random_topological_order(edges: DataFrame, of: DataFrame, seed: int = 42, how: str = "auto") -> DataFrame:
    """``(graph_id, v, place)``: by level, at random within a level."""
    levels = topological_levels(edges, of, how=how)
    w = Window.partitionBy("graph_id").orderBy("level", random_unit("graph_id", "v", seed=seed), "v")
    return levels.select("graph_id", "v", (F.row_number().over(w) - 1).cast("long").alias("place"))


def bfs_sample(edges: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """``(graph_id, v)``: up to ``size`` vertices by distance from a random one, at random within a layer, padded at random.

    A layer is a turn; turns end when every graph has its vertices or no more can be reached.
    """
    both = cut(both_ways(canonical(edges)), "both")
    vs = cut(vertices(both).withColumn("u", random_unit("graph_id", "v", seed=seed)), "vs")
    start = vs.groupBy("graph_id").agg(F.min(F.struct("u", "v")).alias("x")).select("graph_id", F.col("x.v").alias("v"), F.lit(0).cast("long").alias("depth"))
    seen, depth = cut(start, "seen"), 0
    while True:
        depth += 1
        short = seen.groupBy("graph_id").count().where(F.col("count") < size)
        front = seen.where(F.col("depth") == depth - 1).join(short, "graph_id", "left_semi")
        near = both.join(front.select("graph_id", F.col("v").alias("src")), ["graph_id", "src"]).select("graph_id", F.col("dst").alias("v")).distinct()
        fresh = cut(near.join(seen, ["graph_id", "v"], "left_anti").withColumn("depth", F.lit(depth).cast("long")), "fresh")
        if fresh.isEmpty():
            break
        seen, old = cut(seen.unionByName(fresh), "seen"), seen
        drop_cut(old)
    far = vs.join(seen, ["graph_id", "v"], "left")
    place = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.col("depth").asc_nulls_last(), "u", "v"))
    return far.withColumn("place", place).where(F.col("place") <= size).select("graph_id", "v")


# ---------------------------------------------------------------- cores and motifs


def _held_bytes(edges: DataFrame) -> int:
    """Bytes that ``L.Arrays`` takes, about, for the graphs of more than ``WORKER_EDGES`` edges together."""
    n = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("m"), (F.approx_count_distinct("src") + F.approx_count_distinct("dst")).alias("n"))
    return n.where(F.col("m") > WORKER_EDGES).agg(F.sum(12 * F.col("m") + 64 * F.col("n"))).first()[0] or 0


def _cores_of(parts: list[tuple[np.ndarray, np.ndarray]], large: L.Arrays | None) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and core numbers of a graph whose edges are in ``parts`` and ``large``."""
    if large is None:
        graph = L.Lists([e for src, dst in parts for e in zip(src.tolist(), dst.tolist())], False)
        return np.array(graph.ids, np.int64), np.array(L.core_numbers(graph), np.int64)
    for src, dst in parts:
        large.take(src, dst)
    large.close()
    return large.ids(), L.core_array(large).astype(np.int64)


def _core_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``core_numbers`` for edges that come graph by graph; those of a large graph are never Python objects."""
    started, now, n, parts, large, done = False, None, 0, [], None, []

    def ended() -> None:
        v, core = _cores_of(parts, large)
        graph_id = pa.nulls(len(v), pa.int64()) if now is None else pa.array(np.full(len(v), now, np.int64))
        done.append(pa.RecordBatch.from_arrays([graph_id, pa.array(v), pa.array(core)], ["graph_id", "v", "core"]))

    def sent() -> Iterator[pa.RecordBatch]:
        yield from pa.Table.from_batches(done).combine_chunks().to_batches(OUT_ROWS)
        done.clear()

    for b in batches:
        runs = pc.run_end_encode(b.column("graph_id"), run_end_type=pa.int64())
        src, dst = (b.column(c).to_numpy() for c in ("src", "dst"))
        i = 0
        for g, j in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
            if not started or g != now:
                if started:
                    ended()
                started, now, n, parts, large = True, g, 0, [], None
            parts.append((src[i:j].copy(), dst[i:j].copy()))
            n += j - i
            if n > WORKER_EDGES:
                large = large or L.Arrays()
                large.take(*(np.concatenate(x) for x in zip(*parts)))
                n, parts = 0, []
            i = j
        if done:
            yield from sent()
    if started:
        ended()
        yield from sent()


def core_numbers(edges: DataFrame, how: str = "auto") -> DataFrame:
    """``(graph_id, v, core)``; loops are dropped.

    A worker takes a graph edge by edge and holds it as arrays, up to ``HELD_BYTES``; beyond that no worker is used.
    """
    e = canonical(edges)
    if how == "worker":
        e = cut(e, "simple")
    if (how == "worker" and _held_bytes(e) <= HELD_BYTES) or (how == "auto" and is_small(e)):
        return e.repartition("graph_id").sortWithinPartitions("graph_id").mapInArrow(_core_rows, "graph_id long, v long, core long")
    # a vertex's core number is the h-index of its neighbours' (Lu et al., 2016): few turns, no peeling order
    both = cut(both_ways(e).withColumnRenamed("src", "v"), "both")
    start = both.groupBy("graph_id", "v").agg(F.count(F.lit(1)).alias("core"))

    def step(s: DataFrame) -> DataFrame:
        near = both.join(s.select("graph_id", F.col("v").alias("dst"), "core"), ["graph_id", "dst"])
        # neighbours by value: with counts per value the h-index needs no long sort
        counts = near.groupBy("graph_id", "v", "core").agg(F.count(F.lit(1)).alias("n"))
        above = F.sum("n").over(Window.partitionBy("graph_id", "v").orderBy(F.col("core").desc()).rowsBetween(Window.unboundedPreceding, 0))
        return counts.withColumn("h", F.least("core", above)).groupBy("graph_id", "v").agg(F.max("h").alias("core"))

    return fixpoint(start, step, name="cores")


def two_core(edges: DataFrame, how: str = "auto") -> DataFrame:
    """Edges of the 2-core: the confluent part of the undirected kernel."""
    return peel(edges, directed=False, how=how)


def _by_degree(undirected: DataFrame) -> DataFrame:
    """Each edge from the end of lower degree to the other, so that hubs start few paths."""
    d = both_ways(undirected).groupBy("graph_id", F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("d"))
    j = undirected.join(d.select("graph_id", F.col("v").alias("src"), F.col("d").alias("ds")), ["graph_id", "src"])
    j = j.join(d.select("graph_id", F.col("v").alias("dst"), F.col("d").alias("dd")), ["graph_id", "dst"])
    first = F.struct("ds", "src") < F.struct("dd", "dst")
    return j.select("graph_id", F.when(first, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("b"))


def _three(e: DataFrame) -> DataFrame:
    """Every triangle of edges ``(graph_id, a, b)`` as ``a, b, c`` in the order of the degrees, once."""
    wedge = e.join(e.select("graph_id", "a", F.col("b").alias("c")), ["graph_id", "a"])
    return wedge.join(e.select("graph_id", F.col("a").alias("b"), F.col("b").alias("c")), ["graph_id", "b", "c"]).select("graph_id", "a", "b", "c")


def triangles(edges: DataFrame) -> DataFrame:
    """``(graph_id, v, triangles)`` for vertices that lie on one."""
    found = _three(_by_degree(canonical(edges)))
    return found.select("graph_id", F.explode(F.array("a", "b", "c")).alias("v")).groupBy("graph_id", "v").agg(F.count(F.lit(1)).alias("triangles"))


def clustering(edges: DataFrame) -> DataFrame:
    """``(graph_id, v, clustering)``: closed share of a vertex's neighbour pairs; 0 below degree 2."""
    e = canonical(edges)
    d = both_ways(e).groupBy("graph_id", F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("d"))
    t = d.join(triangles(edges), ["graph_id", "v"], "left")
    value = F.when(F.col("d") >= 2, 2.0 * F.coalesce("triangles", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0)
    return t.select("graph_id", "v", value.alias("clustering"))


def _four(e: DataFrame, three: DataFrame) -> DataFrame:
    """Complete subgraphs of four as ``a, b, c, d`` in the order of the degrees, once."""
    t = three.join(e.select("graph_id", "a", F.col("b").alias("d")), ["graph_id", "a"])
    t = t.join(e.select("graph_id", F.col("a").alias("b"), F.col("b").alias("d")), ["graph_id", "b", "d"])
    return t.join(e.select("graph_id", F.col("a").alias("c"), F.col("b").alias("d")), ["graph_id", "c", "d"])


def _at_vertices(found: DataFrame, n) -> DataFrame:
    """Sum of ``n`` at each vertex of the rows' arrays ``at``."""
    return found.select("graph_id", F.explode("at").alias("v"), n.alias("n")).groupBy("graph_id", "v").agg(F.sum("n").alias("n"))


def four_cliques(edges: DataFrame) -> DataFrame:
    """``(graph_id, v, cliques)``: complete subgraphs of four vertices at each vertex."""
    e = cut(_by_degree(canonical(edges)), "ordered")
    k = _four(e, _three(e)).select("graph_id", F.explode(F.array("a", "b", "c", "d")).alias("v"))
    return k.groupBy("graph_id", "v").agg(F.count(F.lit(1)).alias("cliques"))


def four_cycles(edges: DataFrame) -> DataFrame:
    """``(graph_id, v, cycles)``: cycles of four vertices without a chord at each vertex.

    Cycles are counted, not listed: all of them from the paths below their end of highest
    degree; those with one chord from the triangles on each edge; with ``q`` cycles,
    ``d`` pairs of triangles on one edge and ``k`` complete fours at a vertex, ``q - d + 3 k``
    are without a chord.
    """
    undirected = canonical(edges)
    e = cut(_by_degree(undirected), "ordered")
    d = both_ways(undirected).groupBy("graph_id", F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("d"))
    rank = cut(both_ways(undirected).join(d.withColumnRenamed("v", "src"), ["graph_id", "src"]), "ranked")
    # paths top - middle - other in which the top has the highest degree: a hub is the top of few and the middle of none
    up = e.select("graph_id", F.col("a").alias("m"), F.col("b").alias("top"))
    up = up.join(d.select("graph_id", F.col("v").alias("top"), F.col("d").alias("td")), ["graph_id", "top"])
    other = rank.select("graph_id", F.col("dst").alias("m"), F.col("src").alias("x"), F.col("d").alias("xd"))
    paths = cut(up.join(other, ["graph_id", "m"]).where(F.struct("xd", "x") < F.struct("td", "top")).select("graph_id", "top", "m", "x"), "paths")
    ends = cut(paths.groupBy("graph_id", "top", "x").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "ends")
    at_ends = _at_vertices(ends.withColumn("at", F.array("top", "x")), (F.col("c") * (F.col("c") - 1) / 2).cast("long"))
    at_middles = paths.join(ends, ["graph_id", "top", "x"]).groupBy("graph_id", F.col("m").alias("v")).agg(F.sum(F.col("c") - 1).alias("n"))
    three = cut(_three(e), "three")
    sides = F.array(*(F.struct(F.col(x).alias("p"), F.col(y).alias("q"), F.col(z).alias("w")) for x, y, z in (("a", "b", "c"), ("a", "c", "b"), ("b", "c", "a"))))
    sides = cut(three.select("graph_id", F.inline(sides)), "sides")
    on = cut(sides.groupBy("graph_id", "p", "q").agg(F.count(F.lit(1)).alias("t")).where("t > 1"), "on")
    chords = _at_vertices(on.withColumn("at", F.array("p", "q")), (F.col("t") * (F.col("t") - 1) / 2).cast("long"))
    wings = sides.join(on, ["graph_id", "p", "q"]).groupBy("graph_id", F.col("w").alias("v")).agg(F.sum(F.col("t") - 1).alias("n"))
    fours = _at_vertices(_four(e, three).withColumn("at", F.array("a", "b", "c", "d")), F.lit(3).cast("long"))
    minus = chords.unionByName(wings).select("graph_id", "v", (-F.col("n")).alias("n"))
    every = at_ends.unionByName(at_middles).unionByName(fours).unionByName(minus)
    return every.groupBy("graph_id", "v").agg(F.sum("n").alias("cycles")).where("cycles > 0")


# ---------------------------------------------------------------- walks


def transition(edges: DataFrame, directed: bool) -> DataFrame:
    """``(graph_id, i, j, p)``: one step of a random walk."""
    e = canonical(edges, directed) if directed else both_ways(canonical(edges))
    n = F.count(F.lit(1)).over(Window.partitionBy("graph_id", "src"))
    return e.select("graph_id", F.col("src").alias("i"), F.col("dst").alias("j"), (F.lit(1.0) / n).alias("p"))


def _stepped(rows: DataFrame, steps: DataFrame) -> DataFrame:
    """One more step of the walks in ``rows (graph_id, i, j, p)``."""
    j = rows.join(steps.select("graph_id", F.col("i").alias("j"), F.col("j").alias("k"), F.col("p").alias("q")), ["graph_id", "j"])
    return j.groupBy("graph_id", "i", F.col("k").alias("j")).agg(F.sum(F.col("p") * F.col("q")).alias("p"))


def _walks_from(starts: DataFrame, steps: DataFrame, back: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """``(graph_id, v, step, p)`` for some start vertices: rows of one half of the way out, columns of the other half back."""
    one = starts.select("graph_id", F.col("v").alias("i"), F.col("v").alias("j"), F.lit(1.0).alias("p"))
    most = max(lengths)
    out, home = {0: one}, {0: one}
    for k in range(1, most - most // 2 + 1):
        out[k] = cut(_stepped(out[k - 1], steps), "out")
        if k <= most // 2:
            home[k] = cut(_stepped(home[k - 1], back), "home")
    found = None
    for k in lengths:
        there = home[k // 2].select("graph_id", "i", "j", F.col("p").alias("q"))
        d = out[k - k // 2].join(there, ["graph_id", "i", "j"]).groupBy("graph_id", F.col("i").alias("v")).agg(F.sum(F.col("p") * F.col("q")).alias("p"))
        d = d.withColumn("step", F.lit(k).cast("long"))
        found = d if found is None else found.unionByName(d)
    return found


def dense_walks(graph: L.Lists, lengths: tuple[int, ...]) -> dict[int, list[float]]:
    """Return probabilities of each vertex of a small graph, by length, from powers of its dense matrix."""
    import numpy as np

    p = np.zeros((graph.n, graph.n))
    for v, near in enumerate(graph.out):
        if near:
            p[v, near] = 1.0 / len(near)
    power, at, out = p, 1, {}
    for k in range(1, max(lengths) + 1):
        while at < k:
            power, at = power @ p, at + 1
        if k in lengths:
            out[k] = power.diagonal().tolist()
    return out


def return_probabilities(edges: DataFrame, of: DataFrame, directed: bool, steps: tuple[int, ...] = (2, 3, 4, 5), how: str = "auto") -> DataFrame:
    """``(graph_id, v, step, p)``: chance that a random walk from v is back after ``step`` steps; 0 where it cannot be.

    Small graphs are dense matrices in workers.  On larger ones ``WALK_STARTS`` vertices
    are followed at a time, halfway out and halfway back, so what is held grows with the
    vertices and never with their square.
    """
    e = canonical(edges, directed) if directed else both_ways(canonical(edges))
    every = of.select("graph_id", "v").distinct().withColumn("step", F.explode(F.array(*(F.lit(k).cast("long") for k in steps))))
    if how == "worker" or (how == "auto" and is_small(e, DENSE_VERTICES)):

        def work(g: int, es: list[tuple[int, int]]) -> list[tuple]:
            graph = L.Lists(es, True)
            found = dense_walks(graph, steps)
            return [(g, graph.ids[v], k, p) for k, ps in found.items() for v, p in enumerate(ps)]

        out = per_graph(graph_rows(e), work, "graph_id long, v long, step long, p double")
    else:
        step = cut(transition(edges, directed), "walk")
        back = cut(step.select("graph_id", F.col("j").alias("i"), F.col("i").alias("j"), "p"), "back")
        starts = step.select("graph_id", F.col("i").alias("v")).distinct()
        blocks = max(1, -(-starts.count() // WALK_STARTS))
        starts = cut(starts.withColumn("block", F.pmod(F.xxhash64("graph_id", "v"), F.lit(blocks))), "starts")
        out = None
        for block in range(blocks):
            mine = starts.where(F.col("block") == block)
            part = cut_of(lambda mine=mine: _walks_from(mine, step, back, tuple(steps)), "block")
            out = part if out is None else out.unionByName(part)
    return every.join(out, ["graph_id", "v", "step"], "left").select("graph_id", "v", "step", F.coalesce("p", F.lit(0.0)).alias("p"))
