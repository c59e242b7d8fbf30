"""Plain edge-table operators: canonical form, subgraphs, degrees, relabelling.

Functions take ``edges`` with ``src, dst`` and group by ``keys`` (the graph's id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("graph_id",)


def canonical(edges: DataFrame, directed: bool = False, keys=KEYS, loops: bool = False) -> DataFrame:
    """Distinct edges; undirected ones run from the smaller to the larger end; loops go unless asked for."""
    e = edges if loops else edges.where("src <> dst")
    if directed:
        return e.select(*keys, "src", "dst").distinct()
    return e.select(*keys, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def both_ways(undirected: DataFrame, keys=KEYS) -> DataFrame:
    """Each edge once in either direction; a loop once."""
    back = undirected.where("src <> dst").select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))
    return undirected.select(*keys, "src", "dst").unionByName(back)


def in_range(edges: DataFrame, n) -> DataFrame:
    """Edges whose ends are vertex numbers below ``n`` (a number or a column)."""
    top = n if not isinstance(n, int) else F.lit(n)
    return edges.where((F.col("src") >= 0) & (F.col("dst") >= 0) & (F.col("src") < top) & (F.col("dst") < top))


def self_loops(edges: DataFrame, keys=KEYS) -> DataFrame:
    return edges.where("src = dst").select(*keys, F.col("src").alias("v")).distinct()


def vertices(edges: DataFrame, keys=KEYS) -> DataFrame:
    ends = edges.select(*keys, F.explode(F.array("src", "dst")).alias("v"))
    return ends.distinct()


def induced(edges: DataFrame, kept: DataFrame, keys=KEYS) -> DataFrame:
    """Edges with both ends among ``kept`` (``keys, v``)."""
    a = kept.select(*keys, F.col("v").alias("src"))
    b = kept.select(*keys, F.col("v").alias("dst"))
    return edges.join(a, [*keys, "src"], "left_semi").join(b, [*keys, "dst"], "left_semi").select(*edges.columns)


def without_vertices(edges: DataFrame, removed: DataFrame, keys=KEYS) -> DataFrame:
    """Edges with no end among ``removed`` (``keys, v``)."""
    a = removed.select(*keys, F.col("v").alias("src"))
    b = removed.select(*keys, F.col("v").alias("dst"))
    return edges.join(a, [*keys, "src"], "left_anti").join(b, [*keys, "dst"], "left_anti").select(*edges.columns)


def add_edges(edges: DataFrame, more: DataFrame, keys=KEYS) -> DataFrame:
    return edges.select(*keys, "src", "dst").unionByName(more.select(*keys, "src", "dst")).distinct()


def remove_edges(edges: DataFrame, fewer: DataFrame, keys=KEYS) -> DataFrame:
    return edges.join(fewer.select(*keys, "src", "dst"), [*keys, "src", "dst"], "left_anti")


def degrees(undirected: DataFrame, keys=KEYS, of: DataFrame | None = None) -> DataFrame:
    """``(keys, v, degree)``; a loop counts once; vertices of ``of`` without edges have 0."""
    d = both_ways(undirected, keys).groupBy(*keys, F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("degree"))
    if of is None:
        return d
    return of.join(d, [*keys, "v"], "left").select(*keys, "v", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def in_out_degrees(directed: DataFrame, keys=KEYS, of: DataFrame | None = None) -> DataFrame:
    """``(keys, v, in_degree, out_degree)`` from one pass over the edges."""
    ends = directed.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("src").alias("v"), F.lit(0).alias("i"), F.lit(1).alias("o")),
                F.struct(F.col("dst").alias("v"), F.lit(1).alias("i"), F.lit(0).alias("o")),
            )
        ).alias("x"),
    )
    d = ends.groupBy(*keys, F.col("x.v").alias("v")).agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))
    if of is None:
        return d
    zero = F.lit(0).cast("long")
    return of.join(d, [*keys, "v"], "left").select(*keys, "v", F.coalesce("in_degree", zero).alias("in_degree"), F.coalesce("out_degree", zero).alias("out_degree"))


def residual_max_degree(undirected: DataFrame, removed: DataFrame, keys=KEYS) -> DataFrame:
    """Largest degree after a removal; a loop counts twice."""
    rest = without_vertices(undirected, removed, keys)
    ends = rest.select(*keys, F.explode(F.array("src", "dst")).alias("v"))
    return ends.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("d")).groupBy(*keys).agg(F.max("d").alias("max_degree"))


def dense_labels(vs: DataFrame, keys=KEYS, as_text: bool = False) -> DataFrame:
    """``(keys, v, new_v)``: numbers from 0 in order of the ids, or of the ids as text ('10' before '2')."""
    order = F.col("v").cast("string") if as_text else F.col("v")
    return vs.select(*keys, "v", (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("long").alias("new_v"))


def relabel(edges: DataFrame, labels: DataFrame, keys=KEYS) -> DataFrame:
    """Edges in new numbers; ``labels`` is ``(keys, v, new_v)``."""
    a = labels.select(*keys, F.col("v").alias("src"), F.col("new_v").alias("a"))
    b = labels.select(*keys, F.col("v").alias("dst"), F.col("new_v").alias("b"))
    return edges.join(a, [*keys, "src"]).join(b, [*keys, "dst"]).select(*keys, F.col("a").alias("src"), F.col("b").alias("dst"))


def lift(vs: DataFrame, labels: DataFrame, keys=KEYS) -> DataFrame:
    """Vertices back in their old numbers."""
    old = labels.select(*keys, F.col("new_v").alias("v"), F.col("v").alias("old"))
    return vs.join(old, [*keys, "v"]).select(*keys, F.col("old").alias("v"))
