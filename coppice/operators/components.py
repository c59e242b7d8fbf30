"""Connected components by contraction.

In a turn every vertex points to the smallest vertex around it, itself included.  The
pointers only go down, so they form trees, which pointer doubling flattens; then each tree
becomes one vertex under its root's name, and edges within it disappear.  Every vertex
with an edge shares its tree with another, so at most half of them are left for the
next turn, and the edge table shrinks with them.  A root is the smallest vertex of its
tree, so the last one is that of its component.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.plans.fixpoint import cut, cut_of, drop_cut


def _flattened(e: DataFrame, ks: list[str]) -> DataFrame:
    """``(keys.., u, root)`` of every vertex; each doubling joins the pointers with themselves."""
    both = e.union(e.select(*ks, F.col("v").alias("u"), F.col("u").alias("v")))
    up = cut(both.groupBy(*ks, "u").agg(F.min("v").alias("v")).select(*ks, "u", F.least("u", "v").alias("root")), "pointers")
    while True:
        # a root points to itself, so pointers that are at one need no further step
        onward = up.where("u <> root").select(*ks, F.col("u").alias("root"), F.col("root").alias("next"))
        doubled = up.join(onward, [*ks, "root"], "left").select(*ks, "u", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        doubled = cut(doubled, "pointers")
        settled = doubled.where("moved").isEmpty()
        drop_cut(up)
        up = doubled.drop("moved")
        if settled:
            return up


def _contracted(e: DataFrame, roots: DataFrame, ks: list[str]) -> DataFrame:
    """Edges between trees, under their roots' names."""
    j = e.join(roots.withColumnRenamed("root", "a"), [*ks, "u"]).join(roots.select(*ks, F.col("u").alias("v"), F.col("root").alias("b")), [*ks, "v"])
    return j.where("a <> b").select(*ks, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def component_labels(edges: DataFrame, src: str = "src", dst: str = "dst", keys: tuple[str, ...] = ()) -> DataFrame:
    """``(keys.., v, component)`` for every vertex that has an edge to another vertex.

    ``component`` is the smallest vertex id reachable.  Vertices without such an edge
    do not appear; callers give them their own id.  Nulls and self-loops are ignored.
    """
    ks, turns = list(keys), []
    e = edges.select(*ks, F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    e = cut(e.select(*ks, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not e.isEmpty():
        turns.append(cut_of(lambda e=e: _flattened(e, ks), "roots"))
        e, old = cut(_contracted(e, turns[-1], ks), "edges"), e
        drop_cut(old)

    def further(labels: DataFrame, roots: DataFrame) -> DataFrame:
        """Labels led on by the roots of the next turn."""
        j = labels.join(roots.select(*ks, F.col("u").alias("root"), F.col("root").alias("next")), [*ks, "root"], "left")
        return j.select(*ks, "u", F.coalesce("next", "root").alias("root"))

    labels = reduce(further, turns) if turns else e.withColumnRenamed("v", "root")
    return labels.select(*ks, F.col("u").alias("v"), F.col("root").alias("component"))
