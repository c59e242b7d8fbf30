"""Sharding by a k-d tree over document metadata, in DataFrame operations alone.

Rows with equal texts form a group and stay together.  A group is a point whose
dimensions are the logarithm of its size, the ranks of its first language and source
among all values, and its first doc_id, and whose weight is its bytes.  A node is split
at the weighted median of the dimension in which its points spread widest, until every
leaf holds the target bytes.  The medians of all nodes of a level are found at once, on
all their points, by histograms over the stretch of keys in which each median lies; a
bucket's own ends are the next stretch, until it is too light to matter.  The text's hash
follows the dimension's own bits, so heavy ties split like any other value.

Nodes, histograms and splits are tables: they grow with the number of leaves, are worked
on by executors, and nothing of them comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.llm.common import checked_broadcast, column_or_null, cut, cut_of

DIMENSIONS = ("size_log", "lang_at", "source_at", "doc_at")
#: Leading bits of a dimension and of the hash that breaks its ties.
DIMENSION_BITS, TIE_BITS = 28, 24
#: Buckets of a node's histogram, and the share of a node's bytes below which a bucket is not split further.
BUCKETS, FINE = 256, 0.0005
#: Rows that one task numbers at most, about.
NUMBERED_ROWS = 50_000
#: Levels of splits that are applied before the points are written anew.
LEVELS_EACH = 4


def _named(value: Column) -> Column:
    """A text as a key that sorts like it; null comes first."""
    return F.coalesce(F.concat(F.lit("s"), value), F.lit("n"))


def _ranks(groups: DataFrame) -> DataFrame:
    """``(dim, value, at)``: the place of every language and source among all, by code points.

    Values are numbered within stretches of about ``NUMBERED_ROWS``, however many there are.
    """
    pairs = F.array(*(F.struct(F.lit(dim).alias("dim"), F.col(dim).alias("value")) for dim in ("lang", "source")))
    values = cut(groups.select(F.inline(pairs)).distinct(), "values")
    parts = max(1, -(-values.count() // NUMBERED_ROWS))
    values = cut(values.repartitionByRange(parts, "dim", "value").withColumn("part", F.spark_partition_id()), "ranges")
    counts = values.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    at = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("dim", "value"))
    # a row for each stretch
    firsts = F.broadcast(counts.select("part", before.alias("before")))
    return values.join(firsts, "part").select("dim", "value", at.cast("double").alias("at"))


def _points(rows: DataFrame) -> DataFrame:
    """Groups of equal texts with a sortable key for each dimension."""
    g = rows.groupBy("h", "crc", "size").agg(
        F.sum("size").cast("double").alias("w"),
        F.log2("size").alias("size_log"),
        _named(F.min("lang")).alias("lang"),
        _named(F.min("source")).alias("source"),
        F.coalesce(F.min("doc_id"), F.lit(-1)).cast("double").alias("doc_at"),
    )
    g = cut(g, "groups")
    ranks = cut(_ranks(g), "ranks")
    for dim in ("lang", "source"):
        of = ranks.where(F.col("dim") == dim).select(F.col("value").alias(dim), F.col("at").alias(f"{dim}_at"))
        g = g.join(checked_broadcast(of), dim)
    ends = g.agg(*(f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max)))).first()
    top, tie = float((1 << DIMENSION_BITS) - 1), F.col("h").bitwiseAND(F.lit((1 << TIE_BITS) - 1))
    keys = []
    for d in DIMENSIONS:
        lo, hi = ends[f"lo_{d}"] or 0.0, ends[f"hi_{d}"] or 0.0
        scaled = F.floor((F.col(d) - lo) / (hi - lo) * top) if hi > lo else F.lit(0)
        keys.append((F.shiftleft(scaled.cast("long"), TIE_BITS) + tie).alias(d))
    return g.select("h", "crc", "size", "w", *keys, F.lit(0).cast("long").alias("node"))


def _key_of(dimension: Column) -> Column:
    key = F.when(dimension == 0, F.col(DIMENSIONS[0]))
    for i, d in enumerate(DIMENSIONS[1:], 1):
        key = key.when(dimension == i, F.col(d))
    return key


def _widest(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, dim, total, wanted, lo, hi`` of each node that is to be split: its widest dimension, its bytes, those
    that go to the left, and the ends of its keys."""
    unit = 1.0 / (1 << (DIMENSION_BITS + TIE_BITS))
    sums = [F.sum(F.col("w") * F.pow(F.col(d) * unit, n)).alias(f"m{n}_{d}") for d in DIMENSIONS for n in (1, 2)]
    sums += [f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]
    stats = points.join(checked_broadcast(nodes), "node").groupBy("node", "leaves").agg(F.sum("w").alias("total"), *sums)
    spread = F.array(*(F.col(f"m2_{d}") / F.col("total") - F.pow(F.col(f"m1_{d}") / F.col("total"), 2) for d in DIMENSIONS))
    stats = stats.withColumn("dim", (F.array_position(spread, F.array_max(spread)) - 1).cast("int"))
    wanted = F.col("total") * F.floor(F.col("leaves") / 2) / F.col("leaves")
    ends = (F.array(*(F.col(f"{n}_{d}") for d in DIMENSIONS))[F.col("dim")].alias(n) for n in ("lo", "hi"))
    return stats.select("node", "dim", "total", wanted.alias("wanted"), *ends)


def _narrowed(points: DataFrame, search: DataFrame) -> DataFrame:
    """The bucket in which each node's median lies: ``lo`` and ``hi`` become its own ends, ``below`` is the weight in front of it, ``inside`` its own."""
    near = points.join(checked_broadcast(search), "node").withColumn("key", _key_of(F.col("dim"))).where("key between lo and hi")
    same = ("node", "dim", "total", "wanted", "below")
    bucket = F.expr(f"((key - lo) * {BUCKETS}) div (hi - lo + 1)").alias("bucket")
    sums = near.groupBy(*same, bucket).agg(F.sum("w").alias("w"), F.min("key").alias("first"), F.max("key").alias("last"))
    # a node has no more rows than buckets
    upto = F.col("below") + F.sum("w").over(Window.partitionBy("node").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumn("upto", upto)
    this = F.struct("bucket", (F.col("upto") - F.col("w")).alias("below"), F.col("w").alias("inside"), "first", "last")
    # sums of doubles may end a hair below the whole: then it is the last bucket
    found = sums.groupBy(*same).agg(F.coalesce(F.min(F.when(F.col("upto") >= F.col("wanted"), this)), F.max(this)).alias("b"))
    return found.select("node", "dim", "total", "wanted", F.col("b.first").alias("lo"), F.col("b.last").alias("hi"), F.col("b.below").alias("below"), F.col("b.inside").alias("inside"))


def _medians(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, dim, split)``: keys below ``split`` go to the left."""
    search = cut(_widest(points, nodes).withColumn("below", F.lit(0.0)), "search")
    done = None
    while True:
        found = cut(_narrowed(points, search), "narrowed")
        fine = (F.col("inside") <= FINE * F.col("total")) | (F.col("lo") == F.col("hi"))
        # the bucket goes to the side that leaves the halves nearer to their shares
        left = F.col("below") + F.col("inside") - F.col("wanted") < F.col("wanted") - F.col("below")
        settled = found.where(fine).select("node", "dim", F.when(left, F.col("hi") + 1).otherwise(F.col("lo")).alias("split"))
        done = settled if done is None else done.union(settled)
        search = found.where(~fine).drop("inside")
        if search.isEmpty():
            return done


def _shards_of(points: DataFrame, leaves: int) -> DataFrame:
    """``(h, crc, size, shard)``; the children of node ``i`` are ``2 i + 1`` and ``2 i + 2``."""
    points = cut(points, "points")
    nodes = points.sparkSession.range(1).select(F.lit(0).cast("long").alias("node"), F.lit(0).alias("first"), F.lit(leaves).alias("leaves"))
    for level in range(max(0, leaves - 1).bit_length()):
        nodes = cut(nodes, "nodes")
        splits = cut_of(lambda: _medians(points, nodes.where("leaves > 1").select("node", "leaves")), "splits")
        # a node without points needs no split: no point looks for its leaves
        side = F.when(_key_of(F.col("dim")) >= F.col("split"), 2).otherwise(1)
        points = points.join(checked_broadcast(splits), "node", "left")
        points = points.withColumn("node", F.when(F.col("split").isNull(), F.col("node")).otherwise(2 * F.col("node") + side)).drop("dim", "split")
        if level % LEVELS_EACH == LEVELS_EACH - 1:
            points = cut(points, "points")
        half = F.floor(F.col("leaves") / 2).cast("int")
        children = F.array(
            F.struct((2 * F.col("node") + 1).alias("node"), F.col("first"), half.alias("leaves")),
            F.struct((2 * F.col("node") + 2).alias("node"), (F.col("first") + half).alias("first"), (F.col("leaves") - half).alias("leaves")),
        )
        nodes = nodes.where("leaves = 1").union(nodes.where("leaves > 1").select(F.inline(children)))
    nodes = cut(nodes, "nodes")
    return points.join(checked_broadcast(nodes), "node").select("h", "crc", "size", F.col("first").alias("shard"))


def shard(docs: DataFrame, leaves: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Give the number of leaves or the bytes that a leaf aims at.  ``size`` is the UTF-8
    bytes of the text plus one.  Null and empty texts are one group; rows with equal
    texts, repeated rows among them, share a shard even where that makes it large.  Texts
    of any length count whole; null languages, sources and ids come first in their
    dimension.  ``slot`` numbers a shard's rows from 0 without gaps.  The law is
    ``bytes``, so ``grown_shard`` is null.  An empty table gives no rows; other columns
    are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("crc"),
        F.xxhash64(text).alias("h"),
        column_or_null(docs, "lang", "string").alias("lang"),
        column_or_null(docs, "source", "string").alias("source"),
    )
    rows = cut(rows, "rows")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if leaves is None:
        leaves = max(1, round(total / target_bytes))
    placed = cut_of(lambda: _shards_of(_points(rows), leaves), "leaves")
    parts = max(1, -(-n // NUMBERED_ROWS))
    part = F.pmod(F.xxhash64("doc_id", "h"), F.lit(parts))
    rows = cut(rows.join(placed, ["h", "crc", "size"]).select("doc_id", "size", "crc", "h", "shard", part.alias("part")), "sharded")
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    first = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    firsts = cut(counts.select("shard", "part", first.alias("first")), "firsts")
    at = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "h"))
    return rows.withColumn("at", at).join(checked_broadcast(firsts), ["shard", "part"]).select(
        "doc_id",
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.col("at") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
