"""Graphs and result tables derived from the star-schema tables.

Every graph is a table of edges ``(graph_id, src, dst, w)``; a table may hold many graphs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(event_type, v)``: the few event types as vertices, numbered by name."""
    types = table(spark, sf_dir, "events").select("event_type").distinct()
    return types.select("event_type", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("long").alias("v"))


def event_graphs(spark: SparkSession, sf_dir: str, least: int = 3) -> DataFrame:
    """One directed graph per user: an edge where one event type follows another ``least`` times or more."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    following = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pairs = e.select("user_id", F.col("event_type").alias("a"), following.alias("b")).where("a <> b")
    w = pairs.groupBy("user_id", "a", "b").agg(F.count(F.lit(1)).alias("w")).where(F.col("w") >= least)
    types = F.broadcast(event_types(spark, sf_dir))  # as many rows as there are event types
    w = w.join(types.select(F.col("event_type").alias("a"), F.col("v").alias("src")), "a")
    w = w.join(types.select(F.col("event_type").alias("b"), F.col("v").alias("dst")), "b")
    return w.select(F.col("user_id").cast("long").alias("graph_id"), "src", "dst", "w")


def event_graph_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's graph, those without edges too."""
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("graph_id")).distinct()


def event_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(graph_id, v)`` for every graph and event type."""
    # one row with an array of the few event types
    types = event_types(spark, sf_dir).agg(F.collect_list("v").alias("vs"))
    every = event_graph_ids(spark, sf_dir).withColumn("one", F.lit(1)).join(F.broadcast(types.withColumn("one", F.lit(1))), "one")
    return every.select("graph_id", F.explode("vs").alias("v"))


def nation_top(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Each supplier nation to the ``k`` other customer nations with most line items, ties by key."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("dst"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("src"))
    j = (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    w = j.where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.col("w").desc(), "dst"))
    return w.withColumn("r", place).where(F.col("r") <= k).select(F.lit(0).cast("long").alias("graph_id"), "src", "dst", "w")


#: Brands that are vertices: the first ones by name.
BRANDS = 16


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(p_brand, v)``: the first ``BRANDS`` part brands, numbered by name."""
    named = table(spark, sf_dir, "part").select("p_brand").distinct()
    return named.select("p_brand", (F.row_number().over(Window.orderBy("p_brand")) - 1).cast("long").alias("v")).where(F.col("v") < BRANDS)


def brand_graph_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph for each order priority, numbered by its first character."""
    return table(spark, sf_dir, "orders").select(F.substring("o_orderpriority", 1, 1).cast("long").alias("graph_id")).distinct()


def brand_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(graph_id, v)`` for every graph and brand."""
    vs = brands(spark, sf_dir).agg(F.collect_list("v").alias("vs"))  # one row
    every = brand_graph_ids(spark, sf_dir).withColumn("one", F.lit(1)).join(F.broadcast(vs.withColumn("one", F.lit(1))), "one")
    return every.select("graph_id", F.explode("vs").alias("v"))


def brand_graphs(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Each brand to the ``k`` brands that follow it most often on the lines of an order, ties by number; one graph for each priority."""
    named = F.broadcast(brands(spark, sf_dir))  # at most BRANDS rows
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.substring("o_orderpriority", 1, 1).cast("long").alias("graph_id"))
    following = F.lead("p_brand").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    pairs = line.join(parts, "l_partkey").select("l_orderkey", F.col("p_brand").alias("a"), following.alias("b")).where("a <> b")
    pairs = pairs.join(named.select(F.col("p_brand").alias("a"), F.col("v").alias("src")), "a").join(named.select(F.col("p_brand").alias("b"), F.col("v").alias("dst")), "b")
    w = pairs.join(orders, "l_orderkey").groupBy("graph_id", "src", "dst").agg(F.count(F.lit(1)).alias("w"))
    place = F.row_number().over(Window.partitionBy("graph_id", "src").orderBy(F.col("w").desc(), "dst"))
    return w.withColumn("r", place).where(F.col("r") <= k).select("graph_id", "src", "dst", "w")


#: Added to supplier keys, so that both sides of a bipartite graph have ids of their own.
SUPPLIER_OFFSET = 1_000_000_000


def part_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and the suppliers that have supplied them, undirected and bipartite."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return line.select(
        F.lit(0).cast("long").alias("graph_id"), F.col("l_partkey").alias("src"), (F.col("l_suppkey") + SUPPLIER_OFFSET).alias("dst"), F.lit(1).cast("long").alias("w")
    )


def cust_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and the suppliers that have served them."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    j = line.join(orders, "l_orderkey").groupBy("o_custkey", "l_suppkey").agg(F.count(F.lit(1)).alias("w"))
    return j.select(F.lit(0).cast("long").alias("graph_id"), F.col("o_custkey").alias("src"), (F.col("l_suppkey") + SUPPLIER_OFFSET).alias("dst"), "w")


def solver_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of solver runs: ``instance, solver, fvs_size, n, runtime_s, valid``."""
    line = table(spark, sf_dir, "lineitem")
    return (
        line.groupBy(F.col("l_partkey").alias("instance"), F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("solver"))
        .agg(
            F.min(F.floor("l_quantity")).cast("long").alias("fvs_size"),
            F.round(F.avg("l_extendedprice") / 10000, 10).alias("runtime_s"),
            (F.max("l_discount") < 0.095).alias("valid"),
        )
        .withColumn("n", (F.col("instance") % 40 + 10).cast("long"))
    )
