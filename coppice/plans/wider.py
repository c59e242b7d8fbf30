"""Queries over graphs of 16 vertices and over large ones, each with the SQL that it must agree with.

The graphs of 16 brands are searched by subsets in SQL: a set of vertices is a number, and
peeling takes bits off it.  Where an operator has two ways, both are registered.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from coppice.operators import features, generate, kernels, nets, solvers
from coppice.operators import structure as S
from coppice.operators.edges import canonical
from coppice.plans import queries as B
from coppice.plans import sql as Q
from coppice.plans.fixpoint import cut, temporary_path
from coppice.plans.queries import query
from coppice.sources import derived as D
from coppice.streaming import degrees

#: Brands that follow a brand in the sparse graphs, which fall apart, and in the dense ones.
SPARSE, DENSE = 1, 3


def _sparse(spark, sf):
    return D.brand_graphs(spark, sf, SPARSE).select("graph_id", "src", "dst")


def _dense(spark, sf):
    return D.brand_graphs(spark, sf, DENSE).select("graph_id", "src", "dst")


def _copied(query_sql: str) -> str:
    """A query over event graphs as one over dense brand graphs."""
    out = query_sql
    for least in (B.DIRECTED, B.UNDIRECTED):
        out = out.replace(Q.event_graph(least), Q.brand_graph(DENSE))
    return out.replace(Q.CORES, Q.CORES_BY_BITS)


THIN = "WITH RECURSIVE" + Q.brand_graph(SPARSE) + ","
FULL = "WITH RECURSIVE" + Q.brand_graph(DENSE) + ","
FULL_U = FULL + Q.UNDIRECTED + ","
_SCC = B.SCC.replace(Q.event_graph(B.DIRECTED), Q.brand_graph(SPARSE))


def _named(name: str, sql: str | None, run) -> None:
    run.__name__ = name
    query(sql)(run)


# ---------------------------------------------------------------- components and cycles

for _how in ("worker", "frames"):
    _end = "" if _how == "worker" else "_frames"
    _named(f"brand_scc{_end}", _SCC + " SELECT graph_id, v, scc FROM scc", lambda spark, sf, how=_how: S.strong_components(_sparse(spark, sf), how))
    _named(
        f"brand_components{_end}",
        THIN + Q.UNDIRECTED + "," + Q.REACH_BOTH + " SELECT gv.graph_id, gv.v, coalesce(least(gv.v, min(r.dst)), gv.v) AS component FROM gv LEFT JOIN r ON gv.graph_id = r.graph_id AND gv.v = r.src GROUP BY gv.graph_id, gv.v",
        lambda spark, sf, how=_how: S.connected(_sparse(spark, sf), D.brand_vertices(spark, sf), how=how),
    )
    _named(f"brand_cores{_end}", FULL_U + Q.CORES_BY_BITS + " SELECT graph_id, v, core FROM core WHERE core > 0", lambda spark, sf, how=_how: S.core_numbers(_dense(spark, sf), how))
    _named(
        f"brand_source_sink_peel{_end}",
        FULL + Q.peel_by_bits(True, both=True) + " SELECT e.graph_id, src, dst FROM e JOIN left_over l ON e.graph_id = l.graph_id WHERE (alive >> CAST(src AS INT)) & 1 = 1 AND (alive >> CAST(dst AS INT)) & 1 = 1",
        lambda spark, sf, how=_how: S.peel(_dense(spark, sf), True, sinks=True, how=how),
    )
    _named(
        f"brand_walks{_end}",
        FULL + B._rwse_sql("e", features.V3_STEPS),
        lambda spark, sf, how=_how: B._rounded(S.return_probabilities(_dense(spark, sf), D.brand_vertices(spark, sf), True, features.V3_STEPS, how), 9),
    )
    _named(
        f"brand_dfvs_by_scc_sum{_end}",
        FULL + Q.optimum_by_bits(True) + " SELECT graph_id, fvs_size FROM opt",
        lambda spark, sf, how=_how: solvers.solve_by_component(_dense(spark, sf), True, "bst", D.brand_graph_ids(spark, sf), how).select("graph_id", "fvs_size"),
    )


@query(FULL + Q.REACH + " SELECT graph_id, src AS v, min(least(src, dst)) AS least FROM r WHERE src = dst GROUP BY ALL")
def brand_vertices_on_cycles(spark, sf):
    """Vertices that reach themselves: those of components of more than one vertex."""
    return S.nontrivial_scc(_dense(spark, sf)).withColumn("least", F.col("v"))


@query(FULL + Q.REACH + " SELECT DISTINCT graph_id, true AS closed, true AS simple FROM r WHERE src = dst")
def brand_cycle_frames(spark, sf):
    """A cycle of each cyclic graph, found over tables: every step of it is an edge, and no vertex comes twice."""
    e = cut(_dense(spark, sf), "edges")
    c = cut(S.find_cycle(e, directed=True, how="frames"), "cycles")
    following = F.element_at("cycle", (F.pmod(F.col("i") + 1, "length") + 1).cast("int")).alias("dst")
    step = c.select("graph_id", "length", "cycle", F.posexplode("cycle").alias("i", "src")).select("graph_id", "length", "src", following)
    held = step.join(e, ["graph_id", "src", "dst"]).groupBy("graph_id").agg(F.count(F.lit(1)).alias("steps"), F.count_distinct("src").alias("vertices"))
    j = c.join(held, "graph_id", "left")
    return j.select("graph_id", F.coalesce(F.col("steps") == F.col("length"), F.lit(False)).alias("closed"), F.coalesce(F.col("vertices") == F.col("length"), F.lit(False)).alias("simple"))


for _how in ("worker", "frames"):
    _end = "" if _how == "worker" else "_frames"
    _named(f"brand_girth_directed{_end}", FULL + B._girth("e", 16), lambda spark, sf, how=_how: S.girth(_dense(spark, sf), True, how))
    _named(f"brand_girth_undirected{_end}", FULL_U + B._girth("b", 8), lambda spark, sf, how=_how: S.girth(_dense(spark, sf), False, how))


# ---------------------------------------------------------------- motifs


@query(FULL_U + Q.TRIANGLES + " SELECT graph_id, v, triangles FROM tri")
def brand_triangles(spark, sf):
    return S.triangles(_dense(spark, sf))


@query(FULL_U + B.FOURS + " SELECT graph_id, v, cliques FROM k4")
def brand_four_cliques(spark, sf):
    return S.four_cliques(_dense(spark, sf))


@query(FULL_U + B.FOURS + " SELECT graph_id, v, cycles FROM c4")
def brand_four_cycles(spark, sf):
    return S.four_cycles(_dense(spark, sf))


for _how in ("worker", "frames"):
    _end = "" if _how == "worker" else "_frames"
    for _name, _make, _directed in (("features_v2_dir", features.v2, True), ("features_v2_und", features.v2, False), ("features_v3_dir", features.v3, True), ("features_v3_und", features.v3, False)):
        _named(
            f"brand_{_name}{_end}",
            _copied(B.ORACLES[_name]),
            lambda spark, sf, how=_how, make=_make, directed=_directed: B._rounded(make(_dense(spark, sf), D.brand_vertices(spark, sf), directed, how), 9),
        )


# ---------------------------------------------------------------- solvers


for _directed in (True, False):
    _kind = "dfvs" if _directed else "fvs"
    _best = (FULL if _directed else FULL_U) + Q.optimum_by_bits(_directed) + " SELECT graph_id, fvs_size FROM opt"
    for _algo in ("bst", "ic", "brute"):
        _named(
            f"brand_{_kind}_{_algo}",
            _best,
            lambda spark, sf, directed=_directed, algo=_algo: solvers.solve(_dense(spark, sf), directed, algo, D.brand_graph_ids(spark, sf)).select("graph_id", "fvs_size"),
        )
    _named(
        f"brand_{_kind}_kernel_keeps_least_size",
        _best,
        lambda spark, sf, directed=_directed: B._preserved(canonical(_dense(spark, sf), directed), D.brand_graph_ids(spark, sf), directed),
    )
    for _algo in ("kma", "dkma"):

        def _gap(spark, sf, directed=_directed, algo=_algo):
            """What a heuristic finds is a solution, and here a least one."""
            found = solvers.solve(_dense(spark, sf), directed, algo, D.brand_graph_ids(spark, sf))
            return found.select("graph_id", "fvs_size", "valid", "minimal")

        _named(f"brand_{_kind}_{_algo}", _best.replace("SELECT graph_id, fvs_size FROM opt", "SELECT graph_id, fvs_size, true AS valid, true AS minimal FROM opt"), _gap)


@query(FULL + Q.peel_by_bits(True, both=True) + " SELECT graph_id, CAST(bit_count(alive) AS BIGINT) AS kernel_n FROM left_over")
def brand_confluent_kernel_size(spark, sf):
    """Vertices with an edge in what peeling leaves of the dense graphs."""
    e = S.peel(_dense(spark, sf), True, sinks=True)
    ends = e.select("graph_id", F.explode(F.array("src", "dst")).alias("v")).distinct().groupBy("graph_id").agg(F.count(F.lit(1)).alias("kernel_n"))
    return D.brand_graph_ids(spark, sf).join(ends, "graph_id", "left").select("graph_id", F.coalesce("kernel_n", F.lit(0)).cast("long").alias("kernel_n"))


# ---------------------------------------------------------------- nets

_V1_DIR = """di AS (SELECT gv.graph_id, gv.v, (SELECT count(*) FROM ty) AS n, (SELECT count(*) FROM e WHERE e.graph_id = gv.graph_id AND e.dst = gv.v) AS i,
        (SELECT count(*) FROM e WHERE e.graph_id = gv.graph_id AND e.src = gv.v) AS o FROM gv),
    f AS (SELECT graph_id, v, i::DOUBLE / greatest(n - 1, 1) AS h0, o::DOUBLE / greatest(n - 1, 1) AS h1, least(i, o)::DOUBLE / greatest(n - 1, 1) AS h2 FROM di)"""
_MEANS = nets.random_weights("directed", 3, 4, seed=5)
_ATTENTION = nets.random_weights("undirected_attention", 3, 4, heads=2, layers=1, seed=6)


@query(FULL + _V1_DIR + "," + Q.means_net(_MEANS, 3) + " SELECT graph_id, v, round(prob, 6) AS prob FROM net")
def brand_net_of_means(spark, sf):
    """A whole net of the first generation, its weights drawn by a seed, over its three channels."""
    prob = nets.probabilities(_dense(spark, sf), D.brand_vertices(spark, sf), True, _MEANS, generation=1)
    return prob.select("graph_id", "v", F.round("prob", 6).alias("prob"))


@query(FULL + _V1_DIR + "," + Q.UNDIRECTED + "," + Q.attention_net(_ATTENTION, 3) + " SELECT graph_id, v, round(prob, 6) AS prob FROM net")
def brand_net_of_attention(spark, sf):
    """A net of the third generation with one block of two heads, over three channels."""
    e, of = cut(_dense(spark, sf), "edges"), D.brand_vertices(spark, sf)
    f, channels = nets.vertex_features(e, of, True, 1)
    prob = nets.score(e, f, channels, "undirected_attention", _ATTENTION)
    return prob.select("graph_id", "v", F.round("prob", 6).alias("prob"))


def _hinted_queries() -> None:
    ids = "SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS graph_id, true AS valid, true AS size_ge_optimum, true AS hints_held FROM orders"
    for generation, width in ((1, 3), (2, 11), (3, 16)):
        for directed in (True, False):
            kind = ("directed" if directed else "undirected") + ("_attention" if generation == 3 else "")

            def run(spark, sf, generation=generation, directed=directed, kind=kind, width=width):
                """Vertices that an untrained net is sure of, with a solution of the rest: always a solution."""
                e, of = cut(_dense(spark, sf), "edges"), cut(D.brand_vertices(spark, sf), "vertices")
                w = nets.random_weights(kind, width, 8, heads=2, layers=2, seed=generation)
                found = nets.hinted_solve(e, of, directed, w, generation, threshold=0.5)
                best = solvers.solve(e, directed, "bst", of).select("graph_id", F.col("fvs_size").alias("least"))
                j = found.join(best, "graph_id")
                return j.select("graph_id", "valid", (F.col("fvs_size") >= F.col("least")).alias("size_ge_optimum"), (F.col("hinted") <= F.col("fvs_size")).alias("hints_held"))

            _named(f"brand_net_kma_v{generation}_{'dir' if directed else 'und'}", ids, run)


_hinted_queries()


#: Labels of the training table: a least solution has as many vertices as the least size.
@query(FULL + Q.optimum_by_bits(True) + " SELECT opt.graph_id, fvs_size AS labelled, (SELECT count(*) FROM ty) AS n FROM opt")
def brand_training_labels(spark, sf):
    rows = nets.training_table(_dense(spark, sf), D.brand_vertices(spark, sf), True)
    return rows.groupBy("graph_id").agg(F.sum("y").cast("long").alias("labelled"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- generators and checks


def _drawn(n: int, p: float, directed: bool) -> str:
    pairs = n * (n - 1) if directed else n * (n - 1) // 2
    draws = round(-pairs * math.log1p(-p))
    ends = "src, dst" if directed else "least(src, dst) AS src, greatest(src, dst) AS dst"
    return f"""WITH d AS (SELECT CAST('0x' || substr(md5('42:' || i), 1, 12) AS BIGINT) % {n * (n - 1)} AS k FROM range(0, {draws}) t(i)),
        x AS (SELECT k // {n - 1} AS src, k % {n - 1} + CASE WHEN k % {n - 1} >= k // {n - 1} THEN 1 ELSE 0 END AS dst FROM d)
        SELECT DISTINCT CAST(0 AS BIGINT) AS graph_id, {ends} FROM x"""


@query(_drawn(300, 0.05, True))
def erdos_renyi_directed(spark, sf):
    return generate.erdos_renyi(spark, 300, 0.05)


@query(_drawn(300, 0.05, False))
def erdos_renyi_undirected(spark, sf):
    return generate.erdos_renyi(spark, 300, 0.05, directed=False)


#: Even graphs answer with vertex 3 twice, graph 1 with a vertex that it has not, graph 3 and 5 with none.
@query(
    FULL
    + Q.REACH
    + """ SELECT g.graph_id, graph_id % 2 = 1 AS unique, graph_id <> 1 AS in_range, false AS valid FROM g"""
)
def brand_verified_answers(spark, sf):
    ids = D.brand_graph_ids(spark, sf)
    twice = ids.where("graph_id % 2 = 0").select("graph_id", F.explode(F.array(F.lit(3).cast("long"), F.lit(3).cast("long"))).alias("v"))
    outside = ids.where("graph_id = 1").select("graph_id", F.lit(99).cast("long").alias("v"))
    return S.verify_answers(_dense(spark, sf), twice.unionByName(outside), D.brand_vertices(spark, sf), True)


#: Levels of whole graphs: vertices on a cycle, and those that one reaches, do not appear.
LEVELS = (
    THIN
    + Q.REACH
    + """, cyc AS (SELECT DISTINCT graph_id, src AS v FROM r WHERE src = dst),
    behind AS (SELECT graph_id, v FROM cyc UNION SELECT r.graph_id, r.dst FROM r JOIN cyc ON r.graph_id = cyc.graph_id AND r.src = cyc.v),
    front AS (SELECT gv.graph_id, gv.v FROM gv ANTI JOIN behind ON gv.graph_id = behind.graph_id AND gv.v = behind.v),
    p AS (SELECT graph_id, v, CAST(0 AS BIGINT) AS n FROM front
          UNION SELECT p.graph_id, e.dst, n + 1 FROM p JOIN e ON p.graph_id = e.graph_id AND p.v = e.src JOIN front f ON f.graph_id = e.graph_id AND f.v = e.dst),
    lv AS (SELECT graph_id, v, max(n) AS level FROM p GROUP BY ALL)"""
)


@query(LEVELS + " SELECT graph_id, v, level FROM lv")
def brand_topological_levels(spark, sf):
    return S.topological_levels(_sparse(spark, sf), D.brand_vertices(spark, sf))


@query(
    LEVELS
    + """ SELECT graph_id, v, row_number() OVER (PARTITION BY graph_id ORDER BY level, CAST('0x' || substr(md5('42:' || graph_id || ':' || v), 1, 12) AS BIGINT), v) - 1 AS place FROM lv"""
)
def brand_topological_order(spark, sf):
    return S.random_topological_order(_sparse(spark, sf), D.brand_vertices(spark, sf))


# ---------------------------------------------------------------- large graphs


@query("WITH RECURSIVE " + Q.labels_by_turns("SELECT DISTINCT l_partkey AS p, l_suppkey + 1000000000 AS s FROM lineitem WHERE l_quantity >= 49.5 AND l_discount >= 0.085"))
def large_components(spark, sf):
    """Components of the parts and suppliers of the largest line items: many, of many sizes; by joins, not in a worker."""
    line = D.table(spark, sf, "lineitem").where("l_quantity >= 49.5 and l_discount >= 0.085").select("l_partkey", "l_suppkey").distinct()
    e = line.select(F.lit(0).cast("long").alias("graph_id"), F.col("l_partkey").alias("src"), (F.col("l_suppkey") + D.SUPPLIER_OFFSET).alias("dst"))
    return S.connected(e, how="frames").groupBy("component").agg(F.count(F.lit(1)).alias("n"))


#: Core numbers by turns over the neighbours' values, written out; more turns change nothing on these tables.
CORE_TURNS = 40


@query(Q.cores_by_turns("SELECT o_custkey AS c, l_suppkey + 1000000000 AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL HAVING count(*) >= 1", CORE_TURNS))
def large_cores(spark, sf):
    """Core numbers of the graph of customers and their suppliers; by joins, not in a worker."""
    e = D.cust_supp(spark, sf).select("graph_id", "src", "dst")
    return S.core_numbers(e, how="frames").select("v", "core")


@query(Q.cores_by_turns("SELECT o_custkey AS c, l_suppkey + 1000000000 AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL HAVING count(*) >= 1", CORE_TURNS))
def large_cores_in_a_worker(spark, sf):
    return S.core_numbers(D.cust_supp(spark, sf).select("graph_id", "src", "dst"), how="worker").select("v", "core")


@query(
    """WITH x AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 3),
       p AS (SELECT a.c AS a, b.c AS b, count(*) AS n FROM x a JOIN x b ON a.s = b.s AND a.c < b.c GROUP BY ALL),
       ends AS (SELECT unnest([a, b]) AS v, n * (n - 1) // 2 AS k FROM p),
       q AS (SELECT a.s, b.s AS t, count(*) AS n FROM x a JOIN x b ON a.c = b.c AND a.s < b.s GROUP BY ALL),
       sends AS (SELECT unnest([s, t]) + 1000000000 AS v, n * (n - 1) // 2 AS k FROM q)
       SELECT v, CAST(sum(k) AS BIGINT) AS cycles FROM (SELECT * FROM ends UNION ALL SELECT * FROM sends) GROUP BY v HAVING sum(k) > 0"""
)
def large_four_cycles(spark, sf):
    """Cycles of four among customers of three nations and their suppliers; two sides have no chords."""
    few = D.table(spark, sf, "customer").where("c_nationkey < 3").select(F.col("c_custkey").alias("src"))
    e = D.cust_supp(spark, sf).select("graph_id", "src", "dst").join(few, "src", "left_semi")
    return S.four_cycles(cut(e.select("graph_id", "src", "dst"), "edges")).select("v", F.col("cycles").cast("long").alias("cycles"))


@query(
    """WITH x AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
       b AS (SELECT c AS v, s + 1000000000 AS w FROM x UNION ALL SELECT s + 1000000000, c FROM x)
       SELECT CAST(count(*) AS BIGINT) AS edges, count(DISTINCT v) AS vertices, CAST(0 AS BIGINT) AS forced FROM b WHERE true"""
)
def large_kernel_size(spark, sf):
    """Both directions of every edge: nothing is peeled off where each lies on a cycle of two, and nothing is forced."""
    e = D.cust_supp(spark, sf).select("graph_id", "src", "dst")
    both = cut(e.unionByName(e.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))), "both")
    k, forced = kernels.confluent_kernel(both, True, how="frames")
    k = cut(k, "kernel")
    n = k.select("src").distinct().count()
    return k.agg(F.count(F.lit(1)).alias("edges")).select("edges", F.lit(n).cast("long").alias("vertices"), F.lit(forced.count()).cast("long").alias("forced"))


# ---------------------------------------------------------------- streams


@query(
    """WITH x AS (SELECT date_trunc('day', ts) AS d, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2)
       SELECT strftime(d, '%Y-%m-%d') AS day, event_type, n, value FROM x WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""
)
def streamed_windows(spark, sf):
    """Events as a stream, counted by day; a day is there once the watermark has passed its end."""
    out, log = temporary_path(spark, "stream"), temporary_path(spark, "log")
    stream = degrees.event_stream(spark, f"{sf}/events*.parquet", D.table(spark, sf, "events").schema)
    degrees.append_results(degrees.windowed_counts(stream), out, log).awaitTermination()
    rows = spark.read.parquet(out)
    return rows.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("value", 4).alias("value"))
