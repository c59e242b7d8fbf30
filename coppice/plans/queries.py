"""Named queries over the driver's tables, each with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.operators import analytics as A
from coppice.operators import edges as E
from coppice.operators import features, generate, kernels, runner, scoring, solvers
from coppice.operators import structure as S
from coppice.plans import sql as Q
from coppice.plans.fixpoint import cut
from coppice.sources import derived as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Directed graphs keep edges of weight 3, undirected ones of weight 4.
DIRECTED, UNDIRECTED = 3, 4


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.event_graphs(spark, sf_dir, DIRECTED)


def _undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.canonical(D.event_graphs(spark, sf_dir, UNDIRECTED))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for comparison. Walks are sums of halves and quarters, which end in ties: at nine digits a nudge decides them."""
    nudge = 1e-12 if digits == 9 else 0.0
    return df.select(*(F.round(F.col(c) + nudge, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


DIR = "WITH RECURSIVE" + Q.event_graph(DIRECTED) + ","
UND = "WITH RECURSIVE" + Q.event_graph(UNDIRECTED) + "," + Q.UNDIRECTED + ","
DIR0 = "WITH RECURSIVE" + Q.event_graph(DIRECTED)
UND0 = "WITH RECURSIVE" + Q.event_graph(UNDIRECTED) + "," + Q.UNDIRECTED

# ---------------------------------------------------------------- edges and degrees


@query(UND0 + " SELECT graph_id, src, dst FROM u")
def edges_canonical(spark, sf):
    return _undirected(spark, sf)


@query(DIR0 + " SELECT graph_id, src, dst, w FROM e")
def edges_directed(spark, sf):
    return _directed(spark, sf)


@query(UND0 + " SELECT gv.graph_id, gv.v, count(b.dst) AS degree FROM gv LEFT JOIN b ON gv.graph_id = b.graph_id AND gv.v = b.src GROUP BY ALL")
def degrees_undirected(spark, sf):
    return E.degrees(_undirected(spark, sf), of=D.event_vertices(spark, sf))


@query(
    DIR0
    + """ SELECT gv.graph_id, gv.v, (SELECT count(*) FROM e WHERE e.graph_id = gv.graph_id AND e.dst = gv.v) AS in_degree,
          (SELECT count(*) FROM e WHERE e.graph_id = gv.graph_id AND e.src = gv.v) AS out_degree FROM gv"""
)
def degrees_directed(spark, sf):
    return E.in_out_degrees(_directed(spark, sf), of=D.event_vertices(spark, sf))


@query(DIR0 + " SELECT graph_id, src, dst, w FROM e WHERE src IN (0, 1, 3) AND dst IN (0, 1, 3)")
def induced_subgraph(spark, sf):
    return E.induced(_directed(spark, sf), D.event_vertices(spark, sf).where("v in (0, 1, 3)"))


@query(DIR0 + " SELECT graph_id, src, dst, w FROM e WHERE src NOT IN (0, 2) AND dst NOT IN (0, 2)")
def remove_vertices(spark, sf):
    return E.without_vertices(_directed(spark, sf), D.event_vertices(spark, sf).where("v in (0, 2)"))


@query(DIR0 + " SELECT graph_id, src, dst FROM e UNION SELECT graph_id, 0, 1 FROM g")
def add_edge(spark, sf):
    more = D.event_graph_ids(spark, sf).select("graph_id", F.lit(0).cast("long").alias("src"), F.lit(1).cast("long").alias("dst"))
    return E.add_edges(_directed(spark, sf), more)


@query(DIR0 + " SELECT graph_id, src, dst, w FROM e WHERE NOT (src = 0 AND dst = 1)")
def remove_edge(spark, sf):
    fewer = D.event_graph_ids(spark, sf).select("graph_id", F.lit(0).cast("long").alias("src"), F.lit(1).cast("long").alias("dst"))
    return E.remove_edges(_directed(spark, sf), fewer)


@query("WITH x AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem) SELECT CAST(0 AS BIGINT) AS graph_id, src, dst FROM x WHERE src < 200 AND dst < 200")
def edges_in_range(spark, sf):
    e = D.part_supp(spark, sf).withColumn("dst", F.col("dst") - D.SUPPLIER_OFFSET)
    return E.in_range(e, 200).select("graph_id", "src", "dst")


@query("SELECT DISTINCT CAST(0 AS BIGINT) AS graph_id, l_partkey AS v FROM lineitem WHERE l_partkey = l_suppkey")
def self_loops(spark, sf):
    e = D.part_supp(spark, sf).withColumn("dst", F.col("dst") - D.SUPPLIER_OFFSET)
    return E.self_loops(e)


@query(
    """WITH x AS (SELECT DISTINCT l_suppkey AS v FROM lineitem)
       SELECT CAST(0 AS BIGINT) AS graph_id, v, row_number() OVER (ORDER BY CAST(v AS VARCHAR)) - 1 AS new_v FROM x"""
)
def relabel_by_text(spark, sf):
    vs = D.table(spark, sf, "lineitem").select(F.lit(0).cast("long").alias("graph_id"), F.col("l_suppkey").alias("v")).distinct()
    return E.dense_labels(vs, as_text=True)


@query(
    DIR
    + """ x AS (SELECT graph_id, src AS v FROM e UNION SELECT graph_id, dst FROM e),
          l AS (SELECT graph_id, v, row_number() OVER (PARTITION BY graph_id ORDER BY v) - 1 AS n FROM x)
          SELECT e.graph_id, a.n AS src, b.n AS dst FROM e JOIN l a ON e.graph_id = a.graph_id AND e.src = a.v JOIN l b ON e.graph_id = b.graph_id AND e.dst = b.v"""
)
def relabel_dense(spark, sf):
    e = _directed(spark, sf)
    return E.relabel(e, E.dense_labels(E.vertices(e)))


@query(
    UND
    + """ k AS (SELECT * FROM u WHERE src <> 0 AND dst <> 0), d AS (SELECT graph_id, v, count(*) AS c FROM (SELECT graph_id, unnest([src, dst]) AS v FROM k) GROUP BY ALL)
          SELECT graph_id, max(c) AS max_degree FROM d GROUP BY graph_id"""
)
def residual_max_degree(spark, sf):
    return E.residual_max_degree(_undirected(spark, sf), D.event_vertices(spark, sf).where("v = 0"))


# ---------------------------------------------------------------- components, cycles, order


@query(UND + Q.REACH_BOTH + " SELECT gv.graph_id, gv.v, coalesce(least(gv.v, min(r.dst)), gv.v) AS component FROM gv LEFT JOIN r ON gv.graph_id = r.graph_id AND gv.v = r.src GROUP BY gv.graph_id, gv.v")
def connected_components(spark, sf):
    return S.connected(_undirected(spark, sf), D.event_vertices(spark, sf))


#: Every supplier has served a part of the first one's component in these tables; others would stay without a label.
@query(
    """WITH RECURSIVE x AS (SELECT DISTINCT l_partkey AS p, l_suppkey + 1000000000 AS s FROM lineitem),
       b AS (SELECT p AS src, s AS dst FROM x UNION ALL SELECT s, p FROM x),
       r AS (SELECT min(src) AS v FROM b UNION SELECT b.dst FROM r JOIN b ON r.v = b.src)
       SELECT (SELECT min(src) FROM b) AS component, count(*) AS n FROM r"""
)
def part_supplier_components(spark, sf):
    return S.connected(D.part_supp(spark, sf)).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


@query(
    UND
    + Q.REACH_BOTH
    + """, l AS (SELECT graph_id, src AS v, least(src, min(dst)) AS c FROM r GROUP BY graph_id, src),
          s AS (SELECT graph_id, c, row_number() OVER (PARTITION BY graph_id ORDER BY count(*) DESC, c) AS place FROM l GROUP BY graph_id, c)
          SELECT l.graph_id, l.v FROM l JOIN s ON l.graph_id = s.graph_id AND l.c = s.c AND place = 1"""
)
def largest_component(spark, sf):
    return S.largest_component(_undirected(spark, sf))


SCC = (
    DIR
    + Q.REACH
    + """, vs AS (SELECT graph_id, src AS v FROM e UNION SELECT graph_id, dst FROM e),
    scc AS (SELECT vs.graph_id, vs.v, least(vs.v, coalesce(min(x.dst), vs.v)) AS scc FROM vs
            LEFT JOIN (SELECT a.graph_id, a.src, a.dst FROM r a JOIN r z ON a.graph_id = z.graph_id AND a.src = z.dst AND a.dst = z.src) x
            ON vs.graph_id = x.graph_id AND vs.v = x.src GROUP BY vs.graph_id, vs.v)"""
)


@query(SCC + " SELECT graph_id, v, scc FROM scc")
def scc_labels(spark, sf):
    return S.strong_components(_directed(spark, sf))


@query(SCC + " SELECT graph_id, v FROM (SELECT *, count(*) OVER (PARTITION BY graph_id, scc) AS n FROM scc) WHERE n > 1")
def nontrivial_scc(spark, sf):
    return S.nontrivial_scc(_directed(spark, sf))


@query(
    SCC
    + """, big AS (SELECT graph_id, v FROM (SELECT *, count(*) OVER (PARTITION BY graph_id, scc) AS n FROM scc) WHERE n > 1)
    SELECT e.graph_id, src, dst FROM e SEMI JOIN big a ON e.graph_id = a.graph_id AND src = a.v SEMI JOIN big c ON e.graph_id = c.graph_id AND dst = c.v"""
)
def scc_prune(spark, sf):
    return kernels.scc_prune(_directed(spark, sf))


@query(DIR + Q.REACH + " SELECT g.graph_id, count(r.src) > 0 AS has_cycle FROM g LEFT JOIN r ON g.graph_id = r.graph_id AND r.src = r.dst GROUP BY ALL")
def has_directed_cycle(spark, sf):
    return S.has_cycle(_directed(spark, sf), D.event_graph_ids(spark, sf), directed=True)


#: Without loops a graph is a forest if its edges are as many as its touched vertices less their components.
FOREST = (
    Q.REACH_BOTH
    + """, l AS (SELECT graph_id, src AS v, least(src, min(dst)) AS c FROM r GROUP BY graph_id, src),
    f AS (SELECT graph_id, count(*) - count(DISTINCT c) AS most FROM l GROUP BY graph_id),
    n AS (SELECT graph_id, count(*) AS n FROM u GROUP BY graph_id)"""
)


@query(UND + FOREST + " SELECT g.graph_id, coalesce(n.n > f.most, false) AS has_cycle FROM g LEFT JOIN f USING (graph_id) LEFT JOIN n USING (graph_id)")
def has_cycle_undirected(spark, sf):
    return S.has_cycle(_undirected(spark, sf), D.event_graph_ids(spark, sf), directed=False)


@query("WITH RECURSIVE" + Q.event_graph(DIRECTED).replace("WHERE a <> b", "WHERE a <> b AND x.v NOT IN (0, 1) AND y.v NOT IN (0, 1)") + "," + Q.REACH + " SELECT g.graph_id, count(r.src) = 0 AS valid FROM g LEFT JOIN r ON g.graph_id = r.graph_id AND r.src = r.dst GROUP BY ALL")
def is_valid_dfvs(spark, sf):
    removed = D.event_vertices(spark, sf).where("v in (0, 1)")
    return S.is_solution(_directed(spark, sf), removed, D.event_graph_ids(spark, sf), directed=True)


@query("WITH RECURSIVE" + Q.event_graph(UNDIRECTED).replace("WHERE a <> b", "WHERE a <> b AND x.v <> 0 AND y.v <> 0") + "," + Q.UNDIRECTED + "," + FOREST + " SELECT g.graph_id, NOT coalesce(n.n > f.most, false) AS valid FROM g LEFT JOIN f USING (graph_id) LEFT JOIN n USING (graph_id)")
def is_valid_fvs(spark, sf):
    removed = D.event_vertices(spark, sf).where("v = 0")
    return S.is_solution(_undirected(spark, sf), removed, D.event_graph_ids(spark, sf), directed=False)


@query(DIR + Q.REACH + " SELECT DISTINCT r.graph_id, true AS closed FROM r WHERE r.src = r.dst")
def found_cycle_is_one(spark, sf):
    """A cycle of each cyclic graph, with its own check: every step of it is an edge and no vertex repeats."""
    e = cut(_directed(spark, sf), "edges")
    c = S.find_cycle(e, directed=True)
    step = c.select("graph_id", "length", F.posexplode("cycle").alias("i", "src"), "cycle")
    step = step.select("graph_id", "length", "src", F.element_at("cycle", (F.pmod(F.col("i") + 1, "length") + 1).cast("int")).alias("dst"))
    good = step.join(e, ["graph_id", "src", "dst"]).groupBy("graph_id", "length").agg(F.count_distinct("src").alias("n"))
    return good.select("graph_id", (F.col("n") == F.col("length")).alias("closed"))


def _girth(source: str, most: int) -> str:
    """Closed walks by length: the shortest one is a cycle. Undirected walks do not turn back on their edge."""
    back = "" if source == "e" else " AND x.dst <> w.prev"
    return f""" w AS (SELECT graph_id, src AS start, src AS prev, dst, 1 AS n FROM {source}
          UNION SELECT w.graph_id, start, w.dst, x.dst, n + 1 FROM w JOIN {source} x ON w.graph_id = x.graph_id AND w.dst = x.src
                WHERE n < {most} AND w.dst <> start{back})
          SELECT graph_id, CAST(min(n) AS BIGINT) AS girth FROM w WHERE start = dst GROUP BY graph_id"""


@query(DIR + _girth("e", 5))
def girth_directed(spark, sf):
    return S.girth(_directed(spark, sf), directed=True)


@query(UND + _girth("b", 5))
def girth_undirected(spark, sf):
    return S.girth(_undirected(spark, sf), directed=False)


@query(UND + Q.CORES + " SELECT core.graph_id, core.v, core.core FROM core SEMI JOIN b ON core.graph_id = b.graph_id AND core.v = b.src")
def kcore(spark, sf):
    return S.core_numbers(_undirected(spark, sf))


@query(UND + Q.CORES + " SELECT u.graph_id, src, dst FROM u SEMI JOIN core a ON u.graph_id = a.graph_id AND src = a.v AND a.core >= 2 SEMI JOIN core c ON u.graph_id = c.graph_id AND dst = c.v AND c.core >= 2")
def two_core(spark, sf):
    return S.two_core(_undirected(spark, sf))


#: The union of all sets in which every vertex has a predecessor and a successor.
PEELED = Q.MASKS + """,
    bad AS (SELECT DISTINCT m.graph_id, m.mask FROM m JOIN gv ON m.graph_id = gv.graph_id AND (mask >> CAST(gv.v AS INT)) & 1 = 1
            LEFT JOIN me i ON i.graph_id = m.graph_id AND i.mask = m.mask AND i.dst = gv.v
            LEFT JOIN me o ON o.graph_id = m.graph_id AND o.mask = m.mask AND o.src = gv.v WHERE i.src IS NULL OR o.src IS NULL),
    keep AS (SELECT m.graph_id, bit_or(m.mask) AS mask FROM m ANTI JOIN bad ON m.graph_id = bad.graph_id AND m.mask = bad.mask GROUP BY m.graph_id)
    SELECT e.graph_id, src, dst FROM e JOIN keep ON e.graph_id = keep.graph_id AND (mask >> CAST(src AS INT)) & 1 = 1 AND (mask >> CAST(dst AS INT)) & 1 = 1"""


@query(DIR + PEELED)
def source_sink_peel(spark, sf):
    return S.peel(_directed(spark, sf), directed=True, sinks=True)


#: Levels of the part of a graph in front of its cycles: the longest path from a source.
LEVELS = """ d AS (SELECT graph_id, src, dst FROM e WHERE src < dst),
          p AS (SELECT graph_id, v, CAST(0 AS BIGINT) AS n FROM gv UNION SELECT p.graph_id, d.dst, n + 1 FROM p JOIN d ON p.graph_id = d.graph_id AND p.v = d.src)
          SELECT graph_id, v, max(n) AS level FROM p GROUP BY ALL"""


@query(DIR + LEVELS)
def topological_levels(spark, sf):
    return S.topological_levels(_directed(spark, sf).where("src < dst"), D.event_vertices(spark, sf))


@query(
    DIR
    + LEVELS.replace("SELECT graph_id, v, max(n) AS level FROM p GROUP BY ALL", "")
    + """, l AS (SELECT graph_id, v, max(n) AS level FROM p GROUP BY ALL)
          SELECT graph_id, v, row_number() OVER (PARTITION BY graph_id ORDER BY level, CAST('0x' || substr(md5('42:' || graph_id || ':' || v), 1, 12) AS BIGINT), v) - 1 AS place FROM l"""
)
def random_topological_order(spark, sf):
    return S.random_topological_order(_directed(spark, sf).where("src < dst"), D.event_vertices(spark, sf))


@query(
    """WITH RECURSIVE x AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey
                 JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY ALL),
       e AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM x) WHERE r <= 2),
       b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
       vs AS (SELECT DISTINCT CAST(src AS BIGINT) AS v, CAST('0x' || substr(md5('42:0:' || src), 1, 12) AS BIGINT) AS u FROM b),
       s AS (SELECT arg_min(v, u) AS v FROM vs),
       w AS (SELECT v, 0 AS n FROM s UNION SELECT CAST(b.dst AS BIGINT), n + 1 FROM w JOIN b ON w.v = b.src WHERE n < 24),
       l AS (SELECT v, min(n) AS depth FROM w GROUP BY v)
       SELECT CAST(0 AS BIGINT) AS graph_id, vs.v FROM vs LEFT JOIN l USING (v) ORDER BY coalesce(depth, 1000), u LIMIT 12"""
)
def bfs_sample(spark, sf):
    return S.bfs_sample(D.nation_top(spark, sf, 2), 12)


# ---------------------------------------------------------------- motifs and walks


@query(UND + Q.TRIANGLES + " SELECT graph_id, v, triangles FROM tri")
def triangles(spark, sf):
    return S.triangles(_undirected(spark, sf))


CLUSTERING = Q.TRIANGLES + """, dg AS (SELECT graph_id, src AS v, count(*) AS d FROM b GROUP BY ALL),
    cl AS (SELECT dg.graph_id, dg.v, CASE WHEN d >= 2 THEN 2.0::DOUBLE * coalesce(triangles, 0) / (d * (d - 1)) ELSE 0.0::DOUBLE END AS clustering
           FROM dg LEFT JOIN tri ON dg.graph_id = tri.graph_id AND dg.v = tri.v)"""


@query(UND + CLUSTERING + " SELECT graph_id, v, round(clustering, 6) AS clustering FROM cl")
def clustering(spark, sf):
    return _rounded(S.clustering(_undirected(spark, sf)))


FOURS = """
    q AS (SELECT x.graph_id, x.v AS a, y.v AS b, z.v AS c, t.v AS d FROM gv x JOIN gv y ON x.graph_id = y.graph_id AND x.v < y.v
          JOIN gv z ON x.graph_id = z.graph_id AND y.v < z.v JOIN gv t ON x.graph_id = t.graph_id AND z.v < t.v),
    qe AS (SELECT q.graph_id, a, q.b, c, d, u.src, u.dst FROM q JOIN u ON q.graph_id = u.graph_id AND u.src IN (a, q.b, c, d) AND u.dst IN (a, q.b, c, d)),
    qn AS (SELECT graph_id, a, b, c, d, count(*) AS n, sum(CASE WHEN a IN (src, dst) THEN 1 ELSE 0 END) AS da, sum(CASE WHEN b IN (src, dst) THEN 1 ELSE 0 END) AS db,
                  sum(CASE WHEN c IN (src, dst) THEN 1 ELSE 0 END) AS dc, sum(CASE WHEN d IN (src, dst) THEN 1 ELSE 0 END) AS dd FROM qe GROUP BY ALL),
    k4 AS (SELECT graph_id, v, count(*) AS cliques FROM (SELECT graph_id, unnest([a, b, c, d]) AS v FROM qn WHERE n = 6) GROUP BY ALL),
    c4 AS (SELECT graph_id, v, count(*) AS cycles FROM (SELECT graph_id, unnest([a, b, c, d]) AS v FROM qn WHERE n = 4 AND da = 2 AND db = 2 AND dc = 2 AND dd = 2) GROUP BY ALL)"""

#: Motifs are taken from a denser graph, where all kinds occur.
DENSE = "WITH RECURSIVE" + Q.event_graph(DIRECTED) + "," + Q.UNDIRECTED + ","


@query(DENSE + FOURS + " SELECT graph_id, v, cliques FROM k4")
def four_cliques(spark, sf):
    return S.four_cliques(_directed(spark, sf))


@query(DENSE + FOURS + " SELECT graph_id, v, cycles FROM c4")
def four_cycles(spark, sf):
    return S.four_cycles(_directed(spark, sf))


def _rwse_sql(source: str, steps: tuple[int, ...]) -> str:
    rows = " UNION ALL ".join(f"SELECT gv.graph_id, gv.v, CAST({k} AS BIGINT) AS step, round(coalesce(d{k}.p, 0.0::DOUBLE) + 1e-12::DOUBLE, 9) AS p FROM gv LEFT JOIN d{k} ON gv.graph_id = d{k}.graph_id AND gv.v = d{k}.v" for k in steps)
    return Q.walks(source, steps) + " " + rows


@query(DIR + _rwse_sql("e", (2, 3, 4, 5)))
def rwse_2_5(spark, sf):
    return _rounded(S.return_probabilities(_directed(spark, sf), D.event_vertices(spark, sf), True), 9)


@query(UND + _rwse_sql("b", features.V3_STEPS))
def rwse_v3(spark, sf):
    return _rounded(S.return_probabilities(_undirected(spark, sf), D.event_vertices(spark, sf), False, features.V3_STEPS), 9)


# ---------------------------------------------------------------- kernels and solvers


@query(UND + Q.CORES + " SELECT u.graph_id, src, dst FROM u SEMI JOIN core a ON u.graph_id = a.graph_id AND src = a.v AND a.core >= 2 SEMI JOIN core c ON u.graph_id = c.graph_id AND dst = c.v AND c.core >= 2")
def kernel_u01(spark, sf):
    return kernels.confluent_kernel(_undirected(spark, sf), directed=False)[0]


@query(SCC + " SELECT e.graph_id, src, dst FROM e JOIN scc a ON e.graph_id = a.graph_id AND src = a.v JOIN scc c ON e.graph_id = c.graph_id AND dst = c.v WHERE a.scc = c.scc")
def kernel_d014(spark, sf):
    return kernels.confluent_kernel(_directed(spark, sf), directed=True)[0]


def _preserved(edges: DataFrame, ids: DataFrame, directed: bool) -> DataFrame:
    """Least size before, and forced plus least size after."""
    e = cut(edges.select("graph_id", "src", "dst"), "edges")
    k, forced = kernels.kernel(e, directed)
    n = forced.groupBy("graph_id").agg(F.count(F.lit(1)).alias("forced"))
    after = solvers.solve(k, directed, "bst", ids).select("graph_id", "fvs_size")
    return after.join(n, "graph_id", "left").select("graph_id", (F.col("fvs_size") + F.coalesce("forced", F.lit(0))).alias("fvs_size"))


@query(UND + Q.UNDIRECTED_OPTIMUM + " SELECT graph_id, fvs_size FROM opt")
def kernel_u2_preserves_opt(spark, sf):
    return _preserved(_undirected(spark, sf), D.event_graph_ids(spark, sf), False)


@query(DIR + Q.DIRECTED_OPTIMUM + " SELECT graph_id, fvs_size FROM opt")
def kernel_bypass_preserves_opt(spark, sf):
    return _preserved(_directed(spark, sf), D.event_graph_ids(spark, sf), True)


#: Vertices with a loop, which a part and supplier of one number make, are forced.
@query("SELECT CAST(0 AS BIGINT) AS graph_id, count(DISTINCT l_partkey) AS forced FROM lineitem WHERE l_partkey = l_suppkey")
def kernel_forced_count(spark, sf):
    e = D.part_supp(spark, sf).withColumn("dst", F.col("dst") - D.SUPPLIER_OFFSET)
    forced = kernels.confluent_kernel(e, directed=True)[1]
    return forced.groupBy("graph_id").agg(F.count(F.lit(1)).alias("forced"))


def _solver_queries() -> None:
    for directed, name in ((True, "dfvs"), (False, "fvs")):
        optimum = (DIR + Q.DIRECTED_OPTIMUM) if directed else (UND + Q.UNDIRECTED_OPTIMUM)
        for algo in ("brute", "bst", "ic"):

            def run(spark, sf, directed=directed, algo=algo):
                e = _directed(spark, sf) if directed else _undirected(spark, sf)
                return solvers.solve(e, directed, algo, D.event_graph_ids(spark, sf)).select("graph_id", "fvs_size")

            run.__name__ = f"{name}_min_size" + ("" if algo == "brute" else f"_{algo}")
            query(optimum + " SELECT graph_id, fvs_size FROM opt")(run)
        for algo in ("greedy", "ma", "kma", "dkma"):

            def checked(spark, sf, directed=directed, algo=algo):
                """Properties that any run must have: valid, minimal, no smaller than the least size."""
                e = cut((_directed(spark, sf) if directed else _undirected(spark, sf)).select("graph_id", "src", "dst"), "edges")
                ids = D.event_graph_ids(spark, sf)
                found = solvers.solve(e, directed, algo, ids)
                best = solvers.solve(e, directed, "bst", ids).select("graph_id", F.col("fvs_size").alias("least"))
                j = found.join(best, "graph_id")
                minimal = F.col("minimal") if algo != "greedy" else F.lit(True)
                return j.select("graph_id", "valid", minimal.alias("minimal"), (F.col("fvs_size") >= F.col("least")).alias("size_ge_optimum"))

            checked.__name__ = f"{algo}_{name}_valid"
            query("SELECT DISTINCT CAST(user_id AS BIGINT) AS graph_id, true AS valid, true AS minimal, true AS size_ge_optimum FROM events")(checked)


_solver_queries()


@query(DIR + Q.DIRECTED_OPTIMUM + " SELECT graph_id, fvs_size FROM opt")
def dfvs_by_scc_sum(spark, sf):
    return solvers.solve_by_component(_directed(spark, sf), True, "bst", D.event_graph_ids(spark, sf)).select("graph_id", "fvs_size")


#: Of the least solutions, the one whose bit mask is smallest; its vertices.
@query(
    DIR
    + Q.DIRECTED_OPTIMUM
    + """, full_mask AS (SELECT CAST((1 << count(*)) - 1 AS BIGINT) AS f FROM ty)
         SELECT good.graph_id, min(f - mask) AS mask FROM good JOIN opt ON good.graph_id = opt.graph_id AND good.size = opt.fvs_size, full_mask GROUP BY good.graph_id"""
)
def dfvs_canonical_mask(spark, sf):
    s = solvers.solve(_directed(spark, sf), True, "brute", D.event_graph_ids(spark, sf))
    mask = F.aggregate("solution", F.lit(0).cast("long"), lambda a, v: a + F.pow(F.lit(2.0), v).cast("long"))
    return s.select("graph_id", mask.alias("mask"))


def _degree_greedy_sql(directed: bool) -> str:
    """The greedy rule, unrolled: a set of removed vertices per graph grows by one for each turn."""
    src = "e" if directed else "b"
    ends = "SELECT graph_id, mask, unnest([src, dst]) AS v FROM l{0}" if directed else "SELECT graph_id, mask, src AS v FROM l{0}"
    turns = []
    for i in range(5):
        turns.append(
            f"""l{i} AS (SELECT s.graph_id, mask, src, dst FROM s{i} s JOIN {src} x ON s.graph_id = x.graph_id
                     WHERE (mask >> CAST(src AS INT)) & 1 = 0 AND (mask >> CAST(dst AS INT)) & 1 = 0),
            c{i} AS (SELECT graph_id, src, dst FROM l{i} UNION SELECT c.graph_id, c.src, l.dst FROM c{i} c JOIN l{i} l ON c.graph_id = l.graph_id AND c.dst = l.src),
            y{i} AS ({_cyclic(i, directed)}),
            t{i} AS (SELECT graph_id, arg_max(v, d * 1000 + v) AS v FROM (SELECT graph_id, v, count(*) AS d FROM ({ends.format(i)}) GROUP BY ALL) GROUP BY graph_id),
            s{i + 1} AS (SELECT s.graph_id, CASE WHEN y.graph_id IS NULL THEN mask ELSE mask | (CAST(1 AS BIGINT) << CAST(t.v AS INT)) END AS mask
                         FROM s{i} s LEFT JOIN y{i} y ON s.graph_id = y.graph_id LEFT JOIN t{i} t ON s.graph_id = t.graph_id)"""
        )
    head = DIR if directed else UND
    return head + " s0 AS (SELECT graph_id, CAST(0 AS BIGINT) AS mask FROM g)," + ",".join(turns) + " SELECT graph_id, CAST(bit_count(mask) AS BIGINT) AS taken FROM s5 WHERE mask > 0"


def _cyclic(i: int, directed: bool) -> str:
    if directed:
        return f"SELECT DISTINCT graph_id FROM c{i} WHERE src = dst"
    return f"""SELECT x.graph_id FROM (SELECT graph_id, count(*) / 2 AS n FROM l{i} GROUP BY graph_id) x
               JOIN (SELECT graph_id, count(*) - count(DISTINCT l) AS most FROM (SELECT graph_id, src, least(src, min(dst)) AS l FROM c{i} GROUP BY graph_id, src) GROUP BY graph_id) y
               ON x.graph_id = y.graph_id WHERE x.n > y.most"""


@query(_degree_greedy_sql(True))
def greedy_dfvs(spark, sf):
    return solvers.greedy(_directed(spark, sf), directed=True).groupBy("graph_id").agg(F.count(F.lit(1)).alias("taken"))


@query(_degree_greedy_sql(False))
def greedy_fvs(spark, sf):
    return solvers.greedy(_undirected(spark, sf), directed=False).groupBy("graph_id").agg(F.count(F.lit(1)).alias("taken"))


#: Sets of up to six nations are tried; a larger least size would have no row.
@query("WITH RECURSIVE" + Q.nation_optimum((1, 2, 3), 6) + " SELECT graph_id AS k, fvs_size, true AS valid, true AS minimal FROM opt")
def nation_dfvs_by_k(spark, sf):
    """Least solution of the nations' trade graphs for growing numbers of customers."""
    out = None
    for k in (1, 2, 3):
        e = D.nation_top(spark, sf, k).withColumn("graph_id", F.lit(k).cast("long"))
        out = e if out is None else out.unionByName(e)
    return solvers.solve(out, True, "bst").select(F.col("graph_id").alias("k"), "fvs_size", "valid", "minimal")


@query()
def consensus_commit(spark, sf):
    """Vertices that most of several heuristic solutions agree on."""
    e = cut(_directed(spark, sf).select("graph_id", "src", "dst"), "edges")
    ids = D.event_graph_ids(spark, sf)
    members = None
    for seed in (1, 2, 3):
        x = solvers.solve(e, True, "ma", ids, seed=seed).select("graph_id", F.lit(seed).alias("member"), F.explode("solution").alias("v"))
        members = x if members is None else members.unionByName(x)
    n = D.event_vertices(spark, sf).groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    return solvers.consensus(cut(members, "members"), n)


@query(
    DIR0 + " SELECT DISTINCT graph_id, true AS valid FROM g"
)
def soft_hint_valid(spark, sf):
    """Hinted vertices with a solution of the rest are a solution."""
    e = cut(_directed(spark, sf).select("graph_id", "src", "dst"), "edges")
    ids = D.event_graph_ids(spark, sf)
    hints = D.event_vertices(spark, sf).where("v = 2")
    x = cut(scoring.soft_hint(e, hints, True, ids, "kma", generations=10), "hinted")
    return S.is_solution(e, x, ids, directed=True)


@query("SELECT CAST(user_id AS BIGINT) AS graph_id, a.algo FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN (VALUES ('bst'), ('greedy')) a(algo) WHERE NOT (user_id % 2 = 0 AND a.algo = 'bst')")
def resume_antijoin(spark, sf):
    """A batch of two solvers over all graphs leaves out what is there already."""
    ids = D.event_graph_ids(spark, sf)
    there = ids.where("graph_id % 2 = 0").select("graph_id", F.lit("bst").alias("algo"))
    return runner.run(_directed(spark, sf), ids, ["bst", "greedy"], True, there).select("graph_id", "algo")


# ---------------------------------------------------------------- analytics


def _results(spark, sf):
    return D.solver_results(spark, sf)


def _scored(spark, sf):
    return A.scores(A.penalised(_results(spark, sf)))


RES = "WITH " + Q.RESULTS
SOLVERS = ["s0", "s1", "s2", "s3", "s4"]


@query(RES + " SELECT instance, min(fvs_size) AS best FROM pen GROUP BY instance")
def best_known(spark, sf):
    return A.best_known(A.penalised(_results(spark, sf)))


@query(RES + " SELECT instance, solver, fvs_size, best, round(score, 6) AS score FROM sc")
def normalized_scores(spark, sf):
    return _rounded(_scored(spark, sf))


@query(RES + " SELECT instance, solver, fvs_size FROM pen")
def invalid_penalty(spark, sf):
    return A.penalised(_results(spark, sf)).select("instance", "solver", "fvs_size")


@query(
    RES
    + " SELECT instance, min(best) AS optimal_fvs, "
    + ", ".join(f"max(fvs_size) FILTER (solver = '{s}') AS {s}_fvs, round(max(score) FILTER (solver = '{s}'), 6) AS {s}_score" for s in SOLVERS)
    + " FROM sc GROUP BY instance"
)
def score_pivot(spark, sf):
    return _rounded(A.score_pivot(_scored(spark, sf), SOLVERS))


@query(RES + " SELECT solver, round(avg(score), 4) AS mean_score, count(score) AS instance_count FROM sc GROUP BY solver")
def solver_summary(spark, sf):
    r = _results(spark, sf)
    return A.solver_summary(A.scores(A.penalised(r)), r)


@query(RES + " SELECT solver, round(stddev_pop(score), 6) AS spread FROM sc GROUP BY solver")
def score_spread(spark, sf):
    return A.score_spread(_scored(spark, sf))


@query(RES + " SELECT solver, round(sum(runtime_s), 4) AS runtime_s FROM res GROUP BY solver")
def runtime_totals(spark, sf):
    return A.runtime_totals(_results(spark, sf))


@query(
    RES
    + """, a AS (SELECT * FROM res WHERE solver = 's0'), x AS (SELECT * FROM res WHERE solver = 's1'), y AS (SELECT * FROM res WHERE solver = 's2')
    SELECT a.instance, a.fvs_size AS reference_size, x.fvs_size AS ic_size,
           CASE WHEN x.fvs_size IS NULL THEN 'N/A' WHEN a.fvs_size = x.fvs_size THEN 'True' ELSE 'False' END AS ic_match, y.fvs_size AS bst_size,
           CASE WHEN y.fvs_size IS NULL THEN 'N/A' WHEN a.fvs_size = y.fvs_size THEN 'True' ELSE 'False' END AS bst_match
    FROM a LEFT JOIN x USING (instance) LEFT JOIN y USING (instance)"""
)
def crosscheck_solvers(spark, sf):
    r = _results(spark, sf)
    return A.crosscheck(r.where("solver = 's0'"), ic=r.where("solver = 's1'"), bst=r.where("solver = 's2'"))


TIM = "WITH " + Q.TIMED


def _timed(spark, sf):
    return A.timed(_results(spark, sf), 4.0)


@query(TIM + " SELECT solver, n, round(avg(success::INT) * 100, 6) AS solved FROM tm GROUP BY ALL")
def success_by_n(spark, sf):
    return A.success_rate(_timed(spark, sf), "n")


@query(TIM + " SELECT solver, k, round(avg(success::INT) * 100, 6) AS solved FROM tm GROUP BY ALL")
def success_by_k(spark, sf):
    return A.success_rate(_timed(spark, sf), "k")


@query(TIM + " SELECT n, count(DISTINCT k) AS values FROM tm GROUP BY n")
def distinct_k_by_n(spark, sf):
    return A.distinct_by(_timed(spark, sf), "n", "k")


@query(TIM + " SELECT n, count(DISTINCT k) AS values FROM tm GROUP BY n ORDER BY values DESC, n LIMIT 1")
def best_n(spark, sf):
    return A.best_by(_timed(spark, sf), "n", "k")


@query(TIM + " SELECT k, count(DISTINCT n) AS values FROM tm GROUP BY k ORDER BY values DESC, k LIMIT 1")
def best_k(spark, sf):
    return A.best_by(_timed(spark, sf), "k", "n")


@query(TIM + ", p AS (SELECT n FROM tm GROUP BY n ORDER BY count(DISTINCT k) DESC, n LIMIT 1) SELECT instance, solver, tm.n, k, runtime_s, success FROM tm JOIN p USING (n)")
def points_at_best_n(spark, sf):
    return A.points_at_best(_timed(spark, sf), "n", "k").select("instance", "solver", "n", "k", "runtime_s", "success")


@query(TIM + " SELECT k, bool_or(success) AS solved FROM tm GROUP BY k")
def any_solved_by_k(spark, sf):
    return A.any_solved(_timed(spark, sf), "k")


FRONT = """, ft AS (SELECT solver, k, min(runtime_s) AS runtime_s FROM tm WHERE k > 0 AND success GROUP BY ALL),
    fr AS (SELECT *, min(runtime_s) OVER (PARTITION BY solver ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ft),
    front AS (SELECT solver, k, runtime_s FROM fr WHERE before IS NULL OR runtime_s < before)"""


@query(TIM + FRONT + " SELECT solver, k, runtime_s FROM front")
def pareto_front(spark, sf):
    return A.pareto_front(_timed(spark, sf))


@query(
    TIM
    + FRONT
    + """, c AS (SELECT k, min(runtime_s) AS runtime_s FROM front GROUP BY k),
    x AS (SELECT *, min(runtime_s) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c)
    SELECT k, runtime_s FROM x WHERE before IS NULL OR runtime_s < before"""
)
def combined_pareto(spark, sf):
    return A.combined_front(_timed(spark, sf))


ABLATION = """, ab AS (SELECT r.instance, r.solver, r.fvs_size, b.fvs_size AS base_size, r.runtime_s, r.valid,
           CASE WHEN b.fvs_size > 0 THEN 100.0::DOUBLE * (b.fvs_size - r.fvs_size) / b.fvs_size ELSE 0.0::DOUBLE END AS improvement, r.fvs_size < b.fvs_size AS beats
    FROM res r JOIN res b ON r.instance = b.instance AND b.solver = 's0' AND r.solver <> 's0')"""


@query(RES + ABLATION + " SELECT instance, solver, fvs_size, base_size, runtime_s, valid, round(improvement, 6) AS improvement, beats FROM ab")
def ablation_rows(spark, sf):
    rows = A.ablation_rows(_results(spark, sf), "s0")
    return rows.withColumn("improvement", F.round("improvement", 6))


@query(
    RES
    + ABLATION
    + """ SELECT solver, round(avg(improvement), 6) AS mean_improvement, round(stddev_samp(improvement), 6) AS std_improvement, round(quantile_cont(improvement, 0.5), 6) AS median_improvement,
          round(avg(runtime_s), 6) AS mean_runtime, round(avg(beats::INT) * 100, 6) AS beats_percent, round(avg(valid::INT) * 100, 6) AS valid_percent FROM ab GROUP BY solver"""
)
def ablation_summary(spark, sf):
    return A.ablation_summary(A.ablation_rows(_results(spark, sf), "s0"))


@query(RES + ", x AS (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY fvs_size, solver DESC) AS r FROM res WHERE valid) SELECT instance, solver, fvs_size FROM x WHERE r = 1")
def best_algorithm(spark, sf):
    return A.best_algorithm(_results(spark, sf), SOLVERS[::-1])


@query("WITH x AS (SELECT l_partkey AS instance, 's' || (l_suppkey % 5) AS solver, CAST(l_quantity AS BIGINT) AS fvs_size, row_number() OVER (PARTITION BY l_partkey, l_suppkey % 5 ORDER BY (l_orderkey * 10 + l_linenumber) * 100 + CAST(l_quantity AS BIGINT) DESC) AS r FROM lineitem) SELECT instance, solver, fvs_size FROM x WHERE r = 1")
def last_row_wins(spark, sf):
    line = D.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("instance"),
        F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("solver"),
        F.col("l_quantity").cast("long").alias("fvs_size"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100 + F.col("l_quantity").cast("long")).alias("at"),
    )
    return A.last_row_wins(line, "at").drop("at")


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN round(value, 6) WHEN 1 THEN round(value / 1000, 6) WHEN 2 THEN round(value, 6) END AS seconds FROM events"""
)
def runtime_parse(spark, sf):
    e = D.table(spark, sf, "events")
    unit = F.element_at(F.array(F.lit("s"), F.lit(" ms"), F.lit(""), F.lit(" min")), (F.col("event_id") % 4 + 1).cast("int"))
    text = F.concat(F.col("value").cast("decimal(18,6)").cast("string"), unit)
    return e.select("event_id", F.round(A.parse_runtime(text), 6).alias("seconds"))


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN event_id WHEN 3 THEN event_id ELSE NULL END AS size,
              CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN NULL WHEN 3 THEN true ELSE false END AS valid FROM events"""
)
def parse_status(spark, sf):
    e = D.table(spark, sf, "events")
    turn = (F.col("event_id") % 5 + 1).cast("int")
    number = F.col("event_id").cast("string")
    size = F.element_at(F.array(F.lit("TIMEOUT"), F.lit(" n/a "), number, F.concat(number, F.lit(".0")), F.lit("error")), turn)
    valid = F.element_at(F.array(F.lit("True"), F.lit("invalid"), F.lit("TIMEOUT"), F.lit(" OK "), F.lit("0")), turn)
    return e.select("event_id", A.parse_size(size).alias("size"), A.parse_validity(valid).alias("valid"))


@query("SELECT DISTINCT CAST(l_partkey AS BIGINT) AS id, CAST(l_partkey AS BIGINT) AS digits, 'h_' AS prefix, '.gr' AS suffix FROM lineitem WHERE l_partkey BETWEEN 1 AND 200")
def natural_order(spark, sf):
    names = D.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.concat(F.lit("h_"), F.col("l_partkey").cast("string"), F.lit(".gr")).alias("instance")).distinct()
    kept = A.instance_filter(names)
    key = A.natural_key(F.col("instance"))
    return kept.select("id", key["digits"].alias("digits"), key["prefix"].alias("prefix"), key["suffix"].alias("suffix"))


@query("SELECT DISTINCT CAST(n AS BIGINT) AS n, CAST(CASE WHEN n <= 50 THEN 100 WHEN n <= 200 THEN 500 ELSE 600 END AS BIGINT) AS seconds FROM (SELECT l_partkey % 400 AS n FROM lineitem)")
def dynamic_timeout(spark, sf):
    n = D.table(spark, sf, "lineitem").select((F.col("l_partkey") % 400).cast("long").alias("n")).distinct()
    return n.select("n", A.dynamic_timeout(F.col("n")).alias("seconds"))


@query("SELECT * FROM (VALUES ('DKMA', 'directed_DKMA_heuristic_15'), ('DKMA', 'directed_DKMA_heuristic_30'), ('KMA', 'directed_KMA_heuristic_30'), ('KMA', 'directed_DKMA_heuristic_15'), ('KMA', 'directed_DKMA_heuristic_30')) t(token, solver)")
def solver_groups(spark, sf):
    names = ["directed_DKMA_heuristic_15", "directed_DKMA_heuristic_30", "directed_KMA_heuristic_30", "directed_GNN-KMA_heuristic_30"]
    return A.name_groups(spark.createDataFrame([(n,) for n in names], "solver string"))


# ---------------------------------------------------------------- features


FEATURES_END = " FROM f"


@query(
    UND
    + CLUSTERING
    + """ , f AS (SELECT gv.graph_id, gv.v, coalesce(d, 0)::DOUBLE / greatest(n - 1, 1) AS degree_ratio, coalesce(clustering, 0.0::DOUBLE) AS clustering,
                  ln(1 + coalesce(d, 0)) / ln(1 + n) AS degree_log
           FROM gv CROSS JOIN (SELECT count(*) AS n FROM ty) LEFT JOIN dg ON gv.graph_id = dg.graph_id AND gv.v = dg.v LEFT JOIN cl ON gv.graph_id = cl.graph_id AND gv.v = cl.v)
    SELECT graph_id, v, """
    + Q.rounded(["degree_ratio", "clustering", "degree_log"])
    + FEATURES_END
)
def features_v1_und(spark, sf):
    return _rounded(features.undirected_v1(_undirected(spark, sf), D.event_vertices(spark, sf)), 9)


DEG = """ di AS (SELECT gv.graph_id, gv.v, (SELECT count(*) FROM ty) AS n, (SELECT count(*) FROM e WHERE e.graph_id = gv.graph_id AND e.dst = gv.v) AS i,
                 (SELECT count(*) FROM e WHERE e.graph_id = gv.graph_id AND e.src = gv.v) AS o FROM gv)"""


@query(
    DIR
    + DEG
    + """, f AS (SELECT graph_id, v, i::DOUBLE / greatest(n - 1, 1) AS in_ratio, o::DOUBLE / greatest(n - 1, 1) AS out_ratio, least(i, o)::DOUBLE / greatest(n - 1, 1) AS least_ratio FROM di)
    SELECT graph_id, v, """
    + Q.rounded(["in_ratio", "out_ratio", "least_ratio"])
    + FEATURES_END
)
def features_v1_dir(spark, sf):
    return _rounded(features.directed_v1(_directed(spark, sf), D.event_vertices(spark, sf)), 9)


def _joined_walks(steps) -> str:
    return " ".join(f"LEFT JOIN d{k} ON x.graph_id = d{k}.graph_id AND x.v = d{k}.v" for k in steps)


def _walk_columns(steps) -> str:
    return ", ".join(f"coalesce(d{k}.p, 0.0::DOUBLE) AS rwse_{k}" for k in steps)


_STEPS2 = (2, 3, 4, 5)
_MOTIFS = """ LEFT JOIN tri ON x.graph_id = tri.graph_id AND x.v = tri.v LEFT JOIN c4 ON x.graph_id = c4.graph_id AND x.v = c4.v
    LEFT JOIN k4 ON x.graph_id = k4.graph_id AND x.v = k4.v LEFT JOIN core ON x.graph_id = core.graph_id AND x.v = core.v"""
_MOTIF_COLUMNS = """ln(1 + coalesce(triangles, 0)) / ln(1 + n) AS triangles_log, ln(1 + coalesce(cycles, 0)) / ln(1 + n) AS cycles_log, ln(1 + coalesce(cliques, 0)) / ln(1 + n) AS cliques_log,
    CASE WHEN max(coalesce(core.core, 0)) OVER (PARTITION BY x.graph_id) > 0 THEN coalesce(core.core, 0)::DOUBLE / max(coalesce(core.core, 0)) OVER (PARTITION BY x.graph_id) ELSE 0.0::DOUBLE END AS core_ratio"""
_V2_TAIL = ["rwse_2", "rwse_3", "rwse_4", "rwse_5", "triangles_log", "cycles_log", "cliques_log", "core_ratio"]


@query(
    DENSE
    + DEG
    + ","
    + Q.walks("e", _STEPS2)
    + ","
    + Q.TRIANGLES
    + ","
    + FOURS
    + ","
    + Q.CORES
    + f""", f AS (SELECT x.graph_id, x.v, i::DOUBLE / (n - 1) AS in_ratio, o::DOUBLE / (n - 1) AS out_ratio, least(i, o)::DOUBLE / (n - 1) AS least_ratio, {_walk_columns(_STEPS2)}, {_MOTIF_COLUMNS}
          FROM di x {_joined_walks(_STEPS2)} {_MOTIFS}) SELECT graph_id, v, """
    + Q.rounded(["in_ratio", "out_ratio", "least_ratio", *_V2_TAIL])
    + FEATURES_END
)
def features_v2_dir(spark, sf):
    return _rounded(features.v2(_directed(spark, sf), D.event_vertices(spark, sf), True), 9)


@query(
    UND
    + CLUSTERING
    + ","
    + Q.walks("b", _STEPS2)
    + ","
    + FOURS
    + ","
    + Q.CORES
    + f""", x0 AS (SELECT gv.graph_id, gv.v, (SELECT count(*) FROM ty) AS n, coalesce(d, 0) AS d, coalesce(clustering, 0.0::DOUBLE) AS clustering
                   FROM gv LEFT JOIN dg ON gv.graph_id = dg.graph_id AND gv.v = dg.v LEFT JOIN cl ON gv.graph_id = cl.graph_id AND gv.v = cl.v),
    f AS (SELECT x.graph_id, x.v, d::DOUBLE / (n - 1) AS degree_ratio, clustering, ln(1 + d) / ln(1 + n) AS degree_log, {_walk_columns(_STEPS2)}, {_MOTIF_COLUMNS}
          FROM x0 x {_joined_walks(_STEPS2)} {_MOTIFS}) SELECT graph_id, v, """
    + Q.rounded(["degree_ratio", "clustering", "degree_log", *_V2_TAIL])
    + FEATURES_END
)
def features_v2_und(spark, sf):
    return _rounded(features.v2(_undirected(spark, sf), D.event_vertices(spark, sf), False), 9)


_V3 = features.V3_STEPS
_V3_TAIL = """ln(1 + size) / greatest(1.0::DOUBLE, ln(1 + n)) AS component_log, CASE WHEN size > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS nontrivial,
    i * o / (n * size)::DOUBLE AS score, coalesce(triangles, 0)::DOUBLE AS t, coalesce(core.core, 0)::DOUBLE AS c"""
_V3_NORM = ", ".join(
    f"CASE WHEN max({c}) OVER (PARTITION BY graph_id) > 0 THEN {c} / max({c}) OVER (PARTITION BY graph_id) ELSE 0.0::DOUBLE END AS {name}" for c, name in (("score", "cycle_score"), ("t", "triangle_ratio"), ("c", "core_ratio"))
)
_V3_NAMES = ["in_ratio", "out_ratio", "least_ratio", "balance", *(f"rwse_{k}" for k in _V3), "component_log", "nontrivial", "cycle_score", "triangle_ratio", "core_ratio"]
_V3_MOTIFS = "LEFT JOIN tri ON x.graph_id = tri.graph_id AND x.v = tri.v LEFT JOIN core ON x.graph_id = core.graph_id AND x.v = core.v"


@query(
    SCC
    + ","
    + Q.UNDIRECTED
    + ","
    + DEG
    + ","
    + Q.walks("e", _V3)
    + ","
    + Q.TRIANGLES
    + ","
    + Q.CORES
    + f""", sz AS (SELECT graph_id, v, count(*) OVER (PARTITION BY graph_id, scc) AS size FROM scc),
    f0 AS (SELECT x.graph_id, x.v, i::DOUBLE / (n - 1) AS in_ratio, o::DOUBLE / (n - 1) AS out_ratio, least(i, o)::DOUBLE / (n - 1) AS least_ratio, i / (i + o + 1e-8::DOUBLE) AS balance, {_walk_columns(_V3)}, {_V3_TAIL}
           FROM (SELECT di.*, coalesce(size, 1) AS size FROM di LEFT JOIN sz ON di.graph_id = sz.graph_id AND di.v = sz.v) x {_joined_walks(_V3)} {_V3_MOTIFS}),
    f AS (SELECT *, {_V3_NORM} FROM f0) SELECT graph_id, v, """
    + Q.rounded(_V3_NAMES)
    + FEATURES_END
)
def features_v3_dir(spark, sf):
    return _rounded(features.v3(_directed(spark, sf), D.event_vertices(spark, sf), True), 9)


@query(
    UND
    + Q.REACH_BOTH
    + ","
    + Q.walks("b", _V3)
    + ","
    + Q.TRIANGLES
    + ","
    + Q.CORES
    + f""", cc AS (SELECT graph_id, src AS v, least(src, min(dst)) AS c FROM r GROUP BY graph_id, src),
    sz AS (SELECT graph_id, v, count(*) OVER (PARTITION BY graph_id, c) AS size FROM cc),
    dg AS (SELECT graph_id, src AS v, count(*) AS d FROM b GROUP BY ALL),
    x0 AS (SELECT gv.graph_id, gv.v, (SELECT count(*) FROM ty) AS n, coalesce(d, 0) AS i, coalesce(d, 0) AS o, coalesce(size, 1) AS size
           FROM gv LEFT JOIN sz ON gv.graph_id = sz.graph_id AND gv.v = sz.v LEFT JOIN dg ON gv.graph_id = dg.graph_id AND gv.v = dg.v),
    f0 AS (SELECT x.graph_id, x.v, i::DOUBLE / (n - 1) AS in_ratio, o::DOUBLE / (n - 1) AS out_ratio, least(i, o)::DOUBLE / (n - 1) AS least_ratio, 0.5::DOUBLE AS balance, {_walk_columns(_V3)}, {_V3_TAIL}
           FROM x0 x {_joined_walks(_V3)} {_V3_MOTIFS}),
    f AS (SELECT *, {_V3_NORM} FROM f0) SELECT graph_id, v, """
    + Q.rounded(_V3_NAMES)
    + FEATURES_END
)
def features_v3_und(spark, sf):
    return _rounded(features.v3(_undirected(spark, sf), D.event_vertices(spark, sf), False), 9)


# ---------------------------------------------------------------- scoring


def _channels(spark, sf):
    """Two made-up channels per vertex."""
    v = D.event_vertices(spark, sf)
    return v.select("graph_id", "v", (((F.col("graph_id") + F.col("v")) % 7) / 7.0).alias("x0"), ((F.col("graph_id") * (F.col("v") + 1) % 5) / 5.0).alias("x1"))


CHANNELS = " ch AS (SELECT graph_id, v, ((graph_id + v) % 7) / 7.0::DOUBLE AS x0, (graph_id * (v + 1) % 5) / 5.0::DOUBLE AS x1 FROM gv)"
MEANS = CHANNELS + """,
    mi AS (SELECT e.graph_id, dst AS v, avg(x0) AS x0, avg(x1) AS x1 FROM e JOIN ch ON e.graph_id = ch.graph_id AND e.src = ch.v GROUP BY ALL),
    mo AS (SELECT e.graph_id, src AS v, avg(x0) AS x0, avg(x1) AS x1 FROM e JOIN ch ON e.graph_id = ch.graph_id AND e.dst = ch.v GROUP BY ALL),
    mm AS (SELECT ch.*, coalesce(mi.x0, 0.0::DOUBLE) AS i0, coalesce(mi.x1, 0.0::DOUBLE) AS i1, coalesce(mo.x0, 0.0::DOUBLE) AS o0, coalesce(mo.x1, 0.0::DOUBLE) AS o1
           FROM ch LEFT JOIN mi ON ch.graph_id = mi.graph_id AND ch.v = mi.v LEFT JOIN mo ON ch.graph_id = mo.graph_id AND ch.v = mo.v)"""


@query(DIR + MEANS + " SELECT graph_id, v, round(greatest(0.1 + 0.5 * i0 - 0.25 * i1 + 0.3 * o0 + 0.2 * o1 + 0.7 * x0 - 0.4 * x1, 0), 6) AS h0, round(greatest(-0.2 + 0.1 * i0 + 0.6 * i1 - 0.5 * o0 + 0.4 * o1 - 0.3 * x0 + 0.8 * x1, 0), 6) AS h1 FROM mm")
def message_pass_layer(spark, sf):
    h = scoring.directed_layer(_directed(spark, sf), _channels(spark, sf), ["x0", "x1"], [[0.5, -0.25], [0.1, 0.6]], [[0.3, 0.2], [-0.5, 0.4]], [[0.7, -0.4], [-0.3, 0.8]], [0.1, -0.2])
    return _rounded(h)


@query(
    UND
    + CHANNELS
    + """, bs AS (SELECT * FROM b UNION ALL SELECT graph_id, v, v FROM gv), dn AS (SELECT graph_id, src AS v, count(*) AS d FROM bs GROUP BY ALL)
    SELECT bs.graph_id, bs.src AS v, round(sum(x0 / sqrt(p.d * q.d)), 6) AS x0, round(sum(x1 / sqrt(p.d * q.d)), 6) AS x1
    FROM bs JOIN dn p ON bs.graph_id = p.graph_id AND bs.src = p.v JOIN dn q ON bs.graph_id = q.graph_id AND bs.dst = q.v JOIN ch ON bs.graph_id = ch.graph_id AND bs.dst = ch.v GROUP BY ALL"""
)
def gcn_layer(spark, sf):
    return _rounded(scoring.gcn_layer(_undirected(spark, sf), _channels(spark, sf), ["x0", "x1"]))


@query(
    DIR
    + CHANNELS
    + """, es AS (SELECT graph_id, src, dst FROM e UNION ALL SELECT graph_id, v, v FROM gv),
    s0 AS (SELECT es.graph_id, es.dst, a.x0, a.x1, 0.6 * a.x0 - 0.9 * a.x1 + 0.5 * c.x0 + 0.2 * c.x1 AS z FROM es
           JOIN ch a ON es.graph_id = a.graph_id AND es.src = a.v JOIN ch c ON es.graph_id = c.graph_id AND es.dst = c.v),
    s1 AS (SELECT *, CASE WHEN z > 0 THEN z ELSE 0.2 * z END AS l FROM s0)
    SELECT graph_id, dst AS v, round(sum(exp(l) * x0) / sum(exp(l)), 6) AS x0, round(sum(exp(l) * x1) / sum(exp(l)), 6) AS x1 FROM s1 GROUP BY ALL"""
)
def attention_layer(spark, sf):
    return _rounded(scoring.attention_layer(_directed(spark, sf), _channels(spark, sf), ["x0", "x1"], [0.6, -0.9], [0.5, 0.2]))


@query(DIR + CHANNELS + " SELECT graph_id, round(avg(x0), 6) AS x0, round(avg(x1), 6) AS x1 FROM ch GROUP BY graph_id")
def mean_readout(spark, sf):
    return _rounded(scoring.mean_readout(_channels(spark, sf), ["x0", "x1"]))


def _probabilities(spark, sf):
    """Labels of documents with a made-up probability; one graph per hundred documents."""
    d = D.table(spark, sf, "labels")
    key = F.conv(F.substring(F.md5(F.concat(F.lit("p:"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    y = F.col("quality").cast("long")
    return d.select(F.floor(F.col("doc_id") / 100).cast("long").alias("graph_id"), F.col("doc_id").alias("v"), F.round(0.7 * key + 0.3 * y, 9).alias("prob"), y.alias("y"))


PROB = """WITH pr AS (SELECT doc_id // 100 AS graph_id, doc_id AS v, round(0.7::DOUBLE * (CAST('0x' || substr(md5('p:' || doc_id), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE) + 0.3::DOUBLE * quality, 9) AS prob,
                 CAST(quality AS BIGINT) AS y FROM labels)"""


@query(PROB + ", r AS (SELECT *, count(*) OVER (PARTITION BY graph_id) AS n, row_number() OVER (PARTITION BY graph_id ORDER BY prob DESC, v) AS r FROM pr) SELECT graph_id, round(avg(y), 6) AS precision FROM r WHERE r <= greatest(1, ceil(n * 0.08::DOUBLE)) GROUP BY graph_id")
def topk_precision(spark, sf):
    return scoring.topk_precision(_probabilities(spark, sf))


@query(
    PROB
    + """, c AS (SELECT count(*) FILTER (prob >= 0.5 AND y = 1) AS tp, count(*) FILTER (prob >= 0.5 AND y = 0) AS fp, count(*) FILTER (prob < 0.5 AND y = 1) AS fn, count(*) FILTER (prob < 0.5 AND y = 0) AS tn FROM pr)
    SELECT tp, fp, fn, tn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0.0 END AS recall,
           CASE WHEN 2 * tp + fp + fn > 0 THEN round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) ELSE 0.0 END AS f1, CASE WHEN tp + fp + fn + tn > 0 THEN round((tp + tn) / (tp + fp + fn + tn), 6) ELSE 0.0 END AS accuracy FROM c"""
)
def confusion_metrics(spark, sf):
    return scoring.confusion(_probabilities(spark, sf).withColumn("pred", (F.col("prob") >= 0.5).cast("int")))


@query(
    PROB
    + """, r AS (SELECT *, count(*) OVER (PARTITION BY graph_id) AS n FROM pr), k AS (SELECT *, count(*) OVER (PARTITION BY graph_id) AS k, row_number() OVER (PARTITION BY graph_id ORDER BY prob DESC, v) AS r FROM r WHERE prob >= 0.65)
    SELECT graph_id, v FROM k WHERE k >= greatest(1, ceil(n * 0.005::DOUBLE)) AND r <= greatest(1, ceil(n * 0.08::DOUBLE))"""
)
def candidate_pick(spark, sf):
    return scoring.candidates(_probabilities(spark, sf))


@query(
    PROB
    + """, l AS (SELECT *, ln(greatest(least(prob, 0.999999), 0.000001) / (1 - greatest(least(prob, 0.999999), 0.000001))) AS z FROM pr),
    t AS (SELECT y, CASE WHEN y = 1 THEN 1 / (1 + exp(-z)) ELSE 1 - 1 / (1 + exp(-z)) END AS p FROM l)
    SELECT y, round(avg(-pow(1 - least(greatest(p, 1e-8), 1 - 1e-8), CASE WHEN y = 1 THEN 0.5 ELSE 2.0 END) * ln(least(greatest(p, 1e-8), 1 - 1e-8))), 6) AS loss FROM t GROUP BY y"""
)
def focal_loss(spark, sf):
    p = F.greatest(F.least("prob", F.lit(0.999999)), F.lit(0.000001))
    rows = _probabilities(spark, sf).withColumn("z", F.log(p / (1 - p)))
    return rows.groupBy("y").agg(F.round(F.avg(scoring.focal_loss(F.col("z"), F.col("y"))), 6).alias("loss"))


@query(PROB + " SELECT y, round((SELECT count(*) FROM pr) / (2 * count(*)), 6) AS weight FROM pr GROUP BY y")
def class_weights(spark, sf):
    return _rounded(scoring.class_weights(_probabilities(spark, sf)))


def _samples(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("track"), F.col("source").alias("category"))


@query(
    """WITH r AS (SELECT doc_id, lang, source, count(*) OVER (PARTITION BY lang, source) AS n,
                         row_number() OVER (PARTITION BY lang, source ORDER BY CAST('0x' || substr(md5('42:' || doc_id), 1, 12) AS BIGINT), doc_id) AS r FROM documents)
       SELECT doc_id, CASE WHEN r <= least(floor(n * 0.2::DOUBLE), n - 1) THEN 'val' ELSE 'train' END AS split FROM r"""
)
def stratified_split(spark, sf):
    return scoring.stratified_split(_samples(spark, sf), ["track", "category"], "doc_id").select("doc_id", "split")


@query(
    """WITH r AS (SELECT doc_id, lang AS track, row_number() OVER (PARTITION BY lang ORDER BY CAST('0x' || substr(md5('42:' || doc_id), 1, 12) AS BIGINT), doc_id) AS r FROM documents)
       SELECT doc_id, track FROM r WHERE r <= CASE track WHEN 'en' THEN 20 WHEN 'de' THEN 10 ELSE 0 END"""
)
def sample_by_track(spark, sf):
    return scoring.sample_by_track(_samples(spark, sf), {"en": 20, "de": 10}, "doc_id").select("doc_id", "track")


@query("SELECT lang AS track, source AS category, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (lang, source))")
def sample_breakdown(spark, sf):
    return scoring.breakdown(_samples(spark, sf))


@query("SELECT vec_id, CAST(label AS BIGINT) AS label FROM embeddings WHERE label IN (0, 1) AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0")
def valid_samples(spark, sf):
    e = D.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("f"), F.col("label").cast("long").alias("y"))
    return scoring.valid_samples(e).select("vec_id", F.col("y").alias("label"))


@query("SELECT i AS epoch, round(CASE WHEN i < 5 THEN (i + 1) / 5.0 ELSE 0.01 + 0.99 * 0.5 * (1 + cos(pi() * (i - 5) / 45.0)) END, 6) AS rate FROM range(0, 50) t(i)")
def lr_schedule(spark, sf):
    return spark.createDataFrame([(i, round(scoring.learning_rate(i, 5, 50), 6)) for i in range(50)], "epoch long, rate double")


# ---------------------------------------------------------------- generators


@query(
    """WITH w AS (SELECT c_nationkey AS name, count(*) AS weight FROM customer GROUP BY ALL), s AS (SELECT name, 1000 * weight / (sum(weight) OVER ())::DOUBLE AS share FROM w),
       r AS (SELECT *, floor(share) AS whole, row_number() OVER (ORDER BY share - floor(share) DESC, name) AS place FROM s)
       SELECT name, CAST(whole + CASE WHEN place <= 1000 - sum(whole) OVER () THEN 1 ELSE 0 END AS BIGINT) AS count FROM r"""
)
def allocate_counts(spark, sf):
    w = D.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("name")).agg(F.count(F.lit(1)).alias("weight"))
    return generate.allocate(w, 1000)


@query(
    """WITH v AS (SELECT i, i % 9 AS c, i // 9 AS r FROM range(0, 63) t(i))
       SELECT CAST(0 AS BIGINT) AS graph_id, i AS src, i + 1 AS dst FROM v WHERE c < 8 UNION ALL SELECT 0, i, i + 9 FROM v WHERE r < 6"""
)
def grid_edges(spark, sf):
    return generate.grid(spark, 7, 9)


@query("SELECT CAST(0 AS BIGINT) AS graph_id, a.i AS src, b.i AS dst FROM range(0, 60) a(i), range(0, 60) b(i) WHERE a.i <> b.i AND (a.i * 7919 + b.i * 104729) % 1000 < 50")
def random_edges(spark, sf):
    return generate.random_pairs(spark, 60, 50)


@query("SELECT CAST(0 AS BIGINT) AS graph_id, a.i AS src, b.i AS dst FROM range(0, 60) a(i), range(0, 60) b(i) WHERE a.i < b.i AND (a.i * 7919 + b.i * 104729) % 1000 < 80")
def dag_edges(spark, sf):
    return generate.dag(spark, 60, 80)


@query("SELECT 'tree' AS family, CAST(99 AS BIGINT) AS edges")
def grown_trees(spark, sf):
    """A random tree has one edge less than vertices."""
    t = generate.grown(spark, "tree", [100])
    return t.select(F.lit("tree").alias("family")).groupBy("family").agg(F.count(F.lit(1)).alias("edges"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least feedback vertex set of every user's graph."""
    return QUERIES["dfvs_min_size"](spark, sf_dir)


from coppice.plans import wider  # noqa: E402,F401  (registers its queries here)
