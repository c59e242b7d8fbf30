"""The batch runner: many graphs by many solvers, resumable."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.plans.fixpoint import cut

RESULT_KEY = ["family", "track", "category", "file", "algo", "params"]


def remaining(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work without a result; the whole key counts, since file names repeat between buckets."""
    return work.join(done.select(*keys), keys, "left_anti")


#: What a run leaves: sizes are null and ``valid`` is null where the time was up.
RUN = (
    "graph_id long, algo string, n long, m long, fvs_size long, solution array<long>, valid boolean, status string, "
    "kernel_n long, kernel_s double, search_s double, runtime_ms double, executed_at timestamp"
)
#: Columns of the suite's table.
SUITE = [*RESULT_KEY, "n", "m", "fvs_size", "runtime_ms", "kernel_n", "valid", "status", "executed_at"]


def run(
    edges: DataFrame, ids: DataFrame, algos: list[str], directed: bool, results: DataFrame | None = None, seconds: float | None = None, **options
) -> DataFrame:
    """``RUN`` rows for the pairs of graph and solver that ``results`` lacks; ``seconds`` holds for each pair."""
    from coppice.operators.solvers import EXACT, solve

    out = None
    for algo in algos:
        todo = ids.select("graph_id").distinct()
        if results is not None:
            todo = remaining(todo.withColumn("algo", F.lit(algo)), results, ["graph_id", "algo"]).select("graph_id")
        own = {} if algo in EXACT or algo == "greedy" else options
        part = solve(edges.join(todo, "graph_id", "left_semi"), directed, algo, todo, seconds, **own).withColumn("algo", F.lit(algo))
        part = part.withColumn("runtime_ms", F.round((F.col("kernel_s") + F.col("search_s")) * 1000, 3)).withColumn("executed_at", F.current_timestamp())
        part = part.select(*(x.split()[0] for x in RUN.split(", ")))
        out = part if out is None else out.unionByName(part)
    return out


def append(results: DataFrame, path: str) -> None:
    """Add result rows to a table in the store."""
    results.write.mode("append").parquet(path)


def stored(spark: SparkSession, path: str, schema: DataFrame) -> DataFrame:
    """The rows stored at ``path``; none, with the columns of ``schema``, where nothing was stored yet."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.read.parquet(path)
    return schema.limit(0)


def suite(graphs: DataFrame, edges: DataFrame, algos: list[str], path: str, seconds: float | None = None, **options) -> int:
    """Run every solver on every graph that the table at ``path`` lacks, and append ``SUITE`` rows; the number of new ones.

    ``graphs`` has ``graph_id, family, track, category, file``; family ``directed`` is
    solved as such.  A result is known by the whole of ``RESULT_KEY`` (``params`` are the
    options as JSON), since file names repeat between buckets.  All rows of a call are one
    commit: a call that fails on the way adds nothing and can be run again.
    """
    spark = graphs.sparkSession
    params = json.dumps(options | ({} if seconds is None else {"seconds": seconds}), sort_keys=True)
    graphs = graphs.withColumn("params", F.lit(params))
    out = None
    for directed in (True, False):
        mine = graphs.where((F.col("family") == "directed") == F.lit(directed))
        for algo in algos:
            work = mine.withColumn("algo", F.lit(algo))
            done = stored(spark, path, work.select(*RESULT_KEY))
            todo = cut(remaining(work, done, RESULT_KEY), "todo")
            found = run(edges.join(todo, "graph_id", "left_semi"), todo, [algo], directed, None, seconds, **options)
            rows = todo.drop("algo").join(found, "graph_id").select(*SUITE)
            out = rows if out is None else out.unionByName(rows)
    out = cut(out, "suite")
    n = out.count()
    if n:
        append(out, path)
    return n
