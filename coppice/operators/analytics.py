"""Result analytics: scores, summaries, cross-checks, fronts and success rates.

A results table has ``instance, solver, fvs_size`` and, where needed, ``n, runtime_s, valid``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: what stands for "no value" in result files
SIZE_NULLS = ("", "N/A", "TIMEOUT", "ERROR", "NONE")
COUNT_NULLS = ("", "N/A", "UNKNOWN", "NONE")
TRUE_WORDS = ("true", "1", "yes", "valid", "ok", "success")
FALSE_WORDS = ("false", "0", "no", "invalid", "failed")


def parse_size(text: Column) -> Column:
    """Integers, integer-looking floats; tokens for no value, and anything else, are null."""
    t = F.trim(text)
    return F.when(F.upper(t).isin(*SIZE_NULLS), F.lit(None)).otherwise(t.try_cast("double").try_cast("long"))


def parse_count(text: Column) -> Column:
    t = F.trim(text)
    return F.when(F.upper(t).isin(*COUNT_NULLS), F.lit(None)).otherwise(t.try_cast("double").try_cast("long"))


def parse_validity(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin(*TRUE_WORDS), F.lit(True)).when(t.isin(*FALSE_WORDS), F.lit(False))


def parse_runtime(text: Column) -> Column:
    """Seconds from ``12``, ``12s`` or ``340ms``; anything else is null."""
    t = F.lower(F.trim(text))
    number = F.regexp_extract(t, r"^([0-9.eE+-]+)\s*(ms|s)?$", 1).try_cast("double")
    return F.when(F.regexp_extract(t, r"^([0-9.eE+-]+)\s*(ms|s)?$", 2) == "ms", number / 1000).otherwise(number)


def natural_key(name: Column) -> Column:
    """Sort key of ``(digits, prefix, suffix)``: ``h_2`` before ``h_10``; names without digits come last."""
    digits = F.regexp_extract(name, r"^(\D*)(\d+)(.*)$", 2).try_cast("long")
    return F.struct(
        F.coalesce(digits, F.lit((1 << 63) - 1)).alias("digits"),
        F.when(digits.isNull(), name).otherwise(F.regexp_extract(name, r"^(\D*)(\d+)(.*)$", 1)).alias("prefix"),
        F.regexp_extract(name, r"^(\D*)(\d+)(.*)$", 3).alias("suffix"),
    )


def instance_filter(results: DataFrame, low: int = 1, high: int = 200, any_name: bool = False) -> DataFrame:
    """Rows whose instance is ``h_<number>`` within a range, or all."""
    if any_name:
        return results
    number = F.regexp_extract("instance", r"^h_(\d+)", 1).try_cast("int")
    return results.where(number.between(low, high))


def last_row_wins(results: DataFrame, order: str) -> DataFrame:
    """Of rows of one instance and solver, the last."""
    w = Window.partitionBy("instance", "solver").orderBy(F.col(order).desc())
    return results.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def penalised(results: DataFrame) -> DataFrame:
    """Rows with a size: an invalid answer counts as n, and goes where n is unknown."""
    size = F.when(F.coalesce(F.col("valid"), F.lit(True)), F.col("fvs_size")).otherwise(F.col("n"))
    return results.withColumn("fvs_size", size).where(F.col("fvs_size").isNotNull())


def best_known(results: DataFrame) -> DataFrame:
    return results.groupBy("instance").agg(F.min("fvs_size").alias("best"))


def scores(results: DataFrame) -> DataFrame:
    """``instance, solver, fvs_size, best, score``: 100 * best / size; a best of 0 gives 100 or 0."""
    best = F.min("fvs_size").over(Window.partitionBy("instance"))
    r = results.withColumn("best", best)
    score = (
        F.when((F.col("best") == 0) & (F.col("fvs_size") == 0), 100.0)
        .when(F.col("best") == 0, 0.0)
        .when(F.col("fvs_size") > 0, F.lit(100.0) * F.col("best") / F.col("fvs_size"))
    )
    return r.select("instance", "solver", "fvs_size", "best", score.alias("score"))


def score_pivot(scored: DataFrame, solvers: list[str]) -> DataFrame:
    """``instance, optimal_fvs, {solver}_fvs, {solver}_score``."""
    wide = scored.groupBy("instance").agg(
        F.min("best").alias("optimal_fvs"),
        *(
            F.max(F.when(F.col("solver") == s, F.col(c))).alias(f"{s}_{name}")
            for s in solvers
            for c, name in (("fvs_size", "fvs"), ("score", "score"))
        ),
    )
    return wide


def solver_summary(scored: DataFrame, solvers: DataFrame) -> DataFrame:
    """``solver, mean_score, instance_count`` for every solver; no score gives null and 0."""
    s = scored.groupBy("solver").agg(F.round(F.avg("score"), 4).alias("mean_score"), F.count("score").alias("instance_count"))
    return solvers.select("solver").distinct().join(s, "solver", "left").select("solver", "mean_score", F.coalesce("instance_count", F.lit(0)).alias("instance_count"))


def score_spread(scored: DataFrame) -> DataFrame:
    return scored.groupBy("solver").agg(F.round(F.stddev_pop("score"), 6).alias("spread"))


def runtime_totals(results: DataFrame) -> DataFrame:
    return results.groupBy("solver").agg(F.round(F.sum("runtime_s"), 4).alias("runtime_s"))


def crosscheck(reference: DataFrame, **others: DataFrame) -> DataFrame:
    """The reference's sizes beside each other solver's and ``{name}_match`` (True, False, N/A)."""
    out = reference.select("instance", F.col("fvs_size").alias("reference_size"))
    for name, table in others.items():
        out = out.join(table.select("instance", F.col("fvs_size").alias(f"{name}_size")), "instance", "left")
        same = F.when(F.col("reference_size").isNull() | F.col(f"{name}_size").isNull(), "N/A").when(F.col("reference_size") == F.col(f"{name}_size"), "True").otherwise("False")
        out = out.withColumn(f"{name}_match", same)
    return out


def timed(results: DataFrame, limit: float = 10.0) -> DataFrame:
    """``n, k, runtime_s, success``: size-0 rows go; beyond the limit, or without a size (k = -1), is no success."""
    k = F.coalesce(F.col("fvs_size"), F.lit(-1)).cast("long")
    slow = (F.col("runtime_s") > limit) | (k == -1)
    return results.where(k != 0).select("instance", "solver", "n", k.alias("k"), F.least("runtime_s", F.lit(limit)).alias("runtime_s"), (~slow).alias("success"))


def success_rate(timed_rows: DataFrame, by: str) -> DataFrame:
    """``solver, {by}, solved`` in percent."""
    return timed_rows.groupBy("solver", by).agg(F.round(F.avg(F.col("success").cast("int")) * 100, 6).alias("solved"))


def distinct_by(timed_rows: DataFrame, by: str, what: str) -> DataFrame:
    return timed_rows.groupBy(by).agg(F.count_distinct(what).alias("values"))


def best_by(timed_rows: DataFrame, by: str, what: str) -> DataFrame:
    """The value of ``by`` with most distinct ``what``; ties to the smallest."""
    return distinct_by(timed_rows, by, what).orderBy(F.col("values").desc(), F.col(by)).limit(1)


def points_at_best(timed_rows: DataFrame, by: str, what: str) -> DataFrame:
    return timed_rows.join(F.broadcast(best_by(timed_rows, by, what).select(by)), by, "left_semi")


def any_solved(timed_rows: DataFrame, by: str) -> DataFrame:
    return timed_rows.groupBy(by).agg(F.bool_or("success").alias("solved"))


def pareto_front(points: DataFrame, keys: tuple[str, ...] = ("solver",)) -> DataFrame:
    """``keys, k, runtime_s``: points faster than all of smaller or equal k; one of equal points.

    Per k only the fastest can be on a front, so the ordered window runs over distinct k.
    """
    least = points.where("k > 0 and success").groupBy(*keys, "k").agg(F.min("runtime_s").alias("runtime_s"))
    w = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    front = least.withColumn("before", F.min("runtime_s").over(w))
    return front.where("before is null or runtime_s < before").select(*keys, "k", "runtime_s")


def combined_front(points: DataFrame) -> DataFrame:
    fronts = pareto_front(points).select("k", "runtime_s", F.lit(True).alias("success"))
    return pareto_front(fronts.withColumn("all", F.lit(0)), ("all",)).select("k", "runtime_s")


# fixed values: tokens of solver names that name no group
TRIVIAL_TOKENS = ("SOLVER", "MODEL", "HEURISTIC", "DIRECTED", "UNDIRECTED", "SUMMARY", "15", "30", "60", "90")


def name_groups(solvers: DataFrame, least: int = 2) -> DataFrame:
    """``token, solver``: solvers whose name holds a token that occurs ``least`` times or more.

    ``KMA`` leaves out names with ``gnn``; ``MA`` those with ``gnn`` or ``kma``.
    """
    names = solvers.select("solver").distinct()
    tokens = names.select(F.explode(F.regexp_extract_all(F.upper("solver"), F.lit("[A-Z0-9]+"), F.lit(0))).alias("token"))
    counts = tokens.where(~F.col("token").isin(*TRIVIAL_TOKENS)).groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least)
    text = F.upper("solver")
    gnn, kma = text.contains("GNN"), text.contains("KMA")
    odd = ((F.col("token") == "KMA") & gnn) | ((F.col("token") == "MA") & (gnn | kma))
    # both sides are names of solvers, a handful whatever the number of results
    return names.join(F.broadcast(counts), text.contains(F.col("token")) & ~odd).select("token", "solver")


def ablation_rows(results: DataFrame, baseline: str) -> DataFrame:
    """Each other solver's rows beside the baseline's: ``improvement`` in percent, ``beats``."""
    b = results.where(F.col("solver") == baseline).select("instance", F.col("fvs_size").alias("base_size"))
    j = results.where(F.col("solver") != baseline).join(b, "instance")
    improvement = F.when(F.col("base_size") > 0, 100.0 * (F.col("base_size") - F.col("fvs_size")) / F.col("base_size")).otherwise(0.0)
    return j.select("instance", "solver", "fvs_size", "base_size", "runtime_s", "valid", improvement.alias("improvement"), (F.col("fvs_size") < F.col("base_size")).alias("beats"))


def ablation_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("solver").agg(
        F.round(F.avg("improvement"), 6).alias("mean_improvement"),
        F.round(F.stddev_samp("improvement"), 6).alias("std_improvement"),
        F.round(F.percentile("improvement", F.lit(0.5)), 6).alias("median_improvement"),
        F.round(F.avg("runtime_s"), 6).alias("mean_runtime"),
        F.round(F.avg(F.col("beats").cast("int")) * 100, 6).alias("beats_percent"),
        F.round(F.avg(F.col("valid").cast("int")) * 100, 6).alias("valid_percent"),
    )


def best_algorithm(results: DataFrame, order: list[str]) -> DataFrame:
    """Per instance the valid solver of least size; ties go by ``order``."""
    place = F.array_position(F.array(*(F.lit(x) for x in order)), F.col("solver"))
    top = results.where("valid").groupBy("instance").agg(F.min(F.struct("fvs_size", place.alias("p"), "solver")).alias("b"))
    return top.select("instance", "b.solver", "b.fvs_size")


def dynamic_timeout(n: Column) -> Column:
    """Seconds allowed by graph size."""
    return F.when(n <= 50, 100).when(n <= 200, 500).otherwise(600).cast("long")
