"""Scoring vertices: message passing, losses, metrics, candidate choice and splits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.operators.edges import KEYS, both_ways, canonical, without_vertices

# ---------------------------------------------------------------- message passing


def neighbour_means(edges: DataFrame, features: DataFrame, channels: list[str], directed: bool = True) -> DataFrame:
    """``{c}_in`` and ``{c}_out``: means over predecessors and successors, 0 without any."""
    e = canonical(edges, directed, loops=True)
    e = e if directed else both_ways(e)
    out = features
    for side, here, there in (("in", "dst", "src"), ("out", "src", "dst")):
        sent = e.join(features.withColumnRenamed("v", there), [*KEYS, there])
        mean = sent.groupBy(*KEYS, F.col(here).alias("v")).agg(*(F.avg(c).alias(f"{c}_{side}") for c in channels))
        out = out.join(mean, [*KEYS, "v"], "left")
    zero = F.lit(0.0)
    return out.select(*KEYS, "v", *channels, *(F.coalesce(f"{c}_{s}", zero).alias(f"{c}_{s}") for s in ("in", "out") for c in channels))


def directed_layer(edges: DataFrame, features: DataFrame, channels: list[str], w_in, w_out, w_self, bias, relu: bool = True) -> DataFrame:
    """``W_in mean(preds) + W_out mean(succs) + W_self x + b`` as expressions; weights are ``[out][in]`` lists."""
    m = neighbour_means(edges, features, channels)

    def unit(o: int) -> Column:
        total = F.lit(float(bias[o]))
        for i, c in enumerate(channels):
            total = total + float(w_in[o][i]) * F.col(f"{c}_in") + float(w_out[o][i]) * F.col(f"{c}_out") + float(w_self[o][i]) * F.col(c)
        return F.greatest(total, F.lit(0.0)) if relu else total

    return m.select(*KEYS, "v", *(unit(o).alias(f"h{o}") for o in range(len(bias))))


def gcn_layer(edges: DataFrame, features: DataFrame, channels: list[str]) -> DataFrame:
    """``D^-1/2 (A + I) D^-1/2 x`` on the undirected graph; a vertex counts as its own neighbour."""
    b = both_ways(canonical(edges)).unionByName(features.select(*KEYS, F.col("v").alias("src"), F.col("v").alias("dst")))
    d = b.groupBy(*KEYS, "src").agg(F.count(F.lit(1)).alias("d"))
    j = b.join(d, [*KEYS, "src"]).join(d.select(*KEYS, F.col("src").alias("dst"), F.col("d").alias("e")), [*KEYS, "dst"])
    j = j.join(features.withColumnRenamed("v", "dst"), [*KEYS, "dst"])
    scale = 1.0 / F.sqrt(F.col("d") * F.col("e"))
    return j.groupBy(*KEYS, F.col("src").alias("v")).agg(*(F.sum(scale * F.col(c)).alias(c) for c in channels))


def sage_layer(edges: DataFrame, features: DataFrame, channels: list[str]) -> DataFrame:
    """Means over undirected neighbours beside the vertex's own channels."""
    return neighbour_means(edges, features, channels, directed=False).select(*KEYS, "v", *channels, *(f"{c}_in" for c in channels))


def dense(features: DataFrame, channels: list[str], weights: np.ndarray, bias: np.ndarray, activation: str = "relu") -> DataFrame:
    """A dense layer over wide channels: numpy on Arrow batches."""
    names = [f"h{i}" for i in range(len(bias))]
    w, b = np.asarray(weights, float), np.asarray(bias, float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            y = pdf[channels].to_numpy(float) @ w.T + b
            y = np.maximum(y, 0) if activation == "relu" else 1 / (1 + np.exp(-y)) if activation == "sigmoid" else y
            yield pd.concat([pdf[[*KEYS, "v"]], pd.DataFrame(y, columns=names, index=pdf.index)], axis=1)

    return features.mapInPandas(run, "graph_id long, v long, " + ", ".join(f"{n} double" for n in names))


def attention_layer(edges: DataFrame, features: DataFrame, channels: list[str], a_src, a_dst, slope: float = 0.2) -> DataFrame:
    """One head of attention over predecessors and the vertex itself: softmax of a leaky score, then the weighted sum."""
    e = canonical(edges, True).unionByName(features.select(*KEYS, F.col("v").alias("src"), F.col("v").alias("dst")))
    j = e.join(features.select(*KEYS, F.col("v").alias("src"), *channels), [*KEYS, "src"])
    own = features.select(*KEYS, F.col("v").alias("dst"), sum(float(x) * F.col(c) for x, c in zip(a_dst, channels)).alias("own"))
    j = j.join(own, [*KEYS, "dst"])
    score = sum(float(x) * F.col(c) for x, c in zip(a_src, channels)) + F.col("own")
    j = j.withColumn("s", F.when(score > 0, score).otherwise(slope * score))
    # a first aggregate of maxima keeps the exponentials in range; both are partial sums, no window over a hub
    top = j.groupBy(*KEYS, "dst").agg(F.max("s").alias("top"))
    j = j.join(top, [*KEYS, "dst"]).withColumn("w", F.exp(F.col("s") - F.col("top")))
    sums = j.groupBy(*KEYS, F.col("dst").alias("v")).agg(F.sum("w").alias("z"), *(F.sum(F.col("w") * F.col(c)).alias(c) for c in channels))
    return sums.select(*KEYS, "v", *((F.col(c) / F.col("z")).alias(c) for c in channels))


def mean_readout(features: DataFrame, channels: list[str]) -> DataFrame:
    return features.groupBy(*KEYS).agg(*(F.avg(c).alias(c) for c in channels))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


# ---------------------------------------------------------------- losses and metrics


def class_weights(labels: DataFrame, label: str = "y") -> DataFrame:
    """``label, weight``: n / (2 * count)."""
    return labels.groupBy(label).agg(F.count(F.lit(1)).alias("c")).withColumn("n", F.sum("c").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).select(label, (F.col("n") / (2 * F.col("c"))).alias("weight"))


def focal_loss(logit: Column, y: Column, fp_gamma: float = 2.0, fn_gamma: float = 0.5, eps: float = 1e-8) -> Column:
    """``-(1 - p_t)^gamma log p_t`` with one exponent for each class."""
    p = sigmoid(logit)
    p_t = F.least(F.greatest(F.when(y == 1, p).otherwise(1 - p), F.lit(eps)), F.lit(1 - eps))
    return -F.pow(1 - p_t, F.when(y == 1, fn_gamma).otherwise(fp_gamma)) * F.log(p_t)


def topk_precision(scored: DataFrame, share: float = 0.08, keys=KEYS) -> DataFrame:
    """Share of positives among the ``max(1, ceil(share * n))`` most probable; ties to the smaller v."""
    w = Window.partitionBy(*keys)
    r = scored.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("r", F.row_number().over(w.orderBy(F.col("prob").desc(), "v")))
    return r.where(F.col("r") <= F.greatest(F.lit(1), F.ceil(F.col("n") * share))).groupBy(*keys).agg(F.round(F.avg(F.col("y").cast("double")), 6).alias("precision"))


def confusion(scored: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``tp, fp, fn, tn, precision, recall, f1, accuracy`` of ``pred`` against ``y``."""
    count = {
        "tp": "pred = 1 and y = 1",
        "fp": "pred = 1 and y = 0",
        "fn": "pred = 0 and y = 1",
        "tn": "pred = 0 and y = 0",
    }
    c = scored.groupBy(*keys).agg(*(F.count_if(F.expr(x)).alias(k) for k, x in count.items()))

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)

    tp, fp, fn, tn = (F.col(k) for k in count)
    return c.select(
        *keys, *count, share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2.0 * tp, 2 * tp + fp + fn).alias("f1"), share(tp + tn, tp + fp + fn + tn).alias("accuracy")
    )


# ---------------------------------------------------------------- candidates


def candidates(scored: DataFrame, threshold: float = 0.65, least: float = 0.005, most: float = 0.08, keys=KEYS) -> DataFrame:
    """``keys, v``: probability of the threshold or more, at most ``ceil(most * n)`` by probability; none at all
    where fewer than ``max(1, ceil(least * n))`` qualify."""
    w = Window.partitionBy(*keys)
    s = scored.withColumn("n", F.count(F.lit(1)).over(w))
    s = s.where(F.col("prob") >= threshold).withColumn("k", F.count(F.lit(1)).over(w))
    s = s.withColumn("r", F.row_number().over(w.orderBy(F.col("prob").desc(), "v")))
    enough = F.col("k") >= F.greatest(F.lit(1), F.ceil(F.col("n") * least))
    return s.where(enough & (F.col("r") <= F.greatest(F.lit(1), F.ceil(F.col("n") * most)))).select(*keys, "v")


def soft_hint(edges: DataFrame, hints: DataFrame, directed: bool, ids: DataFrame, algo: str = "kma", **options) -> DataFrame:
    """``graph_id, v``: the hinted vertices and a solution of what is left without them."""
    from coppice.operators.solvers import solve

    rest = without_vertices(canonical(edges, directed, loops=True), hints)
    found = solve(rest, directed, algo, ids, **options)
    return hints.select("graph_id", "v").unionByName(found.select("graph_id", F.explode("solution").alias("v"))).distinct()


# ---------------------------------------------------------------- samples


def stratified_split(rows: DataFrame, strata: list[str], key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """``split``: of each stratum ``floor(share * n)`` rows, by hash of the key, are ``val``; at least one is ``train``."""
    from coppice.operators.structure import random_unit

    w = Window.partitionBy(*strata)
    r = rows.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(random_unit(key, seed=seed), key)))
    cut = F.least(F.floor(F.col("_n") * share), F.col("_n") - 1)
    return r.withColumn("split", F.when(F.col("_r") <= cut, "val").otherwise("train")).drop("_n", "_r")


def sample_by_track(rows: DataFrame, wanted: dict[str, int], key: str, seed: int = 42) -> DataFrame:
    """Up to so many rows of each track, by hash of the key."""
    from coppice.operators.structure import random_unit

    most = F.create_map(*(F.lit(x) for kv in wanted.items() for x in kv))[F.col("track")]
    w = Window.partitionBy("track").orderBy(random_unit(key, seed=seed), key)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def breakdown(rows: DataFrame) -> DataFrame:
    """Counts by track, and by track and category."""
    return rows.groupingSets([["track"], ["track", "category"]], "track", "category").agg(F.count(F.lit(1)).alias("n"))


def learning_rate(epoch: int, warmup: int, total: int, least: float = 0.01) -> float:
    """Share of the base rate: a linear rise, then half a cosine down to ``least``."""
    if epoch < warmup:
        return (epoch + 1) / max(1, warmup)
    done = (epoch - warmup) / max(1, total - warmup)
    return least + (1 - least) * (1 + math.cos(math.pi * done)) / 2


def valid_samples(samples: DataFrame) -> DataFrame:
    """Samples with finite features and a 0/1 label."""
    odd = F.exists("f", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return samples.where(F.col("f").isNotNull() & ~odd & F.col("y").isin(0, 1))


def sample_problems(samples: DataFrame, edges: DataFrame, channels: int) -> DataFrame:
    """``(graph_id, problem)`` for graphs whose samples ``(graph_id, v, f, y)`` cannot be trained on, one row for each problem.

    ``shape``: a feature list that is missing or not ``channels`` long; ``finite``: a
    feature that is null or not finite; ``label``: a label that is not 0 or 1; ``repeat``:
    a vertex with two rows; ``ids``: an edge that ends outside the graph's rows.
    """
    f = F.col("f")
    odd = F.exists(f, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    row = {
        "shape": f.isNull() | (F.size(f) != channels),
        "finite": F.coalesce(odd, F.lit(False)),
        "label": ~F.coalesce(F.col("y").isin(0, 1), F.lit(False)),
    }
    flags = samples.groupBy("graph_id").agg(*(F.bool_or(c).alias(n) for n, c in row.items()), (F.count(F.lit(1)) > F.count_distinct("v")).alias("repeat"))
    named = F.filter(F.array(*(F.when(F.col(n), F.lit(n)) for n in (*row, "repeat"))), lambda x: x.isNotNull())
    found = flags.select("graph_id", F.explode(named).alias("problem"))
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("v")).distinct()
    ends = ends.join(samples.select("graph_id").distinct(), "graph_id", "left_semi").join(samples.select("graph_id", "v"), ["graph_id", "v"], "left_anti")
    return found.unionByName(ends.select("graph_id", F.lit("ids").alias("problem")).distinct())


def train_logistic(samples: DataFrame, channels: list[str], label: str = "y", max_iter: int = 50):
    """A logistic model over the channels, with class weights; returns the fitted ``pyspark.ml`` model."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    weights = class_weights(samples, label)
    rows = samples.join(F.broadcast(weights), label)  # one row per class
    assembled = VectorAssembler(inputCols=channels, outputCol="features_").transform(rows)
    return LogisticRegression(featuresCol="features_", labelCol=label, weightCol="weight", maxIter=max_iter).fit(assembled)
