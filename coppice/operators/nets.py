"""Nets that score vertices, as forward passes: numpy over whole graphs, one graph per row, in workers.

Weights are named arrays with one row per output.  Four kinds cover three generations:
``directed`` and ``undirected`` (three layers of neighbour means, then two classes; 3 or
11 channels) and ``directed_attention`` and ``undirected_attention`` (residual attention
blocks and a mean of the graph beside each vertex; 16 channels).  Hidden width, heads and
layers follow from the weights' shapes.  Norms are those of inference, folded to a scale
and a shift.  A graph too large for a worker is scored by the layers of ``scoring``, which
are joins and aggregates.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.operators import features, scoring, solvers
from coppice.operators.edges import canonical, without_vertices
from coppice.operators.structure import is_solution, random_unit
from coppice.plans.fixpoint import cut

KINDS = ("directed", "undirected", "directed_attention", "undirected_attention")
SLOPE = 0.2

Weights = dict[str, np.ndarray]


# ---------------------------------------------------------------- parts


def linear(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    y = x @ w[f"{name}.weight"].T
    return y + w[f"{name}.bias"] if f"{name}.bias" in w else y


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


def normed(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    return x * w[f"{name}.scale"] + w[f"{name}.shift"]


def fold_norm(mean: np.ndarray, variance: np.ndarray, gamma: np.ndarray, beta: np.ndarray, eps: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Scale and shift of a batch norm at inference."""
    scale = gamma / np.sqrt(variance + eps)
    return scale, beta - mean * scale


def neighbour_mean(x: np.ndarray, sender: np.ndarray, receiver: np.ndarray) -> np.ndarray:
    total, count = np.zeros_like(x), np.zeros(len(x))
    np.add.at(total, receiver, x[sender])
    np.add.at(count, receiver, 1)
    return total / np.maximum(count, 1)[:, None]


def attention(x: np.ndarray, sender: np.ndarray, receiver: np.ndarray, w: Weights, name: str) -> np.ndarray:
    """Heads of attention whose score is taken after the slope, with a loop at each vertex; the heads' mean."""
    heads, width = w[f"{name}.score"].shape
    other = sender != receiver
    every = np.arange(len(x))
    s, r = np.r_[sender[other], every], np.r_[receiver[other], every]
    left = linear(x, w, f"{name}.left").reshape(-1, heads, width)
    right = linear(x, w, f"{name}.right").reshape(-1, heads, width)
    sum_ = left[s] + right[r]
    score = (np.where(sum_ > 0, sum_, SLOPE * sum_) * w[f"{name}.score"]).sum(axis=2)
    top = np.full((len(x), heads), -np.inf)
    np.maximum.at(top, r, score)
    share = np.exp(score - top[r])
    total = np.zeros((len(x), heads))
    np.add.at(total, r, share)
    out = np.zeros((len(x), heads, width))
    np.add.at(out, r, (share / total[r])[:, :, None] * left[s])
    return out.mean(axis=1) + w[f"{name}.bias"]


def residual_block(x: np.ndarray, sender: np.ndarray, receiver: np.ndarray, w: Weights, name: str) -> np.ndarray:
    own = linear(x, w, f"{name}.skip") if f"{name}.skip.weight" in w else x
    return relu(normed(attention(x, sender, receiver, w, f"{name}.attention"), w, f"{name}.norm")) + own


# ---------------------------------------------------------------- nets


def _means_net(x: np.ndarray, src: np.ndarray, dst: np.ndarray, w: Weights, directed: bool) -> np.ndarray:
    h = x
    for i in range(3):
        layer = f"conv{i}"
        if directed:
            parts = ((neighbour_mean(h, src, dst), "in"), (neighbour_mean(h, dst, src), "out"), (h, "self"))
            y = sum(linear(part, w, f"{layer}.{name}") for part, name in parts) + w[f"{layer}.bias"]
        else:
            y = linear(neighbour_mean(h, np.r_[src, dst], np.r_[dst, src]), w, f"{layer}.near") + linear(h, w, f"{layer}.self")
        h = relu(normed(y, w, f"norm{i}"))
    logits = linear(relu(linear(h, w, "head0")), w, "head1")
    # the second class's probability
    return 1 / (1 + np.exp(logits[:, 0] - logits[:, 1]))


def _attention_net(x: np.ndarray, src: np.ndarray, dst: np.ndarray, w: Weights, directed: bool) -> np.ndarray:
    h, i = relu(normed(linear(x, w, "input"), w, "input_norm")), 0
    while any(name.startswith(f"layer{i}.") for name in w):
        layer = f"layer{i}"
        if directed:
            both = [residual_block(h, src, dst, w, f"{layer}.forward"), residual_block(h, dst, src, w, f"{layer}.back"), h]
            h = relu(normed(linear(np.concatenate(both, axis=1), w, f"{layer}.fuse"), w, f"{layer}.norm"))
        else:
            h = residual_block(h, np.r_[src, dst], np.r_[dst, src], w, f"{layer}.both")
        i += 1
    whole = relu(linear(h.mean(axis=0, keepdims=True), w, "readout"))
    y = np.concatenate([h, np.repeat(whole, len(h), axis=0)], axis=1)
    logit = linear(relu(linear(relu(linear(y, w, "head0")), w, "head1")), w, "head2")[:, 0]
    return 1 / (1 + np.exp(-logit))


def forward(kind: str, x: np.ndarray, src: np.ndarray, dst: np.ndarray, w: Weights) -> np.ndarray:
    """Probability of each row of ``x``; ``src`` and ``dst`` are row numbers, each undirected edge once."""
    if kind not in KINDS:
        raise ValueError(f"no such net: {kind}")
    if not len(x):
        return np.zeros(0)
    return (_attention_net if kind.endswith("attention") else _means_net)(x, src, dst, w, kind.startswith("directed"))


def random_weights(kind: str, channels: int, hidden: int, heads: int = 4, layers: int = 5, seed: int = 42) -> Weights:
    """Weights as before any training, drawn by a seed."""
    r, w = np.random.default_rng(seed), {}

    def line(name: str, rows: int, columns: int, bias: bool = True) -> None:
        w[f"{name}.weight"] = r.normal(0, np.sqrt(2 / (rows + columns)), (rows, columns))
        if bias:
            w[f"{name}.bias"] = r.normal(0, 0.1, rows)

    def norm(name: str, width: int) -> None:
        w[f"{name}.scale"], w[f"{name}.shift"] = r.uniform(0.5, 1.5, width), r.normal(0, 0.1, width)

    def block(name: str) -> None:
        line(f"{name}.attention.left", heads * hidden, hidden)
        line(f"{name}.attention.right", heads * hidden, hidden)
        w[f"{name}.attention.score"], w[f"{name}.attention.bias"] = r.normal(0, 1, (heads, hidden)), np.zeros(hidden)
        norm(f"{name}.norm", hidden)

    if kind.endswith("attention"):
        line("input", hidden, channels)
        norm("input_norm", hidden)
        for i in range(layers):
            if kind.startswith("directed"):
                block(f"layer{i}.forward")
                block(f"layer{i}.back")
                line(f"layer{i}.fuse", hidden, 3 * hidden)
                norm(f"layer{i}.norm", hidden)
            else:
                block(f"layer{i}.both")
        line("readout", hidden // 4, hidden)
        line("head0", hidden, hidden + hidden // 4)
        line("head1", hidden // 2, hidden)
        line("head2", 1, hidden // 2)
        return w
    for i in range(3):
        width = hidden if i else channels
        if kind == "directed":
            for name in ("in", "out", "self"):
                line(f"conv{i}.{name}", hidden, width, bias=False)
            w[f"conv{i}.bias"] = r.normal(0, 0.1, hidden)
        else:
            line(f"conv{i}.near", hidden, width)
            line(f"conv{i}.self", hidden, width, bias=False)
        norm(f"norm{i}", hidden)
    line("head0", hidden // 2, hidden)
    line("head1", 2, hidden // 2)
    return w


def save_weights(spark: SparkSession, w: Weights, path: str) -> None:
    """One row per array, as Parquet in the store."""
    rows = [(name, list(x.shape), x.astype(float).ravel().tolist()) for name, x in w.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, value array<double>").write.parquet(path)


def load_weights(spark: SparkSession, path: str) -> Weights:
    """A net's weights; their size is that of the net."""
    return {r["name"]: np.array(r["value"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}


# ---------------------------------------------------------------- graphs


def score(edges: DataFrame, vertices: DataFrame, channels: list[str], kind: str, w: Weights) -> DataFrame:
    """``(graph_id, v, prob)`` for every vertex; null channels count as 0, and edges to other vertices are left out."""
    directed = kind.startswith("directed")
    e = canonical(edges, directed).groupBy("graph_id").agg(F.collect_list(F.struct("src", "dst")).alias("edges"))
    x = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in channels))
    v = vertices.groupBy("graph_id").agg(F.collect_list(F.struct("v", x.alias("x"))).alias("vertices"))
    buffer = io.BytesIO()
    np.savez(buffer, **w)
    stored = buffer.getvalue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = dict(np.load(io.BytesIO(stored)))
        for b in batches:
            for g, vs, es in zip(*(b.column(c).to_pylist() for c in ("graph_id", "vertices", "edges"))):
                vs = sorted(vs, key=lambda r: r["v"])
                at = {r["v"]: i for i, r in enumerate(vs)}
                pairs = [(at[r["src"]], at[r["dst"]]) for r in es or [] if r["src"] in at and r["dst"] in at]
                src, dst = np.array(pairs, np.int64).reshape(-1, 2).T
                p = forward(kind, np.array([r["x"] for r in vs]), src, dst, weights)
                arrays = [pa.array([g] * len(vs), pa.int64()), pa.array([r["v"] for r in vs], pa.int64()), pa.array(p, pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["graph_id", "v", "prob"])

    return v.join(e, "graph_id", "left").select("graph_id", "vertices", "edges").mapInArrow(run, "graph_id long, v long, prob double")


def vertex_features(edges: DataFrame, of: DataFrame, directed: bool, generation: int) -> tuple[DataFrame, list[str]]:
    """The channels that a generation of nets reads, and their names in order."""
    if generation == 1:
        f = (features.directed_v1 if directed else features.undirected_v1)(edges, of)
    else:
        f = (features.v2 if generation == 2 else features.v3)(edges, of, directed)
    return f, [c for c in f.columns if c not in ("graph_id", "v")]


def probabilities(edges: DataFrame, of: DataFrame, directed: bool, w: Weights, generation: int = 3) -> DataFrame:
    """``(graph_id, v, prob)`` by a net of one of the three generations."""
    f, channels = vertex_features(edges, of, directed, generation)
    kind = ("directed" if directed else "undirected") + ("_attention" if generation == 3 else "")
    return score(edges, f, channels, kind, w)


def hinted_solve(
    edges: DataFrame,
    of: DataFrame,
    directed: bool,
    w: Weights,
    generation: int = 3,
    algo: str = "kma",
    threshold: float = 0.65,
    least: float = 0.005,
    most: float = 0.08,
    capped: bool = True,
    seconds: float | None = None,
    **options,
) -> DataFrame:
    """``(graph_id, fvs_size, hinted, solution, valid)``: vertices that a net is sure of are fixed, the rest is searched.

    Hints follow ``scoring.candidates``; without ``capped`` every vertex of the threshold
    or more is one.  With ``algo="dkma"`` and no cap this is the second composition.
    """
    e = cut(canonical(edges, directed, loops=True), "edges")
    ids = cut(of.select("graph_id").distinct(), "ids")
    prob = cut(probabilities(e, of, directed, w, generation), "prob")
    hints = scoring.candidates(prob, threshold, least, most) if capped else prob.where(F.col("prob") >= threshold).select("graph_id", "v")
    hints = cut(hints, "hints")
    rest = solvers.solve(without_vertices(e, hints), directed, algo, ids, seconds, **options).select("graph_id", F.explode("solution").alias("v"))
    chosen = cut(hints.unionByName(rest).distinct(), "chosen")
    sizes = chosen.groupBy("graph_id").agg(F.count(F.lit(1)).alias("fvs_size"), F.array_sort(F.collect_list("v")).alias("solution"))
    n = hints.groupBy("graph_id").agg(F.count(F.lit(1)).alias("hinted"))
    out = is_solution(e, chosen, ids, directed).join(sizes, "graph_id", "left").join(n, "graph_id", "left")
    zero = F.lit(0).cast("long")
    return out.select("graph_id", F.coalesce("fvs_size", zero).alias("fvs_size"), F.coalesce("hinted", zero).alias("hinted"), F.coalesce("solution", F.array().cast("array<long>")).alias("solution"), "valid")


def training_table(edges: DataFrame, of: DataFrame, directed: bool, generation: int = 3, algo: str = "bst", seconds: float | None = None) -> DataFrame:
    """``(graph_id, v, f, y, fvs_size)``: features and whether the vertex is in the solution found.

    Graphs whose search ran out of time, or whose answer is no solution, give no rows.
    """
    f, channels = vertex_features(edges, of, directed, generation)
    found = solvers.solve(edges, directed, algo, of, seconds).where("valid").select("graph_id", "solution", "fvs_size")
    rows = f.select("graph_id", "v", F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in channels)).alias("f")).join(found, "graph_id")
    return rows.select("graph_id", "v", "f", F.array_contains("solution", F.col("v")).cast("int").alias("y"), "fvs_size")


def store_samples(samples: DataFrame, path: str) -> int:
    """Append the samples of graphs that the table at ``path`` lacks; the number of new rows."""
    from coppice.operators.runner import append, stored

    there = stored(samples.sparkSession, path, samples).select("graph_id").distinct()
    new = cut(samples.join(there, "graph_id", "left_anti"), "samples")
    n = new.count()
    if n:
        append(new, path)
    return n


# ---------------------------------------------------------------- training


def _flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[name].ravel() for name in sorted(w)])


def _shaped(x: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for name in sorted(like):
        out[name] = x[at : at + like[name].size].reshape(like[name].shape)
        at += like[name].size
    return out


def _spread_back(g: np.ndarray, sender: np.ndarray, receiver: np.ndarray) -> np.ndarray:
    """What ``neighbour_mean`` hands back to the senders."""
    count, out = np.zeros(len(g)), np.zeros_like(g)
    np.add.at(count, receiver, 1)
    np.add.at(out, sender, (g / np.maximum(count, 1)[:, None])[receiver])
    return out


def gradients(kind: str, x: np.ndarray, src: np.ndarray, dst: np.ndarray, y: np.ndarray, weight: np.ndarray, w: Weights) -> tuple[float, Weights]:
    """Sum of weighted cross entropies over the rows of a graph, and its gradients, for the nets of neighbour means."""
    if kind not in ("directed", "undirected"):
        raise ValueError(f"only nets of neighbour means are trained here, not {kind}")
    directed = kind == "directed"
    ways = {"in": (src, dst), "out": (dst, src)} if directed else {"near": (np.r_[src, dst], np.r_[dst, src])}
    h, held = x, []
    for i in range(3):
        parts = {name: neighbour_mean(h, *way) for name, way in ways.items()} | {"self": h}
        z = sum(linear(part, w, f"conv{i}.{name}") for name, part in parts.items()) + w.get(f"conv{i}.bias", 0.0)
        held.append((parts, z))
        h = relu(normed(z, w, f"norm{i}"))
    u = linear(h, w, "head0")
    logits = linear(relu(u), w, "head1")
    p = 1 / (1 + np.exp(logits[:, 0] - logits[:, 1]))
    loss = -(weight * (y * np.log(np.maximum(p, 1e-12)) + (1 - y) * np.log(np.maximum(1 - p, 1e-12)))).sum()

    g: Weights = {}

    def back(name: str, of: np.ndarray, inputs: np.ndarray) -> np.ndarray:
        g[f"{name}.weight"] = of.T @ inputs
        if f"{name}.bias" in w:
            g[f"{name}.bias"] = of.sum(axis=0)
        return of @ w[f"{name}.weight"]

    one = weight * (p - y)
    d = back("head1", np.stack([-one, one], axis=1), relu(u))
    d = back("head0", d * (u > 0), h)
    for i in reversed(range(3)):
        parts, z = held[i]
        d = d * (normed(z, w, f"norm{i}") > 0)
        g[f"norm{i}.scale"], g[f"norm{i}.shift"] = (d * z).sum(axis=0), d.sum(axis=0)
        d = d * w[f"norm{i}.scale"]
        if f"conv{i}.bias" in w:
            g[f"conv{i}.bias"] = d.sum(axis=0)
        from_parts = {name: back(f"conv{i}.{name}", d, part) for name, part in parts.items()}
        d = from_parts["self"] + sum(_spread_back(from_parts[name], *way) for name, way in ways.items())
    return float(loss), g


def train(
    edges: DataFrame,
    samples: DataFrame,
    kind: str,
    w: Weights,
    epochs: int = 60,
    rate: float = 0.01,
    warmup: int = 5,
    clip: float = 1.0,
    check_every: int = 5,
    patience: int = 20,
    validate: float = 0.2,
    seed: int = 42,
) -> tuple[Weights, list[tuple[int, float, float]]]:
    """Trained weights, and ``(epoch, training loss, validation loss)`` at every check.

    ``samples`` is ``(graph_id, v, f, y)``.  Graphs are split by hash, ``validate`` of them
    for validation.  Every epoch is a job: workers add up the gradients of their graphs,
    and executors the workers' sums, position by position, so what comes to the driver is
    one set of weights.  Steps are Adam's, clipped, at a rate that rises and falls; the
    weights of least validation loss are returned, and ``patience`` checks without a lower
    one end the training.  Classes weigh ``n / (2 * count)``.
    """
    directed = kind == "directed"
    per_class = {r["y"]: r["weight"] for r in scoring.class_weights(samples).collect()}  # a row for each class
    e = canonical(edges, directed).groupBy("graph_id").agg(F.collect_list(F.struct("src", "dst")).alias("edges"))
    v = samples.groupBy("graph_id").agg(F.collect_list(F.struct("v", "f", "y")).alias("vertices"))
    held_out = random_unit("graph_id", seed=seed) < validate
    graphs = cut(v.join(e, "graph_id", "left").select("vertices", "edges", held_out.alias("held_out")), "graphs")
    size = _flat(w).size

    def step_of(weights: Weights, split: bool):
        """One row: loss, rows and, in training, gradients, of the task's graphs."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, n, total = 0.0, 0, np.zeros(size)
            for b in batches:
                for vs, es in zip(b.column("vertices").to_pylist(), b.column("edges").to_pylist()):
                    at = {r["v"]: i for i, r in enumerate(vs)}
                    pairs = [(at[r["src"]], at[r["dst"]]) for r in es or [] if r["src"] in at and r["dst"] in at]
                    src, dst = np.array(pairs, np.int64).reshape(-1, 2).T
                    y = np.array([r["y"] for r in vs], float)
                    weight = np.array([per_class[r["y"]] for r in vs])
                    more, g = gradients(kind, np.array([r["f"] for r in vs], float), src, dst, y, weight, weights)
                    loss, n = loss + more, n + len(vs)
                    if not split:
                        total += _flat(g)
            if n:
                values = [loss, float(n), *([] if split else total.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([values], pa.list_(pa.float64()))], names=["sums"])

        rows = graphs.where("held_out" if split else "not held_out").select("vertices", "edges").mapInArrow(run, "sums array<double>")
        added = rows.select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
        return np.array([r["x"] for r in added]) if added else np.zeros(2)

    x, m, s = _flat(w), np.zeros(size), np.zeros(size)
    best, least, still, told = x, float("inf"), 0, []
    for epoch in range(epochs):
        sums = step_of(_shaped(x, w), False)
        if sums[1]:
            g = sums[2:] / sums[1]
            g *= min(1.0, clip / max(float(np.linalg.norm(g)), 1e-12))
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            turn = epoch + 1
            x = x - rate * scoring.learning_rate(epoch, warmup, epochs) * (m / (1 - 0.9**turn)) / (np.sqrt(s / (1 - 0.999**turn)) + 1e-8)
        if (epoch + 1) % check_every == 0 or epoch + 1 == epochs:
            ours = sums[0] / max(sums[1], 1.0)
            theirs = step_of(_shaped(x, w), True)
            # without graphs held out the training loss decides
            loss = theirs[0] / theirs[1] if theirs[1] else ours
            told.append((epoch, float(ours), float(loss)))
            best, least, still = (x, loss, 0) if loss < least else (best, least, still + 1)
            if still >= patience:
                break
    return _shaped(best, w), told
