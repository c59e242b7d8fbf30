"""Nets against plain loops, and the tables that they are trained on."""

import math
import random

import numpy as np
import pytest

from coppice.operators import edges as E
from coppice.operators import nets
from coppice.operators import structure as S


@pytest.fixture(scope="module")
def few(spark):
    r = random.Random(8)
    data = [(g, r.randrange(7), r.randrange(7)) for g in range(3) for _ in range(6 + 5 * g)]
    return spark.createDataFrame(data, "graph_id long, src long, dst long").cache()


def times(w, name, x):
    rows = [sum(a * b for a, b in zip(row, x)) for row in w[f"{name}.weight"]]
    return [y + b for y, b in zip(rows, w[f"{name}.bias"])] if f"{name}.bias" in w else rows


def loop_attention(x, edges, w, name):
    heads, width = w[f"{name}.score"].shape
    left, right = [times(w, f"{name}.left", v) for v in x], [times(w, f"{name}.right", v) for v in x]
    out = []
    for v in range(len(x)):
        near = [a for a, b in edges if b == v and a != v] + [v]
        total = [0.0] * width
        for h in range(heads):
            part = slice(h * width, (h + 1) * width)
            score = []
            for a in near:
                s = [p + q for p, q in zip(left[a][part], right[v][part])]
                score.append(sum(c * (y if y > 0 else 0.2 * y) for c, y in zip(w[f"{name}.score"][h], s)))
            e = [math.exp(s - max(score)) for s in score]
            for a, share in zip(near, e):
                for i, y in enumerate(left[a][part]):
                    total[i] += share / sum(e) * y / heads
        out.append([t + b for t, b in zip(total, w[f"{name}.bias"])])
    return out


def test_attention_as_by_loops():
    r = np.random.default_rng(3)
    x, edges = r.normal(size=(6, 4)), [(0, 1), (1, 2), (2, 0), (3, 1), (4, 4), (0, 2)]
    w = nets.random_weights("undirected_attention", 4, 4, heads=3, layers=1)
    src, dst = np.array(edges).T
    got = nets.attention(x, src, dst, w, "layer0.both.attention")
    assert np.allclose(got, loop_attention(x.tolist(), edges, w, "layer0.both.attention"))


@pytest.mark.parametrize("kind", nets.KINDS)
def test_scores_do_not_depend_on_the_order_of_rows(spark, few, kind):
    channels = ["a", "b"]
    v = E.vertices(few).selectExpr("graph_id", "v", "v / 7 AS a", "CASE WHEN v <> 3 THEN sin(v) END AS b")
    w = nets.random_weights(kind, 2, 8, heads=2, layers=2)
    one = {(r["graph_id"], r["v"]): r["prob"] for r in nets.score(few, v, channels, kind, w).collect()}
    two = {(r["graph_id"], r["v"]): r["prob"] for r in nets.score(few.repartition(5), v.repartition(3), channels, kind, w).collect()}
    assert one == pytest.approx(two) and len(one) == v.count()
    assert all(0 < p < 1 for p in one.values()) and len(set(one.values())) > 3


def test_directions_matter_to_directed_nets():
    r = np.random.default_rng(1)
    x, src, dst = r.normal(size=(5, 3)), np.array([0, 1, 2, 3]), np.array([1, 2, 3, 4])
    for kind, same in (("directed", False), ("directed_attention", False), ("undirected", True), ("undirected_attention", True)):
        w = nets.random_weights(kind, 3, 8, heads=2, layers=2)
        assert np.allclose(nets.forward(kind, x, src, dst, w), nets.forward(kind, x, dst, src, w)) == same


def test_norms_fold():
    x = np.random.default_rng(2).normal(2, 3, (500, 4))
    scale, shift = nets.fold_norm(x.mean(0), x.var(0), np.full(4, 2.0), np.ones(4))
    y = x * scale + shift
    assert np.allclose(y.mean(0), 1, atol=1e-6) and np.allclose(y.std(0), 2, atol=1e-3)


def test_weights_are_stored(spark, tmp_path):
    w = nets.random_weights("directed_attention", 16, 8, heads=2, layers=2)
    nets.save_weights(spark, w, str(tmp_path / "w"))
    again = nets.load_weights(spark, str(tmp_path / "w"))
    assert set(w) == set(again) and all((w[k] == again[k]).all() for k in w)


@pytest.mark.parametrize("directed", [True, False])
def test_hinted_solutions_are_solutions(few, directed):
    of = E.vertices(few)
    kind = "directed_attention" if directed else "undirected_attention"
    w = nets.random_weights(kind, 16, 8, heads=2, layers=1)
    for capped, algo in ((True, "kma"), (False, "dkma")):
        found = nets.hinted_solve(few, of, directed, w, threshold=0.4, algo=algo, capped=capped).collect()
        assert len(found) == 3 and all(r["valid"] and r["hinted"] <= r["fvs_size"] == len(r["solution"]) for r in found)


def test_training_table_holds_solutions(spark, few, tmp_path):
    of = E.vertices(few)
    t = nets.training_table(few, of, True).cache()
    labelled = t.where("y = 1").select("graph_id", "v")
    assert all(r["valid"] for r in S.is_solution(few, labelled, of, True).collect())
    assert {len(r["f"]) for r in t.collect()} == {16}
    path = str(tmp_path / "samples")
    assert nets.store_samples(t.where("graph_id < 2"), path) == t.where("graph_id < 2").count()
    assert nets.store_samples(t, path) == t.where("graph_id = 2").count()
    assert nets.store_samples(t, path) == 0


@pytest.mark.parametrize("kind", ["directed", "undirected"])
def test_gradients_as_by_differences(kind):
    r = np.random.default_rng(4)
    x, src, dst = r.normal(size=(6, 3)), np.array([0, 1, 2, 3, 0]), np.array([1, 2, 0, 4, 4])
    y, weight = np.array([0, 1, 0, 1, 1, 0.0]), r.uniform(0.5, 2, 6)
    w = nets.random_weights(kind, 3, 4, seed=2)
    loss, g = nets.gradients(kind, x, src, dst, y, weight, w)
    p = nets.forward(kind, x, src, dst, w)
    assert loss == pytest.approx(-(weight * np.log(np.where(y == 1, p, 1 - p))).sum())
    assert set(g) == set(w)
    for name in w:
        for at in np.ndindex(w[name].shape):
            near = []
            for h in (1e-6, -1e-6):
                moved = {k: v.copy() for k, v in w.items()}
                moved[name][at] += h
                near.append(nets.gradients(kind, x, src, dst, y, weight, moved)[0])
            assert g[name][at] == pytest.approx((near[0] - near[1]) / 2e-6, abs=1e-4), (name, at)


def test_training_learns_a_rule(spark):
    """Vertices that two or more others point to are to be told from the rest; what is learned holds for graphs held out."""
    from pyspark.sql import functions as F

    r = random.Random(6)
    data = [(g, a, b) for g in range(80) for a in range(8) for b in range(8) if a != b and r.random() < 0.2]
    e = spark.createDataFrame(data, "graph_id long, src long, dst long").cache()
    rows = []
    for g in range(80):
        for v in range(8):
            n = sum(1 for h, _, b in data if h == g and b == v)
            rows.append((g, v, [1.0, n / 2.0 - 0.75, float(n == 0)], int(n >= 2)))
    samples = spark.createDataFrame(rows, "graph_id long, v long, f array<double>, y int").cache()
    start = nets.random_weights("directed", 3, 8, seed=3)
    w, told = nets.train(e, samples, "directed", start, epochs=60, rate=0.05)
    assert min(t[2] for t in told) < 0.6 * told[0][2], told
    f = samples.select("graph_id", "v", "y", *(F.col("f")[i].alias(f"c{i}") for i in range(3)))
    prob = nets.score(e, f, ["c0", "c1", "c2"], "directed", w).join(f, ["graph_id", "v"])
    assert prob.where((F.col("prob") > 0.5) == (F.col("y") == 1)).count() > 0.9 * len(rows)
    again, _ = nets.train(e, samples, "directed", start, epochs=3)
    same, _ = nets.train(e.repartition(5), samples.repartition(3), "directed", start, epochs=3)
    assert all(np.allclose(again[k], same[k], atol=1e-6) for k in again)
