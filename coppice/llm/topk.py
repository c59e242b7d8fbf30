"""Exact top-k by inner product with Fagin's threshold algorithm.

Candidates are dealt into blocks of a bounded number of rows, queries likewise, and
every block of queries meets every block of candidates.  A block of candidates keeps one
list per dimension, sorted by component.  A query walks the lists of its nonzero
dimensions from the end that its sign prefers, all to the same depth; each row met for
the first time is scored in full.  No row unseen can score more than the sum of the
components at the current depth, so the walk stops once the k-th score lies above that.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coppice.llm.common import cut

K = 5
SCALE = 256
#: Rows of a block of candidates, and of a block of queries, about.
CANDIDATES, QUERIES = 8192, 4096
#: Depth of the first step; each further step doubles it.
DEPTH = 16


class Lists:
    """A block's integer vectors with one sorted list per dimension."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, norm: float):
        # every sum stays exact: single floats hold integers to 2^24, doubles to 2^53
        bound = norm * (float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max())) if len(x) else 0.0)
        kind = np.float32 if bound < 1 << 23 else np.float64 if bound < 1 << 52 else object
        self.x = np.ascontiguousarray(x.astype(kind))
        self.ids, self.rows = ids, rows
        self.order = np.argsort(x, axis=0, kind="stable")

    def top(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of the k best rows but ``own``, ties to the smaller id; and the depth walked to."""
        n = len(self.x)
        q = q.astype(self.x.dtype)
        dims = np.flatnonzero(q)
        best, scores = np.zeros(0, np.int64), np.zeros(0, self.x.dtype)
        seen = self.rows == own
        lists, x = (self.order, self.x) if len(dims) == self.order.shape[1] else (self.order[:, dims], self.x)
        down, weights = q[dims] > 0, q[dims]
        depth, before = min(DEPTH, n), 0
        while before < n:
            step = np.where(down, lists[n - depth : n - before][::-1], lists[before:depth])
            fresh = np.zeros(n, bool)
            fresh[step.ravel()] = True
            if not len(dims):
                fresh[:] = True
            fresh &= ~seen
            seen |= fresh
            place = np.flatnonzero(fresh)
            score = x[place] @ q
            if len(best) == k:
                keep = score >= scores[-1]
                place, score = place[keep], score[keep]
            best, scores = np.concatenate([best, place]), np.concatenate([scores, score])
            first = np.lexsort((self.ids[best], -scores))[:k] if scores.dtype != object else np.array(sorted(range(len(best)), key=lambda i: (-scores[i], self.ids[best[i]]))[:k], np.int64)
            best, scores = best[first], scores[first]
            bound = (weights * x[step[-1], dims]).sum() if len(dims) else 0
            if len(best) == k and scores[-1] > bound:
                break
            before, depth = depth, min(2 * depth, n)
        return best, scores, depth


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    x = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    return x


def _search(k: int):
    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(queries):
            width = max(candidates["v"].map(len).max(), queries["v"].map(len).max())
            q = _matrix(queries["v"], width)
            norm = float(np.sqrt((q.astype(np.float64) ** 2).sum(axis=1).max()))
            block = Lists(_matrix(candidates["v"], width), candidates["vec_id"].to_numpy(), candidates["row_id"].to_numpy(), norm)
            for vector, vec_id, row in zip(q, queries["vec_id"], queries["row_id"]):
                best, scores, _ = block.top(vector, row, k)
                limit = (1 << 63) - 1
                out += [(row, vec_id, block.ids[i], max(-limit - 1, min(limit, int(s)))) for i, s in zip(best, scores)]
        return pd.DataFrame(out, columns=["query_row", "query_id", "vec_id", "score"])

    return run


def integer_vectors(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(row_id, vec_id, v)`` with ``v = floor(scale * component)``; vectors that are null or hold nulls or non-finite components are left out."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = table.select(F.monotonically_increasing_id().alias("row_id"), F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"), odd.alias("odd"))
    return rows.where("x is not null and not odd").select("row_id", "vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def top_k(table: DataFrame, is_query, k: int = K, scale: int = SCALE, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest scores, all if there are fewer.

    Ties of score go to the smaller vec_id.  A query's own row is no candidate; a row
    repeated with its vec_id is one, and a repeated query is answered once for each
    row.  Shorter vectors are filled up with zeros; rows with a null vec_id take no
    part.  Products beyond the range of a long are held at its ends: a component of
    2^63 / ``scale`` or more counts as that, and so does a score.  An empty table gives no
    rows; other columns are ignored.
    """
    rows = cut(integer_vectors(table.where("vec_id is not null"), scale), "vectors")
    asked = rows.where(is_query)
    n, m = rows.count(), asked.count()
    blocks, groups = max(1, -(-n // candidates)), max(1, -(-m // queries))
    here = rows.withColumn("block", F.pmod(F.xxhash64("row_id"), F.lit(blocks)))
    here = here.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    there = asked.withColumn("group", F.pmod(F.xxhash64("row_id"), F.lit(groups)))
    there = there.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = here.groupBy("block", "group").cogroup(there.groupBy("block", "group")).applyInPandas(
        _search(k), "query_row long, query_id long, vec_id long, score long"
    )
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
