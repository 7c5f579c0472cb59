"""Exact top-k search by largest inner product with two cover trees (operator 3).

Each level of a cover tree halves the covering radius: a node's vectors lie
within its radius of its centre, one of them.  Queries and rows are indexed
alike, and both trees are descended together, level by level.  For a pair of
nodes with centres q, p and radii a, b, no query and row below them have a larger
inner product than  <q, p> + a |p| + b |q| + a b.  A pair whose bound is under the
worst kth score of the query node's group is pruned with all that is below it.

Rows are dealt to blocks; every block of queries visits every block of rows.  A
first pass over one block gives every query a kth score to start from.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from flowwatch.llm.common import stored
from flowwatch.llm.vectors import best, blocked_search, ranked, usable

BLOCK, QUERY_BLOCK = 4096, 512
#: just below the largest long
_LONG = float((1 << 63) - (1 << 20))
#: centres tried at once when a node is covered
_TRY = 64


def rounding(dim: int) -> float:
    """Bound of the relative rounding error of a product of vectors, against the product of their norms."""
    return 4 * (dim + 8) * np.finfo(np.float64).eps


class CoverTree:
    """Levels of nodes over the rows of ``x``: per level, each node's centre (a row), radius
    (largest distance of a vector below it) and parent (in the level before).  The last level
    has a node for every row."""

    def __init__(self, x: np.ndarray):
        self.x, self.square = x, (x * x).sum(axis=1)
        n = len(x)
        centre, group = np.zeros(1, np.int64), np.zeros(n, np.int64)
        reach = self._distance(np.arange(n), 0)
        self.levels = [(centre, np.array([reach.max()]), np.zeros(1, np.int64))]
        r = reach.max()
        while r > 0 and len(centre) < n:
            r /= 2
            if not np.isfinite(r) or r < 1e-6 * (1 + np.sqrt(self.square.max())):
                break
            centre, group, parent, radius = self._cover(centre, group, r)
            self.levels.append((centre, radius, parent))
        # vectors that can't be told apart by distance are rows of their own in the last level
        self.levels.append((np.arange(n), np.zeros(n), group))

    def _distance(self, rows: np.ndarray, c: int | np.ndarray) -> np.ndarray:
        """Distances, never too small: rounding is as large as the squares make it, and what overflows is infinite."""
        if np.ndim(c):
            size = self.square[rows][None, :] + self.square[c][:, None]
            d = size - 2 * (self.x[c] @ self.x[rows].T)
        else:
            size = self.square[rows] + self.square[c]
            d = size - 2 * (self.x[rows] @ self.x[c])
        d = np.sqrt(np.maximum(d + size * rounding(self.x.shape[1]), 0)) * (1 + 1e-9) + 1e-6
        return np.where(np.isnan(d), np.inf, d)

    def _cover(self, centre: np.ndarray, group: np.ndarray, r: float):
        """Covers each node's vectors with balls of radius ``r`` around some of them, its centre first."""
        centres, parents, radii = [], [], []
        new = np.empty_like(group)
        order = np.argsort(group, kind="stable")
        bounds = np.searchsorted(group[order], np.arange(len(centre) + 1))
        for g, c in enumerate(centre.tolist()):
            rest = order[bounds[g]:bounds[g + 1]]
            rest = np.concatenate(([c], rest[rest != c]))
            while len(rest):
                tried = rest[:_TRY]
                d = self._distance(rest, tried)
                free = np.ones(len(rest), bool)
                for k, t in enumerate(tried.tolist()):
                    if free[k]:
                        mine = free & (d[k] <= r)
                        mine[k] = True
                        new[rest[mine]] = len(centres)
                        centres.append(t)
                        parents.append(g)
                        radii.append(float(d[k][mine].max()) if mine.sum() > 1 else 0.0)
                        free &= ~mine
                rest = rest[free]
        return np.array(centres), new, np.array(parents), np.array(radii)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers in doubles, exact; those beyond a long are the nearest long."""
    edge = float(1 << 62)
    if len(x) and np.sqrt((x * x).sum(axis=1)).max() * np.sqrt((q * q).sum()) < edge and max(np.abs(x).max(), np.abs(q).max()) < edge:
        return x.astype(np.int64) @ q.astype(np.int64)
    low, high = -(1 << 63), (1 << 63) - 1
    whole = [int(c) for c in q]
    return np.array([min(high, max(low, sum(int(a) * b for a, b in zip(row, whole) if a))) for row in x], np.int64)


def dual_tree(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int):
    """Top k rows of ``x`` for each row of ``q`` (whole numbers in doubles); ``floor``: scores that
    a query's kth is known to reach.  Gives query ids, ids, scores."""
    rows, asked = CoverTree(x), CoverTree(q)
    norm, q_norm = np.sqrt(rows.square), np.sqrt(asked.square)
    depth = max(len(rows.levels), len(asked.levels))
    alive = np.ones((1, 1), bool)
    kth = floor.astype(np.float64).copy()           # of each query
    groups: list[np.ndarray] = []                   # of each level: the node that holds each query
    at = np.arange(len(q))
    for centre, _, parent in reversed(asked.levels):
        groups.append(at)
        at = parent[at]
    groups.reverse()
    for step in range(depth):
        last_q, last_p = step >= len(asked.levels), step >= len(rows.levels)
        qc, qr, q_up = asked.levels[-1] if last_q else asked.levels[step]
        pc, pr, p_up = rows.levels[-1] if last_p else rows.levels[step]
        group = groups[-1 if last_q else step]
        if step:
            alive = alive if last_q else alive[q_up]
            alive = alive if last_p else alive[:, p_up]
        some_q, some_p = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if not len(some_q):
            break
        dot = np.full(alive.shape, -np.inf)
        dot[np.ix_(some_q, some_p)] = q[qc[some_q]] @ x[pc[some_p]].T
        dot[~alive] = -np.inf
        slack = rounding(x.shape[1]) * (q_norm[qc] + qr)[:, None] * (norm[pc] + pr)[None, :]
        # a node's centres are vectors: k of them, less what the query's distance can take away,
        # are k scores of every query in the group
        other = np.where(ids[pc][None, :] == q_ids[qc][:, None], -np.inf, dot)
        if other.shape[1] > k:
            # one more than k: a query below may be one of these rows itself
            less = other - qr[:, None] * norm[pc][None, :] - slack
            sure = np.partition(np.where(np.isnan(less), -np.inf, less), other.shape[1] - k - 1, axis=1)[:, other.shape[1] - k - 1]
            kth = np.maximum(kth, sure[group])
        worst = np.full(len(qc), np.inf)
        np.minimum.at(worst, group, kth)
        # scores beyond a long are all the nearest long
        worst = np.where(worst <= -_LONG, -np.inf, np.minimum(worst, _LONG))
        bound = dot + qr[:, None] * norm[pc][None, :] + pr[None, :] * q_norm[qc][:, None] + qr[:, None] * pr[None, :] + slack
        alive = alive & ~(bound + 1e-6 < worst[:, None])
    out = []
    for i in range(len(q)):
        near = np.flatnonzero(alive[i])
        near = near[ids[near] != q_ids[i]]
        score = products(x[near], q[i])
        top = best(ids[near], score, k)
        out.append((np.full(len(top), q_ids[i]), ids[near[top]], score[top]))
    return tuple(np.concatenate(c) for c in zip(*out))


def top_products(vectors: DataFrame, queries: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding",
                 scale: float = 1024.0, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k rows of largest inner product for each row that meets ``queries`` (a condition on
    ``vec_id``), over vectors of floor(scale * component): query_id, rank, vec_id, score long.

    A query's own id is no candidate; ties go to the smaller id.  Vectors that are null or
    empty, or hold null or non-finite components, and rows without an id, take no part; of
    rows repeating an id the smallest vector stands.  Vectors of different lengths never meet.
    Products are exact whatever the size of the components; a score beyond a long
    is the nearest long, and ranks as such.  Other columns are not read.  No vectors, no rows.
    """
    # from 2^53 on a double is whole; what overflows by the scale is as good as the largest double
    most = float(np.finfo(np.float64).max)
    fine = usable(vectors, F.col(vec_col), id_col, zero=True).withColumn(
        "v", F.transform("v", lambda c: F.when(F.abs(scale * c) < float(1 << 53), F.floor(scale * c).cast("double"))
                         .otherwise(F.greatest(F.least(scale * c, F.lit(most)), F.lit(-most)))))
    rows = stored(fine, "vectors")
    asked = rows.filter(queries)

    def search(ids: np.ndarray, x: np.ndarray, b: pd.DataFrame) -> tuple[np.ndarray, ...]:
        return dual_tree(ids, x, b["q_vec_id"].to_numpy(), np.stack(b["q_v"]), b["q_floor"].to_numpy(), k)

    # kth scores over a first block
    n = max(1, -(-rows.count() // block))
    start = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == 0)
    low = F.lit(float("-inf"))
    first = blocked_search(start, asked.withColumn("floor", low), search, "long", k, block, query_block)
    floors = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).cast("double").alias("f"))
    asked = stored(asked.join(floors, F.col("vec_id") == F.col("query_id"), "left").select(
        "vec_id", "v", "dim", F.coalesce("f", low).alias("floor")), "queries")
    return ranked(blocked_search(rows, asked, search, "long", k, block, query_block), k)


ORACLE_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from p)
select query_id, rank, vec_id, score from r where rank <= 10
"""
