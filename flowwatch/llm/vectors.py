"""Vectors in blocks, and query blocks that meet them (operators 1 and 3)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F


def usable(vectors: DataFrame, vec: Column, id_col: str = "vec_id", zero: bool = False) -> DataFrame:
    """(vec_id, dim, v array<double>) of the vectors that take part: not null or empty, all
    components there and finite, and, unless ``zero``, one that is not 0.

    A null id takes no part; of rows repeating an id, the smallest vector stands for it."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.cast("array<double>").alias("v"))
    fine = F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if not zero:
        fine = fine & F.exists("v", lambda x: x != 0)
    return v.filter(F.coalesce(fine, F.lit(False))).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def blocked_search(rows: DataFrame, queries: DataFrame, search: Callable, score_type: str, k: int,
                   block: int, query_block: int) -> DataFrame:
    """Top ``k`` of ``rows`` for each of ``queries`` (both (vec_id, dim, v), queries perhaps
    with more columns), of the same dimension: (query_id, vec_id, score).

    Rows are dealt by a hash of the id to blocks of about ``block`` rows, queries to blocks of
    ``query_block``; each pair of blocks meets in one task, which returns at most k rows a query.
    ``search(ids, x, query frame)``, the frame's columns led by ``q_``, gives three arrays: query ids, ids, scores."""
    n, m = (max(1, -(-d.count() // size)) for d, size in ((rows, block), (queries, query_block)))
    left = (rows.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
            .withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))))
    right = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    right = (right.withColumn("q_block", F.pmod(F.xxhash64("q_vec_id"), F.lit(m)).cast("int"))
             .withColumn("b_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        a, b = a.sort_values("vec_id"), b.sort_values("q_vec_id")
        found = search(a["vec_id"].to_numpy(), np.stack(a["v"]), b)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    return left.groupBy("dim", "b", "q").cogroup(right.groupBy("q_dim", "b_block", "q_block")).applyInPandas(
        meet, f"query_id long, vec_id long, score {score_type}")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of what the blocks found: query_id, rank, vec_id, score; ties to the smaller id."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]
