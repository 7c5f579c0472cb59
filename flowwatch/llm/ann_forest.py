"""Approximate nearest neighbours by a hash-prefix forest (operator 1).

Every tree hashes a vector to a string: the vector is turned by the tree's
random rotation, and the letters are its axes, with sign, in order of
magnitude.  Nearby vectors share long prefixes.  A tree is the sorted array of
its strings; the vectors that share a prefix with a query lie side by side and
are found by binary search.  A query descends all trees to the longest shared
prefixes and then ascends in all of them at the same time, a letter at a step,
until enough candidates are gathered; these are compared exactly.

Strings are taken from unit vectors minus their block's mean, as a direction that
all share says nothing about nearness.  How many candidates are enough is measured:
a sample of the queries is also compared with the whole block, and the number grows
from a few times k until the forest finds nearly all of their nearest (at last, all rows).

The forest is built per block of vectors, in the task that a block of queries
visits, so no array grows with the table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from flowwatch.llm.common import stored
from flowwatch.llm.vectors import best, blocked_search, ranked, usable

#: trees, letters of a string, candidates at which the ascent ends, to begin with, for each of the k, and their growth
TREES, LETTERS, START, GROWTH, SEED = 56, 4, 2, 1.5, 11
BLOCK, QUERY_BLOCK = 8192, 4096
#: queries of a block that are compared with all rows, and the part of their nearest to be found
SAMPLE, FOUND = 64, 0.93


class Forest:
    """Sorted arrays of hash strings of the rows of ``x``."""

    def __init__(self, x: np.ndarray, trees: int = TREES, letters: int = LETTERS, seed: int = SEED):
        self.d = x.shape[1]
        self.letters = min(letters, self.d)
        rng = np.random.default_rng([seed, self.d])
        self.turns = [np.linalg.qr(rng.normal(size=(self.d, self.d)))[0] for _ in range(trees)]
        self.n, self.centre = len(x), x.mean(axis=0)
        self.trees = []
        for turn in self.turns:
            s = self.strings(x, turn)
            order = np.argsort(s, kind="stable")
            self.trees.append((s[order], order))

    def strings(self, x: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """Strings as numbers, in the order of the strings."""
        y = (x - self.centre) @ turn
        size = np.abs(y)
        top = np.argsort(-size, axis=1, kind="stable")[:, :self.letters]
        letter = 2 * top + (np.take_along_axis(y, top, axis=1) > 0)
        out = np.zeros(len(x), np.int64)
        for k in range(self.letters):
            out = out * (2 * self.d) + letter[:, k]
        return out

    def candidates(self, q: np.ndarray, least: int):
        """For each row of ``q``, places of at least ``least`` rows (all, if fewer)."""
        strings = [self.strings(q, turn) for turn in self.turns]
        ranges = []
        for cut in range(self.letters):             # letters left off the end
            unit = (2 * self.d) ** cut
            lo = [s // unit * unit for s in strings]
            ranges.append([(np.searchsorted(t, a), np.searchsorted(t, a + unit)) for (t, _), a in zip(self.trees, lo)])
        sums = [sum(b - a for a, b in level) for level in ranges]
        for i in range(len(q)):
            for level, total in zip(ranges, sums):
                if total[i] < least:
                    continue
                there = np.zeros(self.n, bool)
                for (a, b), (_, order) in zip(level, self.trees):
                    there[order[a[i]:b[i]]] = True
                found = np.flatnonzero(there)
                if len(found) >= least:
                    yield found
                    break
            else:
                yield np.arange(self.n)


def least_copies(x: np.ndarray, k: int) -> np.ndarray:
    """Places, ascending, of the rows that are among the first k equal ones."""
    if not len(x):
        return np.arange(0)
    group = np.unique(x, axis=0, return_inverse=True)[1].reshape(-1)
    order = np.argsort(group, kind="stable")
    first = np.searchsorted(group[order], group[order])
    return np.sort(order[np.arange(len(x)) - first < k])


def nearest(vectors: DataFrame, queries: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding",
            start: int = START, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k nearest found of each row that meets ``queries`` (a condition on ``vec_id``):
    query_id, rank, vec_id, score (cosine in double precision of the original vectors).

    A query's own id is no candidate; ties go to the smaller id.  Vectors that are
    null, empty or zero, or hold null or non-finite components, and rows without an id,
    take no part; of rows repeating an id the smallest vector stands.  Vectors of
    different lengths never meet.  Other columns are not read.  No vectors, no rows.
    """
    rows = stored(usable(vectors, F.col(vec_col), id_col), "vectors")

    def search(ids: np.ndarray, x: np.ndarray, asked: pd.DataFrame) -> tuple[np.ndarray, ...]:
        q, q_ids = np.stack(asked["q_v"]), asked["q_vec_id"].to_numpy()
        # scaled by powers of two first, which is exact: norms neither overflow nor vanish
        x, q = (np.ldexp(a, -np.frexp(np.abs(a).max(axis=1, keepdims=True))[1]) for a in (x, q))
        norms, q_norms = (np.sqrt((a * a).sum(axis=1)) for a in (x, q))
        # a query's k nearest hold no more than the first k of equal vectors, besides itself
        few = least_copies(x, k + 1)
        ids, x, norms = ids[few], x[few], norms[few]
        forest, unit = Forest(x / norms[:, None]), q / q_norms[:, None]

        def compared(i: int, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            near = near[ids[near] != q_ids[i]]
            # row by row, so that equal vectors have equal scores
            score = (x[near] * q[i]).sum(axis=1) / (norms[near] * q_norms[i])
            top = best(ids[near], score, k)
            return ids[near[top]], score[top]

        enough = start * k
        tried = np.unique(np.linspace(0, len(q) - 1, min(len(q), SAMPLE)).astype(int))
        if enough < len(ids):
            true = [compared(i, np.arange(len(ids)))[0] for i in tried]
        while enough < len(ids):
            got = [compared(i, near)[0] for i, near in zip(tried, forest.candidates(unit[tried], enough))]
            if sum(np.isin(t, g).sum() for t, g in zip(true, got)) >= FOUND * sum(map(len, true)):
                break
            enough = int(GROWTH * enough) + 1
        out = []
        for i, near in enumerate(forest.candidates(unit, enough)):
            found_ids, score = compared(i, near)
            out.append((np.full(len(score), q_ids[i]), found_ids, score))
        return tuple(np.concatenate(c) for c in zip(*out))

    found = blocked_search(rows, rows.filter(queries), search, "double", k, block, query_block)
    return ranked(found, k)
