"""Toxicity by weak supervision (operator 7).

1. Words and word beginnings that go with the label are gathered from a bounded
   sample of the labelled training rows, and make many voters: one for each, and
   patterns over all of them (how many, how dense, none at all, insults in plain
   English, shouting).  A voter says toxic, clean, or nothing.
2. A generative label model explains the votes by the hidden class.  It
   estimates, by expectation maximisation, every voter's accuracy, and the
   correlations along the tree of voters that depend most on each other given
   the class.  The given label is one more voter, so wrong labels are found out.
3. A linear classifier learns the model's posterior labels from the words and
   votes, and scores every whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from flowwatch.llm.common import python_tasks, stored

#: bound of the sample of labelled rows that lexicon, label model and classifier are fitted on
MAX_LABELLED = 20_000
#: words and word beginnings taken as features; those of them that get a voter of their own
WORDS, BEGINNINGS, WORD_VOTERS = 250, 60, 40
#: beginnings' lengths, fewest documents with a listed item, and least ratio of its rates in toxic and clean ones
BEGINNING_CHARS, MIN_DOCS, MIN_LIFT = (4, 5), 4, 3.0

# Plain English insults.
INSULTS = ["clown", "disgusting", "dumb", "fool", "garbage", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic",
           "scum", "stupid", "trash", "ugly", "vermin", "worthless"]

_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


class Voters:
    """The lexicon and its voters: ``of(text)`` gives a text's votes (1 toxic, -1 clean, 0 none) and features."""

    def __init__(self, words: list[str], beginnings: list[str]):
        self.words = {w: i for i, w in enumerate(words)}
        self.starts = {b: len(words) + i for i, b in enumerate(beginnings)}
        self.lengths = sorted({len(b) for b in beginnings})
        self.insults = frozenset(INSULTS)
        self.own = min(WORD_VOTERS, len(words))
        self.n_lexicon = len(words) + len(beginnings)
        self.n_votes = self.own + len(beginnings) + 9
        self.n_features = self.n_lexicon + 2 * 9 + 6

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        words = _WORD.findall(text.lower())
        there = set(words)
        known = there & self.words.keys()
        started = {b for k in self.lengths for b in {w[:k] for w in there} & self.starts.keys()}
        rude = there & self.insults
        hits = n_rude = 0
        if known or started or rude:
            starts, lexicon, insults, lengths = self.starts, self.words, self.insults, self.lengths
            mine = {w for w in there if w in lexicon or any(w[:k] in starts for k in lengths)}
            hits = sum(w in mine for w in words)
            n_rude = sum(w in insults for w in words) if rude else 0
        n = max(1, len(words))
        caps = sum(1 for w in text.split() if len(w) > 3 and w.isupper())
        shout = text.count("!!") + caps
        x = np.zeros(self.n_features)
        votes = np.zeros(self.n_votes, np.int8)
        for w in known:
            i = self.words[w]
            x[i] = 1
            if i < self.own:
                votes[i] = 1
        for b in started:
            i = self.starts[b]
            x[i] = 1
            votes[self.own + i - len(self.words)] = 1
        kinds = len(known) + len(started)
        pattern = [
            1 if kinds >= 2 else -1 if kinds == 0 else 0,
            1 if hits >= 2 else -1 if hits == 0 else 0,
            1 if hits >= 4 else -1 if hits <= 1 else 0,
            1 if hits / n >= 0.01 else -1 if hits / n < 0.002 else 0,
            1 if hits / n >= 0.03 else 0,
            1 if n_rude >= 1 else 0,
            1 if n_rude >= 3 else 0,
            1 if n_rude / n >= 0.01 else -1 if n_rude == 0 and kinds == 0 else 0,
            1 if shout >= 5 else 0,
        ]
        votes[-9:] = pattern
        a = self.n_lexicon
        p = np.array(pattern)
        x[a:a + 9], x[a + 9:a + 18] = p > 0, p < 0
        x[a + 18:] = (math.log1p(hits), math.log1p(n_rude), min(1.0, 20 * hits / n), min(1.0, 20 * n_rude / n),
                      math.log1p(kinds), math.log1p(n) / 10)
        return votes, x


# ---- label model ------------------------------------------------------------

class LabelModel:
    """Votes given the class, as a tree of voters: p(y) * product of p(vote | vote of its parent, y)."""

    def __init__(self, rounds: int = 25, smooth: float = 0.5):
        self.rounds, self.smooth = rounds, smooth

    def fit(self, votes: np.ndarray, first: np.ndarray, count: np.ndarray | None = None) -> np.ndarray:
        """Posterior of the class after EM from the posteriors ``first``; votes in -1, 0, 1;
        ``count``: texts that each row stands for."""
        n, k = votes.shape
        count = np.ones(n) if count is None else count.astype(np.float64)
        hot = (votes[:, :, None] == np.array([-1, 0, 1])).reshape(n, 3 * k).astype(np.float32)
        post = first.astype(np.float64)
        for step in range(self.rounds):
            joint = [self._joint(hot, w * count) for w in (1 - post, post)]
            if step % 5 == 0:
                self.parent = self._tree(joint, k)
            prior = min(max((post * count).sum() / count.sum(), 1e-3), 1 - 1e-3)
            score = np.zeros((n, 2))
            for y in (0, 1):
                score[:, y] = math.log(prior if y else 1 - prior)
                for j in range(k):
                    score[:, y] += self._table(joint[y], j)[votes[:, j] + 1, votes[:, self.parent[j]] + 1]
            new = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -30, 30)))
            moved, post = np.abs(new - post).max(), new
            if moved < 1e-4:
                break
        self.accuracy = [float((joint[1][3 * j + 2, 3 * j + 2] + joint[0][3 * j, 3 * j])
                               / max(1e-9, sum(joint[y][3 * j + v, 3 * j + v] for y in (0, 1) for v in (0, 2))))
                         for j in range(k)]
        return post

    @staticmethod
    def _joint(hot: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Weighted counts of every pair of votes."""
        return (hot * weight[:, None].astype(np.float32)).T.astype(np.float64) @ hot.astype(np.float64)

    def _table(self, joint: np.ndarray, j: int) -> np.ndarray:
        """log p(vote of j | vote of its parent); a root is its own parent."""
        p = self.parent[j]
        if p == j:
            own = np.diag(joint)[3 * j:3 * j + 3] + self.smooth
            return np.repeat(np.log(own / own.sum())[:, None], 3, axis=1)
        pair = joint[3 * j:3 * j + 3, 3 * p:3 * p + 3]
        own = np.diag(joint)[3 * j:3 * j + 3] + self.smooth
        pair = pair + self.smooth * own[:, None] / own.sum() * 3
        return np.log(pair / pair.sum(axis=0, keepdims=True))

    @staticmethod
    def _tree(joint: list[np.ndarray], k: int) -> list[int]:
        """Maximum spanning tree by the voters' mutual information given the class."""
        total = sum(j[:3, :3].sum() for j in joint)
        info = np.zeros((k, k))
        for j in joint:
            p = (j + 1e-6).reshape(k, 3, k, 3) / max(total, 1)
            own = np.diag(j + 1e-6).reshape(k, 3) / max(total, 1)
            mass = own.sum(axis=1)[0]
            info += (p * (np.log(p) + math.log(mass) - np.log(own[:, :, None, None]) - np.log(own[None, None]))).sum(axis=(1, 3))
        parent, best, near = list(range(k)), np.full(k, -np.inf), np.zeros(k, int)
        left = set(range(1, k))
        best[1:], near[1:] = info[0, 1:], 0
        while left:
            j = max(left, key=lambda i: (best[i], -i))
            left.remove(j)
            if best[j] > 1e-4:
                parent[j] = int(near[j])
            for i in left:
                if info[j, i] > best[i]:
                    best[i], near[i] = info[j, i], j
        return parent


# ---- on Spark -----------------------------------------------------------------

def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """(toxic, text) of at most ``bound`` labelled training rows, chosen by a hash of the id; of rows
    repeating an id the one of smallest text."""
    y = (labels.select("doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
         .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    d = docs.select("doc_id", "text").join(F.broadcast(y), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    return stored(d.select("toxic", "text"), "labelled")


def gather_lexicon(sample: DataFrame) -> tuple[list[str], list[str]]:
    """The words and word beginnings that go most with the label, best first."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for pdf in batches:
            for toxic, text in zip(pdf["toxic"], pdf["text"]):
                there = set(_WORD.findall((text or "").lower()))
                found = {("", "")} | {("w", w) for w in there} | {(f"b{k}", w[:k]) for k in BEGINNING_CHARS for w in there if len(w) > k}
                n.update((*f, int(toxic)) for f in found)
            if len(n) > 300_000:
                yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["kind", "item", "toxic", "n"])
                n.clear()
        yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["kind", "item", "toxic", "n"])

    d = sample.mapInPandas(count, "kind string, item string, toxic int, n long").groupBy("kind", "item").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("toxic") == 1, 0).otherwise(F.col("n"))).alias("b"))
    d = stored(d.filter(f"kind = '' or a + b >= {MIN_DOCS}"), "lexicon")
    size = d.agg(F.sum(F.when(F.col("kind") == "", F.col("a"))).alias("a"), F.sum(F.when(F.col("kind") == "", F.col("b"))).alias("b"),
                 F.count("*").alias("n")).first()
    if not size or not size.a or not size.b:
        return [], []

    # signed root of the likelihood ratio; chance alone makes the largest of n about sqrt(2 log n)
    seen, rows = F.col("a") + F.col("b"), size.a + size.b

    def part(x: Column, n: int) -> Column:
        return F.when(x > 0, x * F.log(x * rows / (seen * n))).otherwise(0.0)

    def side(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log(x * rows / ((F.lit(rows) - seen) * y))).otherwise(0.0)

    g = 2 * (part(F.col("a"), size.a) + part(F.col("b"), size.b)
             + side(size.a - F.col("a"), F.lit(size.a)) + side(size.b - F.col("b"), F.lit(size.b)))
    lift = F.col("a") * size.b / (F.greatest(F.col("b"), F.lit(0.5)) * size.a)
    chance = math.sqrt(2 * math.log(max(2, size.n)))
    d = d.filter("kind <> ''").withColumn("z", F.sqrt(F.greatest(g, F.lit(0.0)))).filter((F.col("z") > chance) & (lift > MIN_LIFT))
    best = [F.desc("z"), F.col("item")]
    words = [r.item for r in d.filter("kind = 'w'").orderBy(*best).limit(WORDS).collect()]
    starts = [r.item for r in d.filter("kind <> 'w'").orderBy(*best).limit(BEGINNINGS).collect()]
    return words, starts


class Model:
    """A fitted scorer: voters, and the weights of the linear classifier."""

    def __init__(self, voters: Voters, weights: np.ndarray, bias: float):
        self.voters, self.weights, self.bias = voters, weights, bias

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.voters.of(text)[1] @ self.weights)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> Model:
    """Fits on at most ``bound`` labelled rows, none of them held out.

    The sample's distinct rows of votes (at most bound x about 110 bytes) go to the
    driver for the label model; the classifier is fitted on Spark, over distinct rows in
    one order, so that its sums, and the scores, are the same in every run.  Without both kinds
    of labels the model is a fixed one over the plain insults."""
    python_tasks(docs.sparkSession)
    sample = labelled_sample(docs, labels, bound)
    words, starts = gather_lexicon(sample)
    voters = Voters(words, starts)
    if not words and not starts:
        w = np.zeros(voters.n_features)
        w[-5], w[-3] = 2.0, 2.0
        return Model(voters, w, -3.0)

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [voters.of(t) for t in pdf["text"]]
            yield pd.DataFrame({"toxic": pdf["toxic"], "votes": [v.tobytes() for v, _ in both], "x": [x for _, x in both]})

    voted = stored(sample.mapInPandas(vote, "toxic int, votes binary, x array<double>"), "votes")
    # equal votes and labels are one row of the model, with their number
    rows = voted.groupBy("toxic", "votes").count().orderBy("toxic", "votes").toPandas()
    given = rows["toxic"].to_numpy().astype(np.int8)
    votes = np.frombuffer(b"".join(rows["votes"]), np.int8).reshape(len(rows), -1)
    used = np.flatnonzero((votes != 0).any(axis=0))
    post = LabelModel().fit(np.column_stack([votes[:, used], 2 * given - 1]), np.where(given == 1, 0.95, 0.05),
                            rows["count"].to_numpy())
    found = pd.DataFrame({"toxic": given.astype(np.int32), "votes": rows["votes"], "p": post})
    spark = docs.sparkSession
    p = spark.createDataFrame(found, "toxic int, votes binary, p double")
    # equal features and votes are one row with their number; at most twice ``bound`` rows, in one partition
    train = voted.groupBy("toxic", "votes", "x").agg(F.count("*").alias("n")).join(F.broadcast(p), ["toxic", "votes"])
    train = train.select("x", "toxic", "votes", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("p").alias("part")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("part")))).alias("y"), "n")
    train = train.filter("y.part > 0.001").coalesce(1).sortWithinPartitions("x", "toxic", "votes", "y.label").select(
        array_to_vector("x").alias("features"), "y.label", (F.col("y.part") * F.col("n")).alias("weight"))
    lr = LogisticRegression(weightCol="weight", regParam=0.002, maxIter=60).fit(train)
    return Model(voters, np.array(lr.coefficients.toArray()), float(lr.intercept))


def scored(spark, text: Column, model: Model) -> Column:
    """Score (0 to 1, higher: likelier toxic) of a text column; null and empty texts too."""
    python_tasks(spark)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return run(text)


def score_documents(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts score like a text without any listed word.  A null id
    is not held out (and never trains).  Ids with several labels count as toxic
    if one is; labels without a document, and null ones, are left out.  Rows repeating an
    id are scored each.  Other columns are not read.  An empty table gives no rows.
    """
    model = fit(docs, labels, bound)
    s = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored(docs.sparkSession, F.col("text"), model).alias("score"))
    return s.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """``docs``, all columns, without the documents that are predicted toxic."""
    model = fit(docs, labels, bound)
    return docs.filter(scored(docs.sparkSession, F.col("text"), model) < 0.5)
