"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import flowwatch
from flowwatch.session import ensure_checkpoint_dir

# functions that run in tasks travel with the task: executors need no copy of this package
cloudpickle.register_pickle_by_value(flowwatch)

#: ASCII white space: \x20 and \x09-\x0D
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: rows in an Arrow batch handed to Python; texts may be long, so batches are short
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, as every executor has it installed."""
    import public_tokenizers
    return public_tokenizers.path(name)


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, everything else left alone."""
    return F.translate(c, UPPER, LOWER)


def python_tasks(spark: SparkSession) -> None:
    """Prepares the session for Python functions over whole texts: Arrow batches are short."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def lasting(name: str, make: Callable):
    """What ``make()`` gives, made once in a Python worker and kept for its next tasks: functions travel by
    value, so variables of this package are new in every task, and only the interpreter's own last."""
    held = sys.__dict__.setdefault("_flowwatch_kept", {})
    if name not in held:
        held[name] = make()
    return held[name]


class Memo:
    """Answers by question, at most about ``most``, in two generations.

    New answers are young.  When half of ``most`` are young, they become the old ones and the old
    ones go; an old answer that is asked for again is young again.  So what comes back stays, and
    the memo is never emptied whole."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most // 2, {}, {}

    def rest(self) -> None:
        """Between tasks only the young answers are kept: a worker that waits holds half."""
        self.old = {}

    def missing(self, questions) -> list:
        """Questions without an answer; the others are young from now on."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young, old, out = self.young, self.old, []
        for q in questions:
            if q not in young:
                found = old.get(q)
                if found is None:
                    out.append(q)
                else:
                    young[q] = found
        return out


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder (removable when the application ends)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/flowwatch-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: cuts the
    lineage, and gives later joins the measured size of the files."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of ``edges(u long, v long)``.

    Alternates the large-star and small-star steps until the edges no longer
    change, so a chain of n nodes takes about log n rounds.  A star's centre
    is never gathered: each step is a minimum per node (combined before the
    shuffle and written, so that the join back to the edges has plain shuffles on
    both sides, whose skewed keys adaptive execution splits).  Rounds are cut with
    ``checkpoint()``.
    Self-links, repeated links and links with a null end are ignored; no links
    give an empty result.  Returns (node long, component long), one row per
    node that has a link.
    """
    ensure_checkpoint_dir(edges.sparkSession)

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    def tidy(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()

    e = tidy(edges.select(F.col("u").cast("long"), F.col("v").cast("long"))).checkpoint()
    seen = mark(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        # large star: every neighbour above u moves to the least of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(least(both).select("u", F.least("u", "m").alias("m")), "star-centres")
        large = stored(tidy(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))), "large-stars")
        # small star: every neighbour below u, and u, move to the least of them
        small = large.join(stored(least(large), "star-centres"), "u")
        e = tidy(small.select("v", F.col("m")).toDF("u", "v").unionByName(small.select("u", F.col("m").alias("v")))).checkpoint()
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("connected_components: no fixed point within max_rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
