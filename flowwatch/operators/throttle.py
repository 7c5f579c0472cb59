"""Greedy notification throttle, exact and without per-key collection.

Semantics (per key): the first event is kept; afterwards an event is kept
iff it is at least ``period`` after the *last kept* event.  Because the rule
depends on the last kept row it is not a ``lag``; it is the chain

    e0 -> nxt(e0) -> nxt(nxt(e0)) -> ...

where ``nxt(e)`` is the first event (by time, then id) at or after
``t(e) + period``.  Plan:

1. ``nxt`` by a two-level as-of join (see :func:`successor`): window
   partitions are bounded by one key's events in one fine bucket (1 s for an
   hour period) or by a fixed number of bucket summaries.
2. Pointer doubling: ``J[i+1] = J[i] o J[i]`` (self-joins on the unique event
   id), then the chain from ``e0`` is marked with ``S <- S u J[i](S)`` for
   ``i`` from high to low.  ``ceil(log2(L))`` rounds, ``L`` = most non-empty
   buckets of any key (a chain keeps at most one event per bucket).

All joins are on unique ids, so a key holding a third of all rows is spread
over every task; each round's result is checkpointed to cut lineage.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowwatch.operators.flows import idiv


def _checkpoint(df: DataFrame) -> DataFrame:
    return df.checkpoint(eager=True)


def _running_first(rows: DataFrame, part: list[str], order_key: str, kind_asc: bool) -> F.Column:
    """Smallest candidate (kind 0) at or after each row in ``order_key`` order
    (running frame over descending order: O(n) per partition)."""
    kind = F.col("_kind").asc() if kind_asc else F.col("_kind").desc()
    w = (Window.partitionBy(*part).orderBy(F.col(order_key).desc(), kind, F.col("_id").desc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return F.last(F.when(F.col("_kind") == 0, F.struct(order_key, "_id")), ignorenulls=True).over(w)


def successor(events: DataFrame, keys: list[str], t: str, id_: str, period: int,
              fine_per_period: int = 3600) -> DataFrame:
    """``(keys, id, nxt)``: first event (by time, then id) with time >= t + period.

    Two-level as-of join; every window partition is bounded by the events of
    one key in one *fine* bucket (``period / fine_per_period``, 1 s for an
    hour), or by ``2 * fine_per_period`` summary rows:

    1. in the probe's fine bucket: running "first at or after" over the
       bucket's events and the probes landing in it;
    2. otherwise the first event of the next non-empty fine bucket: inside
       the same coarse bucket (``period``) from fine-bucket summaries, else
       from the next non-empty coarse bucket (``lead`` over coarse summaries).
    """
    r = fine_per_period if fine_per_period > 0 and period % fine_per_period == 0 else 1
    fw = period // r
    ev = events.select(*keys, F.col(t).alias("_t"), F.col(id_).alias("_id"))
    ev = ev.withColumn("_f", idiv(F.col("_t"), fw)).withColumn("_c", idiv(F.col("_t"), period))
    # 1. inside the target fine bucket (target = f + r, exactly)
    cand = ev.select(*keys, "_f", "_t", "_id", F.lit(0).alias("_kind"))
    probes = ev.select(*keys, (F.col("_f") + r).alias("_f"), (F.col("_t") + period).alias("_t"),
                       "_id", F.lit(1).alias("_kind"))
    both = cand.unionByName(probes)
    hit = _running_first(both, [*keys, "_f"], "_t", kind_asc=True)
    near = (both.withColumn("_hit", hit).filter(F.col("_kind") == 1)
            .select(*keys, "_id", (F.col("_f") - r).alias("_src_f"), F.col("_hit._id").alias("_nid")))
    # 2a. next non-empty fine bucket after the target, within the target's coarse bucket
    fine = ev.groupBy(*keys, "_f").agg(F.min(F.struct("_t", "_id")).alias("_first"))
    fsum = fine.select(*keys, "_f", idiv(F.col("_f"), r).alias("_cb"), F.col("_first._id").alias("_id"),
                       F.lit(0).alias("_kind"))
    targets = fine.select(*keys, (F.col("_f") + r).alias("_f")).select(
        *keys, "_f", idiv(F.col("_f"), r).alias("_cb"), F.lit(None).cast("bigint").alias("_id"),
        F.lit(1).alias("_kind"))
    fb = fsum.unionByName(targets)
    nxt_fine = _running_first(fb, [*keys, "_cb"], "_f", kind_asc=False)   # strictly later fine bucket
    within = (fb.withColumn("_n", nxt_fine).filter(F.col("_kind") == 1)
              .select(*keys, (F.col("_f") - r).alias("_src_f"), F.col("_n._id").alias("_within")))
    # 2b. else the first event of the next non-empty coarse bucket at least two buckets later
    coarse = ev.groupBy(*keys, "_c").agg(F.min(F.struct("_t", "_id")).alias("_first"))
    wc = Window.partitionBy(*keys).orderBy("_c")
    far = coarse.select(
        *keys, F.col("_c").alias("_src_c"),
        F.when(F.lead("_c", 1).over(wc) >= F.col("_c") + 2, F.lead("_first", 1).over(wc)._id)
        .otherwise(F.lead("_first", 2).over(wc)._id).alias("_far"))
    out = (near.join(within, [*keys, "_src_f"], "left")
           .withColumn("_src_c", idiv(F.col("_src_f"), r))
           .join(far, [*keys, "_src_c"], "left"))
    return out.select(*keys, F.col("_id").alias(id_), F.coalesce("_nid", "_within", "_far").alias("nxt"))


def greedy_throttle(events: DataFrame, keys: list[str], t: str, id_: str, period: int) -> DataFrame:
    """Rows of ``events`` kept by the throttle (``id_`` unique within ``keys``).

    The events are read once and checkpointed; the rounds and the final
    selection read the checkpoint."""
    events = _checkpoint(events)
    ev = events.select(*keys, t, id_)
    buckets = ev.select(*keys, idiv(F.col(t), period).alias("_b")).distinct()
    longest = buckets.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    rounds = math.ceil(math.log2(longest)) if longest > 1 else 0
    tables = []
    if rounds:
        jump = successor(ev, keys, t, id_, period)
        tables.append(_checkpoint(jump.filter(F.col("nxt").isNotNull())))
    for _ in range(1, rounds):
        j = tables[-1]
        nxt = j.alias("a").join(j.alias("b"), [*(F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys),
                                               F.col("a.nxt") == F.col(f"b.{id_}")], "left")
        nxt = nxt.select(*[F.col(f"a.{k}") for k in keys], F.col(f"a.{id_}"), F.col("b.nxt").alias("nxt"))
        tables.append(_checkpoint(nxt.filter(F.col("nxt").isNotNull())))
    first = ev.withColumn("_r", F.struct(F.col(t), F.col(id_))).groupBy(*keys).agg(F.min("_r").alias("_r"))
    kept = first.select(*keys, F.col(f"_r.{id_}").alias(id_))
    for j in reversed(tables):
        # distances covered so far are multiples of 2^(i+1); adding 2^i never collides
        step = kept.join(j, [*keys, id_]).select(*keys, F.col("nxt").alias(id_))
        kept = _checkpoint(kept.unionByName(step))
    return events.join(kept, [*keys, id_], "left_semi")
