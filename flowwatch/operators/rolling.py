"""Bounded per-source history over *active* windows.

A row frame (not a range frame): windows in which a source is silent do not
age its entries out.  The frame runs over flows (at most one row per source
per 2 s window), never over packets.

Hot sources are split by time: flows are cut into blocks of ``block_windows``
windows and each block is seeded with a *halo* -- the last ``n`` flows of the
source before the block, taken from the tails of (at most ``n``) previous
non-empty blocks.  The row frame then runs inside (source, block) partitions,
each bounded by the block size, and gives exactly the same values as one
frame over the whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowwatch.config import DEFAULT, Thresholds
from flowwatch.operators.flows import idiv

BLOCK_WINDOWS = 4096          # ~2.3 h of 2 s windows per (source, block) partition
_HIST = ["window_id", "total_packets", "unique_target_ports", "_syn"]


def rolling_state(flows: DataFrame, th: Thresholds = DEFAULT, block_windows: int | None = BLOCK_WINDOWS) -> DataFrame:
    """``block_windows=None``: one frame per source (for inputs already bounded
    per source, e.g. a micro-batch plus its 14-row state)."""
    n = th.rolling_windows - 1
    if block_windows is None:
        w = Window.partitionBy("src_ip").orderBy("window_id").rowsBetween(-n, Window.currentRow)
        return flows.select(
            "*",
            F.count(F.lit(1)).over(w).alias("rolling_windows"),
            F.sum("total_packets").over(w).alias("rolling_packets"),
            F.sum("unique_target_ports").over(w).alias("rolling_unique_ports"),
            F.sum(F.col("total_syn_flags").cast("bigint")).over(w).alias("rolling_syn"),
        )
    f = (flows.withColumn("_syn", F.col("total_syn_flags").cast("bigint"))
         .withColumn("_blk", idiv(F.col("window_id"), block_windows)))
    # tail of each (source, block): its last n flows (partition bounded by the block)
    w_tail = Window.partitionBy("src_ip", "_blk").orderBy(F.col("window_id").desc())
    tails = (f.withColumn("_r", F.row_number().over(w_tail)).filter(F.col("_r") <= n)
             .groupBy("src_ip", "_blk").agg(F.collect_list(F.struct(*_HIST)).alias("_tail")))
    # halo of a block: last n flows among the tails of the previous n non-empty blocks
    w_prev = Window.partitionBy("src_ip").orderBy("_blk").rowsBetween(-n, -1)
    cand = F.array_sort(F.flatten(F.collect_list("_tail").over(w_prev)))
    halo = (tails.select("src_ip", "_blk", cand.alias("_c"))
            .select("src_ip", "_blk", F.slice("_c", F.greatest(F.size("_c") - n + 1, F.lit(1)), n).alias("_h"))
            .select("src_ip", "_blk", F.explode("_h").alias("e"))
            .select("src_ip", "_blk", *[F.col(f"e.{c}").alias(c) for c in _HIST])
            .withColumn("_halo", F.lit(True)))
    rows = f.withColumn("_halo", F.lit(False))
    both = rows.unionByName(halo, allowMissingColumns=True)
    w = Window.partitionBy("src_ip", "_blk").orderBy("window_id").rowsBetween(-n, Window.currentRow)
    out = both.select(
        "*",
        F.count(F.lit(1)).over(w).alias("rolling_windows"),
        F.sum("total_packets").over(w).alias("rolling_packets"),
        F.sum("unique_target_ports").over(w).alias("rolling_unique_ports"),
        F.sum("_syn").over(w).alias("rolling_syn"),
    )
    return out.filter(~F.col("_halo")).drop("_halo", "_blk", "_syn")
