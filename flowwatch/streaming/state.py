"""Per-source history of a stream, as a log of segments.

A batch writes one small segment: the latest history (at most 14 windows) of the
sources that it saw, nothing of any other source.  Segments are merged like the
digits of a counter: when ``FANOUT`` segments of one size are complete they
become one of the next size, in which the newest row of each source stays.  So
after ``n`` batches at most ``(FANOUT - 1) * log(n)`` segments are live, a row is
rewritten once per size, and a batch writes in proportion to the sources it saw,
however many were seen before.

Which segments are live follows from the number of the batch alone.  A retried
batch therefore reads what it read before and overwrites what it wrote; what a
batch merged is removed by the next batch, when no retry can ask for it.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowwatch.config import DEFAULT, Thresholds
from flowwatch.session import path_exists

FANOUT = 8
#: what the rolling rules need of a past window
HISTORY = ["window_id", "total_packets", "unique_target_ports", "total_syn_flags"]
_ENTRY = "window_id: bigint, total_packets: bigint, unique_target_ports: bigint, total_syn_flags: double"
SCHEMA = f"src_ip string, batch bigint, history array<struct<{_ENTRY}>>"


def live_segments(n: int, fanout: int = FANOUT) -> list[tuple[int, int]]:
    """(first, last) of the segments that hold the batches before batch ``n``, oldest and largest first."""
    size = 1
    while size * fanout <= n:
        size *= fanout
    out, at = [], 0
    while at < n:
        while at + size > n:
            size //= fanout
        out.append((at, at + size - 1))
        at += size
    return out


def merged_by(n: int, fanout: int = FANOUT) -> tuple[tuple[int, int] | None, list[tuple[int, int]]]:
    """The segment that batch ``n`` merges, if any, and its parts, batch ``n`` among them."""
    new = live_segments(n + 1, fanout)[-1]
    if new == (n, n):
        return None, []
    return new, [s for s in live_segments(n, fanout) if s[0] >= new[0]] + [(n, n)]


def segment_path(root: str, segment: tuple[int, int]) -> str:
    return os.path.join(root, f"batches-{segment[0]:09d}-{segment[1]:09d}")


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _read(spark: SparkSession, root: str, segments: list[tuple[int, int]]) -> DataFrame:
    paths = [segment_path(root, s) for s in segments]
    for p in paths:
        if not path_exists(spark, p):
            # history would silently start anew
            raise FileNotFoundError(f"state segment is missing: {p}")
    return spark.read.schema(SCHEMA).parquet(*paths)


def _newest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("src_ip").agg(F.max("batch").alias("batch"), F.max_by("history", "batch").alias("history"))


def history(spark: SparkSession, root: str, batch_id: int, sources: DataFrame, fanout: int = FANOUT) -> DataFrame | None:
    """Past windows of ``sources(src_ip)``, distinct, as batch ``batch_id`` finds them: (src_ip, *HISTORY)."""
    if batch_id == 0:
        return None
    rows = _read(spark, root, live_segments(batch_id, fanout)).join(sources, "src_ip", "left_semi")
    return _newest(rows).select("src_ip", F.explode("history").alias("h")).select("src_ip", *[F.col(f"h.{c}").alias(c) for c in HISTORY])


def write_history(flows: DataFrame, root: str, batch_id: int, th: Thresholds = DEFAULT, fanout: int = FANOUT) -> None:
    """Writes the segment of a batch from ``flows(src_ip, *HISTORY)``, past and new windows of the sources
    it saw, and the segment that it completes."""
    spark = flows.sparkSession
    w = Window.partitionBy("src_ip").orderBy(F.col("window_id").desc())
    last = flows.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= th.rolling_windows - 1)
    entry = F.struct(*[F.col(c).cast("double" if c == "total_syn_flags" else "bigint").alias(c) for c in HISTORY])
    rows = last.groupBy("src_ip").agg(F.sort_array(F.collect_list(entry)).alias("history"))
    rows.select("src_ip", F.lit(batch_id).cast("bigint").alias("batch"), "history").write.mode("overwrite").parquet(segment_path(root, (batch_id, batch_id)))
    whole, parts = merged_by(batch_id, fanout)
    if whole:
        _newest(_read(spark, root, parts)).write.mode("overwrite").parquet(segment_path(root, whole))


def forget(spark: SparkSession, root: str, batch_id: int, fanout: int = FANOUT) -> None:
    """Removes the parts of what the batch before merged: batch ``batch_id`` runs, so that one is done."""
    if batch_id:
        for part in merged_by(batch_id - 1, fanout)[1]:
            _remove(spark, segment_path(root, part))
