"""Sinks (B1-B7).

Appends from streaming micro-batches are idempotent: rows are written to the
``batch_id`` partition with dynamic partition overwrite, so a retried batch
replaces its own output instead of duplicating it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwatch import config as C
from flowwatch.functions import scrub


def day_partition(ts_us: str = "ts_us") -> F.Column:
    """UTC calendar day of an epoch-microsecond column (time-zone free)."""
    return F.date_from_unix_date(F.floor(F.col(ts_us) / F.lit(86_400_000_000)).cast("int"))


def write_clean_packets(clean: DataFrame, path: str, fmt: str = "parquet") -> None:
    """B1: merged clean packets, partitioned by day."""
    out = clean.withColumn("dt", day_partition("ts_us"))
    w = out.write.mode("overwrite").partitionBy("dt")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def write_flow_features(flows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """B2: flow table without first/last packet time, features scrubbed."""
    out = flows.drop("first_packet_us", "last_packet_us")
    out = out.select(*[scrub(c).alias(c) if c in C.FEATURE_COLS else F.col(c) for c in out.columns])
    w = out.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def append_table(df: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Append; with ``batch_id`` an idempotent partition overwrite."""
    if batch_id is None:
        df.write.mode("append").parquet(path)
        return
    (df.withColumn("batch_id", F.lit(int(batch_id))).write
     .mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(path))


def write_protocol_breakdown(protos: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Per-protocol counts, clustered by source inside each file so the
    per-source drill-down (A7/D17) skips row groups by their min/max stats."""
    append_table(protos.sortWithinPartitions("src_ip", "protocol"), path, batch_id)


def export_csv(view: DataFrame, path: str) -> None:
    """CSV export of a (filtered) alert view with a header row."""
    view.write.mode("overwrite").option("header", True).csv(path)


def load_detector_model(rf_path: str | None, fallback_path: str | None = None):
    """The supervised model, else the clustering model, else none; and whether it is
    supervised.  Any of the three can be a :class:`Detector`'s model."""
    from pyspark.sql import SparkSession
    from flowwatch.operators.ml import ClusterModel, FlowModel
    from flowwatch.session import path_exists
    spark = SparkSession.getActiveSession()
    if rf_path and path_exists(spark, rf_path):
        return FlowModel.load(rf_path), True
    if fallback_path and path_exists(spark, fallback_path):
        return ClusterModel.load(fallback_path), False
    return None, False
