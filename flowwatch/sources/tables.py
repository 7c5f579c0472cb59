"""Table and list sources."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowwatch import config as C
from flowwatch.functions import coerce_numeric, scrub
from flowwatch.session import path_exists
from flowwatch.sinks.segments import SEGMENTS, read_appended


ALERT_LOG = ("window_id bigint, window_start_us bigint, timestamp string, source_ip string, packets_per_sec double, "
             "avg_window_size double, syn_ack_ratio double, total_bytes bigint, traffic_profile string, threat_level string, "
             "confidence double")
PROTOCOL_TABLE = "window_id bigint, src_ip string, protocol string, packets bigint, bytes bigint"


def read_ip_list(spark: SparkSession, path: str | None, strip_inline_comments: bool = True) -> DataFrame:
    """A3: one address per line; blanks and ``#`` lines dropped; de-duplicated.

    A missing file yields an empty list.  ``strip_inline_comments`` also cuts
    ``addr  # note`` at the ``#`` (the original keeps the whole text, which
    then never matches; pass ``False`` to reproduce that).
    """
    empty = spark.createDataFrame([], T.StructType([T.StructField("ip", T.StringType())]))
    if not path:
        return empty
    try:
        lines = spark.read.text(path)
    except AnalysisException:
        return empty
    v = F.trim(F.col("value"))
    if strip_inline_comments:
        v = F.trim(F.regexp_replace(v, r"\s*#.*$", ""))
    out = lines.select(v.alias("ip")).filter((F.col("ip") != "") & ~F.col("ip").startswith("#"))
    return out.distinct()


def read_flow_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A4: flow-feature table with the required-column check; features scrubbed."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    df = reader.format(fmt).load(path)
    missing = [c for c in C.FEATURE_COLS if c not in df.columns]
    if missing:
        raise ValueError(f"Missing columns in flow table: {missing}")
    return df.select(*[scrub(coerce_numeric(c) if fmt == "csv" else F.col(c)).alias(c)
                       if c in C.FEATURE_COLS else F.col(c) for c in df.columns])


def read_benchmark_csv(spark: SparkSession, path: str) -> DataFrame:
    """A5 (+ C22/C23): labelled benchmark CSV read as text, aliased, features coerced."""
    from flowwatch.operators.evaluate import normalize_benchmark
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    df = normalize_benchmark(raw)
    return df.select(*[coerce_numeric(c).alias(c) if c in C.FEATURE_COLS else F.col(f"`{c}`")
                       for c in df.columns])


def read_alert_log(spark: SparkSession, path: str) -> DataFrame:
    """A6 + B5: alert table tolerant of the older schema without ``confidence``.

    The schema is given, so no footer is read to plan; a file without the column
    gives nulls, which read as 0.  Merged segments are read in place of what they hold."""
    df = read_appended(spark, path, ALERT_LOG) if path_exists(spark, f"{path}/{SEGMENTS}") else spark.read.schema(ALERT_LOG).parquet(path)
    return df.withColumn("confidence", F.coalesce(F.col("confidence"), F.lit(0.0)))


def read_protocol_table(spark: SparkSession, path: str, source_ip: str | None = None) -> DataFrame:
    """Per-protocol counts, optionally for one source (filter pushed to the scan).  Merged segments, in
    which a source lies in few row groups, are read in place of what they hold."""
    df = read_appended(spark, path, PROTOCOL_TABLE) if path_exists(spark, f"{path}/{SEGMENTS}") else spark.read.parquet(path)
    return df.filter(F.col("src_ip") == source_ip) if source_ip is not None else df
