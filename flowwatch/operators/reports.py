"""Operational reports over the alert table (section 2.4 / 2.8 dashboard views).

Every report is a DataFrame function of the alert table (and the protocol
table); top-N views are ``orderBy(...).limit(n)`` which plans as a
distributed top-k (``TakeOrderedAndProject``), never a full sort to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwatch import config as C
from flowwatch.config import DEFAULT, Thresholds
from flowwatch.functions import block_rule_name, round_half_away, severity_of

def newest_first():
    """Alert id order, newest first (``id`` order == (window_id, source_ip))."""
    return [F.col("window_id").desc(), F.col("source_ip").desc()]


def alert_view(alerts: DataFrame) -> DataFrame:
    """C17: all alerts in dashboard columns, confidence in percent.  Every total,
    distribution and queue below reads this view; only the two pages limit."""
    return alerts.select(
        "window_id",
        F.col("timestamp").alias("time"),
        "source_ip",
        "packets_per_sec",
        F.col("avg_window_size").alias("avg_window"),
        "syn_ack_ratio",
        "total_bytes",
        "traffic_profile",
        "threat_level",
        round_half_away(F.col("confidence") * 100, 1).alias("confidence_pct"),
    )


def latest_alerts(view: DataFrame, limit: int = C.LATEST_ALERTS) -> DataFrame:
    """H1: the newest alerts of the view, newest first."""
    return view.orderBy(*newest_first()).limit(limit)


def with_severity(df: DataFrame) -> DataFrame:
    return df.withColumn("severity", severity_of("threat_level"))


def severity_filter(view: DataFrame, severities=tuple(C.SEVERITY_BUCKETS)) -> DataFrame:
    """C15 + C16: keep rows whose severity bucket is selected."""
    return view.filter(severity_of("threat_level").isin(*severities))


def alert_page(view: DataFrame, severities=tuple(C.SEVERITY_BUCKETS), size: int = C.ALERT_PAGE) -> DataFrame:
    """H2: first page of the filtered view, newest first."""
    return severity_filter(view, severities).orderBy(*newest_first()).limit(size)


def soc_metrics(view: DataFrame, blocked: DataFrame) -> DataFrame:
    """Headline counters (one row)."""
    m = view.agg(
        F.count(F.lit(1)).alias("total_flows"),
        F.count_if(F.col("threat_level") == C.SEVERE).alias("critical_threats"),
        F.countDistinct("source_ip").alias("unique_sources"),
    )
    b = blocked.agg(F.countDistinct("ip").alias("blocked_ips"))
    return _one_row_pair(m, b)


def _one_row_pair(a: DataFrame, b: DataFrame) -> DataFrame:
    """Side-by-side of two single-row aggregates (the second as scalar subqueries)."""
    return a.select("*", *[b.select(c).scalar().alias(c) for c in b.columns])


def threat_distribution(view: DataFrame) -> DataFrame:
    """Alerts per threat level."""
    return view.groupBy("threat_level").agg(F.count(F.lit(1)).alias("count"))


def top_talkers(view: DataFrame, n: int = C.TOP_TALKERS) -> DataFrame:
    """H3: sources with most alerts (ties by address)."""
    return (view.groupBy("source_ip").agg(F.count(F.lit(1)).alias("flows"))
            .orderBy(F.col("flows").desc(), F.col("source_ip")).limit(n))


def protocol_mix(breakdown: DataFrame, source_ip: str | None = None) -> DataFrame:
    """Packets per protocol (for one source, or per source when ``None``).

    The source predicate is a plain filter, so on a parquet protocol table it
    is pushed into the scan.
    """
    if source_ip is not None:
        return (breakdown.filter(F.col("src_ip") == source_ip)
                .groupBy("protocol").agg(F.sum("packets").alias("pkts")))
    return breakdown.groupBy("src_ip", "protocol").agg(F.sum("packets").alias("pkts"))


def threat_timeline(view: DataFrame) -> DataFrame:
    """Severity counts per window start, three columns forced and zero-filled."""
    return (with_severity(view).groupBy("window_id", "time")
            .pivot("severity", C.SEVERITY_BUCKETS).count().na.fill(0, C.SEVERITY_BUCKETS)
            .orderBy("window_id"))


def distinct_sources(view: DataFrame) -> DataFrame:
    """H5."""
    return view.select("source_ip").distinct()


def mitigation_queue(view: DataFrame, blocked: DataFrame) -> DataFrame:
    """D20 + J5 + C19: severe sources not yet blocked, alert counts and rule name."""
    severe = view.filter(F.col("threat_level") == C.SEVERE)
    per_src = severe.groupBy("source_ip").agg(F.count(F.lit(1)).alias("severe_alerts"))
    open_ = per_src.join(blocked.select(F.col("ip").alias("source_ip")), "source_ip", "left_anti")
    return open_.withColumn("rule_name", block_rule_name("source_ip"))


def mitigation_status(view: DataFrame, blocked: DataFrame) -> DataFrame:
    """How many severe sources are blocked / awaiting mitigation (one row)."""
    severe = view.filter(F.col("threat_level") == C.SEVERE).select("source_ip").distinct()
    b = blocked.select(F.col("ip").alias("source_ip")).distinct()
    blocked_n = severe.join(b, "source_ip", "left_semi").agg(F.count(F.lit(1)).alias("mitigated"))
    total = severe.agg(F.count(F.lit(1)).alias("severe_sources"))
    out = _one_row_pair(total, blocked_n)
    out = out.withColumn("awaiting", F.col("severe_sources") - F.col("mitigated"))
    return out.withColumn(
        "status",
        F.when(F.col("awaiting") > 0, F.lit("awaiting mitigation"))
        .when(F.col("severe_sources") > 0, F.lit("all mitigated"))
        .otherwise(F.lit("no critical threats")))


def window_severity_counts(alerts: DataFrame) -> DataFrame:
    """Per window, alerts of each of the four threat levels (zero-filled)."""
    names = {C.BASELINE: "baseline", C.MODERATE: "moderate", C.BANDWIDTH: "bandwidth", C.SEVERE: "severe"}
    p = alerts.groupBy("window_id").pivot("threat_level", C.THREAT_LEVELS).count().na.fill(0, C.THREAT_LEVELS)
    return p.select("window_id", *[F.col(f"`{k}`").alias(v) for k, v in names.items()])


def total_window_count(pk: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """E4 as a one-row frame: ``max(1, span div 2 s + 1)``."""
    span = F.max("ts_us") - F.min("ts_us")
    return pk.agg(F.greatest(F.lit(1), F.floor(span / F.lit(th.window_us)).cast("bigint") + 1)
                  .alias("windows_processed"))


def replay_summary(pk: DataFrame, alerts: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """Windows processed (skipped included), flows scored, per-severity totals."""
    a = alerts.agg(
        F.count(F.lit(1)).alias("flows_scored"),
        F.count_if(F.col("threat_level") == C.BASELINE).alias("baseline"),
        F.count_if(F.col("threat_level").isin(C.MODERATE, C.BANDWIDTH)).alias("moderate"),
        F.count_if(F.col("threat_level") == C.SEVERE).alias("severe"),
    )
    return _one_row_pair(total_window_count(pk, th), a)


#: window ids made from one row
ID_CHUNK = 4096


def window_ids(spark: SparkSession, n: Column) -> DataFrame:
    """window_id 0 to ``n`` - 1, in chunks dealt to as many tasks as a shuffle has, so that
    no row or task holds them all (without a number, adaptive execution would merge them)."""
    size = F.lit(ID_CHUNK).cast("bigint")
    last = F.floor((n - 1) / size).cast("bigint")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = spark.range(1).select(F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk")).repartition(tasks, "chunk")
    first = F.col("chunk") * size
    return chunks.select(F.explode(F.sequence(first, F.least(first + size, n) - 1)).alias("window_id"))


def window_progress(spark: SparkSession, pk: DataFrame, alerts: DataFrame,
                    th: Thresholds = DEFAULT) -> DataFrame:
    """Per window id (empty windows included): packets, flows, severe, skipped.

    Ids come from the window count as a scalar subquery; ids, packets and flows
    are stacked and summed in one aggregate, so nothing is joined and nothing
    runs while the plan is built.
    """
    n = total_window_count(pk, th).scalar()
    zero = F.lit(0).cast("bigint")
    ids = window_ids(spark, n).select("window_id", zero.alias("packets"), zero.alias("flows"), zero.alias("severe"))
    packets = pk.groupBy("window_id").agg(F.count(F.lit(1)).alias("packets")).select(
        "window_id", "packets", zero.alias("flows"), zero.alias("severe"))
    flows = alerts.select("window_id", zero.alias("packets"), F.lit(1).cast("bigint").alias("flows"),
                          (F.col("threat_level") == C.SEVERE).cast("bigint").alias("severe"))
    out = ids.unionByName(packets).unionByName(flows).groupBy("window_id").agg(
        *[F.sum(c).alias(c) for c in ("packets", "flows", "severe")])
    return out.withColumn("skipped", F.col("packets") < th.min_window_packets)
