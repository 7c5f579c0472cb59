"""Windows, gate, flow features, inter-arrival stats and protocol counts.

E1 tumbling windows, E2 gate, E4 window count, D1-D6 flow aggregate,
D3/J1 inter-arrival statistics, C12/C13 derived rates.

Plan shape (see ``README.md``):

* Every aggregate is *mergeable*: counts, sums, min/max and exact integer
  moments (sum of squares of sizes, sum of squared time gaps).  Gap moments
  are computed inside small time sub-buckets (``sub_us``) and merged level by
  level with one boundary gap per bucket, so a hot source inside one window is
  spread over many tasks and no task sorts a whole source.
* Standard deviations come from exact integer moments, which makes them
  independent of summation order (bit-identical across partitionings).
* The two distinct counts use Spark's two-phase distinct aggregation
  (map-side de-duplication on ``(key, value)``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowwatch.config import DEFAULT, Thresholds
from flowwatch.functions import is_blank
from flowwatch.operators.clean import usable_time, valid_sources

SUB_US = 10_000            # 10 ms: finest bucket of the gap decomposition
COARSE_SUBS = 6_000        # 60 s of sub-buckets per coarse bucket (global flows)
FLOW_KEYS = ["window_id", "src_ip"]

_DEC = "decimal(38,0)"


def idiv(x: Column, d: int) -> Column:
    """Exact integer division rounding toward negative infinity (``d`` > 0)."""
    return F.call_function("div", x - F.pmod(x, F.lit(d)), F.lit(d))


def window_origin(clean: DataFrame) -> Column:
    """First usable packet time as a scalar subquery (no single-partition window)."""
    return usable_time(clean).select(F.min("ts_us")).scalar()


def assign_windows(clean: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """Half-open ``[t0 + k*2s, t0 + (k+1)*2s)`` windows anchored at the first packet."""
    t0 = window_origin(clean)
    pk = usable_time(clean).withColumn("_rel", F.col("ts_us") - t0)
    return (pk.withColumn("window_id", idiv(F.col("_rel"), th.window_us))
            .withColumn("window_start_us", F.col("ts_us") - F.pmod(F.col("_rel"), F.lit(th.window_us)))
            .drop("_rel"))


def window_packet_counts(pk: DataFrame) -> DataFrame:
    """Packets per window, blank sources included (partial aggregation map-side)."""
    return pk.groupBy("window_id").agg(F.count(F.lit(1)).alias("window_packets"))


def gated_windows(pk: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """Windows with at least ``min_window_packets`` packets."""
    return window_packet_counts(pk).filter(F.col("window_packets") >= th.min_window_packets)


def apply_gate(agg: DataFrame, pk: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """Keep aggregated rows of gated windows.

    An inner join on the *aggregated* rows (one per window and key); a
    semi-join would be pushed below the aggregate onto raw packets, which
    shuffles every packet by window once the window table outgrows a
    broadcast.
    """
    gate = gated_windows(pk, th).withColumnRenamed("window_id", "_gw")
    return agg.join(gate, agg["window_id"] == gate["_gw"]).drop("_gw", "window_packets")


# ---------------------------------------------------------------------------
# Mergeable partial aggregates
# ---------------------------------------------------------------------------

def _partials(valid: DataFrame, keys: list[str], sub: Column, carry=(), extra=()) -> DataFrame:
    """Level 1: per (keys, sub-bucket) partial aggregates incl. in-bucket gaps.

    ``carry``: columns constant per key (e.g. ``window_start_us``) kept via ``min``.
    """
    df = valid.withColumn("_sub", sub)
    w = Window.partitionBy(*keys, "_sub").orderBy("ts_us")
    d = F.col("ts_us") - F.lag("ts_us").over(w)
    df = df.withColumn("_d", d)
    return df.groupBy(*keys, "_sub").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("frame_len").alias("sx"),
        F.sum(F.col("frame_len") * F.col("frame_len")).alias("sxx"),
        F.sum("syn").alias("syn"),
        F.sum("ack").alias("ack"),
        F.sum("fin").alias("fin"),
        F.sum("rst").alias("rst"),
        F.sum("ttl").alias("ttl"),
        F.sum("win").alias("win"),
        F.min("ts_us").alias("lo"),
        F.max("ts_us").alias("hi"),
        F.coalesce(F.sum(F.col("_d") * F.col("_d")), F.lit(0)).alias("s2"),
        F.count_if(F.col("protocol") == "DNS").alias("dns_packets"),
        *[F.min(c).alias(c) for c in carry],
        *extra,
    )


def _merge(parts: DataFrame, keys: list[str], order: str, carry=(), extra=()) -> DataFrame:
    """Merge partials of consecutive buckets; adds the gap between buckets.

    ``extra``: further aggregate expressions computed in the same ``groupBy``."""
    w = Window.partitionBy(*keys).orderBy(order)
    g = (F.col("lo") - F.lag("hi").over(w)).cast(_DEC)
    parts = parts.withColumn("_g2", g * g)
    return parts.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum("sx").alias("sx"),
        F.sum(F.col("sxx").cast(_DEC)).alias("sxx"),
        F.sum("syn").alias("syn"),
        F.sum("ack").alias("ack"),
        F.sum("fin").alias("fin"),
        F.sum("rst").alias("rst"),
        F.sum("ttl").alias("ttl"),
        F.sum("win").alias("win"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        (F.sum(F.col("s2").cast(_DEC)) + F.coalesce(F.sum("_g2"), F.lit(0).cast(_DEC))).alias("s2"),
        F.sum("dns_packets").alias("dns_packets"),
        *[F.min(c).alias(c) for c in carry],
        *extra,
    )


def _distinct_targets(valid: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct destination addresses and ports (nulls not counted)."""
    return valid.groupBy(*keys).agg(
        F.countDistinct("dst_ip").alias("unique_target_ips"),
        F.countDistinct("dst_port").alias("unique_target_ports"),
    )


_TARGETS = {"dst_ip": "unique_target_ips", "dst_port": "unique_target_ports"}


def _target_sketches(lg_k: int) -> list[Column]:
    """D2, approximate: a cardinality sketch of each kind of target, to be merged; at most 2^lg_k registers."""
    return [F.hll_sketch_agg(c, lg_k).alias(f"_{c}s") for c in _TARGETS]


def _target_estimates() -> list[Column]:
    return [F.hll_sketch_estimate(F.hll_union_agg(f"_{c}s")).alias(name) for c, name in _TARGETS.items()]


def sketch_error(lg_k: int) -> float:
    """Relative error of a sketch's estimate that three standard deviations stay within."""
    return 3 * 1.04 / 2 ** (lg_k / 2)


def flow_features_approx(pk: DataFrame, th: Thresholds = DEFAULT, sub_us: int = SUB_US, lg_k: int = 12) -> DataFrame:
    """D1 with approximate distinct targets (D2): :func:`flow_features` in one pass over the packets.

    Each sub-bucket keeps two mergeable sketches, so no packet is shuffled a second time for its
    targets, and packets without a source are partials of their own that count for the gate: a window's
    packets are the sum over its merged rows, one for each source.  Small sets are counted exactly;
    large ones within :func:`sketch_error`.  :func:`flow_features`, the default, is exact."""
    sub = idiv(F.col("ts_us"), sub_us)
    carry = ["window_start_us"] if "window_start_us" in pk.columns else []
    known = pk.withColumn("src_ip", F.when(~is_blank("src_ip"), F.col("src_ip")))
    merged = _merge(_partials(known, FLOW_KEYS, sub, carry, _target_sketches(lg_k)), FLOW_KEYS, "_sub", carry, _target_estimates())
    merged = merged.withColumn("_packets", F.sum("n").over(Window.partitionBy("window_id")))
    flows = merged.filter((F.col("_packets") >= th.min_window_packets) & F.col("src_ip").isNotNull())
    return _derive(flows, FLOW_KEYS, th, carry)


def _derive(m: DataFrame, keys: list[str], th: Thresholds, carry=()) -> DataFrame:
    """18 features from merged moments (all exact until the last step)."""
    n = F.col("n")
    span = F.col("hi") - F.col("lo")
    dur = F.greatest(span.cast("double") / 1e6, F.lit(th.min_duration_s))
    size_var_num = (n.cast(_DEC) * F.col("sxx") - F.col("sx").cast(_DEC) * F.col("sx").cast(_DEC))
    size_std = F.when(n > 1, F.sqrt(size_var_num.cast("double") / (n.cast("double") * (n - 1).cast("double")))) \
        .otherwise(F.lit(0.0))
    gaps = n - 1
    iat_var_num = gaps.cast(_DEC) * F.col("s2") - span.cast(_DEC) * span.cast(_DEC)
    iat_mean = F.when(n > 1, span.cast("double") / gaps / 1e6).otherwise(F.lit(0.0))
    iat_std = F.when(n > 1, F.sqrt(iat_var_num.cast("double") / (gaps.cast("double") * gaps.cast("double"))) / 1e6) \
        .otherwise(F.lit(0.0))
    return m.select(
        *keys,
        n.alias("total_packets"),
        F.col("sx").alias("total_bytes"),
        F.col("unique_target_ips"),
        F.col("unique_target_ports"),
        F.col("syn").alias("total_syn_flags"),
        F.col("ack").alias("total_ack_flags"),
        F.col("fin").alias("total_fin_flags"),
        F.col("rst").alias("total_rst_flags"),
        (F.col("ttl") / n).alias("avg_ttl"),
        (F.col("win") / n).alias("avg_window_size"),
        dur.alias("flow_duration_sec"),
        (n / dur).alias("packets_per_second"),
        (F.col("sx") / dur).alias("bytes_per_second"),
        (F.col("sx") / n).alias("avg_packet_size"),
        (F.col("syn") / (F.col("ack") + 1)).alias("syn_ack_ratio"),
        size_std.alias("packet_size_std"),
        iat_mean.alias("iat_mean"),
        iat_std.alias("iat_std"),
        F.col("lo").alias("first_packet_us"),
        F.col("hi").alias("last_packet_us"),
        F.col("dns_packets"),
        *carry,
    )


def flow_features(pk: DataFrame, th: Thresholds = DEFAULT, sub_us: int = SUB_US) -> DataFrame:
    """Per (window_id, src_ip) features of gated windows.

    ``pk`` is the output of :func:`assign_windows`.  Three aggregates, none of
    which holds a source's or a window's rows together:

    * partials per (window, source, 10 ms sub-bucket) of packets with a source,
      merged per (window, source);
    * distinct targets in two levels, (window, source, value) and then counts,
      so a scanner's targets are spread over all tasks and never one row;
    * packets per window, blank sources included, for the gate: one row per
      window, joined to the merged rows.
    """
    sub = idiv(F.col("ts_us"), sub_us)
    carry = ["window_start_us"] if "window_start_us" in pk.columns else []
    valid = valid_sources(pk)
    merged = _merge(_partials(valid, FLOW_KEYS, sub, carry), FLOW_KEYS, "_sub", carry)
    flows = apply_gate(merged, pk, th).join(_distinct_targets(valid, FLOW_KEYS), FLOW_KEYS)
    return _derive(flows, FLOW_KEYS, th, carry)


def flow_features_global(clean: DataFrame, th: Thresholds = DEFAULT, sub_us: int = SUB_US,
                         coarse_subs: int = COARSE_SUBS) -> DataFrame:
    """D1 (training variant): one flow per source over the whole dataset.

    Three-level gap decomposition (10 ms -> 60 s -> source) so that a source
    holding a large share of all packets is still split across tasks; every
    window partition is bounded by the bucket geometry, not by data volume.
    """
    valid = valid_sources(clean)
    keys = ["src_ip"]
    sub = idiv(F.col("ts_us"), sub_us)
    p1 = _partials(valid, keys, sub).withColumn("_coarse", idiv(F.col("_sub"), coarse_subs))
    p2 = _merge(p1, keys + ["_coarse"], "_sub")
    merged = _merge(p2, keys, "_coarse")
    flows = merged.join(_distinct_targets(valid, keys), keys)
    return _derive(flows, keys, th)


def protocol_breakdown(pk: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """Packets and bytes per (window, source, protocol) of gated windows."""
    rows = pk.filter(~is_blank("src_ip") & ~is_blank("protocol"))
    agg = rows.groupBy("window_id", "src_ip", "protocol").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("frame_len").alias("bytes"))
    return apply_gate(agg, pk, th)


def iat_stats(pk: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """D3 as its own table (all windows with a valid source, gate not applied)."""
    valid = valid_sources(pk)
    sub = idiv(F.col("ts_us"), SUB_US)
    merged = _merge(_partials(valid, FLOW_KEYS, sub), FLOW_KEYS, "_sub")
    n = F.col("n")
    span = F.col("hi") - F.col("lo")
    gaps = n - 1
    num = gaps.cast(_DEC) * F.col("s2") - span.cast(_DEC) * span.cast(_DEC)
    return merged.select(
        *FLOW_KEYS,
        F.when(n > 1, span.cast("double") / gaps / 1e6).otherwise(F.lit(0.0)).alias("iat_mean"),
        F.when(n > 1, F.sqrt(num.cast("double") / (gaps.cast("double") * gaps.cast("double"))) / 1e6)
        .otherwise(F.lit(0.0)).alias("iat_std"),
    )
