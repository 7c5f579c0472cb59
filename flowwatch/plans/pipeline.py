"""End-to-end detection dataflow (F9), batch form.

``packets -> clean -> windows -> gate -> flows -> rolling -> layers -> fuse -> alerts``

Every stage is a DataFrame transform; the same functions run inside
Structured Streaming micro-batches (:mod:`flowwatch.streaming`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwatch import config as C
from flowwatch.config import DEFAULT, Thresholds
from flowwatch.functions import class_threat, clock_text, round_half_even
from flowwatch.operators.clean import clean_packets
from flowwatch.operators.flows import assign_windows, flow_features
from flowwatch.operators.fusion import apply_precedence, mark_listed
from flowwatch.operators.rolling import rolling_state
from flowwatch.operators.rules import dns_tunnel, rule_classify, slow_attack, weak_label

ALERT_COLUMNS = ["window_id", "window_start_us", "timestamp", "source_ip", "packets_per_sec",
                 "avg_window_size", "syn_ack_ratio", "total_bytes", "traffic_profile",
                 "threat_level", "confidence"]


@dataclass
class Detector:
    """Configuration of the scoring layers.

    ``model``: ``None``, or a ``ClusterModel`` -> no classifier (the rule threat
    stands in, confidence 0); ``"weak_label"`` -> the weak-supervision label as a
    deterministic stand-in; otherwise a ``FlowModel`` from :mod:`flowwatch.operators.ml`.
    """

    th: Thresholds = DEFAULT
    intel: DataFrame | None = None
    baseline: DataFrame | None = None
    model: object = None


def windowed_packets(raw: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """Clean packets with ``window_id`` / ``window_start_us`` (usable times only)."""
    return assign_windows(clean_packets(raw), th)


def flows_with_history(pk: DataFrame, th: Thresholds = DEFAULT, materialize: bool = True) -> DataFrame:
    """Flow features + rolling history.

    The blocked history reads the flows twice (rows and block tails); with
    different pruned columns the two reads cannot share an exchange, so the
    flow table (one row per window and source, far smaller than the packets)
    is checkpointed once to the shared checkpoint folder and both read it.
    """
    flows = flow_features(pk, th)
    if materialize:
        flows = flows.checkpoint(eager=True)
    return rolling_state(flows, th)


def _model_layer(flows: DataFrame, det: Detector) -> DataFrame:
    """model threat + confidence."""
    from flowwatch.operators.ml import ClusterModel, predict
    if det.model is None or isinstance(det.model, ClusterModel):
        return (flows.withColumn("model_threat", F.col("rule_threat"))
                .withColumn("confidence_raw", F.lit(0.0)))
    if det.model == "weak_label":
        return (flows.withColumn("model_threat", class_threat(weak_label(th=det.th)))
                .withColumn("confidence_raw", F.lit(0.0)))
    scored = predict(det.model, flows)
    return (scored.withColumn("model_threat", class_threat(F.col("prediction")))
            .withColumn("confidence_raw", F.col("model_confidence")))


def score_flows(flows: DataFrame, det: Detector) -> DataFrame:
    """All layers side by side (wide table used by the layer-level queries)."""
    th = det.th
    rp, rt = rule_classify(th=th)
    sp, st = slow_attack(th=th)
    dp, dt = dns_tunnel(th=th)
    df = (flows.withColumn("rule_profile", rp).withColumn("rule_threat", rt)
          .withColumn("slow_profile", sp).withColumn("slow_threat", st)
          .withColumn("dns_profile", dp).withColumn("dns_threat", dt))
    df = _model_layer(df, det)
    df = mark_listed(df, det.intel, "intel_hit")
    df = mark_listed(df, det.baseline, "baseline_hit")
    return apply_precedence(df)


def to_alerts(scored: DataFrame) -> DataFrame:
    """T5 projection with display rounding (C14)."""
    return scored.select(
        "window_id",
        "window_start_us",
        clock_text(F.col("window_start_us")).alias("timestamp"),
        F.col("src_ip").alias("source_ip"),
        round_half_even("packets_per_second", 2).alias("packets_per_sec"),
        round_half_even("avg_window_size", 2).alias("avg_window_size"),
        round_half_even("syn_ack_ratio", 2).alias("syn_ack_ratio"),
        F.col("total_bytes").cast("bigint").alias("total_bytes"),
        "traffic_profile",
        "threat_level",
        round_half_even("confidence_raw", 4).alias("confidence"),
    )


def detect(raw: DataFrame, det: Detector | None = None) -> DataFrame:
    """Raw packets -> scored wide flows."""
    det = det or Detector()
    pk = windowed_packets(raw, det.th)
    return score_flows(flows_with_history(pk, det.th), det)


def alerts(raw: DataFrame, det: Detector | None = None) -> DataFrame:
    """Raw packets -> alert table (one row per gated window and source)."""
    return to_alerts(detect(raw, det))
