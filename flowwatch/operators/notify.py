"""Severe-alert notices (N1, N3, C20, C21, B8 outbox rows).

Delivery (SMTP / webhooks) is not built: the outbox holds one row per
(notice, enabled channel) with the message text and payload, ready for a
delivery job.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwatch import config as C
from flowwatch.config import DEFAULT, Thresholds
from flowwatch.functions import format_fixed
from flowwatch.operators.throttle import greedy_throttle


def load_channel_config(path: str | None) -> dict:
    """Channel configuration; missing or malformed file -> no channels (notices off)."""
    if not path or not os.path.exists(path):
        return {}
    try:
        with open(path, encoding="utf-8") as f:
            cfg = json.load(f)
    except (OSError, json.JSONDecodeError):
        return {}
    return cfg if isinstance(cfg, dict) else {}


def enabled_channels(cfg: dict) -> list[str]:
    return [c for c in C.CHANNELS if isinstance(cfg.get(c), dict) and cfg[c].get("enabled")]


def notice_records(scored: DataFrame) -> DataFrame:
    """Severe flows as notice records (unrounded pps / sar, as sent)."""
    return scored.filter(F.col("threat_level") == C.SEVERE).select(
        "window_id", "window_start_us",
        F.col("src_ip").alias("source_ip"),
        F.col("traffic_profile").alias("profile"),
        F.col("threat_level").alias("threat"),
        F.col("packets_per_second").alias("pps"),
        F.col("syn_ack_ratio").alias("sar"),
        F.col("total_bytes").cast("bigint").alias("total_bytes"),
        F.col("confidence_raw").alias("confidence"),
    )


def _fixed(x, digits: int):
    return format_fixed(x, digits)


def with_text(notices: DataFrame, clock: str = "timestamp") -> DataFrame:
    """C20: subject and body exactly as the mail/webhook text."""
    body = F.concat(
        F.lit(C.NOTICE_TITLE + "\n" + "=" * len(C.NOTICE_TITLE) + "\n"),
        F.lit("Timestamp      : "), F.col(clock), F.lit("\n"),
        F.lit("Source IP      : "), F.col("source_ip"), F.lit("\n"),
        F.lit("Traffic Profile: "), F.col("profile"), F.lit("\n"),
        F.lit("Threat Level   : "), F.col("threat"), F.lit("\n"),
        F.lit("Packets/sec    : "), _fixed(F.col("pps"), 1), F.lit("\n"),
        F.lit("SYN/ACK Ratio  : "), _fixed(F.col("sar"), 2), F.lit("\n"),
        F.lit("Total Bytes    : "), F.col("total_bytes").cast("string"), F.lit("\n"),
        F.lit("Confidence     : "), _fixed(F.col("confidence") * 100, 1), F.lit("%\n"),
    )
    return (notices.withColumn("subject", F.concat(F.lit(C.NOTICE_SUBJECT_PREFIX), F.col("source_ip")))
            .withColumn("body", body))


def throttle_notices(notices: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """N2 per source: the kept sequence is the same for every channel (each
    channel's slot is consumed at attempt time with identical times), so the
    throttle runs once per source and channels fan out afterwards."""
    return greedy_throttle(notices, ["source_ip"], "window_start_us", "window_id", th.throttle_s * 1_000_000)


def fan_out(notices: DataFrame, channels: list[str]) -> DataFrame:
    """One row per (notice, enabled channel); no channels -> no rows.

    The channel list is configuration (at most three names), expanded with a
    generator, not a join.
    """
    if not channels:
        return notices.withColumn("channel", F.lit(None).cast("string")).limit(0)
    return notices.withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels])))


def with_payload(outbox: DataFrame, cfg: dict | None = None) -> DataFrame:
    """Per-channel JSON payload (two webhook shapes) or mail envelope."""
    cfg = cfg or {}
    email = cfg.get("email", {}) if isinstance(cfg.get("email"), dict) else {}
    to_addrs = ", ".join(email.get("to_addrs", []) or [])
    discord = F.to_json(F.struct(
        F.lit(C.NOTICE_SENDER).alias("username"),
        F.array(F.struct(
            F.col("subject").alias("title"),
            F.concat(F.lit("```\n"), F.col("body"), F.lit("\n```")).alias("description"),
            F.lit(C.NOTICE_COLOR).alias("color"))).alias("embeds")))
    slack = F.to_json(F.struct(
        F.concat(F.lit("*"), F.col("subject"), F.lit("*\n```\n"), F.col("body"), F.lit("\n```")).alias("text")))
    mail = F.to_json(F.struct(
        F.lit(email.get("from_addr", "")).alias("From"),
        F.lit(to_addrs).alias("To"),
        F.col("subject").alias("Subject"),
        F.col("body").alias("body")))
    payload = (F.when(F.col("channel") == "discord", discord)
               .when(F.col("channel") == "slack", slack)
               .otherwise(mail))
    return outbox.withColumn("payload", payload)


def outbox(scored: DataFrame, cfg: dict, th: Thresholds = DEFAULT) -> DataFrame:
    """Throttled, fanned-out notice rows with text and payload."""
    from flowwatch.functions import clock_text
    n = notice_records(scored).withColumn("timestamp", clock_text(F.col("window_start_us")))
    n = with_text(throttle_notices(n, th))
    return with_payload(fan_out(n, enabled_channels(cfg)), cfg)
