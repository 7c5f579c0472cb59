"""Greedy throttle vs a sequential fold; notice text and payloads."""

import json
import random

import pytest
from pyspark.sql import functions as F

from flowwatch import config as C
from flowwatch.operators import notify
from flowwatch.operators.throttle import greedy_throttle


def _fold(rows, period):
    kept, last = [], {}
    for k, i, t in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if k not in last or t - last[k] >= period:
            kept.append((k, i))
            last[k] = t
    return sorted(kept)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_throttle_matches_sequential_fold(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(600):
        k = 0 if rnd.random() < 0.5 else rnd.randrange(1, 6)          # one hot key
        t = rnd.randrange(0, 40_000) if rnd.random() < 0.9 else rnd.randrange(0, 40) * 1000
        rows.append((k, i, t))
    df = spark.createDataFrame(rows, "k long, i long, t long")
    got = sorted((r.k, r.i) for r in greedy_throttle(df, ["k"], "t", "i", 3600).collect())
    assert got == _fold(rows, 3600)


@pytest.mark.parametrize("fine", [1, 7, 60, 3600])
def test_successor_levels_agree(spark, fine):
    from flowwatch.operators.throttle import successor
    rnd = random.Random(fine)
    rows = [(rnd.randrange(3), i, rnd.randrange(0, 30_000)) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, i long, t long")
    got = {(r.k, r.i): r.nxt for r in successor(df, ["k"], "t", "i", 3600, fine_per_period=fine).collect()}
    want = {}
    for k, i, t in rows:
        later = sorted((t2, i2) for k2, i2, t2 in rows if k2 == k and t2 >= t + 3600)
        want[(k, i)] = later[0][1] if later else None
    assert got == want


def test_throttle_single_event_and_ties(spark):
    rows = [(0, 1, 5), (0, 2, 5), (0, 3, 3605), (0, 4, 3605), (1, 9, 0)]
    df = spark.createDataFrame(rows, "k long, i long, t long")
    got = sorted((r.k, r.i) for r in greedy_throttle(df, ["k"], "t", "i", 3600).collect())
    assert got == [(0, 1), (0, 3), (1, 9)]


NOTICE = dict(timestamp="12:00:00", source_ip="10.0.0.99", profile="DDoS SYN Flood", threat=C.SEVERE,
              pps=1234.5, sar=9.1, total_bytes=500000, confidence=0.95)


def test_notice_text(spark):
    df = spark.createDataFrame([NOTICE])
    r = notify.with_text(df).first()
    assert r.subject == "[Hybrid IDS] Severe Threat from 10.0.0.99"
    assert r.body == ("Hybrid IDS Severe Alert\n=======================\nTimestamp      : 12:00:00\n"
                      "Source IP      : 10.0.0.99\nTraffic Profile: DDoS SYN Flood\n"
                      f"Threat Level   : {C.SEVERE}\nPackets/sec    : 1234.5\nSYN/ACK Ratio  : 9.10\n"
                      "Total Bytes    : 500000\nConfidence     : 95.0%\n")


def test_half_even_formatting(spark):
    df = spark.createDataFrame([dict(NOTICE, pps=1234.25, sar=2.675)])
    body = notify.with_text(df).first().body
    assert "Packets/sec    : 1234.2\n" in body and "SYN/ACK Ratio  : 2.67\n" in body


def test_fanout_and_payloads(spark):
    cfg = {"email": {"enabled": True, "from_addr": "a@x", "to_addrs": ["b@x", "c@x"]},
           "discord": {"enabled": True}, "slack": {"enabled": False}}
    df = notify.with_text(spark.createDataFrame([NOTICE]))
    out = notify.with_payload(notify.fan_out(df, notify.enabled_channels(cfg)), cfg).collect()
    assert sorted(r.channel for r in out) == ["discord", "email"]
    p = {r.channel: json.loads(r.payload) for r in out}
    assert p["discord"]["username"] == "Hybrid IDS" and p["discord"]["embeds"][0]["color"] == 0xFF3333
    assert p["discord"]["embeds"][0]["description"].startswith("```\nHybrid IDS Severe Alert")
    assert p["email"]["To"] == "b@x, c@x"
    assert notify.fan_out(df, []).count() == 0
    assert notify.enabled_channels(notify.load_channel_config("/nonexistent.json")) == []


def test_exact_rounding_matches_python(spark):
    import random
    from flowwatch.functions import format_fixed
    rnd = random.Random(7)
    vals = [2.675, 1.005, 0.125, 1234.25, 0.05, -2.675, 0.0, 1e-9, 123456.785] + \
           [round(rnd.uniform(-1e4, 1e4), rnd.randrange(1, 5)) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for d in (1, 2, 4):
        got = [r[0] for r in df.select(format_fixed("x", d)).collect()]
        assert got == [f"{v:.{d}f}" for v in vals]
