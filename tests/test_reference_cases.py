"""The original detector's unit cases, as literal fixtures (FIXTURES.md section 2)."""

import pytest
from pyspark.sql import functions as F

from flowwatch import config as C
from flowwatch.operators.flows import assign_windows, flow_features
from flowwatch.operators.rules import dns_tunnel, rule_classify, slow_attack

RULE_CASES = [
    ((600, 10, 1, 200), (C.P_SYN_FLOOD, C.SEVERE)),
    ((2000, 1, 1, 500), (C.P_FLOOD, C.SEVERE)),
    ((400, 1, 1, 900), (C.P_BANDWIDTH, C.BANDWIDTH)),
    ((10, 1, 50, 80), (C.P_SCAN, C.MODERATE)),
    ((2, 1, 1, 80), (C.P_PING, C.BASELINE)),
    ((50, 1, 2, 500), (C.P_WEB, C.BASELINE)),
]


def test_rule_table(spark):
    df = spark.createDataFrame([(float(a), float(b), c, float(d)) for (a, b, c, d), _ in RULE_CASES],
                               "packets_per_second double, syn_ack_ratio double, "
                               "unique_target_ports long, avg_packet_size double")
    p, t = rule_classify()
    got = [(r[0], r[1]) for r in df.select(p, t).collect()]
    assert got == [c[1] for c in RULE_CASES]


SLOW_CASES = [
    ((3, 999, 999, 999), None),
    ((10, 100, 80, 0), C.P_SLOW_SCAN),
    ((10, 300, 10, 200), C.P_SUSTAINED_SYN),
    ((10, 10, 10, 10), None),
]


def test_slow_rules(spark):
    df = spark.createDataFrame([c[0] for c in SLOW_CASES],
                               "rolling_windows long, rolling_packets long, rolling_unique_ports long, rolling_syn long")
    p, t = slow_attack()
    got = df.select(p.alias("p"), t.alias("t")).collect()
    assert [r.p for r in got] == [c[1] for c in SLOW_CASES]
    assert [r.t for r in got] == [C.MODERATE if c[1] else C.BASELINE for c in SLOW_CASES]


@pytest.mark.parametrize("dns,expect", [(61, C.P_DNS_TUNNEL), (60, None), (0, None)])
def test_dns_rule(spark, dns, expect):
    p, _ = dns_tunnel()
    assert spark.createDataFrame([(dns,)], "dns_packets long").select(p).first()[0] == expect


def _packets(spark, rows):
    schema = ("frame_no long, ts_us long, src_ip string, dst_ip string, protocol string, src_port string, "
              "dst_port string, frame_len long, syn double, ack double, fin double, rst double, ttl double, win double")
    return spark.createDataFrame(rows, schema)


def _row(i, src="10.0.0.1", ts=1_700_000_000_000_000, size=100, syn=0.0, proto="TCP"):
    return (i, ts, src, "10.0.0.2", proto, "12345", "80", size, syn, 0.0, 0.0, 0.0, 64.0, 1024.0)


def test_dns_non_dns_protocols_do_not_fire(spark):
    rows = [_row(i, ts=1_700_000_000_000_000 + i, proto=p) for i, p in enumerate(["TCP", "UDP", "HTTP"] * 200)]
    f = flow_features(assign_windows(_packets(spark, rows)))
    p, _ = dns_tunnel()
    assert f.select(p).first()[0] is None


def test_flows_empty_input(spark):
    f = flow_features(assign_windows(_packets(spark, [])))
    assert f.count() == 0
    assert set(C.FEATURE_COLS) <= set(f.columns)


def test_flows_blank_sources(spark):
    rows = [_row(i, src=s) for i, s in enumerate(["", "nan", "NaN", "   "])]
    f = flow_features(assign_windows(_packets(spark, rows)))
    assert f.count() == 0
    assert set(C.FEATURE_COLS) <= set(f.columns)


def test_flows_single_packet(spark):
    # a window needs two packets; the second one has a blank source
    rows = [_row(0, size=200, syn=1.0), _row(1, src="")]
    r = flow_features(assign_windows(_packets(spark, rows))).first()
    assert r.total_packets == 1 and r.total_bytes == 200
    assert r.flow_duration_sec == pytest.approx(0.1)
    assert r.packets_per_second == pytest.approx(10.0)
    assert r.bytes_per_second == pytest.approx(2000.0)
    assert r.avg_packet_size == 200.0
    assert r.iat_mean == 0.0 and r.iat_std == 0.0 and r.packet_size_std == 0.0
