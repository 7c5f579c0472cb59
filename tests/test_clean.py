"""Cleaning, coercion and file sources."""

import os

import pytest
from pyspark.sql import functions as F

from flowwatch.functions import canonical_port, clean_flag, coerce_numeric
from flowwatch.sources.packets import read_packets_csv
from flowwatch.sources.tables import read_ip_list

CASES = [("5", 5.0), (" 7 ", 7.0), ("1.5", 1.5), (".5", 0.5), ("5.", 5.0), ("1e3", 1000.0), ("+2", 2.0),
         ("-3", -3.0), ("80,443", 80.0), ("1d", 0.0), ("0x1p3", 0.0), ("nan", 0.0), ("NaN", 0.0),
         ("", 0.0), (None, 0.0), ("abc", 0.0), ("1_0", 0.0), ("TRUE", 0.0)]


def test_coerce_numeric(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "x string")
    assert [r[0] for r in df.select(coerce_numeric("x")).collect()] == [c[1] for c in CASES]


def test_clean_flag(spark):
    vals = [("True", 1.0), ("true", 1.0), ("False", 0.0), ("false", 0.0), ("", 0.0), ("nan", 0.0),
            ("1", 1.0), ("0", 0.0), ("True,False", 1.0), ("TRUE", 0.0), (None, 0.0), (" True ", 1.0)]
    df = spark.createDataFrame([(v[0],) for v in vals], "x string")
    assert [r[0] for r in df.select(clean_flag("x")).collect()] == [v[1] for v in vals]


def test_canonical_port(spark):
    vals = [("80", None, "80"), ("80.0", None, "80"), (None, "53", "53"), (None, None, "0"),
            ("80,443", None, "80,443"), ("080", None, "80")]
    df = spark.createDataFrame([v[:2] for v in vals], "t string, u string")
    assert [r[0] for r in df.select(canonical_port("t", "u")).collect()] == [v[2] for v in vals]


HEADER = ",".join(f'"{h}"' for h in ["frame.time_epoch", "ip.src", "ip.dst", "tcp.srcport", "udp.srcport",
                                      "tcp.dstport", "udp.dstport", "_ws.col.Protocol", "frame.len",
                                      "tcp.flags.syn", "tcp.flags.ack", "tcp.flags.fin", "tcp.flags.reset",
                                      "ip.ttl", "tcp.window_size"])


def _write(path, lines):
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def test_packet_csv_edge_cases(spark, tmp):
    good = os.path.join(tmp, "a.csv")
    _write(good, [
        HEADER,
        '"1700000000.5","10.0.0.1","10.0.0.2","1234","","80","","TCP","60","True","False","0","0","64","1024"',
        '"1700000001.0","10.0.0.1","10.0.0.3","1234","","80,443","","TCP","70","True,False","1","0","0","64,63","1024"',
        '"1700000001.5","10.0.0.1"',                                      # short line: kept, padded
        '"1700000002","10.0.0.1","10.0.0.2","1","","80","","TCP","60","0","0","0","0","64","1","x","y"',  # too long
        "",
    ])
    bad = os.path.join(tmp, "b.csv")
    _write(bad, [",".join(HEADER.split(",")[:14]), '"1","2","3","4","5","6","7","8","9","10","11","12","13","14"'])
    hdr_only = os.path.join(tmp, "c.csv")
    _write(hdr_only, [HEADER])
    df = read_packets_csv(spark, [good, bad, hdr_only])
    rows = df.orderBy("ts_us").collect()
    assert [r.ts_us for r in rows] == [1700000000500000, 1700000001000000, 1700000001500000]
    assert rows[1].tcp_dst == "80,443" and rows[2].dst_ip is None


GOOD = '"170000000{}","10.0.0.1","10.0.0.2","1234","","80","","TCP","60","True","False","0","0","64","1024"'


@pytest.mark.parametrize("odd,kept", [
    ('"oops","10.0.0.1"', 6),                                                                            # short
    ('"oops","10.0.0.1","10.0.0.2","1","","80","","TCP","60","0","0","0","0","64","1","x"', 5),         # over-long
    ('"oops","10.0.0.1","10.0.0.2","1","","80","","TCP","60","0","0","0","0","64","1",""', 5),          # over-long by an empty field
    ('"oops","10.0.0.1","10.0.0.2","1","","80","","TCP","60","0","0","0","0","64","1"', 6),             # empty fields
    ('"oops","10.0.0.1","10.0.0.2","1","2","80","3","TCP","60","0","0","0","0","64","1"', 6),           # full
])
def test_a_bad_time_costs_no_file(spark, tmp, odd, kept):
    p = os.path.join(tmp, "a.csv")
    _write(p, [HEADER, *[GOOD.format(i) for i in range(3)], odd, *[GOOD.format(i) for i in (3, 4)]])
    rows = read_packets_csv(spark, p).collect()
    assert len(rows) == kept and sum(r.ts_us == 0 for r in rows) == kept - 5


def test_first_line_is_the_header(spark, tmp):
    """A file without one loses its first row; a 14-column file goes whole, wherever it stands."""
    _write(os.path.join(tmp, "a.csv"), [GOOD.format(i) for i in range(5)])
    _write(os.path.join(tmp, "b.csv"), [",".join(HEADER.split(",")[:14]), *[GOOD.format(i) for i in range(5)]])
    assert read_packets_csv(spark, os.path.join(tmp, "a.csv")).count() == 4
    assert read_packets_csv(spark, tmp).count() == 4


def test_ip_list(spark, tmp):
    p = os.path.join(tmp, "intel.txt")
    _write(p, ["# comment", "192.0.2.66", "", "  198.51.100.7  ", "192.0.2.66", "10.0.0.5   # dashboard host"])
    got = sorted(r.ip for r in read_ip_list(spark, p).collect())
    assert got == ["10.0.0.5", "192.0.2.66", "198.51.100.7"]
    raw = sorted(r.ip for r in read_ip_list(spark, p, strip_inline_comments=False).collect())
    assert "10.0.0.5   # dashboard host" in raw
    assert read_ip_list(spark, os.path.join(tmp, "missing.txt")).count() == 0


def test_packet_time_is_time_zone_free(spark):
    import datetime as dt
    from flowwatch.sources.packets import packet_view
    rows = [(1, dt.datetime(2024, 3, 10, 12, 59, 59, 123456), 5, "click", 1.0, '{"k": 1}')]
    ev = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, "
                                     "value double, props string")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        out = []
        for tz in ("UTC", "America/Los_Angeles", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            out.append(packet_view(ev).first().ts_us)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    us = (dt.datetime(2024, 3, 10, 12, 59, 59, 123456) - dt.datetime(2024, 1, 1)) // dt.timedelta(microseconds=1)
    assert out == [1704067200000000 + us // 16384] * 3
