"""S2, D2, D3 in streams: segments of history, counted packets, the fold of the throttle."""

import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from flowwatch.config import DEFAULT
from flowwatch.operators.clean import clean_packets
from flowwatch.operators.flows import assign_windows, flow_features
from flowwatch.operators.throttle import greedy_throttle
from flowwatch.sources.packets import RAW_ORDER, packets_from_events
from flowwatch.streaming import pipeline, state

from conftest import SF001


@pytest.mark.parametrize("fanout", [2, 3, 8])
def test_segments_are_a_counter(fanout):
    """Live segments cover all batches once; what a batch or its retry reads is there; few are live."""
    there = set()
    for n in range(700):
        live = state.live_segments(n, fanout)
        assert [b for a, z in live for b in range(a, z + 1)] == list(range(n))
        for _ in range(2):                               # a run and a retry
            assert set(live) <= there
            there.add((n, n))
            whole, parts = state.merged_by(n, fanout)
            if whole:
                assert set(parts) <= there and sum(z - a + 1 for a, z in parts) == whole[1] - whole[0] + 1
                there.add(whole)
            if n:
                there -= set(state.merged_by(n - 1, fanout)[1])
        digits = len(live)
        assert digits <= (fanout - 1) * 12 and len(there) <= digits + 2 * fanout * 12


def test_history_equals_the_last_windows(spark, tmp):
    r = random.Random(1)
    naive = defaultdict(list)
    for n in range(12):
        names = r.sample([f"s{i}" for i in range(30)], 6)
        new = [(s, 10 * n + k, r.randrange(99), r.randrange(9), float(r.randrange(5))) for s in names for k in range(r.randint(1, 4))]
        for _ in range(1 + (n % 5 == 3)):                # some batches run twice
            flows = spark.createDataFrame(new, "src_ip string, window_id bigint, total_packets bigint, unique_target_ports bigint, total_syn_flags double")
            past = state.history(spark, tmp, n, flows.select("src_ip").distinct(), fanout=3)
            got = sorted(map(tuple, past.collect())) if past is not None else []
            assert got == sorted((s, *x) for s in names for x in naive[s])
            both = flows if past is None else flows.unionByName(past)
            state.write_history(both, tmp, n, fanout=3)
            state.forget(spark, tmp, n, fanout=3)
        for s, *x in new:
            naive[s].append(tuple(x))
        for s in names:
            naive[s] = sorted(naive[s])[-(DEFAULT.rolling_windows - 1):]
    # a lost segment is an error, not a new beginning
    lost = state.segment_path(tmp, state.live_segments(12, 3)[0])
    os.rename(lost, lost + "-gone")
    with pytest.raises(FileNotFoundError):
        state.history(spark, tmp, 12, flows.select("src_ip").distinct(), fanout=3)


def counted(raw, th=DEFAULT):
    """The stream's aggregate, run over a batch."""
    return pipeline.counted_packets(raw, th)


def test_counted_packets_give_the_batch_features(spark):
    raw = packets_from_events(spark, SF001)
    t0 = clean_packets(raw).filter("ts_us > 0").agg(F.min("ts_us")).first()[0]
    rows = pipeline.counted_packets(raw, DEFAULT, origin_us=t0)
    got = pipeline.batch_flows(rows)
    want = flow_features(assign_windows(clean_packets(raw))).filter("true")
    gate = rows.groupBy("window_id").agg(F.sum("n").alias("p")).filter(F.col("p") >= DEFAULT.min_window_packets)
    got = got.join(gate, "window_id", "left_semi").select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_million_targets_in_one_window(spark):
    n = 1_000_000
    rows = spark.range(n).select(
        F.lit(0).cast("bigint").alias("window_id"), F.lit(0).cast("bigint").alias("window_start_us"), F.lit("10.0.0.1").alias("src_ip"),
        (F.col("id") * 2 + 5).alias("ts_us"), F.lit("TCP").alias("protocol"), F.concat(F.lit("t"), "id").alias("dst_ip"),
        F.lit(None).cast("string").alias("dst_port"), F.lit(1).cast("bigint").alias("n"), F.lit(60).cast("bigint").alias("sx"),
        F.lit(3600).cast("bigint").alias("sxx"), *[F.lit(1.0).alias(c) for c in ("syn", "ack", "fin", "rst", "ttl", "win")])
    f = pipeline.batch_flows(rows).first()
    assert f.unique_target_ips == n and f.unique_target_ports == 0 and f.total_packets == n
    assert f.iat_mean == 2e-6 and f.iat_std == 0.0


def test_no_lists_in_the_streams_state(spark, tmp):
    raw = packets_from_events(spark, SF001).select(*[F.col(c).cast("string").alias(c) if c not in ("frame_no", "ts_us") else F.col(c) for c in RAW_ORDER])
    raw.write.parquet(os.path.join(tmp, "in"))
    rows = pipeline.counted_packets(pipeline.packet_stream(spark, os.path.join(tmp, "in")))
    plans = rows._jdf.queryExecution().analyzed().toString()
    flows = pipeline.batch_flows(pipeline.counted_packets(raw))
    plans += flows._jdf.queryExecution().executedPlan().toString()
    assert "collect_" not in plans and "flatten" not in plans


def test_fold_throttle_equals_greedy(spark):
    r = random.Random(7)
    period = 3_600_000_000
    events = sorted({(f"k{r.randrange(5)}", r.randrange(40) * 900_000_000) for _ in range(150)})
    kept, last = [], None
    for part in (events[:0], [e for e in events if e[1] < 9e9], [e for e in events if 9e9 <= e[1] < 2e10], [e for e in events if e[1] >= 2e10]):
        d = spark.createDataFrame(part, "source_ip string, window_start_us bigint")
        got = pipeline.fold_throttle(d, last, period).collect()
        kept += [(x.source_ip, t) for x in got for t in x.kept]
        newest = {}
        for s, t in kept:
            newest[s] = max(t, newest.get(s, t))
        last = spark.createDataFrame(sorted(newest.items()), "source_ip string, last_kept_us bigint")
    d = spark.createDataFrame([(s, t, i) for i, (s, t) in enumerate(events)], "source_ip string, window_start_us bigint, id bigint")
    want = greedy_throttle(d, ["source_ip"], "window_start_us", "id", period).select("source_ip", "window_start_us")
    assert sorted(kept) == sorted(map(tuple, want.collect()))
