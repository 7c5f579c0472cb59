"""Structured Streaming run equals the batch run."""

import os
import time

from pyspark.sql import functions as F

from flowwatch.operators import notify
from flowwatch.operators.flows import protocol_breakdown
from flowwatch.plans.pipeline import Detector, alerts, detect, windowed_packets
from flowwatch.sources.packets import RAW_ORDER, packets_from_events
from flowwatch.streaming import state
from flowwatch.streaming.pipeline import late_rows, late_rows_total, packet_stream, stage_replay_files, start_detection_stream

from conftest import SF001


def test_stream_equals_batch(spark, tmp):
    raw = packets_from_events(spark, SF001).select(
        *[F.col(c).cast("string").alias(c) if c not in ("frame_no", "ts_us") else F.col(c) for c in RAW_ORDER])
    inp = os.path.join(tmp, "in")
    # time-ordered files, a far-future flush packet, then one packet far behind the watermark
    t0 = stage_replay_files(raw, inp, chunks=4, late_packet=True)
    out = os.path.join(tmp, "out")
    intel = spark.createDataFrame([("10.0.0.9",)], "ip string")
    det = Detector(intel=intel)
    cfg = {"email": {"enabled": True}, "discord": {"enabled": True}}
    q = start_detection_stream(spark, packet_stream(spark, inp, max_files_per_trigger=1), out,
                               os.path.join(tmp, "ckpt"), det=det, origin_us=t0, trigger={"availableNow": True},
                               notify_cfg=cfg)
    q.awaitTermination(600)
    assert q.exception() is None
    assert late_rows(q) == 1
    for _ in range(50):                                  # listeners hear of a batch a little later
        if late_rows_total(spark, out):
            break
        time.sleep(0.2)
    assert late_rows_total(spark, out) == 1
    got = spark.read.parquet(os.path.join(out, "alerts")).drop("batch_id")
    want = alerts(raw, det)
    cols = want.columns
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.collect()))
    # no state is kept that no retry can ask for
    n = 1 + max(p["batchId"] for p in q.recentProgress if p["numInputRows"])
    kept = {d for d in os.listdir(os.path.join(out, "state")) if d.startswith("batches-")}
    live = set(state.live_segments(n)) | set(state.live_segments(n - 1)) | {(n - 1, n - 1)}
    assert kept and kept <= {os.path.basename(state.segment_path("", s)) for s in live}
    assert len([d for d in os.listdir(os.path.join(out, "throttle_state")) if d.startswith("batch_id=")]) == 2
    # protocols as in batch
    pk = windowed_packets(raw)
    protos = spark.read.parquet(os.path.join(out, "protocol_breakdown"))
    cols = ["window_id", "src_ip", "protocol", "packets", "bytes"]
    assert sorted(map(tuple, protos.select(*cols).collect())) == sorted(map(tuple, protocol_breakdown(pk).select(*cols).collect()))
    outbox = spark.read.parquet(os.path.join(out, "outbox")).select("window_id", "source_ip", "channel", "payload")
    batch_outbox = notify.outbox(detect(raw, det), cfg).select("window_id", "source_ip", "channel", "payload")
    assert outbox.count() > 0
    assert sorted(map(tuple, outbox.collect())) == sorted(map(tuple, batch_outbox.collect()))


def test_stop_restart_failed_batch_and_csv(spark, tmp):
    """A stream of CSV files, stopped and started again, with a batch that fails once and is
    run again, ends with what the batch run gives."""
    from flowwatch import config as C
    from flowwatch.sources.packets import read_packets_csv
    from flowwatch.streaming import pipeline
    raw = packets_from_events(spark, SF001)
    inp, out, ckpt = (os.path.join(tmp, d) for d in ("in", "out", "ckpt"))
    os.makedirs(inp)
    rows = raw.filter("ts_us > 0").orderBy("ts_us", "frame_no").collect()
    size = len(rows) // 4 + 1
    for n in range(5):
        part = rows[n * size:(n + 1) * size]
        with open(os.path.join(inp, f"{n}.csv"), "w") as f:
            f.write(",".join(C.PACKET_FIELDS) + "\n")
            for r in part:
                t = f"{r.ts_us // 1_000_000}.{r.ts_us % 1_000_000:06d}"
                f.write(",".join(f'"{"" if v is None else v}"' for v in (t, *r[2:])) + "\n")
            if n == 4:
                f.write(f'"{rows[-1].ts_us // 1_000_000 + 3600}","",""\n')
        os.utime(os.path.join(inp, f"{n}.csv"), (1_700_000_000 + n, 1_700_000_000 + n))
    batch = read_packets_csv(spark, inp)
    t0 = batch.filter("ts_us > 0").agg(F.min("ts_us")).first()[0]

    def run():
        q = start_detection_stream(spark, packet_stream(spark, inp, "csv", max_files_per_trigger=1), out, ckpt,
                                   origin_us=t0, trigger={"availableNow": True}, notify_cfg={"email": {"enabled": True}})
        q.awaitTermination(600)
        return q

    calls, real = [], pipeline.process_batch

    def fails_once(df, batch_id, *rest):
        calls.append(batch_id)
        real(df, batch_id, *rest)
        if calls.count(2) == 1 and batch_id == 2:
            raise RuntimeError("lost after its writes")

    pipeline.process_batch = fails_once
    try:
        try:
            run()
        except Exception:
            pass
        run()
    finally:
        pipeline.process_batch = real
    assert calls.count(2) == 2
    want = alerts(batch.filter(f"ts_us <= {rows[-1].ts_us}"))
    got = spark.read.parquet(os.path.join(out, "alerts")).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
