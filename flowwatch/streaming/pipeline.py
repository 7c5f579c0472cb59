"""Structured Streaming form of the detection dataflow.

``readStream`` (packet files) -> clean -> watermark -> counted packets of 2 s
windows in append mode -> ``foreachBatch``:

* the streaming state holds no lists: it is a counted multiset of packets, keyed by
  window, source, time, protocol and target, spread over the state store's partitions.
  The watermark closes every key of a window in the same micro-batch, so a
  batch holds whole windows and the gate (blank sources included) is evaluated there;
* in the batch, gap moments come from ``lag`` inside 10 ms sub-buckets and are
  merged, and distinct targets are counted in two levels, both as in batch;
* rolling history (S2) is a log of segments (:mod:`flowwatch.streaming.state`): a batch
  reads the history of the sources it sees and writes theirs only;
* alerts, protocol counts and the notice outbox are idempotent partition
  overwrites keyed by ``batch_id`` (S5: restart from the checkpoint).

Windows are epoch-aligned with an optional ``origin_us`` offset (a stream
cannot know its first packet); with ``origin_us`` = the batch anchor the
stream reproduces the batch alerts exactly.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from flowwatch.config import DEFAULT, Thresholds
from flowwatch.functions import is_blank
from flowwatch.operators.clean import clean_packets
from flowwatch.operators.flows import FLOW_KEYS, SUB_US, _derive, _merge, idiv
from flowwatch.operators.rolling import rolling_state
from flowwatch.plans.pipeline import Detector, score_flows, to_alerts
from flowwatch.sinks.writers import append_table, write_protocol_breakdown
from flowwatch.session import path_exists
from flowwatch.sources.packets import RAW_ORDER, packets_of_files
from flowwatch.streaming import state

def raw_schema_typed() -> T.StructType:
    """Raw packet layout as written by :func:`flowwatch.sources.packets.packet_view`."""
    f = [T.StructField("frame_no", T.LongType()), T.StructField("ts_us", T.LongType())]
    for c in RAW_ORDER[2:]:
        f.append(T.StructField(c, T.StringType()))
    return T.StructType(f)


def packet_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """Unbounded packet source over a directory of packet files.

    CSV files are admitted one by one, each whole: a file that can't be read to its end, is not
    UTF-8 or whose header has not 15 fields gives no rows, as in batch, and does not stop the stream."""
    r = spark.readStream
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        return packets_of_files(r.option("ignoreCorruptFiles", True).text(path, wholetext=True))
    return r.schema(raw_schema_typed()).parquet(path)


#: what is summed over equal packets
_SUMS = ["frame_len", "syn", "ack", "fin", "rst", "ttl", "win"]
_NAMES = {"frame_len": "sx"}


def counted_packets(raw: DataFrame, th: Thresholds = DEFAULT, watermark: str = "4 seconds", origin_us: int = 0) -> DataFrame:
    """Streaming counted multiset of packets: sums per (window, source, time, protocol, target).

    Packets without a source only count for the gate: they are one key a window."""
    clean = clean_packets(raw).filter(F.col("ts_us") > 0)
    ev = clean.withColumn("event_time", F.timestamp_micros("ts_us")).withColumn("_blank", is_blank("src_ip"))
    keys = ["src_ip", "ts_us", "protocol", "dst_ip", "dst_port"]
    for c in keys:
        ev = ev.withColumn(c, F.when(~F.col("_blank"), F.col(c)))
    offset = origin_us % th.window_us
    win = F.window("event_time", f"{th.window_us} microseconds", startTime=f"{offset} microseconds")
    agg = ev.withWatermark("event_time", watermark).groupBy(win.alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("frame_len") * F.col("frame_len")).alias("sxx"),
        *[F.sum(c).alias(_NAMES.get(c, c)) for c in _SUMS])
    start = F.unix_micros(F.col("w.start"))
    return agg.select(idiv(start - F.lit(origin_us), th.window_us).alias("window_id"),
                      start.alias("window_start_us"), "*").drop("w")


def _sub_buckets(rows: DataFrame, sub_us: int = SUB_US) -> DataFrame:
    """Partials per (window, source, 10 ms sub-bucket) of counted packets; equal times are no gap."""
    rows = rows.withColumn("_sub", idiv(F.col("ts_us"), sub_us))
    w = Window.partitionBy(*FLOW_KEYS, "_sub").orderBy("ts_us")
    d = F.col("ts_us") - F.lag("ts_us").over(w)
    return rows.withColumn("_d", d).groupBy(*FLOW_KEYS, "_sub").agg(
        *[F.sum(c).alias(c) for c in ("n", "sx", "sxx", "syn", "ack", "fin", "rst", "ttl", "win")],
        F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"), F.coalesce(F.sum(F.col("_d") * F.col("_d")), F.lit(0)).alias("s2"),
        F.coalesce(F.sum(F.when(F.col("protocol") == "DNS", F.col("n"))), F.lit(0)).alias("dns_packets"),
        F.min("window_start_us").alias("window_start_us"))


def _distinct(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Distinct values per flow in two levels; nulls do not count."""
    return (rows.filter(F.col(value).isNotNull()).select(*FLOW_KEYS, value).distinct()
            .groupBy(*FLOW_KEYS).agg(F.count(F.lit(1)).alias(name)))


def batch_flows(rows: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """Flow features of the counted packets of gated windows."""
    valid = rows.filter(F.col("src_ip").isNotNull())
    m = _merge(_sub_buckets(valid), FLOW_KEYS, "_sub", ["window_start_us"])
    for value, name in (("dst_ip", "unique_target_ips"), ("dst_port", "unique_target_ports")):
        m = m.join(_distinct(valid, value, name), FLOW_KEYS, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return _derive(m, FLOW_KEYS, th, ["window_start_us"])


@dataclass
class StreamSinks:
    root: str
    notify_cfg: dict | None = None
    alerts: str = field(init=False)
    protocols: str = field(init=False)
    state: str = field(init=False)
    outbox: str = field(init=False)
    throttle_state: str = field(init=False)

    def __post_init__(self):
        self.alerts = os.path.join(self.root, "alerts")
        self.protocols = os.path.join(self.root, "protocol_breakdown")
        self.state = os.path.join(self.root, "state")
        self.outbox = os.path.join(self.root, "outbox")
        self.throttle_state = os.path.join(self.root, "throttle_state")


def _previous_state(spark: SparkSession, path: str, batch_id: int, schema) -> DataFrame | None:
    """Snapshot written by the previous batch (``batch_id = N - 1``).

    Every executed batch writes its snapshot and batch ids are consecutive,
    so a (re)run of batch N reads exactly the state batch N - 1 left.  If that
    is gone, history would silently start anew: an error.
    """
    prev = os.path.join(path, f"batch_id={batch_id - 1}")
    if batch_id == 0:
        return None
    if not path_exists(spark, prev):
        raise FileNotFoundError(f"state of batch {batch_id - 1} is missing under {path}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(prev)


def _snapshot(state: DataFrame, path: str, batch_id: int) -> None:
    """Writes a batch's state, an empty one too; a retried batch replaces its own."""
    state.write.mode("overwrite").parquet(os.path.join(path, f"batch_id={batch_id}"))


def _forget(spark: SparkSession, path: str, batch_id: int) -> None:
    """Removes the snapshot that no retry can ask for any more: batch N reads N - 1 only."""
    old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(path, f"batch_id={batch_id - 2}"))
    old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


def _write_all(jobs) -> None:
    """Run independent sink writes as concurrent Spark jobs."""
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        for f in [pool.submit(j) for j in jobs]:
            f.result()


def process_batch(batch: DataFrame, batch_id: int, det: Detector, sinks: StreamSinks) -> None:
    """Gate -> features -> rolling (stateful) -> layers -> idempotent writes.

    The counted packets and the flows with their history each feed several writes, so
    both are persisted for the batch and given back whatever happens."""
    spark = batch.sparkSession
    th = det.th
    held = [batch.persist()]
    try:
        gate = (batch.groupBy("window_id").agg(F.sum("n").alias("_wp"))
                .filter(F.col("_wp") >= th.min_window_packets).select("window_id"))
        rows = batch.join(gate, "window_id")
        flows = batch_flows(rows, th).persist()
        held.append(flows)
        # Keyed bounded history across batches
        prev = state.history(spark, sinks.state, batch_id, flows.select("src_ip").distinct())
        mine = flows.withColumn("_new", F.lit(True))
        both = mine if prev is None else mine.unionByName(prev.withColumn("_new", F.lit(False)), allowMissingColumns=True)
        # a batch holds a few windows per source plus <= 14 past ones: one frame per source
        rolled = rolling_state(both, th, block_windows=None).persist()
        held.append(rolled)
        scored = score_flows(rolled.filter("_new").drop("_new"), det)
        protos = (rows.filter(F.col("src_ip").isNotNull() & ~is_blank("protocol")).groupBy(*FLOW_KEYS, "protocol")
                  .agg(F.sum("n").alias("packets"), F.sum("sx").alias("bytes")))
        jobs = [lambda: state.write_history(rolled.select("src_ip", *state.HISTORY), sinks.state, batch_id, th),
                lambda: append_table(to_alerts(scored), sinks.alerts, batch_id),
                lambda: write_protocol_breakdown(protos, sinks.protocols, batch_id)]
        if sinks.notify_cfg is not None:
            jobs.append(lambda: _notices_batch(scored, batch_id, det, sinks))
        _write_all(jobs)
        state.forget(spark, sinks.state, batch_id)
        if sinks.notify_cfg is not None:
            _forget(spark, sinks.throttle_state, batch_id)
    finally:
        for df in reversed(held):
            df.unpersist()


def fold_throttle(notices: DataFrame, last: DataFrame | None, period: int) -> DataFrame:
    """Times kept by the greedy throttle: (source_ip, kept array<bigint>) of ``notices(source_ip,
    window_start_us)`` after ``last(source_ip, last_kept_us)``.

    A fold over a batch's notices of one source, a time for each of its windows at most, in order;
    it keeps at most one time a period."""
    d = notices.groupBy("source_ip").agg(F.sort_array(F.collect_set("window_start_us")).alias("_times"))
    if last is None:
        d = d.withColumn("last_kept_us", F.lit(None).cast("bigint"))
    else:
        d = d.join(last, "source_ip", "left")
    none = F.array().cast("array<bigint>")

    def step(acc, t):
        due = acc["last"].isNull() | (t >= acc["last"] + period)
        return F.when(due, F.struct(t.alias("last"), F.concat(acc["kept"], F.array(t)).alias("kept"))).otherwise(acc)

    kept = F.aggregate("_times", F.struct(F.col("last_kept_us").alias("last"), none.alias("kept")), step, lambda acc: acc["kept"])
    return d.select("source_ip", kept.alias("kept"))


def _notices_batch(scored: DataFrame, batch_id: int, det: Detector, sinks: StreamSinks) -> None:
    """S3: keyed throttle across batches.

    The state is one row per source (last kept time) of the last period; an older one can't hold
    back anything.  The snapshot is written to ``throttle_state/batch_id=N`` (idempotent on retry)."""
    from flowwatch.functions import clock_text
    from flowwatch.operators import notify
    spark = scored.sparkSession
    period = det.th.throttle_s * 1_000_000
    notices = notify.notice_records(scored).withColumn("timestamp", clock_text(F.col("window_start_us"))).persist()
    try:
        prev = _previous_state(spark, sinks.throttle_state, batch_id, "source_ip string, last_kept_us bigint")
        kept = fold_throttle(notices, prev, period).filter(F.size("kept") > 0).persist()
        try:
            last = kept.select("source_ip", F.element_at("kept", -1).alias("last_kept_us"))
            if prev is not None:
                last = prev.join(last.select("source_ip"), "source_ip", "left_anti").unionByName(last)
            now = scored.agg(F.max("window_start_us")).scalar()
            _snapshot(last.filter(F.col("last_kept_us") > F.coalesce(now, F.lit(0)) - period), sinks.throttle_state, batch_id)
            sent = notices.join(kept.select("source_ip", F.explode("kept").alias("window_start_us")), ["source_ip", "window_start_us"], "left_semi")
            cfg = sinks.notify_cfg
            out = notify.with_payload(notify.fan_out(notify.with_text(sent), notify.enabled_channels(cfg)), cfg)
            append_table(out, sinks.outbox, batch_id)
        finally:
            kept.unpersist()
    finally:
        notices.unpersist()


def late_rows(query) -> int:
    """Rows dropped by the watermark in the query's recent progress; :func:`late_rows_total` counts all."""
    total = 0
    for p in query.recentProgress:
        for op in p.get("stateOperators", []) if isinstance(p, dict) else p.stateOperators:
            v = op.get("numRowsDroppedByWatermark", 0) if isinstance(op, dict) else op.numRowsDroppedByWatermark
            total += int(v or 0)
    return total


def start_detection_stream(spark: SparkSession, source: DataFrame, out_root: str, checkpoint: str,
                           det: Detector | None = None, watermark: str = "4 seconds", origin_us: int = 0,
                           trigger: dict | None = None, notify_cfg: dict | None = None):
    """Start the continuous pipeline; returns the ``StreamingQuery``."""
    det = det or Detector()
    sinks = StreamSinks(out_root, notify_cfg)
    agg = counted_packets(source, det.th, watermark, origin_us)
    name = f"detection-{uuid.uuid4().hex}"
    spark.streams.addListener(LateCounter(spark, os.path.join(out_root, "late"), name))
    w = (agg.writeStream.outputMode("append").queryName(name).option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, bid: process_batch(df, bid, det, sinks)))
    w = w.trigger(**(trigger or {"processingTime": f"{det.th.window_us // 1_000_000} seconds"}))
    return w.start()


def stage_replay_files(raw: DataFrame, path: str, chunks: int = 8, late_packet: bool = False) -> int:
    """A9 helper: write packets as ``chunks`` files in order of time, plus a far-future flush packet, so a file
    stream with ``maxFilesPerTrigger=1`` replays them like a live capture.
    Returns the batch anchor (first usable packet time) for ``origin_us``.

    One range-partitioned pass writes all slices, packets without a usable time in the first.  The file source
    orders files by modification time, which is set a second apart after the write.
    ``late_packet`` appends one packet far behind the watermark (S4 check)."""
    from flowwatch.operators.flows import window_origin
    spark = raw.sparkSession
    raw = raw.select(*[F.col(c).cast("string").alias(c) if c not in ("frame_no", "ts_us") else F.col(c)
                       for c in RAW_ORDER])
    t0, lo, hi = spark.range(1).select(window_origin(clean_packets(raw)), raw.filter("ts_us > 0").agg(F.min("ts_us")).scalar(),
                                       raw.filter("ts_us > 0").agg(F.max("ts_us")).scalar()).first()
    raw.withColumn("_t", F.greatest("ts_us", F.lit(0))).repartitionByRange(chunks, "_t").drop("_t").write.mode("append").parquet(path)
    flush = spark.createDataFrame([(0, hi + 3_600_000_000)], "frame_no long, ts_us long")
    for c in RAW_ORDER[2:]:
        flush = flush.withColumn(c, F.lit(None).cast("string"))
    done = _in_order(spark, path, set())
    flush.coalesce(1).write.mode("append").parquet(path)
    done = _in_order(spark, path, done)
    if late_packet:
        flush.coalesce(1).withColumn("ts_us", F.lit(lo)).withColumn("src_ip", F.lit("10.9.9.9")).write.mode("append").parquet(path)
        _in_order(spark, path, done)
    return t0


def _in_order(spark: SparkSession, path: str, done: set[str]) -> set[str]:
    """Gives the files that are not in ``done`` modification times a second apart, after those, in order of their names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    new = sorted(n for s in fs.listStatus(p) if (n := s.getPath().getName()).startswith("part-") and n not in done)
    for i, name in enumerate(new, len(done)):
        fs.setTimes(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, name), (1_600_000_000 + i) * 1000, -1)
    return done | set(new)


class LateCounter(StreamingQueryListener):
    """A durable count of the rows that the watermark dropped, for the whole life of a query.

    Every batch that drops rows leaves a small file with their number, named by the batch, so a
    retried batch counts once, and the count outlives restarts and the query's recent progress."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.root, self.name = spark, root, name

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        dropped = sum(int(op.numRowsDroppedByWatermark or 0) for op in p.stateOperators)
        if p.name == self.name and dropped:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(os.path.join(self.root, f"batch-{p.batchId:09d}"))
            out = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
            out.writeBytes(f"{p.batchId},{dropped}\n")
            out.close()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def late_rows_total(spark: SparkSession, out_root: str) -> int:
    """Rows dropped by the watermark since the stream first ran, from its durable counter."""
    root = os.path.join(out_root, "late")
    if not path_exists(spark, root):
        return 0
    return spark.read.schema("batch_id bigint, rows bigint").csv(root).agg(F.sum("rows")).first()[0] or 0


def late_packets_batch(batch: DataFrame, batch_id: int, root: str, delay_us: int, th: Thresholds, origin_us: int) -> None:
    """One batch of :func:`start_late_table`."""
    spark = batch.sparkSession
    batch = clean_packets(batch).filter("ts_us > 0").persist()
    try:
        seen = os.path.join(root, "seen")
        prev = _previous_state(spark, seen, batch_id, "ts_us bigint")
        top = batch.agg(F.max("ts_us").alias("ts_us"))
        top = (top if prev is None else top.unionByName(prev)).agg(F.max("ts_us").alias("ts_us"))
        if prev is not None:
            end = F.col("ts_us") - F.pmod(F.col("ts_us") - F.lit(origin_us), F.lit(th.window_us)) + th.window_us
            mark = prev.select((idiv(F.col("ts_us"), 1000) * 1000 - delay_us).alias("m")).scalar()
            append_table(batch.filter(end <= mark), os.path.join(root, "late_packets"), batch_id)
        _snapshot(top, seen, batch_id)
        _forget(spark, seen, batch_id)
    finally:
        batch.unpersist()


def start_late_table(spark: SparkSession, source: DataFrame, out_root: str, checkpoint: str, delay_s: float = 4.0, th: Thresholds = DEFAULT,
                     origin_us: int = 0, trigger: dict | None = None):
    """A side table of the late packets, ``late_packets``: those whose window ended at or before the newest
    time of the batches before, less the delay.  Run over the same source with the same files a
    trigger as the detection stream, it holds the packets that one drops."""
    w = source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, bid: late_packets_batch(df, bid, out_root, round(delay_s * 1_000_000), th, origin_us))
    return w.trigger(**(trigger or {"processingTime": f"{th.window_us // 1_000_000} seconds"})).start()


def batch_durations_ms(query) -> list[int]:
    """Trigger execution time of every recorded micro-batch (ms)."""
    out = []
    for p in query.recentProgress:
        d = p.get("durationMs", {}) if isinstance(p, dict) else p.durationMs
        v = d.get("triggerExecution") if isinstance(d, dict) else None
        if v is not None:
            out.append(int(v))
    return out
