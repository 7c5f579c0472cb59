"""Late packets are counted for the whole life of a stream, and kept in a table of their own."""

import os
import time

from pyspark.sql import functions as F

from flowwatch.sources.packets import RAW_ORDER
from flowwatch.streaming.pipeline import late_rows, late_rows_total, packet_stream, start_detection_stream, start_late_table

BASE = 1_700_000_000_000_000
BATCHES = 14


def write_batches(spark, path, first, last):
    """A file a batch, 3 s further each; every batch from the third on holds ``n % 4`` packets of long ago."""
    planted = 0
    for n in range(first, last):
        rows = [(n * 100 + i, BASE + n * 3_000_000 + i * 10_000, f"10.0.0.{i % 3}") for i in range(60)]
        late = [(n * 100 + 90 + i, BASE + (n - 4) * 3_000_000 + i * 50_000, f"10.7.{n}.{i}") for i in range(n % 4 if n >= 4 else 0)]
        planted += len(late)
        d = spark.createDataFrame(rows + late, "frame_no long, ts_us long, src_ip string")
        for c in RAW_ORDER[3:]:
            d = d.withColumn(c, F.lit({"protocol": "TCP", "frame_len": "60", "dst_ip": "10.9.9.9"}.get(c)).cast("string"))
        d.select(*RAW_ORDER).coalesce(1).write.mode("append").parquet(path)
        for f in os.listdir(path):
            if f.startswith("part-") and os.path.getmtime(os.path.join(path, f)) > 1_600_001_000:
                os.utime(os.path.join(path, f), (1_600_000_000 + n, 1_600_000_000 + n))
    return planted


def test_late_packets_are_counted_exactly(spark, tmp):
    inp, out, side = (os.path.join(tmp, d) for d in ("in", "out", "side"))
    old = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates", "100")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    planted = 0
    try:
        # in two runs, so that neither the recent progress nor one query's life holds all
        for first, last in ((0, BATCHES // 2), (BATCHES // 2, BATCHES)):
            planted += write_batches(spark, inp, first, last)
            q = start_detection_stream(spark, packet_stream(spark, inp, max_files_per_trigger=1), out, os.path.join(tmp, "c1"), trigger={"availableNow": True})
            s = start_late_table(spark, packet_stream(spark, inp, max_files_per_trigger=1), side, os.path.join(tmp, "c2"), trigger={"availableNow": True})
            for x in (q, s):
                x.awaitTermination(900)
                assert x.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", old)
    for _ in range(50):                                  # listeners hear of a batch a little later
        if late_rows_total(spark, out) == planted:
            break
        time.sleep(0.2)
    assert late_rows(q) < planted == late_rows_total(spark, out)
    table = spark.read.parquet(os.path.join(side, "late_packets"))
    assert table.count() == planted and table.filter("src_ip not like '10.7.%'").count() == 0
