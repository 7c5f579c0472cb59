"""Write-then-read queries: file sources and sinks (A1-A6, B1, B6) on data derived from the driver tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from flowwatch import config as C
from flowwatch.operators import evaluate as E
from flowwatch.operators import reports
from flowwatch.functions import severity_of
from flowwatch.operators.clean import clean_packets
from flowwatch.operators.flows import protocol_breakdown
from flowwatch.plans import oracle as O
from flowwatch.plans.pipeline import windowed_packets
from flowwatch.plans.catalog import ALERTS_LISTS, ALERTS_PLAIN, CLEAN_CTES, W, _raw, alerts_df, register
from flowwatch.plans.catalog_learning import BENCH, BENCH_PAIR, BIN, LAB, _benchmark_csv_frame
from flowwatch.session import ensure_checkpoint_dir
from flowwatch.sinks import segments
from flowwatch.sinks.writers import export_csv, write_clean_packets
from flowwatch.sources.packets import DAMAGED, ENCODING, HEADER, RAW_ORDER, UNREADABLE, packet_files, packets_of_files, read_packets_csv
from flowwatch.sources.tables import ALERT_LOG, PROTOCOL_TABLE, read_alert_log, read_benchmark_csv, read_ip_list, read_protocol_table


def _folder(s, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(s), f"{name}-{uuid.uuid4().hex}")


CSV_COLS = ["ts_us", *C.RAW_COLUMNS[1:]]


def _packets_csv(s, sf):
    """A1, A2: the packet view written as packet-field CSV files and read back."""
    path = _folder(s, "packets")
    raw = _raw(s, sf)
    time = (F.col("ts_us").cast("decimal(20,0)") / 1_000_000).cast("decimal(20,6)").cast("string")
    out = raw.select(time.alias(C.PACKET_FIELDS[0]), *[F.col(c).cast("string").alias(f) for c, f in zip(RAW_ORDER[2:], C.PACKET_FIELDS[1:])])
    (out.write.option("header", True).option("quoteAll", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).option("nullValue", "").csv(path))
    return read_packets_csv(s, path).select(*CSV_COLS)


register("packets_csv", W(O.PACKETS) + "SELECT ts_us, " + ", ".join(
    f"nullif(cast({c} AS varchar), '') AS {c}" for c in C.RAW_COLUMNS[1:]) + " FROM packets")(_packets_csv)


def _packets_csv_bad(s, sf):
    """A folder in which half of the packets lie in files of 14 columns and some text is not UTF-8: the other
    half is read, the bad files are named, and a reader of whole files gets the same."""
    path = _folder(s, "packets-bad")
    raw = _raw(s, sf)
    time = (F.col("ts_us").cast("decimal(20,0)") / 1_000_000).cast("decimal(20,6)").cast("string")
    out = raw.select("frame_no", time.alias(C.PACKET_FIELDS[0]), *[F.col(c).cast("string").alias(f) for c, f in zip(RAW_ORDER[2:], C.PACKET_FIELDS[1:])])
    for rows, cols in ((out.filter("frame_no % 2 = 0"), C.PACKET_FIELDS), (out.filter("frame_no % 2 <> 0"), C.PACKET_FIELDS[:-1])):
        (rows.select(*[F.col(f"`{c}`") for c in cols]).write.mode("append").option("header", True).option("quoteAll", True)
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("nullValue", "").csv(path))
    odd = F.unhex(F.lit("22FF22" + "2C2230" * 14)).cast("string")
    raw.filter("frame_no % 5 = 0").select(odd.alias("value")).write.mode("append").text(path)
    files = packet_files(s, path)
    named = files.agg((F.count_if(F.col("reason") == HEADER) > 0) & (F.count_if(F.col("reason") == ENCODING) > 0)
                      & (F.count_if(F.col("reason").isin(UNREADABLE, DAMAGED)) == 0)).scalar()
    one = read_packets_csv(s, path, files).select(*CSV_COLS).withColumn("reader", F.lit("lines"))
    two = packets_of_files(s.read.text(path, wholetext=True)).select(*CSV_COLS).withColumn("reader", F.lit("files"))
    return one.unionByName(two).withColumn("bad_files_named", named)


register("packets_csv_bad_files", W(O.PACKETS) + "SELECT ts_us, " + ", ".join(
    f"nullif(cast({c} AS varchar), '') AS {c}" for c in C.RAW_COLUMNS[1:]) + """, reader, true AS bad_files_named
FROM packets, (VALUES ('lines'), ('files')) r(reader) WHERE frame_no % 2 = 0""")(_packets_csv_bad)


def _ip_list(s, sf):
    """A3: a list file with comments, blanks, repeats and notes, read back."""
    path = _folder(s, "list")
    v = F.when(F.col("frame_no") % 7 == 0, F.concat(F.lit("# "), "src_ip")).when(F.col("frame_no") % 5 == 0, F.lit("")) \
        .when(F.col("frame_no") % 3 == 0, F.concat("src_ip", F.lit("   # seen"))).otherwise(F.concat(F.lit("  "), "src_ip"))
    _raw(s, sf).filter("length(trim(src_ip)) > 3").select(v.alias("value")).write.text(path)
    return read_ip_list(s, path)


register("ip_list", W(O.PACKETS) + """
SELECT DISTINCT src_ip AS ip FROM packets WHERE length(trim(src_ip)) > 3 AND frame_no % 7 <> 0 AND frame_no % 5 <> 0""")(_ip_list)


def _benchmark_csv(s, sf):
    """Labelled flows written under benchmark headers with blanks around them, read, predicted, counted."""
    path = _folder(s, "benchmark")
    frame = _benchmark_csv_frame(s, sf)
    frame.toDF(*[f" {c}" for c in frame.columns]).write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    norm = read_benchmark_csv(s, path)
    return E.binary_confusion(norm.select(E.binary_truth("Label").alias("label"),
                                          (E.threat_class_from_rules() > 0).cast("int").alias("prediction")))


register("benchmark_csv", W(*ALERTS_PLAIN, LAB.rsplit("test AS", 1)[0].rstrip().rstrip(","), BENCH, BENCH_PAIR) + BIN)(_benchmark_csv)


def _clean_stored(s, sf):
    """B1: clean packets written by day, read back."""
    path = _folder(s, "clean")
    write_clean_packets(clean_packets(_raw(s, sf)), path)
    return s.read.parquet(path).groupBy(F.col("dt").cast("string").alias("dt"), "protocol").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("frame_len").alias("bytes"))


register("clean_packets_stored", W(*CLEAN_CTES) + """
SELECT cast(cast(make_timestamp(ts_us) AS date) AS varchar) AS dt, protocol, count(*) AS packets, cast(sum(frame_len) AS bigint) AS bytes
FROM clean GROUP BY ALL""")(_clean_stored)


def _export(s, sf):
    """The severity-filtered alert view exported as CSV with a header, read back."""
    path = _folder(s, "export")
    view = reports.severity_filter(reports.alert_view(alerts_df(s, sf, lists=True)), ("Severe", "Moderate"))
    export_csv(view, path)
    return s.read.option("header", True).csv(path).groupBy("threat_level", "traffic_profile").agg(
        F.count(F.lit(1)).alias("alerts"), F.sum(F.col("total_bytes").cast("bigint")).alias("bytes"))


register("alert_export", W(*ALERTS_LISTS) + """
SELECT threat_level, traffic_profile, count(*) AS alerts, cast(sum(total_bytes) AS bigint) AS bytes FROM alerts
WHERE threat_level LIKE '%Severe%' OR threat_level LIKE '%Moderate%' GROUP BY threat_level, traffic_profile""")(_export)


def _batched_alerts(s, sf, blocks: int = 64):
    """The alert table appended in batches of ``blocks`` windows, older ones first, as a stream leaves it;
    every third batch is of the older schema."""
    path = _folder(s, "alert-log")
    c = (F.col("window_id") * 37 + F.col("total_bytes")) % 10001 / 10000.0
    a = alerts_df(s, sf, lists=True).withColumn("confidence", c).withColumn("batch_id", F.expr(f"window_id div {blocks}"))
    a = a.repartition("batch_id")
    a.filter("batch_id % 3 <> 0").write.partitionBy("batch_id").parquet(path)
    a.filter("batch_id % 3 = 0").drop("confidence").write.mode("append").partitionBy("batch_id").parquet(path)
    return path


def _alert_log_segments(s, sf):
    """The log before and after its batches are merged: the same rows, kept confidences and missing ones."""
    path = _batched_alerts(s, sf)

    def totals(name):
        return read_alert_log(s, path).groupBy("source_ip").agg(
            F.count(F.lit(1)).alias("alerts"), F.max("confidence").alias("most"), F.count_if(F.col("confidence") == 0).alias("without"),
            F.sum("total_bytes").cast("bigint").alias("bytes")).withColumn("read", F.lit(name))

    before = totals("before").checkpoint()
    segments.compact(s, path, ALERT_LOG, "source_ip", leave=4)
    during = totals("during").checkpoint()                  # batches and the segment that holds them are both there
    segments.compact(s, path, ALERT_LOG, "source_ip", leave=1 << 30)
    return before.unionByName(during).unionByName(totals("after"))


register("alert_log_segments", W(*ALERTS_LISTS) + """
SELECT source_ip, count(*) AS alerts, max(c) AS most, count(*) FILTER (WHERE c = 0) AS "without", cast(sum(total_bytes) AS bigint) AS bytes, read
FROM (SELECT source_ip, total_bytes, CASE WHEN window_id // 64 % 3 = 0 THEN 0.0 ELSE (window_id * 37 + total_bytes) % 10001 / 10000.0 END AS c FROM alerts),
  (VALUES ('before'), ('during'), ('after')) r(read) GROUP BY source_ip, read""")(_alert_log_segments)


def _latest_stored(s, sf):
    """H1 on a stored log: its newest batches only, some of them merged."""
    path = _batched_alerts(s, sf)
    segments.compact(s, path, ALERT_LOG, "source_ip", leave=4)
    rows = segments.newest_rows(s, path, ALERT_LOG, C.LATEST_ALERTS, reports.newest_first())
    return rows.select("window_id", "timestamp", "source_ip", "packets_per_sec", "total_bytes", "traffic_profile", "threat_level")


register("latest_alerts_stored", W(*ALERTS_LISTS) + f"""
SELECT window_id, timestamp, source_ip, packets_per_sec, total_bytes, traffic_profile, threat_level FROM alerts
ORDER BY window_id DESC, source_ip DESC LIMIT {C.LATEST_ALERTS}""")(_latest_stored)


def _page_stored(s, sf):
    """H2 on a stored log: the first page of severe and moderate alerts, from as many of the newest batches as hold it."""
    path = _batched_alerts(s, sf)
    rows = segments.newest_rows(s, path, ALERT_LOG, C.ALERT_PAGE, reports.newest_first(), severity_of("threat_level").isin("Severe", "Moderate"))
    return rows.select("window_id", "source_ip", "traffic_profile", "threat_level")


register("alert_page_stored", W(*ALERTS_LISTS) + f"""
SELECT window_id, source_ip, traffic_profile, threat_level FROM alerts WHERE threat_level LIKE '%Severe%' OR threat_level LIKE '%Moderate%'
ORDER BY window_id DESC, source_ip DESC LIMIT {C.ALERT_PAGE}""")(_page_stored)


def _protocol_segments(s, sf):
    """The protocol table appended in batches, merged by source, read back for one source."""
    path = _folder(s, "protocol-log")
    rows = protocol_breakdown(windowed_packets(_raw(s, sf))).withColumn("batch_id", F.expr("window_id div 64")).repartition("batch_id")
    rows.sortWithinPartitions("src_ip").write.partitionBy("batch_id").parquet(path)
    segments.compact(s, path, PROTOCOL_TABLE, "src_ip", leave=4)
    return reports.protocol_mix(read_protocol_table(s, path, "10.0.0.9"), "10.0.0.9")


register("protocol_drill_down_merged", W(*CLEAN_CTES, O.WINDOWS) + f"""
SELECT protocol, count(*) AS pkts FROM pk
WHERE src_ip = '10.0.0.9' AND NOT {O.blank('protocol')} AND window_id IN (SELECT window_id FROM gate) GROUP BY protocol""")(_protocol_segments)


def _truth(s, sf):
    """Labels of any case, none, and others."""
    label = F.expr("""CASE frame_no % 9 WHEN 0 THEN NULL WHEN 1 THEN 'BENIGN' WHEN 2 THEN 'Benign' WHEN 3 THEN 'bEnIgN' WHEN 4 THEN ''
      WHEN 5 THEN 'BENIGN ' WHEN 6 THEN 'DoS Hulk' WHEN 7 THEN 'nan' ELSE protocol END""")
    return _raw(s, sf).select("frame_no", label.alias("Label")).select("frame_no", E.binary_truth("Label").alias("truth"))


register("binary_truth_labels", W(O.PACKETS) + """
SELECT frame_no, CASE WHEN frame_no % 9 IN (1, 2, 3) OR (frame_no % 9 = 8 AND lower(protocol) = 'benign') THEN 0 ELSE 1 END AS truth FROM packets""")(_truth)
