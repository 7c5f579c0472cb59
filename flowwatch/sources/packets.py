"""Packet sources (A1, A2, H6 and the fixture view over ``events``).

Every source yields the *raw packet* layout::

    frame_no BIGINT, ts_us BIGINT, src_ip, dst_ip, tcp_src, udp_src, tcp_dst,
    udp_dst, protocol, frame_len, syn, ack, fin, rst, ttl, win

``ts_us`` is epoch microseconds; the other fields keep whatever type the
source has (text for CSV) and are coerced by :mod:`flowwatch.operators.clean`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowwatch import config as C
from flowwatch.functions import coerce_numeric

RAW_ORDER = ["frame_no", "ts_us", "src_ip", "dst_ip", "tcp_src", "udp_src", "tcp_dst",
             "udp_dst", "protocol", "frame_len", "syn", "ack", "fin", "rst", "ttl", "win"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Packet view over the driver's ``events`` table (FIXTURES.md section 1): the
# expressions are the fixture definition and are mirrored in the oracle SQL.
_VIEW_BASE = [
    "event_id", "event_type", "value", "user_id",
    "user_id % 16 AS c",
    "cast(get_json_object(props, '$.k') AS bigint) AS k",
    # microseconds since 2024-01-01 from wall-clock fields: time-zone free for TIMESTAMP_NTZ
    "cast(datediff(to_date(ts), DATE'2024-01-01') AS bigint) * 86400000000 + cast(hour(ts) AS bigint) * 3600000000"
    " + cast(minute(ts) AS bigint) * 60000000 + cast(extract(SECOND FROM ts) * 1000000 AS bigint) AS us",
]
_VIEW_TCP = "(c IN (0,1,2,4,5) OR event_type IN ('click','view','purchase')) AS is_tcp"
_VIEW_COLS = [
    "event_id AS frame_no",
    """CASE event_id % 997 WHEN 5 THEN 0 WHEN 6 THEN -1000000 ELSE 1704067200000000 + us div CASE c WHEN 0 THEN 4194304 WHEN 1 THEN 8388608
         WHEN 2 THEN 131072 WHEN 3 THEN 2097152 WHEN 4 THEN 65536 WHEN 6 THEN 262144
         WHEN 10 THEN 8192 ELSE 16384 END END AS ts_us""",
    """CASE WHEN event_id % 101 = 0 THEN '' WHEN event_id % 103 = 0 THEN 'nan'
         WHEN event_id % 109 = 0 THEN '   '
         WHEN c > 10 THEN concat('10.1.', cast(user_id div 256 % 256 AS string), '.', cast(user_id % 256 AS string))
         ELSE concat('10.0.0.', cast(c + 1 AS string)) END AS src_ip""",
    """CASE WHEN event_id % 89 = 0 THEN NULL
         ELSE concat('192.168.', cast(k % 4 AS string), '.', cast(event_id % 8 AS string)) END AS dst_ip""",
    "CASE WHEN is_tcp THEN concat(cast(1024 + event_id % 50000 AS string), if(event_id % 67 = 0, ',443', '')) END AS tcp_src",
    "CASE WHEN NOT is_tcp AND event_id % 17 <> 0 THEN concat(cast(1024 + event_id % 40000 AS string), if(event_id % 5 = 0, '.0', '')) END AS udp_src",
    """CASE WHEN is_tcp THEN CASE WHEN c IN (2,5) THEN 1 + event_id % 1024 WHEN c = 4 THEN 22
         WHEN k % 2 = 0 THEN 80 ELSE 443 END END AS tcp_dst""",
    """CASE WHEN NOT is_tcp AND event_id % 13 <> 0 THEN
         CASE WHEN event_type = 'signup' OR c = 6 THEN 53 ELSE 5000 + k % 3 END END AS udp_dst""",
    """CASE WHEN event_id % 107 = 0 THEN '' WHEN c = 6 THEN 'DNS' WHEN c = 3 THEN 'HTTP'
         WHEN c IN (0,1,2,4,5) THEN 'TCP' WHEN event_type = 'click' THEN 'TCP'
         WHEN event_type = 'view' THEN 'HTTP' WHEN event_type = 'purchase' THEN 'TLSv1.2'
         WHEN event_type = 'signup' THEN 'DNS' ELSE 'UDP' END AS protocol""",
    """CASE WHEN c = 10 THEN 60 + k % 64 WHEN c = 3 THEN 900 + k
         ELSE 60 + cast(floor(value * 4) AS bigint) % 1441 END AS frame_len""",
    """CASE WHEN c IN (0,2,4,5) THEN 'True' WHEN event_id % 4 = 0 THEN '1'
         WHEN event_id % 53 = 0 THEN 'True,False' ELSE 'False' END AS syn""",
    """CASE WHEN c IN (0,2) THEN 'False' WHEN event_id % 4 <> 0 THEN '1'
         WHEN event_id % 59 = 0 THEN NULL ELSE '0' END AS ack""",
    "CASE WHEN event_id % 31 = 0 THEN 'true' ELSE 'false' END AS fin",
    "CASE WHEN event_id % 37 = 0 THEN '1' ELSE '0' END AS rst",
    """CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 71 = 0 THEN '64,63'
         ELSE cast(64 + k % 64 AS string) END AS ttl""",
    "CASE WHEN is_tcp THEN cast(1024 + event_id % 64512 AS string) END AS win",
]


def packet_view(events: DataFrame) -> DataFrame:
    """Raw packets derived row-by-row from ``events`` (narrow, no shuffle)."""
    return events.selectExpr(*_VIEW_BASE).selectExpr("*", _VIEW_TCP).selectExpr(*_VIEW_COLS)


def packets_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packet_view(read_table(spark, sf_dir, "events"))


# ---------------------------------------------------------------------------
# Packet-field CSV (A1/A2)
# ---------------------------------------------------------------------------

def csv_schema() -> T.StructType:
    """15 text fields in file order plus one overflow field for over-long lines."""
    fields = [T.StructField(n, T.StringType()) for n in C.RAW_COLUMNS]
    return T.StructType(fields + [T.StructField("_overflow", T.StringType())])


def csv_reader(reader):
    """Options of a batch or stream reader of packet-field CSV: each file's first line is a
    header, every field is text, and an empty field differs from one that is not there."""
    return (reader.schema(csv_schema()).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE")
            .option("quote", '"').option("sep", ",").option("nullValue", "\u0001").option("emptyValue", ""))


def csv_rows(rows: DataFrame, *keep: str) -> DataFrame:
    """Raw packets of the rows that :func:`csv_reader` reads: over-long rows (a field beyond the
    fifteenth, empty or not) are dropped, empty fields are null.  ``keep``: further columns."""
    rows = rows.filter(F.col("_overflow").isNull())
    return _to_raw(rows.select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in C.RAW_COLUMNS], *keep), *keep)


def _to_raw(df: DataFrame, *keep: str) -> DataFrame:
    ts = F.round(coerce_numeric("time_epoch") * F.lit(1_000_000.0)).try_cast("bigint")
    return df.select(
        F.lit(None).cast("bigint").alias("frame_no"),
        F.coalesce(ts, F.lit(0)).alias("ts_us"),
        *[F.col(c) for c in C.RAW_COLUMNS[1:]],
        *keep,
    )


def _fields(line) -> F.Column:
    """Number of fields of a CSV line (commas inside quotes do not count)."""
    return F.size(F.split(F.regexp_replace(line, '"[^"]*"', ""), ",", -1))


#: endings of archives that are read through a codec, and what checks them without Spark
ARCHIVES = {".gz": "gzip", ".bz2": "bz2", ".deflate": "zlib"}
#: reasons for which a file is set aside
UNREADABLE, DAMAGED, ENCODING, HEADER = "no line could be read", "damaged archive", "not UTF-8", "not 15 columns"


def archive_is_whole(content: bytes, codec: str) -> bool:
    """Whether an archive unpacks to its end; unpacked in pieces that are thrown away."""
    import bz2
    import zlib
    def start():
        return bz2.BZ2Decompressor() if codec == "bz2" else zlib.decompressobj(31 if codec == "gzip" else 15)

    try:
        unpack, rest = start(), content
        while True:
            if codec == "bz2":
                unpack.decompress(rest, 1 << 20)
                rest = b""
                if unpack.eof:
                    rest = unpack.unused_data
                elif unpack.needs_input:
                    return False
            else:
                unpack.decompress(rest, 1 << 20)
                rest = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
                if not unpack.eof and not rest:
                    return False
            if unpack.eof:
                if not rest.strip(b"\0"):
                    return True
                unpack = start()           # archives may follow one another
    except (OSError, EOFError, ValueError, zlib.error):
        return False


def _damaged_archives(spark: SparkSession, paths) -> DataFrame:
    """Paths of archives that do not unpack to their end.  Only archives are opened: their contents, packed,
    go to the tasks one by one."""
    from collections.abc import Iterator
    import pandas as pd
    check = archive_is_whole
    endings = dict(ARCHIVES)
    files = spark.read.format("binaryFile").option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(paths)
    ending = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    files = files.select(F.col("_metadata.file_path").alias("file"), ending.alias("ending"), "content").filter(F.col("ending").isin(*endings))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bad = [p for p, e, c in zip(pdf["file"], pdf["ending"], pdf["content"]) if not check(bytes(c), endings[e])]
            yield pd.DataFrame({"file": pd.Series(bad, dtype=object)})

    return files.mapInPandas(work, "file string")


def packet_files(spark: SparkSession, paths) -> DataFrame:
    """A2: every file under ``paths`` with the reason for which it is set aside (null: it is read).

    Files listed are held against files read.  A file is set aside whole, as one whose load fails, if

    * none of its lines can be read (it has none, or is gone, or may not be opened; files of no bytes are not listed),
    * it is an archive that does not unpack to its end,
    * it holds a line that is not UTF-8, or
    * its first line has not exactly 15 fields.

    The listing reads no contents, the lines are combined before the shuffle to one row per file, and
    neither file names nor rows pass through the driver.  Archives of other kinds than gzip, bzip2 and
    deflate are not checked: a damaged one ends the read with an error.
    """
    listed = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("file"))
    lines = (spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"))
        .withColumn("_n", F.when(F.col("_at") == 0, F.monotonically_increasing_id())))
    seen = lines.groupBy("file").agg(F.min_by(_fields("value"), "_n").alias("fields"), F.count_if(~F.is_valid_utf8("value")).alias("odd"))
    damaged = _damaged_archives(spark, paths).withColumn("damaged", F.lit(True))
    reason = (F.when(F.col("damaged"), F.lit(DAMAGED)).when(F.col("odd").isNull(), F.lit(UNREADABLE))
              .when(F.col("odd") > 0, F.lit(ENCODING)).when(F.coalesce("fields", F.lit(0)) != len(C.RAW_COLUMNS), F.lit(HEADER)))
    return listed.join(seen, "file", "left").join(damaged, "file", "left").select("file", reason.alias("reason"))


def quarantined_files(spark: SparkSession, paths) -> DataFrame:
    """A2: the files that :func:`read_packets_csv` sets aside, and why: (file, reason)."""
    return packet_files(spark, paths).filter("reason is not null")


def read_packets_csv(spark: SparkSession, paths, files: DataFrame | None = None, place: bool = False) -> DataFrame:
    """A1 + A2 + H6: union of packet-field CSV files in one scan.

    * each file's first line is its header, whatever it holds; fields are renamed
      by position and read as text (no inference);
    * a file that can't be read to its end, or whose header has not exactly 15 fields, is
      skipped whole and does not end the read; :func:`quarantined_files` names it and says why;
    * data rows: short ones are null-padded, over-long ones are dropped, empty lines
      are skipped; a row whose time is no number is kept with time 0.

    ``files``: what :func:`packet_files` gives, if it is there already.  ``place``: adds a column of that name
    that orders rows by file and, within a file, as they stand there (D21).
    """
    good = (packet_files(spark, paths) if files is None else files).filter("reason is null").select(F.col("file").alias("_file"))
    reader = csv_reader(spark.read).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    rows = reader.csv(paths).withColumn("_file", F.col("_metadata.file_path"))
    if place:
        # ids ascend within a block of a file, in the order of its lines
        rows = rows.withColumn("place", F.struct("_file", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")))
    return csv_rows(rows.join(good, "_file", "left_semi"), *(["place"] if place else []))


def packets_of_files(files: DataFrame) -> DataFrame:
    """Raw packets of whole files, rows of ``value``, with the rules of :func:`read_packets_csv`, a file
    at a time: no state and no join, so that a stream can use it.

    A file is one row, which suits the short slices of a live capture: it must fit in a task."""
    header = F.substring_index(F.substring_index("value", "\n", 1), "\r", 1)
    good = files.filter(F.is_valid_utf8("value") & (_fields(header) == len(C.RAW_COLUMNS)))
    lines = good.select(F.posexplode(F.split("value", "\r\n|\r|\n", -1)).alias("_at", "line")).filter("_at > 0 and line <> ''")
    options = {"mode": "PERMISSIVE", "quote": '"', "sep": ",", "nullValue": "\u0001", "emptyValue": ""}
    row = F.from_csv("line", csv_schema().simpleString()[len("struct<"):-1].replace(":", " "), options)
    return csv_rows(lines.select(row.alias("r")).select("r.*"))


def union_packets(*frames: DataFrame) -> DataFrame:
    """H6: UNION ALL of packet frames by column name."""
    out = frames[0].select(*RAW_ORDER)
    for f in frames[1:]:
        out = out.unionByName(f.select(*RAW_ORDER), allowMissingColumns=False)
    return out
