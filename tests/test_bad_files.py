"""Files that can't be read are set aside whole and named; all others are read."""

import bz2
import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from flowwatch import config as C
from flowwatch.sources import packets as P
from flowwatch.streaming.pipeline import packet_stream


def csv_text(n, seed, columns=C.PACKET_FIELDS, end="\n"):
    r = random.Random(seed)
    rows = [",".join(f'"{c}"' for c in columns)]
    for i in range(n):
        rows.append(",".join(f'"{v}"' for v in (f"{1_700_000_000 + i}.5", f"10.0.{seed}.{r.randrange(9)}", "10.9.9.9", "1,2", "", "80", "", "TCP", 60 + i,
                                                 "True", "0", "", "0", 64, 1024)[:len(columns)]))
    return end.join(rows) + end


@pytest.fixture()
def folder(tmp):
    """Good files of several kinds, and bad ones with the reason for which they are set aside."""
    path = os.path.join(tmp, "in")
    os.makedirs(path)

    def put(name, data):
        with open(os.path.join(path, name), "wb") as f:
            f.write(data if isinstance(data, bytes) else data.encode())

    good = {"a.csv": csv_text(50, 1), "b.csv": csv_text(7, 2, end="\r\n"), "odd header.csv": csv_text(5, 3).replace("frame.len", "what, ever")}
    for name, text in good.items():
        put(name, text)
    put("c.csv.gz", gzip.compress(csv_text(2000, 4).encode()))
    put("two.csv.gz", gzip.compress(csv_text(20, 5).encode()) + gzip.compress(csv_text(3, 5).encode().split(b"\n", 1)[1]))
    put("d.csv.bz2", bz2.compress(csv_text(30, 6).encode()))
    bad = {"14 columns.csv": P.HEADER, "binary.csv": P.ENCODING, "cut.csv.gz": P.DAMAGED, "cut.csv.bz2": P.DAMAGED,
           "not an archive.csv.gz": P.DAMAGED, "no lines.csv.gz": P.UNREADABLE, "late byte.csv": P.ENCODING, "broken.csv.gz": P.DAMAGED}
    put("14 columns.csv", csv_text(9, 7, C.PACKET_FIELDS[:14]))
    put("binary.csv", random.Random(1).randbytes(5000))
    put("no lines.csv.gz", gzip.compress(b""))
    whole = gzip.compress(csv_text(5000, 8).encode())
    put("cut.csv.gz", whole[:len(whole) // 2])
    put("broken.csv.gz", whole[:len(whole) // 2] + b"\0" * 40 + whole[len(whole) // 2 + 40:])
    whole = bz2.compress(csv_text(90_000, 9).encode())
    put("cut.csv.bz2", whole[:len(whole) * 3 // 4])
    put("not an archive.csv.gz", csv_text(4, 9))
    put("late byte.csv", csv_text(400, 9).encode() + b'"1700000000.5","10.0.0.\xff"\n')
    return path, {"10.0.1": 50, "10.0.2": 7, "10.0.3": 5, "10.0.4": 2000, "10.0.5": 23, "10.0.6": 30}, bad


def per_seed(rows):
    return {r[0]: r[1] for r in rows.groupBy(F.substring_index("src_ip", ".", 3)).count().collect()}


def test_bad_files_are_named_and_good_ones_read(spark, folder):
    path, good, bad = folder
    assert per_seed(P.read_packets_csv(spark, path)) == good
    named = {os.path.basename(r.file).replace("%20", " "): r.reason for r in P.quarantined_files(spark, path).collect()}
    assert named == bad
    files = P.packet_files(spark, path)
    assert files.count() == len(os.listdir(path)) == len(good) + len(bad)
    assert per_seed(P.read_packets_csv(spark, path, files)) == good


def test_whole_archives(spark):
    text = csv_text(3000, 1).encode()
    packed = {"gzip": gzip.compress(text), "bz2": bz2.compress(text)}
    for codec, data in packed.items():
        assert P.archive_is_whole(data, codec) and P.archive_is_whole(data + data, codec)
        for cut in (0, 1, len(data) // 3, len(data) - 1):
            assert not P.archive_is_whole(data[:cut], codec), (codec, cut)


def test_stream_reads_the_same_files(spark, folder, tmp):
    path, good, _ = folder
    out = os.path.join(tmp, "out")
    q = (packet_stream(spark, path, "csv", max_files_per_trigger=3).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", os.path.join(tmp, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert q.exception() is None
    got = spark.read.parquet(out)
    assert per_seed(got) == good
    want = P.read_packets_csv(spark, path)
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_only_bad_files(spark, tmp):
    path = os.path.join(tmp, "x")
    os.makedirs(path)
    with open(os.path.join(path, "a.csv"), "w") as f:
        f.write("one,two\n1,2\n")
    assert P.read_packets_csv(spark, path).count() == 0 and P.quarantined_files(spark, path).count() == 1


def test_profile_of_an_export_follows_its_rows(spark, tmp):
    """First values and values in order of appearance, over files in order of their names and lines in order."""
    from flowwatch.operators.profile import column_profile
    path = os.path.join(tmp, "x")
    os.makedirs(path)
    r, values = random.Random(3), []
    for name, n in (("a.csv", 4000), ("b.csv", 300), ("c.csv", 9000)):      # Spark reads large files first
        rows = csv_text(n, 1).split("\n")[:-1]
        for i in range(1, len(rows)):
            cells = rows[i].split(",")
            flag = r.choice(["", "", "True", "False", "1", f"v{r.randrange(40)}"])
            cells[-6] = f'"{flag}"'
            values.append(flag or None)
            rows[i] = ",".join(cells)
        with open(os.path.join(path, name), "w") as f:
            f.write("\n".join(rows) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        got = {x.column: x for x in column_profile(P.read_packets_csv(spark, path, place=True).drop("frame_no"), order="place").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    syn = got["syn"]
    assert syn.first_values == [v for v in values if v is not None][:20] and syn.rows == len(values)
    assert syn.distinct_values == [v or "nan" for v in dict.fromkeys(values)][:15]
