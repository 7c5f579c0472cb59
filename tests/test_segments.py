"""Merged append tables, reads of the newest rows, look-ups of one source."""

import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from flowwatch.sinks import segments
from flowwatch.sinks.writers import append_table

SCHEMA = "window_id bigint, src_ip string, v double"


def batch(spark, n, rows=20):
    return spark.range(rows).select((F.lit(n) * rows + F.col("id")).alias("window_id"),
                                    F.concat(F.lit("10.0."), (F.col("id") * 7 + n) % 50).alias("src_ip"), F.lit(n / 2).alias("v"))


def rows_of(df):
    return sorted(map(tuple, df.select("window_id", "src_ip", "v", "batch_id").collect()))


def files(path):
    return [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def test_same_rows_before_during_after(spark, tmp):
    for n in range(30):
        append_table(batch(spark, n), tmp, n)
        if n % 10 == 9:
            want = rows_of(segments.read_appended(spark, tmp, SCHEMA))
            assert len(want) == 20 * (n + 1)
            listed = segments.units(spark, tmp)
            made = segments.compact(spark, tmp, SCHEMA, "src_ip", leave=4)
            assert made.last == n - 1 and rows_of(segments.read_appended(spark, tmp, SCHEMA)) == want
            # a reader that listed the table before still finds every file
            assert rows_of(segments._rows(spark, listed, SCHEMA)) == want
    assert segments.compact(spark, tmp, SCHEMA, "src_ip", leave=4) is None
    assert rows_of(segments.read_appended(spark, tmp, SCHEMA)) == want
    assert len(files(tmp)) <= 1 + len(files(os.path.join(tmp, "batch_id=29")))
    assert len(segments.units(spark, tmp)) == 2


def test_failed_merge_leaves_the_table_as_it_was(spark, tmp):
    for n in range(8):
        append_table(batch(spark, n), tmp, n)
    want = rows_of(segments.read_appended(spark, tmp, SCHEMA))
    made = segments.compact(spark, tmp, SCHEMA, "src_ip", leave=2)
    os.remove(os.path.join(made.path.replace("file:", ""), "_SUCCESS"))          # as a writer that was lost leaves it
    assert rows_of(segments.read_appended(spark, tmp, SCHEMA)) == want
    again = segments.compact(spark, tmp, SCHEMA, "src_ip", leave=2)
    assert again.path == made.path and rows_of(segments.read_appended(spark, tmp, SCHEMA)) == want
    # a retried batch, not merged yet, still replaces its own rows
    append_table(batch(spark, 7), tmp, 7)
    assert rows_of(segments.read_appended(spark, tmp, SCHEMA)) == want


def test_full_segments_stay(spark, tmp):
    for n in range(12):
        append_table(batch(spark, n), tmp, n)
        segments.compact(spark, tmp, SCHEMA, "src_ip", leave=2, full_bytes=1)
    want = [(n * 20 + i, f"10.0.{(i * 7 + n) % 50}", n / 2, n) for n in range(12) for i in range(20)]
    assert rows_of(segments.read_appended(spark, tmp, SCHEMA)) == sorted(want)


@pytest.mark.parametrize("limit", [1, 25, 60, 10_000])
def test_newest_rows_open_the_newest_batches_only(spark, tmp, limit):
    for n in range(16):
        append_table(batch(spark, n), tmp, n)
    segments.compact(spark, tmp, SCHEMA, "src_ip", upto=8, leave=2)
    order = [F.desc("window_id"), F.desc("src_ip")]
    got = segments.newest_rows(spark, tmp, SCHEMA, limit, order)
    every = segments.read_appended(spark, tmp, SCHEMA).orderBy(*order).limit(limit)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in every.collect()]
    opened = {f for f in got.inputFiles()}
    need = -(-limit // 20)
    if limit <= 60:
        newest = {f"batch_id={n}/" for n in range(16 - 2 * need, 16)}
        assert opened and all(any(b in f for b in newest) for f in opened)
    page = segments.newest_rows(spark, tmp, SCHEMA, 3, order, F.col("src_ip") == "10.0.7")
    want = segments.read_appended(spark, tmp, SCHEMA).filter("src_ip = '10.0.7'").orderBy(*order).limit(3)
    assert [tuple(r) for r in page.collect()] == [tuple(r) for r in want.collect()]


def test_look_up_of_one_source_opens_few_row_groups(spark, tmp):
    wide = spark.range(300_000).select(F.col("id").alias("window_id"), F.concat(F.lit("10.0."), F.xxhash64("id") % 5000).alias("src_ip"), F.rand(1).alias("v"))
    for n in range(4):
        append_table(wide.filter(F.col("id") % 4 == n).repartition(2), tmp, n)

    def groups(paths, source):
        hit = every = 0
        for p in paths:
            meta = pq.ParquetFile(p).metadata
            at = meta.schema.names.index("src_ip")
            for g in range(meta.num_row_groups):
                stats = meta.row_group(g).column(at).statistics
                every += meta.row_group(g).num_rows
                hit += meta.row_group(g).num_rows * (stats.min <= source <= stats.max)
        return hit / every

    source = wide.filter("id = 77").first().src_ip
    before = groups(files(tmp), source)
    segments.compact(spark, tmp, SCHEMA, "src_ip", upto=4, leave=1, files=8)
    assert before > 0.9 and groups(files(os.path.join(tmp, segments.SEGMENTS)), source) <= 0.25
    got = segments.read_appended(spark, tmp, SCHEMA).filter(F.col("src_ip") == source)
    assert got.count() == wide.filter(F.col("src_ip") == source).count()


def test_empty_table(spark, tmp):
    assert segments.read_appended(spark, os.path.join(tmp, "none"), SCHEMA).count() == 0
    assert segments.newest_rows(spark, os.path.join(tmp, "none"), SCHEMA, 5, [F.desc("window_id")]).count() == 0
