"""Append tables whose batch folders are merged, and reads of them.

A stream appends a folder ``batch_id=N`` a batch.  ``compact`` merges the small ones to a
segment ``_segments/first-last``: written whole, sorted by a column of choice with a Bloom
filter on it, and committed by the marker that the writing job leaves last.  A
reader takes the committed segments that no wider one holds, and the batch folders that none
holds, so it reads the same rows before, during and after.  What a segment holds is removed
only by the next call, when readers that had listed it are gone; a call that
fails leaves no marker and is run again.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENTS = "_segments"
#: a merged unit of this size is not merged again; small units that are left unmerged
FULL_BYTES, LEAVE = 128 << 20, 16


@dataclass(frozen=True, order=True)
class Unit:
    """Batches ``first`` to ``last`` of a table: a batch folder or a committed segment."""

    first: int
    last: int
    merged: bool
    path: str
    size: int

    def within(self, other: Unit) -> bool:
        return other.merged and other.first <= self.first and self.last <= other.last and self.path != other.path


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _folders(spark: SparkSession, path: str, pattern: str) -> list[tuple[re.Match, str]]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    found = [(re.fullmatch(pattern, s.getPath().getName()), s.getPath().toString()) for s in fs.listStatus(p) if s.isDirectory()]
    return [(m, x) for m, x in found if m]


def _unit(spark: SparkSession, first: int, last: int, merged: bool, path: str) -> Unit:
    fs, p = _fs(spark, path)
    return Unit(first, last, merged, path, fs.getContentSummary(p).getLength())


def _all_units(spark: SparkSession, path: str) -> list[Unit]:
    batches = [_unit(spark, int(m[1]), int(m[1]), False, p) for m, p in _folders(spark, path, r"batch_id=(\d+)")]
    merged = [_unit(spark, int(m[1]), int(m[2]), True, p) for m, p in _folders(spark, os.path.join(path, SEGMENTS), r"(\d+)-(\d+)")]
    done = []
    for u in merged:
        fs, p = _fs(spark, os.path.join(u.path, "_SUCCESS"))
        if fs.exists(p):
            done.append(u)
    return sorted(batches + done)


def units(spark: SparkSession, path: str) -> list[Unit]:
    """What a reader of the table takes, oldest first."""
    found = _all_units(spark, path)
    return [u for u in found if not any(u.within(o) for o in found)]


def _rows(spark: SparkSession, taken: list[Unit], schema: str) -> DataFrame:
    """Rows of some units, with ``batch_id``."""
    schema = f"{schema}, batch_id bigint"
    batches, merged = [u.path for u in taken if not u.merged], [u.path for u in taken if u.merged]
    parts = []
    if batches:
        root = os.path.dirname(batches[0])
        parts.append(spark.read.schema(schema).option("basePath", root).parquet(*batches))
    if merged:
        parts.append(spark.read.schema(schema).parquet(*merged))
    if not parts:
        return spark.createDataFrame([], schema)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of an append table, with ``batch_id``; ``schema``: its columns but that one."""
    return _rows(spark, units(spark, path), schema)


def compact(spark: SparkSession, path: str, schema: str, cluster_by: str, upto: int | None = None,
            full_bytes: int = FULL_BYTES, leave: int = LEAVE, files: int | None = None) -> Unit | None:
    """Merges the small units of batches before ``upto`` (by default all but the newest, which may be
    written again), if more than ``leave`` of them follow one another; gives the new segment.

    The segment is range-partitioned and sorted by ``cluster_by``, so its row groups hold narrow ranges, and has a
    Bloom filter on it: a look-up of one value opens few of them.  ``files``: at most so many; by default one for each
    ``full_bytes``."""
    found = _all_units(spark, path)
    now = [u for u in found if not any(u.within(o) for o in found)]
    for u in set(found) - set(now):
        fs, p = _fs(spark, u.path)
        fs.delete(p, True)
    upto = max((u.last for u in now), default=0) if upto is None else upto
    small: list[Unit] = []
    for u in now:
        if u.last >= upto:
            break
        small = [] if u.size >= full_bytes else [*small, u]
    if len(small) <= leave:
        return None
    size = sum(u.size for u in small)
    target = os.path.join(path, SEGMENTS, f"{small[0].first:09d}-{small[-1].last:09d}")
    rows = _rows(spark, small, schema).repartitionByRange(files or max(1, -(-size // full_bytes)), cluster_by).sortWithinPartitions(cluster_by)
    (rows.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{cluster_by}", "true")
     .option("parquet.block.size", str(16 << 20)).parquet(target))
    return _unit(spark, small[0].first, small[-1].last, True, target)


def newest_rows(spark: SparkSession, path: str, schema: str, limit: int, order: list[Column], keep: Column | None = None) -> DataFrame:
    """H1/H2: the first ``limit`` rows by ``order`` of an append table whose later batches come first in it.

    Units are taken from the newest on, twice as many each time, until they hold enough rows that
    ``keep`` passes; older ones are not opened."""
    found = list(reversed(units(spark, path)))
    n = 1
    while True:
        rows = _rows(spark, found[:n], schema)
        rows = rows if keep is None else rows.filter(keep)
        if n >= len(found) or rows.limit(limit).count() >= limit:
            return rows.orderBy(*order).limit(limit)
        n *= 2
