"""Sharding by Karmarkar-Karp differencing (operator 2).

Documents of equal text are one indivisible group; its size is the sum of its
documents'.  Differencing keeps partial partitions (16 sums each, at first one
group and 15 empty shards) and repeatedly combines the two of largest spread,
largest shard upon smallest, until one is left.

Groups are dealt by hash to blocks of bounded size; each block is differenced
in a task of its own to one partial partition, and the blocks' partial
partitions are differenced in the same way, level by level, until one is left.
Only the permutations come back down.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from flowwatch.llm.common import python_tasks, stored

SHARDS = 16
#: groups, or partial partitions of a level, differenced in one task
BLOCK = 8192
#: pieces of a shard that are numbered separately
PIECES = 4096


def differencing(parts: Sequence[Sequence[int]]) -> list[list[int]]:
    """For each partial partition, the shard that each of its places ends in.

    Ties between equal spreads go by position, so results do not change."""
    k = len(parts[0])
    sums, order, heap = [], [], []
    for n, p in enumerate(parts):
        o = sorted(range(k), key=p.__getitem__)
        order.append(o)
        sums.append([p[i] for i in o])
        heap.append((sums[n][0] - sums[n][-1], n))
    heapq.heapify(heap)
    made: list[tuple[int, int]] = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = [x + y for x, y in zip(sums[a], reversed(sums[b]))]
        sums[a] = sums[b] = []
        o = sorted(range(k), key=both.__getitem__)
        s = [both[i] for i in o]
        made.append((a, b))
        order.append(o)
        sums.append(s)
        heapq.heappush(heap, (s[0] - s[-1], len(sums) - 1))
    place: dict[int, list[int]] = {len(sums) - 1: list(range(k))}
    out: list[list[int]] = [[]] * len(parts)
    for node in range(len(sums) - 1, -1, -1):
        at = [0] * k
        for p, i in zip(place.pop(node), order[node]):
            at[i] = p
        if node < len(parts):
            out[node] = at
        else:
            a, b = made[node - len(parts)]
            place[a], place[b] = at, at[::-1]
    return out


def _blocks(rows: int, block: int) -> int:
    return max(1, -(-rows // block))


def assign_groups(groups: DataFrame, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """``groups(group, weight long)``, each group once, with its ``shard`` int."""
    python_tasks(groups.sparkSession)
    n = _blocks(groups.count(), block)
    leaf_type = "group binary, node long, place int, weight long"

    def leaves(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "group"], ascending=[False, True], kind="stable")
        at = differencing([[0] * (shards - 1) + [w] for w in pdf["weight"].tolist()])
        return pd.DataFrame({"group": pdf["group"], "node": pdf["node"], "place": [a[-1] for a in at], "weight": pdf["weight"]})

    placed = stored(groups.withColumn("node", F.pmod(F.xxhash64("group"), F.lit(n)))
                    .select("group", "node", "weight").groupBy("node").applyInPandas(leaves, leaf_type), "leaves")
    level = (placed.groupBy("node", "place").agg(F.sum("weight").alias("w")).groupBy("node")
             .agg(F.map_from_entries(F.collect_list(F.struct("place", "w"))).alias("m"))
             .select("node", F.expr(f"transform(sequence(0, {shards - 1}), i -> coalesce(m[i], 0L))").alias("sums")))
    steps = []
    while True:
        up = _blocks(n, block)

        def combine(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("node")
            parts = [list(map(int, s)) for s in pdf["sums"]]
            at = differencing(parts)
            total = [0] * shards
            for s, a in zip(parts, at):
                for x, p in zip(s, a):
                    total[p] += x
            return pd.DataFrame({"node": pdf["node"], "up": pdf["up"], "at": at, "total": [total] * len(at)})

        done = stored(level.withColumn("up", F.pmod(F.xxhash64("node"), F.lit(up))).groupBy("up").applyInPandas(
            combine, "node long, up long, at array<int>, total array<long>"), "level")
        steps.append(done)
        if up == 1:
            break
        level = done.groupBy("up").agg(F.first("total").alias("sums")).withColumnRenamed("up", "node")
        n = up
    for done in steps:
        s = done.select("node", "up", "at")
        placed = placed.join(s, "node").select("group", F.col("up").alias("node"), F.expr("at[place]").alias("place"))
    return placed.select("group", F.col("place").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes plus 1; null counts as the empty text, in
    size, checksum and group.  Law ``bytes``: shards' sums of sizes are near
    equal; ``grown_shard`` is null.  Equal texts share a shard, even if one
    group is larger than a shard's fair part.  Slots number a shard's rows from
    0 without gaps; rows repeating an id get slots of their own, null ids too.
    Other columns are not read.  An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = stored(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                              F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("group")), "sizes")
    groups = stored(rows.groupBy("group").agg(F.sum("size").alias("weight")), "groups")
    placed = stored(assign_groups(groups, shards, block), "shards")
    at = rows.join(placed, "group").withColumn("piece", F.pmod(F.xxhash64("doc_id", "group"), F.lit(PIECES)).cast("int"))
    at = stored(at, "placed")
    before = W.partitionBy("shard").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    offset = at.groupBy("shard", "piece").count().withColumn("below", F.coalesce(F.sum("count").over(before), F.lit(0)))
    nth = F.row_number().over(W.partitionBy("shard", "piece").orderBy("doc_id", "group"))
    out = at.withColumn("nth", nth).join(offset.select("shard", "piece", "below"), ["shard", "piece"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                      (F.col("below") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
