"""Merkle manifest of a data set by bitmap ranks (operator 12).

A document is a leaf, the documents of a language a tree of eight-wide runs in
ascending order of id, and the languages' roots a last such tree.  A leaf's
place is found without sorting leaves: per language the ids are a compressed
bitmap, whose non-zero 64-bit words are merged by OR, and above the words lies
a directory of counts in levels of 2^14.  Each level adds up the counts before
a word among at most 2^14 neighbours, so the rank of an id is the sum down the
directory plus the bits below it in its word.  Ids on several rows add their
further rows to the count; among those rows the leaf's own leading digits are
the key of a second such index.

With its rank a leaf goes to a slot of a keyed array, 512 slots to a key, that is
three levels of the tree at once.  The arrays' roots are the leaves of the next
arrays, until one is left.  On the way back each array gives its slots the
siblings above them, so every proof is put together in one array's task.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowwatch.llm.common import lower_ascii, stored

#: children of a node; levels of the tree in an array, and its slots
WIDTH, LEVELS = 8, 3
SLOTS = WIDTH ** LEVELS
#: bits of an id in a word, and of a word's number in each level of the directory
WORD_BITS, FANOUT_BITS = 6, 14
#: the word of rows without an id, before all others
NO_ID = -(1 << 62)

_PATH = "array<struct<left string, right string>>"


# ---- leaves ---------------------------------------------------------------

def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def field(c: Column) -> Column:
    """A value with its length in bytes before it; ``-`` if null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


# ---- ranks ----------------------------------------------------------------

def rank_words(keys: DataFrame, group: list[str]) -> DataFrame:
    """Words of the bitmaps of ``keys(*group, word long, bit int, n long)``, one row a key.

    Returns (*group, word, bits, more, before, total): the bits that are set; those
    set by more than one row, with the number of further rows; the rows in words
    before; all rows of the group."""
    d = keys.groupBy(*group, "word").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.sum("n").alias("n"),
        F.collect_list(F.when(F.col("n") > 1, F.struct("bit", (F.col("n") - 1).alias("n")))).alias("more"))
    levels = [stored(d, "bitmap-words")]
    at, top = "word", 64 - WORD_BITS
    while top > FANOUT_BITS + 2:
        up = f"{at}_up"
        levels.append(levels[-1].withColumn(up, F.shiftright(at, FANOUT_BITS)).groupBy(*group, up).agg(F.sum("n").alias("n")))
        at, top = up, top - FANOUT_BITS
    # counts before a node: of its neighbours under one parent, then those before the parent
    above = None
    for level in reversed(range(len(levels))):
        d, at = levels[level], "word" + "_up" * level
        if above is None:
            w = W.partitionBy(*group)
            d = d.withColumn("total", F.sum("n").over(w))
            d = d.withColumn("before", F.coalesce(F.sum("n").over(w.orderBy(at).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        else:
            w = W.partitionBy(*group, f"{at}_up").orderBy(at).rowsBetween(W.unboundedPreceding, -1)
            d = d.withColumn(f"{at}_up", F.shiftright(at, FANOUT_BITS)).withColumn("here", F.coalesce(F.sum("n").over(w), F.lit(0)))
            d = d.join(above.select(*group, f"{at}_up", F.col("before").alias("start"), "total"), [*group, f"{at}_up"])
            d = d.withColumn("before", F.col("start") + F.col("here")).drop(f"{at}_up", "start", "here")
        above = d
    return stored(above.drop("n"), "ranks")


def rank(bit: Column) -> Column:
    """Rows before a key in its group, from the columns of its word."""
    lower = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), bit))
    below = F.bit_count(F.col("bits").bitwiseAND(lower))
    more = F.aggregate(F.filter("more", lambda m: m["bit"] < bit), F.lit(0).cast("long"), lambda a, m: a + m["n"])
    return F.col("before") + below + more


def placed(leaves: DataFrame) -> DataFrame:
    """``leaves(grp, doc_id, leaf, changed, n)``, n equal rows each, as single rows with their ``slot``
    in the group, by (doc_id, leaf), and the group's ``total``."""
    d = leaves.withColumn("word", F.coalesce(F.shiftright("doc_id", WORD_BITS), F.lit(NO_ID)))
    d = d.withColumn("bit", F.coalesce(F.col("doc_id").bitwiseAND(F.lit((1 << WORD_BITS) - 1)).cast("int"), F.lit(0)))
    d = stored(d, "leaves")
    ids = d.groupBy("grp", "word", "bit").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    d = d.join(rank_words(ids.drop("kinds"), ["grp"]), ["grp", "word"]).withColumn("slot", rank(F.col("bit")))
    d = d.drop("bits", "more", "before")
    many = stored(ids.filter("kinds > 1").select("grp", "word", "bit"), "repeated")
    if not many.isEmpty():
        # rows of one id with different leaves: a second index, keyed by the leaf's digits
        same = ["grp", "word", "bit"]
        key = F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long")
        again = d.join(many, same, "left_semi").withColumn("key", key)
        again = again.withColumnsRenamed({"word": "id_word", "bit": "id_bit", "slot": "id_slot", "total": "id_total"})
        again = again.withColumn("word", F.shiftright("key", WORD_BITS)).withColumn("bit", F.col("key").bitwiseAND(F.lit(63)).cast("int"))
        # leaves that agree in 60 bits are told apart by the rest
        w = W.partitionBy("grp", "id_word", "id_bit", "key").orderBy("leaf").rowsBetween(W.unboundedPreceding, -1)
        again = stored(again.withColumn("within", F.coalesce(F.sum("n").over(w), F.lit(0))), "repeated-leaves")
        group = ["grp", "id_word", "id_bit"]
        keys = again.groupBy(*group, "word", "bit").agg(F.sum("n").alias("n"))
        again = again.join(rank_words(keys, group), [*group, "word"]).withColumn(
            "slot", F.col("id_slot") + rank(F.col("bit")) + F.col("within"))
        cols = ["grp", "doc_id", "leaf", "changed", "n", "slot", "total"]
        again = again.drop("total").withColumnRenamed("id_total", "total").select(*cols)
        d = d.join(many, same, "left_anti").select(*cols).unionByName(again)
    return d.withColumn("slot", F.explode(F.expr("sequence(slot, slot + n - 1)"))).select(
        "grp", "slot", "total", "doc_id", "leaf", "changed")


# ---- arrays of slots ------------------------------------------------------

def tree(nodes: list[str], levels: int) -> list[list[str]]:
    """Levels of a tree over ``nodes``, lowest first."""
    found = [nodes]
    for _ in range(levels):
        below = found[-1]
        found.append([digest(*below[i:i + WIDTH]) for i in range(0, len(below), WIDTH)])
    return found


def height(total: int) -> int:
    """Levels above ``total`` nodes until one is left."""
    n = 0
    while total > 1:
        total, n = -(-total // WIDTH), n + 1
    return n


def siblings(levels: list[list[str]], slot: int) -> list[tuple[str, str]]:
    """The others of a slot's run, left and right of it, level by level."""
    out = []
    for level in levels[:-1]:
        a = slot - slot % WIDTH
        out.append(("".join(level[a:slot]), "".join(level[slot + 1:a + WIDTH])))
        slot //= WIDTH
    return out


def arrays(slots: DataFrame, cols: list[str]) -> DataFrame:
    """``slots(grp, slot, total, *cols)`` gathered to keyed arrays: (grp, key, total, slots)."""
    d = slots.groupBy("grp", F.expr(f"slot div {SLOTS}").alias("key")).agg(
        F.first("total").alias("total"), F.sort_array(F.collect_list(F.struct((F.col("slot") % SLOTS).cast("int").alias("slot"), *cols))).alias("slots"))
    return stored(d, "arrays")


def _roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        top = [tree([s["node"] for s in slots], min(LEVELS, height(total)))[-1][0] for slots, total in zip(pdf["slots"], pdf["total"])]
        yield pd.DataFrame({"grp": pdf["grp"], "slot": pdf["key"], "total": -(-pdf["total"] // SLOTS), "node": top})


def reduced(slots: DataFrame) -> list[DataFrame]:
    """Arrays of ``slots(grp, slot, total, node, ...)``, level by level; the last is one row a group: (grp, slot, total, node)."""
    cols = [c for c in slots.columns if c not in ("grp", "slot", "total")]
    found, d = [], slots
    while True:
        found.append(arrays(d, cols))
        d = stored(found[-1].mapInPandas(_roots, "grp string, slot long, total long, node string"), "nodes")
        cols = ["node"]
        if d.filter("total > 1").isEmpty():
            return [*found, d]


def _down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Paths of the slots of arrays that know the path above them."""
    for pdf in batches:
        for grp, key, total, slots, path, subroot, root in pdf[["grp", "key", "total", "slots", "path", "subroot", "root"]].itertuples(index=False):
            levels = tree([s["node"] for s in slots], min(LEVELS, height(total)))
            above = [(p["left"], p["right"]) for p in path]
            own = [[{"left": a, "right": b} for a, b in siblings(levels, i) + above] for i in range(len(slots))]
            yield pd.DataFrame({"grp": grp, "key": [key * SLOTS + i for i in range(len(slots))], "path": own, "subroot": subroot, "root": root})


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        node = digest(left, node, right)
    return node


def _proofs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for total, slots, path, subroot, root in pdf[["total", "slots", "path", "subroot", "root"]].itertuples(index=False):
            levels = tree([s["node"] for s in slots], min(LEVELS, height(total)))
            above = [(p["left"], p["right"]) for p in path]
            proofs, folded = [], []
            for i, s in enumerate(slots):
                own = siblings(levels, i) + above
                proofs.append(digest(*[x for pair in own for x in pair]))
                folded.append(fold(s["changed"], own))
            yield pd.DataFrame({
                "doc_id": [s["doc_id"] for s in slots], "leaf": [s["node"] for s in slots], "subroot": subroot, "root": root,
                "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded]})


def paths(found: list[DataFrame], above: DataFrame) -> DataFrame:
    """Paths of the lowest arrays of ``found`` from those of the groups' roots, ``above(grp, path,
    subroot, root)``: (grp, key, path, subroot, root)."""
    d = above.withColumn("key", F.lit(0).cast("long"))
    for level in reversed(found[1:-1]):
        d = stored(level.join(d, ["grp", "key"]).mapInPandas(_down, f"grp string, key long, path {_PATH}, subroot string, root string"), "paths")
    return d


def in_order(groups: DataFrame) -> DataFrame:
    """``groups(grp, ...)``, distinct, with their place among all, ``slot``, and their number, ``total``:
    ranges of the name are ordered each, and the ranges' sizes added up."""
    d = groups.repartitionByRange("grp").withColumn("range", F.spark_partition_id())
    d = stored(d, "groups")
    sizes = d.groupBy("range").agg(F.count("*").alias("size"))
    every = W.orderBy("range")                        # a row a range
    sizes = sizes.withColumn("start", F.sum("size").over(every) - F.col("size")).withColumn("total", F.sum("size").over(W.partitionBy()))
    place = F.row_number().over(W.partitionBy("range").orderBy("grp")) - 1
    return d.withColumn("slot", place.cast("long")).join(sizes, "range").withColumn("slot", F.col("slot") + F.col("start")).drop("range", "start", "size")


def manifest(docs: DataFrame, changed_text: Column | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, leaf, subroot (of its language), root, proof_sha256, folded_root
    and verified: whether the row, with ``changed_text`` for its text, folds to the root.

    Leaves hash doc_id, source, lang, n_chars and text.  Those of a language ascend
    by id, rows without an id first, rows repeating an id by their leaf; equal rows
    are leaves each.  A null language comes before all others.  Null and empty
    texts differ (``-`` and ``0:``).  Other columns are not read.  An empty table
    gives no rows.
    """
    text = F.col("text")
    cols = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("grp"),
                    leaf(*cols, text).alias("leaf"),
                    (leaf(*cols, text) if changed_text is None else leaf(*cols, changed_text)).alias("changed"))
    # equal leaves are equal rows, so ``changed`` adds no group
    d = d.groupBy("grp", "doc_id", "leaf", "changed").agg(F.count("*").alias("n"))
    # ids travel in arrays as text: pandas would make doubles of them beside nulls
    found = reduced(placed(d).withColumnRenamed("leaf", "node").withColumn("doc_id", F.col("doc_id").cast("string")))
    subroots = in_order(found[-1].select("grp", F.col("node").alias("subroot")))
    # the tree over the languages is one group
    over = reduced(subroots.select(F.lit("").alias("grp"), "slot", "total", F.col("subroot").alias("node"), F.col("grp").alias("name")))
    top = over[-1].select(F.lit("").alias("grp"), F.col("node").alias("root"), F.lit("").alias("subroot"),
                          F.array().cast(_PATH).alias("path"))
    last = paths(over, top)

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for total, slots, path, root in pdf[["total", "slots", "path", "root"]].itertuples(index=False):
                levels = tree([s["node"] for s in slots], min(LEVELS, height(total)))
                above = [(p["left"], p["right"]) for p in path]
                yield pd.DataFrame({
                    "grp": [s["name"] for s in slots], "subroot": [s["node"] for s in slots], "root": root,
                    "path": [[{"left": a, "right": b} for a, b in siblings(levels, i) + above] for i in range(len(slots))]})

    langs = stored(over[0].join(last, ["grp", "key"]).mapInPandas(named, f"grp string, subroot string, root string, path {_PATH}"), "languages")
    return found[0].join(paths(found, langs), ["grp", "key"]).mapInPandas(
        _proofs, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    ).withColumn("doc_id", F.col("doc_id").cast("long"))


def manifest_report(docs: DataFrame) -> DataFrame:
    """The manifest, held against texts of which every third, by the id's checksum, is lower-cased."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return manifest(docs, F.when(hit, lower_ascii(F.col("text"))).otherwise(F.col("text")))


ORACLE_SQL = """
with recursive f as (select doc_id, lang, text, case when crc % 3 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as changed,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head
  from (select *, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, 3988292384 * (a & 1)) end) as back, xor(back, 4294967295) as crc from documents)),
l as (select doc_id, coalesce('=' || lang, '') as grp, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
    sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) as changed from f),
p as (select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as slot from l),
t as (select grp, 0 as level, list(leaf order by slot) as nodes from p group by grp
  union all select grp, level + 1, list_transform(range(0, len(nodes), 8), lambda i: sha256(array_to_string(nodes[i + 1:i + 8], ''))) from t where len(nodes) > 1),
s as (select grp, nodes[1] as subroot, row_number() over (order by grp) - 1 as slot from t where len(nodes) = 1),
u as (select 0 as level, list(subroot order by slot) as nodes from s
  union all select level + 1, list_transform(range(0, len(nodes), 8), lambda i: sha256(array_to_string(nodes[i + 1:i + 8], ''))) from u where len(nodes) > 1),
r as (select p.grp, p.slot, s.slot as lang_slot, doc_id, leaf, p.changed, subroot, (select nodes[1] from u where len(nodes) = 1) as root from p join s using (grp)),
g as (
  select r.grp, r.slot, t.level, (r.slot // (8 ** t.level)::bigint)::bigint as pos, t.nodes from r join t on r.grp = t.grp and len(t.nodes) > 1
  union all
  select r.grp, r.slot, 100 + u.level, (r.lang_slot // (8 ** u.level)::bigint)::bigint, u.nodes from r join u on len(u.nodes) > 1),
h as (select grp, slot, level, array_to_string(nodes[pos - pos % 8 + 1:pos], '') as a, array_to_string(nodes[pos + 2:pos - pos % 8 + 8], '') as b from g),
o as (select grp, slot, list(struct_pack(a := a, b := b) order by level) as path from h group by grp, slot),
z as (select r.*, coalesce(path, []) as path,
    list_reduce(list_concat([struct_pack(a := changed, b := '')], coalesce(path, [])), lambda x, y: struct_pack(a := sha256(y.a || x.a || y.b), b := '')).a as folded_root
  from r left join o using (grp, slot))
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.a || x.b), '')) as proof_sha256, folded_root, folded_root = root as verified from z
"""
