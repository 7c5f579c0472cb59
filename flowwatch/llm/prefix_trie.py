"""Conversation prefix trie by adaptive radix trees (operator 13).

A turn's id is 16 bytes of the hash of its role and text, so a conversation is a
string of fixed-width big-endian ids, and conversations that begin alike share a
prefix.  The strings are range-partitioned and sorted; each task puts runs of
bounded size into an adaptive radix tree: inner nodes hold 4, 16, 48 or 256
children and grow from one layout to the next, and a chain of single children is
one node with the bytes in between.  Only byte depths that are whole turns are
nodes of the trie.

A run holds all conversations of a prefix unless the prefix also begins the run's
first or last string.  All other nodes are final.  Those on the two borders are
given out in part, one row for each turn of the border, and merged by their
prefix: a prefix that a third of all conversations share is one small row in each
run.  Sums over subtrees are sums from the far end of each border, every merged
node counted on one border only, and then over the borders that share a prefix.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowwatch.llm.common import WORD, stored

#: bytes of a turn's id
ID_BYTES = 16
#: conversations, and turns, after which a run is closed
RUN_ROWS, RUN_TURNS = 20_000, 400_000
#: longest list of head turns that conversations take from the first of their twenty
HEAD = 3


# ---- the tree -------------------------------------------------------------

class Node4:
    """Up to four children: sorted bytes and their nodes."""
    size = 4

    def __init__(self):
        self.bytes, self.kids = bytearray(), []

    def get(self, b: int):
        i = self.bytes.find(b)
        return self.kids[i] if i >= 0 else None

    def put(self, b: int, node) -> None:
        i = bisect_left(self.bytes, b)
        if i < len(self.bytes) and self.bytes[i] == b:
            self.kids[i] = node
        else:
            self.bytes.insert(i, b)
            self.kids.insert(i, node)

    def full(self) -> bool:
        return len(self.kids) == self.size

    def items(self) -> list:
        return list(zip(self.bytes, self.kids))

    def grown(self):
        return _moved(self, Node16())


class Node16(Node4):
    """Up to sixteen children, found by bisection."""
    size = 16

    def get(self, b: int):
        i = bisect_left(self.bytes, b)
        return self.kids[i] if i < len(self.bytes) and self.bytes[i] == b else None

    def grown(self):
        return _moved(self, Node48())


class Node48:
    """Up to 48 children: a place for each byte, and the nodes in order of arrival."""
    size = 48

    def __init__(self):
        self.place, self.kids = bytearray(b"\xff" * 256), []

    def get(self, b: int):
        i = self.place[b]
        return self.kids[i] if i != 255 else None

    def put(self, b: int, node) -> None:
        if self.place[b] != 255:
            self.kids[self.place[b]] = node
        else:
            self.place[b] = len(self.kids)
            self.kids.append(node)

    def full(self) -> bool:
        return len(self.kids) == self.size

    def items(self) -> list:
        return [(b, self.kids[i]) for b, i in enumerate(self.place) if i != 255]

    def grown(self):
        return _moved(self, Node256())


class Node256:
    """A node for every byte."""

    def __init__(self):
        self.kids = [None] * 256

    def get(self, b: int):
        return self.kids[b]

    def put(self, b: int, node) -> None:
        self.kids[b] = node

    def full(self) -> bool:
        return False

    def items(self) -> list:
        return [(b, k) for b, k in enumerate(self.kids) if k is not None]


def _moved(old, new):
    for b, kid in old.items():
        new.put(b, kid)
    return new


class Inner:
    """A node of the tree: the bytes that lead to it from its parent (their end, ``upto``, in ``key``,
    any key that passes), its children, and the conversations that end here."""

    __slots__ = ("key", "start", "upto", "kids", "ends", "words")

    def __init__(self, key: bytes, start: int, upto: int, words):
        self.key, self.start, self.upto, self.words = key, start, upto, words
        self.kids, self.ends = None, []

    def child(self, b: int):
        return None if self.kids is None else self.kids.get(b)

    def put(self, b: int, node: Inner) -> None:
        if self.kids is None:
            self.kids = Node4()
        elif self.kids.full() and self.kids.get(b) is None:
            self.kids = self.kids.grown()
        self.kids.put(b, node)


def _agree(a: bytes, b: bytes, start: int, upto: int) -> int:
    """First place from ``start`` on in which the keys differ, at most ``upto``."""
    upto = min(upto, len(a), len(b))
    if a[start:upto] == b[start:upto]:
        return upto
    step = start
    while a[step:step + 64] == b[step:step + 64]:
        step += 64
    while a[step] == b[step]:
        step += 1
    return step


class RadixTree:
    """Adaptive radix tree over byte strings with the ids of those that end at each node."""

    def __init__(self):
        self.root = Inner(b"", 0, 0, ())

    def insert(self, key: bytes, conv_id: int, words) -> None:
        node, parent = self.root, None
        while True:
            at = _agree(key, node.key, node.start, node.upto)
            if at < node.upto:                    # the path to the node parts
                split = Inner(node.key, node.start, at, node.words)
                parent.put(node.key[node.start], split)
                node.start = at
                split.put(node.key[at], node)
                node = split
            if at == len(key):
                node.ends.append(conv_id)
                return
            below = node.child(key[at])
            if below is None:
                leaf = Inner(key, at, len(key), words)
                leaf.ends.append(conv_id)
                node.put(key[at], leaf)
                return
            parent, node = node, below

    def turns(self) -> Iterator[tuple]:
        """Nodes of the trie, those below first: (a key through it, depth, smallest id, conversations,
        children, ids that end here, words of its last turn, the children's places in this order)."""
        todo: list[tuple[Inner, bool]] = [(self.root, False)]
        done: list[tuple] = []                    # per finished node: smallest id, conversations, nodes just below
        n = 0
        while todo:
            node, seen = todo.pop()
            kids = [k for _, k in node.kids.items()] if node.kids is not None else []
            if not seen:
                todo.append((node, True))
                todo.extend((k, False) for k in kids)
                continue
            found = done[len(done) - len(kids):]
            del done[len(done) - len(kids):]
            least = min([*node.ends, *[f[0] for f in found]], default=None)
            count = len(node.ends) + sum(f[1] for f in found)
            below = [p for f in found for p in f[2]]
            last = node.upto - node.upto % ID_BYTES
            first = node.start // ID_BYTES * ID_BYTES + ID_BYTES if node is not self.root else 0
            for depth in range(last, first - 1, -ID_BYTES):
                words = node.words[depth // ID_BYTES - 1] if depth else 0
                yield node.key, depth // ID_BYTES, least, count, len(below), node.ends if depth == node.upto else [], words, below
                below, n = [n], n + 1
            done.append((least, count, below))


# ---- runs -----------------------------------------------------------------

#: final nodes have kind 'node'; parts of border nodes 'part'; ids that end at a border node 'ends'
_ROWS = ("kind string, conv_id long, depth long, parent_conv_id long, above binary, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string, prefix binary, border long, words long, first_id long, ids string")
_COLS = [c.split()[0] for c in _ROWS.split(", ")]


def prefix_ids(key: bytes) -> list[bytes]:
    """Of every prefix of whole turns, the shortest first: 16 bytes that name it."""
    state, out = sha256(), []
    for i in range(0, len(key) + 1, ID_BYTES):
        out.append(state.digest()[:16])
        state.update(key[i:i + ID_BYTES])
    return out


def _joined(ids: list[int]) -> str:
    return ",".join(map(str, sorted(ids)))


def run_rows(keys: list[bytes], conv_ids: list[int], words: list, run: int) -> list[tuple]:
    """Rows of a run: conversations sorted by (key, id)."""
    tree = RadixTree()
    for key, c, w in zip(keys, conv_ids, words):
        tree.insert(key, c, w)
    borders = [keys[0], keys[-1]]
    names = [prefix_ids(k) for k in borders]

    def border(key: bytes, depth: int) -> int | None:
        upto = depth * ID_BYTES
        return next((i for i, b in enumerate(borders) if len(b) >= upto and key[:upto] == b[:upto]), None)

    out: list[tuple] = []
    totals: list[tuple] = []                      # per node: leaves and saved tokens of its subtree without border nodes
    where: list[tuple] = []                       # per node: border, depth
    orphans: dict[int, int] = {}                  # final node: its row, until its parent comes
    given: set[tuple[int, int]] = set()
    for n, (key, depth, least, count, n_kids, ends, w, below) in enumerate(tree.turns()):
        side = border(key, depth)
        closed = [p for p in below if where[p] is None]
        leaves, saved = sum(totals[p][0] for p in closed), sum(totals[p][1] for p in closed)
        if side is None:
            leaves, saved = leaves or 1, saved + (count - 1) * w
            for p in closed:
                out[orphans.pop(p)][3] = least
            orphans[n] = len(out)
            out.append(["node", least, depth, None, None, count, n_kids, leaves, saved, sha256(_joined(ends).encode()).hexdigest(),
                        None, None, None, None, None])
            where.append(None)
        else:
            name = names[side][depth]
            for p in closed:
                out[orphans.pop(p)][4] = name
            given.add((side, depth))
            out.append(["part", least, depth, None, names[side][depth - 1] if depth else None, count, len(closed), leaves, saved, None,
                        name, 2 * run + side, w, None, None])
            if ends:
                out.append(["ends", None, depth, None, None, None, None, None, None, None, name, None, None, min(ends), _joined(ends)])
            where.append((side, depth))
        totals.append((leaves, saved))
    # a border's turns that were given out on the other one
    for side, b in enumerate(borders):
        for depth in range(len(b) // ID_BYTES + 1):
            if (side, depth) not in given:
                out.append(["part", None, depth, None, names[side][depth - 1] if depth else None, 0, 0, 0, 0, None,
                            names[side][depth], 2 * run + side, None, None, None])
    return out


def _runs(rows_most: int, turns_most: int):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, n_runs, n_turns = TaskContext.get().partitionId() << 32, 0, 0
        keys: list[bytes] = []
        ids: list[int] = []
        words: list[np.ndarray] = []

        def close() -> Iterator[pd.DataFrame]:
            found = run_rows(keys, ids, words, base + n_runs)
            for i in range(0, len(found), 50_000):
                d = pd.DataFrame(found[i:i + 50_000], columns=_COLS)
                for c in ("conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "border", "words", "first_id"):
                    d[c] = d[c].astype("Int64")
                yield d

        for pdf in batches:
            for key, c, w in zip(pdf["key"], pdf["conv_id"], pdf["words"]):
                keys.append(key)
                ids.append(int(c))
                words.append(w)
                n_turns += len(w)
                if len(keys) >= rows_most or n_turns >= turns_most:
                    yield from close()
                    keys, ids, words, n_runs, n_turns = [], [], [], n_runs + 1, 0
        if keys:
            yield from close()
    return work


def _hash_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Checksum of the ids of each prefix, from its pieces in ascending order."""
    name, state = None, None
    for pdf in batches:
        done = []
        for prefix, ids in zip(pdf["prefix"], pdf["ids"]):
            if prefix != name:
                if name is not None:
                    done.append((name, state.hexdigest()))
                name, state = prefix, sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pd.DataFrame(done, columns=["prefix", "ends_sha256"])
    if name is not None:
        yield pd.DataFrame([(name, state.hexdigest())], columns=["prefix", "ends_sha256"])


# ---- on Spark -------------------------------------------------------------

def turn_id(role: Column, text: Column) -> Column:
    """Hexadecimal digits of a turn's id."""
    return F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * ID_BYTES)


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<turn, id, words>>) of ``turns(conv_id, turn, role, text)``, in order of turn, null
    first, equal turns by their ids.  Turns without a conv_id take no part."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    d = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(
        F.col("turn").cast("long").alias("turn"), turn_id(role, text).alias("id"),
        F.regexp_count(text, F.lit(WORD)).cast("int").alias("words")).alias("t"))
    return d.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Conversations that take their first turns from the first of their twenty: the first h of
    conversation c - c % 20 (all if fewer, none if absent), h the checksum of c modulo 4."""
    h = (F.crc32(F.col("conv_id").cast("string")) % (HEAD + 1)).cast("int")
    convs = stored(convs, "conversations")
    heads = convs.filter("conv_id % 20 = 0").select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, HEAD).alias("head"))
    d = convs.join(heads, F.col("conv_id") - F.col("conv_id") % 20 == F.col("head_id"), "left").withColumn("h", h)
    none = F.array().cast(convs.schema["turns"].dataType)
    head = F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))
    own = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return d.select("conv_id", F.concat(head, own).alias("turns"))


def trie(convs: DataFrame, run_rows_most: int = RUN_ROWS, run_turns_most: int = RUN_TURNS) -> DataFrame:
    """Nodes of the prefix trie of ``convs(conv_id, turns)``, ids distinct: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation is one key of 16 bytes a turn, and its checksummed list of ids one stream; neither needs more than
    a task's memory for a run (``run_rows_most`` conversations, or the one that reaches ``run_turns_most`` turns)."""
    keys = stored(convs.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("key"),
                               F.transform("turns", lambda t: t["words"]).alias("words")), "keys")
    runs = stored(keys.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
                  .mapInPandas(_runs(run_rows_most, run_turns_most), _ROWS), "runs")
    part = runs.filter("kind = 'part'")

    # nodes on the borders, merged; each is owned by one of the borders through it
    nodes = stored(part.groupBy("prefix").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("above").alias("above"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("closed"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"),
        F.max("words").alias("words"), F.min("border").alias("owner")), "borders")
    kids = nodes.filter("above is not null").groupBy(F.col("above").alias("prefix")).agg(F.count("*").alias("open"))
    nodes = stored(nodes.join(kids, "prefix", "left").withColumn("n_children", F.col("closed") + F.coalesce("open", F.lit(0))).withColumn(
        "leaves", F.col("leaves") + (F.col("n_children") == 0).cast("long")).withColumn(
        "saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("words")), "border-nodes")
    # sums over subtrees: from the far end of each border, over the nodes that it owns
    own = part.select("prefix", "border", "depth").join(nodes.select("prefix", "owner", "leaves", "saved"), "prefix")
    mine = F.col("owner") == F.col("border")
    w = W.partitionBy("border").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    far = own.select("prefix", *[F.sum(F.when(mine, F.col(c)).otherwise(0)).over(w).alias(c) for c in ("leaves", "saved")])
    subtree = far.groupBy("prefix").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    pieces = runs.filter("kind = 'ends'").select("prefix", "first_id", "ids")
    ends = pieces.repartition("prefix").sortWithinPartitions("prefix", "first_id").mapInPandas(_hash_ends, "prefix binary, ends_sha256 string")
    parents = nodes.select(F.col("prefix").alias("above"), F.col("conv_id").alias("above_id"))
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    merged = (nodes.join(subtree, "prefix").join(ends, "prefix", "left").join(parents, "above", "left")
              .withColumn("parent_conv_id", F.col("above_id")).withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256))))
    final = runs.filter("kind = 'node'").join(parents, "above", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above_id"))
    return merged.select(*cols).unionByName(final.select(*cols))


def trie_report(turns: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations of ``turns``.

    Null roles and texts are empty; turns without a conv_id take no part; repeated rows are
    turns each; other columns are not read.  An empty table gives no rows."""
    return trie(rebuilt(conversations_of(turns)))


ORACLE_SQL = r"""
with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, id) as n, id, words from (
    select conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[:32] as id,
      len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words from conversations where conv_id is not null)),
c as (select conv_id, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(conv_id::varchar, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, 3988292384 * (a & 1)) end), 4294967295) % 4 as h from (select distinct conv_id from t)),
r as (select c.conv_id, t.n, id, words from c join t on t.conv_id = c.conv_id - c.conv_id % 20 and n <= h
  union all select c.conv_id, greatest(0, least(h, coalesce(m, 0))) + t.n - h, id, words from c join t on t.conv_id = c.conv_id and n > h
    left join (select conv_id, max(n) as m from t group by conv_id) b on b.conv_id = c.conv_id - c.conv_id % 20),
p as (select conv_id, n as depth, words, sha256(string_agg(id, '') over (partition by conv_id order by n)) as prefix,
    coalesce(sha256(string_agg(id, '') over (partition by conv_id order by n rows between unbounded preceding and 1 preceding)), '') as above,
    n = max(n) over (partition by conv_id) as ends from r
  union all select conv_id, 0, 0, '', null, not exists (select 1 from r where r.conv_id = c.conv_id) from c),
a as (select prefix, any_value(above) as above, any_value(depth) as depth, any_value(words) as words, min(conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256 from p group by prefix),
k as (select above, count(*) as n_children from a where above is not null group by above),
x as (select a.*, coalesce(n_children, 0) as n_children from a left join k on k.above = a.prefix),
s as (select u.prefix, count(*) filter (where x.n_children = 0) as n_leaves, sum((x.n_convs - 1) * x.words) as saved_tokens
  from (select distinct q.prefix, o.prefix as below from p q join p o on q.conv_id = o.conv_id and o.depth >= q.depth) u join x on x.prefix = u.below group by u.prefix)
select x.conv_id, x.depth::bigint as depth, y.conv_id as parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens::bigint as saved_tokens, x.ends_sha256
from x left join x y on y.prefix = x.above join s on s.prefix = x.prefix
"""
