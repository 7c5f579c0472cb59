"""SimHash near-duplicates by anchor-point covering (operator 5).

The two 31-bit halves of a fingerprint (bits 0-30 and 31-61) are covered with
the perfect [31, 26] Hamming code: its code words are the anchors, and every
half is within one bit of exactly one of them.  Two fingerprints that differ in
at most three bits differ in at most one bit in one of the halves.  So each
fingerprint is replicated, per half, to every anchor within covering radius
plus threshold, 1 + 1 = 2 bits: 16 anchors, or 1 if it is an anchor itself.
The anchor next to the one fingerprint is then among the anchors of the other,
and fingerprints are compared, on all 64 bits, at their anchors only.

Equal fingerprints are one row before that.  An anchor's rows give a spanning
forest of their links, never all pairs, and anchors with very many rows are cut
into blocks that meet pairwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from flowwatch.llm.common import connected_components, python_tasks, stored

SHINGLE, MAX_BITS, SEED = 3, 3, 42
#: fingerprints next to one anchor beyond which it is cut into blocks
ANCHOR_BLOCK = 4096

_HALF = 31
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: shingle hashes whose bits are counted at once
_AT_ONCE = 1 << 15


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a UTF-8 text: words are split at ASCII white
    space, A-Z lower-cased; shingles count as often as they occur; a text of
    fewer words is one shingle; no words give 0.  A bit is set if it is set in
    over half of the shingles' XXH64 values."""
    words = (text or b"").translate(_FOLD).split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[:len(words) - k + 1].tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(whole[a:b], SEED) for a, b in zip(starts, ends[k - 1:].tolist())), np.uint64, len(starts))
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _AT_ONCE):
        part = hashes[i:i + _AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.uint32)
    return int(np.packbits(count * 2 > len(hashes)).view(">i8")[0])


def _text_key(text: Column) -> list[Column]:
    """Two hashes that tell the texts of one id apart; null and empty texts are alike."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("text_key"), F.hash(t).alias("text_key2")]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long, text_key, text_key2) of every row; null texts have fingerprint 0."""
    python_tasks(docs.sparkSession)

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.select(F.col(id_col).alias("doc_id"), fp(F.col(text_col).cast("binary")).alias("fp"), *_text_key(F.col(text_col)))


def _syndrome(half: Column) -> Column:
    """Number of the bit (from 1) in which a half differs from its anchor; 0: it is one."""
    s = F.lit(0)
    for k in range(5):
        mask = sum(1 << (j - 1) for j in range(1, _HALF + 1) if j >> k & 1)
        s = s + F.shiftleft(F.bit_count(half.bitwiseAND(F.lit(mask).cast("long"))) % 2, k)
    return s.cast("int")


def anchors(fps: DataFrame) -> DataFrame:
    """``fps(fp, ...)`` replicated to its anchors: adds ``anchor`` and ``home`` (it is the nearest one).

    Bits i and j (0: no bit) differ between a half and one of its anchors within
    two bits exactly if i xor j is the half's syndrome."""
    full = F.lit((1 << _HALF) - 1).cast("long")
    halves = F.array(*[F.struct(F.lit(n).alias("n"), F.shiftrightunsigned("fp", n * _HALF).bitwiseAND(full).alias("x")) for n in (0, 1)])
    d = fps.withColumn("_half", F.explode(halves)).withColumn("_s", _syndrome(F.col("_half.x")))

    def bit(i: str) -> str:
        return f"if({i} = 0, 0L, shiftleft(1L, {i} - 1))"

    at = F.expr(f"""if(_s = 0, array(_half.x), transform(filter(sequence(0, {_HALF}), i -> i < (i ^ _s)),
                    i -> _half.x ^ {bit('i')} ^ {bit('(i ^ _s)')}))""")
    d = d.select("*", F.posexplode(at).alias("_nth", "_at"))
    # the first pair is (0, syndrome): one bit away, the home anchor
    return d.select(*fps.columns, F.shiftleft("_at", 1).bitwiseOR(F.col("_half.n").cast("long")).alias("anchor"),
                    (F.col("_nth") == 0).alias("home"))


def forest(fps: np.ndarray, nodes: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between ``fps`` (distinct): each found row with its tree's first."""
    rest, u, v = np.arange(len(fps)), [], []
    while len(rest) > 1:
        root, rest, front = rest[0], rest[1:], [rest[0]]
        while front and len(rest):
            near = np.bitwise_count(fps[rest] ^ fps[front.pop()]) <= max_bits
            found, rest = rest[near], rest[~near]
            u.append(np.full(len(found), nodes[root]))
            v.append(nodes[found])
            front.extend(found.tolist())
    return (np.concatenate(u), np.concatenate(v)) if u else (nodes[:0], nodes[:0])


def _compare(max_bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Streams rows sorted by (anchor, lo, hi) and compares those of each anchor."""
        kept: list[pd.DataFrame] = []
        for pdf in batches:
            key = pdf[["anchor", "lo", "hi"]].to_numpy()
            new = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            if kept and len(key) and (kept[0][["anchor", "lo", "hi"]].to_numpy()[0] != key[0]).any():
                yield pairs(pd.concat(kept), max_bits)
                kept = []
            if len(new):
                kept.append(pdf.iloc[:new[-1]])
                yield pairs(pd.concat(kept), max_bits)
                kept = [pdf.iloc[new[-1]:]]
            elif len(key):
                kept.append(pdf)
        if kept:
            yield pairs(pd.concat(kept), max_bits)
    return run


def pairs(pdf: pd.DataFrame, max_bits: int) -> pd.DataFrame:
    """Links (u, v) of whole anchors, sorted by anchor."""
    key = pdf[["anchor", "lo", "hi"]].to_numpy()
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
    sizes = np.diff(np.r_[starts, len(key)])
    # without a row at home there is no pair to be found at this anchor
    some = (sizes > 1) & np.logical_or.reduceat(pdf["home"].to_numpy(), starts)
    fp, node = pdf["fp"].to_numpy().view(np.uint64), pdf["node"].to_numpy()
    two = some & (sizes == 2)
    a = starts[two]
    a = a[np.bitwise_count(fp[a] ^ fp[a + 1]) <= max_bits]
    u, v = [node[a]], [node[a + 1]]
    for s, n in zip(starts[some & ~two].tolist(), sizes[some & ~two].tolist()):
        x, y = forest(fp[s:s + n], node[s:s + n], max_bits)
        u.append(x)
        v.append(y)
    return pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v)})


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = ANCHOR_BLOCK) -> DataFrame:
    """Links (u, v) that connect what ``fps(fp, node)``, of distinct fingerprints, has within ``max_bits`` (at most 3).

    An anchor with more than ``block`` rows, at home or not, is cut into blocks by a hash of the
    fingerprint: its rows at home and those away each by their own number.  Blocks at home meet each
    other and the blocks away, so an anchor costs its rows at home times all its rows, and one without a
    row at home is dropped before the shuffle."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves of covering radius 1 find up to three differing bits")
    rep = anchors(fps)
    rows = rep.groupBy("anchor").agg(F.count_if("home").alias("at_home"), F.count("*").alias("rows")).filter(F.col("rows") > block)
    hot = stored(rows.select("anchor", F.ceil(F.col("at_home") / block).cast("int").alias("n_home"),
                             F.ceil((F.col("rows") - F.col("at_home")) / block).cast("int").alias("n_away")), "hot-anchors")
    if hot.isEmpty():
        rep = rep.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(0))
    else:
        rep = rep.join(hot, "anchor", "left").filter("n_home is null or n_home > 0")
        # blocks at home come first, those away after them
        own = F.pmod(F.xxhash64("fp"), F.greatest(F.when(F.col("home"), F.col("n_home")).otherwise(F.col("n_away")), F.lit(1))).cast("int")
        rep = rep.withColumn("own", F.when(F.col("n_home").isNull(), 0).when(F.col("home"), own).otherwise(F.col("n_home") + own))
        meets = F.when(F.col("n_home").isNull(), 1).when(F.col("home"), F.col("n_home") + F.col("n_away")).otherwise(F.col("n_home"))
        rep = (rep.withColumn("other", F.explode(F.sequence(F.lit(0), meets - 1)))
               .withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")))
    rep = rep.select("anchor", "lo", "hi", "fp", "node", "home")
    return (rep.repartition("anchor", "lo", "hi").sortWithinPartitions("anchor", "lo", "hi")
            .mapInPandas(_compare(max_bits), "u long, v long"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int) -> DataFrame:
    """doc_id, fp, text_key, text_key2, component (of the fingerprint), component_id of every row."""
    fps = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = stored(fps.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    nodes = distinct.select("fp", F.xxhash64("fp").alias("node"))      # XXH64 of 8 bytes is one to one
    comp = connected_components(fingerprint_links(nodes, max_bits))
    named = distinct.withColumn("node", F.xxhash64("fp")).join(comp, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    least = stored(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "components")
    named = stored(named.join(least, "component").select("fp", "component", "component_id"), "groups")
    return fps.join(named, "fp", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """Per row: doc_id, fp (long), component_id: the smallest id reachable over links.

    Rows without an id have a fingerprint but take no part (null component).
    Rows repeating an id are linked through it only if their fingerprints are.
    Null, empty and wordless texts have fingerprint 0 and are linked like any
    other.  Other columns are not read.  An empty table gives no rows.
    """
    return _grouped(docs, id_col, text_col, shingle, max_bits).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs``, all columns, with one document of each group: a row whose id is the group's
    smallest.  Rows without an id stay.  Rows repeating an id are decided each by its own text,
    so unlike texts of one id stay in their own groups.  Of a group's rows with its smallest id
    the one of smallest fingerprint, then text hash, then hash of the other columns stays."""
    found = _grouped(docs, id_col, text_col, shingle, max_bits).filter("doc_id is not null")
    text = ["doc_id", "text_key", "text_key2"]
    names = {c: f"_llm_{c}" for c in text}
    own = found.filter("doc_id = component_id").groupBy("component").agg(
        F.first("doc_id").alias("doc_id"), F.min(F.struct("fp", "text_key", "text_key2")).alias("first"), F.count("*").alias("rows"))
    own = stored(own.select("doc_id", "first.text_key", "first.text_key2", "rows"), "kept")
    marked = docs.withColumns({f"_llm_{c.split('.')[-1]}": k for c, k in zip(text, [F.col(id_col), *_text_key(F.col(text_col))])})
    gone = stored(found.select(*text).distinct().join(own, text, "left_anti"), "gone")
    on = list(names.values())
    kept = marked.join(gone.withColumnsRenamed(names), on, "left_anti")
    # equal texts of a kept id are one document
    again = stored(found.join(own.filter("rows > 1").select(*text), text, "left_semi").groupBy(*text).count().filter("count > 1").select(*text), "again")
    if again.isEmpty():
        return kept.select(*docs.columns)
    again = again.withColumnsRenamed(names)
    row = F.struct(*[F.col(c) for c in docs.columns])
    double = kept.join(again, on, "left_semi").groupBy(*on).agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("_llm_row")).select("_llm_row.*")
    return kept.join(again, on, "left_anti").select(*docs.columns).unionByName(double)


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id."""
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
