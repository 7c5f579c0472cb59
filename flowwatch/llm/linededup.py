"""Line de-duplication (operator 6), DataFrame functions only.

Lines are split off whole texts and only their hashes travel.  The hashes are
range-partitioned with the document as second key and sorted by (hash,
document, position), so one very frequent line spreads over many tasks; a
streaming pass keeps the first occurrence in every document, and counting
those gives each line's document count and its largest document.  What comes
back is not text but a compressed bitmap per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowwatch.llm.common import WHITE, lower_ascii, stored

#: shortest key (code points) and smallest number of documents that make a line boilerplate
MIN_CHARS, MIN_DOCS = 40, 5


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_key, pos, h1, h2) of every line whose key is long enough."""
    lines = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), _text_key(F.col(text_col)).alias("text_key"),
        F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
    key = F.btrim("line", F.lit(WHITE))
    return (lines.filter(F.char_length(key) >= min_chars)
            .withColumn("line", lower_ascii(key))
            .select("doc_id", "text_key", "pos", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2")))


def drop_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Keep bitmaps of the documents that lose a line.

    Returns (doc_id, text_key, n_dropped, bitmap): ``bitmap`` is an array of
    (word, keep) for the 64-line words that lose a line, ascending; bit b of
    ``keep`` is line 64 * word + b.  Words that are not listed, and documents
    that are not listed, keep all.

    A line's key is the line stripped of ASCII white space with A-Z lowered;
    keys of at least ``min_chars`` code points found in at least ``min_docs``
    distinct documents stay only in the largest document id holding them (all
    its lines with the key).  Null and empty texts are one empty line.  Rows
    without an id take no part and keep all.  Rows repeating an id count as
    one document and each keeps or loses its own lines.  Other columns are not
    read.  An empty table gives no rows.
    """
    at = stored(line_hashes(docs, id_col, text_col, min_chars), "lines")
    line = ["h1", "h2"]
    sorted_ = (at.select(*line, "doc_id", "pos").repartitionByRange(*line, "doc_id")
               .sortWithinPartitions(*line, "doc_id", "pos"))
    first = (sorted_.withColumn("nth", F.row_number().over(W.partitionBy(*line, "doc_id").orderBy("pos")))
             .filter("nth = 1"))
    common = (first.groupBy(*line).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("stays_in"))
              .filter(F.col("n_docs") >= min_docs).drop("n_docs"))
    # written first: the join's sides are then plain shuffles, and a very common line is split by adaptive execution
    common = stored(common, "common-lines")
    gone = at.join(common, line).filter("doc_id <> stays_in")
    words = gone.groupBy("doc_id", "text_key", F.expr("pos div 64").cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("drop"))
    return words.groupBy("doc_id", "text_key").agg(
        F.sum(F.bit_count("drop")).cast("long").alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("drop").alias("keep")))).alias("bitmap"))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the bitmap and count of each row as ``_llm_bitmap`` and ``_llm_dropped``."""
    b = bitmaps.select(F.col("doc_id").alias("_llm_id"), F.col("text_key").alias("_llm_key"),
                       F.col("n_dropped").alias("_llm_dropped"), F.col("bitmap").alias("_llm_bitmap"))
    return docs.join(b, (docs[id_col] == b["_llm_id"]) & (_text_key(docs[text_col]) == b["_llm_key"]), "left").drop(
        "_llm_id", "_llm_key")


def kept_text(text: Column, bitmap: Column) -> Column:
    """The lines that the bitmap keeps, joined by newlines (the text itself without a bitmap)."""
    words = F.map_from_entries(bitmap)

    def keep(line: Column, i: Column) -> Column:
        word = F.coalesce(F.element_at(words, F.shiftright(i, 6)), F.lit(-1).cast("long"))
        return F.call_function("shiftrightunsigned", word, i.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("long")) == 1

    return F.when(bitmap.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.filter(_lines(text), keep), "\n"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs``, all columns, with the dropped lines taken out of the texts
    (and ``n_chars``, if there, counted anew).  Null texts stay null."""
    marked = with_bitmaps(docs, drop_bitmaps(docs, id_col, text_col, min_chars, min_docs), id_col, text_col)
    new = F.when(F.col(text_col).isNull(), None).otherwise(kept_text(F.col(text_col), F.col("_llm_bitmap")))
    out = marked.withColumn(text_col, new).drop("_llm_bitmap", "_llm_dropped")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.char_length(text_col).cast(kind))
    return out.select(*docs.columns)


def line_report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_dropped, kept_sha256 and the bitmap (null: keeps all)."""
    d = docs.select("doc_id", "text")
    return with_bitmaps(d, drop_bitmaps(d)).select(
        "doc_id", F.size(_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce("_llm_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(kept_text(F.col("text"), F.col("_llm_bitmap")), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
x as (select doc_id, l[i] as line, i,
        translate(trim(l[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
      from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from d)),
c as (select k, max(doc_id) as stays_in from x where length(k) >= 40 group by k having count(distinct doc_id) >= 5),
y as (select x.*, c.k is not null and x.doc_id <> c.stays_in as gone from x left join c on x.k = c.k)
select doc_id, count(*)::bigint as n_lines, (count(*) filter (where gone))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from y group by doc_id
"""
