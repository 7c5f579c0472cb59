"""Mixing sources to target weights by Pareto order sampling (operator 10), DataFrame functions only.

Each source's share of the words is set by water-filling: weight times level,
never more than ``max_copies`` times what it has.  Inside a source a document
is wanted ``appetite`` times a common factor, again at most ``max_copies``
times.  The whole part of that is certain.  The rest f is an inclusion
probability: documents are ranked by random odds over inclusion odds,
[u / (1 - u)] / [f / (1 - f)], and the first ones are taken until the words
that the source still lacks are reached (the sample's fixed size is in words).
The last place goes to the document whose size is nearest to what remains, or
the next in rank takes the place of one that brings the words nearer still.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowwatch.llm.common import WORD, stored

MAX_COPIES, SEED = 3, 7
#: documents under so many words are wanted half as much
SHORT_WORDS, SHORT_APPETITE = 50, 0.5
#: buckets of the rank by which a source's cut is found without sorting the source
RANK_BUCKETS = 65536

_BIG = "decimal(38,0)"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def default_appetite(size: Column) -> Column:
    return F.when(size < SHORT_WORDS, F.lit(SHORT_APPETITE)).otherwise(F.lit(1.0))


def _random(doc_id: Column) -> Column:
    """In (0, 1), fixed by the id."""
    digits = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"|{SEED}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = MAX_COPIES) -> DataFrame:
    """Target of every source of ``sizes(source, size)``: (source, source_size, target).

    Sources by code point, null last, weigh ``weights`` over and over.  The one
    ordered pass reads one row per source."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * max_copies)
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(0))
    s = (s.withColumn("left_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
         .withColumn("left_words", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
         .withColumn("full", F.col("cap").cast(_BIG) * F.col("left_w") <= F.col("w").cast(_BIG) * F.col("left_words")))
    rest_words = F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0))
    rest_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(every)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(
        (F.col("w") * rest_words).cast("double") / rest_w.cast("double"))
    return s.select("source", "source_size", target.alias("target"))


def _scales(rows: DataFrame, targets: DataFrame, max_copies: int) -> DataFrame:
    """(source, scale): copies of a document are min(max_copies, scale * appetite) and a
    source's copies together have its target's words.  Reads one row per (source, appetite)."""
    a = rows.groupBy("source", "appetite").agg(F.sum("size").alias("words")).filter("words > 0 and appetite > 0")
    a = a.withColumnRenamed("source", "_s").join(targets, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    order = W.partitionBy("source").orderBy(F.desc("appetite"))
    above, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    a = a.withColumn("scale", (F.col("target") - max_copies * F.coalesce(F.sum("words").over(above), F.lit(0)))
                     / F.sum(F.col("words") * F.col("appetite")).over(rest))
    # the first level, from above, that the scale does not fill
    a = a.withColumn("_free", F.col("scale") * F.col("appetite") <= max_copies)
    return a.groupBy("source").agg(F.coalesce(F.max_by("scale", F.when(F.col("_free"), F.col("appetite"))),
                                              F.max("scale")).alias("scale"))


class _Wish:
    """Column expressions of one document: ``whole`` certain copies, and its Pareto rank
    ``q`` (null: not sampled), bucket ``b`` and sort key ``key`` for one copy more."""

    def __init__(self, doc_id: Column, size: Column, text_key: Column, appetite: Column, scale: Column, max_copies: int):
        wanted = F.least(F.lit(float(max_copies)), F.coalesce(scale, F.lit(0.0)) * appetite.cast("double"))
        self.whole = F.floor(wanted)
        f, u = wanted - self.whole, _random(doc_id)
        self.q = F.when((f > 0) & (size > 0), u * (1 - f) / ((1 - u) * f))
        self.b = F.least(F.lit(RANK_BUCKETS - 1), F.floor(self.q / (1 + self.q) * RANK_BUCKETS)).cast("int")
        self.key = F.struct(self.q.alias("q"), doc_id.alias("doc_id"), size.alias("size"), text_key.alias("text_key"))

    def copies(self, edge: Column, cut: Column, extra: Column, drop: Column) -> Column:
        more = (self.b < edge) | ((self.b == edge) & (self.key <= cut)) | self.key.eqNullSafe(extra)
        more = F.coalesce(more, F.lit(False)) & ~self.key.eqNullSafe(drop)
        return (self.whole + F.when(self.q.isNotNull() & more, 1).otherwise(0)).cast("int")


def _joined(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with their source's plan as the struct ``_llm_plan``."""
    p = plan.select(F.struct("*").alias("_llm_plan"))
    return rows.join(p, F.col("source").eqNullSafe(F.col("_llm_plan.source")))


def mix_plan(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = MAX_COPIES) -> DataFrame:
    """Per source what decides each of its documents: (source, source_size, target, scale, edge, cut, extra, drop).

    ``rows(source, doc_id, size, text_key, appetite)``.  ``cut``, ``extra`` and
    ``drop`` are (q, doc_id, size, text_key): documents up to the cut and the one equal
    to ``extra``, but not the one equal to ``drop``, get a copy more.  The cut is found from a histogram of the
    rank with a fixed number of buckets per source; only the documents of one
    bucket are put in order, so no source is ever sorted in one task.
    """
    targets = stored(source_targets(rows, weights, max_copies), "targets")
    scales = _scales(rows, targets, max_copies)
    plan = targets.join(scales.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    plan = stored(plan, "scales")
    r = _joined(rows, plan)
    wish = _Wish(F.col("doc_id"), F.col("size"), F.col("text_key"), F.col("appetite"), F.col("_llm_plan.scale"), max_copies)
    r = r.select("source", "size", F.col("_llm_plan.target").alias("target"), wish.whole.alias("whole"),
                 wish.b.alias("b"), wish.key.alias("key"))
    hist = r.groupBy("source", "b").agg(
        F.sum("size").alias("n"), F.sum(F.col("whole") * F.col("size")).alias("certain"), F.first("target").alias("target"))
    by_bucket = W.partitionBy("source").orderBy(F.col("b").asc_nulls_first())
    # the bucket null holds what is not sampled; its words do not count
    n = F.when(F.col("b").isNotNull(), F.col("n")).otherwise(0)
    hist = (hist.withColumn("need", F.col("target") - F.sum("certain").over(W.partitionBy("source")))
            .withColumn("upto", F.sum(n).over(by_bucket)).withColumn("below", F.col("upto") - n))
    # the bucket in which the words run out, or the last one
    last = F.max("b").over(W.partitionBy("source"))
    edge = stored(hist.filter(F.col("b").isNotNull())
                  .withColumn("_last", last)
                  .filter((F.col("below") <= F.col("need")) & ((F.col("upto") > F.col("need")) | (F.col("b") == F.col("_last"))))
                  .select(F.col("source").alias("_s"), F.col("b").alias("edge"), "below", "need"), "edges")
    key = F.col("key")
    e = r.join(edge, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").filter("b is not null")
    order = W.partitionBy("source").orderBy("key").rangeBetween(W.unboundedPreceding, 0)
    inside = (e.filter("b = edge").withColumn("upto", F.col("below") + F.sum("size").over(order)))
    cuts = inside.groupBy("source").agg(
        F.max(F.when(F.col("upto") <= F.col("need"), key)).alias("cut"),
        F.first("edge").alias("edge"), F.first("need").alias("need"),
        F.coalesce(F.max(F.when(F.col("upto") <= F.col("need"), F.col("upto"))), F.first("below")).alias("got"))
    cuts = stored(cuts.withColumn("lack", F.col("need") - F.col("got")).withColumnRenamed("source", "_s"), "cuts")
    inside = (F.col("b") < F.col("edge")) | ((F.col("b") == F.col("edge")) & F.coalesce(key <= F.col("cut"), F.lit(False)))
    c = r.filter("b is not null").join(cuts, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("inside", inside)
    # the last place: one document more, or the next one for one that is in already, whichever ends nearer
    off = F.abs(F.col("lack") - F.col("size"))
    add = c.filter("not inside").groupBy(F.col("source").alias("_x")).agg(
        F.min(F.when(off < F.col("lack"), F.struct(off.alias("off"), key.alias("key")))).alias("one"), F.min(key).alias("next"))
    last = stored(cuts.select("_s", "edge", "cut", "lack").join(add, F.col("_s").eqNullSafe(F.col("_x")), "left").drop("_x")
                  .withColumn("over", F.col("next.size") - F.col("lack"))
                  .withColumn("off", F.coalesce("one.off", "lack")), "last")
    beside = last.select(F.col("_s").alias("_x"), "over", F.col("off").alias("_off"))
    gone = F.abs(F.col("over") - F.col("size"))
    swap = c.filter("inside").join(beside, F.col("source").eqNullSafe(F.col("_x"))).filter(gone < F.col("_off")).groupBy("_x").agg(
        F.min(F.struct(gone.alias("off"), key.alias("key"))).getField("key").alias("drop"))
    last = last.join(swap, F.col("_s").eqNullSafe(F.col("_x")), "left").select(
        "_s", "edge", "cut", F.when(F.col("drop").isNull(), F.col("one.key")).otherwise(F.col("next")).alias("extra"), "drop")
    return stored(plan.join(last, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "mix")


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _rows(docs: DataFrame, appetite=default_appetite) -> DataFrame:
    r = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _text_key().alias("text_key"))
    return stored(r.withColumn("appetite", appetite(F.col("size")).cast("double")), "sizes")


def _copies(size: Column, text_key: Column, appetite: Column, max_copies: int) -> Column:
    wish = _Wish(F.col("doc_id"), size, text_key, appetite, F.col("_llm_plan.scale"), max_copies)
    return wish.copies(*(F.col(f"_llm_plan.{k}") for k in ("edge", "cut", "extra", "drop")))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = MAX_COPIES,
          appetite=default_appetite) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    Size: number of words, 0 for null and empty texts (their ``taken`` is 0).
    Rows equal in id and text share one decision; ties in rank go by id, size
    and text.  A null id is drawn like any other id and comes first among ties.
    A null source is a source of its own, last in order.  Other columns are not
    read.  An empty table gives no rows.
    """
    rows = _rows(docs, appetite)
    r = _joined(rows, mix_plan(rows, weights, max_copies))
    r = r.withColumn("copies", _copies(F.col("size"), F.col("text_key"), F.col("appetite"), max_copies))
    return r.select("doc_id", "source", "size", F.col("_llm_plan.source_size").alias("source_size"),
                    F.col("_llm_plan.target").alias("target"), "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = MAX_COPIES,
                  appetite=default_appetite) -> DataFrame:
    """``docs``, all columns, each row as often as the mix takes it (not at all, once, or more).
    Every row is decided from its own values and its source's plan.  Wordless
    documents are kept as often as their whole copies say."""
    plan = mix_plan(_rows(docs, appetite), weights, max_copies)
    size = F.col("_llm_size")
    r = _joined(docs.withColumn("_llm_size", word_count(F.col("text"))), plan)
    r = r.withColumn("_llm_copies", _copies(size, _text_key(), appetite(size), max_copies)).filter("_llm_copies > 0")
    r = r.withColumn("_llm_nth", F.explode(F.array_repeat(F.lit(0), F.col("_llm_copies"))))
    return r.select(*docs.columns)


ORACLE_SQL = r"""
with r as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    (('0x' || substr(md5(doc_id::varchar || '|7'), 1, 13))::bigint + 0.5::double) / 4503599627370496::double as u
  from documents),
s0 as (select source, sum(size)::hugeint as n, row_number() over (order by source nulls last) as rn from r group by source),
s1 as (select *, 1 + (rn - 1) % 3 as w, 3 * n as cap from s0),
s2 as (select *, sum(w) over () - coalesce(sum(w) over before, 0) as lw, sum(n) over () - coalesce(sum(cap) over before, 0) as ln
       from s1 window before as (order by cap::double / w, source nulls last rows between unbounded preceding and 1 preceding)),
s3 as (select *, cap * lw <= w * ln as f from s2),
t as (select source, n, case when f then cap::double
        else (w * (sum(n) over () - coalesce(sum(cap) filter (where f) over (), 0)))::double / (sum(w) filter (where not f) over ())::double
        end as target from s3),
a as (select *, case when size < 50 then 0.5::double else 1::double end as a from r),
k0 as (select source, a, sum(size)::hugeint as words from a group by source, a having sum(size) > 0),
k1 as (select k0.source, k0.a, (t.target - (3 * coalesce(sum(words) over above, 0))::double) / (sum(words::double * k0.a) over rest) as scale
       from k0 join t on k0.source is not distinct from t.source
       window above as (partition by k0.source order by k0.a desc rows between unbounded preceding and 1 preceding),
              rest as (partition by k0.source order by k0.a desc rows between current row and unbounded following)),
k as (select source, coalesce(arg_max(scale, a) filter (where scale * a <= 3), max(scale)) as scale from k1 group by source),
x as (select a.*, t.n as source_size, t.target, least(3::double, coalesce(k.scale, 0) * a.a) as wanted
      from a join t on a.source is not distinct from t.source left join k on a.source is not distinct from k.source),
y as (select *, floor(wanted) as whole, wanted - floor(wanted) as f from x),
z as (select *, case when f > 0 and size > 0 then u * (1 - f) / ((1 - u) * f) end as q,
        target - sum(whole::bigint * size) over (partition by source) as need from y),
c as (select *, case when q is not null then sum(size) over (partition by source, q is null order by q, doc_id) end as upto from z),
d as (select *, coalesce(q is not null and upto <= need, false) as inside from c),
g as (select *, need - coalesce(max(upto) filter (where inside) over (partition by source), 0) as lack from d),
h0 as (select *, q is not null and not inside as out,
        min(case when q is not null and not inside and abs(lack - size) < lack then abs(lack - size) end) over (partition by source) as off_one,
        min(case when q is not null and not inside then row(q, doc_id, size) end) over (partition by source) as nxt from g),
h1 as (select *, coalesce(off_one, lack) as off, abs(nxt[3] - lack - size) as gap from h0),
h2 as (select *, min(case when inside and gap < off then row(gap, q, doc_id) end) over (partition by source) as swap,
        min(case when out and abs(lack - size) = off_one then row(q, doc_id) end) over (partition by source) as one from h1),
h as (select *, case when swap is null then out and one is not null and abs(lack - size) = off_one and q = one[1] and doc_id = one[2]
             else out and q = nxt[1] and doc_id = nxt[2] end as extra,
        coalesce(inside and q = swap[2] and doc_id = swap[3], false) as gone from h2),
k9 as (select *, case when (inside and not gone) or coalesce(extra, false) then 1 else 0 end as more from h)
select doc_id, source, size, source_size::bigint as source_size, target,
  (whole + more)::int as copies, (whole::bigint + more) * size as taken
from k9
"""
