"""Quality rules with thresholds that adapt to language and source (operator 11).

Each document gives a few whole-number measures.  Their distribution is kept as
mergeable quantile sketches, one per language, source and measure: a sketch is
its non-empty buckets (values that agree in their leading seven binary digits)
with their counts, as rows, so sketches of parts are merged by adding counts,
and those of a language, or of all, by leaving out a key.  A bucket's lower end
is within 1/64 of every value in it.

A threshold lies above the median by a multiple of the distance between the
lower quartile and the median: the lower half of a measure is not moved by junk
in the upper half.  The thresholds of a source are drawn towards those of its
language, and these towards those of all documents, as if by a few more
documents, so small sources need no rule of their own.  Thresholds are joined
to the measures, and documents beyond one of them go.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowwatch.llm.common import python_tasks, stored

#: base rules: least words, largest share of repeated words (percent)
LEAST_WORDS, MOST_REPEATED = 50, 50
#: lower-half spreads between the median and a threshold; pseudo-documents of the level above
REACH, PRIOR = 6, 50
#: leading binary digits in which the values of a bucket agree
DIGITS = 7
#: measures in thousandths: least distance of a threshold from the median, and whether low values fail too
MEASURES = {"word_length": (1500, True), "symbols": (100, False), "dup_lines": (400, False), "repeats": (350, False)}

_SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def text_counts(raw: bytes | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word) of a UTF-8 text."""
    raw = raw or b""
    words = raw.split()
    n = len(words)
    chars = len(b"".join(words).translate(None, _CONTINUATION))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    first: dict[tuple, int] = {}
    inside = bytearray(n)
    for i, window in enumerate(zip(words, words[1:], words[2:])):
        j = first.setdefault(window, i)
        if j != i:
            inside[i:i + 3] = inside[j:j + 3] = b"\1\1\1"
    return n, chars, symbols, len(lines) - len(set(lines)), sum(inside), len(lines)


def counts(spark, text: Column) -> Column:
    """``text_counts`` of a text column, as a struct of longs."""
    python_tasks(spark)

    @F.pandas_udf(", ".join(f"{c} long" for c in _COUNTS))
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_counts(t) for t in texts], columns=_COUNTS, dtype="int64")

    return run(text.cast("binary"))


def base_failed(c: Column) -> Column:
    return (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])


def measures(c: Column) -> dict[str, Column]:
    """The measures, in thousandths, of a column of counts."""
    def share(part: Column, whole: Column) -> Column:
        return F.call_function("div", 1000 * part, F.greatest(whole, F.lit(1)))

    return {"word_length": share(c["word_chars"], c["n_words"]), "symbols": share(c["n_symbols"], c["n_words"]),
            "dup_lines": share(c["n_dup_lines"], c["n_lines"]), "repeats": share(c["n_repeat_words"], c["n_words"])}


def bucket(value: Column) -> Column:
    """Lower end of a whole number's bucket: all but its leading binary digits are zero."""
    shift = F.greatest(F.length(F.bin(value)) - DIGITS, F.lit(0))
    return value - value % F.call_function("shiftleft", F.lit(1).cast("long"), shift)


def sketches(values: DataFrame, keys: list[str]) -> DataFrame:
    """Quantile sketches of ``values(*keys, measure, value)``: (*keys, measure, low, n)."""
    return values.withColumn("low", bucket(F.col("value"))).groupBy(*keys, "measure", "low").agg(F.count("*").alias("n"))


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches merged over all keys but ``keys``."""
    return parts.groupBy(*keys, "measure", "low").agg(F.sum("n").alias("n"))


def fences(parts: DataFrame, keys: list[str], reach: int = REACH) -> DataFrame:
    """Per sketch of ``parts(*keys, measure, low, n)``: number of values, and the thresholds below and above the median."""
    group = W.partitionBy(*keys, "measure")
    d = parts.withColumn("upto", F.sum("n").over(group.orderBy("low"))).withColumn("total", F.sum("n").over(group))
    q = d.groupBy(*keys, "measure").agg(
        F.max("total").alias("total"),
        F.min(F.when(4 * F.col("upto") >= F.col("total"), F.col("low"))).alias("q25"),
        F.min(F.when(2 * F.col("upto") >= F.col("total"), F.col("low"))).alias("q50"))
    least = F.lit(None).cast("long")
    for name, (distance, _) in MEASURES.items():
        least = F.when(F.col("measure") == name, distance).otherwise(least)
    away = F.greatest(reach * (F.col("q50") - F.col("q25")), least)
    return q.select(*keys, "measure", "total", (F.col("q50") - away).cast("double").alias("lower"),
                    (F.col("q50") + away).cast("double").alias("upper"))


def thresholds(values: DataFrame, reach: int = REACH, prior: int = PRIOR) -> DataFrame:
    """(lang_key, source_key, measure, lower, upper) for every language and source of
    ``values(lang_key, source_key, measure, value)``."""
    keys = ["lang_key", "source_key"]
    own = stored(sketches(values, keys), "sketches")
    by_lang = merged(own, keys[:1])
    levels = [fences(own, keys, reach), fences(by_lang, keys[:1], reach), fences(merged(own, []), [], reach)]
    one, two, three = (d.withColumnsRenamed({c: f"{c}{k}" for c in ("total", "lower", "upper")}) for k, d in enumerate(levels))

    def drawn(n: Column, x: Column, to: Column) -> Column:
        return (n * x + prior * to) / (n + prior)

    d = one.join(two, ["lang_key", "measure"]).join(three, ["measure"])
    for side in ("lower", "upper"):
        d = d.withColumn(side, drawn(F.col("total0"), F.col(f"{side}0"), drawn(F.col("total1"), F.col(f"{side}1"), F.col(f"{side}2"))))
    return d.select(*keys, "measure", "lower", "upper")


def _key(c: Column) -> Column:
    """A join key that tells null from every string."""
    return F.coalesce(F.concat(F.lit("="), c), F.lit(""))


def _bounds(counted: DataFrame, reach: int, prior: int) -> DataFrame:
    """One row per language and source of ``counted(lang, source, c)``: the thresholds that its documents meet."""
    fine = counted.filter(~base_failed(F.col("c"))).select(
        _key(F.col("lang")).alias("lang_key"), _key(F.col("source")).alias("source_key"),
        F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), v.alias("value")) for m, v in measures(F.col("c")).items()])).alias("m"))
    t = thresholds(fine.select("lang_key", "source_key", "m.measure", "m.value"), reach, prior)
    return stored(t.groupBy("lang_key", "source_key").agg(*[
        F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"_llm_{side}_{m}") for m in MEASURES for side in ("lower", "upper")]), "thresholds")


def _judged(counted: DataFrame, bounds: DataFrame) -> DataFrame:
    """``counted(..., lang, source, c)`` with ``_llm_failed``: the measures beyond a threshold, comma-joined."""
    d = counted.withColumn("_llm_lang", _key(F.col("lang"))).withColumn("_llm_source", _key(F.col("source")))
    d = d.join(bounds, (F.col("_llm_lang") == F.col("lang_key")) & (F.col("_llm_source") == F.col("source_key")), "left")
    beyond = []
    for m, v in measures(F.col("c")).items():
        out = v > F.col(f"_llm_upper_{m}")
        if MEASURES[m][1]:
            out = out | (v < F.col(f"_llm_lower_{m}"))
        beyond.append(F.when(out, F.lit(m)))
    return d.withColumn("_llm_failed", F.concat_ws(",", *beyond)).drop("lang_key", "source_key", "_llm_lang", "_llm_source")


def _verdict() -> Column:
    return ~base_failed(F.col("c")) & (F.col("_llm_failed") == "")


def quality_report(docs: DataFrame, reach: int = REACH, prior: int = PRIOR) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, and ``beyond``: the measures beyond a threshold of the row's language and source.

    Thresholds are taken from all documents that pass the base rules.  Null and
    empty texts have no words and fail.  Null languages and sources are a
    language and a source of their own.  Rows without an id, and rows repeating
    one, are documents like any other.  Other columns are not read.  An empty
    table gives no rows.
    """
    counted = stored(docs.select("doc_id", "lang", "source", counts(docs.sparkSession, F.col("text")).alias("c")), "counts")
    judged = _judged(counted, _bounds(counted, reach, prior))
    return judged.select("doc_id", *[f"c.{c}" for c in _COUNTS[:5]], base_failed(F.col("c")).alias("base_failed"),
                         _verdict().alias("kept"), F.col("_llm_failed").alias("beyond"))


def keep_good(docs: DataFrame, reach: int = REACH, prior: int = PRIOR) -> DataFrame:
    """``docs``, all columns, without the documents that fail; texts are counted twice rather than written."""
    spark = docs.sparkSession
    bounds = _bounds(docs.select("lang", "source", counts(spark, F.col("text")).alias("c")), reach, prior)
    whole = docs.select(F.struct(*docs.columns).alias("_llm_row"), "lang", "source", counts(spark, F.col("text")).alias("c"))
    return _judged(whole, bounds).filter(_verdict()).select("_llm_row.*")


def oracle_sql() -> str:
    def share(part: str, whole: str) -> str:
        return f"1000 * {part} // greatest({whole}, 1)"

    values = {"word_length": share("word_chars", "n_words"), "symbols": share("n_symbols", "n_words"),
              "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words")}
    rows = " union all ".join(f"select *, '{m}' as measure, {v} as value, {MEASURES[m][0]} as least, {str(MEASURES[m][1]).lower()} as both_ends from b" for m, v in values.items())
    levels = {"own": "lang, source, ", "by_lang": "lang, ", "every": ""}
    fence = ",\n".join(f"""
{name}_c as (select {k}measure, any_value(least) as least, value - value % (1::bigint << greatest(length(bin(value)) - {DIGITS}, 0)) as low, count(*) as n
  from m where not base_failed group by {k}measure, low),
{name}_u as (select *, sum(n) over (partition by {k}measure order by low) as upto, sum(n) over (partition by {k}measure) as total from {name}_c),
{name}_q as (select {k}measure, any_value(least) as least, max(total)::double as total, min(low) filter (where 4 * upto >= total) as q25,
  min(low) filter (where 2 * upto >= total) as q50 from {name}_u group by {k}measure),
{name} as (select *, (q50 - greatest({REACH} * (q50 - q25), least))::double as lower, (q50 + greatest({REACH} * (q50 - q25), least))::double as upper from {name}_q)"""
                       for name, k in levels.items())

    def drawn(side: str) -> str:
        up = f"(l.total * l.{side} + {PRIOR} * e.{side}) / (l.total + {PRIOR})"
        return f"(o.total * o.{side} + {PRIOR} * ({up})) / (o.total + {PRIOR}) as {side}"

    word = r"[^\x20\x09-\x0D]"
    return f"""
with d as (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '{word}+') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) as ls from d),
win as (select r, i, ws[i:i + 2] as x from (select r, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3)),
rep as (select r, i from win semi join (select r, x from win group by r, x having count(*) > 1) g using (r, x)),
cov as (select r, count(distinct i + k) as n from (select r, i, unnest([0, 1, 2]) as k from rep) group by r),
a as (select w.r, doc_id, lang, source, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
  len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(cov.n, 0) as n_repeat_words, len(ls) as n_lines from w left join cov using (r)),
b as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed from a),
m as ({rows}),{fence},
t as (select o.lang, o.source, o.measure, {drawn('lower')}, {drawn('upper')} from own o
  join by_lang l on o.lang is not distinct from l.lang and o.measure = l.measure join every e on o.measure = e.measure),
j as (select m.*, m.value > t.upper or (m.both_ends and m.value < t.lower) as beyond from m left join t
  on m.lang is not distinct from t.lang and m.source is not distinct from t.source and m.measure = t.measure)
select any_value(doc_id) as doc_id, any_value(n_words)::bigint as n_words, any_value(word_chars)::bigint as word_chars, any_value(n_symbols)::bigint as n_symbols,
  any_value(n_dup_lines)::bigint as n_dup_lines, any_value(n_repeat_words)::bigint as n_repeat_words, any_value(base_failed) as base_failed,
  not any_value(base_failed) and not coalesce(bool_or(beyond), false) as kept,
  coalesce(string_agg(measure, ',' order by case measure {' '.join(f"when '{x}' then {i}" for i, x in enumerate(MEASURES))} end) filter (where beyond), '') as beyond
from j group by r
"""
