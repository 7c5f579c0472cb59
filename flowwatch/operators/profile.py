"""Column profile of a raw packet export (diagnostic of flag columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Raw flag fields (the export names them tcp.flags.syn/ack/fin/reset, all matching "flags").
FLAG_FIELDS = ("syn", "ack", "fin", "rst")


def flag_candidates(df: DataFrame) -> list[str]:
    return [c for c in df.columns
            if c in FLAG_FIELDS or any(k in c.lower() for k in ("flags", "syn", "ack"))]


def column_profile(df: DataFrame, order: str = "frame_no", first_n: int = 20,
                   distinct_n: int = 15) -> DataFrame:
    """One row per candidate column: rows, dtype, first non-null values and the
    first distinct values in order of appearance.  Both "first" lists are
    distributed top-k queries (``orderBy(...).limit``), not full sorts.

    ``order`` is the column that tells which row comes first: packets of an export have none of their own, so they
    are read with their ``place``.
    """
    total = df.agg(F.count(F.lit(1)).alias("rows"))
    parts = []
    types = dict(df.dtypes)
    for c in flag_candidates(df):
        firsts = (df.filter(F.col(c).isNotNull()).orderBy(order).limit(first_n)
                  .agg(F.sort_array(F.collect_list(F.struct(order, F.col(c).cast("string").alias("v"))))
                       .alias("a"))
                  .select(F.transform("a", lambda x: x["v"]).alias("first_values")))
        uniq = (df.select(F.col(c).cast("string").alias("v"), order).groupBy("v")
                .agg(F.min(order).alias("o")).orderBy("o").limit(distinct_n)
                .agg(F.sort_array(F.collect_list(F.struct("o", "v"))).alias("a"))
                .select(F.transform("a", lambda x: F.coalesce(x["v"], F.lit("nan"))).alias("distinct_values")))
        one = total.select(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"), "rows",
                           firsts.scalar().alias("first_values"), uniq.scalar().alias("distinct_values"))
        parts.append(one)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
