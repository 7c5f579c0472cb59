"""List layers, fusion and profile precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwatch import config as C
from flowwatch.functions import threat_rank


def mark_listed(flows: DataFrame, ips: DataFrame | None, flag: str) -> DataFrame:
    """Membership flag from a one-column (``ip``) list.

    The list is de-duplicated by its reader; the join is a left outer equi-join
    that the planner broadcasts when the list's measured size is small.
    """
    if ips is None:
        return flows.withColumn(flag, F.lit(False))
    lst = ips.select(F.col("ip").alias("_ip")).withColumn(flag, F.lit(True))
    return (flows.join(lst, flows["src_ip"] == lst["_ip"], "left")
            .drop("_ip").withColumn(flag, F.coalesce(F.col(flag), F.lit(False))))


def fuse(*threats: Column) -> Column:
    """highest rank wins; ties keep the earliest argument."""
    ranks = [threat_rank(t) for t in threats]
    top = F.greatest(*ranks)
    expr = threats[-1]
    for t, r in reversed(list(zip(threats[:-1], ranks[:-1]))):
        expr = F.when(r == top, t).otherwise(expr)
    return expr


def apply_precedence(df: DataFrame) -> DataFrame:
    """F8: intel > whitelist > DNS > slow (only if it ranks >= fused) > rule.

    Expects columns ``model_threat, rule_profile, rule_threat, slow_profile,
    slow_threat, dns_profile, dns_threat, intel_hit, baseline_hit``.
    """
    fused = fuse(F.col("model_threat"), F.col("rule_threat"), F.col("slow_threat"), F.col("dns_threat"))
    df = df.withColumn("fused_threat", fused)
    slow_wins = F.col("slow_profile").isNotNull() & (
        threat_rank(F.col("slow_threat")) >= threat_rank(F.col("fused_threat")))
    threat = (F.when(F.col("intel_hit"), F.lit(C.SEVERE))
              .when(F.col("baseline_hit"), F.lit(C.BASELINE))
              .otherwise(F.col("fused_threat")))
    profile = (F.when(F.col("intel_hit"), F.lit(C.P_INTEL))
               .when(F.col("baseline_hit"), F.lit(C.P_WHITELIST))
               .when(F.col("dns_profile").isNotNull(), F.col("dns_profile"))
               .when(slow_wins, F.col("slow_profile"))
               .otherwise(F.col("rule_profile")))
    return df.withColumn("threat_level", threat).withColumn("traffic_profile", profile)
