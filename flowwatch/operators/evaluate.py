"""Evaluation and benchmark normalisation.

All metrics are aggregates (``count_if`` / ``groupBy``); nothing is collected
to compute them.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwatch import config as C
from flowwatch.functions import round_half_even


def _r(x):
    return round_half_even(x, 6)


def round6(c):
    """Report precision for metrics (6 decimals, half to even)."""
    return round_half_even(c, 6)


def threat_class_from_rules(th=None) -> F.Column:
    """Class 0/1/2 predicted by the single-window rule table."""
    from flowwatch.config import DEFAULT
    from flowwatch.operators.rules import rule_classify
    _, t = rule_classify(th=th or DEFAULT)
    return F.when(t == C.SEVERE, F.lit(2)).when(t.isin(C.MODERATE, C.BANDWIDTH), F.lit(1)).otherwise(F.lit(0))


def threat_class(threat: str = "rule_threat") -> F.Column:
    """Threat text -> class 0/1/2 (both moderate levels are class 1)."""
    t = F.col(threat)
    return (F.when(t == C.SEVERE, F.lit(2))
            .when(t.isin(C.MODERATE, C.BANDWIDTH), F.lit(1)).otherwise(F.lit(0)))


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """D10."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))


def confusion_matrix(df: DataFrame, truth: str = "label", pred: str = "prediction",
                     classes=(0, 1, 2)) -> DataFrame:
    """Truth rows x predicted-class columns (zero-filled)."""
    p = df.groupBy(truth).pivot(pred, list(classes)).count().na.fill(0)
    return p.select(truth, *[F.col(str(c)).alias(f"pred_{c}") for c in classes])


def binary_confusion(df: DataFrame, truth: str = "label", pred: str = "prediction") -> DataFrame:
    """Attack (class > 0) vs benign counts, one row."""
    t, p = F.col(truth) > 0, F.col(pred) > 0
    return df.agg(F.count_if(t & p).alias("tp"), F.count_if(t & ~p).alias("fn"),
                  F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"))


#: metric, the spec's bound, and whether the bound is the least or the most allowed
SPEC = [("detection_rate", C.TARGET_DETECTION_RATE, "least"), ("false_positive_rate", C.TARGET_FALSE_POSITIVE, "most"),
        ("precision", C.TARGET_PRECISION, "least"), ("f1", C.TARGET_F1, "least")]


def _ratio(part: F.Column, whole: F.Column) -> F.Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def within(metric: F.Column, bound: float, kind: str) -> F.Column:
    """Mark of a metric against its bound (the bound itself is allowed)."""
    kept = metric >= bound if kind == "least" else metric <= bound
    return F.when(kept, "PASS").otherwise("FAIL")


def spec_metrics(conf: DataFrame) -> DataFrame:
    """D13 + C25: the spec's four metrics (0 where undefined), rounded, each with its mark."""
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    rates = conf.select("tp", "fn", "fp", "tn", _ratio(tp, tp + fn).alias("detection_rate"),
                        _ratio(fp, fp + tn).alias("false_positive_rate"), _ratio(tp, tp + fp).alias("precision"))
    p, r = F.col("precision"), F.col("detection_rate")
    rates = rates.withColumn("f1", _ratio(2 * p * r, p + r))
    names = {"detection_rate": "detection_mark", "false_positive_rate": "false_positive_mark"}
    return rates.select("tp", "fn", "fp", "tn", *[_r(F.col(m)).alias(m) for m, _, _ in SPEC],
                        *[within(F.col(m), bound, kind).alias(names.get(m, f"{m}_mark")) for m, bound, kind in SPEC])


def latency_mark(ms_per_decision: float) -> str:
    """D15's mark against the spec's bound per decision."""
    return "PASS" if ms_per_decision <= C.TARGET_LATENCY_MS else "FAIL"


def label_counts(df: DataFrame, truth: str = "label", pred: str = "prediction", test: F.Column | None = None) -> DataFrame:
    """Rows per (truth, prediction) and whether they are evaluated: all that the metrics need, in one pass.

    ``test``: the rows to evaluate (default all); the others only show which classes there are."""
    t = F.lit(True) if test is None else test
    return df.groupBy(F.col(truth).alias("label"), F.col(pred).alias("prediction"), t.alias("test")).agg(F.count(F.lit(1)).alias("rows"))


def classification_report(df: DataFrame, classes=(0, 1, 2), truth: str = "label", pred: str = "prediction",
                          names: dict | None = None, test: F.Column | None = None) -> DataFrame:
    """Per-class precision/recall/F1/support, accuracy, macro and weighted averages.

    The rows are read once, for their :func:`label_counts`; all else is arithmetic on these few rows.
    Only classes that occur in ``df`` get a row and count in the macro average; ``test`` picks the rows
    that are evaluated (default all).
    """
    names = names or {}
    y, z, n = F.col("label"), F.col("prediction"), F.col("rows")

    def rows(cond: F.Column) -> F.Column:
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0))

    aggs = [rows(F.col("test")).alias("n"), rows(F.col("test") & (y == z)).alias("correct"),
            F.struct(*[(rows(y == c) > 0).alias(f"in{c}") for c in classes]).alias("_flags")]
    for c in classes:
        aggs += [rows(F.col("test") & (y == c) & (z == c)).alias(f"tp{c}"), rows(F.col("test") & (z == c)).alias(f"pp{c}"),
                 rows(F.col("test") & (y == c)).alias(f"s{c}")]
    row = label_counts(df, truth, pred, test).agg(*aggs)
    per = []
    for c in classes:
        tp, pp, s = F.col(f"tp{c}"), F.col(f"pp{c}"), F.col(f"s{c}")
        p = F.when(pp > 0, tp / pp).otherwise(F.lit(0.0))
        r = F.when(s > 0, tp / s).otherwise(F.lit(0.0))
        f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
        per.append(F.struct(F.lit(names.get(c, str(c))).alias("class"), p.alias("precision"),
                            r.alias("recall"), f.alias("f1_score"), s.alias("support"),
                            F.col(f"_flags.in{c}").alias("present")))
    cls = row.select("n", "correct", F.array(*per).alias("rows"))
    ps = [F.col("rows")[i] for i in range(len(classes))]

    def psum(field, weight=None):
        terms = [F.when(x["present"], x[field] * (x[weight] if weight else F.lit(1.0))).otherwise(F.lit(0.0))
                 for x in ps]
        return sum(terms[1:], terms[0])

    k = sum([F.when(x["present"], F.lit(1.0)).otherwise(F.lit(0.0)) for x in ps[1:]],
            F.when(ps[0]["present"], F.lit(1.0)).otherwise(F.lit(0.0)))
    nn = F.col("n")
    macro = F.struct(F.lit("macro avg").alias("class"), (psum("precision") / k).alias("precision"),
                     (psum("recall") / k).alias("recall"), (psum("f1_score") / k).alias("f1_score"),
                     nn.alias("support"), F.lit(True).alias("present"))
    weighted = F.struct(F.lit("weighted avg").alias("class"),
                        (psum("precision", "support") / nn).alias("precision"),
                        (psum("recall", "support") / nn).alias("recall"),
                        (psum("f1_score", "support") / nn).alias("f1_score"),
                        nn.alias("support"), F.lit(True).alias("present"))
    acc = F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                   F.lit(None).cast("double").alias("recall"),
                   F.when(nn > 0, F.col("correct") / nn).otherwise(F.lit(0.0)).alias("f1_score"),
                   nn.alias("support"), F.lit(True).alias("present"))
    allr = cls.select(F.explode(F.concat(F.col("rows"), F.array(acc, macro, weighted))).alias("r"))
    return allr.filter(F.col("r.present")).select(
        F.col("r.class").alias("class"), _r(F.col("r.precision")).alias("precision"),
        _r(F.col("r.recall")).alias("recall"), _r(F.col("r.f1_score")).alias("f1_score"),
        F.col("r.support").cast("bigint").alias("support"))


# ---------------------------------------------------------------------------
# Labelled benchmark
# ---------------------------------------------------------------------------

def normalize_benchmark(df: DataFrame, unit_scale: float = 1.0) -> DataFrame:
    """C22 + C23: trim header names, apply aliases, add missing features as 0.0.

    Names are trimmed *before* aliasing (Q16); a missing ``Label`` is an error.
    """
    renamed = []
    for c in df.columns:
        name = c.strip()
        renamed.append(F.col(f"`{c}`").alias(C.BENCHMARK_ALIASES.get(name, name)))
    out = df.select(*renamed)
    if "Label" not in out.columns:
        raise ValueError("Expected a 'Label' column with BENIGN / attack-name values.")
    for c in C.FEATURE_COLS:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(0.0))
    if unit_scale != 1.0:
        out = out.withColumn("flow_duration_sec", F.col("flow_duration_sec") * unit_scale)
    return out


def binary_truth(label: str = "Label") -> F.Column:
    """Attack unless the label is ``BENIGN`` (any case); null counts as attack."""
    return (F.upper(F.coalesce(F.col(label).cast("string"), F.lit("nan"))) != "BENIGN").cast("int")


def scoring_latency_ms(flows: DataFrame, score) -> float:
    """Wall time of ``score(flows)`` per flow, in ms.  The flows are made and held before, so only
    the decisions are timed."""
    flows = flows.persist()
    try:
        n = flows.count()
        t = time.perf_counter()
        score(flows).write.format("noop").mode("overwrite").save()
        return (time.perf_counter() - t) / max(n, 1) * 1000.0
    finally:
        flows.unpersist()


def decision_latency_ms(scored: DataFrame) -> float:
    """Wall time of a full scoring pass (noop sink) per row, in ms, with all that ``scored`` is made of;
    :func:`scoring_latency_ms` times the decisions alone."""
    n = scored.count()
    t = time.perf_counter()
    scored.write.format("noop").mode("overwrite").save()
    return (time.perf_counter() - t) / max(n, 1) * 1000.0
