"""Learning and evaluation queries (section 2.9 + D10-D15, C22-C25)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowwatch import config as C
from flowwatch.operators import evaluate as E
from flowwatch.operators import ml
from flowwatch.operators.flows import flow_features
from flowwatch.plans import oracle as O
from flowwatch.plans.catalog import ALERTS_PLAIN, W, _detector, _pk, _scored, register
from flowwatch.plans.pipeline import detect, to_alerts

KEYS = ["window_id", "src_ip"]


def _labelled(s, sf):
    """Scored flows + weak label (truth) + class of the fused detector threat (prediction)."""
    f = _scored(s, sf)
    return ml.with_weak_label(f).withColumn("prediction", E.threat_class("threat_level"))


def _split(s, sf):
    return ml.train_test_split(_labelled(s, sf), KEYS)


def _test(s, sf):
    return _split(s, sf).filter("is_test")


LAB = f"""
lab AS (SELECT *, ({O.WEAK_LABEL}) AS label,
  CASE WHEN threat_level = 'Severe (Critical Anomaly)' THEN 2
       WHEN threat_level IN ('Moderate (Suspicious)', 'Moderate (Bandwidth Spike)') THEN 1 ELSE 0 END
    AS prediction FROM scored),
hs AS (SELECT *, md5(concat_ws('|', cast(window_id AS varchar), src_ip) || '#42') AS h FROM lab),
sp AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h)
                 <= round(count(*) OVER (PARTITION BY label) * 0.2) AS is_test FROM hs),
test AS (SELECT * FROM sp WHERE is_test)"""
L = W(*ALERTS_PLAIN, LAB)

register("weak_labels", L + "SELECT window_id, src_ip, label FROM lab")(
    lambda s, sf: _labelled(s, sf).select("window_id", "src_ip", "label"))

register("label_distribution", L + 'SELECT label, count(*) AS "count" FROM lab GROUP BY label')(
    lambda s, sf: E.label_distribution(_labelled(s, sf)))


def _z(c):
    s = f"stddev_pop(cast({c} AS double)) OVER ()"
    return (f"{O.rhe(f'(cast({c} AS double) - avg(cast({c} AS double)) OVER ()) / CASE WHEN {s} = 0 THEN 1 ELSE {s} END', 6)}"
            f" AS {c}_z")


register("scaled_features", W(*O.BASE) + "SELECT window_id, src_ip, "
         + ", ".join(_z(c) for c in C.FEATURE_COLS) + " FROM flows")(
    lambda s, sf: (lambda z: z.select(*KEYS, *[E.round6(f"{c}_z").alias(f"{c}_z") for c in C.FEATURE_COLS]))(
        ml.scaled_features_exact(flow_features(_pk(s, sf)).select(*KEYS, *C.FEATURE_COLS))))

register("train_test_split", L + "SELECT window_id, src_ip, label, is_test FROM sp")(
    lambda s, sf: _split(s, sf).select("window_id", "src_ip", "label", "is_test"))

register("class_weights", L + """
, w AS (SELECT label, count(*) AS n_c FROM sp WHERE NOT is_test GROUP BY label)
SELECT label, n_c, (SELECT sum(n_c) FROM w) / ((SELECT count(*) FROM w) * n_c) AS weight FROM w""")(
    lambda s, sf: ml.class_weights(_split(s, sf).filter("NOT is_test")))

register("confusion_matrix", L + """
SELECT label, count(*) FILTER (WHERE prediction = 0) AS pred_0, count(*) FILTER (WHERE prediction = 1) AS pred_1,
       count(*) FILTER (WHERE prediction = 2) AS pred_2 FROM test GROUP BY label""")(
    lambda s, sf: E.confusion_matrix(_test(s, sf)))

BIN = """
SELECT count(*) FILTER (WHERE label > 0 AND prediction > 0) AS tp,
       count(*) FILTER (WHERE label > 0 AND prediction = 0) AS fn,
       count(*) FILTER (WHERE label = 0 AND prediction > 0) AS fp,
       count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn FROM test"""
register("binary_confusion", L + BIN)(lambda s, sf: E.binary_confusion(_test(s, sf)))


def _spec_sql(src: str) -> str:
    dr = "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END"
    fpr = "CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END"
    pr = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END"
    return f"""
m AS (SELECT tp, fn, fp, tn, {dr} AS dr, {fpr} AS fpr, {pr} AS prec FROM ({src}) c),
m2 AS (SELECT *, CASE WHEN prec + dr > 0 THEN 2 * prec * dr / (prec + dr) ELSE 0.0 END AS f1 FROM m)
SELECT tp, fn, fp, tn, {O.rhe('dr', 6)} AS detection_rate, {O.rhe('fpr', 6)} AS false_positive_rate,
  {O.rhe('prec', 6)} AS precision, {O.rhe('f1', 6)} AS f1,
  CASE WHEN dr >= 0.95 THEN 'PASS' ELSE 'FAIL' END AS detection_mark,
  CASE WHEN fpr <= 0.05 THEN 'PASS' ELSE 'FAIL' END AS false_positive_mark,
  CASE WHEN prec >= 0.9 THEN 'PASS' ELSE 'FAIL' END AS precision_mark,
  CASE WHEN f1 >= 0.92 THEN 'PASS' ELSE 'FAIL' END AS f1_mark FROM m2"""


register("spec_metrics", W(*ALERTS_PLAIN, LAB, _spec_sql(BIN)))(
    lambda s, sf: E.spec_metrics(E.binary_confusion(_test(s, sf))))


def _report(s, sf):
    return E.classification_report(_split(s, sf), test=F.col("is_test"))


def _report_sql(names={0: "0", 1: "1", 2: "2"}, present: str = "lab") -> str:
    per = []
    for c, name in names.items():
        per.append(f"""
  SELECT '{name}' AS class, CASE WHEN pp{c} > 0 THEN tp{c} / pp{c} ELSE 0.0 END AS p,
    CASE WHEN s{c} > 0 THEN tp{c} / s{c} ELSE 0.0 END AS r, s{c} AS support, {c} AS o FROM agg""")
    cnt = ", ".join(f"count(*) FILTER (WHERE label = {c} AND prediction = {c}) AS tp{c}, "
                    f"count(*) FILTER (WHERE prediction = {c}) AS pp{c}, count(*) FILTER (WHERE label = {c}) AS s{c}"
                    for c in names)

    def term(c, field, weighted=False):
        w = f" * support" if weighted else ""
        return f"coalesce((SELECT {field}{w} FROM pcf WHERE o = {c}), 0.0)"

    def tsum(field, weighted=False):
        return "(" + " + ".join(term(c, field, weighted) for c in names) + ")"

    fmt = dict(psum_p=tsum("p"), psum_r=tsum("r"), psum_f=tsum("f"),
               wsum_p=tsum("p", True), wsum_r=tsum("r", True), wsum_f=tsum("f", True))
    return f"""
agg AS (SELECT count(*) AS n, count(*) FILTER (WHERE label = prediction) AS correct, {cnt} FROM test),
pc AS ({' UNION ALL '.join(per)}),
pcf AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM pc
        WHERE o IN (SELECT DISTINCT label FROM {present})),
g AS (SELECT * FROM pcf),
cp AS (SELECT {fmt['psum_p']} AS sp, {fmt['psum_r']} AS sr, {fmt['psum_f']} AS sf, {fmt['wsum_p']} AS wp, {fmt['wsum_r']} AS wr, {fmt['wsum_f']} AS wf,
          (SELECT count(*) FROM pcf) AS k FROM (SELECT 1) one),
rows AS (
  SELECT class, p, r, f, support FROM pcf
  UNION ALL SELECT 'accuracy', NULL, NULL, CASE WHEN n > 0 THEN correct / n ELSE 0.0 END, n FROM agg
  UNION ALL SELECT 'macro avg', sp / k, sr / k, sf / k, n FROM agg, cp
  UNION ALL SELECT 'weighted avg', wp / n, wr / n, wf / n, n FROM agg, cp)
SELECT class, {O.rhe('p', 6)} AS precision, {O.rhe('r', 6)} AS recall, {O.rhe('f', 6)} AS f1_score,
  cast(support AS bigint) AS support FROM rows"""


register("classification_report", W(*ALERTS_PLAIN, LAB, _report_sql()))(_report)

# ---------------------------------------------------------------------------
# labelled benchmark (C22-C24, G10): flows exported under benchmark headers
# ---------------------------------------------------------------------------

REVERSE = {v: k for k, v in C.BENCHMARK_ALIASES.items()}
BENCH_LABEL = "CASE label WHEN 0 THEN 'BENIGN' WHEN 1 THEN 'PortScan' ELSE 'DoS Hulk' END"


def _benchmark_csv_frame(s, sf):
    lab = _labelled(s, sf)
    cols = [F.col(c).alias(REVERSE.get(c, c)) for c in C.FEATURE_COLS if c in REVERSE]
    return lab.select("window_id", "src_ip", *cols, F.expr(BENCH_LABEL).alias("Label"))


def _bench_eval(s, sf):
    norm = E.normalize_benchmark(_benchmark_csv_frame(s, sf))
    return norm.select("window_id", "src_ip", E.binary_truth("Label").alias("truth"),
                       (E.threat_class_from_rules() > 0).cast("int").alias("predicted"))


BENCH = f"""
bench AS (SELECT window_id, src_ip, total_packets, total_bytes, flow_duration_sec, packets_per_second,
  bytes_per_second, avg_packet_size, packet_size_std, iat_mean, iat_std, total_syn_flags, total_ack_flags,
  total_fin_flags, total_rst_flags, 0.0 AS unique_target_ips, 0.0 AS unique_target_ports, 0.0 AS avg_ttl,
  0.0 AS avg_window_size, 0.0 AS syn_ack_ratio, {BENCH_LABEL} AS "Label" FROM lab)"""

register("binary_truth", W(*ALERTS_PLAIN, LAB, BENCH) + """
SELECT window_id, src_ip, CAST(upper(coalesce("Label", 'nan')) <> 'BENIGN' AS int) AS truth FROM bench""")(
    lambda s, sf: E.normalize_benchmark(_benchmark_csv_frame(s, sf))
    .select("window_id", "src_ip", E.binary_truth("Label").alias("truth")))

register("benchmark_eval", W(*ALERTS_PLAIN, LAB, BENCH) + f"""
SELECT window_id, src_ip, CAST(upper(coalesce("Label", 'nan')) <> 'BENIGN' AS int) AS truth,
  CAST(({O.RULE_THREAT}) <> 'Baseline (Safe)' AS int) AS predicted FROM bench""")(_bench_eval)

# the same rows' metrics with marks, and the two-class report
BENCH_PAIR = f"""
test AS (SELECT CAST(upper(coalesce("Label", 'nan')) <> 'BENIGN' AS int) AS label,
  CAST(({O.RULE_THREAT}) <> 'Baseline (Safe)' AS int) AS prediction FROM bench)"""
BENCH_NAMES = {0: "Benign", 1: "Attack"}


def _bench_pair(s, sf):
    return _bench_eval(s, sf).select(F.col("truth").alias("label"), F.col("predicted").alias("prediction"))


register("benchmark_spec_metrics", W(*ALERTS_PLAIN, LAB.rsplit("test AS", 1)[0].rstrip().rstrip(","), BENCH, BENCH_PAIR, _spec_sql(BIN)))(
    lambda s, sf: E.spec_metrics(E.binary_confusion(_bench_pair(s, sf))))

register("benchmark_report", W(*ALERTS_PLAIN, LAB.rsplit("test AS", 1)[0].rstrip().rstrip(","), BENCH, BENCH_PAIR,
                               _report_sql(BENCH_NAMES, "test")))(
    lambda s, sf: E.classification_report(_bench_pair(s, sf), classes=(0, 1), names=BENCH_NAMES))

# ---------------------------------------------------------------------------
# model-dependent (rows-only checks)
# ---------------------------------------------------------------------------

_MODELS: dict = {}


def _training(s, sf):
    """Labelled flows materialised once (checkpoint), split, and the fitted forest."""
    key = (s.sparkContext.applicationId, sf)
    if key not in _MODELS:
        lab = _labelled(s, sf).checkpoint(eager=True)
        sp = ml.train_test_split(lab, KEYS)
        train = sp.filter("NOT is_test").drop("prediction", "is_test").cache()
        scaler = ml.fit_scaler(lab)                # fitted before the split, as the original (Q15)
        model = ml.fit_forest(train, scaler)
        train.unpersist()
        _MODELS[key] = (model, sp)
    return _MODELS[key]


def trained_model(s, sf):
    return _training(s, sf)[0]


def _rf_predictions(s, sf):
    model, sp = _training(s, sf)
    test = sp.filter("is_test").drop("prediction", "is_test")
    return ml.predict(model, test).select("window_id", "src_ip", "label", "prediction")


register("rf_predictions")(_rf_predictions)
register("ml_scored_flows")(lambda s, sf: ml.predict(trained_model(s, sf), flow_features(_pk(s, sf)))
                            .select("window_id", "src_ip", "prediction", "model_confidence"))
register("feature_importance")(lambda s, sf: ml.feature_importance(trained_model(s, sf)))
register("kmeans_clusters")(lambda s, sf: ml.fit_kmeans(flow_features(_pk(s, sf)))[1]
                            .select("window_id", "src_ip", "cluster"))
register("alerts_ml")(lambda s, sf: to_alerts(detect(
    __import__("flowwatch.sources.packets", fromlist=["x"]).packets_from_events(s, sf),
    _detector(s, lists=True, model=trained_model(s, sf)))))



def _bench_eval_rf(s, sf):
    """G10 with the trained forest: aliased benchmark rows -> scale -> predict -> collapse."""
    norm = E.normalize_benchmark(_benchmark_csv_frame(s, sf))
    pred = ml.predict(trained_model(s, sf), norm)
    return pred.select("window_id", "src_ip", E.binary_truth("Label").alias("truth"),
                       (F.col("prediction") > 0).cast("int").alias("predicted"))


register("benchmark_eval_rf")(_bench_eval_rf)


def _rf_holdout(s, sf):
    model, sp = _training(s, sf)
    return ml.predict(model, sp.filter("is_test").drop("prediction", "is_test")), sp


register("rf_spec_metrics")(lambda s, sf: E.spec_metrics(E.binary_confusion(_rf_holdout(s, sf)[0])))


def _rf_report(s, sf):
    """D14 of the forest's held-out predictions; the classes are those of all labelled flows."""
    held, sp = _rf_holdout(s, sf)
    every = held.select("label", "prediction", F.lit(True).alias("evaluated")).unionByName(
        sp.select("label", F.lit(None).cast("double").alias("prediction"), F.lit(False).alias("evaluated")))
    return E.classification_report(every, test=F.col("evaluated"))


register("rf_classification_report")(_rf_report)


STORED_COLS = ["window_id", "src_ip", "label", "prediction"]


def _stored_predictions(s, sf):
    """Predictions written once with a stable table, and all metrics from the stored rows: counts, report
    and marks agree with one another."""
    import os
    import uuid
    from flowwatch.session import ensure_checkpoint_dir
    path = os.path.join(ensure_checkpoint_dir(s), f"predictions-{uuid.uuid4().hex}")
    lab = _test(s, sf)
    lab.select(*STORED_COLS).write.partitionBy("label").parquet(path)
    rows = s.read.schema("window_id bigint, src_ip string, label int, prediction int").parquet(path)
    conf = E.spec_metrics(E.binary_confusion(rows))
    report = E.classification_report(rows, names={0: "0", 1: "1", 2: "2"})
    acc = report.filter("class = 'accuracy'").select(F.col("f1_score").alias("accuracy"), F.col("support").alias("rows")).select(F.struct("*").alias("a")).scalar()
    return conf.select("*", acc.alias("_a")).select("tp", "fn", "fp", "tn", "detection_rate", "precision", "f1",
                                                    F.col("_a.accuracy").alias("accuracy"), F.col("_a.rows").alias("rows"))


register("stored_prediction_metrics", W(*ALERTS_PLAIN, LAB) + """
SELECT tp, fn, fp, tn, """ + ", ".join(O.rhe(x, 6) + f" AS {n}" for x, n in (
    ("CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END", "detection_rate"), ("CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END", "precision"),
    ("CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END", "f1"), ("correct / n", "accuracy"))) + """, n AS "rows"
FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM (
  SELECT count(*) FILTER (WHERE label > 0 AND prediction > 0) AS tp, count(*) FILTER (WHERE label > 0 AND prediction = 0) AS fn,
    count(*) FILTER (WHERE label = 0 AND prediction > 0) AS fp, count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
    count(*) FILTER (WHERE label = prediction) AS correct, count(*) AS n FROM test))""")(_stored_predictions)
