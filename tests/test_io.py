"""Sinks and table sources."""

import os

from pyspark.sql import functions as F

from flowwatch import config as C
from flowwatch.operators.clean import clean_packets
from flowwatch.operators.flows import assign_windows, flow_features, protocol_breakdown
from flowwatch.operators import ml
from flowwatch.operators.profile import column_profile
from flowwatch.plans.pipeline import Detector, alerts
from flowwatch.sinks.writers import (
    append_table, export_csv, load_detector_model, write_clean_packets, write_flow_features,
)
from flowwatch.sources.packets import packets_from_events
from flowwatch.sources.tables import read_alert_log, read_flow_table, read_protocol_table

from conftest import SF001


def test_packets_and_flows_roundtrip(spark, tmp):
    clean = clean_packets(packets_from_events(spark, SF001))
    write_clean_packets(clean, os.path.join(tmp, "pk"))
    back = spark.read.parquet(os.path.join(tmp, "pk"))
    assert back.count() == clean.count() and "dt" in back.columns
    flows = flow_features(assign_windows(clean))
    write_flow_features(flows, os.path.join(tmp, "flows"), fmt="csv")
    f2 = read_flow_table(spark, os.path.join(tmp, "flows"), fmt="csv")
    assert f2.count() == flows.count() and "first_packet_us" not in f2.columns


def test_alert_log_migration_and_idempotent_append(spark, tmp):
    a = alerts(packets_from_events(spark, SF001))
    old = a.drop("confidence")
    path = os.path.join(tmp, "alerts")
    append_table(old, path, batch_id=0)
    append_table(a, path, batch_id=1)
    append_table(a, path, batch_id=1)                    # retried batch: no duplicates
    log = read_alert_log(spark, path)
    assert log.count() == 2 * a.count()
    assert log.filter(F.col("confidence").isNull()).count() == 0
    export_csv(log.limit(10), os.path.join(tmp, "export"))
    assert spark.read.option("header", True).csv(os.path.join(tmp, "export")).count() == 10


def test_protocol_filter_is_pushed_down(spark, tmp):
    pk = assign_windows(clean_packets(packets_from_events(spark, SF001)))
    protocol_breakdown(pk).write.parquet(os.path.join(tmp, "proto"))
    df = read_protocol_table(spark, os.path.join(tmp, "proto"), "10.0.0.3")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(src_ip), EqualTo(src_ip,10.0.0.3)]" in plan
    assert df.count() > 0


def test_model_roundtrip_and_fallback(spark, tmp):
    flows = ml.with_weak_label(flow_features(assign_windows(clean_packets(packets_from_events(spark, SF001)))))
    scaler = ml.fit_scaler(flows)
    model = ml.fit_forest(flows, scaler, num_trees=5, max_depth=5)
    path = os.path.join(tmp, "rf")
    model.save(path)
    loaded, supervised = load_detector_model(path, None)
    assert supervised
    a = [r.prediction for r in ml.predict(model, flows).orderBy("window_id", "src_ip").collect()]
    b = [r.prediction for r in ml.predict(loaded, flows).orderBy("window_id", "src_ip").collect()]
    assert a == b
    assert load_detector_model(os.path.join(tmp, "none"), None) == (None, False)
    # the fallback keeps its scaler, and a detector with it scores by rules with confidence 0
    clusters, flagged = ml.fit_kmeans(flows, restarts=2)
    clusters.save("file:" + os.path.join(tmp, "km"))
    fallback, supervised = load_detector_model(os.path.join(tmp, "none"), "file:" + os.path.join(tmp, "km"))
    assert not supervised and fallback.scaler == clusters.scaler
    key = ["window_id", "src_ip", "cluster"]
    assert sorted(map(tuple, fallback.clusters(flows).select(*key).collect())) == sorted(map(tuple, flagged.select(*key).collect()))
    raw = packets_from_events(spark, SF001)
    assert sorted(map(tuple, alerts(raw, Detector(model=fallback)).collect())) == sorted(map(tuple, alerts(raw).collect()))
    assert alerts(raw, Detector(model=loaded)).filter("confidence > 0").count() > 0


def test_column_profile(spark):
    prof = column_profile(packets_from_events(spark, SF001)).collect()
    assert sorted(r.column for r in prof) == ["ack", "fin", "rst", "syn"]
    syn = [r for r in prof if r.column == "syn"][0]
    assert len(syn.first_values) == 20 and 1 <= len(syn.distinct_values) <= 15


def test_scaler_population_std(spark):
    df = spark.createDataFrame([(float(i),) * len(C.FEATURE_COLS) for i in (1, 2, 3)],
                               ", ".join(f"{c} double" for c in C.FEATURE_COLS))
    s = ml.fit_scaler(df)
    mean, std = s["total_packets"]
    assert mean == 2.0 and abs(std - (2 / 3) ** 0.5) < 1e-12


def test_benchmark_csv_and_latency(spark, tmp):
    from flowwatch.operators import evaluate as E
    from flowwatch.sources.tables import read_benchmark_csv
    p = os.path.join(tmp, "bench.csv")
    with open(p, "w") as f:
        f.write(" Flow Duration,Total Fwd Packets,Flow Packets/s,SYN Flag Count,Label\n")
        f.write("1.5,10,2000,5,BENIGN\n2,20,Infinity,1,DoS Hulk\n3,30,5,0,benign\n4,1,1,0,\n")
    df = read_benchmark_csv(spark, p)
    rows = df.orderBy("flow_duration_sec").collect()
    assert [r.total_packets for r in rows] == [10.0, 20.0, 30.0, 1.0]
    assert rows[1].packets_per_second == 0.0 and rows[0].unique_target_ports == 0.0
    truth = [r[0] for r in df.orderBy("flow_duration_sec").select(E.binary_truth("Label")).collect()]
    assert truth == [0, 1, 0, 1]
    flows = ml.with_weak_label(df)
    assert E.decision_latency_ms(flows) >= 0.0
