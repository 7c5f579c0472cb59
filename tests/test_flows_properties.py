"""Plan-independence and oracle-free properties of the flow operators."""

from pyspark.sql import functions as F

from flowwatch import config as C
from flowwatch.operators.flows import assign_windows, flow_features, flow_features_global
from flowwatch.operators.clean import clean_packets, drop_unaddressed
from flowwatch.operators.fusion import fuse
from flowwatch.config import Thresholds
from flowwatch.plans.pipeline import alerts, flows_with_history
from flowwatch.sources.packets import packets_from_events

from conftest import SF001, SF01


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_sub_bucket_and_partitioning_do_not_change_flows(spark):
    raw = packets_from_events(spark, SF001)
    pk = assign_windows(clean_packets(raw))
    a = flow_features(pk)
    b = flow_features(assign_windows(clean_packets(raw.repartition(3, "frame_no"))), sub_us=1_000_000)
    c = flow_features(pk, sub_us=1)
    assert _rows(a) == _rows(b) == _rows(c)


def test_window_ids_partition_packets(spark):
    pk = assign_windows(clean_packets(packets_from_events(spark, SF001)))
    bad = pk.filter((F.col("ts_us") < F.col("window_start_us")) |
                    (F.col("ts_us") >= F.col("window_start_us") + 2_000_000))
    assert bad.count() == 0
    assert pk.agg(F.min("window_id")).first()[0] == 0


def test_global_flows_split_levels_agree(spark):
    clean = drop_unaddressed(clean_packets(packets_from_events(spark, SF001)))
    assert _rows(flow_features_global(clean)) == _rows(flow_features_global(clean, sub_us=7, coarse_subs=3))


def test_fuse_ties_keep_first_argument(spark):
    df = spark.createDataFrame([(C.BANDWIDTH, C.MODERATE), (C.MODERATE, C.BANDWIDTH), (C.BASELINE, C.SEVERE)],
                               "a string, b string")
    got = [r[0] for r in df.select(fuse(F.col("a"), F.col("b"))).collect()]
    assert got == [C.BANDWIDTH, C.MODERATE, C.SEVERE]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_alert_plan_is_jvm_only(spark):
    pk = assign_windows(clean_packets(packets_from_events(spark, SF001)))
    for df in (flow_features(pk), flows_with_history(pk, materialize=False), alerts(packets_from_events(spark, SF001))):
        plan = _plan(df)
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
        # single-partition exchanges only gather one partial aggregate row per task
        lines = plan.splitlines()
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                assert "HashAggregate" in lines[i + 1] and "partial_" in lines[i + 1]
    assert "FileScan parquet" in _plan(flow_features(pk))


def test_flow_plan_holds_no_group_together(spark):
    plan = _plan(flow_features(assign_windows(clean_packets(packets_from_events(spark, SF001)))))
    assert "collect_set" not in plan and "collect_list" not in plan
    for line in plan.splitlines():
        if "Window [" in line:
            assert "_sub" in line or "src_ip" in line


def test_moments_of_a_very_large_source(spark):
    from flowwatch.operators.flows import _derive
    n = 10 ** 10
    m = spark.sql(f"""SELECT 's' AS src_ip, {n}L AS n, {100 * n}L AS sx, cast({20_000 * n} AS decimal(38,0)) AS sxx, 0.0D AS syn,
        0.0D AS ack, 0.0D AS fin, 0.0D AS rst, 0.0D AS ttl, 0.0D AS win, 0L AS lo, {10 * (n - 1)}L AS hi,
        cast({104 * (n - 1)} AS decimal(38,0)) AS s2, 0L AS dns_packets, 1L AS unique_target_ips, 1L AS unique_target_ports""")
    r = _derive(m, ["src_ip"], Thresholds()).first()
    assert abs(r.packet_size_std - 100.0) < 1e-6 and abs(r.iat_mean - 1e-5) < 1e-12 and abs(r.iat_std - 2e-6) < 1e-12


def test_no_nested_loops_and_no_jobs_while_planning(spark):
    import __spark_entry__ as E
    q = E.queries()
    sc = spark.sparkContext
    for name in ("scaled_features", "window_progress", "soc_metrics", "replay_summary", "column_profile", "flow_features"):
        assert "NestedLoop" not in _plan(q[name](spark, SF001)), name
    for name in ("flow_features", "scaled_features", "column_profile", "protocol_breakdown", "iat_join"):
        sc.setJobGroup(name, name)
        q[name](spark, SF001)
        # at most the read of the table's footer
        assert len(sc.statusTracker().getJobIdsForGroup(name)) <= 1, name
    sc.setLocalProperty("spark.jobGroup.id", None)


def test_flows_grow_with_the_table(spark):
    n = [flow_features(assign_windows(clean_packets(packets_from_events(spark, d)))).count() for d in (SF001, SF01)]
    assert n[1] >= 5 * n[0]


def test_rolling_blocks_equal_single_frame(spark):
    from flowwatch.operators.rolling import rolling_state
    from pyspark.sql import Window
    pk = assign_windows(clean_packets(packets_from_events(spark, SF001)))
    flows = flow_features(pk)
    w = Window.partitionBy("src_ip").orderBy("window_id").rowsBetween(-14, 0)
    ref = flows.select("window_id", "src_ip", F.count(F.lit(1)).over(w).alias("a"),
                       F.sum("total_packets").over(w).alias("b"), F.sum("unique_target_ports").over(w).alias("c"),
                       F.sum(F.col("total_syn_flags").cast("bigint")).over(w).alias("d"))
    cols = ["window_id", "src_ip", "rolling_windows", "rolling_packets", "rolling_unique_ports", "rolling_syn"]
    for block in (1, 3, 17, 4096):
        got = rolling_state(flows, block_windows=block).select(*cols)
        assert _rows(got) == _rows(ref), block


def test_window_ids_are_dealt_to_tasks(spark):
    from flowwatch.operators import reports
    size = reports.ID_CHUNK
    for n in (1, size, size + 1, 20 * size + 7):
        # the count is a scalar subquery, as in the report
        count = spark.range(1).select(F.lit(n).cast("bigint").alias("n")).scalar()
        ids = reports.window_ids(spark, count).withColumn("task", F.spark_partition_id()).collect()
        assert sorted(r.window_id for r in ids) == list(range(n))
    assert len({r.task for r in ids}) > 1
    pk = assign_windows(clean_packets(packets_from_events(spark, SF001)))
    plan = _plan(reports.window_progress(spark, pk, alerts(packets_from_events(spark, SF001))))
    assert "REPARTITION_BY_NUM" in plan
