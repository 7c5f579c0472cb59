"""Query catalog: every inventory operator as ``(spark, sf_dir) -> DataFrame``.

Each entry has a DuckDB counterpart in :func:`oracle_sql` (same column names)
unless the operator is not SQL-expressible (model fitting), in which case the
driver records a rows-only check.  All queries read the driver tables (the
packet view is derived from ``events``), so their work grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwatch import config as C
from flowwatch.operators.clean import clean_packets, drop_unaddressed, valid_sources
from flowwatch.operators.flows import (
    assign_windows, flow_features, flow_features_approx, flow_features_global, gated_windows, iat_stats,
    protocol_breakdown, sketch_error, window_packet_counts,
)
from flowwatch.plans import oracle as O
from flowwatch.plans.pipeline import Detector, detect, flows_with_history, to_alerts, windowed_packets
from flowwatch.sources.packets import packets_from_events, read_table

# Parity fixtures (FIXTURES.md): list contents used by the list queries.
INTEL_IPS = ["10.0.0.9", "10.0.0.10"]
BASELINE_IPS = ["10.0.0.1", "10.0.0.8", "10.0.0.10"]
BLOCKED_IPS = ["10.0.0.2"]

Query = Callable[[SparkSession, str], DataFrame]
_Q: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        _Q[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return deco


def _raw(spark, sf):
    return packets_from_events(spark, sf)


def _clean(spark, sf):
    return clean_packets(_raw(spark, sf))


def _pk(spark, sf):
    return windowed_packets(_raw(spark, sf))


def _ip_df(spark, ips):
    return spark.createDataFrame([(i,) for i in ips], "ip string")


def _detector(spark, lists: bool = False, model=None) -> Detector:
    if not lists:
        return Detector(model=model)
    return Detector(intel=_ip_df(spark, INTEL_IPS), baseline=_ip_df(spark, BASELINE_IPS), model=model)


def _scored(spark, sf, lists=False, model=None):
    return detect(_raw(spark, sf), _detector(spark, lists, model))


def alerts_df(spark, sf, lists=False, model=None):
    return to_alerts(_scored(spark, sf, lists, model))


W = O.with_
BASE = O.BASE
CLEAN_CTES = (O.PACKETS, O.CLEAN)
LISTS = O.lists_cte(INTEL_IPS, BASELINE_IPS)
NOLISTS = O.lists_cte([], [])
ALERTS_PLAIN = O.alerts_sql()
ALERTS_LISTS = O.alerts_sql(INTEL_IPS, BASELINE_IPS)

# ---------------------------------------------------------------------------
# 2.3 projections / scalar functions
# ---------------------------------------------------------------------------

register("first_value_of_multi", W(O.PACKETS) + """
SELECT frame_no, split_part(cast(syn AS varchar), ',', 1) AS syn_first,
       split_part(cast(ttl AS varchar), ',', 1) AS ttl_first FROM packets""")(
    lambda s, sf: _raw(s, sf).select(
        "frame_no",
        F.split_part(F.col("syn").cast("string"), F.lit(","), F.lit(1)).alias("syn_first"),
        F.split_part(F.col("ttl").cast("string"), F.lit(","), F.lit(1)).alias("ttl_first")))

register("coerce_numeric", W(O.PACKETS) + f"""
SELECT frame_no, {O.num('ttl')} AS ttl, {O.num('win')} AS win, {O.num('frame_len')} AS frame_len,
       {O.num('syn')} AS syn_strict FROM packets""")(
    lambda s, sf: (lambda r: r.select(
        "frame_no", coerce_numeric("ttl").alias("ttl"), coerce_numeric("win").alias("win"),
        coerce_numeric("frame_len").alias("frame_len"), coerce_numeric("syn").alias("syn_strict")))(_raw(s, sf)))

register("clean_flags", W(*CLEAN_CTES) + "SELECT frame_no, syn, ack, fin, rst FROM clean")(
    lambda s, sf: _clean(s, sf).select("frame_no", "syn", "ack", "fin", "rst"))

register("dest_port", W(*CLEAN_CTES) + "SELECT frame_no, dst_port FROM clean")(
    lambda s, sf: _clean(s, sf).select("frame_no", "dst_port"))

register("source_port", W(*CLEAN_CTES) + "SELECT frame_no, src_port FROM clean")(
    lambda s, sf: _clean(s, sf).select("frame_no", "src_port"))

register("clean_packets", W(*CLEAN_CTES) + "SELECT * FROM clean")(
    lambda s, sf: _clean(s, sf))

register("drop_unaddressed", W(*CLEAN_CTES) + f"""
SELECT * FROM clean WHERE NOT {O.blank('src_ip')} AND NOT {O.blank('dst_ip')}""")(
    lambda s, sf: drop_unaddressed(_clean(s, sf)))

register("valid_sources", W(*CLEAN_CTES) + f"SELECT * FROM clean WHERE NOT {O.blank('src_ip')}")(
    lambda s, sf: valid_sources(_clean(s, sf)))

# ---------------------------------------------------------------------------
# 2.5 windows / 2.4 flow aggregates
# ---------------------------------------------------------------------------

register("tumbling_windows", W(*CLEAN_CTES, O.WINDOWS) + """
SELECT frame_no, ts_us, window_id, window_start_us FROM pk""")(
    lambda s, sf: _pk(s, sf).select("frame_no", "ts_us", "window_id", "window_start_us"))

register("window_gate", W(*CLEAN_CTES, O.WINDOWS) + """
SELECT window_id, count(*) AS window_packets, count(*) >= 2 AS passes FROM pk GROUP BY window_id""")(
    lambda s, sf: window_packet_counts(_pk(s, sf)).withColumn("passes", F.col("window_packets") >= 2))

FLOW_COLS = ", ".join(["window_id", "src_ip"] + C.FEATURE_COLS + ["dns_packets", "window_start_us"])
register("flow_features", W(*BASE) + f"SELECT {FLOW_COLS} FROM flows")(
    lambda s, sf: flow_features(_pk(s, sf)).select(*FLOW_COLS.split(", ")))

def _approx(s, sf):
    """D2, approximate: each flow's estimates within the error that the sketch's size gives, all else exact."""
    pk = _pk(s, sf)
    a, b = (f.select(*FLOW_COLS.split(", ")) for f in (flow_features_approx(pk), flow_features(pk)))
    targets = ["unique_target_ips", "unique_target_ports"]
    b = b.select("window_id", "src_ip", *[F.col(c).alias(f"exact_{c}") for c in targets])
    close = [(F.abs(F.col(c) - F.col(f"exact_{c}")) <= sketch_error(12) * F.col(f"exact_{c}")).alias(f"{c}_close") for c in targets]
    return a.join(b, ["window_id", "src_ip"]).select(*[c for c in a.columns if c not in targets], *[f"exact_{c}" for c in targets], *close)


register("flow_features_approx", W(*BASE) + "SELECT " + ", ".join(c for c in FLOW_COLS.split(", ") if not c.startswith("unique_"))
         + """, unique_target_ips AS exact_unique_target_ips, unique_target_ports AS exact_unique_target_ports,
true AS unique_target_ips_close, true AS unique_target_ports_close FROM flows""")(_approx)

register("flow_rates", W(*BASE) + """
SELECT window_id, src_ip, flow_duration_sec, packets_per_second, bytes_per_second, avg_packet_size,
       syn_ack_ratio FROM flows""")(
    lambda s, sf: flow_features(_pk(s, sf)).select(
        "window_id", "src_ip", "flow_duration_sec", "packets_per_second", "bytes_per_second",
        "avg_packet_size", "syn_ack_ratio"))

GLOBAL_COLS = ", ".join(["src_ip"] + C.FEATURE_COLS)
register("flow_features_batch", W(*CLEAN_CTES, f"""
bvalid AS (SELECT * FROM clean WHERE NOT {O.blank('src_ip')} AND NOT {O.blank('dst_ip')})""",
    "bagg AS (" + O._flow_agg("src_ip", "bvalid", "src_ip") + ")",
    "bflows AS (" + O._derive("src_ip", "bagg") + ")") + f"SELECT {GLOBAL_COLS} FROM bflows")(
    lambda s, sf: flow_features_global(drop_unaddressed(_clean(s, sf))).select(*GLOBAL_COLS.split(", ")))

IAT_SQL = f"""
ivalid AS (SELECT * FROM pk WHERE NOT {O.blank('src_ip')}),
iagg AS ({O._flow_agg('window_id, src_ip', 'ivalid', 'window_id, src_ip')}),
iat AS (SELECT window_id, src_ip,
    CASE WHEN n > 1 THEN cast(hi - lo AS double) / (n - 1) / 1e6 ELSE 0.0 END AS iat_mean,
    CASE WHEN n > 1 THEN sqrt(cast((n - 1) * s2 - cast(hi - lo AS hugeint) * (hi - lo) AS double)
         / cast((n - 1) * (n - 1) AS double)) / 1e6 ELSE 0.0 END AS iat_std FROM iagg)"""
register("iat_stats", W(*CLEAN_CTES, O.WINDOWS, IAT_SQL) + "SELECT * FROM iat")(
    lambda s, sf: iat_stats(_pk(s, sf)))


def _iat_join(s, sf):
    pk = _pk(s, sf)
    flows = flow_features(pk).select("window_id", "src_ip", "total_packets", "total_bytes")
    return flows.join(iat_stats(pk), ["window_id", "src_ip"], "left")


register("iat_join", W(*BASE, IAT_SQL) + """
SELECT f.window_id, f.src_ip, f.total_packets, f.total_bytes, i.iat_mean, i.iat_std
FROM flows f LEFT JOIN iat i ON f.window_id = i.window_id AND f.src_ip = i.src_ip""")(_iat_join)

register("protocol_breakdown", W(*CLEAN_CTES, O.WINDOWS) + f"""
SELECT window_id, src_ip, protocol, count(*) AS packets, cast(sum(frame_len) AS bigint) AS bytes
FROM pk WHERE NOT {O.blank('src_ip')} AND NOT {O.blank('protocol')}
  AND window_id IN (SELECT window_id FROM gate)
GROUP BY window_id, src_ip, protocol""")(
    lambda s, sf: protocol_breakdown(_pk(s, sf)))

register("rolling_state", W(*BASE) + """
SELECT window_id, src_ip, rolling_windows, rolling_packets, rolling_unique_ports, rolling_syn FROM hist""")(
    lambda s, sf: flows_with_history(_pk(s, sf)).select(
        "window_id", "src_ip", "rolling_windows", "rolling_packets", "rolling_unique_ports", "rolling_syn"))

# ---------------------------------------------------------------------------
# 2.6 detection layers
# ---------------------------------------------------------------------------

register("rule_classify", W(*ALERTS_PLAIN) + """
SELECT window_id, src_ip, rule_profile, rule_threat FROM scored""")(
    lambda s, sf: _scored(s, sf).select("window_id", "src_ip", "rule_profile", "rule_threat"))

register("slow_attack", W(*ALERTS_PLAIN) + """
SELECT window_id, src_ip, rolling_windows, slow_profile, slow_threat FROM scored""")(
    lambda s, sf: _scored(s, sf).select("window_id", "src_ip", "rolling_windows", "slow_profile", "slow_threat"))

register("dns_tunnel", W(*ALERTS_PLAIN) + """
SELECT window_id, src_ip, dns_packets, dns_profile, dns_threat FROM scored""")(
    lambda s, sf: _scored(s, sf).select("window_id", "src_ip", "dns_packets", "dns_profile", "dns_threat"))

register("intel_matches", W(*ALERTS_LISTS) + """
SELECT window_id, src_ip, threat_level, traffic_profile FROM scored WHERE intel_hit""")(
    lambda s, sf: _scored(s, sf, lists=True).filter("intel_hit")
    .select("window_id", "src_ip", "threat_level", "traffic_profile"))

register("baseline_override", W(*ALERTS_LISTS) + """
SELECT window_id, src_ip, fused_threat, threat_level, traffic_profile FROM scored
WHERE baseline_hit AND NOT intel_hit""")(
    lambda s, sf: _scored(s, sf, lists=True).filter("baseline_hit AND NOT intel_hit")
    .select("window_id", "src_ip", "fused_threat", "threat_level", "traffic_profile"))

register("fused_threats", W(*ALERTS_PLAIN) + """
SELECT window_id, src_ip, model_threat, rule_threat, slow_threat, dns_threat, fused_threat FROM scored""")(
    lambda s, sf: _scored(s, sf).select(
        "window_id", "src_ip", "model_threat", "rule_threat", "slow_threat", "dns_threat", "fused_threat"))

register("alerts", W(*ALERTS_PLAIN) + "SELECT * FROM alerts")(
    lambda s, sf: alerts_df(s, sf))

register("alerts_with_lists", W(*ALERTS_LISTS) + "SELECT * FROM alerts")(
    lambda s, sf: alerts_df(s, sf, lists=True))

register("alerts_weak_label", W(*O.alerts_sql(model="weak_label")) + "SELECT * FROM alerts")(
    lambda s, sf: alerts_df(s, sf, model="weak_label"))


from flowwatch.functions import coerce_numeric  # noqa: E402  (used by lambdas above)


def queries() -> dict[str, Query]:
    from flowwatch.plans import catalog_io, catalog_learning, catalog_reports  # noqa: F401  (register more)
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    from flowwatch.plans import catalog_io, catalog_learning, catalog_reports  # noqa: F401
    return dict(_SQL)


# ---------------------------------------------------------------------------
# late additions: C11 scrub, H6 union, D21 profile
# ---------------------------------------------------------------------------

def _scrub_sql(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL OR isnan(cast({c} AS double)) OR abs(cast({c} AS double)) = 'Infinity'::double "
            f"THEN 0.0 ELSE cast({c} AS double) END AS {c}")


def _scrubbed(s, sf):
    from flowwatch.functions import scrub
    f = flow_features(_pk(s, sf))
    return f.select("window_id", "src_ip", *[scrub(c).alias(c) for c in C.FEATURE_COLS])


register("scrub_features", W(*BASE) + "SELECT window_id, src_ip, "
         + ", ".join(_scrub_sql(c) for c in C.FEATURE_COLS) + " FROM flows")(_scrubbed)


def _union(s, sf):
    from flowwatch.sources.packets import union_packets
    raw = _raw(s, sf)
    web = F.col("protocol").isin("HTTP", "TLSv1.2")
    return union_packets(raw.filter(web), raw.filter(~web | F.col("protocol").isNull())).select(
        "frame_no", "ts_us", "src_ip", "dst_ip", "protocol")


register("packet_union", W(O.PACKETS) + """
SELECT frame_no, ts_us, src_ip, dst_ip, protocol FROM packets WHERE protocol IN ('HTTP', 'TLSv1.2')
UNION ALL
SELECT frame_no, ts_us, src_ip, dst_ip, protocol FROM packets WHERE protocol NOT IN ('HTTP', 'TLSv1.2') OR protocol IS NULL""")(
    _union)


def _profile(s, sf):
    from flowwatch.operators.profile import column_profile
    lists = [F.array_join(c, "|").alias(c) for c in ("first_values", "distinct_values")]
    return column_profile(_raw(s, sf)).select("column", "dtype", "rows", *lists)


register("column_profile", W(O.PACKETS) + " UNION ALL ".join(f"""
SELECT '{c}' AS "column", 'string' AS dtype, (SELECT count(*) FROM packets) AS rows,
  (SELECT string_agg(v, '|' ORDER BY frame_no) FROM
     (SELECT {c} AS v, frame_no FROM packets WHERE {c} IS NOT NULL ORDER BY frame_no LIMIT 20) f) AS first_values,
  (SELECT string_agg(coalesce(v, 'nan'), '|' ORDER BY o) FROM
     (SELECT {c} AS v, min(frame_no) AS o FROM packets GROUP BY {c} ORDER BY o LIMIT 15) d) AS distinct_values"""
    for c in ("syn", "ack", "fin", "rst")))(_profile)


# C11 and C17 on values that need them (flow features are never null or infinite)
def _odd_values(s, sf):
    return read_table(s, sf, "events").select("event_id", F.expr("""CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN double('NaN')
        WHEN 2 THEN double('Infinity') WHEN 3 THEN double('-Infinity') ELSE value END""").alias("x"))


def _scrub_values(s, sf):
    from flowwatch.functions import scrub
    return _odd_values(s, sf).select("event_id", scrub("x").alias("x"))


register("scrub_values", """
SELECT event_id, CASE WHEN event_id % 6 < 4 THEN 0.0 ELSE value END AS x FROM events""")(_scrub_values)


def _confidence_pct(s, sf):
    from flowwatch.operators.reports import alert_view
    a = alerts_df(s, sf, lists=True)
    c = F.pmod(F.col("window_id") * 37 + F.col("total_bytes"), F.lit(10001)) / 10000.0
    return alert_view(a.withColumn("confidence", c)).select("window_id", "source_ip", "confidence_pct")


register("confidence_pct", W(*ALERTS_LISTS) + """
SELECT window_id, source_ip, floor((window_id * 37 + total_bytes) % 10001 / 10000.0 * 100 * 10.0 + 0.5) / 10.0 AS confidence_pct
FROM alerts""")(_confidence_pct)


def _protocol_drill_down(s, sf):
    """A7 + D17: the protocol table written, read back for one source, summed."""
    import os
    import uuid

    from flowwatch.operators.reports import protocol_mix
    from flowwatch.session import ensure_checkpoint_dir
    from flowwatch.sinks.writers import write_protocol_breakdown
    from flowwatch.sources.tables import read_protocol_table
    path = os.path.join(ensure_checkpoint_dir(s), f"protocols-{uuid.uuid4().hex}")
    write_protocol_breakdown(protocol_breakdown(_pk(s, sf)), path, 0)
    return protocol_mix(read_protocol_table(s, path, "10.0.0.9"), "10.0.0.9")


register("protocol_drill_down", W(*CLEAN_CTES, O.WINDOWS) + f"""
SELECT protocol, count(*) AS pkts FROM pk
WHERE src_ip = '10.0.0.9' AND NOT {O.blank('protocol')} AND window_id IN (SELECT window_id FROM gate) GROUP BY protocol""")(
    _protocol_drill_down)


def _stored_tables(s, sf):
    """Flows and alerts written and read back; an older alert log without confidence beside them."""
    import os
    import uuid

    from flowwatch.session import ensure_checkpoint_dir
    from flowwatch.sinks.writers import append_table, write_flow_features
    from flowwatch.sources.tables import read_alert_log, read_flow_table
    root = os.path.join(ensure_checkpoint_dir(s), f"tables-{uuid.uuid4().hex}")
    write_flow_features(flow_features(_pk(s, sf)), os.path.join(root, "flows"))
    flows = read_flow_table(s, os.path.join(root, "flows"))
    a = alerts_df(s, sf, lists=True)
    append_table(a.drop("confidence"), os.path.join(root, "alerts"), 0)
    append_table(a.filter("threat_level <> 'Baseline (Safe)'"), os.path.join(root, "alerts"), 1)
    log = read_alert_log(s, os.path.join(root, "alerts"))
    return flows.groupBy("src_ip").agg(F.count(F.lit(1)).alias("flows"), F.sum("total_packets").cast("bigint").alias("packets")).join(
        log.groupBy(F.col("source_ip").alias("src_ip")).agg(
            F.count(F.lit(1)).alias("logged"), F.max("confidence").alias("confidence")), "src_ip")


register("stored_tables", W(*ALERTS_LISTS) + """
SELECT f.src_ip, flows, packets, logged, confidence FROM
  (SELECT src_ip, count(*) AS flows, cast(sum(total_packets) AS bigint) AS packets FROM flows GROUP BY src_ip) f
  JOIN (SELECT source_ip, count(*) + count(*) FILTER (WHERE threat_level <> 'Baseline (Safe)') AS logged,
          0.0::double AS confidence FROM alerts GROUP BY source_ip) a ON f.src_ip = a.source_ip""")(_stored_tables)
