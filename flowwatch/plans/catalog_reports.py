"""Report, notification and learning queries (registered into the catalog)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowwatch import config as C
from flowwatch.functions import clock_text
from flowwatch.operators import notify, reports
from flowwatch.operators.flows import protocol_breakdown
from flowwatch.operators.throttle import greedy_throttle
from flowwatch.plans import oracle as O
from flowwatch.plans.catalog import (
    ALERTS_LISTS, BLOCKED_IPS, W, _ip_df, _pk, _scored, alerts_df, register,
)
from flowwatch.sources.packets import read_table

SEV = ("(CASE WHEN threat_level LIKE '%Severe%' THEN 'Severe' "
       "WHEN threat_level LIKE '%Moderate%' THEN 'Moderate' ELSE 'Baseline' END)")
VIEW = f"""
view AS (
  SELECT window_id, timestamp AS time, source_ip, packets_per_sec, avg_window_size AS avg_window,
    syn_ack_ratio, total_bytes, traffic_profile, threat_level,
    sign(confidence * 100 * 10.0) * floor(abs(confidence * 100 * 10.0) + 0.5) / 10.0 AS confidence_pct
  FROM alerts),
blocked AS (SELECT * FROM (VALUES {", ".join(f"('{b}')" for b in BLOCKED_IPS)}) t(ip))"""
R = W(*ALERTS_LISTS, VIEW)
FILTER_SEVERITIES = ("Severe", "Moderate")


def _view(s, sf):
    return reports.alert_view(alerts_df(s, sf, lists=True))


def _blocked(s):
    return _ip_df(s, BLOCKED_IPS)


register("latest_alerts", R + f"SELECT * FROM view ORDER BY window_id DESC, source_ip DESC LIMIT {C.LATEST_ALERTS}")(
    lambda s, sf: reports.latest_alerts(_view(s, sf)))

register("severity_filter", R + f"SELECT * FROM view WHERE {SEV} IN ('Severe', 'Moderate')")(
    lambda s, sf: reports.severity_filter(_view(s, sf), FILTER_SEVERITIES))

register("alert_page", R + f"""
SELECT * FROM view WHERE {SEV} IN ('Severe', 'Moderate') ORDER BY window_id DESC, source_ip DESC LIMIT 100""")(
    lambda s, sf: reports.alert_page(_view(s, sf), FILTER_SEVERITIES))

register("soc_metrics", R + """
SELECT (SELECT count(*) FROM view) AS total_flows,
       (SELECT count(*) FROM view WHERE threat_level = 'Severe (Critical Anomaly)') AS critical_threats,
       (SELECT count(DISTINCT source_ip) FROM view) AS unique_sources,
       (SELECT count(DISTINCT ip) FROM blocked) AS blocked_ips""")(
    lambda s, sf: reports.soc_metrics(_view(s, sf), _blocked(s)))

register("threat_distribution", R + 'SELECT threat_level, count(*) AS "count" FROM view GROUP BY threat_level')(
    lambda s, sf: reports.threat_distribution(_view(s, sf)))

register("top_talkers", R + """
SELECT source_ip, count(*) AS flows FROM view GROUP BY source_ip ORDER BY flows DESC, source_ip LIMIT 5""")(
    lambda s, sf: reports.top_talkers(_view(s, sf)))

register("distinct_sources", R + "SELECT DISTINCT source_ip FROM view")(
    lambda s, sf: reports.distinct_sources(_view(s, sf)))

register("threat_timeline", R + f"""
SELECT window_id, time,
  count(*) FILTER (WHERE {SEV} = 'Severe') AS "Severe",
  count(*) FILTER (WHERE {SEV} = 'Moderate') AS "Moderate",
  count(*) FILTER (WHERE {SEV} = 'Baseline') AS "Baseline"
FROM view GROUP BY window_id, time""")(
    lambda s, sf: reports.threat_timeline(_view(s, sf)))

register("mitigation_queue", R + """
SELECT source_ip, count(*) AS severe_alerts, concat('IDS_BLOCK_', replace(source_ip, '.', '_')) AS rule_name
FROM view WHERE threat_level = 'Severe (Critical Anomaly)' AND source_ip NOT IN (SELECT ip FROM blocked)
GROUP BY source_ip""")(
    lambda s, sf: reports.mitigation_queue(_view(s, sf), _blocked(s)))

register("mitigation_status", W(*ALERTS_LISTS, VIEW, """
sev AS (SELECT DISTINCT source_ip FROM view WHERE threat_level = 'Severe (Critical Anomaly)')""") + """
SELECT severe_sources, mitigated, severe_sources - mitigated AS awaiting,
  CASE WHEN severe_sources - mitigated > 0 THEN 'awaiting mitigation'
       WHEN severe_sources > 0 THEN 'all mitigated' ELSE 'no critical threats' END AS status
FROM (SELECT (SELECT count(*) FROM sev) AS severe_sources,
             (SELECT count(*) FROM sev WHERE source_ip IN (SELECT ip FROM blocked)) AS mitigated) q""")(
    lambda s, sf: reports.mitigation_status(_view(s, sf), _blocked(s)))

register("window_severity_counts", W(*ALERTS_LISTS) + """
SELECT window_id,
  count(*) FILTER (WHERE threat_level = 'Baseline (Safe)') AS baseline,
  count(*) FILTER (WHERE threat_level = 'Moderate (Suspicious)') AS moderate,
  count(*) FILTER (WHERE threat_level = 'Moderate (Bandwidth Spike)') AS bandwidth,
  count(*) FILTER (WHERE threat_level = 'Severe (Critical Anomaly)') AS severe
FROM alerts GROUP BY window_id""")(
    lambda s, sf: reports.window_severity_counts(alerts_df(s, sf, lists=True)))

PROTO = f"""
proto AS (
  SELECT window_id, src_ip, protocol, count(*) AS packets, cast(sum(frame_len) AS bigint) AS bytes
  FROM pk WHERE NOT {O.blank('src_ip')} AND NOT {O.blank('protocol')}
    AND window_id IN (SELECT window_id FROM gate)
  GROUP BY window_id, src_ip, protocol)"""

register("protocol_mix", W(O.PACKETS, O.CLEAN, O.WINDOWS, PROTO) + """
SELECT src_ip, protocol, cast(sum(packets) AS bigint) AS pkts FROM proto GROUP BY src_ip, protocol""")(
    lambda s, sf: reports.protocol_mix(protocol_breakdown(_pk(s, sf))))

register("replay_summary", W(*ALERTS_LISTS) + """
SELECT (SELECT greatest(1, (max(ts_us) - min(ts_us)) // 2000000 + 1) FROM pk) AS windows_processed,
  count(*) AS flows_scored,
  count(*) FILTER (WHERE threat_level = 'Baseline (Safe)') AS baseline,
  count(*) FILTER (WHERE threat_level IN ('Moderate (Suspicious)', 'Moderate (Bandwidth Spike)')) AS moderate,
  count(*) FILTER (WHERE threat_level = 'Severe (Critical Anomaly)') AS severe
FROM alerts""")(
    lambda s, sf: reports.replay_summary(_pk(s, sf), alerts_df(s, sf, lists=True)))

register("window_progress", W(*ALERTS_LISTS, """
ids AS (SELECT unnest(range(0, (SELECT greatest(1, (max(ts_us) - min(ts_us)) // 2000000 + 1) FROM pk))) AS window_id),
wp AS (SELECT window_id, count(*) AS packets FROM pk GROUP BY window_id),
wf AS (SELECT window_id, count(*) AS flows,
         count(*) FILTER (WHERE threat_level = 'Severe (Critical Anomaly)') AS severe FROM alerts GROUP BY window_id)""") + """
SELECT i.window_id, coalesce(p.packets, 0) AS packets, coalesce(f.flows, 0) AS flows,
  coalesce(f.severe, 0) AS severe, coalesce(p.packets, 0) < 2 AS skipped
FROM ids i LEFT JOIN wp p ON i.window_id = p.window_id LEFT JOIN wf f ON i.window_id = f.window_id""")(
    lambda s, sf: reports.window_progress(s, _pk(s, sf), alerts_df(s, sf, lists=True)))

# ---------------------------------------------------------------------------
# 2.10 notices
# ---------------------------------------------------------------------------

NOTICES = """
notices AS (
  SELECT window_id, window_start_us, src_ip AS source_ip, traffic_profile AS profile, threat_level AS threat,
    packets_per_second AS pps, syn_ack_ratio AS sar, cast(total_bytes AS bigint) AS total_bytes,
    confidence_raw AS confidence
  FROM scored WHERE threat_level = 'Severe (Critical Anomaly)')"""


def _notices(s, sf):
    return notify.notice_records(_scored(s, sf, lists=True))


register("severe_alerts", W(*ALERTS_LISTS, NOTICES) + "SELECT * FROM notices")(_notices)


def _rec_throttle(src: str, key: str, t: str, id_: str, period: int) -> str:
    """Brute-force sequential fold as a recursive CTE (oracle only)."""
    return f"""
thr_in AS (SELECT {key} AS k, {id_} AS i, {t} AS t,
           row_number() OVER (PARTITION BY {key} ORDER BY {t}, {id_}) AS rn FROM {src}),
thr(k, rn, i, t, last_kept, kept) AS (
  SELECT k, rn, i, t, t, true FROM thr_in WHERE rn = 1
  UNION ALL
  SELECT e.k, e.rn, e.i, e.t,
         CASE WHEN e.t - r.last_kept >= {period} THEN e.t ELSE r.last_kept END,
         e.t - r.last_kept >= {period}
  FROM thr r JOIN thr_in e ON e.k = r.k AND e.rn = r.rn + 1)"""


EVENT_NOTICES = """
err AS (SELECT user_id AS notice_key, event_id, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) AS t_us
        FROM events)"""


def _event_throttle(s, sf):
    ev = read_table(s, sf, "events").select(
        F.col("user_id").alias("notice_key"), "event_id",
        F.expr("cast(datediff(to_date(ts), DATE'2024-01-01') AS bigint) * 86400000000 + cast(hour(ts) AS bigint) * 3600000000"
               " + cast(minute(ts) AS bigint) * 60000000 + cast(extract(SECOND FROM ts) * 1000000 AS bigint)").alias("t_us"))
    return greedy_throttle(ev, ["notice_key"], "t_us", "event_id", C.Thresholds().throttle_s * 1_000_000)


register("throttled_notices", "WITH RECURSIVE " + W(EVENT_NOTICES, _rec_throttle(
    "err", "notice_key", "t_us", "event_id", 3600 * 1_000_000))[5:] + """
SELECT k AS notice_key, i AS event_id, t AS t_us FROM thr WHERE kept""")(_event_throttle)

ALERT_THROTTLE = _rec_throttle("notices", "source_ip", "window_start_us", "window_id", 3600 * 1_000_000)


def _alert_throttle(s, sf):
    n = _notices(s, sf)
    return notify.throttle_notices(n).select("window_id", "source_ip", "window_start_us")


register("notice_throttle_alerts", "WITH RECURSIVE " + W(*ALERTS_LISTS, NOTICES, ALERT_THROTTLE)[5:] + """
SELECT i AS window_id, k AS source_ip, t AS window_start_us FROM thr WHERE kept""")(_alert_throttle)

PARITY_CHANNELS = ["email", "discord"]   # email on, discord on, slack off


def _fanout(s, sf):
    n = notify.throttle_notices(_notices(s, sf))
    return notify.fan_out(n, PARITY_CHANNELS).select("window_id", "source_ip", "channel")


register("notice_fanout", "WITH RECURSIVE " + W(*ALERTS_LISTS, NOTICES, ALERT_THROTTLE)[5:] + """
SELECT i AS window_id, k AS source_ip, channel FROM thr, (VALUES ('email'), ('discord')) c(channel) WHERE kept""")(
    _fanout)


def _text(s, sf):
    n = _notices(s, sf).withColumn("timestamp", clock_text(F.col("window_start_us")))
    return notify.with_text(n).select("window_id", "source_ip", "subject", "body")


def _p(x, d):
    return f"printf('%.{d}f', cast({x} AS double))"


TEXTS = f"""
texts AS (
SELECT window_id, source_ip, concat('{C.NOTICE_SUBJECT_PREFIX}', source_ip) AS subject,
  concat('{C.NOTICE_TITLE}', chr(10), '{"=" * len(C.NOTICE_TITLE)}', chr(10),
    'Timestamp      : ', {O.clock('window_start_us')}, chr(10),
    'Source IP      : ', source_ip, chr(10),
    'Traffic Profile: ', profile, chr(10),
    'Threat Level   : ', threat, chr(10),
    'Packets/sec    : ', {_p('pps', 1)}, chr(10),
    'SYN/ACK Ratio  : ', {_p('sar', 2)}, chr(10),
    'Total Bytes    : ', cast(total_bytes AS varchar), chr(10),
    'Confidence     : ', {_p('confidence * 100', 1)}, '%', chr(10)) AS body
FROM notices)"""
register("notice_text", W(*ALERTS_LISTS, NOTICES, TEXTS) + "SELECT * FROM texts")(_text)


OUTBOX_CFG = {"email": {"enabled": True, "from_addr": "ids@example.org", "to_addrs": ["soc@example.org", "duty@example.org"]},
              "discord": {"enabled": True}, "slack": {"enabled": True}}


def _outbox(s, sf):
    return notify.outbox(_scored(s, sf, lists=True), OUTBOX_CFG).select("window_id", "source_ip", "channel", "payload")


register("notice_outbox", "WITH RECURSIVE " + W(*ALERTS_LISTS, NOTICES, TEXTS, ALERT_THROTTLE)[5:] + f"""
SELECT i AS window_id, k AS source_ip, channel, cast(CASE channel
  WHEN 'email' THEN json_object('From', '{OUTBOX_CFG["email"]["from_addr"]}', 'To', '{", ".join(OUTBOX_CFG["email"]["to_addrs"])}',
    'Subject', subject, 'body', body)
  WHEN 'discord' THEN json_object('username', '{C.NOTICE_SENDER}', 'embeds', json_array(json_object('title', subject,
    'description', concat('```', chr(10), body, chr(10), '```'), 'color', {C.NOTICE_COLOR})))
  ELSE json_object('text', concat('*', subject, '*', chr(10), '```', chr(10), body, chr(10), '```')) END AS varchar) AS payload
FROM thr JOIN texts ON i = window_id AND k = source_ip, (VALUES {", ".join(f"('{c}')" for c in C.CHANNELS)}) c(channel)
WHERE kept""")(_outbox)
