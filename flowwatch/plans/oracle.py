"""DuckDB reference SQL for the correctness gate.

Each query in :mod:`flowwatch.plans.catalog` has an independent, brute-force
SQL formulation here (plain window ``lag`` over whole groups, recursive CTE
for the throttle, ...).  The pieces below are CTEs that the catalog chains.
"""

from __future__ import annotations

from flowwatch import config as C

NUM_RE = C.NUMERIC_PATTERN.strip("^$")


def num(x: str) -> str:
    t = f"trim(split_part(cast({x} AS varchar), ',', 1))"
    return f"coalesce(CASE WHEN regexp_full_match({t}, '{NUM_RE}') THEN try_cast({t} AS double) END, 0)"


def flag(x: str) -> str:
    t = f"trim(split_part(cast({x} AS varchar), ',', 1))"
    return f"(CASE WHEN {t} IN ('True', 'true') THEN 1.0 ELSE {num(t)} END)"


def port(tcp: str, udp: str) -> str:
    p = f"coalesce(cast({tcp} AS varchar), cast({udp} AS varchar))"
    return (f"(CASE WHEN {p} IS NULL THEN '0' "
            f"WHEN regexp_full_match(trim({p}), '[0-9]+([.]0*)?') "
            f"THEN cast(try_cast(regexp_extract(trim({p}), '^([0-9]+)', 1) AS bigint) AS varchar) "
            f"ELSE {p} END)")


def blank(x: str) -> str:
    return f"(coalesce(trim({x}), '') IN ('', 'nan', 'NaN'))"


def rhe(x: str, d: int) -> str:
    s = float(10 ** d)
    return f"(round_even(cast({x} AS double) * {s}, 0) / {s})"


def clock(us: str) -> str:
    sod = f"(({us}) // 1000000 % 86400)"
    return (f"concat_ws(':', lpad(cast({sod} // 3600 AS varchar), 2, '0'), "
            f"lpad(cast({sod} % 3600 // 60 AS varchar), 2, '0'), lpad(cast({sod} % 60 AS varchar), 2, '0'))")


PACKETS = """
e AS (
  SELECT event_id, event_type, value, user_id, user_id % 16 AS c,
         cast(json_extract_string(props, '$.k') AS bigint) AS k,
         date_diff('microsecond', TIMESTAMP '2024-01-01', ts) AS us
  FROM events),
x AS (SELECT *, (c IN (0,1,2,4,5) OR event_type IN ('click','view','purchase')) AS is_tcp FROM e),
packets AS (
  SELECT event_id AS frame_no,
    CASE event_id % 997 WHEN 5 THEN 0 WHEN 6 THEN -1000000 ELSE 1704067200000000 + us // CASE c WHEN 0 THEN 4194304 WHEN 1 THEN 8388608 WHEN 2 THEN 131072
         WHEN 3 THEN 2097152 WHEN 4 THEN 65536 WHEN 6 THEN 262144 WHEN 10 THEN 8192 ELSE 16384 END END AS ts_us,
    CASE WHEN event_id % 101 = 0 THEN '' WHEN event_id % 103 = 0 THEN 'nan'
         WHEN event_id % 109 = 0 THEN '   '
         WHEN c > 10 THEN concat('10.1.', cast(user_id // 256 % 256 AS varchar), '.', cast(user_id % 256 AS varchar))
         ELSE concat('10.0.0.', cast(c + 1 AS varchar)) END AS src_ip,
    CASE WHEN event_id % 89 = 0 THEN NULL
         ELSE concat('192.168.', cast(k % 4 AS varchar), '.', cast(event_id % 8 AS varchar)) END AS dst_ip,
    CASE WHEN is_tcp THEN concat(cast(1024 + event_id % 50000 AS varchar), if(event_id % 67 = 0, ',443', '')) END AS tcp_src,
    CASE WHEN NOT is_tcp AND event_id % 17 <> 0 THEN concat(cast(1024 + event_id % 40000 AS varchar), if(event_id % 5 = 0, '.0', '')) END AS udp_src,
    CASE WHEN is_tcp THEN CASE WHEN c IN (2,5) THEN 1 + event_id % 1024 WHEN c = 4 THEN 22
         WHEN k % 2 = 0 THEN 80 ELSE 443 END END AS tcp_dst,
    CASE WHEN NOT is_tcp AND event_id % 13 <> 0 THEN
         CASE WHEN event_type = 'signup' OR c = 6 THEN 53 ELSE 5000 + k % 3 END END AS udp_dst,
    CASE WHEN event_id % 107 = 0 THEN '' WHEN c = 6 THEN 'DNS' WHEN c = 3 THEN 'HTTP'
         WHEN c IN (0,1,2,4,5) THEN 'TCP' WHEN event_type = 'click' THEN 'TCP'
         WHEN event_type = 'view' THEN 'HTTP' WHEN event_type = 'purchase' THEN 'TLSv1.2'
         WHEN event_type = 'signup' THEN 'DNS' ELSE 'UDP' END AS protocol,
    CASE WHEN c = 10 THEN 60 + k % 64 WHEN c = 3 THEN 900 + k
         ELSE 60 + cast(floor(value * 4) AS bigint) % 1441 END AS frame_len,
    CASE WHEN c IN (0,2,4,5) THEN 'True' WHEN event_id % 4 = 0 THEN '1'
         WHEN event_id % 53 = 0 THEN 'True,False' ELSE 'False' END AS syn,
    CASE WHEN c IN (0,2) THEN 'False' WHEN event_id % 4 <> 0 THEN '1'
         WHEN event_id % 59 = 0 THEN NULL ELSE '0' END AS ack,
    CASE WHEN event_id % 31 = 0 THEN 'true' ELSE 'false' END AS fin,
    CASE WHEN event_id % 37 = 0 THEN '1' ELSE '0' END AS rst,
    CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 71 = 0 THEN '64,63'
         ELSE cast(64 + k % 64 AS varchar) END AS ttl,
    CASE WHEN is_tcp THEN cast(1024 + event_id % 64512 AS varchar) END AS win
  FROM x)"""

CLEAN = f"""
clean AS (
  SELECT frame_no, ts_us, cast(src_ip AS varchar) AS src_ip, cast(dst_ip AS varchar) AS dst_ip,
    cast(protocol AS varchar) AS protocol,
    {port('tcp_src', 'udp_src')} AS src_port, {port('tcp_dst', 'udp_dst')} AS dst_port,
    coalesce(try_cast(trunc({num('frame_len')}) AS bigint), 0) AS frame_len,
    {flag('syn')} AS syn, {flag('ack')} AS ack, {flag('fin')} AS fin, {flag('rst')} AS rst,
    {num('ttl')} AS ttl, {num('win')} AS win
  FROM packets)"""

WINDOWS = """
pk AS (
  SELECT *, (ts_us - t0) // 2000000 AS window_id, ts_us - (ts_us - t0) % 2000000 AS window_start_us
  FROM clean, (SELECT min(ts_us) AS t0 FROM clean WHERE ts_us > 0) o
  WHERE ts_us > 0),
gate AS (SELECT window_id, count(*) AS window_packets FROM pk GROUP BY window_id HAVING count(*) >= 2)"""

VALID = f"""
valid AS (SELECT * FROM pk WHERE NOT {blank('src_ip')} AND window_id IN (SELECT window_id FROM gate))"""


def _flow_agg(keys: str, src: str, part: str) -> str:
    return f"""
  SELECT {keys}, count(*) AS n, cast(sum(frame_len) AS bigint) AS sx,
    sum(cast(frame_len AS hugeint) * frame_len) AS sxx,
    sum(syn) AS syn, sum(ack) AS ack, sum(fin) AS fin, sum(rst) AS rst,
    sum(ttl) AS ttl, sum(win) AS win, min(ts_us) AS lo, max(ts_us) AS hi,
    coalesce(sum(cast(d AS hugeint) * d), 0) AS s2,
    count(*) FILTER (WHERE protocol = 'DNS') AS dns_packets,
    count(DISTINCT dst_ip) AS unique_target_ips, count(DISTINCT dst_port) AS unique_target_ports
  FROM (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY {part} ORDER BY ts_us) AS d FROM {src}) g
  GROUP BY {keys}"""


def _derive(keys: str, src: str) -> str:
    dur = "greatest(cast(hi - lo AS double) / 1e6, 0.1)"
    return f"""
  SELECT {keys}, n AS total_packets, sx AS total_bytes, unique_target_ips, unique_target_ports,
    syn AS total_syn_flags, ack AS total_ack_flags, fin AS total_fin_flags, rst AS total_rst_flags,
    ttl / n AS avg_ttl, win / n AS avg_window_size, {dur} AS flow_duration_sec,
    n / {dur} AS packets_per_second, sx / {dur} AS bytes_per_second, sx / n AS avg_packet_size,
    syn / (ack + 1) AS syn_ack_ratio,
    CASE WHEN n > 1 THEN sqrt(cast(n * sxx - cast(sx AS hugeint) * sx AS double) / cast(n * (n - 1) AS double))
         ELSE 0.0 END AS packet_size_std,
    CASE WHEN n > 1 THEN cast(hi - lo AS double) / (n - 1) / 1e6 ELSE 0.0 END AS iat_mean,
    CASE WHEN n > 1 THEN sqrt(cast((n - 1) * s2 - cast(hi - lo AS hugeint) * (hi - lo) AS double)
         / cast((n - 1) * (n - 1) AS double)) / 1e6 ELSE 0.0 END AS iat_std,
    lo AS first_packet_us, hi AS last_packet_us, dns_packets
  FROM {src}"""


FLOWS = f"""
fagg AS ({_flow_agg('window_id, src_ip', 'valid', 'window_id, src_ip')}),
flows0 AS ({_derive('window_id, src_ip', 'fagg')}),
flows AS (
  SELECT f.*, t0 + window_id * 2000000 AS window_start_us
  FROM flows0 f, (SELECT min(ts_us) AS t0 FROM clean WHERE ts_us > 0) o),
hist AS (
  SELECT *,
    count(*) OVER w AS rolling_windows, sum(total_packets) OVER w AS rolling_packets,
    sum(unique_target_ports) OVER w AS rolling_unique_ports,
    sum(cast(trunc(total_syn_flags) AS bigint)) OVER w AS rolling_syn
  FROM flows
  WINDOW w AS (PARTITION BY src_ip ORDER BY window_id ROWS BETWEEN 14 PRECEDING AND CURRENT ROW))"""

RANK = "(CASE {t} WHEN 'Severe (Critical Anomaly)' THEN 2 WHEN 'Moderate (Suspicious)' THEN 1 " \
       "WHEN 'Moderate (Bandwidth Spike)' THEN 1 ELSE 0 END)"


def rank(t: str) -> str:
    return RANK.format(t=t)


RULE_PROFILE = """CASE WHEN packets_per_second > 500 AND syn_ack_ratio > 5 THEN 'DDoS SYN Flood'
    WHEN packets_per_second > 1000 THEN 'High-Volume Flood Attack'
    WHEN packets_per_second > 300 AND avg_packet_size > 800 THEN 'Speed Test / Large Data Transfer'
    WHEN unique_target_ports > 20 THEN 'Port Scan / Reconnaissance'
    WHEN packets_per_second <= 5 AND avg_packet_size < 150 THEN 'Ping / Background Telemetry'
    ELSE 'Standard Web Traffic' END"""
RULE_THREAT = """CASE WHEN packets_per_second > 500 AND syn_ack_ratio > 5 THEN 'Severe (Critical Anomaly)'
    WHEN packets_per_second > 1000 THEN 'Severe (Critical Anomaly)'
    WHEN packets_per_second > 300 AND avg_packet_size > 800 THEN 'Moderate (Bandwidth Spike)'
    WHEN unique_target_ports > 20 THEN 'Moderate (Suspicious)'
    ELSE 'Baseline (Safe)' END"""
SLOW_PROFILE = """CASE WHEN rolling_windows >= 5 AND rolling_unique_ports > 60 THEN 'Slow Port Scan (multi-window)'
    WHEN rolling_windows >= 5 AND rolling_syn > 150 AND rolling_packets > 200
      THEN 'Sustained SYN / Brute-Force Probe' END"""
WEAK_LABEL = """CASE WHEN packets_per_second > 500 AND syn_ack_ratio > 5 THEN 2
    WHEN packets_per_second > 1000 THEN 2 WHEN unique_target_ports > 20 THEN 1
    WHEN packets_per_second > 300 AND avg_packet_size > 800 THEN 1 ELSE 0 END"""


def lists_cte(intel: list[str], baseline: list[str]) -> str:
    def vals(xs):
        if not xs:
            return "SELECT CAST(NULL AS varchar) AS ip WHERE false"
        return "SELECT * FROM (VALUES " + ", ".join(f"('{x}')" for x in xs) + ") t(ip)"
    return f"""
intel AS ({vals(intel)}),
whitelist AS ({vals(baseline)})"""


def scored(model: str = "rules") -> str:
    """Layers + fusion + precedence over ``hist`` (needs ``intel``/``whitelist``)."""
    model_threat = {
        "rules": "rule_threat",
        "weak_label": "CASE " + f"({WEAK_LABEL})" + " WHEN 2 THEN 'Severe (Critical Anomaly)' "
                      "WHEN 1 THEN 'Moderate (Suspicious)' ELSE 'Baseline (Safe)' END",
    }[model]
    fr = f"greatest({rank('model_threat')}, {rank('rule_threat')}, {rank('slow_threat')}, {rank('dns_threat')})"
    return f"""
layers AS (
  SELECT *, ({RULE_PROFILE}) AS rule_profile, ({RULE_THREAT}) AS rule_threat,
    ({SLOW_PROFILE}) AS slow_profile,
    CASE WHEN ({SLOW_PROFILE}) IS NOT NULL THEN 'Moderate (Suspicious)' ELSE 'Baseline (Safe)' END AS slow_threat,
    CASE WHEN dns_packets / 2.0 > 30 THEN 'DNS Tunnel / C2 Channel' END AS dns_profile,
    CASE WHEN dns_packets / 2.0 > 30 THEN 'Moderate (Suspicious)' ELSE 'Baseline (Safe)' END AS dns_threat,
    src_ip IN (SELECT ip FROM intel) AS intel_hit,
    src_ip IN (SELECT ip FROM whitelist) AS baseline_hit
  FROM hist),
layers2 AS (SELECT *, {model_threat} AS model_threat, 0.0 AS confidence_raw FROM layers),
fused AS (
  SELECT *, CASE WHEN {rank('model_threat')} = {fr} THEN model_threat
                 WHEN {rank('rule_threat')} = {fr} THEN rule_threat
                 WHEN {rank('slow_threat')} = {fr} THEN slow_threat ELSE dns_threat END AS fused_threat
  FROM layers2),
scored AS (
  SELECT *,
    CASE WHEN intel_hit THEN 'Severe (Critical Anomaly)' WHEN baseline_hit THEN 'Baseline (Safe)'
         ELSE fused_threat END AS threat_level,
    CASE WHEN intel_hit THEN 'Known Malicious IP (Threat Intel Match)'
         WHEN baseline_hit THEN 'Whitelisted Source'
         WHEN dns_profile IS NOT NULL THEN dns_profile
         WHEN slow_profile IS NOT NULL AND {rank('slow_threat')} >= {rank('fused_threat')} THEN slow_profile
         ELSE rule_profile END AS traffic_profile
  FROM fused)"""


ALERTS = f"""
alerts AS (
  SELECT window_id, window_start_us, {clock('window_start_us')} AS timestamp, src_ip AS source_ip,
    {rhe('packets_per_second', 2)} AS packets_per_sec, {rhe('avg_window_size', 2)} AS avg_window_size,
    {rhe('syn_ack_ratio', 2)} AS syn_ack_ratio, cast(total_bytes AS bigint) AS total_bytes,
    traffic_profile, threat_level, {rhe('confidence_raw', 4)} AS confidence
  FROM scored)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes) + "\n"


BASE = (PACKETS, CLEAN, WINDOWS, VALID, FLOWS)


def alerts_sql(intel=(), baseline=(), model="rules") -> tuple[str, ...]:
    return (*BASE, lists_cte(list(intel), list(baseline)), scored(model), ALERTS)
