"""Fixed values and tunable thresholds.

Everything that must equal the original detector for identical results is
listed here, in natural order, as plain text.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the original detector exactly)
# ---------------------------------------------------------------------------

# Threat levels and their ranks (ties share a rank).
BASELINE = "Baseline (Safe)"
MODERATE = "Moderate (Suspicious)"
BANDWIDTH = "Moderate (Bandwidth Spike)"
SEVERE = "Severe (Critical Anomaly)"
THREAT_LEVELS = [BASELINE, MODERATE, BANDWIDTH, SEVERE]
SEVERITY_RANK = {BASELINE: 0, MODERATE: 1, BANDWIDTH: 1, SEVERE: 2}
# Classifier class id -> threat level.
CLASS_THREAT = {0: BASELINE, 1: MODERATE, 2: SEVERE}

# Traffic profiles.
P_SYN_FLOOD = "DDoS SYN Flood"
P_FLOOD = "High-Volume Flood Attack"
P_BANDWIDTH = "Speed Test / Large Data Transfer"
P_SCAN = "Port Scan / Reconnaissance"
P_PING = "Ping / Background Telemetry"
P_WEB = "Standard Web Traffic"
P_SLOW_SCAN = "Slow Port Scan (multi-window)"
P_SUSTAINED_SYN = "Sustained SYN / Brute-Force Probe"
P_DNS_TUNNEL = "DNS Tunnel / C2 Channel"
P_INTEL = "Known Malicious IP (Threat Intel Match)"
P_WHITELIST = "Whitelisted Source"

# Dashboard severity buckets (substring of the threat text).
SEVERITY_BUCKETS = ["Severe", "Moderate", "Baseline"]

# The 18 flow features, in model column order.
FEATURE_COLS = [
    "total_packets", "total_bytes", "unique_target_ips", "unique_target_ports",
    "total_syn_flags", "total_ack_flags", "total_fin_flags", "total_rst_flags",
    "avg_ttl", "avg_window_size", "flow_duration_sec", "packets_per_second",
    "bytes_per_second", "avg_packet_size", "syn_ack_ratio",
    "packet_size_std", "iat_mean", "iat_std",
]

# Packet-field export: 15 fields in file order, renamed by position.
PACKET_FIELDS = [
    "frame.time_epoch", "ip.src", "ip.dst",
    "tcp.srcport", "udp.srcport", "tcp.dstport", "udp.dstport",
    "_ws.col.Protocol", "frame.len",
    "tcp.flags.syn", "tcp.flags.ack", "tcp.flags.fin", "tcp.flags.reset",
    "ip.ttl", "tcp.window_size",
]
RAW_COLUMNS = [
    "time_epoch", "src_ip", "dst_ip", "tcp_src", "udp_src",
    "tcp_dst", "udp_dst", "protocol", "frame_len",
    "syn", "ack", "fin", "rst", "ttl", "win",
]

# Labelled-benchmark header aliases (benchmark column -> feature name).
BENCHMARK_ALIASES = {
    "Total Fwd Packets": "total_packets",
    "Total Length of Fwd Packets": "total_bytes",
    "Flow Duration": "flow_duration_sec",
    "Flow Packets/s": "packets_per_second",
    "Flow Bytes/s": "bytes_per_second",
    "Average Packet Size": "avg_packet_size",
    "Packet Length Std": "packet_size_std",
    "Flow IAT Mean": "iat_mean",
    "Flow IAT Std": "iat_std",
    "SYN Flag Count": "total_syn_flags",
    "ACK Flag Count": "total_ack_flags",
    "FIN Flag Count": "total_fin_flags",
    "RST Flag Count": "total_rst_flags",
}

# Spec targets for the binary (attack vs benign) view.
TARGET_DETECTION_RATE = 0.95
TARGET_FALSE_POSITIVE = 0.05
TARGET_PRECISION = 0.90
TARGET_F1 = 0.92
TARGET_LATENCY_MS = 10.0

# Notification channels in fan-out order.
CHANNELS = ["email", "discord", "slack"]
NOTICE_SUBJECT_PREFIX = "[Hybrid IDS] Severe Threat from "
NOTICE_TITLE = "Hybrid IDS Severe Alert"
NOTICE_SENDER = "Hybrid IDS"
NOTICE_COLOR = 0xFF3333

# Latest-N views of the dashboard.
LATEST_ALERTS = 500
ALERT_PAGE = 100
TOP_TALKERS = 5

# Null-like source/protocol text that counts as blank.
BLANK_TEXT = ["", "nan", "NaN"]

# Numeric text accepted by the coercion (same shape the original accepts).
NUMERIC_PATTERN = r"^[+-]?[.]?[0-9]+[.]?[0-9]*([eE][+-]?[0-9]+)?$"


@dataclass(frozen=True)
class Thresholds:
    """Detector thresholds (defaults are the original's values)."""

    window_us: int = 2_000_000          # tumbling window, 2 s
    min_window_packets: int = 2         # gate: windows below this are skipped
    rolling_windows: int = 15           # active windows of history per source
    min_duration_s: float = 0.1         # duration floor
    # single-window rule table
    syn_flood_pps: float = 500.0
    syn_flood_sar: float = 5.0
    flood_pps: float = 1000.0
    bandwidth_pps: float = 300.0
    bandwidth_size: float = 800.0
    scan_ports: int = 20
    ping_pps: float = 5.0
    ping_size: float = 150.0
    # multi-window rules
    slow_min_windows: int = 5
    slow_ports: int = 60
    slow_syn: int = 150
    slow_packets: int = 200
    # DNS tunnel: DNS packets per second above this
    dns_pps: float = 30.0
    # notification throttle per (source, channel)
    throttle_s: int = 3600

    @property
    def window_s(self) -> float:
        return self.window_us / 1e6


DEFAULT = Thresholds()
