"""Detection rules as built-in ``CASE`` expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowwatch import config as C
from flowwatch.config import DEFAULT, Thresholds


def _case(branches, default):
    """Fold ``[(cond, value), ...]`` into one ``CASE`` (first match wins)."""
    expr = default
    for cond, value in reversed(branches):
        expr = F.when(cond, value).otherwise(expr)
    return expr


def _rule_branches(pps, sar, ports, size, th: Thresholds):
    return [
        ((pps > th.syn_flood_pps) & (sar > th.syn_flood_sar), (C.P_SYN_FLOOD, C.SEVERE)),
        (pps > th.flood_pps, (C.P_FLOOD, C.SEVERE)),
        ((pps > th.bandwidth_pps) & (size > th.bandwidth_size), (C.P_BANDWIDTH, C.BANDWIDTH)),
        (ports > th.scan_ports, (C.P_SCAN, C.MODERATE)),
        ((pps <= th.ping_pps) & (size < th.ping_size), (C.P_PING, C.BASELINE)),
    ]


def rule_classify(pps="packets_per_second", sar="syn_ack_ratio", ports="unique_target_ports",
                  size="avg_packet_size", th: Thresholds = DEFAULT) -> tuple[Column, Column]:
    """single-window rule table -> (profile, threat); ordered, first match wins."""
    pps, sar, ports, size = (F.col(c) if isinstance(c, str) else c for c in (pps, sar, ports, size))
    br = _rule_branches(pps, sar, ports, size, th)
    profile = _case([(c, F.lit(v[0])) for c, v in br], F.lit(C.P_WEB))
    threat = _case([(c, F.lit(v[1])) for c, v in br], F.lit(C.BASELINE))
    return profile, threat


def slow_attack(windows="rolling_windows", packets="rolling_packets", ports="rolling_unique_ports",
                syn="rolling_syn", th: Thresholds = DEFAULT) -> tuple[Column, Column]:
    """multi-window rules on rolling history -> (profile or null, threat)."""
    n, pk, pt, sy = (F.col(c) if isinstance(c, str) else c for c in (windows, packets, ports, syn))
    enough = n >= th.slow_min_windows
    scan = enough & (pt > th.slow_ports)
    sustained = enough & (sy > th.slow_syn) & (pk > th.slow_packets)
    profile = _case([(scan, F.lit(C.P_SLOW_SCAN)), (sustained, F.lit(C.P_SUSTAINED_SYN))],
                    F.lit(None).cast("string"))
    threat = F.when(scan | sustained, F.lit(C.MODERATE)).otherwise(F.lit(C.BASELINE))
    return profile, threat


def dns_tunnel(dns_packets="dns_packets", th: Thresholds = DEFAULT) -> tuple[Column, Column]:
    """exact protocol ``DNS`` above ``dns_pps`` packets per second in the window."""
    d = F.col(dns_packets) if isinstance(dns_packets, str) else dns_packets
    hit = (d / F.lit(th.window_s)) > F.lit(th.dns_pps)
    return (F.when(hit, F.lit(C.P_DNS_TUNNEL)).otherwise(F.lit(None).cast("string")),
            F.when(hit, F.lit(C.MODERATE)).otherwise(F.lit(C.BASELINE)))


def weak_label(pps="packets_per_second", sar="syn_ack_ratio", ports="unique_target_ports",
               size="avg_packet_size", th: Thresholds = DEFAULT) -> Column:
    """G1: weak-supervision class 0/1/2 (ports are tested before bandwidth)."""
    pps, sar, ports, size = (F.col(c) if isinstance(c, str) else c for c in (pps, sar, ports, size))
    return _case([
        ((pps > th.syn_flood_pps) & (sar > th.syn_flood_sar), F.lit(2)),
        (pps > th.flood_pps, F.lit(2)),
        (ports > th.scan_ports, F.lit(1)),
        ((pps > th.bandwidth_pps) & (size > th.bandwidth_size), F.lit(1)),
    ], F.lit(0))
