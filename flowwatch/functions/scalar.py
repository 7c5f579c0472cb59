"""Column-level functions.

All are built-in expressions, so they stay inside whole-stage codegen and
behave the same under ANSI mode (no plain ``cast`` of free text).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowwatch import config as C


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_value(c) -> Column:
    """First value of a multi-valued field (``'a,b'`` -> ``'a'``).

    ``substring_index`` (no array allocation) equals ``split_part(x, ',', 1)``.
    """
    return F.substring_index(_col(c).cast("string"), ",", 1)


def _parse_trimmed(t: Column) -> Column:
    return F.coalesce(F.when(t.rlike(C.NUMERIC_PATTERN), t.try_cast("double")), F.lit(0.0))


def coerce_numeric(c) -> Column:
    """First value, trimmed, parsed as a double; unparsable or null -> 0.

    The pattern guard rejects text that ``try_cast`` alone would accept but a
    plain decimal parser would not (``1d``, ``0x1p3``, ``nan``).
    """
    return _parse_trimmed(F.trim(first_value(c)))


def clean_flag(c) -> Column:
    """``True/true`` -> 1, ``False/false/''/nan`` -> 0, else numeric."""
    t = F.trim(first_value(c))
    return F.when(t.isin("True", "true"), F.lit(1.0)).otherwise(_parse_trimmed(t))


def canonical_port(tcp, udp) -> Column:
    """coalesce(tcp, udp, 0) as canonical text (``'80.0'`` -> ``'80'``).

    Multi-valued text stays its own value.
    """
    p = F.coalesce(_col(tcp).cast("string"), _col(udp).cast("string"))
    t = F.trim(p)
    return (
        F.when(p.isNull(), F.lit("0"))
        .when(
            t.rlike(r"^[0-9]+([.]0*)?$"),
            F.regexp_extract(t, r"^([0-9]+)", 1).try_cast("bigint").cast("string"),
        )
        .otherwise(p)
    )


def is_blank(c) -> Column:
    """Null, empty, spaces, ``nan`` or ``NaN``."""
    return F.coalesce(F.trim(_col(c)), F.lit("")).isin(*C.BLANK_TEXT)


def scrub(c) -> Column:
    """C11: null / NaN / +-inf -> 0."""
    x = _col(c).cast("double")
    return (
        F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(0.0))
        .otherwise(x)
    )


def round_half_even(c, digits: int) -> Column:
    """C14: numpy-style display rounding (scale, round half to even, unscale)."""
    scale = float(10 ** digits)
    return F.rint(_col(c).cast("double") * scale) / scale


def round_exact_half_even(c, digits: int) -> Column:
    """Correct rounding of the *exact* binary value (as printf / Python format).

    ``x * 10^d`` may round onto a .5 tie that the exact product is not on
    (2.675 -> 267.5); the exact product error is recovered with Dekker's
    error-free product (Veltkamp split; ``10^d`` has few bits, ``d <= 7``) and
    decides such ties.  Built-in arithmetic only.
    """
    if not 0 <= digits <= 7:
        raise ValueError("digits must be in 0..7")
    scale = float(10 ** digits)
    x = _col(c).cast("double")
    p = x * scale
    split = x * 134217729.0
    hi = split - (split - x)
    lo = x - hi
    err = (hi * scale - p) + lo * scale
    fl = F.floor(p).cast("double")
    tie = (p - fl) == 0.5
    r = (F.when(tie & (err > 0), fl + 1.0)
         .when(tie & (err < 0), fl)
         .otherwise(F.rint(p)))
    return r / scale


def format_fixed(c, digits: int) -> Column:
    """``'%.{digits}f'`` with the rounding of printf / Python formatting."""
    return F.format_string(f"%.{digits}f", round_exact_half_even(c, digits))


def round_half_away(c, digits: int) -> Column:
    """C17: half-away-from-zero rounding of a double."""
    scale = float(10 ** digits)
    y = _col(c).cast("double") * scale
    return F.signum(y) * F.floor(F.abs(y) + 0.5) / scale


def severity_of(threat) -> Column:
    """Severe / Moderate / Baseline from the threat text."""
    t = _col(threat)
    return (
        F.when(t.contains("Severe"), F.lit("Severe"))
        .when(t.contains("Moderate"), F.lit("Moderate"))
        .otherwise(F.lit("Baseline"))
    )


def threat_rank(threat) -> Column:
    """Threat text -> rank; unknown -> 0."""
    t = _col(threat)
    expr = F.lit(0)
    for level, rank in C.SEVERITY_RANK.items():
        if rank:
            expr = F.when(t == level, F.lit(rank)).otherwise(expr)
    return expr


def class_threat(cls) -> Column:
    """Classifier class id -> threat text (unknown -> Baseline)."""
    c = _col(cls).cast("int")
    expr = F.lit(C.BASELINE)
    for k, v in C.CLASS_THREAT.items():
        expr = F.when(c == k, F.lit(v)).otherwise(expr)
    return expr


def block_rule_name(ip) -> Column:
    """Firewall rule name for a source."""
    return F.concat(F.lit("IDS_BLOCK_"), F.replace(_col(ip), F.lit("."), F.lit("_")))


def clock_text(us) -> Column:
    """``HH:MM:SS`` of an epoch-microsecond value, time-zone free (UTC)."""
    s = F.floor(_col(us) / 1_000_000)
    sod = F.pmod(s, F.lit(86400))
    def two(x):
        return F.lpad(x.cast("string"), 2, "0")
    return F.concat_ws(":", two(F.floor(sod / 3600)), two(F.floor(F.pmod(sod, 3600) / 60)), two(F.pmod(sod, 60)))
