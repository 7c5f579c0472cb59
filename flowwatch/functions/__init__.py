from flowwatch.functions.scalar import (  # noqa: F401
    block_rule_name,
    canonical_port,
    class_threat,
    clean_flag,
    clock_text,
    coerce_numeric,
    first_value,
    format_fixed,
    is_blank,
    round_half_away,
    round_exact_half_even,
    round_half_even,
    scrub,
    severity_of,
    threat_rank,
)
