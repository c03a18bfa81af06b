"""Scalar column functions (all JVM-side built-ins, no Python UDFs)."""

from mixlens.functions.scalar import (
    parse_dmy, to_date_col, weekday_flag, WEEKDAYS, date_in, safe_div, log1p_col, power_col,
    type_label, zero_if_null, week_commencing,
)

__all__ = [
    "parse_dmy", "to_date_col", "weekday_flag", "WEEKDAYS", "date_in", "safe_div", "log1p_col",
    "power_col", "type_label", "zero_if_null", "week_commencing",
]
