"""Scalar functions F1-F15 as Column expressions.

ANSI mode is on in Spark 4: division by zero and bad dates raise.  Every
division here goes through ``try_divide`` and every text date through
``try_to_date`` so a bad value becomes NULL, never an error or NaN.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_dmy(c: ColumnOrName) -> Column:
    """Day/month/year text with '/' or '-' separators -> date (NULL when unparseable)."""
    c = _c(c)
    return F.coalesce(F.try_to_date(c, "d/M/yyyy"), F.try_to_date(c, "d-M-yyyy"))


def to_date_col(c: ColumnOrName) -> Column:
    """ISO date text or timestamp -> date."""
    return _c(c).cast("date")


# Spark's dayofweek numbering: Sunday = 1 ... Saturday = 7 (locale free).
WEEKDAYS: dict[str, int] = {
    "Sunday": 1, "Monday": 2, "Tuesday": 3, "Wednesday": 4,
    "Thursday": 5, "Friday": 6, "Saturday": 7,
}


def weekday_flag(date: ColumnOrName, day: str) -> Column:
    """1.0 on the named weekday, else 0.0."""
    return F.when(F.dayofweek(_c(date)) == WEEKDAYS[day], F.lit(1.0)).otherwise(F.lit(0.0))


def date_in(date: ColumnOrName, dates: Iterable[_dt.date | str]) -> Column:
    """1.0 when the date is one of ``dates`` (an event flag), else 0.0."""
    lits = [F.lit(_dt.date.fromisoformat(d) if isinstance(d, str) else d) for d in dates]
    return F.when(_c(date).isin(*lits), F.lit(1.0)).otherwise(F.lit(0.0))


def safe_div(num: ColumnOrName, den: ColumnOrName) -> Column:
    """num / den, NULL when den is 0 or either side is NULL."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def log1p_col(c: ColumnOrName) -> Column:
    return F.log1p(_c(c))


def power_col(c: ColumnOrName, p: float) -> Column:
    return F.pow(_c(c), F.lit(float(p)))


def type_label(cluster: ColumnOrName, prefix: str = "type_") -> Column:
    return F.concat(F.lit(prefix), _c(cluster).cast("string"))


def zero_if_null(c: ColumnOrName) -> Column:
    return F.coalesce(_c(c), F.lit(0.0))


def week_commencing(date: ColumnOrName) -> Column:
    """Start of the week-of-year bucket: weeks are counted from 1 January (days 1-7 = week 1)."""
    d = _c(date)
    return F.date_add(F.trunc(d, "year"), (F.floor((F.dayofyear(d) - 1) / 7) * 7).cast("int"))
