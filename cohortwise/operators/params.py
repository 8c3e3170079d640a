"""Report parameters as typed values, turned into SQL predicates.

The reports take a product line and a closed date range. Dates become DATE
literals so Catalyst folds them and the comparisons reach the scan as
partition or Parquet filters.
"""

from __future__ import annotations

import datetime as dt

from ..functions import rules as R
from ..functions.sqltext import lit

DateLike = str | dt.date


def as_date(value: DateLike) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value))


def date_range(start: DateLike, end: DateLike) -> tuple[dt.date, dt.date]:
    s, e = as_date(start), as_date(end)
    if s > e:
        raise ValueError(f"start {s} is after end {e}")
    return s, e


def event_is_line_sql(line: str, event_col: str = "event") -> str:
    """event = the line's purchase event; an unknown line matches nothing."""
    ev = R.line_event(line)
    if ev is None:
        return "FALSE"
    return f"{event_col} = {lit(ev)}"


def in_closed_range_sql(start: DateLike, end: DateLike, col: str = "date") -> str:
    s, e = date_range(start, end)
    return f"{col} >= {lit(s)} AND {col} <= {lit(e)}"


def in_renewal_range_sql(start: DateLike, end: DateLike, max_days: int, col: str = "date") -> str:
    """(start, end + max_days]: every renewal any base row can still see."""
    s, e = date_range(start, end)
    return f"{col} > {lit(s)} AND {col} <= {lit(e + dt.timedelta(days=max_days))}"
