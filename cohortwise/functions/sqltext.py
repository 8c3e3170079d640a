"""Spark SQL text for literals, lists and CASE expressions.

Rules are turned into one SQL expression each and handed to Spark with
``F.expr`` / ``selectExpr`` / ``where``: Catalyst builds the same plan as
from chained Column calls, and the driver makes one JVM call per
expression instead of one per node.
"""

from __future__ import annotations

import datetime as dt


def lit(v) -> str:
    """A Spark SQL literal; backslashes and quotes are escaped."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return repr(v) + "D"
    if isinstance(v, dt.date):
        return f"DATE '{v.isoformat()}'"
    s = str(v).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{s}'"


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def in_list(col: str, values) -> str:
    return f"{col} IN ({', '.join(lit(v) for v in values)})"


def case(branches: list[tuple[str, str]], default: str | None = None) -> str:
    """Searched CASE; the first true condition wins."""
    whens = " ".join(f"WHEN {cond} THEN {value}" for cond, value in branches)
    tail = f" ELSE {default}" if default is not None else ""
    return f"CASE {whens}{tail} END"


def map_lookup(table: dict, key: str) -> str:
    """``table[key]`` as a map literal lookup; NULL for a missing key."""
    entries = ", ".join(f"{lit(k)}, {lit(v)}" for k, v in table.items())
    return f"map({entries})[{key}]"


def all_of(conds: list[str]) -> str:
    return " AND ".join(f"({c})" for c in conds)
