"""Long metric rows to wide report rows (D23), and metric stacking.

The pivot takes the explicit column list and is one aggregation of
``max(CASE WHEN column = c THEN value END)`` per column: no job runs to
find the values, the output schema is fixed, and unlike
``groupBy().pivot()`` there is no second aggregation stage. Rows whose
column is NULL or unlisted still create their group row, with empty cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sqltext import ident, lit


def segment_pivot(
    long: DataFrame,
    keys: list[str],
    column_col: str,
    value_col: str,
    columns: list[str],
    fill: str | None = None,
) -> DataFrame:
    """One row per ``keys``, one column per name in ``columns``.

    Every (keys, column) has at most one value; ``fill`` is SQL for missing
    cells (it may depend on the keys, e.g. fill one metric kind only).
    """
    cells = []
    for c in columns:
        value = f"max(CASE WHEN {ident(column_col)} = {lit(c)} THEN {ident(value_col)} END)"
        if fill is not None:
            value = f"coalesce({value}, {fill})"
        cells.append(F.expr(f"{value} AS {ident(c)}"))
    return long.groupBy(*keys).agg(*cells)


def stack_wide(df: DataFrame, keys: list[str], columns: list[str], metrics: list[tuple[str, list[str]]], kind_col: str) -> DataFrame:
    """U1 without a second scan: one wide row -> one row per (label, values), values in the order of ``columns``.

    Values are cast to DOUBLE so rates, counts and money share the columns.
    """
    structs = ", ".join(
        f"struct({lit(label)} AS {ident(kind_col)}, "
        + ", ".join(f"CAST({value} AS DOUBLE) AS {ident(c)}" for c, value in zip(columns, values, strict=True))
        + ")"
        for label, values in metrics
    )
    return df.selectExpr(*[ident(k) for k in keys], f"inline(array({structs}))")
