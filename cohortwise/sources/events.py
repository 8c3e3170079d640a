"""Readers for event and cohort tables.

At scale the event table is Parquet partitioned by ``date`` (and ideally
clustered by ``event``). ``read_events`` only declares the scan; the
operators' range and equality filters reach it as partition filters and
Parquet pushed filters, and only the columns a report uses are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.sqltext import lit
from .by_user import ByUser


def conform(df: DataFrame | ByUser) -> DataFrame:
    """Make ``date`` a DATE; keep every other column as stored.

    A TIMESTAMP (or string) ``date`` compared with a date literal would drop
    the last day's rows after midnight, so it is cast first; other columns
    keep their stored types (user ids may be strings, money may be any
    numeric). Missing required columns fail here, before any job runs. A
    table laid out by user is the union of its parts.
    """
    if isinstance(df, ByUser):
        df = df.whole()
    missing = [n for n in ("event", "date", "user_id") if n not in df.columns]
    if missing:
        raise ValueError(f"event table lacks required columns: {missing}")
    if df.schema["date"].dataType == T.DateType():
        return df
    return df.selectExpr(*[("CAST(date AS DATE) AS date" if c == "date" else f"`{c}`") for c in df.columns])


def read_events(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Scan an event table; partition discovery exposes ``date`` partitions."""
    return conform(spark.read.format(fmt).load(path))


def write_events(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write an event table partitioned by date, files clustered by event.

    An existing table is refused by default. ``mode="overwrite"`` replaces
    the days that ``df`` holds and leaves all others as they are.

    ``REBALANCE(date)`` groups each day's rows into few tasks, and adaptive
    execution splits a day that holds far more rows than others (a hot day
    is written by several tasks, not one) and merges small ones, so the
    layout has few files per day without a skewed writer. Sorting within
    partitions by (event, user_id) makes Parquet row-group statistics
    selective for the ``event = ..`` filters every report uses.
    """
    (
        df.hint("rebalance", "date")
        .sortWithinPartitions("date", "event", "user_id")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date")
        .parquet(path)
    )


def cohorts_from_lists(lists: dict[str, DataFrame]) -> DataFrame:
    """Tag each arm's user list with its group name and stack them.

    Lists may repeat users; the distinct happens in the experiment
    operators. ``user_id`` keeps its stored type (it must match the event
    table's).
    """
    frames = [df.selectExpr(f"{lit(name)} AS group_name", "user_id") for name, df in lists.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
