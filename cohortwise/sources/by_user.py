"""Event tables laid out by user, next to the date layout.

All reports but the order sums follow single users: the training funnel, the
renewal match, the first order of a segment. ``write_by_user`` keeps each
user's rows together, so that none of these shuffles its event rows:

- ``<path>/users``: a table partitioned by date and bucketed by user
  (``bucketBy(n, "user_id")``, files sorted by user). Dates still prune
  partitions; every bucket is one task's read, and joins, aggregations and
  windows by user start from it without an exchange.
- ``<path>/hot``: the rows of hot users, by date only. A user with more rows
  than an average bucket (a bot, or NULL) would make its bucket one long
  task, which nothing downstream can split. Fewer than n users are hot. Their
  rows are read as from any table and combine map-side.

The parts share no user. ``by_user`` marks operators whose rows of a user
depend on this user's rows only: they run on each part, and their results
are stacked. Other operators see the parts' union.

Hot users are found when the layout is first written; days appended later go
by that list, so that a user's rows never stand in both parts.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sqltext import ident, lit

USER = "user_id"


@dataclass(frozen=True)
class ByUser:
    """An event table in two parts that share no user."""

    bucketed: DataFrame
    hot: DataFrame

    def whole(self) -> DataFrame:
        return self.bucketed.unionByName(self.hot)


def by_user(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators over (events, ..) whose rows of a user depend on the user's own events only.

    The operator gets ``bucketed=True`` with rows that are already together
    by user, so that it needs no shuffle of its own for that.
    """

    @functools.wraps(operator)
    def run(events, *args, **kwargs) -> DataFrame:
        if not isinstance(events, ByUser):
            return operator(events, *args, **kwargs)
        return operator(events.bucketed, *args, **{**kwargs, "bucketed": True}).unionByName(operator(events.hot, *args, **kwargs))

    return run


def hot_users(events: DataFrame, buckets: int) -> DataFrame:
    """Users with more rows than an average bucket: fewer than ``buckets`` of them."""
    counts = events.groupBy(USER).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") * buckets > events.count()).select(USER)


def _table_name(path: str) -> str:
    return f"cohortwise_by_user_{zlib.crc32(path.rstrip('/').encode()):08x}"


def _write_parts(events: DataFrame, hot: DataFrame, path: str, buckets: int, mode: str) -> None:
    is_hot = F.col(USER).eqNullSafe(F.col("_cw_hot"))
    hot = hot.withColumnRenamed(USER, "_cw_hot")
    rest = events.join(hot, is_hot, "left_anti")
    (
        rest.repartition(buckets, USER)
        .write.mode(mode)
        .partitionBy("date")
        .bucketBy(buckets, USER)
        .sortBy(USER)
        .option("path", f"{path}/users")
        .format("parquet")
        .saveAsTable(_table_name(path))
    )
    (
        events.join(hot, is_hot, "left_semi")
        .hint("rebalance", "date")
        .sortWithinPartitions("date", "event", USER)
        .write.mode(mode)
        .partitionBy("date")
        .parquet(f"{path}/hot")
    )


def write_by_user(events: DataFrame, path: str, buckets: int) -> None:
    """Writes a new layout of ``buckets`` buckets; an existing one is refused.

    Choose ``buckets`` for the range that a report reads: rows of that range
    divided by what a task should hold.
    """
    spark, path = events.sparkSession, path.rstrip("/")
    columns = ", ".join(f"{ident(f.name)} {f.dataType.simpleString()}" for f in events.schema.fields)
    about = spark.range(1).selectExpr(f"{int(buckets)} AS buckets", f"{lit(columns)} AS columns")
    about.coalesce(1).write.mode("errorifexists").parquet(f"{path}/layout")
    hot_users(events, buckets).coalesce(1).write.parquet(f"{path}/hot_users")
    _write_parts(events, _stored_hot(spark, path, events), path, buckets, "errorifexists")


def append_by_user(events: DataFrame, path: str) -> None:
    """Adds rows (new days, say) to a layout; each user's rows go where the layout keeps that user."""
    spark, path = events.sparkSession, path.rstrip("/")
    buckets, _ = spark.read.parquet(f"{path}/layout").first()
    _register(spark, path)
    _write_parts(events, _stored_hot(spark, path, events), path, buckets, "append")


def _stored_hot(spark: SparkSession, path: str, events: DataFrame) -> DataFrame:
    return spark.read.schema(f"{USER} {events.schema[USER].dataType.simpleString()}").parquet(f"{path}/hot_users")


def _register(spark: SparkSession, path: str) -> tuple[str, str]:
    """The session's name of the layout's bucketed table, and the columns of both parts."""
    buckets, columns = spark.read.parquet(f"{path}/layout").first()
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (date) "
            f"CLUSTERED BY ({USER}) SORTED BY ({USER}) INTO {buckets} BUCKETS LOCATION {lit(f'{path}/users')}"
        )
        spark.catalog.recoverPartitions(name)
    return name, columns


def read_by_user(spark: SparkSession, path: str) -> ByUser:
    """The layout as an event table for every operator and report."""
    path = path.rstrip("/")
    name, columns = _register(spark, path)
    bucketed = spark.table(name)
    hot = spark.read.schema(columns).parquet(f"{path}/hot").select(*bucketed.columns)
    return ByUser(bucketed, hot)
