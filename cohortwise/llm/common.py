"""Shared helpers: tables, written intermediates, text constants.

``materialise`` cuts lineage with a Parquet table under the folder that the
session names in ``spark.checkpoint.dir`` (a cluster's session that names
none is refused). A lost executor loses nothing of
such a table; its readers are planned from its real size.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import scratch_folder as shared_folder

#: The six ASCII white-space characters of every contract, as a regex class body.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes the rows as a Parquet table in the shared folder and returns a reader of it."""
    path = shared_folder(df.sparkSession)
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold_of(column: str | Column, folds: int) -> Column:
    """crc32 of the value as text, modulo ``folds``; a null value is in fold 0 of the empty text."""
    col = F.col(column) if isinstance(column, str) else column
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def py_fold(value, folds: int) -> int:
    """fold_of for one Python value."""
    return zlib.crc32(("" if value is None else str(value)).encode()) % folds


def bounded_sample(rows: DataFrame, limit: int, key: Column) -> DataFrame:
    """About ``limit`` rows at most: rows whose hash of ``key`` falls under limit / count (all rows if fewer).

    For fitting bounded models only. The number of rows returned is binomial
    around ``limit``; it does not grow with the input.
    """
    n = rows.count()
    if n <= limit:
        return rows
    return rows.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < F.lit(int(limit / n * (1 << 30))))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores before it until no column of df has that name (names differ in more than case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def annotate(df: DataFrame, inputs: list[str], added: str, make: Callable[[], Callable[..., list[pa.Array]]]) -> DataFrame:
    """df with further columns (``added``: a DDL string) computed from the columns ``inputs``, batch by batch.

    ``make()`` is called once a task and returns a function from the inputs'
    Arrow arrays to the added columns' arrays. No shuffle, no join: every row
    keeps its own columns, whatever their names or repeats.
    """
    fields = T._parse_datatype_string(added)
    at = [df.columns.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows:
                new = f(*(batch.column(i) for i in at))
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *fields.names])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields.fields]))


def ship(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcasts a value of bounded size; the result gives it inside a task. The value's classes travel along."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)
