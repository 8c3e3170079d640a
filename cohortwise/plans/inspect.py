"""Checks on physical plans: scans, Python nodes, Cartesian products, pushdown.

Used by the tests to hold the reports to their intended shape: how many
times each report reads its sources, that no row passes through Python,
and that no join degenerates into all pairs.
"""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame

PYTHON_NODES = (
    "BatchEvalPython",
    "ArrowEvalPython",
    "ArrowAggregatePython",
    "AggregateInPandas",
    "ArrowWindowPython",
    "WindowInPandas",
    "MapInPandas",
    "MapInArrow",
    "FlatMapGroupsInPandas",
    "FlatMapGroupsInArrow",
    "FlatMapCoGroupsInPandas",
    "FlatMapCoGroupsInArrow",
    "BatchEvalPythonUDTF",
    "ArrowEvalPythonUDTF",
    "PythonUDF",
)
PAIR_NODES = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _explain(df: DataFrame, mode: str) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode=mode)
    return out.getvalue()


def physical_plan(df: DataFrame) -> str:
    """The physical plan as ``df.explain()`` prints it."""
    return _explain(df, "simple")


def formatted_plan(df: DataFrame) -> str:
    """The plan as ``df.explain("formatted")`` prints it."""
    return _explain(df, "formatted")


def scan_count(df: DataFrame, table_hint: str = "") -> int:
    """Number of file scans in the final plan (optionally of one path)."""
    plan = physical_plan(df)
    scans = re.findall(r"FileScan parquet[^\n]*", plan)
    return len([s for s in scans if table_hint in s])


def python_nodes(df: DataFrame) -> list[str]:
    plan = physical_plan(df)
    return [n for n in PYTHON_NODES if n in plan]


def pair_nodes(df: DataFrame) -> list[str]:
    plan = physical_plan(df)
    return [n for n in PAIR_NODES if n in plan]


def exchange_count(df: DataFrame) -> int:
    return len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", physical_plan(df)))
