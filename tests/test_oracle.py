"""The correctness gate: every registered query equals its DuckDB oracle at sf0.01."""

from __future__ import annotations

import pytest
from conftest import SF01

import __spark_entry__ as entry
from tools.compare import duck, rows_key

from cohortwise.plans.registry import QUERIES  # noqa: E402
from oracle_sql import ORACLE_SQL as ORACLE  # noqa: E402


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF01)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(ORACLE[name])
    cols = [d[0] for d in res.description]
    want = res.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert len(rows) == len(want)
    assert rows_key(df.columns, rows, exact=True) == rows_key(cols, want, exact=True)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["指标类型", "续订基数发生月份"]
    assert df.count() >= 0
