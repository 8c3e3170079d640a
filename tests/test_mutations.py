"""The fixture can fail: wrong rules change the result of a key on the test data."""

from __future__ import annotations

import pytest
from conftest import SF01

from cohortwise.operators import renewal as N
from cohortwise.plans.registry import QUERIES
from oracle_sql import ORACLE_SQL
from tools.compare import duck, rows_key


def green(spark, name: str) -> bool:
    df = QUERIES[name](spark, SF01)
    res = duck(SF01).execute(ORACLE_SQL[name])
    cols = [d[0] for d in res.description]
    return rows_key(df.columns, [tuple(r) for r in df.collect()], exact=True) == rows_key(cols, res.fetchall(), exact=True)


@pytest.mark.parametrize("name", ["renewal_flags", "inapp_renewal_report"])
def test_product_counts_in_the_match(spark, monkeypatch, name):
    assert green(spark, name)
    monkeypatch.setattr(N, "_next_renewal_sql", without_product(N._next_renewal_sql))
    assert not green(spark, name)


def without_product(next_sql):
    def mutated(*args, **kw):
        return next_sql(*args, **kw).replace(", product_id_all_product ORDER", " ORDER")

    return mutated


@pytest.mark.parametrize("name", ["renewal_flags", "web_renewal_flags"])
def test_the_last_day_of_the_window_counts(spark, monkeypatch, name):
    assert green(spark, name)
    has_repay = N._has_repay_sql
    monkeypatch.setattr(N, "_has_repay_sql", lambda day, window: has_repay(day, f"({window} + 1)"))
    assert not green(spark, name)


def test_the_product_breaks_ties_of_a_day(spark, monkeypatch):
    assert green(spark, "first_order_per_segment")

    def by_money(base):
        keys = ", ".join([*N.WEB_SEGMENT_KEYS, "user_id"])
        return base.selectExpr("*", f"row_number() OVER (PARTITION BY {keys} ORDER BY first_date, origin_money) AS _rn").where("_rn = 1").drop("_rn")

    monkeypatch.setattr(N, "first_order_per_segment", by_money)
    assert not green(spark, "first_order_per_segment")
