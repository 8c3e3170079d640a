from __future__ import annotations

import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from cohortwise.session import build_session  # noqa: E402
from cohortwise.sources.schemas import COHORT_COLUMNS, PURCHASE_COLUMNS, WALK_COLUMNS  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"

WUP = "purchase_vip_order_wup_h2o"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", "cohortwise-tests", {"spark.sql.shuffle.partitions": "4"})
    yield s
    s.stop()


def purchase(
    user=1,
    date="2024-01-10",
    product="vip.gold_1_month",
    money="10.00",
    first=1,
    device="IOS",
    event=WUP,
    order_id=None,
    order_type="新增",
    subscribe=1,
    distinct_id="x",
    ptype="会员",
    double_extra=None,
    entrance=None,
):
    """One purchase event row in PURCHASE_COLUMNS order."""
    return (
        event,
        dt.date.fromisoformat(date),
        user,
        distinct_id,
        order_id,
        product,
        subscribe,
        first,
        device,
        None if money is None else Decimal(money),
        order_type,
        ptype,
        double_extra,
        entrance,
    )


@pytest.fixture()
def purchases(spark):
    def make(rows):
        return spark.createDataFrame(rows, PURCHASE_COLUMNS)

    return make


def walk(user, event, date="2024-01-06", page=None, info=None, click=None, source=None, entrance=None, entrance_id=None):
    return (event, dt.date.fromisoformat(date), user, page, info, click, source, entrance, entrance_id)


@pytest.fixture()
def walks(spark):
    def make(rows):
        return spark.createDataFrame(rows, WALK_COLUMNS)

    return make


@pytest.fixture()
def cohort_df(spark):
    def make(rows):
        return spark.createDataFrame(rows, COHORT_COLUMNS)

    return make
