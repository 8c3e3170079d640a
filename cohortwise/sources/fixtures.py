"""Deterministic event tables derived from the driver's test tables.

The test data has no subscription or training events, so these mappings
derive them, row for row, from ``orders`` (purchases) and ``events``
(training clicks and page views). Every column is a pure function of the
source row, so the same rules are written once more in DuckDB SQL for the
oracle (``oracle_sql.py`` at the repository root). The work grows with the source tables:
one scan, one projection, and for purchases a generator that appends the
duplicate rows in the same pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import rules as R
from ..functions.sqltext import lit
from .schemas import PURCHASE_COLUMNS

# --- FIXED VALUES of the test mapping --------------------------------------
# purchase event by customer key mod 5
FIXTURE_EVENTS = [
    "purchase_vip_order_wup_h2o",
    "purchase_vip_order_h2o",
    "purchase_vip_order_df_h2o",
    "purchase_vip_order_mm_h2o",
    "purchase_vip_order_db_h2o",
]
# in-app product codes by (customer key div 10) mod 8; None = missing code
FIXTURE_INAPP_CODES = [
    "vip.gold_1_month",
    "vip.GoldYear",
    "vip.3_month.v2",
    "app.auto.month",
    "vip_180_day",
    "coins_pack_100",
    "vip.silveryearsale",
    None,
]
# web product codes by (customer key div 10) mod 10
FIXTURE_WEB_CODES = [
    "webob_0d7-29.9d30",
    "webob_9.9d7-29.9d28",
    "webob_0d30-19.9d30",
    "webob_19.9d14-19.9d14",
    "webob_29.9d30-29.9d30",
    "webob_0d7-79.9d90",
    "webob_79.9d84-79.9d90",
    "webob_169d168-169d168",
    "webob_special",
    "webob_5d60-5d60",
]
FIXTURE_DATE_ORIGIN = "1995-01-01"
FIXTURE_DATE_BASE = "2024-01-01"
FIXTURE_DATE_SPAN = 640
# walk events by event id mod 10
FIXTURE_WALK_EVENTS = [
    R.EV_PAGEVIEW,
    R.EV_PAGEVIEW,
    R.EV_CLICK,
    R.EV_START,
    R.EV_START,
    R.EV_START,
    R.EV_START,
    R.EV_END,
    R.EV_END,
    "other",
]
FIXTURE_PAGES = [60000, 60001, 60067, 60002]
FIXTURE_PAGEINFO = ["Homeworkout", "WalBeat", None]
FIXTURE_ENTRANCES = ["504", "503", "502", "501", None]

# report parameters used with these fixtures
PURCHASE_LINE = "健走"
PURCHASE_START = "2024-01-01"
PURCHASE_END = "2024-06-30"
# the range in two halves, for merged states
HALF_END = "2024-03-31"
HALF_START = "2024-04-01"
# last day with data, as far as the matured flag is concerned
DATA_END = "2025-02-28"
WALK_START = "2024-01-05"
WALK_END = "2024-01-11"


def _pick(values: list, index: str) -> str:
    """values[index] of a small fixed list (a constant array: little generated code)."""
    return f"element_at(array({', '.join('NULL' if v is None else lit(v) for v in values)}), CAST({index} AS INT) + 1)"


def purchase_events(orders: DataFrame) -> DataFrame:
    """Purchase rows (R1-R4 input) from TPC-H-like ``orders``.

    Product, device and product group depend on the customer and the order,
    so one user buys several products on several devices; some users and
    order ids are missing; dates run past the longest window. Appends, in
    the same scan (a generator, not a union), exact copies of orders with
    key % 17 = 0, copies with one more unit of money for key % 19 = 0, and
    copies of key % 23 = 0 with another product of the same plan and two
    more units of money, on the same day, and copies of key % 29 = 0 as
    renewals one day after a month's window has closed.
    """
    k, c = "o_orderkey", "o_custkey"
    day = f"pmod(datediff(to_date(o_orderdate), DATE {lit(FIXTURE_DATE_ORIGIN)}), {FIXTURE_DATE_SPAN})"
    code = f"{c} div 10 + pmod({k}, 3)"
    device = f"pmod({c} + pmod({k}, 2), 7)"
    group = f"({c} + CASE WHEN pmod({k}, 4) = 3 THEN 1 ELSE 0 END)"
    sets = ", ".join("array(0" + "".join(f", {i + 1}" for i in range(4) if bits >> i & 1) + ")" for bits in range(16))
    which = " + ".join(f"CASE WHEN pmod({k}, {n}) = 0 THEN {1 << i} ELSE 0 END" for i, n in enumerate((17, 19, 23, 29)))
    rows = orders.selectExpr(
        f"CASE WHEN pmod({k}, 59) > 0 THEN {k} END AS order_id",
        f"CASE WHEN pmod({k}, 53) > 0 THEN {c} END AS user_id",
        f"date_add(DATE {lit(FIXTURE_DATE_BASE)}, CAST({day} AS INT)) AS date",
        f"{_pick(FIXTURE_EVENTS, f'pmod({c}, 5)')} AS event",
        f"CASE WHEN {c} = 50 THEN {lit(R.INAPP_TEST_DISTINCT_ID)} WHEN pmod({c}, 97) = 3 THEN NULL "
        f"ELSE CAST({c} AS STRING) END AS distinct_id",
        f"CASE WHEN pmod({c} div 5 + CASE WHEN pmod({k}, 7) = 6 THEN 1 ELSE 0 END, 2) = 0 "
        f"THEN {_pick(FIXTURE_INAPP_CODES, f'pmod({code}, 8)')} "
        f"ELSE {_pick(FIXTURE_WEB_CODES, f'pmod({code}, 10)')} END AS product_id_all_product",
        f"CASE WHEN pmod({k}, 13) = 0 THEN NULL WHEN pmod({k}, 11) = 0 THEN CAST(0 AS DECIMAL(12,2)) "
        "ELSE CAST(o_totalprice AS DECIMAL(12,2)) END AS origin_money",
        f"CASE WHEN pmod({k}, 41) = 0 THEN NULL WHEN pmod({k}, 3) = 0 THEN 1 ELSE 0 END AS is_first_purchase_withmoney",
        f"CASE WHEN pmod({k}, 10) = 9 THEN 0 ELSE 1 END AS product_is_subscribe",
        f"CASE WHEN {device} <= 2 THEN 'IOS' WHEN {device} <= 5 THEN 'Android' ELSE 'Web' END AS device_type",
        f"CASE WHEN pmod({k}, 8) <= 2 THEN {lit(R.ORDER_NEW)} WHEN pmod({k}, 8) <= 6 THEN {lit(R.ORDER_RENEW)} "
        "ELSE '升级' END AS all_product_order_type",
        f"CASE WHEN pmod({group}, 29) = 5 THEN NULL WHEN pmod({group}, 3) = 0 THEN {lit(R.RAW_TYPE_MEMBER)} "
        f"ELSE {lit(R.RAW_TYPE_EXTRA)} END AS webob_product_type",
        f"CASE WHEN pmod({group}, 29) = 5 OR pmod({group}, 3) = 0 THEN NULL WHEN pmod({group}, 3) = 1 THEN {lit(R.RAW_NOT_DOUBLE_EXTRA)} "
        f"ELSE {lit(R.RAW_DOUBLE_EXTRA)} END AS webob_product_type_is_double_extra",
        f"CASE pmod({k}, 9) WHEN 0 THEN '75' WHEN 1 THEN NULL ELSE '10001' END AS purchase_entrance_all_product",
        f"explode(element_at(array({sets}), 1 + {which})) AS _copy",
    )
    changed = {
        "origin_money": "CAST(origin_money + CASE _copy WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS DECIMAL(12,2)) AS origin_money",
        "product_id_all_product": "CASE WHEN _copy = 3 THEN concat('alt_', product_id_all_product) ELSE product_id_all_product END "
        "AS product_id_all_product",
        "date": "CASE WHEN _copy = 4 THEN date_add(date, CASE WHEN contains(product_id_all_product, 'webob') THEN 36 ELSE 41 END) ELSE date END AS date",
        "all_product_order_type": f"CASE WHEN _copy = 4 THEN {lit(R.ORDER_RENEW)} ELSE all_product_order_type END AS all_product_order_type",
    }
    return rows.selectExpr(*[changed.get(f.name, f.name) for f in PURCHASE_COLUMNS.fields])


def walk_events(events: DataFrame) -> DataFrame:
    """Training page-view, click, start and end rows (R5 input) from ``events``."""
    i = "event_id"
    ev = _pick(FIXTURE_WALK_EVENTS, f"pmod({i}, 10)")
    is_view = f"pmod({i}, 10) IN (0, 1)"
    is_click = f"pmod({i}, 10) = 2"
    is_action = f"pmod({i}, 10) BETWEEN 3 AND 8"
    return events.selectExpr(
        f"{ev} AS event",
        "CAST(ts AS DATE) AS date",
        "user_id",
        f"CASE WHEN {is_view} THEN {_pick(FIXTURE_PAGES, f'pmod({i} div 10, 4)')} END AS page_id",
        f"CASE WHEN {is_view} AND pmod({i} div 10, 4) = 1 THEN {_pick(FIXTURE_PAGEINFO, f'pmod({i} div 40, 3)')} END AS pageinfo",
        f"CASE WHEN {is_click} THEN (CASE WHEN pmod({i} div 10, 4) = 0 THEN {R.CLICK_FILTER} ELSE 600001 END) END AS click_id",
        f"CASE WHEN {is_click} THEN (CASE WHEN pmod({i} div 40, 2) = 0 THEN {lit(R.CLICK_SOURCE_FILTER)} ELSE '排序' END) END "
        "AS click_source_url",
        f"CASE WHEN {is_action} THEN {_pick(FIXTURE_ENTRANCES, f'pmod({i} div 10, 5)')} END AS action_entrance_wup",
        f"CASE WHEN {is_action} THEN (CASE WHEN pmod({i} div 50, 2) = 0 THEN '2' ELSE '1' END) END AS action_entrance_id_wup",
    )


def cohorts(events: DataFrame) -> DataFrame:
    """Experiment and control user lists from the users seen in ``events``.

    Experiment: even ids and ids ending in 1; control: odd ids (so ids
    ending in 1 are in both arms). Ids divisible by 4 are listed twice.
    """
    users = events.select("user_id").where("user_id IS NOT NULL").distinct()
    exp, ctl = lit(R.GROUP_EXPERIMENT), lit(R.GROUP_CONTROL)
    lists = (
        f"CASE WHEN pmod(user_id, 4) = 0 THEN array({exp}, {exp}) WHEN pmod(user_id, 2) = 0 THEN array({exp}) "
        f"WHEN pmod(user_id, 10) = 1 THEN array({exp}, {ctl}) ELSE array({ctl}) END"
    )
    return users.selectExpr(f"explode({lists}) AS group_name", "user_id")


# driver tables, read with their declared schemas (no footer inference job)
ORDERS_SCHEMA = (
    "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
)
EVENTS_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def load_purchase_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purchase_events(spark.read.schema(ORDERS_SCHEMA).parquet(f"{sf_dir}/orders.parquet"))


def load_walk_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk_events(spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet"))


def load_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts(spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet"))
