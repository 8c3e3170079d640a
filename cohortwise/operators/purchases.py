"""Base purchase rows and their classification.

Each function takes the wide event table and report parameters and returns
a lazy DataFrame. Row predicates are plain comparisons, so the event,
date and flag tests reach the scan (partition and Parquet filters); the
regex classification runs in the same codegen stage right after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import rules as R
from ..functions.sqltext import all_of, in_list, lit
from ..sources.events import conform
from .params import DateLike, event_is_line_sql, in_closed_range_sql

PRODUCT = C.PRODUCT


# --- in-app ----------------------------------------------------------------

def _inapp_filter(line: str, start: DateLike, end: DateLike) -> str:
    return all_of([event_is_line_sql(line), in_closed_range_sql(start, end), C.inapp_row_filter_sql()])


_INAPP_COLUMNS = [
    "event",
    f"{C.month_start_sql()} AS first_month",
    "user_id",
    PRODUCT,
    "is_first_purchase_withmoney",
    "device_type",
    "origin_money",
    "date AS first_date",
]
#: The plan is a function of the product code: found once a row, after a distinct.
_INAPP_PLAN = C.once({"period_type": C.inapp_plan_sql()})


def inapp_base_orders(events: DataFrame, line: str, start: DateLike, end: DateLike) -> DataFrame:
    """Distinct in-app base purchases with plan and window length.

    Output: event, first_month, user_id, product_id_all_product,
    is_first_purchase_withmoney, device_type, origin_money, first_date,
    period_type, diff_days. The plan is a function of the product code, so
    filtering it before the distinct equals filtering after.
    """
    rows = conform(events).where(all_of([_inapp_filter(line, start, end), f"{C.inapp_plan_sql()} IS NOT NULL"]))
    base = rows.selectExpr(*_INAPP_COLUMNS).distinct().selectExpr("*", _INAPP_PLAN)
    return base.selectExpr("*", f"{C.inapp_window_days_sql()} AS diff_days")


def inapp_plan_mix(events: DataFrame, line: str, start: DateLike, end: DateLike) -> DataFrame:
    """Distinct base purchases and users per in-app plan, NULL = no plan."""
    rows = conform(events).where(_inapp_filter(line, start, end)).selectExpr(*_INAPP_COLUMNS).distinct().selectExpr("*", _INAPP_PLAN)
    return rows.groupBy("period_type").agg(
        F.expr("count(1) AS purchases"), F.expr("count(DISTINCT user_id) AS users")
    )


# --- web -------------------------------------------------------------------

def _web_filter(line: str, start: DateLike, end: DateLike, order_types: tuple[str, ...]) -> str:
    return all_of(
        [
            event_is_line_sql(line),
            in_closed_range_sql(start, end),
            C.is_web_code_sql(),
            in_list("all_product_order_type", order_types),
            C.web_entrance_allowed_sql(),
        ]
    )


WEB_ROW_COLUMNS = [
    "event",
    "date",
    "user_id",
    PRODUCT,
    "all_product_order_type AS order_type",
    "origin_money",
    f"{C.web_product_group_sql()} AS product_type_group",
]
#: The code's parts are functions of the product: parsed once a row, after a reduction.
WEB_CODE_PARTS = C.once(
    {"first_price": C.web_first_price_sql(), "first_days": C.web_first_days_sql(), "renew_days": C.web_renew_days_sql()}
)


def web_label_columns(line: str) -> list[str]:
    """SQL of the D3 columns over raw web rows (group, plan, window)."""
    return [
        "event",
        f"{lit(line)} AS event_cn",
        f"{C.month_start_sql()} AS first_month",
        "user_id",
        PRODUCT,
        "order_type",
        "product_type_group",
        "coalesce(origin_money, 0) AS origin_money",
        "date AS first_date",
        f"{C.web_plan_sql(label_set='renewal')} AS product_period_type",
        f"{C.web_window_days_raw_sql()} AS window_days_raw",
    ]


WEB_LABELED = "product_type_group IS NOT NULL AND product_period_type IS NOT NULL AND window_days_raw IS NOT NULL"


def label_web_base(raw: DataFrame, line: str) -> DataFrame:
    """Distinct raw web rows -> D3 rows: group, plan, window; unlabeled rows dropped."""
    labeled = raw.where("product_type_group IS NOT NULL").selectExpr(*web_label_columns(line))
    kept = labeled.where(WEB_LABELED)
    return kept.selectExpr("*", f"{C.web_window_days_sql()} AS diff_days")


def web_base_filter_sql(line: str, start: DateLike, end: DateLike) -> str:
    return all_of([_web_filter(line, start, end, R.WEB_ORDER_TYPES), "product_is_subscribe = 1"])


def web_base_orders(events: DataFrame, line: str, start: DateLike, end: DateLike) -> DataFrame:
    """D3: distinct web subscription base purchases with parsed code and window.

    Output: event, event_cn, first_month, user_id, product_id_all_product,
    order_type, product_type_group, origin_money (NULL as 0), first_date,
    product_period_type, window_days_raw, diff_days. Rows without product
    group, plan or window are dropped. The distinct is on the raw money,
    as the money default is applied after it; the code is parsed after it.
    """
    rows = conform(events).where(web_base_filter_sql(line, start, end))
    raw = rows.selectExpr(*WEB_ROW_COLUMNS).distinct()
    return label_web_base(raw.selectExpr("*", WEB_CODE_PARTS), line)


def web_orders(
    events: DataFrame,
    line: str,
    start: DateLike,
    end: DateLike,
    order_types: tuple[str, ...] = R.WEB_ORDER_TYPES,
    users: bool = False,
) -> DataFrame:
    """Distinct web orders of the ARPPU and sales reports, classified.

    Distinct on (order_id, date, product, order type, money): one order
    with two amounts keeps both; ``users`` adds user_id. Output: order_id, order_type, stat_month,
    origin_money (NULL as 0), product_type_group, first_price, first_days,
    renew_days, renewal_plan, period_group. Rows without product group are
    dropped.
    """
    user = ["user_id"] if users else []
    raw = (
        conform(events)
        .where(_web_filter(line, start, end, order_types))
        .selectExpr(
            *user,
            "order_id",
            "date",
            PRODUCT,
            "all_product_order_type AS order_type",
            "coalesce(origin_money, 0) AS origin_money",
            f"{C.web_product_group_sql()} AS product_type_group",
        )
        .distinct()
    )
    # the code parts are functions of the product, so they are parsed after
    # the distinct: a narrower shuffle, and no regex on duplicate rows
    parsed = raw.where("product_type_group IS NOT NULL").selectExpr(
        *user,
        "order_id",
        "order_type",
        f"{C.month_start_sql()} AS stat_month",
        "origin_money",
        "product_type_group",
        WEB_CODE_PARTS,
    )
    return parsed.selectExpr(
        "*",
        f"{C.web_plan_sql(label_set='renewal')} AS renewal_plan",
        f"{C.web_plan_sql(label_set='sales')} AS period_group",
    )


def per_cell_orders(orders: DataFrame, keys: list[str]) -> DataFrame:
    """Money sum and distinct order count per cell, in two levels.

    First per order (partially aggregated map-side, so a hot order or cell
    collapses before the shuffle), then per cell with a plain count; NULL
    order ids add money but no order.
    """
    per_order = orders.groupBy(*keys, "order_id").agg(F.expr(f"{C.exact_sum_sql(orders, 'origin_money')} AS money"))
    return per_order.groupBy(*keys).agg(F.expr("sum(money) AS revenue"), F.expr("count(order_id) AS orders"))


def sales_report_cells(orders: DataFrame, keys: list[str]) -> DataFrame:
    """One row per ``keys``: money_<i> and orders_<i> of each ARPPU / sales report column i.

    Two levels as ``per_cell_orders``, the second straight by the report's keys.
    """
    per_order = orders.groupBy(*keys, "product_type_group", "period_group", "order_id").agg(
        F.expr(f"{C.exact_sum_sql(orders, 'origin_money')} AS money")
    )
    cells = []
    for i, (_, group, plan) in enumerate(R.WEB_SALES_REPORT_COLUMNS):
        here = f"product_type_group = {lit(group)} AND period_group = {lit(plan)}"
        cells.append(F.expr(f"sum(CASE WHEN {here} THEN money END) AS money_{i}"))
        cells.append(F.expr(f"count(CASE WHEN {here} THEN order_id END) AS orders_{i}"))
    return per_order.groupBy(*keys).agg(*cells)


def web_product_group_mix(events: DataFrame, line: str, start: DateLike, end: DateLike) -> DataFrame:
    """Distinct orders and revenue per product group (new and renewal orders)."""
    cells = per_cell_orders(web_orders(events, line, start, end), ["product_type_group"])
    return cells.selectExpr("product_type_group", "orders", "CAST(revenue AS DOUBLE) AS revenue")


def web_plan_mix(events: DataFrame, line: str, start: DateLike, end: DateLike) -> DataFrame:
    """Orders, users and revenue by plan class in both label sets, plus the rest.

    ``code_parsed`` is 0 for codes the pattern cannot parse; parsed codes
    matching no rule have both labels NULL and ``code_parsed`` 1.

    Two distinct counts, each in two levels: rows are first summed per
    (cell, order, user); each of these gives a row for its order, with the
    money, and a row for its user; then one row per (cell, order or user)
    and a plain count. All combine map-side.
    """
    orders = web_orders(events, line, start, end, users=True).selectExpr(
        "*", "CASE WHEN first_days IS NOT NULL THEN 1 ELSE 0 END AS code_parsed"
    )
    cell = ["renewal_plan", "period_group", "code_parsed"]
    reduced = orders.groupBy(*cell, "order_id", "user_id").agg(F.expr(f"{C.exact_sum_sql(orders, 'origin_money')} AS money"))
    either = reduced.selectExpr(
        *cell,
        "inline(array(struct(TRUE AS is_order, CAST(order_id AS STRING) AS id, money), "
        "struct(FALSE AS is_order, CAST(user_id AS STRING) AS id, CAST(NULL AS DECIMAL(1, 0)) AS money)))",
    )
    per_id = either.groupBy(*cell, "is_order", "id").agg(F.expr("sum(money) AS money"))
    return per_id.groupBy(*cell).agg(
        F.expr("count(CASE WHEN is_order THEN id END) AS orders"),
        F.expr("count(CASE WHEN NOT is_order THEN id END) AS users"),
        F.expr("CAST(sum(money) AS DOUBLE) AS revenue"),
    )
