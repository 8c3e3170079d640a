"""Web order revenue metrics (D14, D15) in long form.

Distinct order counts are two-level aggregations (``per_cell_orders``):
first per order, which partially aggregates map-side so an order or cell
holding a third of all rows collapses before the shuffle, then per cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import classify as C
from ..functions import rules as R
from .params import DateLike
from .purchases import per_cell_orders, web_orders


def web_arppu(events: DataFrame, line: str, start: DateLike, end: DateLike) -> DataFrame:
    """ARPPU = money / distinct orders per order type, month, group and plan.

    Output: order_type, stat_month, product_type_group, period_group,
    revenue, orders, arppu (2 places, half up; NULL with no order id).
    """
    orders = web_orders(events, line, start, end, R.WEB_ORDER_TYPES).where("period_group IS NOT NULL")
    cells = per_cell_orders(orders, ["order_type", "stat_month", "product_type_group", "period_group"])
    return cells.selectExpr(
        "order_type",
        "stat_month",
        "product_type_group",
        "period_group",
        "CAST(revenue AS DOUBLE) AS revenue",
        "orders",
        f"{C.rounded_money_ratio_sql('revenue', 'orders')} AS arppu",
    )


def web_new_sales(events: DataFrame, line: str, start: DateLike, end: DateLike) -> DataFrame:
    """Money and distinct orders of new web orders per month, group and plan."""
    orders = web_orders(events, line, start, end, (R.ORDER_NEW,)).where("period_group IS NOT NULL")
    cells = per_cell_orders(orders, ["stat_month", "product_type_group", "period_group"])
    return cells.selectExpr(
        "stat_month",
        "product_type_group",
        "period_group",
        "CAST(round(revenue, 2) AS DOUBLE) AS revenue",
        "orders",
    )
