"""The five reports (R1-R5) as lazy DataFrame plans.

Each report reads the event table once, with pushed-down event and date
filters (R1 and R2 read base rows and renewal candidates in the same scan,
over the range widened by the longest renewal window) and aggregates
straight to the fixed report columns, one row per month and group, whose
metric kinds are then stacked.
Metric columns are DOUBLE, counts BIGINT.

The final ORDER BY runs on the finished report, whose size is bounded by
months x metric kinds x groups (not by the data), so it is sorted in one
partition (``coalesce(1)``: no extra shuffle, and no sampling job as a
range-partitioned sort would need). The final merge of the last aggregation
runs in that partition too; it gets one partial row per month and group
from each task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import classify as C
from ..functions import rules as R
from ..functions.sqltext import case, ident, lit
from ..operators import experiment as X
from ..operators import purchases as P
from ..operators import renewal as N
from ..operators.params import DateLike
from ..operators.pivot import stack_wide

INAPP_COLUMNS = [c for c, *_ in R.INAPP_REPORT_COLUMNS]
WEB_RENEWAL_COLUMNS = [c for c, *_ in R.WEB_RENEWAL_REPORT_COLUMNS]
WEB_SALES_COLUMNS = [c for c, *_ in R.WEB_SALES_REPORT_COLUMNS]


def with_position(report: DataFrame, name: str = "position") -> DataFrame:
    """A report's rows with their place, from 1: for writers and readers that do not keep rows in order.

    A report's sort ends in one partition, whose row ids count from 0.
    """
    return report.selectExpr("*", f"monotonically_increasing_id() + 1 AS {ident(name)}")


def sales_column_sql() -> str:
    """Report column of a (product group, plan) cell of the ARPPU / sales reports."""
    return case(
        [
            (f"product_type_group = {lit(group)} AND period_group = {lit(plan)}", lit(name))
            for name, group, plan in R.WEB_SALES_REPORT_COLUMNS
        ]
    )


def inapp_renewal_report(events: DataFrame, line: str, start: DateLike, end: DateLike) -> DataFrame:
    """Per base month, a renewal-rate row and a base-revenue row x 10 segments."""
    cells = N.inapp_report_cells(N.inapp_flagged_days(events, line, start, end))
    at = range(len(INAPP_COLUMNS))
    metrics = [
        (R.METRIC_RATE, [C.rounded_ratio_sql(f"repay_{i}", f"base_{i}", 2) for i in at]),
        (R.METRIC_REVENUE_BASE, [f"money_{i}" for i in at]),
    ]
    kind = ident(R.COL_METRIC_KIND)
    wide = stack_wide(cells, ["first_month"], INAPP_COLUMNS, metrics, R.COL_METRIC_KIND)
    wide = wide.selectExpr(kind, "first_month", *map(ident, INAPP_COLUMNS))
    wide = wide.withColumnRenamed("first_month", R.COL_BASE_MONTH)
    rank = f"CASE WHEN {kind} = {lit(R.METRIC_RATE)} THEN 1 ELSE 2 END"
    out = wide.selectExpr("*", f"{rank} AS _rank").coalesce(1).sortWithinPartitions("_rank", R.COL_BASE_MONTH)
    return out.drop("_rank")


def web_first_orders(events: DataFrame, line: str, start: DateLike, end: DateLike) -> DataFrame:
    return N.first_order_per_segment(P.web_base_orders(events, line, start, end))


def web_renewal_report(events: DataFrame, line: str, start: DateLike, end: DateLike) -> DataFrame:
    """R2: per metric, line, month and product group x 16 (plan x order type) columns."""
    cells = N.web_report_cells(N.web_first_orders_with_renewals(events, line, start, end))
    at = range(len(WEB_RENEWAL_COLUMNS))
    metrics = [
        (R.METRIC_RATE, [C.rounded_ratio_sql(f"repay_{i}", f"base_{i}", 4) for i in at]),
        (R.METRIC_REVENUE_BASE, [f"money_{i}" for i in at]),
    ]
    keys = ["event_cn", "first_month", "product_type_group"]
    wide = stack_wide(cells, keys, WEB_RENEWAL_COLUMNS, metrics, R.COL_METRIC_KIND)
    wide = wide.selectExpr(ident(R.COL_METRIC_KIND), *keys, *map(ident, WEB_RENEWAL_COLUMNS))
    wide = wide.withColumnsRenamed(
        {"event_cn": R.COL_LINE, "first_month": R.COL_BASE_MONTH, "product_type_group": R.COL_PRODUCT_TYPE}
    )
    return wide.coalesce(1).sortWithinPartitions(R.COL_LINE, R.COL_BASE_MONTH, R.COL_PRODUCT_TYPE, R.COL_METRIC_KIND)


def web_arppu_report(events: DataFrame, line: str, start: DateLike, end: DateLike) -> DataFrame:
    """ARPPU per order type and month x 12 group/plan columns."""
    orders = P.web_orders(events, line, start, end).where("period_group IS NOT NULL")
    cells = P.sales_report_cells(orders, ["order_type", "stat_month"])
    ratios = [f"{C.rounded_money_ratio_sql(f'money_{i}', f'orders_{i}')} AS {ident(c)}" for i, c in enumerate(WEB_SALES_COLUMNS)]
    wide = cells.selectExpr("order_type", "stat_month", *ratios)
    rank = f"CASE WHEN order_type = {lit(R.ORDER_NEW)} THEN 1 WHEN order_type = {lit(R.ORDER_RENEW)} THEN 2 ELSE 3 END"
    out = wide.selectExpr("*", f"{rank} AS _rank").coalesce(1).sortWithinPartitions("_rank", "stat_month")
    return out.drop("_rank").withColumnsRenamed({"order_type": R.COL_ORDER_TYPE, "stat_month": R.COL_MONTH})


def web_new_sales_report(events: DataFrame, line: str, start: DateLike, end: DateLike) -> DataFrame:
    """Per month, a sales row and an order-count row x 12 group/plan columns."""
    orders = P.web_orders(events, line, start, end, (R.ORDER_NEW,)).where("period_group IS NOT NULL")
    cells = P.sales_report_cells(orders, ["stat_month"])
    at = range(len(WEB_SALES_COLUMNS))
    metrics = [(R.METRIC_SALES, [f"coalesce(round(money_{i}, 2), 0)" for i in at]), (R.METRIC_ORDERS, [f"orders_{i}" for i in at])]
    wide = stack_wide(cells, ["stat_month"], WEB_SALES_COLUMNS, metrics, R.COL_DATA_KIND)
    wide = wide.selectExpr(ident(R.COL_DATA_KIND), "stat_month", *map(ident, WEB_SALES_COLUMNS))
    wide = wide.withColumnRenamed("stat_month", R.COL_MONTH)
    return wide.coalesce(1).sortWithinPartitions(wide[R.COL_MONTH].asc(), wide[R.COL_DATA_KIND].desc())


def experiment_training_report(
    events: DataFrame, cohorts: DataFrame, start: DateLike, end: DateLike, cohort_first: bool = True
) -> DataFrame:
    """Per arm and scene, user base, starters, completers and repeat rate.

    ``cohort_first``: see ``experiment.scene_member_rows``.
    """
    m = X.scene_metrics(events, cohorts, start, end, cohort_first).coalesce(1).sortWithinPartitions("group_order", "scene_order")
    return m.selectExpr(
        f"group_name AS {ident(R.COL_GROUP)}",
        f"scene AS {ident(R.COL_SCENE)}",
        f"user_base AS {ident(R.COL_USER_BASE)}",
        f"start_uv AS {ident(R.COL_START_UV)}",
        f"complete_uv AS {ident(R.COL_COMPLETE_UV)}",
        f"retrain_rate AS {ident(R.COL_RETRAIN_RATE)}",
    )
