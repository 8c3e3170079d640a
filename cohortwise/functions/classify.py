"""Per-row rules as Spark SQL expressions.

Each rule is a ``*_sql`` function returning SQL text over column names,
composable into bigger expressions and handed to Spark with ``selectExpr``,
``where`` or ``F.expr``. Everything runs JVM-side inside whole-stage
codegen; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import rules as R
from .sqltext import all_of, case, in_list, lit, map_lookup

PRODUCT = "product_id_all_product"


# --- in-app ----------------------------------------------------------------

def inapp_plan_sql(product: str = PRODUCT) -> str:
    """Plan period of an in-app product code (年/半年/季/月), NULL if none."""
    return case([(f"{product} RLIKE {lit('(?i)' + pattern)}", lit(plan)) for plan, pattern, _ in R.INAPP_PLANS])


def inapp_window_days_sql(plan: str = "period_type") -> str:
    """Renewal observation window of an in-app plan, NULL for no plan."""
    return case([(f"{plan} = {lit(name)}", lit(days)) for name, _, days in R.INAPP_PLANS])


def is_web_code_sql(product: str = PRODUCT) -> str:
    """Case-sensitive substring test; NULL product gives NULL (row dropped)."""
    return f"contains({product}, {lit(R.WEB_MARKER)})"


def inapp_row_filter_sql() -> str:
    """Row predicates shared by in-app base and renewal purchases."""
    return all_of(
        [
            f"NOT {is_web_code_sql()}",
            "origin_money > 0",
            "product_is_subscribe = 1",
            f"distinct_id != {lit(R.INAPP_TEST_DISTINCT_ID)}",
            in_list("device_type", R.INAPP_DEVICES),
        ]
    )


# --- web -------------------------------------------------------------------

def web_code_part_sql(group: int, typ: str, product: str = PRODUCT) -> str:
    """One group of the web product code, cast; NULL if the code does not parse."""
    return f"try_cast(regexp_extract({product}, {lit(R.WEB_CODE_PATTERN)}, {group}) AS {typ})"


def web_first_price_sql(product: str = PRODUCT) -> str:
    return web_code_part_sql(1, "DOUBLE", product)


def web_first_days_sql(product: str = PRODUCT) -> str:
    return web_code_part_sql(2, "INT", product)


def web_renew_days_sql(product: str = PRODUCT) -> str:
    return web_code_part_sql(4, "INT", product)


def web_product_group_sql(
    double_extra: str = "webob_product_type_is_double_extra",
    product_type: str = "webob_product_type",
) -> str:
    """会员 / 一级增值 / 二级增值, first match wins; NULL drops the row."""
    return case(
        [
            (f"{double_extra} = {lit(R.RAW_DOUBLE_EXTRA)}", lit(R.GROUP_EXTRA2)),
            (
                f"{double_extra} = {lit(R.RAW_NOT_DOUBLE_EXTRA)} AND {product_type} = {lit(R.RAW_TYPE_EXTRA)}",
                lit(R.GROUP_EXTRA1),
            ),
            (f"{product_type} = {lit(R.RAW_TYPE_MEMBER)}", lit(R.GROUP_MEMBER)),
        ]
    )


def web_plan_sql(
    price: str = "first_price", first_days: str = "first_days", renew_days: str = "renew_days", label_set: str = "renewal"
) -> str:
    """Web plan label from parsed code parts, first match wins, NULL if no rule matches.

    ``label_set='renewal'`` gives the renewal-report labels, ``'sales'`` the
    ARPPU / sales-report labels.
    """
    if label_set not in ("renewal", "sales"):
        raise ValueError(f"unknown label set {label_set!r}")
    branches = []
    for renewal_label, sales_label, price_rule, firsts, renews in R.WEB_PLANS:
        tests = [in_list(first_days, firsts), in_list(renew_days, renews)]
        if price_rule == "zero":
            tests.insert(0, f"{price} = 0")
        elif price_rule == "positive" and label_set == "sales":
            tests.insert(0, f"{price} > 0")
        branches.append((all_of(tests), lit(renewal_label if label_set == "renewal" else sales_label)))
    return case(branches)


def web_window_days_raw_sql(order_type: str = "order_type", first_days: str = "first_days", renew_days: str = "renew_days") -> str:
    """New orders watch the first period, renewals the renewal period."""
    return case([(f"{order_type} = {lit(R.ORDER_NEW)}", first_days), (f"{order_type} = {lit(R.ORDER_RENEW)}", renew_days)])


def web_window_days_sql(raw: str = "window_days_raw") -> str:
    table = {raw_days: days for raws, days in R.WEB_WINDOW_DAYS for raw_days in raws}
    return map_lookup(table, raw)


def web_entrance_allowed_sql(entrance: str = "purchase_entrance_all_product") -> str:
    """NULL entrance is kept; listed entrances are excluded."""
    return f"({entrance} IS NULL OR NOT {in_list(entrance, R.WEB_EXCLUDED_ENTRANCES)})"


# --- generic ---------------------------------------------------------------

def month_start_sql(d: str = "date") -> str:
    """First day of the month, as DATE."""
    return f"trunc({d}, 'MM')"


def half_up_div_sql(num: str, den: str) -> str:
    """Exact integer num / den rounded half away from zero (den > 0).

    Long arithmetic, sign(n) * floor((2|n| + d) / 2d); avoids the double
    rounding of decimal or floating division.
    """
    n, d = f"CAST({num} AS BIGINT)", f"CAST({den} AS BIGINT)"
    return f"CAST(sign({n}) * ((abs({n}) * 2 + {d}) div (2 * {d})) AS BIGINT)"


def rounded_ratio_sql(num: str, den: str, places: int) -> str:
    """round(num / den, places) for integers as DOUBLE; NULL when den <= 0."""
    scale = 10**places
    return f"CASE WHEN {den} > 0 THEN {half_up_div_sql(f'CAST({num} AS BIGINT) * {scale}', den)} / {scale}.0D END"


#: Floating money is counted in these units: 8 places, up to 22 digits before the point.
EXACT_MONEY = "DECIMAL(30, 8)"


def exact_sum_sql(df: DataFrame, money: str, condition: str | None = None) -> str:
    """sum(money) that does not depend on the order of rows.

    A sum of DOUBLE or FLOAT rounds at each addition, so another partitioning
    gives other last digits, and another rounded ratio. Such money is cast to
    a fixed decimal (half up at the 8th place) before it is added; NaN and
    amounts beyond its range are refused with an error. Decimals and whole
    numbers add up exactly as they are.
    """
    value = money
    if isinstance(df.schema[money].dataType, (T.DoubleType, T.FloatType)):
        refused = f"raise_error(concat('money that no {EXACT_MONEY} holds: ', {money}))"
        value = f"CASE WHEN isnan({money}) OR abs({money}) >= 1e22 THEN CAST({refused} AS {EXACT_MONEY}) ELSE CAST({money} AS {EXACT_MONEY}) END"
    return f"sum({value})" if condition is None else f"sum(CASE WHEN {condition} THEN {value} END)"


def rounded_money_ratio_sql(money: str, den: str) -> str:
    """round(money / den, 2), half away from zero, as DOUBLE; NULL when den <= 0.

    ``money`` is a sum of any numeric type; it counts to 8 places, and the
    division is one of whole numbers, so nothing is rounded twice.
    """
    n = f"CAST(CAST({money} AS DECIMAL(30, 8)) * 100000000 AS DECIMAL(38, 0))"
    d = f"CAST({den} AS DECIMAL(20, 0))"
    cents = f"CAST((abs({n}) * 200 + {d} * 100000000) div ({d} * 200000000) AS BIGINT)"
    return f"CASE WHEN {den} > 0 THEN CAST(sign({n}) AS BIGINT) * {cents} / 100.0D END"


def once(columns: dict[str, str]) -> str:
    """Columns (name -> SQL) computed once a row, as one generated row.

    Catalyst copies the expressions of a projection into every filter and
    projection above that uses them; a generator's outputs are not copied.
    """
    return "inline(array(struct(" + ", ".join(f"{sql} AS {name}" for name, sql in columns.items()) + ")))"
