"""Renewal cohorts: first orders, renewal candidates, renewal flags, counts.

A base purchase on day d with window n is renewed when the same (event,
user, product) buys again in (d, d + n]. That is "the earliest renewal
after d is at most d + n", so the match runs as one window over rows
sorted by day inside each (event, user, product) partition, instead of an
interval join that would pair every base row with every later purchase of
its key. Before the window every input is reduced by aggregations that
combine map-side (renewal rows to one per key and day, in-app base rows to
one per key, day and cohort attributes, web first-order candidates to one
per segment, user, product and day), so even a user holding a third of all
purchases contributes a number of rows bounded by the days of the report
range, not by its purchases.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import rules as R
from ..functions.sqltext import all_of, case, lit
from ..sources.by_user import by_user
from ..sources.events import conform
from .params import DateLike, date_range, event_is_line_sql, in_renewal_range_sql

KEYS = ["event", "user_id", "product_id_all_product"]

INAPP_FLAG_KEYS = ["first_month", "user_id", "period_type", "is_first_purchase_withmoney", "device_type"]
WEB_SEGMENT_KEYS = ["event_cn", "first_month", "product_type_group", "product_period_type", "order_type"]


# --- D6 --------------------------------------------------------------------

def first_order_per_segment(base: DataFrame) -> DataFrame:
    """Earliest web base order per (line, month, group, plan, order type, user).

    Ties on (first_date, product) are broken by money so the result is
    fixed. ``row_number() = 1`` is planned with a partial WindowGroupLimit
    before the shuffle, which keeps one row per group and map task, so a
    hot user's rows are cut down before they move.
    """
    rn = (
        "row_number() OVER (PARTITION BY " + ", ".join([*WEB_SEGMENT_KEYS, "user_id"])
        + " ORDER BY first_date, product_id_all_product, origin_money) AS _rn"
    )
    return base.selectExpr("*", rn).where("_rn = 1").drop("_rn")


# --- D7 --------------------------------------------------------------------

def _renewal_filter(line: str, start: DateLike, end: DateLike, kind: str) -> str:
    if kind == "inapp":
        return all_of(
            [event_is_line_sql(line), in_renewal_range_sql(start, end, R.INAPP_MAX_WINDOW), C.inapp_row_filter_sql()]
        )
    if kind == "web":
        return all_of(
            [
                event_is_line_sql(line),
                in_renewal_range_sql(start, end, R.WEB_MAX_WINDOW),
                C.is_web_code_sql(),
                "product_is_subscribe = 1",
                f"all_product_order_type = {lit(R.ORDER_RENEW)}",
                C.web_entrance_allowed_sql(),
            ]
        )
    raise ValueError(f"unknown purchase kind {kind!r}")


def renewal_days(events: DataFrame, line: str, start: DateLike, end: DateLike, kind: str) -> DataFrame:
    """Distinct (event, user, product, repay_date) of possible renewals.

    For in-app rows a product without a plan can never match a base key, so
    those rows are dropped before the shuffle.
    """
    cond = _renewal_filter(line, start, end, kind)
    if kind == "inapp":
        cond = all_of([cond, f"{C.inapp_plan_sql()} IS NOT NULL"])
    return conform(events).where(cond).selectExpr(*KEYS, "date AS repay_date").distinct()


def renewal_candidates(events: DataFrame, base: DataFrame, line: str, start: DateLike, end: DateLike, kind: str) -> DataFrame:
    """Distinct later purchases by base customers of the same event, user, product.

    The keys of the base are distinct, so an inner join equals a semi-join;
    the candidate days are deduplicated before it. The key side grows with
    the paying users, so no broadcast is forced: adaptive execution
    broadcasts it only when its measured size is under the threshold.
    """
    keys = base.select(*KEYS).distinct()
    return renewal_days(events, line, start, end, kind).join(keys, KEYS, "left_semi")


@by_user
def renewal_candidates_one_read(events: DataFrame, line: str, start: DateLike, end: DateLike, kind: str, bucketed: bool = False) -> DataFrame:
    """D7 for the reports' own base rows, from one read of the events.

    Base keys are those of D1 (in-app) or of the first orders D6 (web). Base
    and renewal rows come tagged from one scan, reduced to a few rows per key
    and day; one window per key tells whether it has a base row. A NULL key
    matches nothing, as in a join.
    """
    if kind == "inapp":
        s, e = date_range(start, end)
        wanted = [
            event_is_line_sql(line),
            f"date >= {lit(s)} AND date <= {lit(e + dt.timedelta(days=R.INAPP_MAX_WINDOW))}",
            C.inapp_row_filter_sql(),
            f"{C.inapp_plan_sql()} IS NOT NULL",
        ]
        rows = conform(events).where(all_of(wanted)).selectExpr(*KEYS, "date").distinct()
        tagged = (rows if bucketed else rows.repartition("user_id")).selectExpr(
            *KEYS, "date", f"date <= {lit(e)} AS _cw_base", f"date > {lit(s)} AS _cw_renewal"
        )
    elif kind == "web":
        kept = _web_first_orders_and_renewals(events, line, start, end, bucketed)
        tagged = kept.selectExpr(*KEYS, "date", "_cw_first AS _cw_base", "NOT _cw_first AS _cw_renewal")
    else:
        raise ValueError(f"unknown purchase kind {kind!r}")
    known = all_of([f"{k} IS NOT NULL" for k in KEYS])
    matched = tagged.where(known).selectExpr("*", f"max(_cw_base) OVER (PARTITION BY {', '.join(KEYS)}) AS _cw_matched")
    return matched.where("_cw_matched AND _cw_renewal").selectExpr(*KEYS, "date AS repay_date").distinct()


# --- D8 --------------------------------------------------------------------

def _next_renewal_sql(is_renewal: str, day: str, alias: str = "_cw_next") -> str:
    """Earliest renewal day strictly after this row's day, within its key.

    A descending RANGE frame from the partition start to one day before the
    current row: Spark keeps one running minimum per partition, one pass.
    """
    return (
        f"min(CASE WHEN {is_renewal} THEN {day} END) OVER (PARTITION BY " + ", ".join(KEYS)
        + f" ORDER BY {day} DESC RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS {alias}"
    )


def _has_repay_sql(day: str, window: str) -> str:
    """1 if the next renewal falls in (day, day + window]; a NULL key never matches."""
    keys_known = " AND ".join(f"{k} IS NOT NULL" for k in KEYS)
    return (
        f"CASE WHEN {keys_known} AND _cw_next IS NOT NULL AND _cw_next <= {day} + {window} "
        "THEN 1 ELSE 0 END AS has_repay"
    )


def renewal_flags(
    base: DataFrame,
    renewals: DataFrame,
    group_cols: list[str],
    date_col: str = "first_date",
    window_col: str = "diff_days",
    repay_col: str = "repay_date",
    data_end: DateLike | None = None,
) -> DataFrame:
    """Per cohort row (``group_cols``), 1 if any of its base rows renewed.

    A renewal of a base row is a later purchase of the same (event, user,
    product) within (date, date + window]. Base rows are first reduced to
    distinct (group, key, day, window) rows: the flag depends on nothing
    else, and the reduction aggregates map-side, so a hot key contributes a
    number of rows bounded by its days, not by its purchases. Renewal days
    are expected distinct per key and day (``renewal_days``). One shuffle
    on (event, user, product) then feeds the window. Groups by money, which
    would let a key have a row for each of its amounts, take the flags of
    their key and day by a join instead.

    ``data_end`` (the last day with data) adds ``matured``: 1 if every
    window of the group closed by then, so that a 0 is final.
    """
    flags = ["has_repay", *(["matured"] if data_end is not None else [])]
    outcome = [F.expr(f"{'max' if c == 'has_repay' else 'min'}({c}) AS {c}") for c in flags]
    if "origin_money" in group_cols:
        days = [*KEYS, date_col, window_col]
        by_day = renewal_flags(base, renewals, days, date_col, window_col, repay_col, data_end)
        by_day = by_day.withColumnsRenamed({c: f"_cw_{c}" for c in days})
        same = all_of([f"{c} <=> _cw_{c}" for c in days])
        rows = base.select(*dict.fromkeys([*group_cols, *days])).join(by_day, F.expr(same))
        return rows.groupBy(*group_cols).agg(*outcome)
    cols = list(dict.fromkeys([*group_cols, *KEYS, date_col, window_col]))
    b = base.select(*cols).distinct().selectExpr(
        "*", f"unix_date({date_col}) AS _cw_day", "TRUE AS _cw_base", "FALSE AS _cw_renewal"
    )
    r = renewals.selectExpr(*KEYS, f"unix_date({repay_col}) AS _cw_day", "FALSE AS _cw_base", "TRUE AS _cw_renewal")
    both = b.unionByName(r, allowMissingColumns=True)
    flagged = both.selectExpr("*", _next_renewal_sql("_cw_renewal", "_cw_day")).where("_cw_base")
    values = [_has_repay_sql("_cw_day", window_col)]
    if data_end is not None:
        values.append(f"CASE WHEN _cw_day + {window_col} <= unix_date({lit(date_range(data_end, data_end)[0])}) THEN 1 ELSE 0 END AS matured")
    return flagged.selectExpr(*group_cols, *values).groupBy(*group_cols).agg(*outcome)


@by_user
def inapp_flagged_days(events: DataFrame, line: str, start: DateLike, end: DateLike, bucketed: bool = False) -> DataFrame:
    """In-app base purchases per (key, day, first-pay flag, device) with ``has_repay``.

    One scan of [s, e + 380]: in-app base and renewal purchases pass the
    same row predicates and differ only in date range, so each row is
    tagged as base (date <= e) and/or renewal candidate (date > s). Then
    (1) a distinct keeps the distinct base rows of D1 and one row per key
    and day for the rest (base-only columns nulled); (2) base rows are
    summed per (key, day, first-pay flag, device), so money variants
    collapse and every key keeps at most a few rows per day; (3) one
    window flags them, over a shuffle by user that the per-user counts of
    the report reuse. Both aggregations combine map-side before their
    shuffle. ``bucketed`` events are together by user already, and nothing
    here shuffles them. Output: event, first_month, user_id, product_id_all_product,
    is_first_purchase_withmoney, device_type, first_date, period_type,
    diff_days, origin_money (sum over the distinct base rows), has_repay.
    """
    s, e = date_range(start, end)
    in_base = f"date <= {lit(e)}"
    rows = conform(events).where(
        all_of(
            [
                event_is_line_sql(line),
                f"date >= {lit(s)} AND date <= {lit(e + dt.timedelta(days=R.INAPP_MAX_WINDOW))}",
                C.inapp_row_filter_sql(),
                f"{C.inapp_plan_sql()} IS NOT NULL",
            ]
        )
    )
    base_only = ("is_first_purchase_withmoney", "device_type", "origin_money")
    tagged = rows.selectExpr(
        *KEYS,
        "date",
        f"{in_base} AS _cw_base",
        f"date > {lit(s)} AS _cw_renewal",
        *[f"CASE WHEN {in_base} THEN {c} END AS {c}" for c in base_only],
    ).distinct()
    days = tagged.groupBy(*KEYS, "date", "_cw_base", "_cw_renewal", "is_first_purchase_withmoney", "device_type").agg(
        F.expr(f"{C.exact_sum_sql(tagged, 'origin_money')} AS origin_money")
    )
    window = C.inapp_window_days_sql("period_type")
    # hash on user_id alone satisfies both the window (event, user, product)
    # and the per-(month, segment, user) counts that follow, so one shuffle
    # serves both; after the per-day reduction a user's rows are bounded.
    together = days if bucketed else days.repartition("user_id")
    flagged = together.selectExpr("*", _next_renewal_sql("_cw_renewal", "unix_date(date)")).where("_cw_base")
    labeled = flagged.selectExpr("*", C.once({"period_type": C.inapp_plan_sql()}))
    return labeled.selectExpr(
        "event",
        f"{C.month_start_sql()} AS first_month",
        "user_id",
        "product_id_all_product",
        "is_first_purchase_withmoney",
        "device_type",
        "date AS first_date",
        "period_type",
        f"{window} AS diff_days",
        "origin_money",
        _has_repay_sql("unix_date(date)", window),
    )


def _web_first_orders_and_renewals(events: DataFrame, line: str, start: DateLike, end: DateLike, bucketed: bool = False) -> DataFrame:
    """Rows of D6 first orders (``_cw_first``) and of renewal days, from one scan, together by user.

    Web renewals (order type 续订) pass the base predicates too, over a
    longer range, so one scan of [s, e + 190] serves both roles. (1) A hash
    aggregate keeps one row, with the smallest amount, per key, day, order
    type and product group: all that label and order depend on. It combines
    map-side, so a hot user or order collapses before the shuffle and each
    user keeps a number of rows bounded by days and products; codes are
    parsed after it. (2) One shuffle by user, then each row is emitted once
    per role it has: as a first-order candidate (dated up to e and fully
    labeled) and as a renewal day (after s, 续订). Of the candidates the first
    order per segment and user stays (``row_number() = 1`` over date, product,
    money). All windows by user run on that shuffle; ``bucketed`` events are
    together by user already and need none.
    """
    from . import purchases as P

    s, e = date_range(start, end)
    in_base = f"date <= {lit(e)}"
    rows = conform(events).where(P.web_base_filter_sql(line, s, e + dt.timedelta(days=R.WEB_MAX_WINDOW)))
    reduced = (
        rows.selectExpr(*P.WEB_ROW_COLUMNS)
        .groupBy(*KEYS, "date", "order_type", "product_type_group")
        .agg(F.expr("min(coalesce(origin_money, 0)) AS origin_money"))
    )
    together = reduced if bucketed else reduced.repartition("user_id")
    parsed = together.selectExpr("*", P.WEB_CODE_PARTS)
    labeled = parsed.selectExpr(
        "date",
        f"{in_base} AS _cw_base",
        f"date > {lit(s)} AND order_type = {lit(R.ORDER_RENEW)} AS _cw_renewal",
        *P.web_label_columns(line),
    ).selectExpr("*", f"_cw_base AND {P.WEB_LABELED} AS _cw_cand", f"{C.web_window_days_sql()} AS diff_days")
    roles = (
        "CASE WHEN _cw_cand AND _cw_renewal THEN array(TRUE, FALSE) WHEN _cw_cand THEN array(TRUE) "
        "WHEN _cw_renewal THEN array(FALSE) END"
    )
    segment = ["event_cn", "first_month", "product_type_group", "product_period_type", "order_type"]
    first_only = [*segment, "window_days_raw", "diff_days", "origin_money"]
    keyed = labeled.where("_cw_cand OR _cw_renewal").selectExpr("*", f"explode({roles}) AS _cw_first").selectExpr(
        "_cw_first",
        *KEYS,
        "date",
        *[f"CASE WHEN _cw_first THEN {c} END AS {c}" for c in first_only],
    )
    rank = (
        "row_number() OVER (PARTITION BY _cw_first, user_id, " + ", ".join(segment)
        + " ORDER BY date, product_id_all_product, origin_money) AS _cw_rn"
    )
    return keyed.selectExpr("*", rank).where("NOT _cw_first OR _cw_rn = 1")


@by_user
def web_first_orders_with_renewals(events: DataFrame, line: str, start: DateLike, end: DateLike, bucketed: bool = False) -> DataFrame:
    """D6 first orders with ``has_repay``, from one scan and at most one shuffle by user.

    The renewal window runs on the rows of first orders and renewal days,
    which are together by user. Output: the D6 columns plus has_repay.
    """
    kept = _web_first_orders_and_renewals(events, line, start, end, bucketed)
    flagged = kept.selectExpr("*", _next_renewal_sql("NOT _cw_first", "unix_date(date)")).where("_cw_first")
    return flagged.selectExpr(
        "event",
        "event_cn",
        "first_month",
        "user_id",
        "product_id_all_product",
        "order_type",
        "product_type_group",
        "origin_money",
        "date AS first_date",
        "product_period_type",
        "window_days_raw",
        "diff_days",
        _has_repay_sql("unix_date(date)", "diff_days"),
    )


# --- D9, D11, D12 (in-app) ------------------------------------------------------

def inapp_segment_sql(plan: str = "period_type", first: str = "is_first_purchase_withmoney", device: str = "device_type") -> str:
    """Report column of an in-app cohort row; NULL when it has no column."""
    branches = []
    for column, plan_name, is_first, dev in R.INAPP_REPORT_COLUMNS:
        cond = f"{plan} = {lit(plan_name)} AND {first} = {is_first}"
        if dev is not None:
            cond += f" AND {device} = {lit(dev)}"
        branches.append((cond, lit(column)))
    return case(branches)


def _user_counts():
    return [
        F.expr("count(user_id) AS base_users"),
        F.expr("count(CASE WHEN has_repay = 1 THEN user_id END) AS repay_users"),
    ]


def inapp_renewal_users(flags: DataFrame) -> DataFrame:
    """Distinct base and renewed users per month and report segment.

    Two-level: one row per (month, segment, user) with any-renewal, then
    plain counts. Segment NULL rows keep months whose rows fall in no
    column. Output: first_month, segment, base_users, repay_users.
    """
    per_user = (
        flags.selectExpr("first_month", f"{inapp_segment_sql()} AS segment", "user_id", "has_repay")
        .groupBy("first_month", "segment", "user_id")
        .agg(F.expr("max(has_repay) AS has_repay"))
    )
    return per_user.groupBy("first_month", "segment").agg(*_user_counts())


def renewal_rate(users: DataFrame, places: int = 2) -> DataFrame:
    """Renewed / base users, half up to ``places``; NULL when base is 0."""
    return users.selectExpr("*", f"{C.rounded_ratio_sql('repay_users', 'base_users', places)} AS rate")


def inapp_revenue_base(base: DataFrame) -> DataFrame:
    """Money of the distinct in-app base rows per month and segment."""
    return (
        base.selectExpr("first_month", f"{inapp_segment_sql()} AS segment", "origin_money")
        .groupBy("first_month", "segment")
        .agg(F.expr(f"CAST({C.exact_sum_sql(base, 'origin_money')} AS DOUBLE) AS revenue"))
    )


def inapp_report_cells(flagged: DataFrame) -> DataFrame:
    """One row a month: base_<i>, repay_<i> users and money_<i> of each report column i.

    From base rows (or per-day sums of them, ``inapp_flagged_days``)
    carrying ``has_repay``: one row per (month, segment, user), then counts
    and sums straight by month. Equal to D9 and D12, pivoted.
    """
    per_user = (
        flagged.selectExpr("first_month", f"{inapp_segment_sql()} AS segment", "user_id", "has_repay", "origin_money")
        .groupBy("first_month", "segment", "user_id")
        .agg(F.expr("max(has_repay) AS has_repay"), F.expr(f"{C.exact_sum_sql(flagged, 'origin_money')} AS money"))
    )
    cells = []
    for i, (column, *_) in enumerate(R.INAPP_REPORT_COLUMNS):
        here = f"segment = {lit(column)}"
        cells += [
            F.expr(f"count(CASE WHEN {here} THEN user_id END) AS base_{i}"),
            F.expr(f"count(CASE WHEN {here} AND has_repay = 1 THEN user_id END) AS repay_{i}"),
            F.expr(f"sum(CASE WHEN {here} THEN money ELSE 0 END) AS money_{i}"),
        ]
    return per_user.groupBy("first_month").agg(*cells)


# --- D10, D13 (web) --------------------------------------------------------

def web_renewal_users(flags: DataFrame) -> DataFrame:
    """Distinct base and renewed users per line, month, group, plan, order type.

    ``flags`` holds one row per segment and user (D8 over first orders).
    """
    per_user = flags.groupBy(*WEB_SEGMENT_KEYS, "user_id").agg(F.expr("max(has_repay) AS has_repay"))
    return per_user.groupBy(*WEB_SEGMENT_KEYS).agg(*_user_counts())


def web_revenue_base(first_orders: DataFrame) -> DataFrame:
    """Money of the first orders per segment, rounded to whole units."""
    money = C.exact_sum_sql(first_orders, "origin_money")
    return first_orders.groupBy(*WEB_SEGMENT_KEYS).agg(F.expr(f"CAST(round({money}, 0) AS BIGINT) AS revenue_base"))


def web_cohort_cells(flagged_first_orders: DataFrame) -> DataFrame:
    """Users, renewed users and whole-unit money per web segment in one pass.

    From first orders carrying ``has_repay``; they are unique per (segment,
    user), so the counts need no second level. Equal to D10 and D13 over
    the same first orders.
    """
    money = C.exact_sum_sql(flagged_first_orders, "origin_money")
    return flagged_first_orders.groupBy(*WEB_SEGMENT_KEYS).agg(*_user_counts(), F.expr(f"CAST(round({money}, 0) AS BIGINT) AS revenue_base"))


def web_report_cells(flagged_first_orders: DataFrame) -> DataFrame:
    """One row per line, month and product group: base_<i>, repay_<i>, money_<i> of each report column i.

    Equal to ``web_cohort_cells``, pivoted.
    """
    cells = []
    for i, (_, plan, order_type) in enumerate(R.WEB_RENEWAL_REPORT_COLUMNS):
        here = f"product_period_type = {lit(plan)} AND order_type = {lit(order_type)}"
        cells += [
            F.expr(f"count(CASE WHEN {here} THEN user_id END) AS base_{i}"),
            F.expr(f"count(CASE WHEN {here} AND has_repay = 1 THEN user_id END) AS repay_{i}"),
            F.expr(f"CAST(round({C.exact_sum_sql(flagged_first_orders, 'origin_money', here)}, 0) AS BIGINT) AS money_{i}"),
        ]
    return flagged_first_orders.groupBy("event_cn", "first_month", "product_type_group").agg(*cells)
