"""Randomised properties: window-form renewal flags equal a brute-force interval join."""

from __future__ import annotations

import datetime as dt

from conftest import purchase
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cohortwise.functions import rules as R
from cohortwise.operators import purchases as P
from cohortwise.operators import renewal as N

LINE, S, E = "健走", "2024-01-01", "2024-03-31"
CODES = ["vip.gold_1_month", "vip.3_month.v2", "vip.GoldYear", "vip_180_day", "coins_pack_100"]
WINDOW = {plan: days for plan, _, days in R.INAPP_PLANS}
PLAN_OF = {"vip.gold_1_month": "月", "vip.3_month.v2": "季", "vip.GoldYear": "年", "vip_180_day": "半年"}

rows_strategy = st.lists(
    st.tuples(
        st.sampled_from([1, 2, None]),
        st.integers(min_value=-5, max_value=140),
        st.sampled_from(CODES),
        st.sampled_from(["1.00", "2.00"]),
    ),
    min_size=1,
    max_size=25,
)


def brute(rows):
    start, end = dt.date.fromisoformat(S), dt.date.fromisoformat(E)
    base = {(u, d, c, m) for u, d, c, m in rows if start <= d <= end and c in PLAN_OF}
    out = {}
    for u, d, c, m in base:
        n = WINDOW[PLAN_OF[c]]
        hit = u is not None and any(
            u2 == u and c2 == c and d < d2 <= d + dt.timedelta(days=n) and start < d2 <= end + dt.timedelta(days=380)
            for u2, d2, c2, _ in rows
        )
        out[(u, d, c, m)] = int(hit)
    return out


@settings(max_examples=12, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(rows_strategy)
def test_flags_equal_brute_force(purchases, raw):
    base_day = dt.date.fromisoformat(S)
    rows = [(u, base_day + dt.timedelta(days=k), c, m) for u, k, c, m in raw]
    ev = purchases([purchase(user=u, date=d.isoformat(), product=c, money=m) for u, d, c, m in rows])
    want = {}
    for (u, d, c, m), hit in brute(rows).items():
        want[(u, d, c)] = max(want.get((u, d, c), 0), hit)
    one = N.inapp_flagged_days(ev, LINE, S, E).collect()
    got = {(r.user_id, r.first_date, r.product_id_all_product): r.has_repay for r in one}
    assert got == want
    base = P.inapp_base_orders(ev, LINE, S, E)
    two = N.renewal_flags(base, N.renewal_days(ev, LINE, S, E, "inapp"), base.columns).collect()
    per_row = {(r.user_id, r.first_date, r.product_id_all_product, f"{r.origin_money:.2f}"): r.has_repay for r in two}
    assert per_row == brute(rows)


def test_exact_duplicates_change_no_purchase_report(spark):
    """R1-R4 count distinct rows, users and orders: duplicating rows changes nothing."""
    from conftest import SF01

    from cohortwise.plans import reports as RP
    from cohortwise.sources import fixtures as FX

    ev = FX.load_purchase_events(spark, SF01)
    doubled = ev.unionByName(ev.where("pmod(user_id, 3) = 0"))
    for report in (RP.inapp_renewal_report, RP.web_renewal_report, RP.web_arppu_report, RP.web_new_sales_report):
        a = {tuple(r) for r in report(ev, LINE, "2024-01-01", "2024-06-30").collect()}
        b = {tuple(r) for r in report(doubled, LINE, "2024-01-01", "2024-06-30").collect()}
        assert a == b, report.__name__


def test_wide_sales_equal_long_totals(spark):
    from conftest import SF01

    from cohortwise.functions import rules as RR
    from cohortwise.operators import revenue as V
    from cohortwise.plans import reports as RP
    from cohortwise.sources import fixtures as FX

    ev = FX.load_purchase_events(spark, SF01)
    listed = {(g, p) for _, g, p in RR.WEB_SALES_REPORT_COLUMNS}
    long = [r for r in V.web_new_sales(ev, LINE, "2024-01-01", "2024-06-30").collect() if (r.product_type_group, r.period_group) in listed]
    wide = RP.web_new_sales_report(ev, LINE, "2024-01-01", "2024-06-30").collect()
    cols = [c for c, _, _ in RR.WEB_SALES_REPORT_COLUMNS]
    wide_orders = sum(sum(r[c] for c in cols) for r in wide if r[0] == RR.METRIC_ORDERS)
    wide_sales = sum(sum(r[c] for c in cols) for r in wide if r[0] == RR.METRIC_SALES)
    assert wide_orders == sum(r.orders for r in long)
    assert abs(wide_sales - sum(r.revenue for r in long)) < 1e-6 * max(1.0, wide_sales)


WEB_CODES = ["webob_0d7-29.9d30", "webob_29.9d30-29.9d30", "webob_19.9d14-19.9d14", "webob_special"]
web_rows_strategy = st.lists(
    st.tuples(
        st.sampled_from([1, 2, None]),
        st.integers(min_value=-3, max_value=120),
        st.sampled_from(WEB_CODES),
        st.sampled_from(["新增", "续订", "升级"]),
        st.sampled_from(["1.00", "2.00", None]),
        st.sampled_from([("会员", None), ("增值", "非二级增值"), ("增值", "二级增值"), (None, None)]),
        st.sampled_from([None, "75", "10001"]),
    ),
    min_size=1,
    max_size=25,
)


@settings(max_examples=10, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(web_rows_strategy)
def test_web_one_scan_equals_operators(purchases, raw):
    from cohortwise.plans import reports as RP

    base_day = dt.date.fromisoformat(S)
    ev = purchases(
        [
            purchase(user=u, date=(base_day + dt.timedelta(days=k)).isoformat(), product=c, order_type=o, money=m,
                     ptype=pt, double_extra=de, entrance=en, order_id=i)
            for i, (u, k, c, o, m, (pt, de), en) in enumerate(raw)
        ]
    )
    one = {tuple(r) for r in N.web_first_orders_with_renewals(ev, LINE, S, E).collect()}
    first = RP.web_first_orders(ev, LINE, S, E)
    flags = N.renewal_flags(first, N.renewal_days(ev, LINE, S, E, "web"), first.columns)
    two = {tuple(r) for r in flags.select(*first.columns, "has_repay").collect()}
    assert one == two
