"""Report shapes on hand-made rows: empty cells, labels, month rows, sort order."""

from __future__ import annotations

from conftest import purchase

from cohortwise.functions import rules as R
from cohortwise.plans import reports as RP

LINE, S, E = "健走", "2024-01-01", "2024-06-30"


def _rows(df):
    return [r.asDict() for r in df.collect()]


def test_empty_cells_per_report(purchases):
    ev = purchases(
        [
            # in-app: one monthly first-pay purchase renewed within 40 days
            purchase(user=1, date="2024-01-05", product="vip.gold_1_month", money="9.90", first=1),
            purchase(user=1, date="2024-02-01", product="vip.gold_1_month", money="9.90", first=1),
            # in-app row with NULL first-pay flag: no column, but its month appears
            purchase(user=2, date="2024-03-03", product="vip.gold_1_month", money="5.00", first=None),
            # web: one member order on a 30-day plan, new
            purchase(user=3, date="2024-01-10", product="webob_29.9d30-29.9d30", money="29.90", order_id=11,
                     ptype="会员", order_type="新增", entrance=None),
        ]
    )
    r1 = _rows(RP.inapp_renewal_report(ev, LINE, S, E))
    rate = {r[R.COL_BASE_MONTH].isoformat(): r for r in r1 if r[R.COL_METRIC_KIND] == R.METRIC_RATE}
    money = {r[R.COL_BASE_MONTH].isoformat(): r for r in r1 if r[R.COL_METRIC_KIND] == R.METRIC_REVENUE_BASE}
    assert set(rate) == {"2024-01-01", "2024-02-01", "2024-03-01"}
    assert rate["2024-01-01"]["月_首付"] == 1.0 and rate["2024-02-01"]["月_首付"] == 0.0
    assert rate["2024-01-01"]["季_首付"] is None  # no base users: NULL rate
    assert all(v is None for k, v in rate["2024-03-01"].items() if k not in (R.COL_METRIC_KIND, R.COL_BASE_MONTH))
    assert money["2024-01-01"]["月_首付"] == 9.9 and money["2024-01-01"]["年_首付_ios"] == 0.0  # empty revenue is 0
    assert [r[R.COL_METRIC_KIND] for r in r1] == [R.METRIC_RATE] * 3 + [R.METRIC_REVENUE_BASE] * 3

    r3 = _rows(RP.web_arppu_report(ev, LINE, S, E))
    assert len(r3) == 1 and r3[0][R.COL_ORDER_TYPE] == R.ORDER_NEW
    assert r3[0]["【会员】月"] == 29.9 and r3[0]["【会员】季"] is None  # empty ARPPU is NULL

    r4 = _rows(RP.web_new_sales_report(ev, LINE, S, E))
    assert [r[R.COL_DATA_KIND] for r in r4] == [R.METRIC_SALES, R.METRIC_ORDERS]  # descending kind
    assert r4[0]["【会员】月"] == 29.9 and r4[1]["【会员】月"] == 1.0
    assert r4[0]["【会员】季"] == 0.0 and r4[1]["【会员】季"] == 0.0  # empty sales and counts are 0

    r2 = _rows(RP.web_renewal_report(ev, LINE, S, E))
    assert {r[R.COL_METRIC_KIND] for r in r2} == {R.METRIC_RATE, R.METRIC_REVENUE_BASE}
    for r in r2:
        assert r["月_续订"] is None  # no renewal-type first orders: NULL cells
    rate2 = [r for r in r2 if r[R.COL_METRIC_KIND] == R.METRIC_RATE][0]
    assert rate2["月_新增"] == 0.0 and rate2[R.COL_PRODUCT_TYPE] == R.GROUP_MEMBER and rate2[R.COL_LINE] == LINE


def test_web_entrance_and_order_type_rules(purchases):
    rows = [
        purchase(user=1, date="2024-01-10", product="webob_29.9d30-29.9d30", order_id=1, order_type="新增", entrance=None),
        purchase(user=2, date="2024-01-10", product="webob_29.9d30-29.9d30", order_id=2, order_type="新增", entrance="75"),
        purchase(user=3, date="2024-01-10", product="webob_29.9d30-29.9d30", order_id=3, order_type="升级"),
        purchase(user=4, date="2024-01-10", product="webob_29.9d30-29.9d30", order_id=4, order_type="续订", entrance="10001"),
    ]
    r3 = _rows(RP.web_arppu_report(purchases(rows), LINE, S, E))
    assert sorted(r[R.COL_ORDER_TYPE] for r in r3) == [R.ORDER_NEW, R.ORDER_RENEW]
    r4 = _rows(RP.web_new_sales_report(purchases(rows), LINE, S, E))
    assert [r["【会员】月"] for r in r4 if r[R.COL_DATA_KIND] == R.METRIC_ORDERS] == [1.0]


def test_unknown_line_gives_empty_reports(purchases):
    ev = purchases([purchase(user=1, date="2024-01-05"), purchase(user=1, date="2024-02-01")])
    for report in (RP.inapp_renewal_report, RP.web_renewal_report, RP.web_arppu_report, RP.web_new_sales_report):
        assert report(ev, "未知", S, E).count() == 0


def test_inverted_range_fails_before_any_job(purchases):
    import pytest

    ev = purchases([purchase()])
    with pytest.raises(ValueError):
        RP.inapp_renewal_report(ev, LINE, "2024-06-30", "2024-01-01")
    with pytest.raises(ValueError):
        RP.web_new_sales_report(ev, LINE, "2024-13-01", "2024-12-31")


def test_other_lines_use_their_own_event(purchases):
    rows = [
        purchase(user=1, date="2024-01-05", event="purchase_vip_order_h2o"),
        purchase(user=2, date="2024-01-05", event="purchase_vip_order_wup_h2o"),
    ]
    r1 = RP.inapp_renewal_report(purchases(rows), "瑜伽", S, E).collect()
    money = [r for r in r1 if r[R.COL_METRIC_KIND] == R.METRIC_REVENUE_BASE]
    assert len(money) == 1 and money[0]["月_首付"] == 10.0
