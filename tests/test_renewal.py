"""Renewal flags: window edges, keys, NULLs, and window form vs interval join."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import SF01, purchase
from pyspark.sql import functions as F

from cohortwise.operators import purchases as P
from cohortwise.operators import renewal as N
from cohortwise.plans import reports as RP
from cohortwise.sources import fixtures as FX

LINE, S, E = "健走", "2024-01-01", "2024-06-30"


def _flags(purchases, rows):
    ev = purchases(rows)
    flagged = N.inapp_flagged_days(ev, LINE, S, E)
    out = {}
    for r in flagged.collect():
        key = (r.user_id, r.first_date.isoformat(), r.product_id_all_product)
        assert out.get(key, r.has_repay) == r.has_repay
        out[key] = r.has_repay
    return out


def test_window_edges(purchases):
    # monthly plan: 40-day window; base 01-01, renewal exactly at +40 counts
    got = _flags(
        purchases,
        [
            purchase(user=1, date="2024-01-01"),
            purchase(user=1, date="2024-02-10"),
            purchase(user=2, date="2024-01-01"),
            purchase(user=2, date="2024-02-11"),
        ],
    )
    assert got[(1, "2024-01-01", "vip.gold_1_month")] == 1
    assert got[(2, "2024-01-01", "vip.gold_1_month")] == 0
    # the renewal rows are base rows too (inside the range); nothing follows them
    assert got[(1, "2024-02-10", "vip.gold_1_month")] == 0


def test_same_day_and_other_product_do_not_count(purchases):
    got = _flags(
        purchases,
        [
            purchase(user=1, date="2024-03-01", money="10.00"),
            purchase(user=1, date="2024-03-01", money="12.00"),
            purchase(user=2, date="2024-03-01", product="vip.gold_1_month"),
            purchase(user=2, date="2024-03-05", product="vip.GoldYear"),
        ],
    )
    assert got[(1, "2024-03-01", "vip.gold_1_month")] == 0
    assert got[(2, "2024-03-01", "vip.gold_1_month")] == 0


def test_renewal_after_range_end_is_seen(purchases):
    # a base row at the range end sees renewals up to its own window
    got = _flags(purchases, [purchase(user=1, date="2024-06-30"), purchase(user=1, date="2024-07-20")])
    assert got[(1, "2024-06-30", "vip.gold_1_month")] == 1
    assert len(got) == 1


def test_null_user_never_matches(purchases):
    got = _flags(purchases, [purchase(user=None, date="2024-01-01"), purchase(user=None, date="2024-01-05")])
    assert set(got.values()) == {0}


def test_dropped_rows(purchases):
    rows = [
        purchase(user=1, product=None),
        purchase(user=2, distinct_id=None),
        purchase(user=3, device=None),
        purchase(user=4, device="Web"),
        purchase(user=5, money="0.00"),
        purchase(user=6, money=None),
        purchase(user=7, distinct_id="90451406"),
        purchase(user=8, product="webob_0d7-29.9d30"),
        purchase(user=9, subscribe=0),
        purchase(user=10, product="coins_pack_100"),
        purchase(user=11),
    ]
    base = P.inapp_base_orders(purchases(rows), LINE, S, E)
    assert [r.user_id for r in base.collect()] == [11]


def test_unknown_line_gives_no_rows(purchases):
    assert P.inapp_base_orders(purchases([purchase()]), "unknown", S, E).count() == 0


def _brute_force(base_rows, renew_rows):
    """Interval join in Python: any renewal of the key in (d, d + n]."""
    by_key = {}
    for r in renew_rows:
        by_key.setdefault((r.event, r.user_id, r.product_id_all_product), set()).add(r.repay_date)
    out = {}
    for b in base_rows:
        key = (b.event, b.user_id, b.product_id_all_product)
        days = by_key.get(key, set()) if b.user_id is not None else set()
        hit = any(b.first_date < d <= b.first_date + dt.timedelta(days=b.diff_days) for d in days)
        out[tuple(b[c] for c in b.__fields__ if c not in ("has_repay",))] = int(hit)
    return out


@pytest.mark.parametrize("kind", ["inapp", "web"])
def test_window_form_equals_interval_join(spark, kind):
    ev = FX.load_purchase_events(spark, SF01)
    base = P.inapp_base_orders(ev, LINE, S, E) if kind == "inapp" else RP.web_first_orders(ev, LINE, S, E)
    renewals = N.renewal_candidates(ev, base, LINE, S, E, kind)
    flagged = N.renewal_flags(base, N.renewal_days(ev, LINE, S, E, kind), base.columns).collect()
    want = _brute_force(base.collect(), renewals.collect())
    got = {tuple(r[c] for c in r.__fields__ if c != "has_repay"): r.has_repay for r in flagged}
    assert got == want
    assert 0 < sum(got.values()) < len(got)


def test_one_scan_inapp_path_equals_operators(spark):
    ev = FX.load_purchase_events(spark, SF01)
    keys = ["event", "user_id", "product_id_all_product", "first_date", "is_first_purchase_withmoney", "device_type"]
    one = N.inapp_flagged_days(ev, LINE, S, E).groupBy(*keys).agg(
        F.expr("max(has_repay) AS has_repay"), F.expr("sum(origin_money) AS money")
    )
    base = P.inapp_base_orders(ev, LINE, S, E)
    flags = N.renewal_flags(base, N.renewal_days(ev, LINE, S, E, "inapp"), keys)
    money = {tuple(r[c] for c in keys): r.money for r in base.groupBy(*keys).agg(F.expr("sum(origin_money) AS money")).collect()}
    two = {tuple(r[c] for c in keys): (r.has_repay, money[tuple(r[c] for c in keys)]) for r in flags.collect()}
    got = {tuple(r[c] for c in keys): (r.has_repay, r.money) for r in one.collect()}
    assert got == two and len(got) > 100


def test_one_scan_web_path_equals_operators(spark):
    ev = FX.load_purchase_events(spark, SF01)
    one = {tuple(r) for r in N.web_first_orders_with_renewals(ev, LINE, S, E).collect()}
    first = RP.web_first_orders(ev, LINE, S, E)
    flags = N.renewal_flags(first, N.renewal_days(ev, LINE, S, E, "web"), first.columns)
    two = {tuple(r) for r in flags.select(*first.columns, "has_repay").collect()}
    assert one == two and len(one) > 100


def test_renewed_never_exceeds_base(spark):
    ev = FX.load_purchase_events(spark, SF01)
    cells = N.inapp_report_cells(N.inapp_flagged_days(ev, LINE, S, E)).collect()
    assert cells and all(c[f"repay_{i}"] <= c[f"base_{i}"] for c in cells for i in range(10))


def test_flags_by_money_equal_flags_per_base_row(spark):
    ev = FX.load_purchase_events(spark, SF01)
    base, days = P.inapp_base_orders(ev, LINE, S, E), N.renewal_days(ev, LINE, S, E, "inapp")
    got = {tuple(r) for r in N.renewal_flags(base, days, base.columns, data_end="2024-12-31").select(*base.columns, "has_repay", "matured").collect()}
    bought = {}
    for r in days.collect():
        bought.setdefault((r.event, r.user_id, r.product_id_all_product), []).append(r.repay_date)
    want = set()
    for r in base.collect():
        end = r.first_date + dt.timedelta(days=r.diff_days)
        key = (r.event, r.user_id, r.product_id_all_product)
        renewed = None not in key and any(r.first_date < d <= end for d in bought.get(key, []))
        want.add((*r, int(renewed), int(end <= dt.date(2024, 12, 31))))
    assert got == want and {w[-1] for w in want} == {0, 1}


def test_first_order_tie_broken_by_money(purchases):
    rows = [
        purchase(user=1, date="2024-02-03", product="webob_0d7-29.9d30", money="5.00", ptype="会员", order_type="新增"),
        purchase(user=1, date="2024-02-03", product="webob_0d7-29.9d30", money="3.00", ptype="会员", order_type="新增"),
        purchase(user=1, date="2024-02-09", product="webob_0d7-29.9d30", money="1.00", ptype="会员", order_type="新增"),
    ]
    first = RP.web_first_orders(purchases(rows), LINE, S, E).collect()
    assert len(first) == 1
    assert (first[0].first_date.isoformat(), str(first[0].origin_money)) == ("2024-02-03", "3.00")
