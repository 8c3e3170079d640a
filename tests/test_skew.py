"""Hot keys: a user with many purchases reaches the renewal window as a bounded number of rows."""

from __future__ import annotations

from conftest import purchase

from cohortwise.operators import renewal as N

LINE, S, E = "健走", "2024-01-01", "2024-06-30"


def test_hot_user_day_collapses_before_the_window(purchases):
    # one user buys the same product on one day at 400 different amounts,
    # plus 200 exact copies of one of them
    hot = [purchase(user=7, date="2024-02-01", money=f"{i + 1}.00") for i in range(400)]
    hot += [purchase(user=7, date="2024-02-01", money="1.00")] * 200
    rows = hot + [purchase(user=7, date="2024-02-20", money="3.00")]
    flagged = N.inapp_flagged_days(purchases(rows), LINE, S, E).collect()
    by_day = {r.first_date.isoformat(): r for r in flagged}
    assert len(flagged) == 2  # one row per (key, day, first-pay flag, device)
    assert by_day["2024-02-01"].has_repay == 1
    assert float(by_day["2024-02-01"].origin_money) == sum(range(1, 401))  # distinct amounts, copies once


def test_hot_user_segment_gives_one_first_order(purchases):
    code = "webob_29.9d30-29.9d30"
    rows = [
        purchase(user=9, date=f"2024-03-{d:02d}", product=code, money=f"{m}.00", order_type="新增", ptype="会员")
        for d in range(1, 29)
        for m in range(1, 16)
    ]
    first = N.web_first_orders_with_renewals(purchases(rows), LINE, S, E).collect()
    assert len(first) == 1
    assert (first[0].first_date.isoformat(), float(first[0].origin_money)) == ("2024-03-01", 1.0)
