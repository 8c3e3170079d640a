"""Operators on hand-made rows: plan and group mixes, cohort groups."""

from __future__ import annotations

from conftest import purchase

from cohortwise.functions import rules as R
from cohortwise.operators import experiment as X
from cohortwise.operators import purchases as P

LINE, S, E = "健走", "2024-01-01", "2024-06-30"


def test_inapp_plan_mix_keeps_unmatched_codes(purchases):
    rows = [
        purchase(user=1, product="vip.gold_1_month"),
        purchase(user=1, product="vip.gold_1_month", date="2024-01-11"),
        purchase(user=2, product="coins_pack_100"),
        purchase(user=3, product="coins_pack_100"),
    ]
    got = {r.period_type: (r.purchases, r.users) for r in P.inapp_plan_mix(purchases(rows), LINE, S, E).collect()}
    assert got == {"月": (2, 1), None: (2, 2)}


def test_product_group_mix_drops_unclassified_and_counts_orders_once(purchases):
    web = "webob_29.9d30-29.9d30"
    rows = [
        purchase(user=1, product=web, order_id=1, money="10.00", ptype="会员"),
        purchase(user=1, product=web, order_id=1, money="10.00", ptype="会员"),  # exact copy: once
        purchase(user=1, product=web, order_id=1, money="11.00", ptype="会员"),  # other amount: adds, counts once
        purchase(user=2, product=web, order_id=2, money="5.00", ptype="增值", double_extra="二级增值"),
        purchase(user=3, product=web, order_id=3, money="7.00", ptype=None, double_extra=None),  # no group
    ]
    got = {r.product_type_group: (r.orders, r.revenue) for r in P.web_product_group_mix(purchases(rows), LINE, S, E).collect()}
    assert got == {R.GROUP_MEMBER: (1, 21.0), R.GROUP_EXTRA2: (1, 5.0)}


def test_plan_mix_separates_unparseable_from_unclassified(purchases):
    rows = [
        purchase(user=1, product="webob_special", order_id=1),
        purchase(user=2, product="webob_5d60-5d60", order_id=2),
        purchase(user=3, product="webob_0d7-29.9d30", order_id=3),
    ]
    got = {(r.renewal_plan, r.period_group, r.code_parsed): r.orders for r in P.web_plan_mix(purchases(rows), LINE, S, E).collect()}
    assert got == {(None, None, 0): 1, (None, None, 1): 1, ("0元7天-月", "0元7天-月", 1): 1}


def test_experiment_groups_count_distinct_members(cohort_df):
    rows = [(R.GROUP_EXPERIMENT, 1), (R.GROUP_EXPERIMENT, 1), (R.GROUP_EXPERIMENT, None), (R.GROUP_CONTROL, 2)]
    got = {r.group_name: (r.user_base, r.group_order) for r in X.experiment_groups(cohort_df(rows)).collect()}
    assert got == {R.GROUP_EXPERIMENT: (1, 1), R.GROUP_CONTROL: (1, 2)}
