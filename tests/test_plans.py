"""Plan shape: scans per report, no Python, no all-pairs joins, pushdown."""

from __future__ import annotations

import tempfile

import pytest
from conftest import SF001

from cohortwise.plans import inspect
from cohortwise.plans.registry import QUERIES, REPORTS
from cohortwise.plans import reports as RP
from cohortwise.sources import events as EVS
from cohortwise.sources import fixtures as FX


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_python_and_no_pairs(spark, name):
    df = QUERIES[name](spark, SF001)
    assert inspect.python_nodes(df) == []
    assert inspect.pair_nodes(df) == []


# reads of the source table by each key: more than one where the key joins two uses of it
SCANS = {
    "first_order_per_segment": 1,
    "renewal_candidates": 1,
    "renewal_flags": 2,
    "renewal_flags_matured": 2,
    "web_renewal_candidates": 1,
    "web_renewal_flags": 2,
    # two half ranges
    "inapp_renewal_users_merged": 2,
    "web_renewal_users_merged": 2,
    "inapp_renewal_users_total": 2,
}
# all reads of keys over written tables: the two parts of a layout by user, the two lists (each for the semi-join and the grid)
WRITTEN = {
    "inapp_renewal_report_by_user": 2,
    "web_renewal_report_by_user": 2,
    "experiment_training_report_by_user": 5,
    "cohort_lists": 2,
    "experiment_training_report_from_lists": 5,
}
# bitmaps are no fixed-width aggregates: built by sorting rows that are reduced to one a user
BITMAPS = {"inapp_renewal_users_merged", "web_renewal_users_merged", "inapp_renewal_users_total"}
COHORT_ONLY = {"experiment_groups": 1}
FUNNEL = {
    "scene_user_activity", "exposure_base", "filter_funnel_users", "scene_uv", "repeat_users", "dense_scene_grid", "experiment_training_report",
    "experiment_training_report_ordered",
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_scans_per_key(spark, name):
    df = QUERIES[name](spark, SF001)
    if name in WRITTEN:
        assert inspect.scan_count(df) == WRITTEN[name]
    elif name in COHORT_ONLY:
        assert inspect.scan_count(df, "events") == 1
    elif name in FUNNEL:
        # one of the training events; the cohort lists, derived from the same file here, are read for the semi-join and the grid
        plan = inspect.physical_plan(df)
        scans = [x for x in plan.splitlines() if "FileScan parquet" in x]
        assert len(scans) == 3 and len([x for x in scans if "event_id" in x]) == 1
    else:
        assert inspect.scan_count(df, "orders") == SCANS.get(name, 1)


@pytest.mark.parametrize("name", sorted(FUNNEL))
def test_cohort_is_applied_below_the_first_aggregate(spark, name):
    lines = inspect.physical_plan(QUERIES[name](spark, SF001)).splitlines()
    semi = next(i for i, x in enumerate(lines) if "LeftSemi" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    above = [x for x in lines[:semi] if "HashAggregate" in x and depth(x) < depth(lines[semi])]
    assert any("count_if" in x or "max(" in x or "count(" in x for x in above)
    # the side of the events holds no aggregate: raw rows meet the members
    event_scan = next(i for i, x in enumerate(lines) if "FileScan" in x and "event_id" in x)
    assert not any("HashAggregate" in x for x in lines[semi:event_scan])


def _nodes(spark, name):
    """(depth, node) lines of the physical plan, from the last step down."""
    return inspect.physical_plan(QUERIES[name](spark, SF001)).splitlines()


def test_web_codes_are_parsed_once_after_the_reduction(spark):
    lines = _nodes(spark, "web_renewal_report")
    first_exchange = max(i for i, x in enumerate(lines) if "Exchange hashpartitioning" in x)
    assert sum(x.count("regexp_extract(") for x in lines[first_exchange:]) == 0
    assert sum(x.count("regexp_extract(") for x in lines[:first_exchange]) == 3


@pytest.mark.parametrize("name", ["inapp_renewal_report", "inapp_base_orders"])
def test_plan_rules_run_once_above_the_distinct(spark, name):
    lines = _nodes(spark, name)
    first_exchange = max(i for i, x in enumerate(lines) if "Exchange hashpartitioning" in x)
    assert sum(x.count("RLIKE") for x in lines[first_exchange:]) <= 4
    assert sum(x.count("RLIKE") for x in lines[:first_exchange]) == 4


def test_filters_reach_a_partitioned_event_table(spark):
    path = tempfile.mkdtemp(prefix="cohortwise-events-") + "/purchase_events"
    EVS.write_events(FX.load_purchase_events(spark, SF001), path)
    ev = EVS.read_events(spark, path)
    plan = inspect.formatted_plan(RP.web_new_sales_report(ev, "健走", "2024-01-01", "2024-06-30"))
    assert "PartitionFilters: [isnotnull(date" in plan and "(date#" in plan
    assert "EqualTo(event,purchase_vip_order_wup_h2o)" in plan
    assert "StringContains(product_id_all_product,webob)" in plan
    # column pruning: the wide table's unused columns are not read
    read_schema = [line for line in plan.splitlines() if line.startswith("ReadSchema")]
    assert read_schema and all("device_type" not in s and "distinct_id" not in s for s in read_schema)
    # results equal the derived (unmaterialized) table
    a = {tuple(r) for r in RP.web_new_sales_report(ev, "健走", "2024-01-01", "2024-06-30").collect()}
    b = {tuple(r) for r in QUERIES["web_new_sales_report"](spark, SF001).collect()}
    assert a == b


def test_reports_sorted_as_specified(spark):
    rows = QUERIES["inapp_renewal_report"](spark, SF001).collect()
    kinds = [r[0] for r in rows]
    assert kinds == sorted(kinds, key=lambda k: 0 if k == "续订率" else 1)
    assert [r[1] for r in rows if r[0] == "续订率"] == sorted(r[1] for r in rows if r[0] == "续订率")
    assert set(REPORTS) <= set(QUERIES)


@pytest.mark.parametrize(
    "name,budget",
    [
        # distinct, per-day money, by user (window and per-user counts), per month
        ("inapp_renewal_report", 4),
        # reduction, by user (both windows), per month and group
        ("web_renewal_report", 3),
        # distinct, per order, per month
        ("web_arppu_report", 3),
        ("web_new_sales_report", 3),
        # cohort users, their ids, per user, members, per scene
        ("experiment_training_report", 7),
    ],
)
def test_shuffle_budget(spark, name, budget):
    assert inspect.exchange_count(QUERIES[name](spark, SF001)) <= budget


@pytest.mark.parametrize("name", list(QUERIES))
def test_aggregations_stay_hash_based(spark, name):
    """Every report aggregation is a Tungsten hash aggregate: object hash
    aggregation falls back to sorting beyond 128 keys per task, and sort
    aggregation sorts its whole input."""
    plan = inspect.physical_plan(QUERIES[name](spark, SF001))
    assert "ObjectHashAggregate(" not in plan
    if name not in BITMAPS:
        assert "SortAggregate(" not in plan
    # no distinct count multiplies its input by an Expand
    assert "Expand" not in plan
