"""Layout by user: no exchange of event rows, equal results, hot users apart; user lists and scratch folders."""

from __future__ import annotations

import re
import tempfile

import pytest
from conftest import SF01, purchase, walk

from cohortwise.functions import rules as R
from cohortwise.operators import experiment as X
from cohortwise.operators import renewal as N
from cohortwise.plans import inspect
from cohortwise.plans import registry as Q
from cohortwise.plans import reports as RP
from cohortwise.sources import by_user as BU
from cohortwise.sources import fixtures as FX
from cohortwise.sources.scratch import scratch_folder

S, E = FX.WALK_START, FX.WALK_END


def layout(spark, events, buckets=8):
    path = tempfile.mkdtemp(prefix="cohortwise-by-user-") + "/events"
    BU.write_by_user(events, path, buckets)
    return path


@pytest.fixture(scope="module")
def walks_by_user(spark):
    return BU.read_by_user(spark, layout(spark, FX.load_walk_events(spark, SF01)))


@pytest.fixture(scope="module")
def purchases_by_user(spark):
    return BU.read_by_user(spark, layout(spark, FX.load_purchase_events(spark, SF01)))


@pytest.fixture()
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, old)


def below(plan: str, node: str) -> list[str]:
    """The lines of the first child (left side) of the first plan node that matches."""
    lines = plan.splitlines()
    at = next(i for i, x in enumerate(lines) if re.search(node, x))
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    out = []
    for x in lines[at + 1 :]:
        if depth(x) <= depth(lines[at]) or (out and depth(x) == depth(lines[at + 1])):
            break
        out.append(x)
    return out


def test_training_events_meet_the_members_without_an_exchange(spark, walks_by_user, no_broadcast):
    cohorts = FX.load_cohorts(spark, SF01)
    plan = inspect.physical_plan(X.user_activity(walks_by_user.bucketed, S, E, cohorts, bucketed=True))
    events = below(plan, "Join.*LeftSemi")
    assert any("FileScan" in x and "Bucketed: true" in x for x in events)
    assert not any("Exchange" in x for x in events)
    # the per-user aggregation above reuses the buckets, too: what is exchanged is the list
    assert inspect.exchange_count(X.user_activity(walks_by_user.bucketed, S, E, cohorts, bucketed=True)) <= 2
    assert "PartitionFilters: [isnotnull(date" in inspect.formatted_plan(X.user_activity(walks_by_user.bucketed, S, E))


@pytest.mark.parametrize(
    "operator", [lambda ev: N.inapp_flagged_days(ev, Q.LINE, Q.S, Q.E, bucketed=True), lambda ev: N.web_first_orders_with_renewals(ev, Q.LINE, Q.S, Q.E, bucketed=True)]
)
def test_renewals_of_buckets_are_matched_without_an_exchange(purchases_by_user, operator):
    assert inspect.exchange_count(operator(purchases_by_user.bucketed)) == 0


def test_reports_are_equal_to_those_of_the_date_layout(spark, walks_by_user, purchases_by_user):
    cohorts = FX.load_cohorts(spark, SF01)
    pairs = [(RP.experiment_training_report(walks_by_user, cohorts, S, E), Q.experiment_training_report(spark, SF01))]
    for name in ("inapp_renewal_report", "web_renewal_report", "web_arppu_report", "web_new_sales_report"):
        pairs.append((getattr(RP, name)(purchases_by_user, Q.LINE, Q.S, Q.E), getattr(Q, name)(spark, SF01)))
    for ours, plain in pairs:
        assert [tuple(r) for r in ours.collect()] == [tuple(r) for r in plain.collect()]


def test_hot_users_have_a_part_of_their_own(spark, walks, cohort_df):
    """One user with a third of all rows, and NULL with another: buckets stay even, and no row is lost."""
    rows = [walk(7, R.EV_START, date=f"2024-01-0{5 + k % 3}") for k in range(300)]
    rows += [walk(None, R.EV_START) for _ in range(300)]
    rows += [walk(100 + k, R.EV_START if k % 2 else R.EV_END) for k in range(300)]
    events = walks(rows)
    path = layout(spark, events, 4)
    table = BU.read_by_user(spark, path)
    assert {r[0] for r in table.hot.select("user_id").distinct().collect()} == {7, None}
    assert table.bucketed.count() == 300 and table.whole().count() == 900
    members = cohort_df([(R.GROUP_EXPERIMENT, u) for u in (7, 100, 101, 102)] + [(R.GROUP_CONTROL, None), (R.GROUP_CONTROL, 103)])
    report = lambda ev: [tuple(r) for r in RP.experiment_training_report(ev, members, S, E).collect()]
    assert report(table) == report(events)


def test_appended_days_follow_the_first_list(spark, walks):
    """A user who becomes hot later stays in the buckets; one who was hot stays apart. Date partitions are added."""
    path = layout(spark, walks([walk(1, R.EV_START)] * 50 + [walk(k, R.EV_START) for k in range(2, 30)]), 4)
    more = walks([walk(2, R.EV_START, date="2024-01-09")] * 500 + [walk(1, R.EV_END, date="2024-01-09")])
    BU.append_by_user(more, path)
    table = BU.read_by_user(spark, path)
    assert {r[0] for r in table.hot.select("user_id").distinct().collect()} == {1}
    assert table.whole().count() == 78 + 501
    got = {r["user_id"]: (r["n_start_1"], r["n_end_1"]) for r in X.user_activity(table, S, E).collect()}
    assert got[1] == (50, 1) and got[2] == (501, 0) and len(got) == 29


def test_a_new_session_reads_the_layout(spark, walks):
    path = layout(spark, walks([walk(k, R.EV_START) for k in range(40)]), 4)
    before = BU.read_by_user(spark, path).whole().count()
    spark.sql(f"DROP TABLE {BU._table_name(path)}")  # external: the files stay
    table = BU.read_by_user(spark, path)
    assert table.whole().count() == before == 40
    assert inspect.exchange_count(X.user_activity(table.bucketed, S, E)) == 0


def test_an_existing_layout_is_refused(spark, walks):
    events = walks([walk(k, R.EV_START) for k in range(10)])
    path = layout(spark, events, 2)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        BU.write_by_user(events, path, 2)


def test_empty_events(spark, walks, cohort_df):
    table = BU.read_by_user(spark, layout(spark, walks([]), 2))
    assert table.whole().count() == 0
    assert RP.experiment_training_report(table, cohort_df([(R.GROUP_EXPERIMENT, 1)]), S, E).count() == 7


def test_order_sums_take_the_union(spark, purchases):
    web = dict(product="webob_0d7-29.9d30", order_type="新增", ptype="会员")
    events = purchases([purchase(user=u, order_id=u, **web) for u in (1, 1, 2, 3)])
    table = BU.read_by_user(spark, layout(spark, events, 2))
    rows = lambda ev: sorted(map(tuple, RP.web_arppu_report(ev, "健走", "2024-01-01", "2024-01-31").collect()))
    assert rows(table) == rows(events)


def test_scratch_folders_are_shared_or_refused(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_folder(Session())
    assert scratch_folder(spark) != scratch_folder(spark)
