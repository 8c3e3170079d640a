"""Training funnel: scene sets, repeat users, empty arms, D19 vs flags."""

from __future__ import annotations

from conftest import SF01, walk

from cohortwise.functions import rules as R
from cohortwise.operators import experiment as X
from cohortwise.plans import reports as RP
from cohortwise.sources import fixtures as FX

S, E = "2024-01-05", "2024-01-11"


def _report(walks, cohort_df, events, members):
    rows = RP.experiment_training_report(walks(events), cohort_df(members), S, E).collect()
    return {(r[0], r[1]): tuple(r[2:]) for r in rows}


def test_filter_scenes_and_repeat(walks, cohort_df):
    events = [
        walk(1, R.EV_PAGEVIEW, page=R.PAGE_FILTER),
        walk(1, R.EV_START, date="2024-01-05", entrance="504"),  # start before and after the page: both count
        walk(1, R.EV_START, date="2024-01-09", entrance="501"),
        walk(2, R.EV_CLICK, click=R.CLICK_FILTER, source=R.CLICK_SOURCE_FILTER),  # used without the page
        walk(2, R.EV_END, entrance="503"),
        walk(3, R.EV_START, date="2024-01-20"),  # outside the range
    ]
    got = _report(walks, cohort_df, events, [(R.GROUP_EXPERIMENT, 1), (R.GROUP_EXPERIMENT, 2), (R.GROUP_EXPERIMENT, 3)])
    g = R.GROUP_EXPERIMENT
    assert got[(g, R.SCENE_FILTER_PAGE)] == (1, 1, 0, 1.0)
    assert got[(g, R.SCENE_FILTER_NOT_USED)] == (1, 1, 0, 1.0)
    assert got[(g, R.SCENE_FILTER_USED)] == (1, 0, 1, 0.0)
    assert got[(g, R.SCENE_WALK)] == (0, 1, 1, 1.0)
    assert got[(g, R.SCENE_HOME)] == (0, 1, 0, 0.0)
    assert got[(g, R.SCENE_WALKBEAT)] == (0, 0, 1, 0.0)
    assert len(got) == 7


def test_empty_arm_has_no_rows(walks, cohort_df):
    got = _report(walks, cohort_df, [walk(1, R.EV_START)], [(R.GROUP_EXPERIMENT, 1)])
    assert {k[0] for k in got} == {R.GROUP_EXPERIMENT}


def test_user_in_both_arms_counts_in_both(walks, cohort_df):
    members = [(R.GROUP_EXPERIMENT, 7), (R.GROUP_CONTROL, 7), (R.GROUP_CONTROL, 7)]
    got = _report(walks, cohort_df, [walk(7, R.EV_START), walk(7, R.EV_START)], members)
    assert got[(R.GROUP_EXPERIMENT, R.SCENE_WALK)][1:] == (1, 0, 1.0)
    assert got[(R.GROUP_CONTROL, R.SCENE_WALK)][1:] == (1, 0, 1.0)


def test_duplicate_event_changes_repeat_users(walks, cohort_df):
    once = _report(walks, cohort_df, [walk(1, R.EV_START)], [(R.GROUP_CONTROL, 1)])
    twice = _report(walks, cohort_df, [walk(1, R.EV_START), walk(1, R.EV_START)], [(R.GROUP_CONTROL, 1)])
    assert once[(R.GROUP_CONTROL, R.SCENE_WALK)][3] == 0.0
    assert twice[(R.GROUP_CONTROL, R.SCENE_WALK)][3] == 1.0


def test_cohort_first_gives_the_same_rows(spark):
    ev = FX.load_walk_events(spark, SF01)
    for co in (FX.load_cohorts(spark, SF01), FX.load_cohorts(spark, SF01).where("user_id % 50 = 0")):
        a, b = ([tuple(r) for r in X.scene_member_rows(ev, co, S, E, cohort_first=c).collect()] for c in (True, False))
        assert sorted(map(str, a)) == sorted(map(str, b)) and a


def test_filter_page_splits_into_used_and_not_used(spark):
    ev, co = FX.load_walk_events(spark, SF01), FX.load_cohorts(spark, SF01)
    sets = {}
    for r in X.filter_funnel_users(ev, co, S, E).collect():
        sets.setdefault(r.scene, set()).add((r.group_name, r.user_id))
    page, used, not_used = sets[R.SCENE_FILTER_PAGE], sets[R.SCENE_FILTER_USED], sets[R.SCENE_FILTER_NOT_USED]
    assert page == (page & used) | not_used
    assert not (not_used & used)


def test_report_matches_recorded_fixture_numbers(spark):
    rows = RP.experiment_training_report(FX.load_walk_events(spark, SF01), FX.load_cohorts(spark, SF01), S, E).collect()
    got = {(r[0], r[1]): r for r in rows}
    exp = got[(R.GROUP_EXPERIMENT, R.SCENE_WALK)]
    assert (exp[3], exp[4], exp[5]) == (90, 84, round(87 / 90, 4))
    ctl = got[(R.GROUP_CONTROL, R.SCENE_FILTER_NOT_USED)]
    assert (ctl[3], ctl[4]) == (31, 31)
