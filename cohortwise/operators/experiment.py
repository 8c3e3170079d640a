"""A/B experiment training funnel.

Every number in the funnel is a distinct-user count, so the event table is
reduced once to one row per user (start and completion counts per scene,
exposure flags) with a partial aggregation that collapses heavy users
before the shuffle. Cohort membership is then a user-sized join, and the
seven scenes are a generator over each member row, not a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import rules as R
from ..functions.sqltext import all_of, in_list, lit
from ..sources.by_user import by_user
from ..sources.events import conform
from .params import DateLike, in_closed_range_sql

SCENE_ORDER = {scene: i + 1 for i, scene in enumerate(R.SCENES)}
PAGE_SCENES = [R.SCENE_WALK, R.SCENE_WORKOUT, R.SCENE_HOME, R.SCENE_WALKBEAT]

ENT = "action_entrance_wup"
# start/end entrance rule of scenes 1-4
ENTRANCE_RULES = [
    "TRUE",
    f"({in_list(ENT, [R.ENTRANCE_HOME, R.ENTRANCE_WALKBEAT])} OR "
    f"({ENT} = {lit(R.ENTRANCE_OTHER)} AND action_entrance_id_wup = {lit(R.ENTRANCE_OTHER_ID)}))",
    f"{ENT} = {lit(R.ENTRANCE_HOME)}",
    f"{ENT} = {lit(R.ENTRANCE_WALKBEAT)}",
]
VIEW = f"event = {lit(R.EV_PAGEVIEW)}"
# exposure rule of scenes 1-4
EXPOSURE_RULES = [
    f"{VIEW} AND page_id = {R.PAGE_WALK}",
    f"{VIEW} AND page_id = {R.PAGE_WORKOUT}",
    f"{VIEW} AND page_id = {R.PAGE_WORKOUT} AND pageinfo = {lit(R.PAGEINFO_HOME)}",
    f"{VIEW} AND page_id = {R.PAGE_WORKOUT} AND pageinfo = {lit(R.PAGEINFO_WALKBEAT)}",
]
FILTER_PAGE = f"{VIEW} AND page_id = {R.PAGE_FILTER}"
FILTER_USED = (
    f"event = {lit(R.EV_CLICK)} AND click_id = {R.CLICK_FILTER} AND click_source_url = {lit(R.CLICK_SOURCE_FILTER)}"
)


WALK_EVENT_COLUMNS = [
    "user_id",
    "event",
    "page_id",
    "pageinfo",
    "click_id",
    "click_source_url",
    "action_entrance_wup",
    "action_entrance_id_wup",
]


def _event_rows(events: DataFrame, start: DateLike, end: DateLike) -> DataFrame:
    return conform(events).where(
        all_of([in_closed_range_sql(start, end), in_list("event", [R.EV_PAGEVIEW, R.EV_CLICK, R.EV_START, R.EV_END])])
    ).select(*WALK_EVENT_COLUMNS)


def _activity_aggs() -> list:
    """Per-user start/end counts for the four entrance rules and exposure flags."""
    aggs = []
    for i, rule in enumerate(ENTRANCE_RULES, start=1):
        aggs.append(F.expr(f"count_if(event = {lit(R.EV_START)} AND {rule}) AS n_start_{i}"))
        aggs.append(F.expr(f"count_if(event = {lit(R.EV_END)} AND {rule}) AS n_end_{i}"))
    for i, rule in enumerate(EXPOSURE_RULES, start=1):
        aggs.append(F.expr(f"max(CASE WHEN {rule} THEN 1 ELSE 0 END) AS seen_{i}"))
    aggs.append(F.expr(f"max(CASE WHEN {FILTER_PAGE} THEN 1 ELSE 0 END) AS seen_filter_page"))
    aggs.append(F.expr(f"max(CASE WHEN {FILTER_USED} THEN 1 ELSE 0 END) AS used_filter"))
    return aggs


@by_user
def user_activity(
    events: DataFrame, start: DateLike, end: DateLike, members: DataFrame | None = None, bucketed: bool = False
) -> DataFrame:
    """One row per user: start/end counts for the four entrance scenes and flags.

    With ``members`` (rows may repeat) only their events are counted: a
    semi-join before the aggregation, whose small side Spark broadcasts if
    its size allows. On a table laid out by user neither step shuffles the
    events of its buckets (``bucketed``: nothing else to do here).

    Output: user_id, n_start_<i>, n_end_<i> for scenes 1-4, seen_<i> for
    the four exposure rules, seen_filter_page, used_filter (0/1).
    """
    rows = _event_rows(events, start, end)
    if members is not None:
        rows = rows.join(members.select("user_id"), "user_id", "left_semi")
    return rows.groupBy("user_id").agg(*_activity_aggs())


def cohort_members(cohorts: DataFrame) -> DataFrame:
    """Distinct (group_name, user_id); a user may be in both arms."""
    return cohorts.select("group_name", "user_id").distinct()


def scene_member_rows(
    events: DataFrame, cohorts: DataFrame, start: DateLike, end: DateLike, cohort_first: bool = True
) -> DataFrame:
    """Every member x 7 scenes with base membership, scene membership and counts.

    Output: group_name, user_id, scene, scene_order, in_base, in_scene,
    n_start, n_complete. The events of members (``cohort_first``) are
    reduced to one activity row per user with fixed-width aggregates (``count_if``, ``max``), which Spark
    runs as a hash aggregate that combines map-side; the distinct members
    are then joined to it on user_id (each side has at most one or two rows
    per user, so no join key can be hot). Members with no events keep their
    rows (zeros), so every arm gets all seven scenes.

    ``cohort_first=False`` aggregates every user's events instead and gives
    the same rows; it suits cohorts that are most of all users and too many
    to broadcast, where the semi-join would shuffle raw events.
    """
    members = cohort_members(cohorts)
    activity = user_activity(events, start, end, cohorts if cohort_first else None)
    joined = members.join(activity, "user_id", "left")

    def z(c: str) -> str:
        return f"coalesce({c}, 0)"

    page, used = f"{z('seen_filter_page')} = 1", f"{z('used_filter')} = 1"
    not_used = f"{page} AND NOT {used}"
    specs = [(scene, f"{z(f'seen_{i}')} = 1", "TRUE", i) for i, scene in enumerate(PAGE_SCENES, start=1)]
    specs += [(R.SCENE_FILTER_PAGE, page, page, 1), (R.SCENE_FILTER_USED, used, used, 1), (R.SCENE_FILTER_NOT_USED, not_used, not_used, 1)]
    structs = ", ".join(
        f"struct({lit(scene)} AS scene, {SCENE_ORDER[scene]} AS scene_order, {in_base} AS in_base, {in_scene} AS in_scene, "
        f"CAST({z(f'n_start_{i}')} AS BIGINT) AS n_start, CAST({z(f'n_end_{i}')} AS BIGINT) AS n_complete)"
        for scene, in_base, in_scene, i in specs
    )
    return joined.selectExpr("group_name", "user_id", f"inline(array({structs}))")


def scene_user_activity(events: DataFrame, cohorts: DataFrame, start: DateLike, end: DateLike) -> DataFrame:
    """Start and completion counts per (group, scene, user) with any activity.

    A user's start counts in every scene it belongs to (intended overlap).
    Output: group_name, scene, user_id, n_start, n_complete.
    """
    rows = scene_member_rows(events, cohorts, start, end)
    active = "in_scene AND user_id IS NOT NULL AND (n_start > 0 OR n_complete > 0)"
    return rows.where(active).select("group_name", "scene", "user_id", "n_start", "n_complete")


GROUP_ORDER_SQL = f"CASE WHEN group_name = {lit(R.GROUP_EXPERIMENT)} THEN 1 ELSE 2 END"


def experiment_groups(cohorts: DataFrame) -> DataFrame:
    """Distinct members per arm and the arm's sort order."""
    return cohort_members(cohorts).groupBy("group_name").agg(
        F.expr("count(user_id) AS user_base"), F.expr(f"min({GROUP_ORDER_SQL}) AS group_order")
    )


def exposure_base(events: DataFrame, cohorts: DataFrame, start: DateLike, end: DateLike) -> DataFrame:
    """Distinct exposed users per group for the four page rules.

    Output: group_name, scene, user_base; only non-empty cells.
    """
    rows = scene_member_rows(events, cohorts, start, end)
    return (
        rows.where(f"in_base AND {in_list('scene', PAGE_SCENES)}")
        .groupBy("group_name", "scene")
        .agg(F.expr("count(user_id) AS user_base"))
        .where("user_base > 0")
    )


def filter_funnel_users(events: DataFrame, cohorts: DataFrame, start: DateLike, end: DateLike) -> DataFrame:
    """(group, user, scene) for the filter page, filter use, and page without use."""
    rows = scene_member_rows(events, cohorts, start, end)
    first = SCENE_ORDER[R.SCENE_FILTER_PAGE]
    return rows.where(f"in_base AND scene_order >= {first} AND user_id IS NOT NULL").select("group_name", "user_id", "scene")


def retrain_rate_sql(retrain: str, starters: str) -> str:
    """repeat users / starters to 4 places; 0 when nobody started."""
    return f"CASE WHEN {starters} = 0 THEN 0.0D ELSE {C.rounded_ratio_sql(retrain, starters, 4)} END"


def scene_uv(activity: DataFrame) -> DataFrame:
    """Distinct starters and completers per group and scene."""
    return activity.groupBy("group_name", "scene").agg(
        F.expr("count_if(n_start > 0) AS start_uv"), F.expr("count_if(n_complete > 0) AS complete_uv")
    )


def repeat_users(activity: DataFrame) -> DataFrame:
    """Users with two or more starts per group and scene, and their rate."""
    agg = activity.groupBy("group_name", "scene").agg(
        F.expr("count_if(n_start >= 2) AS retrain_uv"), F.expr("count_if(n_start > 0) AS _starters")
    )
    return agg.selectExpr("group_name", "scene", "retrain_uv", f"{retrain_rate_sql('retrain_uv', '_starters')} AS retrain_rate")


def dense_scene_grid(events: DataFrame, cohorts: DataFrame, start: DateLike, end: DateLike) -> DataFrame:
    """Every arm x 7 scenes with its user base, 0 where nobody qualifies.

    Output: group_name, group_order, scene, scene_order, user_base.
    """
    rows = scene_member_rows(events, cohorts, start, end)
    return rows.groupBy("group_name", "scene", "scene_order").agg(
        F.expr("count(CASE WHEN in_base THEN user_id END) AS user_base"),
        F.expr(f"min({GROUP_ORDER_SQL}) AS group_order"),
    ).select("group_name", "group_order", "scene", "scene_order", "user_base")


def scene_metrics(
    events: DataFrame, cohorts: DataFrame, start: DateLike, end: DateLike, cohort_first: bool = True
) -> DataFrame:
    """All funnel numbers per (group, scene) in one aggregation over member rows.

    Equal to D22 joined with D20 and D21; output: group_name, group_order,
    scene, scene_order, user_base, start_uv, complete_uv, retrain_uv,
    retrain_rate.
    """
    rows = scene_member_rows(events, cohorts, start, end, cohort_first)
    counted = "in_scene AND user_id IS NOT NULL"
    agg = rows.groupBy("group_name", "scene", "scene_order").agg(
        F.expr("count(CASE WHEN in_base THEN user_id END) AS user_base"),
        F.expr(f"count_if({counted} AND n_start > 0) AS start_uv"),
        F.expr(f"count_if({counted} AND n_complete > 0) AS complete_uv"),
        F.expr(f"count_if({counted} AND n_start >= 2) AS retrain_uv"),
        F.expr(f"min({GROUP_ORDER_SQL}) AS group_order"),
    )
    return agg.selectExpr("*", f"{retrain_rate_sql('retrain_uv', 'start_uv')} AS retrain_rate")
