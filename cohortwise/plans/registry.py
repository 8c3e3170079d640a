"""Registered queries: every operator and report over the test-data mappings.

Each entry takes (spark, sf_dir) and returns a lazy DataFrame over the
whole source tables of that scale factor, with the fixed report
parameters of ``sources.fixtures``. DECIMAL money is returned as DOUBLE.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules as RULES
from ..functions.sqltext import ident
from ..operators import distinct_state as DS
from ..operators import experiment as X
from ..operators import purchases as P
from ..operators import renewal as N
from ..operators import revenue as V
from ..operators.pivot import segment_pivot
from ..sources import by_user as BU
from ..sources import events as EV
from ..sources import fixtures as FX
from ..sources.scratch import scratch_folder
from . import reports as RP

LINE, S, E = FX.PURCHASE_LINE, FX.PURCHASE_START, FX.PURCHASE_END
WS, WE = FX.WALK_START, FX.WALK_END

Query = Callable[[SparkSession, str], DataFrame]


def _out(df: DataFrame) -> DataFrame:
    """Money as DOUBLE so every engine prints the same values."""
    cols = [
        f"CAST({ident(f.name)} AS DOUBLE) AS {ident(f.name)}" if isinstance(f.dataType, T.DecimalType) else ident(f.name)
        for f in df.schema.fields
    ]
    return df.selectExpr(*cols)


def _p(spark: SparkSession, d: str) -> DataFrame:
    return FX.load_purchase_events(spark, d)


def _w(spark: SparkSession, d: str) -> DataFrame:
    return FX.load_walk_events(spark, d)


def _c(spark: SparkSession, d: str) -> DataFrame:
    return FX.load_cohorts(spark, d)


def inapp_base_orders(spark, d):
    return _out(P.inapp_base_orders(_p(spark, d), LINE, S, E))


def inapp_plan_mix(spark, d):
    return P.inapp_plan_mix(_p(spark, d), LINE, S, E)


def web_base_orders(spark, d):
    return _out(P.web_base_orders(_p(spark, d), LINE, S, E))


def web_product_group_mix(spark, d):
    return P.web_product_group_mix(_p(spark, d), LINE, S, E)


def web_plan_mix(spark, d):
    return P.web_plan_mix(_p(spark, d), LINE, S, E)


def first_order_per_segment(spark, d):
    return _out(N.first_order_per_segment(P.web_base_orders(_p(spark, d), LINE, S, E)))


def renewal_candidates(spark, d):
    return N.renewal_candidates_one_read(_p(spark, d), LINE, S, E, "inapp")


def renewal_flags(spark, d):
    """D8 as the generic operator: D1 base rows and distinct renewal days."""
    ev = _p(spark, d)
    base = P.inapp_base_orders(ev, LINE, S, E)
    return N.renewal_flags(base, N.renewal_days(ev, LINE, S, E, "inapp"), N.INAPP_FLAG_KEYS)


def _inapp_flags_one_scan(spark, d):
    """The same flags as ``renewal_flags``, from the one-scan in-app path."""
    days = N.inapp_flagged_days(_p(spark, d), LINE, S, E)
    return days.groupBy(*N.INAPP_FLAG_KEYS).agg(F.expr("max(has_repay) AS has_repay"))


def inapp_renewal_users(spark, d):
    return N.inapp_renewal_users(_inapp_flags_one_scan(spark, d))


def renewal_rate(spark, d):
    return N.renewal_rate(N.inapp_renewal_users(_inapp_flags_one_scan(spark, d)), 2)


def web_renewal_users(spark, d):
    return N.web_cohort_cells(N.web_first_orders_with_renewals(_p(spark, d), LINE, S, E)).drop("revenue_base")


def renewal_flags_matured(spark, d):
    """D8 with the flag that says whether a 0 is final."""
    ev = _p(spark, d)
    base = P.inapp_base_orders(ev, LINE, S, E)
    return N.renewal_flags(base, N.renewal_days(ev, LINE, S, E, "inapp"), N.INAPP_FLAG_KEYS, data_end=FX.DATA_END)


def web_renewal_candidates(spark, d):
    return N.renewal_candidates_one_read(_p(spark, d), LINE, S, E, "web")


def web_renewal_flags(spark, d):
    ev = _p(spark, d)
    first = RP.web_first_orders(ev, LINE, S, E)
    return N.renewal_flags(first, N.renewal_days(ev, LINE, S, E, "web"), [*N.WEB_SEGMENT_KEYS, "user_id"])


def web_renewal_rate(spark, d):
    return N.renewal_rate(web_renewal_users(spark, d), 4)


def inapp_revenue_base(spark, d):
    return N.inapp_revenue_base(P.inapp_base_orders(_p(spark, d), LINE, S, E))


def web_revenue_base(spark, d):
    return N.web_revenue_base(RP.web_first_orders(_p(spark, d), LINE, S, E))


def web_arppu(spark, d):
    return V.web_arppu(_p(spark, d), LINE, S, E)


def web_new_sales(spark, d):
    return V.web_new_sales(_p(spark, d), LINE, S, E)


def scene_user_activity(spark, d):
    return X.scene_user_activity(_w(spark, d), _c(spark, d), WS, WE)


def experiment_groups(spark, d):
    return X.experiment_groups(_c(spark, d))


def exposure_base(spark, d):
    return X.exposure_base(_w(spark, d), _c(spark, d), WS, WE)


def filter_funnel_users(spark, d):
    return X.filter_funnel_users(_w(spark, d), _c(spark, d), WS, WE)


def scene_uv(spark, d):
    return X.scene_uv(X.scene_user_activity(_w(spark, d), _c(spark, d), WS, WE))


def repeat_users(spark, d):
    return X.repeat_users(X.scene_user_activity(_w(spark, d), _c(spark, d), WS, WE))


def dense_scene_grid(spark, d):
    return X.dense_scene_grid(_w(spark, d), _c(spark, d), WS, WE)


def segment_pivot_orders(spark, d):
    """D23 on its own: new-order counts, long -> one row per month x 12 columns."""
    cells = V.web_new_sales(_p(spark, d), LINE, S, E).selectExpr("*", f"{RP.sales_column_sql()} AS column")
    return segment_pivot(cells, ["stat_month"], "column", "orders", RP.WEB_SALES_COLUMNS, "0")


def inapp_renewal_report(spark, d):
    return RP.inapp_renewal_report(_p(spark, d), LINE, S, E)


def web_renewal_report(spark, d):
    return RP.web_renewal_report(_p(spark, d), LINE, S, E)


def web_arppu_report(spark, d):
    return RP.web_arppu_report(_p(spark, d), LINE, S, E)


def web_new_sales_report(spark, d):
    return RP.web_new_sales_report(_p(spark, d), LINE, S, E)


def experiment_training_report(spark, d):
    return RP.experiment_training_report(_w(spark, d), _c(spark, d), WS, WE)


# --- distinct counts from merged states


def _inapp_state(spark, d, start, end):
    return DS.inapp_user_state(N.inapp_flagged_days(_p(spark, d), LINE, start, end))


def _web_state(spark, d, start, end):
    return DS.web_user_state(N.web_first_orders_with_renewals(_p(spark, d), LINE, start, end))


def inapp_renewal_users_merged(spark, d):
    """D9 from the states of two half ranges."""
    return DS.state_counts(DS.merge_states(_inapp_state(spark, d, S, FX.HALF_END), _inapp_state(spark, d, FX.HALF_START, E)))


def web_renewal_users_merged(spark, d):
    """D10 from the states of two half ranges."""
    return DS.state_counts(DS.merge_states(_web_state(spark, d, S, FX.HALF_END), _web_state(spark, d, FX.HALF_START, E)))


def inapp_renewal_users_total(spark, d):
    """Users of the whole range by segment, each counted once, from the monthly states of two half ranges."""
    months = _inapp_state(spark, d, S, FX.HALF_END), _inapp_state(spark, d, FX.HALF_START, E)
    return DS.state_counts(DS.merge_states(*months, keys=["segment"]))


# --- tables laid out by user, user lists as tables

BY_USER_BUCKETS = 8


#: Layouts of this session, written once for each table: (application, loader, folder) -> path.
_LAYOUTS: dict[tuple[str, str, str], str] = {}


def _by_user(spark, d, load: Query) -> BU.ByUser:
    at = spark.sparkContext.applicationId, load.__name__, d
    if at not in _LAYOUTS:
        path = scratch_folder(spark)
        BU.write_by_user(load(spark, d), path, BY_USER_BUCKETS)
        _LAYOUTS[at] = path
    return BU.read_by_user(spark, _LAYOUTS[at])


def inapp_renewal_report_by_user(spark, d):
    return RP.inapp_renewal_report(_by_user(spark, d, _p), LINE, S, E)


def web_renewal_report_by_user(spark, d):
    return RP.web_renewal_report(_by_user(spark, d, _p), LINE, S, E)


def experiment_training_report_by_user(spark, d):
    return RP.experiment_training_report(_by_user(spark, d, _w), _c(spark, d), WS, WE)


def _listed_cohorts(spark, d) -> DataFrame:
    """The arms' user lists, written as tables of their own and read back."""
    path, lists = scratch_folder(spark), {}
    for k, group in enumerate((RULES.GROUP_EXPERIMENT, RULES.GROUP_CONTROL)):
        _c(spark, d).where(F.col("group_name") == group).select("user_id").write.parquet(f"{path}/{k}")
        lists[group] = spark.read.parquet(f"{path}/{k}")
    return EV.cohorts_from_lists(lists)


def cohort_lists(spark, d):
    """The members of both lists, each arm's users once."""
    return X.cohort_members(_listed_cohorts(spark, d))


def experiment_training_report_from_lists(spark, d):
    return RP.experiment_training_report(_w(spark, d), _listed_cohorts(spark, d), WS, WE)


# --- reports with the place of each row


def _ordered(report: Query) -> Query:
    return lambda spark, d: RP.with_position(report(spark, d))


QUERIES: dict[str, Query] = {
    "inapp_base_orders": inapp_base_orders,
    "inapp_plan_mix": inapp_plan_mix,
    "web_base_orders": web_base_orders,
    "web_product_group_mix": web_product_group_mix,
    "web_plan_mix": web_plan_mix,
    "first_order_per_segment": first_order_per_segment,
    "renewal_candidates": renewal_candidates,
    "renewal_flags": renewal_flags,
    "renewal_flags_matured": renewal_flags_matured,
    "web_renewal_candidates": web_renewal_candidates,
    "web_renewal_flags": web_renewal_flags,
    "inapp_renewal_users": inapp_renewal_users,
    "web_renewal_users": web_renewal_users,
    "renewal_rate": renewal_rate,
    "web_renewal_rate": web_renewal_rate,
    "inapp_revenue_base": inapp_revenue_base,
    "web_revenue_base": web_revenue_base,
    "web_arppu": web_arppu,
    "web_new_sales": web_new_sales,
    "scene_user_activity": scene_user_activity,
    "experiment_groups": experiment_groups,
    "exposure_base": exposure_base,
    "filter_funnel_users": filter_funnel_users,
    "scene_uv": scene_uv,
    "repeat_users": repeat_users,
    "dense_scene_grid": dense_scene_grid,
    "segment_pivot": segment_pivot_orders,
    "inapp_renewal_report": inapp_renewal_report,
    "web_renewal_report": web_renewal_report,
    "web_arppu_report": web_arppu_report,
    "web_new_sales_report": web_new_sales_report,
    "experiment_training_report": experiment_training_report,
    "inapp_renewal_users_merged": inapp_renewal_users_merged,
    "web_renewal_users_merged": web_renewal_users_merged,
    "inapp_renewal_users_total": inapp_renewal_users_total,
    "inapp_renewal_report_by_user": inapp_renewal_report_by_user,
    "web_renewal_report_by_user": web_renewal_report_by_user,
    "experiment_training_report_by_user": experiment_training_report_by_user,
    "cohort_lists": cohort_lists,
    "experiment_training_report_from_lists": experiment_training_report_from_lists,
    "inapp_renewal_report_ordered": _ordered(inapp_renewal_report),
    "web_renewal_report_ordered": _ordered(web_renewal_report),
    "web_arppu_report_ordered": _ordered(web_arppu_report),
    "web_new_sales_report_ordered": _ordered(web_new_sales_report),
    "experiment_training_report_ordered": _ordered(experiment_training_report),
}

REPORTS = [
    "inapp_renewal_report",
    "web_renewal_report",
    "web_arppu_report",
    "web_new_sales_report",
    "experiment_training_report",
]
