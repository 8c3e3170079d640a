"""Per-row rules: plan classification, code parsing, windows, rounding."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortwise.functions import classify as C
from cohortwise.functions import rules as R


def _eval(spark, values, sql, col="product_id_all_product"):
    df = spark.createDataFrame([(v,) for v in values], f"{col} string")
    return [r[0] for r in df.select(F.expr(sql)).collect()]


@pytest.mark.parametrize(
    "code,plan",
    [
        ("vip.gold_1_month", "月"),
        ("vip.GoldYear", "年"),
        ("VIP_YEARLY", "年"),  # case-insensitive
        ("12_month_pack", "年"),  # contains neither 1_month nor 1_year
        ("11_month_pack", "月"),  # contains 1_month
        ("vip_d300", "月"),  # d300 contains d30
        ("vip.3_month.v2", "季"),
        ("vip_180_day", "半年"),
        ("app.auto.month", "月"),
        ("app_autoxyear", None),  # the dot is literal
        ("app.auto.year", "年"),
        ("vip.silveryearsale", "年"),
        ("coins_pack_100", None),
        (None, None),
    ],
)
def test_inapp_plan_first_match(spark, code, plan):
    assert _eval(spark, [code], C.inapp_plan_sql()) == [plan]


def test_web_marker_is_case_sensitive(spark):
    got = _eval(spark, ["webob_1", "WEBOB_1", None], C.is_web_code_sql())
    assert got == [True, False, None]


@pytest.mark.parametrize(
    "code,renewal,sales",
    [
        ("webob_0d7-29.9d30", "0元7天-月", "0元7天-月"),
        ("webob_0d7-79.9d90", "0元7天-季度", "0元7天-季"),
        ("webob_0d30-19.9d30", "0元-月", "首月0元"),
        ("webob_9.9d7-29.9d28", "7天-月", "7天-月_首付非0"),
        ("webob_19.9d14-19.9d14", "半月", "半月"),
        ("webob_29.9d30-29.9d28", "月", "月"),
        ("webob_79.9d84-79.9d90", "季度", "季"),
        ("webob_169d168-169d168", "半年", "半年"),
        ("webob_0d14-0d14", "半月", "半月"),  # zero price, no zero rule: later rule
        ("webob_5d60-5d60", None, None),  # parses, no rule
        ("webob_special", None, None),  # does not parse, no error
    ],
)
def test_web_plan_both_label_sets(spark, code, renewal, sales):
    p, f, n = C.web_first_price_sql(), C.web_first_days_sql(), C.web_renew_days_sql()
    assert _eval(spark, [code], C.web_plan_sql(p, f, n, "renewal")) == [renewal]
    assert _eval(spark, [code], C.web_plan_sql(p, f, n, "sales")) == [sales]


def test_plan_rules_are_first_match():
    rules = C.web_plan_sql(label_set="renewal")
    # zero price, 7 days then 28: the first rule, before the later 7天-月 rule
    assert rules.index("0元7天-月") < rules.index("'7天-月'")
    with pytest.raises(ValueError):
        C.web_plan_sql(label_set="other")


@pytest.mark.parametrize(
    "kind,money,n,want",
    [("double", "0.29", 1, 0.29), ("decimal(12,4)", "9.999", 1, 10.0), ("decimal(12,4)", "0.0150", 3, 0.01), ("double", "10", 3, 3.33), ("int", "7", 2, 3.5)],
)
def test_money_ratio_of_any_numeric(spark, kind, money, n, want):
    df = spark.createDataFrame([(money, n)], "m string, d bigint").selectExpr(f"CAST(m AS {kind}) AS m", "d")
    assert df.selectExpr(f"{C.rounded_money_ratio_sql('m', 'd')} AS x").first().x == want


def test_web_window_days(spark):
    df = spark.createDataFrame([(r,) for r in [7, 14, 28, 30, 84, 90, 168, 60, None]], "window_days_raw int")
    got = [r[0] for r in df.select(F.expr(C.web_window_days_sql())).collect()]
    assert got == [9, 17, 35, 35, 99, 99, 190, None, None]


def test_inapp_windows():
    assert [d for _, _, d in R.INAPP_PLANS] == [380, 190, 100, 40]


@pytest.mark.parametrize(
    "n,d,places,want",
    [(29, 200, 2, 0.15), (1, 8, 2, 0.13), (1, 3, 2, 0.33), (2, 3, 4, 0.6667), (0, 5, 2, 0.0), (5, 5, 4, 1.0), (3, 0, 2, None)],
)
def test_rounded_ratio_half_up(spark, n, d, places, want):
    df = spark.createDataFrame([(n, d)], "n bigint, d bigint")
    got = df.select(F.expr(C.rounded_ratio_sql("n", "d", places))).first()[0]
    assert got == want


def test_money_ratio_half_up(spark):
    df = spark.createDataFrame([("0.05", 2), ("10.00", 3), ("-0.05", 2), ("1.00", 0)], "m string, d bigint")
    df = df.selectExpr("CAST(m AS DECIMAL(12,2)) AS m", "d")
    got = [r[0] for r in df.select(F.expr(C.rounded_money_ratio_sql("m", "d"))).collect()]
    assert got == [0.03, 3.33, -0.03, None]


def test_entrance_rule_keeps_null(spark):
    df = spark.createDataFrame([("75",), (None,), ("10001",), ("50024",)], "purchase_entrance_all_product string")
    got = [r[0] for r in df.select(F.expr(C.web_entrance_allowed_sql())).collect()]
    assert got == [False, True, True, False]
