"""Sources: reading a real event table, type conforming, cohort lists, CLI."""

from __future__ import annotations

import datetime as dt
import tempfile

import pytest
from conftest import SF001, SF01, purchase
from pyspark.sql import functions as F

from cohortwise import cli
from cohortwise.functions import rules as R
from cohortwise.plans import reports as RP
from cohortwise.plans.registry import QUERIES
from cohortwise.sources import events as EVS
from cohortwise.sources import fixtures as FX


def test_conform_casts_timestamp_date_and_keeps_other_columns(spark):
    df = spark.createDataFrame(
        [("e", dt.datetime(2024, 1, 1, 23, 30), "u1", "x")], "event string, date timestamp, user_id string, extra string"
    )
    out = EVS.conform(df)
    assert dict(out.dtypes) == {"event": "string", "date": "date", "user_id": "string", "extra": "string"}
    assert out.first().date == dt.date(2024, 1, 1)


def test_missing_required_columns_fail_early(spark):
    df = spark.createDataFrame([("e",)], "event string")
    try:
        EVS.conform(df)
    except ValueError as e:
        assert "date" in str(e)
    else:
        raise AssertionError("expected a ValueError")


def test_cohorts_from_lists_tags_and_keeps_repeats(spark):
    exp = spark.createDataFrame([(1,), (2,), (2,)], "user_id int")
    ctl = spark.createDataFrame([(3,)], "user_id long")
    rows = sorted(tuple(r) for r in EVS.cohorts_from_lists({R.GROUP_EXPERIMENT: exp, R.GROUP_CONTROL: ctl}).collect())
    assert rows == [(R.GROUP_EXPERIMENT, 1), (R.GROUP_EXPERIMENT, 2), (R.GROUP_EXPERIMENT, 2), (R.GROUP_CONTROL, 3)]


def test_cli_writes_a_report(spark):
    root = tempfile.mkdtemp(prefix="cohortwise-cli-")
    EVS.write_events(FX.load_walk_events(spark, SF001), f"{root}/walk")
    co = FX.load_cohorts(spark, SF001)
    co.where(f"group_name = '{R.GROUP_EXPERIMENT}'").select("user_id").write.parquet(f"{root}/exp")
    co.where(f"group_name = '{R.GROUP_CONTROL}'").select("user_id").write.parquet(f"{root}/ctl")
    cli.main(
        ["training", "--events", f"{root}/walk", "--experiment", f"{root}/exp", "--control", f"{root}/ctl",
         "--start", FX.WALK_START, "--end", FX.WALK_END, "--out", f"{root}/out"]
    )
    got = {tuple(r) for r in spark.read.parquet(f"{root}/out").collect()}
    want = {tuple(r) for r in QUERIES["experiment_training_report"](spark, SF001).collect()}
    assert got == want and len(got) == 14


def test_purchase_report_over_written_table(spark):
    root = tempfile.mkdtemp(prefix="cohortwise-pe-")
    EVS.write_events(FX.load_purchase_events(spark, SF001), f"{root}/pe")
    ev = EVS.read_events(spark, f"{root}/pe")
    got = {tuple(r) for r in RP.inapp_renewal_report(ev, "健走", "2024-01-01", "2024-06-30").collect()}
    want = {tuple(r) for r in QUERIES["inapp_renewal_report"](spark, SF001).collect()}
    assert got == want


def test_reports_accept_string_user_ids(spark):
    ev = FX.load_purchase_events(spark, SF001)
    as_text = ev.selectExpr(*[("concat('u', CAST(user_id AS STRING)) AS user_id" if c == "user_id" else c) for c in ev.columns])
    a = {tuple(r) for r in RP.inapp_renewal_report(ev, "健走", "2024-01-01", "2024-06-30").collect()}
    b = {tuple(r) for r in RP.inapp_renewal_report(EVS.conform(as_text), "健走", "2024-01-01", "2024-06-30").collect()}
    assert a == b and a


def test_cli_purchase_report(spark):
    root = tempfile.mkdtemp(prefix="cohortwise-cli-pe-")
    EVS.write_events(FX.load_purchase_events(spark, SF001), f"{root}/pe")
    cli.main(["web-arppu", "--events", f"{root}/pe", "--line", FX.PURCHASE_LINE, "--start", FX.PURCHASE_START,
              "--end", FX.PURCHASE_END, "--out", f"{root}/out"])
    got = {tuple(r) for r in spark.read.parquet(f"{root}/out").collect()}
    want = {tuple(r) for r in QUERIES["web_arppu_report"](spark, SF001).collect()}
    assert got == want and got


def test_writing_a_day_keeps_the_others_and_refuses_by_default(spark):
    root = tempfile.mkdtemp(prefix="cohortwise-days-") + "/pe"
    ev = FX.load_purchase_events(spark, SF001)
    EVS.write_events(ev, root)
    with pytest.raises(Exception, match="(?i)exists"):
        EVS.write_events(ev, root)
    days = {r.date for r in ev.select("date").distinct().collect()}
    one = min(days)
    EVS.write_events(ev.where(f"date = DATE '{one}'").limit(1), root, mode="overwrite")
    back = EVS.read_events(spark, root)
    assert {r.date for r in back.select("date").distinct().collect()} == days
    assert back.where(f"date = DATE '{one}'").count() == 1


def test_show_prints_every_row(spark, capsys, monkeypatch):
    monkeypatch.setitem(cli.PURCHASE_REPORTS, "web-arppu", lambda *_: spark.range(300).selectExpr("id", "CAST(NULL AS STRING) AS x"))
    monkeypatch.setattr(cli, "read_events", lambda *_: None)
    cli.main(["web-arppu", "--events", "-", "--start", "2024-01-01", "--end", "2024-01-02", "--show"])
    out = capsys.readouterr().out.splitlines()
    assert out[0] == "id\tx" and out[1:] == [f"{i}\t" for i in range(300)]


@pytest.mark.parametrize("name", ["inapp_renewal_report", "web_renewal_report", "web_arppu_report", "web_new_sales_report"])
def test_timestamp_dates_keep_the_last_day(spark, name):
    ev = FX.load_purchase_events(spark, SF01)
    late = ev.withColumn("date", F.expr("CAST(date AS TIMESTAMP) + INTERVAL 13 HOURS"))
    report = getattr(RP, name)
    s, e = "2024-01-01", "2024-06-17"
    assert {tuple(r) for r in report(late, "健走", s, e).collect()} == {tuple(r) for r in report(ev, "健走", s, e).collect()}


def test_timestamp_dates_keep_the_last_day_of_the_funnel(spark):
    ev, co = FX.load_walk_events(spark, SF01), FX.load_cohorts(spark, SF01)
    late = ev.withColumn("date", F.expr("CAST(date AS TIMESTAMP) + INTERVAL 13 HOURS"))
    got, want = ([tuple(r) for r in RP.experiment_training_report(x, co, FX.WALK_START, FX.WALK_END).collect()] for x in (late, ev))
    assert got == want


def test_money_as_double(purchases):
    rows = purchases([purchase(product="webob_29.9d30-29.9d30", money="0.29", order_id=1)])
    as_double = rows.withColumn("origin_money", F.col("origin_money").cast("double"))
    (row,) = RP.web_arppu_report(as_double, "健走", "2024-01-01", "2024-06-30").collect()
    assert row["【会员】月"] == 0.29
