"""Mergeable distinct counts, sums that do not depend on row order, one-read candidates, safe output."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from conftest import SF01, SF001, purchase
from pyspark.sql import functions as F

from cohortwise import cli
from cohortwise.functions import rules as R
from cohortwise.operators import distinct_state as DS
from cohortwise.operators import purchases as P
from cohortwise.operators import renewal as N
from cohortwise.plans import inspect
from cohortwise.plans import registry as Q
from cohortwise.plans import reports as RP
from cohortwise.sources import fixtures as FX
from cohortwise.sources.events import write_events

# --- states ------------------------------------------------------------------


def visits(spark, seed=1, n=3000):
    rng = random.Random(seed)
    ids = [None, 0, -1, -40000, 32767, 32768, 10**12, *range(1, 400)]
    rows = [(rng.choice("abc"), rng.randrange(6), rng.choice(ids), rng.random() < 0.3) for _ in range(n)]
    rows += [("only null", 1, None, True)]
    return rows, spark.createDataFrame(rows, "cell string, day int, id long, good boolean")


COUNTS = {"everyone": "TRUE", "good_ones": "good"}


def brute(rows, key):
    out = {}
    for r in rows:
        a, b = out.setdefault(key(r), (set(), set()))
        if r[2] is not None:
            a.add(r[2])
            if r[3]:
                b.add(r[2])
    return {k: (len(a), len(b)) for k, (a, b) in out.items()}


def test_states_of_days_merge_to_the_range(spark):
    rows, df = visits(spark)
    days = [DS.distinct_state(df.where(F.col("day") == d), ["cell", "day"], "id", COUNTS) for d in range(6)]
    merged = DS.merge_states(*days)
    assert {(r[0], r[1]): (r[2], r[3]) for r in DS.state_counts(merged).collect()} == brute(rows, lambda r: (r[0], r[1]))
    by_cell = DS.state_counts(DS.merge_states(*days, keys=["cell"]))
    assert {r[0]: (r[1], r[2]) for r in by_cell.collect()} == brute(rows, lambda r: r[0])
    twice = DS.state_counts(DS.merge_states(merged, merged, keys=["cell"]))
    assert Counter(map(tuple, twice.collect())) == Counter(map(tuple, by_cell.collect()))


def test_a_written_state_is_read_again(spark, tmp_path):
    rows, df = visits(spark, 2)
    DS.distinct_state(df.where("day < 3"), ["cell"], "id", COUNTS).write.parquet(f"{tmp_path}/a")
    DS.distinct_state(df.where("day >= 3"), ["cell"], "id", COUNTS).write.parquet(f"{tmp_path}/b")
    both = DS.merge_states(spark.read.parquet(f"{tmp_path}/a"), spark.read.parquet(f"{tmp_path}/b"))
    assert {r[0]: (r[1], r[2]) for r in DS.state_counts(both).collect()} == brute(rows, lambda r: r[0])


def test_states_have_a_fixed_size(spark):
    _, df = visits(spark, 3)
    sizes = DS.distinct_state(df, ["cell"], "id", COUNTS).select(F.length("everyone"), F.length("good_ones")).distinct().collect()
    assert [tuple(r) for r in sizes] == [(4096, 4096)]


def test_ids_must_be_whole_numbers(spark):
    _, df = visits(spark)
    with pytest.raises(ValueError, match="whole-number"):
        DS.distinct_state(df.withColumn("id", F.col("id").cast("string")), ["cell"], "id", COUNTS)


@pytest.mark.parametrize("merged,plain", [("inapp_renewal_users_merged", "inapp_renewal_users"), ("web_renewal_users_merged", "web_renewal_users")])
def test_half_ranges_merge_to_d9_and_d10(spark, merged, plain):
    a, b = Q.QUERIES[merged](spark, SF01), Q.QUERIES[plain](spark, SF01)
    assert Counter(map(tuple, a.select(*b.columns).collect())) == Counter(map(tuple, b.collect()))


# --- sums --------------------------------------------------------------------


def double_money(spark):
    """Amounts whose double sums depend on the order: large and tiny ones, halves of a cent."""
    rng = random.Random(6)
    web = dict(product="webob_0d7-29.9d30", ptype="会员")
    rows = [purchase(user=k % 50, order_id=k % 97, date=f"2024-0{1 + k % 3}-1{k % 9}", order_type=rng.choice(["新增", "续订"]), **web) for k in range(600)]
    events = spark.createDataFrame(rows, Q.FX.PURCHASE_COLUMNS).drop("origin_money")
    amounts = spark.createDataFrame([(k, rng.choice([0.1, 0.005, 1e9 + 0.1, 33.335, 1e-3])) for k in range(600)], "k long, origin_money double")
    return events.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])).toDF(events.schema.add("k", "long")).join(amounts, "k").drop("k")


def test_double_money_sums_do_not_depend_on_partitioning(spark, tmp_path):
    double_money(spark).write.parquet(f"{tmp_path}/events")
    events = spark.read.parquet(f"{tmp_path}/events")
    assert dict(events.dtypes)["origin_money"] == "double"
    seen = set()
    for k in range(50):
        dealt = events.repartition(1 + k % 7, F.rand(k)).sortWithinPartitions(F.rand(k + 100))
        seen.add(tuple(map(tuple, RP.web_arppu_report(dealt, "健走", "2024-01-01", "2024-06-30").collect())))
    assert len(seen) == 1
    plain = {events.repartition(1 + k % 7, F.rand(k)).agg(F.sum("origin_money")).first()[0] for k in range(20)}
    assert len(plain) > 1  # the plain sum does depend on it


@pytest.mark.parametrize("report", [RP.inapp_renewal_report, RP.web_renewal_report, RP.web_new_sales_report])
def test_double_money_gives_the_reports_of_decimal_money(spark, report):
    events = FX.load_purchase_events(spark, SF001)
    double = events.withColumn("origin_money", F.col("origin_money").cast("double"))
    rows = lambda ev: [tuple(r) for r in report(ev, Q.LINE, Q.S, Q.E).collect()]
    assert rows(double) == rows(events)


def test_money_that_no_decimal_holds_is_refused(spark, purchases):
    web = dict(product="webob_0d7-29.9d30", ptype="会员")
    for amount in ("NaN", "Infinity", "-1e22"):
        events = purchases([purchase(order_id=1, **web)]).withColumn("origin_money", F.lit(amount).cast("double"))
        with pytest.raises(Exception, match="no DECIMAL"):
            RP.web_arppu_report(events, "健走", "2024-01-01", "2024-06-30").collect()


# --- D5, D7, order, output -----------------------------------------------------


def test_plan_mix_counts_nulls_as_count_distinct_does(spark, purchases):
    web = dict(product="webob_0d7-29.9d30", ptype="会员")
    rows = [purchase(user=u, order_id=o, money=m, **web) for u, o, m in [(1, 1, "1"), (1, 1, "2"), (None, 1, "4"), (2, None, "8"), (2, 2, None), (2, 2, None)]]
    got = P.web_plan_mix(purchases(rows), "健走", "2024-01-01", "2024-01-31").collect()
    assert [(r["orders"], r["users"], r["revenue"]) for r in got] == [(2, 2, 15.0)]


@pytest.mark.parametrize("kind", ["inapp", "web"])
def test_one_read_candidates_equal_the_join(spark, kind):
    events = FX.load_purchase_events(spark, SF01)
    base = P.inapp_base_orders(events, Q.LINE, Q.S, Q.E) if kind == "inapp" else RP.web_first_orders(events, Q.LINE, Q.S, Q.E)
    joined = N.renewal_candidates(events, base, Q.LINE, Q.S, Q.E, kind)
    one = N.renewal_candidates_one_read(events, Q.LINE, Q.S, Q.E, kind)
    assert inspect.scan_count(one) == 1
    assert one.columns == joined.columns
    assert Counter(map(tuple, one.collect())) == Counter(map(tuple, joined.collect()))


def test_positions_follow_the_rows(spark):
    rows = Q.QUERIES["web_new_sales_report_ordered"](spark, SF01).collect()
    assert [r["position"] for r in rows] == list(range(1, len(rows) + 1))
    assert [tuple(r)[:-1] for r in rows] == [tuple(r) for r in Q.QUERIES["web_new_sales_report"](spark, SF01).collect()]


def test_output_is_not_replaced_unless_told(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "build_session", lambda master=None: spark)
    write_events(FX.load_purchase_events(spark, SF001), f"{tmp_path}/events")
    run = lambda *more: cli.main(["web-arppu", "--events", f"{tmp_path}/events", "--start", Q.S, "--end", Q.E, "--out", f"{tmp_path}/out", *more])
    run()
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        run()
    run("--overwrite")
    assert spark.read.parquet(f"{tmp_path}/out").count() == Q.web_arppu_report(spark, SF001).count()


def test_cohort_first_from_the_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "build_session", lambda master=None: spark)
    write_events(FX.load_walk_events(spark, SF001), f"{tmp_path}/events")
    cohorts = FX.load_cohorts(spark, SF001)
    for group, name in ((R.GROUP_EXPERIMENT, "a"), (R.GROUP_CONTROL, "b")):
        cohorts.where(F.col("group_name") == group).select("user_id").write.parquet(f"{tmp_path}/{name}")
    out = []
    for more in ([], ["--all-users"]):
        cli.main(["training", "--events", f"{tmp_path}/events", "--experiment", f"{tmp_path}/a", "--control", f"{tmp_path}/b", "--start", FX.WALK_START, "--end", FX.WALK_END, "--show", *more])
        out.append(capsys.readouterr().out)
    assert out[0] == out[1] and len(out[0].splitlines()) == 15
