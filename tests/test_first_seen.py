"""Kept first hours: charts as before, days replaced and expired, little read."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from demandlens import schemas as S
from demandlens.operators import hourly as H
from demandlens.plans import charts, first_seen, maintenance
from demandlens.plans import store as ST
from demandlens.plans.periods import resolve_period

START = datetime(2026, 6, 1, 3)


def states(spark, rows):
    full = [
        (at, at.date(), f"{n % 3:016d}", n, "q", name, "", "", 0.9, 2, 2) for n, (at, name) in enumerate(rows)
    ]
    return H.conform_hourly(H.hourly_states(spark.createDataFrame(full, S.PARSED_SCHEMA)), H.ARTIST)


def day(n):
    return START + timedelta(days=n)


ROWS = [(day(n), f"a{n % 7}") for n in range(40)] + [(day(n), "always") for n in range(0, 70, 3)] + [
    (day(65), "new"), (day(66), "a1"), (day(10), "old"), (day(66), "old"),
]


def load(spark, place, rows):
    part = states(spark, rows)
    ST.replace_days(part, place.artist_hourly, H.ARTIST)
    first_seen.update(spark, place, {at.date() for at, _ in rows})


def known(spark, place):
    return {r.artist_name: r.first_hour for r in first_seen.read(spark, place).collect()}


def true_first(spark, place):
    rows = first_seen.first_hours(ST.read_hourly(spark, place)).collect()
    return {r.artist_name: r.first_hour for r in rows}


@pytest.fixture
def place(tmp_path):
    return ST.Store(str(tmp_path / "store"))


def test_updates_in_any_order_keep_the_first_hours(spark, place):
    parts = [[r for r in ROWS if lo <= r[0] < day(hi)] for lo, hi in ((day(50), 99), (day(0), 20), (day(20), 50))]
    for part in parts:
        load(spark, place, part)
        assert known(spark, place) == true_first(spark, place)
    load(spark, place, parts[1])
    assert known(spark, place) == true_first(spark, place)
    assert len(known(spark, place)) == 10


def test_a_replaced_day_takes_its_names_along(spark, place):
    load(spark, place, ROWS)
    # Day 10 no longer has "old", and day 0 begins later.
    load(spark, place, [(day(10), "other"), (day(0) + timedelta(hours=5), "always")])
    got = known(spark, place)
    assert got == true_first(spark, place)
    assert got["old"] == day(66) and got["other"] == day(10)
    assert got["always"] == day(0) + timedelta(hours=5)


def test_charts_are_those_without_it_and_read_two_weeks(spark, place):
    load(spark, place, ROWS)
    window = resolve_period("week", day(66))
    table = ST.read_hourly(spark, place)
    plain = charts.artist_chart(table, window)
    quick = charts.artist_chart(table, window, first_seen=first_seen.read(spark, place))
    assert [tuple(r) for r in quick.collect()] == [tuple(r) for r in plain.collect()]
    assert {r.movement for r in quick.collect()} >= {"new", "re_entry"}
    plan = quick._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "FileScan parquet" in x and "search_count" in x]
    assert scans and all("hour_date#" in x and ">= 20" in x for x in scans)
    lowest = {m for x in scans for m in re.findall(r">= (\d{4}-\d\d-\d\d)", x)}
    assert lowest and min(lowest) >= (window.previous_start.date() - timedelta(days=1)).isoformat()


def test_expired_hours_give_way_to_what_is_left(spark, place):
    load(spark, place, ROWS)
    as_of = datetime(2029, 6, 21)
    maintenance.drop_expired(spark, place.artist_hourly, "hourly", as_of)
    first_seen.expire(spark, place, as_of)
    got = known(spark, place)
    start = datetime(2026, 6, 21)
    want = first_seen.first_hours(ST.read_hourly(spark, place).where(F.col("hour_start") >= start))
    assert got == {r.artist_name: r.first_hour for r in want.collect()}
    assert got["old"] == day(66) and min(got.values()) >= start


def test_only_two_versions_stay(spark, place):
    for n in range(4):
        load(spark, place, [(day(n), "x")])
    assert sum(x.startswith("version=") for x in ST.names_in(spark, first_seen.path(place))) == 2
    first_seen.update(spark, place, [])
    assert known(spark, place) == {"x": day(0)}
    assert first_seen.read(spark, ST.Store(place.root + "-none")).count() == 0
