"""Trends by share of people, and dump lines that are not one record."""

from datetime import datetime, timedelta

import pytest

from demandlens.plans import trends
from demandlens.plans.periods import resolve_period
from demandlens.sources import catalogue

WINDOW = resolve_period("week", datetime(2026, 8, 12))


def test_shares_of_both_weeks(spark):
    now, before, outside = WINDOW.current_start, WINDOW.previous_start, WINDOW.current_end
    rows = [(now, "p1", "muse"), (now, "p1", "muse"), (now + timedelta(days=6), "p2", "new"), (now, "p3", ""),
            (now, "p4", None), (now, None, "muse"), (before, "p1", "gone"), (before, "p2", "muse"),
            (outside, "p9", "muse"), (before - timedelta(seconds=1), "p8", "muse")]
    df = spark.createDataFrame(rows, "received_at timestamp_ntz, searcher_pseudonym string, artist_name string")
    got = {r.artist_name: tuple(r)[1:] for r in trends.trends(df, WINDOW).collect()}
    assert got == {
        "muse": (1, 1, 0.5, 0.25, pytest.approx(-0.25)), "new": (0, 1, 0.0, 0.25, pytest.approx(0.25)),
        "gone": (1, 0, 0.5, 0.0, pytest.approx(-0.5)),
    }
    only_now = trends.trends(df.where("received_at >= '%s'" % now), WINDOW).collect()
    assert {r.artist_name: (r.share_before, r.change) for r in only_now}["new"] == (None, pytest.approx(0.25))
    assert trends.trends(df.where("false"), WINDOW).count() == 0


def test_a_dump_line_is_one_object(spark):
    lines = ['{"name":"a"}{"name":"b"}', '{"name":"c"} junk', ' {"name":"d","aliases":[{"name":"e"},{"name":7}]} ',
             '["f"]', '"g"', "", "   ", None, '{"name":"h"', '{"name":"i"},{"name":"j"}', '{"name":8}']
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert sorted(r.display_name for r in catalogue.dump_names(df).collect()) == ["d", "e"]
    assert tuple(catalogue.dump_report(df).first()) == (2, 9)
