import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from demandlens import schemas as S
from demandlens.functions.movement import movement_kind, movement_positions
from demandlens.operators import hourly as H
from demandlens.operators import ranking
from demandlens.plans import charts, lookups
from demandlens.plans.periods import PeriodWindow, resolve_period, with_period
from demandlens.sources.demo import demo_traffic

NOW = datetime(2026, 8, 13, 15, 30)
MONDAY = datetime(2026, 8, 10)


def parsed(spark, rows):
    """Rows of (received_at, person, ticket, artist, track, confidence[, epoch])."""
    full = [
        (at, at.date(), f"{person:016d}", ticket, f"{artist} {track}", artist, "", track, conf, 1,
         rest[0] if rest else 1)
        for at, person, ticket, artist, track, conf, *rest in rows
    ]
    return spark.createDataFrame(full, S.PARSED_SCHEMA)


def history():
    hours = timedelta(hours=1)
    return [
        (NOW, 1, 101, "aphex twin", "windowlicker", 0.9),
        (NOW, 2, 102, "aphex twin", "come to daddy", 0.9),
        (NOW, 2, 103, "aphex twin", "xtal", 0.9),
        (NOW, 3, 104, "autechre", "gantz graf", 0.9),
        (NOW, 4, 105, "autechre", "amber", 0.9),
        (NOW, 5, 106, "boards of canada", "roygbiv", 0.9),
        (MONDAY - 6 * hours, 6, 201, "boards of canada", "olson", 0.9),
        (MONDAY - 7 * hours, 7, 202, "boards of canada", "dayvan cowboy", 0.9),
        (MONDAY - 8 * hours, 8, 203, "boards of canada", "telephasic workshop", 0.9),
        (MONDAY - 9 * hours, 9, 204, "aphex twin", "avril 14th", 0.9),
        (NOW - timedelta(days=60), 10, 301, "autechre", "bike", 0.9),
        (NOW, 11, 302, "some unparseable blob", "", 0.3),
    ]


@pytest.fixture(scope="module")
def two_weeks(spark):
    return parsed(spark, history()).cache()


def rows(df):
    return [tuple(row) for row in df.collect()]


def test_artist_chart_of_two_weeks(spark, two_weeks):
    chart = charts.artist_chart(H.hourly_states(two_weeks), resolve_period("week", NOW))
    assert rows(chart) == [
        (1, "aphex twin", 3, 2, "up", 1),
        (2, "autechre", 2, 2, "re_entry", None),
        (3, "boards of canada", 1, 1, "down", -2),
    ]


def test_track_chart_never_re_enters(spark, two_weeks):
    states = H.hourly_states(two_weeks, H.TRACK)
    chart = charts.track_chart(states, resolve_period("week", NOW), page_size=3)
    assert [(r[2], r[3], r[5], r[6]) for r in rows(chart)] == [
        ("come to daddy", 1, "new", None),
        ("windowlicker", 1, "new", None),
        ("xtal", 1, "new", None),
    ]


def test_search_and_detail(spark, two_weeks):
    states, tracks = H.hourly_states(two_weeks), H.hourly_states(two_weeks, H.TRACK)
    start = lookups.history_start(NOW)
    assert rows(lookups.search_artists(states, "AUT", start)) == [("autechre", 3)]
    series, top = lookups.artist_detail(states, tracks, "aphex twin", NOW)
    assert rows(series) == [(datetime(2026, 8, 9), 1, 1), (datetime(2026, 8, 13), 3, 2)]
    assert [r[0] for r in rows(top)] == ["avril 14th", "come to daddy", "windowlicker", "xtal"]


def test_sample_rows_roll_up(spark):
    at = datetime(2026, 8, 11, 10)
    df = parsed(
        spark,
        [
            (at, 1, 1, "aphex twin", "windowlicker", 0.9),
            (at.replace(minute=5), 1, 2, "aphex twin", "come to daddy", 0.9),
            (at.replace(minute=7), 2, 3, "aphex twin", "windowlicker", 0.8),
            (at.replace(minute=30), 3, 4, "boards of canada", "dayvan cowboy", 0.9),
        ],
    )
    artists = H.collapse_epochs(H.hourly_states(df)).select("artist_name", "searches", "listeners")
    assert sorted(rows(artists)) == [("aphex twin", 3, 2), ("boards of canada", 1, 1)]
    tracks = H.collapse_epochs(H.hourly_states(df, H.TRACK), H.TRACK)
    got = sorted(rows(tracks.select("track_name", "searches", "listeners")))
    assert got == [("come to daddy", 1, 1), ("dayvan cowboy", 1, 1), ("windowlicker", 2, 2)]


def test_listeners_are_withheld_across_key_epochs(spark):
    df = parsed(
        spark,
        [
            (NOW, 1, 1, "both", "x", 0.9, 1),
            (NOW, 1, 2, "both", "x", 0.9, 2),
            (NOW, 1, 3, "one", "x", 0.9, 2),
        ],
    )
    chart = charts.artist_chart(H.hourly_states(df), resolve_period("day", NOW))
    assert [(r[1], r[2], r[3]) for r in rows(chart)] == [("both", 2, None), ("one", 1, 1)]


def test_empty_window_and_first_period(spark, two_weeks):
    states = H.hourly_states(two_weeks)
    assert rows(charts.artist_chart(states, resolve_period("day", datetime(2030, 1, 1)))) == []
    first = charts.artist_chart(states, resolve_period("week", NOW - timedelta(days=60)))
    assert rows(first) == [(1, "autechre", 1, 1, "new", None)]


def many_searches(spark, count=4000, artists=300, seed=3):
    rng = random.Random(seed)
    rows = []
    for ticket in range(count):
        # One artist holds a third of everything.
        artist = "hot" if rng.random() < 1 / 3 else f"artist {rng.randrange(artists):03d}"
        at = MONDAY - timedelta(days=7) + timedelta(minutes=rng.randrange(14 * 24 * 60))
        rows.append((at, rng.randrange(500), ticket, artist, f"t{rng.randrange(3)}", 0.9, 2))
    return parsed(spark, rows), rows


def brute_chart(rows):
    def totals(start, end):
        found = {}
        for at, person, _, artist, *_ in rows:
            if start <= at < end:
                found.setdefault(artist, []).append(person)
        order = sorted(found, key=lambda a: (-len(found[a]), a))
        return found, {artist: i + 1 for i, artist in enumerate(order)}

    week = timedelta(days=7)
    now, positions = totals(MONDAY, MONDAY + week)
    _, before = totals(MONDAY - week, MONDAY)
    out = []
    for artist, position in sorted(positions.items(), key=lambda item: item[1]):
        previous = before.get(artist)
        kind = (
            "new" if previous is None else "unchanged" if previous == position
            else "up" if previous > position else "down"
        )
        moved = None if previous is None else previous - position
        out.append((position, artist, len(now[artist]), len(set(now[artist])), kind, moved))
    return out


@pytest.mark.parametrize("top_k_limit", [ranking.TOP_K_LIMIT, 0])
def test_pages_agree_with_brute_force(spark, top_k_limit):
    df, raw = many_searches(spark)
    states = H.hourly_states(df).cache()
    expected = brute_chart(raw)
    window = resolve_period("week", NOW)
    for offset, size in ((0, 200), (40, 30), (len(expected) - 5, 50)):
        page = charts.artist_chart(states, window, size, offset, top_k_limit=top_k_limit)
        assert rows(page) == expected[offset : offset + size]


def test_sketch_and_exact_paths_agree(spark):
    df, _ = many_searches(spark)
    sketch = H.collapse_epochs(H.hourly_states(df)).select("artist_name", "searches", "listeners")
    exact = H.exact_window(df)
    assert sorted(rows(sketch)) == sorted(rows(exact))


def test_rank_all_numbers_every_row(spark):
    df = spark.range(5000).select(
        F.pmod(F.xxhash64("id"), F.lit(7)).alias("searches"),
        F.col("id").cast("string").alias("artist_name"),
    )
    order = [-F.col("searches"), F.col("artist_name")]
    ranked = ranking.rank_all(df, order).orderBy("position").collect()
    expected = sorted(df.collect(), key=lambda r: (-r[0], r[1]))
    assert [r["position"] for r in ranked] == list(range(1, 5001))
    assert [(r[0], r[1]) for r in ranked] == [(r[0], r[1]) for r in expected]


def test_previous_ranks_reuse_the_totals(spark, tmp_path):
    df, _ = many_searches(spark)
    path = str(tmp_path / "states")
    H.hourly_states(df).write.parquet(path)
    states = spark.read.parquet(path)
    chart = charts.artist_chart(states, resolve_period("week", NOW))
    chart.collect()
    plan = chart._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "unique_searchers" in plan
    # The page is cut inside every task before its rows meet.
    assert "TakeOrderedAndProject" in plan or "WindowGroupLimit" in plan


@pytest.mark.parametrize(
    ("period", "moment", "expected"),
    [
        ("week", NOW, ("2026-08-10", "2026-08-17", "2026-08-03")),
        ("day", NOW, ("2026-08-13", "2026-08-14", "2026-08-12")),
        ("month", datetime(2026, 1, 17), ("2026-01-01", "2026-02-01", "2025-12-01")),
        ("month", datetime(2026, 3, 15), ("2026-03-01", "2026-04-01", "2026-02-01")),
        ("month", datetime(2024, 12, 31), ("2024-12-01", "2025-01-01", "2024-11-01")),
    ],
)
def test_periods(spark, period, moment, expected):
    window = PeriodWindow(*(datetime.fromisoformat(bound) for bound in expected))
    assert resolve_period(period, moment) == window
    df = spark.createDataFrame([(moment,)], "at timestamp_ntz")
    row = with_period(df, "at", period).first()
    assert (row["current_start"], row["current_end"], row["previous_start"]) == tuple(window)


def test_unknown_period():
    with pytest.raises(ValueError):
        resolve_period("year", NOW)


def test_movement(spark):
    cases = [
        (1, 5, False, "up", 4),
        (7, 3, False, "down", -4),
        (2, 2, False, "unchanged", 0),
        (4, None, False, "new", None),
        (4, None, True, "re_entry", None),
    ]
    df = spark.createDataFrame(cases, "rank int, before int, seen boolean, kind string, moved int")
    got = df.select(
        movement_kind(F.col("rank"), F.col("before"), F.col("seen")),
        movement_positions(F.col("rank"), F.col("before")),
        "kind",
        "moved",
    )
    assert all(r[0] == r[2] and r[1] == r[3] for r in got.collect())


def test_page_bounds(spark, two_weeks):
    states, window = H.hourly_states(two_weeks), resolve_period("week", NOW)
    for size, offset in ((0, 0), (201, 0), (50, -1)):
        with pytest.raises(ValueError):
            charts.artist_chart(states, window, size, offset)
    with pytest.raises(ValueError):
        lookups.search_artists(states, "a", NOW)
    with pytest.raises(ValueError):
        lookups.history_start(NOW, 366)


def test_csv_export(spark, two_weeks, tmp_path):
    chart = charts.artist_chart(H.hourly_states(two_weeks), resolve_period("week", NOW))
    charts.export_csv(chart, str(tmp_path / "csv"))
    (part,) = (tmp_path / "csv").glob("*.csv")
    assert part.read_text().splitlines() == [
        "position,artist_name,searches,listeners,movement,positions",
        "1,aphex twin,3,2,up,1",
        "2,autechre,2,2,re_entry,",
        "3,boards of canada,1,1,down,-2",
    ]


def test_share_has_a_floor(spark):
    df = spark.createDataFrame([(1, 1000), (2, 500), (3, 1)], "position int, searches long")
    assert [r["share"] for r in charts.with_share(df).orderBy("position").collect()] == [
        100.0,
        50.0,
        2.0,
    ]


def test_demo_traffic_is_deterministic(spark):
    first = demo_traffic(spark, NOW).collect()
    assert sorted(first) == sorted(demo_traffic(spark, NOW).collect())
    assert 0 < len(first) < 45 * 8 * 10
    assert {r["artist_name"] for r in first} > {"aphex twin", "burial"}
