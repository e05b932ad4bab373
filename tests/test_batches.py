"""Reprocessing in batches of days: the same tables, and no copies of them on the way."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from demandlens import schemas as S
from demandlens.operators import hourly as H
from demandlens.plans import reprocess as R
from demandlens.plans import store as P

NAMES = ["muse", "aphex twin"]


def _raw(spark, rows):
    """Rows of (day, hour, person, ticket, text, source)."""
    full = []
    for day, hour, person, ticket, text, source in rows:
        at = dt.datetime(2024, 1, day, hour)
        full.append((at, at.date(), person, ticket, text, source))
    return spark.createDataFrame(full, S.RAW_SCHEMA)


def _searches(first, last):
    rows = []
    for n in range(first, last):
        text = [f"muse song {n}", "aphex twin - avril", None, f"other {n} - song"][n % 4]
        source = S.SOURCE_IMPORTED if n % 3 else S.SOURCE_DISTRIBUTED
        person = None if n % 7 == 0 else f"{n % 5:016x}"
        rows.append((1 + n % 3, n % 24, person, n, text, source))
    return [*rows, *rows[::2]]


def _place(spark, path):
    place = P.Store(str(path))
    names = spark.createDataFrame([(n, n, 1) for n in NAMES], "a string, b string, c int")
    names.toDF(*S.CATALOGUE_SCHEMA.names).write.parquet(place.catalogue)
    return place


def _tables(spark, place):
    tables = [P.read_parsed(spark, place)]
    for entity in P.ENTITIES:
        states = P.read_hourly(spark, place, entity)
        people = F.theta_sketch_estimate("unique_searchers")
        tables.append(states.withColumn("unique_searchers", people))
    return [sorted(map(tuple, t.collect()), key=str) for t in tables]


@pytest.fixture
def parts(monkeypatch):
    """How many batches each table was dealt into."""
    seen, deal = [], P.in_batches
    noted = lambda *a: (seen.append(deal(*a)), seen[-1])[1]
    monkeypatch.setattr(R, "in_batches", noted)
    return seen


def test_batches_give_what_one_run_gives(spark, tmp_path, monkeypatch, parts):
    got = []
    for name, size in (("one", 2**40), ("each", 1)):
        monkeypatch.setattr(P, "BATCH_BYTES", size)
        place = _place(spark, tmp_path / name)
        P.append_raw(_raw(spark, _searches(0, 60)), place)
        assert R.reprocess(spark, place, use_catalogue=False) == 60
        # Days that were parsed before are merged.
        P.append_raw(_raw(spark, _searches(40, 80)), place)
        R.reprocess(spark, place, use_catalogue=False)
        got.append(_tables(spark, place))
        assert all(len(p) == (1 if name == "one" else len(sum(p, []))) for p in parts)
        parts.clear()
    assert got[0] == got[1] and len(got[0][0]) == 80
    # A part of the days leaves the others alone.
    R.refresh_hourly(spark, place, [dt.date(2024, 1, 3), dt.date(2024, 1, 2)])
    assert _tables(spark, place) == got[0]


def test_days_of_a_table_are_dealt_by_their_size(spark, tmp_path, monkeypatch):
    rows = spark.range(4).select(F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("id").cast("int")).alias("received_date"), "id")
    rows.repartition(1).write.partitionBy("received_date").parquet(str(tmp_path / "t"))
    days = [dt.date(2024, 1, d) for d in (4, 1, 3, 2, 9)]
    for size, batches in {1: 5, 2**40: 1}.items():
        monkeypatch.setattr(P, "BATCH_BYTES", size)
        dealt = P.in_batches(spark, str(tmp_path / "t"), days)
        assert sum(dealt, []) == sorted(days) and len(dealt) == batches
    assert P.in_batches(spark, str(tmp_path / "none"), []) == []


def test_rows_filed_under_another_day_stay_in_their_hour(spark, tmp_path, monkeypatch, parts):
    monkeypatch.setattr(P, "BATCH_BYTES", 1)
    place = P.Store(str(tmp_path / "store"))
    at = dt.datetime(2024, 1, 2, 5)
    rows = [(at, dt.date(2024, 1, d), "a" * 16, d, "", "muse", "", "", 0.9, 2, 1) for d in (1, 2, 3)]
    fields = ["received_at", "received_date", "searcher_pseudonym", "ticket", "query_text", "artist_name",
              "album_name", "track_name", "parse_confidence", "parser_version", "key_epoch"]
    types = "timestamp_ntz date string long string string string string float int smallint".split()
    parsed = spark.createDataFrame(rows, ", ".join(f"{f} {t}" for f, t in zip(fields, types, strict=True)))
    parsed.write.partitionBy("received_date").parquet(place.parsed)
    R.refresh_hourly(spark, place, [dt.date(2024, 1, d) for d in (1, 2, 3)])
    assert [r["search_count"] for r in P.read_hourly(spark, place, H.ARTIST).collect()] == [3]


def test_a_run_that_fails_leaves_no_rows_behind(spark, tmp_path, monkeypatch):
    place = _place(spark, tmp_path / "store")
    P.append_raw(_raw(spark, _searches(0, 12)), place)
    R.reprocess(spark, place, use_catalogue=False)
    before, folders = _tables(spark, place), sorted(os.listdir(place.root))
    fails = lambda s, *a: s.withColumn("artist_name", F.raise_error(F.lit("broken")))
    monkeypatch.setattr(R, "parse_searches", fails)
    with pytest.raises(Exception, match="broken|artist|column"):
        R.reprocess(spark, place)
    assert _tables(spark, place) == before and sorted(os.listdir(place.root)) == folders


def test_parsed_days_are_moved_and_compact(spark, tmp_path):
    place = _place(spark, tmp_path / "store")
    P.append_raw(_raw(spark, _searches(0, 30)), place)
    R.reprocess(spark, place)
    for table in (place.raw, place.parsed, place.artist_hourly, place.track_hourly):
        files = [f for _, _, names in os.walk(table) for f in names if f.endswith(".parquet")]
        assert files and all(".zstd." in f for f in files), table
    assert not any(n.startswith("parsed_search_queries_") for n in os.listdir(place.root))
