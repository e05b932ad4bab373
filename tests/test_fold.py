"""Live increments into the hourly tables: each counts once, whatever breaks."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from demandlens import schemas as S
from demandlens.operators import hourly as H
from demandlens.plans import charts, fold
from demandlens.plans import reprocess as R
from demandlens.plans import store as ST
from demandlens.plans.periods import resolve_period
from demandlens.streaming import rollup

START = datetime(2026, 8, 10, 22)


def parsed(spark, first, last):
    rows = []
    for n in range(first, last):
        at = START + timedelta(minutes=10 * n)
        rows.append((at, at.date(), f"{n % 5:016d}", n, "q", f"artist {n % 3}", "", "", 0.9, 2, 2))
    return spark.createDataFrame(rows, S.PARSED_SCHEMA)


def land(spark, folder, first, last):
    parsed(spark, first, last).coalesce(1).write.mode("append").parquet(str(folder))


def roll_up(spark, folder, place, checkpoint):
    stream = spark.readStream.schema(S.PARSED_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = rollup.maintain_hourly(
        stream, place.increments(H.ARTIST), f"{place.root}/{checkpoint}", available_now=True
    )
    query.awaitTermination()


def rows_of(states):
    return sorted(
        tuple(r) for r in states.select(
            "hour_start", "key_epoch", "artist_name", "search_count",
            F.theta_sketch_estimate("unique_searchers").alias("people"),
        ).collect()
    )


@pytest.fixture
def place(tmp_path):
    return ST.Store(str(tmp_path / "store"))


def test_folds_leave_what_one_batch_leaves(spark, place, tmp_path):
    folder = tmp_path / "in"
    for part in ((0, 20), (20, 35)):
        land(spark, folder, *part)
    roll_up(spark, folder, place, "one")
    assert fold.fold_increments(spark, place) == [date(2026, 8, 10), date(2026, 8, 11)]
    assert rows_of(ST.read_hourly(spark, place)) == rows_of(H.hourly_states(parsed(spark, 0, 35)))
    assert fold.fold_increments(spark, place) == []
    # The same stream goes on, and one with a checkpoint of its own joins in.
    land(spark, folder, 35, 50)
    roll_up(spark, folder, place, "one")
    land(spark, tmp_path / "other", 50, 70)
    roll_up(spark, tmp_path / "other", place, "two")
    assert fold.fold_increments(spark, place) == [date(2026, 8, 11)]
    assert rows_of(ST.read_hourly(spark, place)) == rows_of(H.hourly_states(parsed(spark, 0, 70)))
    window = resolve_period("day", datetime(2026, 8, 11, 12))
    live = [tuple(r) for r in charts.artist_chart(ST.read_hourly(spark, place), window).collect()]
    batch = [tuple(r) for r in charts.artist_chart(H.hourly_states(parsed(spark, 0, 70)), window).collect()]
    assert live == batch and len(live) == 3


@pytest.mark.parametrize("broken", ["before the decision", "before the days", "between days and mark", "before removal"])
def test_a_fold_that_breaks_counts_once(spark, place, tmp_path, monkeypatch, broken):
    land(spark, tmp_path / "in", 0, 30)
    roll_up(spark, tmp_path / "in", place, "one")

    def fails(*_, **__):
        raise RuntimeError("lost")

    whole = fold.replace_days
    with monkeypatch.context() as patch:
        if broken == "before the decision":
            patch.setattr(fold, "write_once", fails)
        elif broken == "before the days":
            patch.setattr(fold, "replace_days", fails)
        elif broken == "between days and mark":
            patch.setattr(fold, "replace_days", lambda *a: (whole(*a), fails()))
        else:
            patch.setattr(fold, "remove", fails)
        with pytest.raises(RuntimeError):
            fold.fold_increments(spark, place)
    land(spark, tmp_path / "in", 30, 40)
    roll_up(spark, tmp_path / "in", place, "one")
    fold.fold_increments(spark, place)
    assert rows_of(ST.read_hourly(spark, place)) == rows_of(H.hourly_states(parsed(spark, 0, 40)))
    marks, is_done = fold.last_marks(spark, place, H.ARTIST)
    assert is_done and fold.pending_increments(spark, place, H.ARTIST, marks) == ({}, [])


def test_a_batch_that_runs_again_is_not_added_again(spark, place, tmp_path):
    land(spark, tmp_path / "in", 0, 30)
    roll_up(spark, tmp_path / "in", place, "one")
    again = spark.read.parquet(place.increments(H.ARTIST)).cache()
    assert again.count() > 0
    fold.fold_increments(spark, place)
    want = rows_of(ST.read_hourly(spark, place))
    # The stream was lost before it noted its last batch, and writes it once more.
    again.write.mode("append").partitionBy("hour_date", "increment").parquet(place.increments(H.ARTIST))
    assert fold.fold_increments(spark, place) == []
    assert rows_of(ST.read_hourly(spark, place)) == want
    marks, _ = fold.last_marks(spark, place, H.ARTIST)
    assert fold.pending_increments(spark, place, H.ARTIST, marks) == ({}, [])


def test_of_two_folds_at_once_one_fails_whole(spark, place, tmp_path):
    land(spark, tmp_path / "in", 0, 10)
    roll_up(spark, tmp_path / "in", place, "one")
    fold.prepare(spark, place)
    marks, _ = fold.last_marks(spark, place, H.ARTIST)
    with pytest.raises(FileExistsError):
        fold._decide(spark, place, H.ARTIST, marks)
    fold.complete(spark, place)
    assert rows_of(ST.read_hourly(spark, place)) == rows_of(H.hourly_states(parsed(spark, 0, 10)))


def test_days_recomputed_from_parsed_rows_are_sealed(spark, place, tmp_path):
    land(spark, tmp_path / "in", 0, 30)
    roll_up(spark, tmp_path / "in", place, "one")
    fold.fold_increments(spark, place)
    all_rows = parsed(spark, 0, 45)
    all_rows.write.partitionBy("received_date").parquet(place.parsed)
    R.refresh_hourly(spark, place, [date(2026, 8, 10)])
    land(spark, tmp_path / "late", 2, 45)
    roll_up(spark, tmp_path / "late", place, "two")
    fold.fold_increments(spark, place)
    first = F.col("hour_date") == date(2026, 8, 10)
    states = ST.read_hourly(spark, place)
    want = H.hourly_states(all_rows)
    assert rows_of(states.where(first)) == rows_of(want.where(first))
    live = H.hourly_states(parsed(spark, 12, 30).unionByName(parsed(spark, 12, 45)))
    assert rows_of(states.where(~first)) == rows_of(live.where(~first))
