"""Look-ups of one artist read little of the stored hourly tables."""

from datetime import datetime

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from demandlens.operators import hourly
from demandlens.operators.hourly import ARTIST, TRACK
from demandlens.plans import lookups, store

FOLDER_DAYS = 2
ARTISTS = 12_000


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    """Two days of 12,000 artists, each asked for in five hours; one holds a third of all."""
    made = store.Store(str(tmp_path_factory.mktemp("hourly")))
    n = ARTISTS * 5 * FOLDER_DAYS
    number = F.when(F.col("id") % 3 == 0, 7).otherwise((F.col("id") / 5).cast("int") % ARTISTS)
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % 5 * 3600 + F.col("id") % FOLDER_DAYS * 86_400)
    searches = spark.range(n).select(
        at.cast("timestamp_ntz").alias("received_at"),
        F.to_date(at).alias("received_date"),
        F.lpad(F.hex("id"), 16, "0").alias("searcher_pseudonym"),
        F.concat(F.lit("artist "), F.lpad(number.cast("string"), 5, "0")).alias("artist_name"),
        F.concat(F.lit("track "), (F.col("id") % 4).cast("string")).alias("track_name"),
        F.lit(0.9).cast("float").alias("parse_confidence"),
        F.lit(2).cast("smallint").alias("key_epoch"),
    )
    for entity in (ARTIST, TRACK):
        states = hourly.conform_hourly(hourly.hourly_states(searches, entity), entity)
        store.replace_days(states, made.hourly(entity), entity)
    return made


def rows_read(df):
    """Rows that the scan of a plan without a shuffle gave to its filter."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    while node.children().size():
        node = node.children().apply(0)
    return node.metrics().apply("numOutputRows").value()


@pytest.mark.parametrize("entity", [ARTIST, TRACK])
@pytest.mark.parametrize("name", ["artist 00011", "artist 03999"])
def test_one_artist_reads_under_a_tenth(spark, place, entity, name):
    table = store.read_hourly(spark, place, entity)
    found = table.where(F.col("artist_name") == name).select("hour_start", "search_count")
    every = table.count()
    assert 0 < rows_read(found) < every / 10
    assert found.count() == table.where(F.concat("artist_name", F.lit("")) == name).count() > 0


def test_an_absent_artist_reads_next_to_nothing(spark, place):
    table = store.read_hourly(spark, place)
    assert rows_read(table.where(F.col("artist_name") == "artist 00011x").select("search_count")) == 0


def test_pages_of_files_are_indexed_and_filtered(spark, place):
    paths = [row[0] for row in store.read_hourly(spark, place).select(F.input_file_name()).distinct().collect()]
    for path in paths:
        meta = pq.ParquetFile(path.removeprefix("file://")).metadata
        names = meta.schema.names
        column = meta.row_group(0).column(names.index("artist_name"))
        assert column.has_column_index and column.has_offset_index


def test_an_artist_lies_in_one_file_a_day(spark, place):
    rows = store.read_hourly(spark, place, TRACK).select(
        "hour_date", "artist_name", F.input_file_name().alias("file")
    )
    most = rows.groupBy("hour_date", "artist_name").agg(F.count_distinct("file").alias("files"))
    assert most.agg(F.max("files")).first()[0] == 1


def test_the_plan_pushes_the_name_down(spark, place, capsys):
    found = lookups.artist_time_series(store.read_hourly(spark, place), "artist 00007", datetime(2024, 1, 1))
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(artist_name,artist 00007)" in plan and "PartitionFilters" in plan
    assert sum(row.searches for row in found.collect()) > ARTISTS
