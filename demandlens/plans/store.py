"""The tables of one installation, as Parquet folders below a root."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandlens import schemas as S
from demandlens.operators.hourly import ARTIST, TRACK
from demandlens.session import shuffles_freed


@dataclass(frozen=True)
class Store:
    """Raw and parsed layers are partitioned by date, hourly tables by day."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    @property
    def raw(self) -> str:
        return self.path("search_query_events")

    @property
    def parsed(self) -> str:
        return self.path("parsed_search_queries")

    @property
    def artist_hourly(self) -> str:
        return self.path("artist_search_counts_hourly")

    @property
    def track_hourly(self) -> str:
        return self.path("track_search_counts_hourly")

    @property
    def catalogue(self) -> str:
        return self.path("artist_catalogue")

    def hourly(self, entity: tuple[str, ...]) -> str:
        return self.artist_hourly if entity == ARTIST else self.track_hourly

    def increments(self, entity: tuple[str, ...]) -> str:
        """What live roll-ups of an entity have added and no fold has taken yet."""
        return f"{self.hourly(entity)}_increments"

    def folds(self, entity: tuple[str, ...]) -> str:
        return f"{self.hourly(entity)}_folds"


def filesystem(spark: SparkSession, path: str):
    """Hadoop's view of a path and the file system it lives on."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, in order; none if there is no folder."""
    target, files = filesystem(spark, path)
    if not files.exists(target):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(target))


def write_once(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole; whoever comes second gets an error."""
    aside, files = filesystem(spark, f"{path}.{uuid.uuid4().hex}.part")
    stream = files.create(aside, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    final, _ = filesystem(spark, path)
    if files.exists(final) or not files.rename(aside, final):
        files.delete(aside, False)
        raise FileExistsError(path)


def remove(spark: SparkSession, path: str) -> None:
    target, files = filesystem(spark, path)
    files.delete(target, True)


# Days are worked on together up to so many stored bytes: what is shuffled on the way stays
# a part of the table.
BATCH_BYTES = 1024 * 1024 * 1024


def in_batches(spark: SparkSession, table: str, days: Iterable[date]) -> list[list[date]]:
    """Days of a table by date, in order, dealt into batches; a larger day is one by itself."""
    batches, room = [], 0
    for day in sorted(days):
        target, files = filesystem(spark, f"{table}/received_date={day.isoformat()}")
        size = files.getContentSummary(target).getLength() if files.exists(target) else 0
        if not batches or size > room:
            batches.append([])
            room = BATCH_BYTES
        batches[-1].append(day)
        room -= size
    return batches


def move_days(spark: SparkSession, source: str, table: str) -> None:
    """Put the date folders of one table in place of another's, without a copy of their rows."""
    folder, files = filesystem(spark, table)
    files.mkdirs(folder)
    for name in names_in(spark, source):
        if name.startswith("received_date="):
            remove(spark, f"{table}/{name}")
            day, _ = filesystem(spark, f"{source}/{name}")
            target, _ = filesystem(spark, f"{table}/{name}")
            if not files.rename(day, target):
                raise OSError(f"could not move {day} to {target}")


# Rows whose least and greatest name the index of a file keeps: what a look-up reads at least.
INDEXED_ROWS = 1_024


def replace_days(states: DataFrame, path: str, entity: tuple[str, ...]) -> None:
    """Write hourly states over the days they belong to; other days stay as they are.

    Within its day an artist lies together, by hour: a look-up finds the rows by the page
    index of a file and passes over files by their bloom filters. Files follow from the size
    of the day; an artist too large for one is split.
    """
    laid_out = states.hint("rebalance", "hour_date", ARTIST[0]).sortWithinPartitions(
        "hour_date", *entity, "hour_start"
    )
    with shuffles_freed(states.sparkSession):
        (
            laid_out.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("compression", S.COMPACT)
            .option("parquet.page.row.count.limit", INDEXED_ROWS)
            .option(f"parquet.bloom.filter.enabled#{ARTIST[0]}", "true")
            .option("parquet.bloom.filter.adaptive.enabled", "true")
            .partitionBy("hour_date")
            .parquet(path)
        )


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """What Spark named the stream of a checkpoint: kept by restarts, new with a new one."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"]


def read_layer(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table with its declared layout; empty when nothing was written yet."""
    target, files = filesystem(spark, path)
    if not files.exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def read_raw(spark: SparkSession, store: Store) -> DataFrame:
    return read_layer(spark, store.raw, S.RAW_SCHEMA)


def read_parsed(spark: SparkSession, store: Store) -> DataFrame:
    return read_layer(spark, store.parsed, S.PARSED_SCHEMA)


def read_hourly(spark: SparkSession, store: Store, entity: tuple[str, ...] = ARTIST) -> DataFrame:
    return read_layer(spark, store.hourly(entity), S.hourly_schema(*entity))


def read_catalogue(spark: SparkSession, store: Store) -> DataFrame:
    return read_layer(spark, store.catalogue, S.CATALOGUE_SCHEMA)


def write_raw_batch(raw: DataFrame, path: str, batch: str) -> None:
    """Put rows below their dates and the name of their batch.

    A batch that is written again replaces itself and nothing else, so live batches
    and imports lie in one layer. Large dates are split over files by their size.
    """
    rows = S.conform(S.refuse_usernames(raw), S.RAW_SCHEMA).withColumn("batch", F.lit(batch))
    with shuffles_freed(raw.sparkSession):
        (
            rows.hint("rebalance", "received_date")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("compression", S.COMPACT)
            .partitionBy("received_date", "batch")
            .parquet(path)
        )


def append_raw(raw: DataFrame, store: Store, batch: str | None = None) -> None:
    """Add observations under a batch name of their own; repeats collapse on reading."""
    write_raw_batch(raw, store.raw, batch or f"import-{uuid.uuid4().hex}")


ENTITIES = (ARTIST, TRACK)
