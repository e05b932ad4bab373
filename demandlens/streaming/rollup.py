"""Keeping hourly states up to date while parsed searches arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from demandlens.operators.hourly import ARTIST, conform_hourly, hourly_states, merge_increments
from demandlens.plans.store import stream_name
from demandlens.schemas import hourly_schema


def maintain_hourly(
    parsed: DataFrame,
    path: str,
    checkpoint: str,
    entity: Sequence[str] = ARTIST,
    available_now: bool = False,
) -> StreamingQuery:
    """Roll up each micro-batch and keep it as an increment of its own.

    Counts and sketches merge, so no streaming state is held and no row is ever
    too late. An increment lies below its day, under the stream's own name and batch
    number: a batch run again after a failure replaces what it wrote before, and a
    stream with a new checkpoint adds to what is there. Repeats must be suppressed
    upstream. Charts read increments once ``plans.fold`` has taken them; it looks for them
    at ``Store.increments``.
    """

    def add_increment(batch: DataFrame, batch_id: int) -> None:
        states = conform_hourly(hourly_states(batch, entity), entity)
        name = stream_name(batch.sparkSession, checkpoint)
        (
            states.withColumn("increment", F.lit(f"{name}-{batch_id}"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("hour_date", "increment")
            .parquet(path)
        )

    writer = (
        parsed.writeStream.foreachBatch(add_increment)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="1 minute"
    )
    return writer.start()


def read_increments(spark: SparkSession, path: str, entity: Sequence[str] = ARTIST) -> DataFrame:
    """The merged hourly states of all increments."""
    increments = spark.read.schema(hourly_schema(*entity)).parquet(path)
    return merge_increments(increments, entity)
