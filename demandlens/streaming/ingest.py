"""Live ingest: accepted messages, pseudonyms, relayed repeats, raw layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from demandlens import schemas as S
from demandlens.functions.privacy import pseudonymize
from demandlens.plans.store import stream_name, write_raw_batch

# Roughly how long 250,000 identities last at the observed 46.7 searches a second.
REPEAT_HORIZON = "90 minutes"

ACCEPTED_KINDS = (S.SOURCE_DISTRIBUTED, S.SOURCE_DISTRIBUTED_SERVER)

# What lands in the watched folder: one JSON message per line.
MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("user", T.StringType()),
        T.StructField("ticket", T.LongType()),
        T.StructField("query", T.StringType()),
    ]
)


def read_messages(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """Messages from files landing in a folder."""
    return spark.readStream.schema(MESSAGE_SCHEMA).options(**options).json(folder)


def accept_messages(messages: DataFrame, hex_key: str) -> DataFrame:
    """Search requests of the two accepted kinds, under pseudonyms.

    A message carries no time of its own on the wire; where the receiver did
    not stamp it, the time it is processed is taken. The user name ends here.
    """
    at = F.coalesce(F.col("received_at"), F.current_timestamp())
    return messages.where(F.col("kind").isin(*ACCEPTED_KINDS)).select(
        F.date_trunc("MILLISECOND", at).alias("received_at"),
        pseudonymize(F.col("user"), hex_key).alias("searcher_pseudonym"),
        "ticket",
        F.col("query").alias("query_text"),
        F.col("kind").alias("source"),
    )


def suppress_repeats(searches: DataFrame, horizon: str = REPEAT_HORIZON) -> DataFrame:
    """Drop a (person, ticket) pair seen within the horizon; the first one stays.

    ``received_at`` must be a zoned timestamp, as watermarks need one. State is
    spread over the pair and forgotten once the horizon has passed.
    """
    return searches.withWatermark("received_at", horizon).dropDuplicatesWithinWatermark(
        ["searcher_pseudonym", "ticket"]
    )


def to_raw(searches: DataFrame) -> DataFrame:
    """Back to zone-less times and the raw layout, ready to be written."""
    at = F.col("received_at").cast("timestamp_ntz")
    rows = searches.withColumn("received_at", at).withColumn("received_date", F.to_date(at))
    return S.conform(S.refuse_usernames(rows), S.RAW_SCHEMA)


def write_raw(
    searches: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Add each micro-batch to the raw layer, beside imported rows.

    A batch lies under the stream's own name and number, so one that is run again
    after a failure replaces what it wrote before.
    """

    def add(batch: DataFrame, number: int) -> None:
        name = stream_name(batch.sparkSession, checkpoint)
        write_raw_batch(batch, path, f"{name}-{number}")

    writer = (
        to_raw(searches)
        .writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="5 seconds"
    )
    return writer.start()
