"""Hourly states: search counts and mergeable sketches of distinct people.

Only the hourly grain is stored. Longer windows merge it: counts add up and
sketches unite. People under different pseudonym keys are never merged, so a
group that touches two key epochs has no listener count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens import schemas as S
from demandlens.functions.parsing import is_chartable

ARTIST = ("artist_name",)
TRACK = ("artist_name", "track_name")

# 2^16 retained hashes: exact up to that many people, about 0.4 % off beyond.
SKETCH_LG = 16


def chartable(parsed: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Rows that may enter a chart: confident, and every name of the entity given."""
    gate = is_chartable(F.col("parse_confidence"))
    for name in entity:
        gate = gate & (F.col(name) != "")
    return parsed.where(gate)


def hourly_states(parsed: DataFrame, entity: Sequence[str] = ARTIST) -> DataFrame:
    """Parsed searches, one row per search, rolled up by hour, epoch and entity."""
    hour = F.date_trunc("HOUR", "received_at").cast("timestamp_ntz")
    return (
        chartable(parsed, entity)
        .groupBy(hour.alias("hour_start"), "key_epoch", *entity)
        .agg(
            F.count("*").alias("search_count"),
            F.theta_sketch_agg("searcher_pseudonym", SKETCH_LG).alias("unique_searchers"),
        )
        .withColumn("hour_date", F.to_date("hour_start"))
        .select(
            "hour_start", "hour_date", "key_epoch", *entity, "search_count", "unique_searchers"
        )
    )


def merge_increments(increments: DataFrame, entity: Sequence[str] = ARTIST) -> DataFrame:
    """States of the same hour, epoch and entity from several loads become one."""
    return increments.groupBy("hour_start", "hour_date", "key_epoch", *entity).agg(
        F.sum("search_count").alias("search_count"),
        F.theta_union_agg("unique_searchers", SKETCH_LG).alias("unique_searchers"),
    )


def in_hours(hourly: DataFrame, start: Column | None, end: Column | None = None) -> DataFrame:
    """The half-open window [start, end), stated on the partition column as well."""
    if start is not None:
        hourly = hourly.where(
            (F.col("hour_date") >= F.to_date(start)) & (F.col("hour_start") >= start)
        )
    if end is not None:
        hourly = hourly.where((F.col("hour_date") <= F.to_date(end)) & (F.col("hour_start") < end))
    return hourly


def merge_window(hourly: DataFrame, entity: Sequence[str] = ARTIST) -> DataFrame:
    """Searches and people per entity and key epoch."""
    return hourly.groupBy(*entity, "key_epoch").agg(
        F.sum("search_count").alias("searches"),
        people(F.col("unique_searchers")).alias("listeners"),
    )


def people(sketch: Column) -> Column:
    return F.theta_sketch_estimate(F.theta_union_agg(sketch, SKETCH_LG))


def listeners_if_one_epoch(sketch: Column, epoch: Column) -> Column:
    """Distinct people of a group, withheld when it touches two key epochs.

    With a single epoch the union over the group is the union over that epoch,
    so one aggregation does; there is no need to group by epoch first.
    """
    return F.when(F.min(epoch) == F.max(epoch), people(sketch))


def collapse_epochs(hourly: DataFrame, entity: Sequence[str] = ARTIST) -> DataFrame:
    """Searches summed over all epochs; listeners only where there is one epoch."""
    return hourly.groupBy(*entity).agg(
        F.sum("search_count").alias("searches"),
        listeners_if_one_epoch(F.col("unique_searchers"), F.col("key_epoch")).alias("listeners"),
        F.count_distinct("key_epoch").alias("epoch_count"),
    )


def exact_window(parsed: DataFrame, entity: Sequence[str] = ARTIST) -> DataFrame:
    """Exact counterpart of ``collapse_epochs`` over the parsed layer.

    Grouping by person first spreads a hot entity over all tasks.
    """
    per_person = (
        chartable(parsed, entity)
        .groupBy(*entity, "key_epoch", "searcher_pseudonym")
        .agg(F.count("*").alias("_searches"))
    )
    one_epoch = F.min("key_epoch") == F.max("key_epoch")
    return per_person.groupBy(*entity).agg(
        F.sum("_searches").alias("searches"),
        F.when(one_epoch, F.count("*")).alias("listeners"),
    )


def conform_hourly(states: DataFrame, entity: Sequence[str]) -> DataFrame:
    return S.conform(states, S.hourly_schema(*entity))
