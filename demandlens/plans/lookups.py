"""Per-artist series and tracks, and search by name."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.operators.hourly import in_hours, listeners_if_one_epoch
from demandlens.plans.charts import DEFAULT_PAGE_SIZE, check_page
from demandlens.plans.periods import moment_literal

DEFAULT_HISTORY_DAYS = 90
MAXIMUM_HISTORY_DAYS = 365
DEFAULT_SEARCH_SIZE = 20


def history_start(now: datetime, days: int = DEFAULT_HISTORY_DAYS) -> datetime:
    if not 1 <= days <= MAXIMUM_HISTORY_DAYS:
        raise ValueError(f"history is 1 to {MAXIMUM_HISTORY_DAYS} days, not {days}")
    return now - timedelta(days=days)


def artist_time_series(hourly: DataFrame, artist_name: str, start: datetime) -> DataFrame:
    """Searches and listeners per day since ``start``; days without any are absent."""
    day = F.date_trunc("DAY", "hour_start").cast("timestamp_ntz").alias("day")
    return (
        in_hours(hourly, moment_literal(start))
        .where(F.col("artist_name") == artist_name)
        .groupBy(day)
        .agg(
            F.sum("search_count").alias("searches"),
            listeners_if_one_epoch(F.col("unique_searchers"), F.col("key_epoch")).alias(
                "listeners"
            ),
        )
        .orderBy("day")
    )


def artist_top_tracks(
    track_hourly: DataFrame, artist_name: str, start: datetime, page_size: int = DEFAULT_PAGE_SIZE
) -> DataFrame:
    """The artist's most searched tracks since ``start``; ties by name."""
    check_page(page_size)
    return (
        in_hours(track_hourly, moment_literal(start))
        .where(F.col("artist_name") == artist_name)
        .groupBy("track_name")
        .agg(
            F.sum("search_count").alias("searches"),
            listeners_if_one_epoch(F.col("unique_searchers"), F.col("key_epoch")).alias(
                "listeners"
            ),
        )
        .orderBy(F.desc("searches"), "track_name")
        .limit(page_size)
    )


def artist_detail(
    artist_hourly: DataFrame,
    track_hourly: DataFrame,
    artist_name: str,
    now: datetime,
    history_days: int = DEFAULT_HISTORY_DAYS,
) -> tuple[DataFrame, DataFrame]:
    """The daily history and the top tracks of one artist."""
    start = history_start(now, history_days)
    return (
        artist_time_series(artist_hourly, artist_name, start),
        artist_top_tracks(track_hourly, artist_name, start),
    )


def search_artists(
    hourly: DataFrame, text: str, start: datetime, page_size: int = DEFAULT_SEARCH_SIZE
) -> DataFrame:
    """Artists whose name contains ``text`` in any case, most searched first."""
    check_page(page_size)
    if not 2 <= len(text) <= 100:
        raise ValueError("search text has 2 to 100 characters")
    return (
        in_hours(hourly, moment_literal(start))
        .where(F.contains(F.lower("artist_name"), F.lower(F.lit(text))))
        .groupBy("artist_name")
        .agg(F.sum("search_count").alias("searches"))
        .orderBy(F.desc("searches"), "artist_name")
        .limit(page_size)
    )
