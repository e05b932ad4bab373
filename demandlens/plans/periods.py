"""Chart periods: a window and the adjacent one before it, all half-open."""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERIODS = ("day", "week", "month")


class PeriodWindow(NamedTuple):
    current_start: datetime
    current_end: datetime
    previous_start: datetime


def _check(period: str) -> None:
    if period not in PERIODS:
        raise ValueError(f"a period is one of {', '.join(PERIODS)}, not {period!r}")


def resolve_period(period: str, moment: datetime) -> PeriodWindow:
    """The window holding ``moment``. Weeks start on Monday, months on the first."""
    _check(period)
    day = datetime(moment.year, moment.month, moment.day)
    if period == "month":
        start = day.replace(day=1)
        end = (start + timedelta(days=31)).replace(day=1)
        before = (start - timedelta(days=1)).replace(day=1)
        return PeriodWindow(start, end, before)
    length = timedelta(days=7 if period == "week" else 1)
    start = day - timedelta(days=day.weekday()) if period == "week" else day
    return PeriodWindow(start, start + length, start - length)


def with_period(df: DataFrame, moment: str, period: str) -> DataFrame:
    """The same windows for every row of a table, by its own time column."""
    _check(period)
    start = F.date_trunc(period, F.col(moment)).cast("timestamp_ntz")
    step = F.expr(f"INTERVAL 1 {period.upper()}")
    return (
        df.withColumn("current_start", start)
        .withColumn("current_end", F.col("current_start") + step)
        .withColumn("previous_start", F.col("current_start") - step)
    )


def moment_literal(moment: datetime) -> Column:
    return F.lit(moment.isoformat(" ")).cast("timestamp_ntz")
