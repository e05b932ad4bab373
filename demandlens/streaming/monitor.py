"""Throughput per minute, silent stretches and ingest counters."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from demandlens.operators.dedup import SEARCH_KEY

TICK_SECONDS = 60
SILENCE_TOLERANCE_TICKS = 5
COUNTERS = ("received", "dropped", "duplicates_skipped")


def search_rate(searches: DataFrame, time: str = "received_at") -> DataFrame:
    """Searches per second in each one-minute tick; works on streams as well."""
    tick = F.window(time, f"{TICK_SECONDS} seconds")
    return (
        searches.groupBy(tick.alias("tick"))
        .agg(F.count("*").alias("received"))
        .select(
            F.col("tick.start").alias("minute"),
            "received",
            (F.col("received") / TICK_SECONDS).alias("searches_per_second"),
        )
    )


def every_minute(rate: DataFrame) -> DataFrame:
    """A search rate with its silent minutes as zeroes, from its first minute to its last."""
    ends = rate.agg(F.min("minute").alias("first"), F.max("minute").alias("last"))
    ticks = ends.select(
        F.explode(F.sequence("first", "last", F.expr(f"INTERVAL {TICK_SECONDS} SECONDS"))).alias(
            "minute"
        )
    )
    return ticks.join(rate, "minute", "left").na.fill(0)


def silence_periods(
    searches: DataFrame,
    tolerance: int = SILENCE_TOLERANCE_TICKS,
    time: str = "received_at",
    until: datetime | None = None,
) -> DataFrame:
    """Stretches of at least ``tolerance`` ticks in a row without any search.

    ``until`` ends the report: searches from that minute on are left out, and a silence that
    lasts up to it is one of the stretches.
    Only the distinct minutes with traffic are compared, each with the one
    before it. That is done within each day; the last minute of the day before
    is carried over from one row per day.
    """
    minute = F.date_trunc("MINUTE", time).cast("timestamp_ntz")
    busy = searches.select(minute.alias("minute")).distinct()
    if until is not None:
        now = F.date_trunc("MINUTE", F.lit(until).cast("timestamp_ntz")).cast("timestamp_ntz")
        end = searches.sparkSession.range(1).select(now.alias("minute"))
        busy = busy.where(F.col("minute") < now).unionByName(end)
    busy = busy.withColumn("day", F.to_date("minute"))
    per_day = busy.groupBy("day").agg(F.max("minute").alias("last_minute"))
    carried = per_day.select(
        "day", F.lag("last_minute").over(Window.orderBy("day")).alias("carried")
    )
    in_day = F.lag("minute").over(Window.partitionBy("day").orderBy("minute"))
    gaps = (
        busy.withColumn("before", in_day)
        .join(F.broadcast(carried), "day")
        .withColumn("before", F.coalesce("before", "carried"))
    )
    one_minute = F.expr("INTERVAL 1 MINUTE")
    silent = F.timestamp_diff("MINUTE", F.col("before"), F.col("minute")) - 1
    return gaps.where(silent >= tolerance).select(
        (F.col("before") + one_minute).alias("silent_from"),
        F.col("minute").alias("silent_until"),
        silent.alias("silent_ticks"),
        (F.col("before") + F.expr(f"INTERVAL {tolerance + 1} MINUTES")).alias("restart_due_at"),
    )


def ingest_statistics(observed: DataFrame) -> DataFrame:
    """Received, written, repeated and dropped observations, as one row."""
    per_search = observed.groupBy(*SEARCH_KEY).agg(F.count("*").alias("copies"))
    return per_search.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("received"),
        F.count("*").alias("written"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates_skipped"),
        F.lit(0).cast("bigint").alias("dropped"),
    )


class SilenceWatchdog(StreamingQueryListener):
    """Calls back once a stream had no rows for several minutes in a row.

    Register with ``spark.streams.addListener``. Whole minutes since the last rows are
    counted by the times of the reports, however often a stream reports; each further
    silent minute calls back once. Every stream has a count of its own.
    """

    def __init__(
        self, on_silence: Callable[[int], None], tolerance: int = SILENCE_TOLERANCE_TICKS
    ) -> None:
        self.on_silence = on_silence
        self.tolerance = tolerance
        self._last_rows: dict[str, datetime] = {}
        self._told: dict[str, int] = {}

    def record(self, rows: float, at: datetime, stream: str = "") -> bool:
        """Take one report; true when it is the first of a minute that is silent too long."""
        if rows > 0 or stream not in self._last_rows:
            self._last_rows[stream], self._told[stream] = at, 0
            return False
        ticks = int((at - self._last_rows[stream]).total_seconds() // TICK_SECONDS)
        if ticks < self.tolerance or ticks <= self._told[stream]:
            return False
        self._told[stream] = ticks
        self.on_silence(ticks)
        return True

    def onQueryStarted(self, event) -> None:
        self._last_rows.pop(str(event.runId), None)
        self.record(0, datetime.fromisoformat(event.timestamp), str(event.runId))

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        at = datetime.fromisoformat(progress.timestamp)
        self.record(progress.numInputRows, at, str(progress.runId))

    def onQueryIdle(self, event) -> None:
        self.record(0, datetime.fromisoformat(event.timestamp), str(event.runId))

    def onQueryTerminated(self, event) -> None:
        self._last_rows.pop(str(event.runId), None)
        self._told.pop(str(event.runId), None)


class LossCounters(StreamingQueryListener):
    """Rows in, rows too late and repeats of every stream, over all its triggers.

    Register with ``spark.streams.addListener`` before the stream starts; ``totals`` is
    keyed by the stream's id. A stream's own reports end after the last hundred.
    """

    def __init__(self) -> None:
        self.totals: dict[str, dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:
        self.totals.setdefault(str(event.id), dict.fromkeys(COUNTERS, 0))

    def onQueryProgress(self, event) -> None:
        total = self.totals.setdefault(str(event.progress.id), dict.fromkeys(COUNTERS, 0))
        total["received"] += event.progress.numInputRows
        for state in event.progress.stateOperators:
            total["dropped"] += state.numRowsDroppedByWatermark
            total["duplicates_skipped"] += state.customMetrics.get("numDroppedDuplicateRows", 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
