"""Silence while it lasts: minutes without searches, kept as keyed state with timers.

Searches are counted per source and minute first, so the state sees one row per busy minute
and source, in the order of event time, whatever the traffic. The state of a source is its
last busy minute. A timer in event time rings once ``tolerance`` minutes have passed without
another one: that is the moment to restart the collector. Traffic that comes back reports how
long the silence was; when it comes in the same micro-batch, that is the only report. State and timers lie in the checkpoint, so a restarted stream neither
forgets a silence nor reports one twice.

Event time moves with the watermark, that is with the rows of any source: a source is found
silent while others still talk. When all are silent nothing moves, which is what
``monitor.SilenceWatchdog`` notices by the clock.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from demandlens.streaming.monitor import SILENCE_TOLERANCE_TICKS, TICK_SECONDS

#: A source has been silent for ``tolerance`` minutes; a silence is over.
SILENT, RESUMED = "silent", "resumed"
SCHEMA = "source string, kind string, silent_from timestamp, silent_until timestamp, silent_ticks long"
MINUTE = timedelta(seconds=TICK_SECONDS)
LATENESS = "1 minute"


class _Silence(StatefulProcessor):
    def __init__(self, tolerance: int) -> None:
        self.tolerance = tolerance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last_busy_minute", "minute timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        minutes = sorted({m.to_pydatetime() for part in rows for m in part["minute"]})
        known = self.last.get()
        before = known[0] if known else None
        if before is not None:
            self._timer(before, False)
        found = []
        for minute in minutes:
            if before is not None and (ticks := self._ticks(before, minute)) >= self.tolerance:
                found.append((key[0], RESUMED, before + MINUTE, minute, ticks))
            before = minute
        self.last.update((before,))
        self._timer(before, True)
        yield _frame(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start = self.last.get()[0] + MINUTE
        yield _frame([(key[0], SILENT, start, start + self.tolerance * MINUTE, self.tolerance)])

    def close(self) -> None:
        pass

    def _timer(self, last: datetime, wanted: bool) -> None:
        due = int((last + (self.tolerance + 1) * MINUTE).replace(tzinfo=UTC).timestamp() * 1000)
        (self.handle.registerTimer if wanted else self.handle.deleteTimer)(due)

    @staticmethod
    def _ticks(before: datetime, minute: datetime) -> int:
        return int((minute - before) / MINUTE) - 1


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["source", "kind", "silent_from", "silent_until", "silent_ticks"])
    return frame.astype({"silent_from": "datetime64[us]", "silent_until": "datetime64[us]", "silent_ticks": "int64"})


def live_silence(
    searches: DataFrame,
    source: str = "source",
    time: str = "received_at",
    tolerance: int = SILENCE_TOLERANCE_TICKS,
    lateness: str = LATENESS,
) -> DataFrame:
    """A stream of silences: ``silent`` when one is due, ``resumed`` when it is over.

    ``time`` is a timestamp with time zone, as event time in Spark is. Rows later than
    ``lateness`` are dropped by the watermark and counted by ``monitor.LossCounters``.
    Null sources are one source; rows without a time are left out.
    """
    busy = (
        searches.where(F.col(time).isNotNull())
        .withWatermark(time, lateness)
        .groupBy(F.window(time, f"{TICK_SECONDS} seconds").alias("tick"), F.col(source).alias("source"))
        .agg(F.count("*").alias("received"))
        .select("source", F.col("tick.start").alias("minute"), F.window_time("tick").alias("at"))
    )
    return busy.groupBy("source").transformWithStateInPandas(
        statefulProcessor=_Silence(tolerance),
        outputStructType=SCHEMA,
        outputMode="append",
        timeMode="eventTime",
    )
