"""Searches a person repeats: at a steady interval, as a saved search does, or in bursts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PERSON, QUERY, TIME = "searcher_pseudonym", "query_text", "received_at"
LEAST_GAPS = 3
TOLERANCE_SECONDS = 60
BURST_SECONDS = 600
LEAST_IN_BURST = 3


PAIR = (PERSON, QUERY)


def _with_carried(rows: DataFrame, value: str) -> DataFrame:
    """Rows with ``carried``: the greatest ``value`` of the pair's earlier hours.

    Only one row per pair and hour is ordered over all hours. Rows meet them by pair and hour,
    as the windows within an hour do, so a pair that asks all day spreads over its hours.
    """
    per_hour = rows.groupBy(*PAIR, "hour").agg(F.max(value).alias("last"))
    earlier = Window.partitionBy(*PAIR).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_hour.select(*PAIR, "hour", F.max("last").over(earlier).alias("carried"))
    return rows.join(carried, [*PAIR, "hour"])


def _gaps(searches: DataFrame) -> DataFrame:
    """Each search with the whole seconds since the same person's last of the same words.

    Rows without a person, words or time are left out. Repeats of one moment count once, so
    a relayed copy is no repeat. An hour's first search takes the last one of the hours before.
    """
    asked = searches.select(*PAIR, F.col(TIME).cast("timestamp_ntz").alias(TIME)).dropna().distinct()
    asked = asked.withColumn("hour", F.date_trunc("HOUR", TIME).cast("timestamp_ntz"))
    in_hour = F.lag(TIME).over(Window.partitionBy(*PAIR, "hour").orderBy(TIME))
    before = F.coalesce(in_hour, "carried")
    return _with_carried(asked, TIME).withColumn("gap", F.timestamp_diff("SECOND", before, F.col(TIME)))


def periodic_repeats(
    searches: DataFrame, tolerance: int = TOLERANCE_SECONDS, least: int = LEAST_GAPS
) -> DataFrame:
    """person, words, searches, interval, steady, share: how regular each repeated search is.

    Gaps are rounded to multiples of ``tolerance`` seconds; ``interval_seconds`` is the most
    frequent one (the shortest of several), ``steady`` how many gaps it has and ``share`` their
    part of all gaps. Pairs with fewer than ``least`` gaps are left out: they have no rhythm.
    Gaps are counted per value before they meet, so a client that asks all day is a few rows.
    """
    if tolerance < 1 or least < 1:
        raise ValueError("tolerance and least number of gaps are 1 or more")
    rounded = (F.floor((F.col("gap") + tolerance / 2) / tolerance) * tolerance).cast("long")
    counted = (
        _gaps(searches).where("gap IS NOT NULL")
        .groupBy(PERSON, QUERY, rounded.alias("interval"))
        .agg(F.count("*").alias("n"))
    )
    most = F.max(F.struct("n", (-F.col("interval")).alias("shorter"))).alias("most")
    per_pair = counted.groupBy(PERSON, QUERY).agg(F.sum("n").alias("gaps"), most)
    return per_pair.where(F.col("gaps") >= least).select(
        PERSON, QUERY,
        (F.col("gaps") + 1).alias("searches"),
        (-F.col("most.shorter")).alias("interval_seconds"),
        F.col("most.n").alias("steady"),
        (F.col("most.n") / F.col("gaps")).alias("share"),
    )


def bursts(
    searches: DataFrame, within: int = BURST_SECONDS, least: int = LEAST_IN_BURST
) -> DataFrame:
    """person, words, started_at, ended_at, searches: repeats close after each other.

    A search at most ``within`` seconds after the last goes on with its burst; bursts of fewer
    than ``least`` searches are left out.
    """
    if within < 0 or least < 1:
        raise ValueError("a burst has a length of 0 or more seconds and 1 or more searches")
    gaps = _gaps(searches).drop("carried")
    is_first = F.col("gap").isNull() | (F.col("gap") > within)
    marked = gaps.withColumn("first_at", F.when(is_first, F.col(TIME)))
    so_far = F.max("first_at").over(Window.partitionBy(*PAIR, "hour").orderBy(TIME))
    started = F.coalesce(so_far, "carried").alias("started_at")
    return (
        _with_carried(marked, "first_at").select(*PAIR, started, TIME)
        .groupBy(*PAIR, "started_at")
        .agg(F.max(TIME).alias("ended_at"), F.count("*").alias("searches"))
        .where(F.col("searches") >= least)
    )
