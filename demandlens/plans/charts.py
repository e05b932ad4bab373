"""Artist and track charts over the hourly states.

A chart page is at most 200 rows. Ranking looks at search counts only, and the
wide sketches are read and united just for the entities of the page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlens.functions.movement import movement_kind, movement_positions
from demandlens.operators import ranking
from demandlens.operators.hourly import ARTIST, TRACK, in_hours, listeners_if_one_epoch
from demandlens.plans.periods import PeriodWindow, moment_literal

DEFAULT_PAGE_SIZE = 50
MAXIMUM_PAGE_SIZE = 200
EXPORT_COLUMNS = ("position", "artist_name", "searches", "listeners", "movement", "positions")


def check_page(page_size: int, offset: int = 0) -> None:
    if not 1 <= page_size <= MAXIMUM_PAGE_SIZE:
        raise ValueError(f"a page holds 1 to {MAXIMUM_PAGE_SIZE} entries, not {page_size}")
    if offset < 0:
        raise ValueError(f"an offset is not negative: {offset}")


def _order(count: str, entity: Sequence[str]) -> list[Column]:
    """Most searched first, then by name. Negated so that every key ascends."""
    return [-F.col(count), *(F.col(name) for name in entity)]


def _window_totals(hourly: DataFrame, entity: Sequence[str], window: PeriodWindow) -> DataFrame:
    """Searches now and before, in one scan and one shuffle of narrow rows."""
    current_start = moment_literal(window.current_start)
    both = in_hours(
        hourly, moment_literal(window.previous_start), moment_literal(window.current_end)
    )
    is_current = F.col("hour_start") >= current_start
    return both.groupBy(*entity).agg(
        F.sum(F.when(is_current, F.col("search_count"))).alias("searches"),
        F.sum(F.when(~is_current, F.col("search_count"))).alias("previous_searches"),
    )


def _chart(
    hourly: DataFrame,
    entity: Sequence[str],
    window: PeriodWindow,
    page_size: int,
    offset: int,
    look_back: bool,
    top_k_limit: int,
    first_seen: DataFrame | None = None,
) -> DataFrame:
    check_page(page_size, offset)
    totals = _window_totals(hourly, entity, window)
    page = ranking.page(
        totals.where(F.col("searches").isNotNull()),
        _order("searches", entity),
        page_size,
        offset,
        top_k_limit=top_k_limit,
    )

    # People of the page's entities now, and whether they were ever seen before
    # the previous period. The look-back reads names only: one row per entity where first
    # hours are kept, all hours otherwise.
    current = in_hours(
        hourly, moment_literal(window.current_start), moment_literal(window.current_end)
    ).select(*entity, "key_epoch", "unique_searchers", F.lit(False).alias("_past"))
    facts = current
    if look_back:
        before_previous = moment_literal(window.previous_start)
        past = (
            in_hours(hourly, None, before_previous)
            if first_seen is None
            else first_seen.where(F.col("first_hour") < before_previous)
        ).select(
            *entity,
            F.lit(None).cast("smallint").alias("key_epoch"),
            F.lit(None).cast("binary").alias("unique_searchers"),
            F.lit(True).alias("_past"),
        )
        facts = current.unionAll(past)
    detailed = (
        facts.join(F.broadcast(page), list(entity))
        .groupBy("position", *entity, "searches", "previous_searches")
        .agg(
            listeners_if_one_epoch(F.col("unique_searchers"), F.col("key_epoch")).alias(
                "listeners"
            ),
            F.max("_past").alias("seen_before"),
        )
    )

    # The second condition always holds. It keeps both counts in the plan, so
    # that ranking reuses the shuffled totals of the page instead of a new scan.
    was_present = F.col("previous_searches").isNotNull() & (
        F.col("searches").isNull() | (F.col("searches") > 0)
    )
    previous = ranking.positions_of(
        totals.where(was_present), page.where(was_present), _order("previous_searches", entity)
    )
    previous = previous.select(
        *(F.col(f"point.k{i + 1}").alias(name) for i, name in enumerate(entity)),
        F.col("rank").alias("previous_position"),
    )
    chart = detailed.join(F.broadcast(previous), list(entity), "left")
    position, before = F.col("position"), F.col("previous_position")
    return chart.select(
        "position",
        *entity,
        "searches",
        "listeners",
        movement_kind(position, before, F.col("seen_before")).alias("movement"),
        movement_positions(position, before).alias("positions"),
    ).orderBy("position").limit(page_size)


def artist_chart(
    hourly: DataFrame,
    window: PeriodWindow,
    page_size: int = DEFAULT_PAGE_SIZE,
    offset: int = 0,
    top_k_limit: int = ranking.TOP_K_LIMIT,
    first_seen: DataFrame | None = None,
) -> DataFrame:
    """Artists by searches in the window, with listeners and movement.

    ``first_seen`` (``plans.first_seen``) tells new artists from returning ones without
    reading the hours before the window.
    """
    return _chart(hourly, ARTIST, window, page_size, offset, True, top_k_limit, first_seen)


def track_chart(
    hourly: DataFrame,
    window: PeriodWindow,
    page_size: int = DEFAULT_PAGE_SIZE,
    offset: int = 0,
    top_k_limit: int = ranking.TOP_K_LIMIT,
) -> DataFrame:
    """Tracks by searches in the window; an absent track is always ``new``."""
    return _chart(hourly, TRACK, window, page_size, offset, False, top_k_limit)


def with_share(chart: DataFrame) -> DataFrame:
    """Each entry's searches relative to the page's top entry, at least 2 (percent)."""
    top = F.max("searches").over(Window.partitionBy())
    return chart.withColumn(
        "share",
        F.greatest(F.col("searches") / F.greatest(top, F.lit(1)) * 100, F.lit(2.0)),
    )


def export_frame(chart: DataFrame) -> DataFrame:
    """The columns of the CSV export, in its order."""
    return chart.select(*EXPORT_COLUMNS)


def export_csv(chart: DataFrame, path: str) -> None:
    """Write one page as a single CSV file; NULL becomes an empty cell."""
    (
        export_frame(chart)
        .coalesce(1)
        .sortWithinPartitions("position")
        .write.mode("overwrite")
        .option("header", True)
        .option("nullValue", "")
        .option("emptyValue", "")
        .option("escape", '"')
        .csv(path)
    )
