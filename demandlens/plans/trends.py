"""What people turn to: the share of a window's people who ask for a thing, then and now.

Shares are compared, not counts, so a busier week alone is no trend. Every entity of either
window is there: the baseline is never cut to a chart, or what comes out of nowhere and what
is gone would be missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.plans.periods import PeriodWindow, moment_literal


def trends(
    searches: DataFrame,
    window: PeriodWindow,
    entity: str = "artist_name",
    person: str = "searcher_pseudonym",
    time: str = "received_at",
) -> DataFrame:
    """entity, people_before, people_now, share_before, share_now, change.

    One scan of both windows. Searches collapse to distinct (entity, person, window) by hash
    aggregation first, which spreads a hot entity over its people. Rows without an entity
    (null or empty) or person are left out of the entities, those with a person still count
    among the people. An empty window has null shares, which count as 0 in the change.
    """
    now = F.col(time) >= moment_literal(window.current_start)
    both = searches.where(
        (F.col(time) >= moment_literal(window.previous_start))
        & (F.col(time) < moment_literal(window.current_end))
        & F.col(person).isNotNull()
    ).select(F.col(entity).alias(entity), F.col(person).alias("_person"), now.alias("_now"))
    asked = both.where(F.col(entity) != "").distinct().groupBy(entity).agg(
        F.count_if(~F.col("_now")).alias("people_before"), F.count_if("_now").alias("people_now")
    )
    everyone = both.select("_person", "_now").distinct()

    def share(people: str, is_now: Column) -> Column:
        total = everyone.where(is_now).agg(F.count("*")).scalar()
        return F.when(total > 0, F.col(people) / total)

    shared = asked.select(
        entity, "people_before", "people_now",
        share("people_before", ~F.col("_now")).alias("share_before"),
        share("people_now", F.col("_now")).alias("share_now"),
    )
    or_none = lambda name: F.coalesce(name, F.lit(0.0))
    return shared.withColumn("change", or_none("share_now") - or_none("share_before"))
