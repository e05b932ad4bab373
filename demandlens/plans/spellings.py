"""Charts in which the spellings of one artist count together.

The hourly table keeps names as people typed them. Here names with one artist key (case,
accents, a leading "the", "&" for "and", punctuation) are one entry: searches add up, people
are the union of all spellings' sketches, and the spelling searched for most is displayed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandlens.functions.text import artist_key
from demandlens.operators.hourly import SKETCH_LG, in_hours
from demandlens.plans.charts import DEFAULT_PAGE_SIZE, check_page
from demandlens.plans.periods import PeriodWindow, moment_literal


def merged_spellings(hourly: DataFrame, window: PeriodWindow) -> DataFrame:
    """artist_name, searches, listeners, spellings for the current half of a window.

    Hours are merged per name first, so a key is worked out once per name and a hot artist
    is a few rows when spellings meet. Names without a key stand for themselves. Listeners
    are null where two key epochs meet. Ties of spellings go to the smallest.
    """
    hours = in_hours(
        hourly, moment_literal(window.current_start), moment_literal(window.current_end)
    )
    names = hours.groupBy("artist_name").agg(
        F.sum("search_count").alias("searches"),
        F.theta_union_agg("unique_searchers", SKETCH_LG).alias("people"),
        F.min("key_epoch").alias("first_epoch"),
        F.max("key_epoch").alias("last_epoch"),
    )
    key = artist_key(F.col("artist_name"))
    keyed = names.withColumn("key", F.coalesce(F.nullif(key, F.lit("")), "artist_name"))
    most = F.min(F.struct((-F.col("searches")).alias("less"), "artist_name"))
    listeners = F.theta_sketch_estimate(F.theta_union_agg("people", SKETCH_LG))
    return keyed.groupBy("key").agg(
        most.getField("artist_name").alias("artist_name"),
        F.sum("searches").alias("searches"),
        F.when(F.min("first_epoch") == F.max("last_epoch"), listeners).alias("listeners"),
        F.count("*").alias("spellings"),
    ).drop("key")


def merged_chart(
    hourly: DataFrame, window: PeriodWindow, page_size: int = DEFAULT_PAGE_SIZE
) -> DataFrame:
    """The first page: position and the columns of ``merged_spellings``; ties go by name."""
    check_page(page_size)
    order = (F.col("searches").desc(), F.col("artist_name"))
    top = merged_spellings(hourly, window).orderBy(*order).limit(page_size)
    # The window holds the page alone.
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("position"), "*")
