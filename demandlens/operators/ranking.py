"""Exact positions in a total order, without sorting everything in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlens.session import shared_dir

# Up to this position a page is cut by a top-k inside every task, whose survivors
# meet in one; Spark does so up to spark.sql.optimizer.windowGroupLimitThreshold,
# 1,000 by default. Deeper pages rank range partitions instead.
TOP_K_LIMIT = 1_000


def rank_all(
    df: DataFrame,
    order: Sequence[Column],
    position: str = "position",
    first: int = 1,
    last: int | None = None,
) -> DataFrame:
    """Number rows by ``order``, which must be total.

    Rows are range-partitioned by the order and written once, so that each
    keeps its range; the sizes of the ranges before it shift the row numbers
    counted within a range. Given ``first`` and ``last``, only the ranges that
    hold such positions are numbered. There is one size per range, so they are
    summed up in one place and broadcast.
    """
    spark = df.sparkSession
    path = shared_dir(spark, "ranked")
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged.write.parquet(path)
    stored = spark.read.schema(ranged.schema).parquet(path)

    sizes = stored.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    starts = starts.where(F.col("_start") + F.col("_rows") >= first)
    if last is not None:
        starts = starts.where(F.col("_start") < last)
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (
        stored.join(F.broadcast(starts), "_range")
        .withColumn(position, F.col("_start") + within)
        .drop("_range", "_rows", "_start")
    )


def page(
    df: DataFrame,
    order: Sequence[Column],
    page_size: int,
    offset: int = 0,
    position: str = "position",
    top_k_limit: int = TOP_K_LIMIT,
) -> DataFrame:
    """Rows at positions offset+1 … offset+page_size of a total order."""
    last = offset + page_size
    if last > top_k_limit:
        ranked = rank_all(df, order, position, offset + 1, last)
    else:
        ranked = df.withColumn(position, F.row_number().over(Window.orderBy(*order)))
        ranked = ranked.where(F.col(position) <= last).withColumn(
            position, F.col(position).cast("bigint")
        )
    return ranked.where(F.col(position).between(offset + 1, last))


def positions_of(df: DataFrame, points: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Where each of a page's rows stands among all rows of ``df``.

    ``order`` holds ascending keys present in both; ``points`` is at most one
    page. The page becomes one sorted array; every row of ``df`` counts towards
    the first page row it stands before, so one small aggregation replaces a
    global sort. Returns the key struct ``point`` and its ``rank``.
    """
    point = F.struct(*(key.alias(f"k{i}") for i, key in enumerate(order)))
    sorted_points = points.agg(F.sort_array(F.collect_list(point)).alias("points")).scalar()
    # The last page row is compared first: most rows stand behind all of them.
    placed = df.select(point.alias("point"), sorted_points.alias("points")).select(
        F.when(F.col("point") >= F.try_element_at("points", F.lit(-1)), F.size("points"))
        .otherwise(F.size(F.filter("points", lambda p: p <= F.col("point"))))
        .alias("passed")
    )
    counts = placed.groupBy("passed").agg(F.count("*").alias("rows_here"))
    tallies = counts.agg(F.collect_list(F.struct("passed", "rows_here"))).scalar()
    numbered = (
        df.sparkSession.range(1)
        .select(sorted_points.alias("points"), tallies.alias("tallies"))
        .select("tallies", F.posexplode("points").alias("place", "point"))
    )
    ahead = F.aggregate(
        F.filter("tallies", lambda t: t["passed"] <= F.col("place")),
        F.lit(1).cast("bigint"),
        lambda total, t: total + t["rows_here"],
    )
    return numbered.select("point", ahead.alias("rank"))
