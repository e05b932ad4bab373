"""What a scene looks for: people who share seed words, and the words they favour.

A scene is all people who ever searched for one of the seed words. The lift of a word says how
much likelier a person of the scene is to search for it than anyone:

    lift = ((scene_people + k) / (scene + k * words)) / ((people + k) / (everyone + k * words))

with k > 0 for smoothing, so that a word of two people does not outrank one of thousands by
chance. People count once per word, however often they search. No person is left out: the
words of one who searched for a whole catalogue are distinct pairs in the shuffle like all
others and are never gathered in one row or task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMOOTHING = 1.0
MOST_SEEDS = 1000
# Into how many parts searches are dealt before their words are told apart, at least.
LEAST_PARTS = 256


def words_of(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits of a query."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1))


def person_words(
    searches: DataFrame, person: str = "searcher_pseudonym", text: str = "query_text"
) -> DataFrame:
    """Distinct pairs of person and word; searches without a person or a word have none.

    A task holds the pairs of its searches in memory, several for each. Searches are small
    beside them, so they are dealt to a given number of tasks, which adaptive execution
    leaves as it is; a person's searches go to many of them.
    """
    parts = max(LEAST_PARTS, int(searches.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return (
        searches.where(F.col(person).isNotNull())
        .select(F.col(person).alias("person"), F.col(text).alias("_text"))
        .repartition(parts, "person", "_text")
        .select("person", F.explode_outer(words_of(F.col("_text"))).alias("word"))
        .where("word IS NOT NULL")
        .distinct()
    )


def scene_people(pairs: DataFrame, seeds: Sequence[str]) -> DataFrame:
    """Who ever searched for a seed word."""
    if not 1 <= len(seeds) <= MOST_SEEDS:
        raise ValueError(f"a scene has 1 to {MOST_SEEDS} seed words, not {len(seeds)}")
    wanted = sorted({seed.lower() for seed in seeds})
    return pairs.where(F.col("word").isin(wanted)).select("person").distinct()


def scene_lift(pairs: DataFrame, seeds: Sequence[str], smoothing: float = SMOOTHING) -> DataFrame:
    """word, scene_people, people, lift for every word, the seeds as well.

    ``pairs`` are distinct (``person_words``). Words and people are counted by hash
    aggregations over narrow pairs; the scene is joined by person as a set of its own, whose
    left side splits where one person has very many words.
    """
    if smoothing <= 0:
        raise ValueError("smoothing is above 0")
    inside = scene_people(pairs, seeds).withColumn("in_scene", F.lit(1))
    counts = (
        pairs.join(inside, "person", "left")
        .groupBy("word")
        .agg(F.count("in_scene").alias("scene_people"), F.count("*").alias("people"))
    )
    totals = pairs.select("person").distinct().join(inside, "person", "left").agg(
        F.count("in_scene").alias("scene"), F.count("*").alias("everyone")
    )
    sizes = totals.withColumn("words", pairs.agg(F.count_distinct("word")).scalar())
    # One row; read as three numbers by a scalar subquery.
    size = sizes.select(F.struct("scene", "everyone", "words")).scalar()
    k = F.lit(float(smoothing))
    share = lambda n, total: (F.col(n) + k) / (size[total] + k * size["words"])
    return counts.select(
        "word", "scene_people", "people",
        (share("scene_people", "scene") / share("people", "everyone")).alias("lift"),
    )


def recommended(
    pairs: DataFrame,
    seeds: Sequence[str],
    size: int = 50,
    least_people: int = 2,
    smoothing: float = SMOOTHING,
) -> DataFrame:
    """The words a scene favours most: position, word, scene_people, people, lift.

    Seeds are left out, as are words of fewer people of the scene than ``least_people``.
    Ties go to the word of more people of the scene, then by word.
    """
    wanted = sorted({seed.lower() for seed in seeds})
    lift = scene_lift(pairs, seeds, smoothing).where(
        ~F.col("word").isin(wanted) & (F.col("scene_people") >= least_people)
    )
    order = (F.round("lift", 9).desc(), F.col("scene_people").desc(), F.col("word"))
    top = lift.orderBy(*order).limit(size)
    # The window holds the page alone, at most ``size`` rows.
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("position"), "*")

