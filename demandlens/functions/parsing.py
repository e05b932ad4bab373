"""Separator parsing of a query into artist, album and track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens import schemas as S
from demandlens.functions import text as X

# Fixed values, in order of precedence: phrases that ask for a release.
ALBUM_MARKERS = (
    "discography",
    "full album",
    "complete album",
    "greatest hits",
    "anthology",
    "box set",
    "collection",
)

PARSE_COLUMNS = ("artist_name", "album_name", "track_name", "parse_confidence")


def _whole_phrase(phrase: str) -> str:
    return f"{X.WORD_START}{phrase}{X.WORD_END}"


def album_marker(normalized: Column) -> Column:
    """The first marker of the list that occurs in the text, else NULL."""
    # Few texts hold the letters of a marker; the others are spared the word edges.
    return F.coalesce(
        *(
            F.when(F.contains(normalized, F.lit(m)) & normalized.rlike(_whole_phrase(m)), F.lit(m))
            for m in ALBUM_MARKERS
        )
    )


def _without_marker(normalized: Column, marker: Column) -> Column:
    pattern = F.concat(F.lit(X.WORD_START), marker, F.lit(X.WORD_END))
    removed = F.regexp_replace(normalized, pattern, F.lit(" "))
    return F.trim(F.regexp_replace(removed, X.SPACES, " "), F.lit(" -"))


def parse_queries(df: DataFrame, normalized: str, prefix: str = "") -> DataFrame:
    """Add artist, album, track and confidence for a normalised text column.

    Normalised text holds single spaces and no dash other than ``-``, so the
    separator between fragments is always exactly ``" - "``. Nothing is
    dropped: text that cannot be split keeps a confidence below the chart gate.
    """
    names = [prefix + name for name in PARSE_COLUMNS]
    marked = df.withColumn("_marker", album_marker(F.col(normalized)))
    rest = marked.withColumn(
        "_remainder",
        F.when(
            F.col("_marker").isNotNull(), _without_marker(F.col(normalized), F.col("_marker"))
        ).otherwise(""),
    )
    split = rest.withColumn(
        "_fragments",
        F.array_remove(
            F.split(
                F.when(F.col("_remainder") != "", F.col("_remainder")).otherwise(F.col(normalized)),
                " - ",
            ),
            "",
        ),
    )

    is_empty = F.col(normalized) == ""
    is_album = F.col("_remainder") != ""
    pieces = F.size("_fragments")
    first, last = F.get("_fragments", F.lit(0)), F.get("_fragments", pieces - 1)
    single = F.when(is_album, F.col("_remainder")).otherwise(F.col(normalized))

    artist = (
        F.when(is_empty, "")
        .when(is_album & (pieces != 2), single)
        .when(pieces >= 2, first)
        .otherwise(single)
    )
    album = F.when(is_album & (pieces == 2), last).when(is_album, F.col("_marker")).otherwise("")
    track = F.when(is_empty | is_album, "").when(pieces >= 2, last).otherwise("")
    confidence = (
        F.when(is_empty, S.CONFIDENCE_EMPTY)
        .when(is_album, S.CONFIDENCE_ALBUM_REQUEST)
        .when(pieces == 2, S.CONFIDENCE_ARTIST_AND_TRACK)
        .when(pieces > 2, S.CONFIDENCE_AMBIGUOUS_SPLIT)
        .otherwise(S.CONFIDENCE_SINGLE_FRAGMENT)
    )
    return split.select(
        *df.columns,
        artist.alias(names[0]),
        album.alias(names[1]),
        track.alias(names[2]),
        confidence.alias(names[3]),
    )


def is_chartable(confidence: Column) -> Column:
    return confidence >= S.MINIMUM_CHART_CONFIDENCE
