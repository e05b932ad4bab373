"""Table layouts, fixed values and the check that no user name is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Sources, epochs, confidences, versions.
SOURCE_DISTRIBUTED = "distributed"
SOURCE_DISTRIBUTED_SERVER = "distributed_server"
SOURCE_IMPORTED = "imported"
SOURCES = (SOURCE_DISTRIBUTED, SOURCE_DISTRIBUTED_SERVER, SOURCE_IMPORTED)

ARCHIVE_KEY_EPOCH = 1
OWN_KEY_EPOCH = 2

PARSER_VERSION = 2
MINIMUM_CHART_CONFIDENCE = 0.5
CONFIDENCE_ARTIST_AND_TRACK = 0.9
CONFIDENCE_CATALOGUE_ARTIST_ONLY = 0.85
CONFIDENCE_CATALOGUE_ARTIST_AND_TRACK = 0.8
CONFIDENCE_ALBUM_REQUEST = 0.7
CONFIDENCE_AMBIGUOUS_SPLIT = 0.6
CONFIDENCE_SINGLE_FRAGMENT = 0.3
CONFIDENCE_EMPTY = 0.0

PSEUDONYM_LENGTH = 16

# The codec of large tables and of texts written on the way.
COMPACT = "zstd"

# One search is one person's ticket within a day. The most telling column comes
# first: sorts by this key then rarely look beyond it.
SEARCH_KEY = ("ticket", "searcher_pseudonym", "received_date")

RAW_SCHEMA = T.StructType(
    [
        T.StructField("received_at", T.TimestampNTZType()),
        T.StructField("received_date", T.DateType()),
        T.StructField("searcher_pseudonym", T.StringType()),
        T.StructField("ticket", T.LongType()),
        T.StructField("query_text", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)

PARSED_SCHEMA = T.StructType(
    [
        T.StructField("received_at", T.TimestampNTZType()),
        T.StructField("received_date", T.DateType()),
        T.StructField("searcher_pseudonym", T.StringType()),
        T.StructField("ticket", T.LongType()),
        T.StructField("query_text", T.StringType()),
        T.StructField("artist_name", T.StringType()),
        T.StructField("album_name", T.StringType()),
        T.StructField("track_name", T.StringType()),
        T.StructField("parse_confidence", T.FloatType()),
        T.StructField("parser_version", T.IntegerType()),
        T.StructField("key_epoch", T.ShortType()),
    ]
)

CATALOGUE_SCHEMA = T.StructType(
    [
        T.StructField("normalized_name", T.StringType()),
        T.StructField("display_name", T.StringType()),
        T.StructField("token_count", T.ShortType()),
    ]
)


def hourly_schema(*entity: str) -> T.StructType:
    """Hourly states for an entity: ("artist_name",) or ("artist_name", "track_name")."""
    return T.StructType(
        [
            T.StructField("hour_start", T.TimestampNTZType()),
            T.StructField("hour_date", T.DateType()),
            T.StructField("key_epoch", T.ShortType()),
            *(T.StructField(name, T.StringType()) for name in entity),
            T.StructField("search_count", T.LongType()),
            T.StructField("unique_searchers", T.BinaryType()),
        ]
    )


def refuse_usernames(df: DataFrame) -> DataFrame:
    """Guard before every write: a stored layout never has a user-name column."""
    leaking = [name for name in df.columns if "username" in name.lower().replace("_", "")]
    if leaking:
        raise ValueError(f"user names must not be stored: {', '.join(leaking)}")
    return df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast to a declared layout, in its column order."""
    return df.select(*(df[field.name].cast(field.dataType) for field in schema.fields))
