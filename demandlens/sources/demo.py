"""A deterministic demonstration history for trying the charts out."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens import schemas as S

DAYS = 45
SLOTS = 10
PEOPLE = 7
# Artist, track and weight out of ten.
WEIGHTED_TRACKS = (
    ("aphex twin", "windowlicker", 7),
    ("boards of canada", "roygbiv", 6),
    ("burial", "archangel", 5),
    ("autechre", "gantz graf", 4),
    ("nils frahm", "says", 3),
    ("four tet", "two thousand and seventeen", 3),
    ("portishead", "glory box", 2),
    ("dj shadow", "midnight in a perfect world", 2),
)


def demo_traffic(spark: SparkSession, now: datetime) -> DataFrame:
    """Parsed searches over 45 days; a hash decides which day and slot occur."""
    artists = F.array(
        *(
            F.struct(F.lit(a).alias("artist"), F.lit(t).alias("track"), F.lit(w).alias("weight"))
            for a, t, w in WEIGHTED_TRACKS
        )
    )
    grid = (
        spark.range(DAYS)
        .select(F.col("id").alias("day"), F.explode(artists).alias("entry"))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("slot"))
    )
    draw = F.xxhash64("day", "entry.artist", "slot")
    at = F.expr(
        f"timestamp_ntz'{now:%Y-%m-%d %H:%M:%S}' "
        "- make_interval(0, 0, 0, cast(day as int), slot, 0, 0)"
    )
    rows = grid.where(F.pmod(draw, F.lit(10)) < F.col("entry.weight")).select(
        at.alias("received_at"),
        F.to_date(at).alias("received_date"),
        F.lpad(F.hex(F.xxhash64(F.col("slot") % PEOPLE)), 16, "0").alias("searcher_pseudonym"),
        F.pmod(draw, F.lit(4_000_000_000)).alias("ticket"),
        F.concat_ws(" ", "entry.artist", "entry.track").alias("query_text"),
        F.col("entry.artist").alias("artist_name"),
        F.lit("").alias("album_name"),
        F.col("entry.track").alias("track_name"),
        F.lit(0.9).alias("parse_confidence"),
        F.lit(1).alias("parser_version"),
        F.lit(S.ARCHIVE_KEY_EPOCH).alias("key_epoch"),
    )
    return S.conform(rows, S.PARSED_SCHEMA)
