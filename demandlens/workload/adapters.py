"""The driver's tables seen as searches, names and archive lines.

Every adapter covers its whole tables and whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens import schemas as S

CUTOVER = "2024-01-17 11:37:00"
L_CUTOVER = "1998-01-01 00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pseudonym_of(number: Column) -> Column:
    return F.lpad(F.lower(F.hex(number)), S.PSEUDONYM_LENGTH, "0")


def _moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def event_searches(events: DataFrame) -> DataFrame:
    """Events as parsed searches: 100 artists, two key epochs, some unsure."""
    at = F.col("ts").cast("timestamp_ntz")
    bucket = F.regexp_extract("props", '"k": ([0-9]+)', 1)
    is_archive = at < _moment(CUTOVER)
    return events.select(
        at.alias("received_at"),
        F.to_date(at).alias("received_date"),
        pseudonym_of(F.col("user_id")).alias("searcher_pseudonym"),
        F.col("event_id").alias("ticket"),
        F.concat_ws(" ", "event_type", bucket).alias("query_text"),
        F.concat(F.lit("artist "), F.lpad(bucket, 2, "0")).alias("artist_name"),
        F.lit("").alias("album_name"),
        F.when(F.col("event_type") == "signup", "").otherwise(F.col("event_type")).alias(
            "track_name"
        ),
        F.when(F.col("event_type") == "error", 0.3).otherwise(0.9).cast("float").alias(
            "parse_confidence"
        ),
        F.lit(S.PARSER_VERSION).alias("parser_version"),
        F.when(is_archive, S.ARCHIVE_KEY_EPOCH).otherwise(S.OWN_KEY_EPOCH).cast("smallint").alias(
            "key_epoch"
        ),
        F.when(is_archive, S.SOURCE_IMPORTED).otherwise(S.SOURCE_DISTRIBUTED).alias("source"),
    )


def events_as_parsed(spark: SparkSession, folder: str) -> DataFrame:
    return event_searches(table(spark, folder, "events"))


def events_as_raw(spark: SparkSession, folder: str) -> DataFrame:
    return events_as_parsed(spark, folder).select(*S.RAW_SCHEMA.names)


def order_lines_as_parsed(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as parsed searches: real duplicates and three parser versions."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    parts = table(spark, folder, "part").select("p_partkey", "p_brand", "p_name")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        parts, F.col("l_partkey") == F.col("p_partkey")
    )
    at = F.col("o_orderdate").cast("timestamp_ntz")
    is_archive = at < _moment(L_CUTOVER)
    return joined.select(
        at.alias("received_at"),
        F.to_date(at).alias("received_date"),
        pseudonym_of(F.col("o_custkey")).alias("searcher_pseudonym"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ticket"),
        F.concat_ws(" ", F.lower("p_brand"), "p_name").alias("query_text"),
        F.lower("p_brand").alias("artist_name"),
        F.lit("").alias("album_name"),
        F.col("p_name").alias("track_name"),
        F.lit(0.9).cast("float").alias("parse_confidence"),
        (F.col("l_suppkey") % 3 + 1).cast("int").alias("parser_version"),
        F.when(is_archive, S.ARCHIVE_KEY_EPOCH).otherwise(S.OWN_KEY_EPOCH).cast("smallint").alias(
            "key_epoch"
        ),
        F.when(is_archive, S.SOURCE_IMPORTED).otherwise(S.SOURCE_DISTRIBUTED).alias("source"),
    )


def order_lines_as_raw(spark: SparkSession, folder: str) -> DataFrame:
    return order_lines_as_parsed(spark, folder).select(*S.RAW_SCHEMA.names)


def is_spread(scan: DataFrame) -> bool:
    """Whether no task of a scan has more than twice a core's share of its rows."""
    per_task = scan.groupBy(F.spark_partition_id()).agg(F.count("*").alias("_rows"))
    seen = per_task.agg(F.max("_rows").alias("most"), F.sum("_rows").alias("all")).first()
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return (seen["most"] or 0) * cores <= 2 * (seen["all"] or 0)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "documents").select("doc_id", "text")
    # The work on a text outweighs its shuffle, but a copy of all texts is only made where
    # the files would leave cores idle.
    return texts if is_spread(texts) else texts.repartition("doc_id")


def document_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every sentence or line of every document: doc_id, piece_no, piece."""
    broken = F.split(F.replace(F.col("text"), F.lit(". "), F.lit("\n")), "\n")
    return documents(spark, folder).select(
        "doc_id", F.posexplode(broken).alias("piece_no", "piece")
    )


def nth_word(text: Column, n: int) -> Column:
    return F.coalesce(F.get(F.split(text, " "), F.lit(n - 1)), F.lit(""))


def after_words(text: Column, n: int) -> Column:
    skipped = F.char_length(F.substring_index(text, " ", n))
    return F.substring(text, skipped + 2, F.char_length(text))


def document_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Those pieces as people would type them, in six shapes by piece number."""
    piece = F.col("piece")
    shape = F.col("piece_no") % 6
    text = (
        F.when(shape == 0, piece)
        .when(shape == 1, F.concat(piece, F.lit(" [FLAC] 320kbps")))
        .when(shape == 2, F.concat(F.lit("C:\\Music\\"), piece, F.lit(".flac")))
        .when(
            shape == 3,
            F.concat(F.substring_index(piece, " ", 2), F.lit(" - "), after_words(piece, 2)),
        )
        .when(shape == 4, F.concat(piece, F.lit(" discography")))
        .otherwise(
            F.concat(
                F.lit("01 - "), nth_word(piece, 1), F.lit(" - "), nth_word(piece, 2),
                F.lit(" - "), after_words(piece, 2),
            )
        )
    )
    return document_pieces(spark, folder).select(
        "doc_id", "piece_no", piece, text.alias("query_text")
    )


def document_names(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces stand for artist names, cut to one to eight words by piece number."""
    words = F.split("piece", " ")
    some = F.slice(words, F.lit(1), (F.col("piece_no") % 8 + 1).cast("int"))
    return document_pieces(spark, folder).select(
        "doc_id", "piece_no", F.array_join(some, " ").alias("display_name")
    )


def dump_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue dump lines: each name with two aliases; one in ten is cut off."""
    name = F.col("display_name")
    record = F.to_json(
        F.struct(
            name.alias("name"),
            F.array(
                F.struct(F.upper(name).alias("name")),
                F.struct(F.concat(name, F.lit(", The")).alias("name")),
            ).alias("aliases"),
        )
    )
    is_cut = (F.col("doc_id") + F.col("piece_no")) % 10 == 0
    return document_names(spark, folder).select(
        F.when(is_cut, F.substring(record, 1, 12)).otherwise(record).alias("line")
    )


def archive_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Archive lines from events, damaged in six ways by event number."""
    searches = events_as_raw(spark, folder)
    kind = F.col("ticket") % 20
    time = F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss")
    zone = F.when(kind == 6, "+02:00").otherwise("Z")
    time_text = F.when(kind == 5, "junk").otherwise(F.concat(time, zone))
    user = F.when(kind == 4, F.substring("searcher_pseudonym", 1, 15)).when(
        kind != 3, F.col("searcher_pseudonym")
    )
    record = F.to_json(
        F.struct(time_text.alias("time"), F.col("query_text").alias("query"), user.alias("user"))
    )
    line = (
        F.when(kind == 0, "")
        .when(kind == 1, F.substring(record, 1, 20))
        .when(kind == 2, "7")
        .otherwise(record)
    )
    return searches.select(
        line.alias("line"),
        (F.col("ticket") % 3).alias("file"),
        F.floor(F.col("ticket") / 1000).alias("block"),
        F.col("ticket").alias("line_order"),
    )
