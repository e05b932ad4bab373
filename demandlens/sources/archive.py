"""The JSON-lines search archive: reading, validating, reporting rejects."""

from __future__ import annotations

import json
import logging
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandlens import schemas as S
from demandlens.functions.privacy import derived_ticket
from demandlens.functions.json_lines import one_value, trimmed
from demandlens.functions.text import SPACE
from demandlens.sources.archive_stream import GZIP_SIGNATURE, ArchiveLines

logger = logging.getLogger(__name__)

ARCHIVE_FILE_PATTERN = "searches-*.jsonl*"

# ISO dates, compact or dashed, with optional time and offset. The wall clock
# is kept as written and the offset dropped.
ISO_TIME = (
    r"^(\d{4})(-?)(\d{2})\2(\d{2})"
    r"(?:.(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,6})\d*)?)?)?"
    r"(?:Z|[+-]\d{2}(?::?\d{2}(?::?\d{2}(?:\.\d+)?)?)?)?)?\z"
)

IMPORTED = "imported"
BLANK = "blank"
MALFORMED = "malformed"
NO_SEARCHER = "no_searcher"
INVALID = "invalid"


def archive_files(spark: SparkSession, *paths: str) -> list[str]:
    """The files that paths stand for: a folder's ``searches-*.jsonl*``, or the file itself.

    Missing paths are skipped with a warning.
    """
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = []
    for path in paths:
        target = path_of(path)
        files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(target):
            logger.warning("skipping %s: not found", path)
        elif files.getFileStatus(target).isDirectory():
            inside = files.globStatus(path_of(os.path.join(path, ARCHIVE_FILE_PATTERN)))
            found += sorted(status.getPath().toString() for status in inside)
        else:
            found.append(files.makeQualified(target).toString())
    return found


def suffix_is_right(spark: SparkSession, file: str) -> bool:
    """Whether a file's suffix says of gzip what its first two bytes say."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(target)
    try:
        signature = bytes(byte & 255 for byte in (stream.read(), stream.read()))  # -1 at the end
    finally:
        stream.close()
    return file.endswith(".gz") == (signature == GZIP_SIGNATURE)


def read_archive(spark: SparkSession, *paths: str) -> DataFrame:
    """Archive lines with their file and place in it.

    A folder stands for its ``searches-*.jsonl*`` files. Whether a file is packed is told by
    its first two bytes, of which the driver reads no more. Where the suffix agrees, Spark
    reads the file as text; files that lost the suffix, or bear it wrongly, go through
    ``ArchiveLines``. Invalid bytes become U+FFFD.
    """
    files = archive_files(spark, *paths)
    if not files:
        raise FileNotFoundError("nothing to import: pass archive files or a folder of them")
    usual = [file for file in files if suffix_is_right(spark, file)]
    frames = []
    if usual:
        frames.append(
            spark.read.text(usual).select(
                F.make_valid_utf8("value").alias("line"),
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("line_order"),
            )
        )
    if len(usual) < len(files):
        frames.append(read_archive_by_signature(spark, *(x for x in files if x not in set(usual))))
    return frames[0] if len(frames) == 1 else frames[0].unionAll(frames[1])


def read_archive_by_signature(spark: SparkSession, *files: str) -> DataFrame:
    """Lines of files, unpacked where their first two bytes are those of gzip."""
    spark.dataSource.register(ArchiveLines)
    return spark.read.format("archive_lines").option("paths", json.dumps(files)).load()


def read_archive_without_suffix(spark: SparkSession, path: str) -> DataFrame:
    """Lines of gzip files whose name lost its suffix; a path is a file or a folder."""
    return read_archive_by_signature(spark, *archive_files(spark, path))


def wall_clock(time_text: Column) -> Column:
    """An ISO time as a zone-less timestamp, NULL when it does not parse."""
    parts = F.regexp_replace(time_text, ISO_TIME, "$1-$3-$4 $5:$6:$7.$8")
    # Parts left out are empty by now and stand for zero.
    for gap, filled in ((" :", " 00:"), ("::", ":00:"), (":.", ":00.")):
        parts = F.replace(parts, F.lit(gap), F.lit(filled))
    written = F.concat(parts, F.lit("0"))
    return F.when(time_text.rlike(ISO_TIME), written.try_cast("timestamp_ntz"))


def classify_archive(lines: DataFrame, line: str = "line") -> DataFrame:
    """Parse every line and name the reason it is imported or rejected for.

    A record needs ``time``, ``user`` and ``query``, a time that parses and a
    pseudonym of exactly sixteen characters. A null query is rejected rather
    than stored as text. Nothing disappears: each line gets one reason. A line is one
    JSON value; two glued together, or one with something behind it, are malformed.
    """
    text = trimmed(F.col(line))
    parsed = lines.withColumn("_json", one_value(text))
    is_object = F.col("_json").isNotNull() & text.rlike(rf"^[{SPACE}]*\{{")
    keys = F.when(is_object, F.json_object_keys(text))
    fields = parsed.select(
        *lines.columns,
        is_object.alias("_is_object"),
        F.array_contains(keys, "query").alias("_has_query"),
        F.array_contains(keys, "user").alias("_has_user"),
        *(
            F.try_variant_get("_json", f"$.{name}", "string").alias(f"_{name}")
            for name in ("time", "user", "query")
        ),
    )
    timed = fields.withColumn("received_at", wall_clock(F.col("_time")))
    reason = (
        F.when(text.rlike(rf"^[{SPACE}]*\z"), BLANK)
        .when(~F.col("_is_object"), MALFORMED)
        .when(F.col("_has_query") & ~F.col("_has_user"), NO_SEARCHER)
        .when(
            F.col("received_at").isNotNull()
            & (F.char_length("_user") == S.PSEUDONYM_LENGTH)
            & F.col("_query").isNotNull(),
            IMPORTED,
        )
        .otherwise(INVALID)
    )
    # A generated row keeps later filters on the reason from being pushed below
    # and evaluating all of this a second time.
    record = F.struct(
        reason.alias("reason"),
        "received_at",
        F.col("_time").alias("time_text"),
        F.col("_user").alias("searcher_pseudonym"),
        F.col("_query").alias("query_text"),
    )
    return timed.select(*lines.columns, F.inline(F.array(record)))


def reject_report(classified: DataFrame) -> DataFrame:
    """Lines per reason; ``imported`` is one of them."""
    return classified.groupBy("reason").agg(F.count("*").alias("line_count"))


def imported_rows(classified: DataFrame, ticket=derived_ticket) -> DataFrame:
    """Accepted lines in the raw layout. The ticket comes from the line itself."""
    accepted = classified.where(F.col("reason") == IMPORTED)
    at = F.date_trunc("MILLISECOND", "received_at").cast("timestamp_ntz")
    return accepted.select(
        at.alias("received_at"),
        F.to_date(at).alias("received_date"),
        "searcher_pseudonym",
        ticket(F.col("searcher_pseudonym"), F.col("time_text"), F.col("query_text")).alias(
            "ticket"
        ),
        "query_text",
        F.lit(S.SOURCE_IMPORTED).alias("source"),
    )


def limit_per_file(
    rows: DataFrame, limit: int, file: str = "file", block: str = "block", order: str = "line_order"
) -> DataFrame:
    """The first ``limit`` rows of each file, in line order.

    Rows are counted per block first. Only the counts are summed up per file,
    so rows are never ordered beyond one block, however large a file is.
    """
    per_block = rows.groupBy(file, block).agg(F.count("*").alias("_in_block"))
    earlier = Window.partitionBy(file).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.select(
        file, block, F.coalesce(F.sum("_in_block").over(earlier), F.lit(0)).alias("_start")
    ).where(F.col("_start") < limit)
    within = Window.partitionBy(file, block).orderBy(order)
    return (
        rows.join(starts, [file, block])
        .withColumn("_place", F.col("_start") + F.row_number().over(within))
        .where(F.col("_place") <= limit)
        .select(*rows.columns)
    )
