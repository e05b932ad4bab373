"""A corpus through language, near-duplicate, benchmark, secret and encoding stages.

Each stage takes (spark, docs, folder) and returns a DataFrame, which is written as
Parquet and read back as the next stage's documents. All but the last return the columns
of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.llm import bagminhash, decontaminate, language, secret_scan, sentencepiece_codec
from demandlens.llm.common import fresh_name, sent_if_few, stored, table
from demandlens.llm.queries import vocabulary

#: SQL for run()'s rows: none, as alignment and classifiers are not SQL.
ORACLE_SQL = None

#: Shorter texts stay even when their language is unclear.
ENOUGH_CHARS = 200


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """Rows with a number of their own, and the name of its column.

    Equal rows, and rows without an id, stay apart. The numbers are written: file splits
    follow the cores at planning time, so a second reading may number rows otherwise.
    """
    row = fresh_name(docs, "_pipeline_row")
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def _without(rows: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """The rows whose number is not in `gone`, without it."""
    numbers = sent_if_few(gone.select(F.col("row_no").alias(row)).distinct(), "gone")
    return rows.join(numbers, row, "left_anti").drop(row)


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents go that have no letter, or enough text and yet no clear language.

    Null and empty texts have no letter and go. The model learns from all rows with a text
    and a language; null languages, sources and ids play no part. Repeated rows are judged
    alike; an empty table stays empty; further columns pass through under any name.
    """
    model = language.learn(docs)
    name = fresh_name(docs, "_found")
    found = docs.withColumn(name, language.identify(F.col("text"), model))
    unclear = F.col(f"{name}.is_ambiguous") & (F.length("text") >= ENOUGH_CHARS)
    kept = found.where((F.col(f"{name}.lang") != language.UNDETERMINED) & ~unclear)
    return kept.drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one of the least doc_id.

    Null ids come last, ties fall to the first in the input, so of repeated rows one stays.
    Null and empty texts are copies of each other. An empty table stays empty; further
    columns pass through under any name.
    """
    rows, row = _numbered(docs)
    found = bagminhash.near_duplicates(rows, row_no=row)
    return _without(rows, row, found.where("NOT is_kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents go that hold a passage of the benchmark.

    Null and empty texts hold none and stay. Repeated rows go or stay together. An empty
    table stays empty; further columns pass through under any name.
    """
    rows, row = _numbered(docs)
    found = decontaminate.contaminated(rows, table(spark, folder, "benchmark"), row_no=row)
    return _without(rows, row, found)


def mask_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Secrets in texts are masked; every document stays.

    A null text stays null. n_chars is counted anew where a text was masked. Repeated rows
    are masked alike. An empty table stays empty; further columns pass through under any name.
    """
    rows, row = _numbered(docs)
    spans = fresh_name(docs, "_spans")
    found = secret_scan.scan(rows, row_no=row).where(F.size("spans") > 0)
    found = found.select(F.col("row_no").alias(row), F.col("spans").alias(spans))
    found = sent_if_few(found, "spans", F.size(spans))
    empty = F.array().cast(found.schema[spans].dataType)
    masked = secret_scan.masked(F.col("text"), F.coalesce(spans, empty))
    out = rows.join(found, row, "left").withColumn("text", masked)
    if "n_chars" in docs.columns:
        out = out.withColumn(
            "n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text"))
        )
    return out.drop(row, spans)


def encode_pieces(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, ids, n_ids and whether decoding gives the text back."""
    model = vocabulary("piece_bpe_32k.model")
    coded = docs.select("doc_id", "text", sentencepiece_codec.encode(F.col("text"), model).alias("ids"))
    plain = F.replace("text", F.lit("▁"), F.lit(" "))
    return coded.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_ids"),
        (sentencepiece_codec.decode(F.col("ids"), model) == plain).alias("is_round_trip"),
    )


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("pieces", encode_pieces),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of a folder through all stages."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, folder), f"pipeline-{name}")
    return docs
