"""The import job: archive files to the raw layer, with a report."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.functions.privacy import derived_ticket
from demandlens.plans.store import Store, append_raw
from demandlens.session import shared_dir
from demandlens.sources import archive

OVER_LIMIT = "over_limit"


def batch_of(files: list[str]) -> str:
    """One name for a set of files, whatever their order."""
    return f"import-{hashlib.md5(chr(10).join(sorted(files)).encode()).hexdigest()}"


def import_archives(
    spark: SparkSession, store: Store, *paths: str, limit: int | None = None, ticket=derived_ticket
) -> DataFrame:
    """Add the searches of archive files to the raw layer; returns lines per file and reason.

    Paths are files or folders of ``searches-*.jsonl*``; missing ones are skipped with a
    warning. Every line is read and judged once: what it holds is written aside, and the
    report, the limit and the raw rows come from there. The same files imported again
    replace what they added before, so a job that failed half way is simply run again.
    ``limit`` takes so many accepted lines of each file, in line order; those behind
    them are reported as ``over_limit``.
    """
    files = archive.archive_files(spark, *paths)
    judged = archive.classify_archive(archive.read_archive(spark, *files)).drop("line")
    aside = shared_dir(spark, "import")
    judged.write.parquet(aside)
    judged = spark.read.schema(judged.schema).parquet(aside)
    accepted = judged.where(F.col("reason") == archive.IMPORTED)
    if limit is not None:
        accepted = archive.limit_per_file(accepted, limit)
    append_raw(archive.imported_rows(accepted, ticket), store, batch_of(files))
    return import_report(judged, limit)


def import_report(judged: DataFrame, limit: int | None = None) -> DataFrame:
    """file, reason, line_count; every line is counted under one reason."""
    report = judged.groupBy("file", "reason").agg(F.count("*").alias("line_count"))
    if limit is None:
        return report
    is_imported, n = F.col("reason") == archive.IMPORTED, F.col("line_count")
    taken = F.when(is_imported, F.least(n, F.lit(limit))).otherwise(n)
    parts = F.array(
        F.struct("reason", taken.alias("line_count")),
        F.struct(F.lit(OVER_LIMIT).alias("reason"), (n - taken).alias("line_count")),
    )
    return report.select("file", F.inline(parts)).where("line_count > 0")
