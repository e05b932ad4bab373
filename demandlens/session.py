"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import SparkSession

# Runtime SQL settings every job here expects. Only settings that are still
# unset (or at Spark's own default) are touched, so a cluster's choices win.
RUNTIME_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Text work is heavy per byte: small shuffles still use every core.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64kb",
    # Sketch states are small for most groups; spilling to a sort after only
    # 128 groups per task would sort nearly every roll-up.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}

CHECKPOINT_DIR = "spark.checkpoint.dir"
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Set the runtime defaults a user has not chosen otherwise; times are UTC."""
    chosen = {entry[0] for entry in spark.sparkContext.getConf().getAll()}
    for name, value in RUNTIME_DEFAULTS.items():
        if name not in chosen:
            spark.conf.set(name, value)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def build_session(app_name: str = "demandlens", master: str | None = None) -> SparkSession:
    """A session for scripts and tests; on a cluster pass no master."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    if master is not None and master.startswith("local"):
        builder = (
            builder.config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "12g")
            .config("spark.sql.shuffle.partitions", "8")
        )
    return apply_defaults(builder.getOrCreate())


@lru_cache(maxsize=1)
def _single_process_folder() -> str:
    return tempfile.mkdtemp(prefix="demandlens-")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    A machine-local folder is only used when Spark itself runs in one process.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
        root = _single_process_folder()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is run within removes its shuffle files when it ends.

    For writes that nobody runs again. Else their files stay until the driver happens to
    collect its garbage, and a job of many writes piles them up.
    """
    chosen = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if chosen is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, chosen)
