"""What the operators share: tables, stored steps, slices of text, hashes."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.session import shared_dir

#: Characters of text that a task holds as Python words at once (a longer text stands alone).
SLICE_CHARS = 1_000_000
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, purpose: str, codec: str = "zstd") -> DataFrame:
    """Write a step below the shared folder and read it back: lineage ends here.

    A lost executor then repeats the step that failed, not all before it.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows, or values in them, that a join may send to every executor; tens of bytes each.
MOST_SENT = 2_000_000


def sent_if_few(df: DataFrame, purpose: str, values: Column | None = None) -> DataFrame:
    """Narrow rows, written, and sent to every executor if they are few.

    The texts they are joined with then stay where they lie. Otherwise Spark chooses.
    `values` counts what a row holds where that is more than one.
    """
    rows = stored(df, purpose)
    held = rows.agg(F.sum(values) if values is not None else F.count("*")).first()[0] or 0
    return F.broadcast(rows) if held <= MOST_SENT else rows


def fresh_name(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until no column bears it, in whatever case."""
    taken = {x.lower() for x in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bound_batches(spark: SparkSession) -> None:
    """Batches that Python gets are bounded in bytes, unless the user has chosen a bound.

    The default counts rows, and ten thousand texts may be of any size.
    """
    if not spark.sparkContext.getConf().contains(BATCH_BYTES):
        spark.conf.set(BATCH_BYTES, "4m")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sized_slices(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows of about `most` together; a larger row ends its run."""
    start, held, i = 0, 0, -1
    for i, size in enumerate(sizes):
        held += size
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start <= i:
        yield start, i + 1


def slices(texts: Sequence[str | None], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about `chars` characters each; nothing is left out."""
    return sized_slices((len(text or "") for text in texts), chars)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (SplitMix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class WordTable(dict):
    """What a task has worked out for words, of which it forgets those not seen lately.

    It lives as long as the Python worker. At most `most` words are current and as many
    wait from before; a word that is met again becomes current again.
    """

    def __init__(self, work: Callable[[list[str]], Iterable[tuple[str, object]]], most: int):
        super().__init__()
        self.work, self.most, self.before = work, most, {}

    def learn(self, wanted: set[str]) -> None:
        """Afterwards the table has all of these; new ones are worked out together."""
        new = wanted - self.keys()
        if len(self) + len(new) > self.most:
            self.before = dict(self)
            self.clear()
            new = wanted
        again = new & self.before.keys()
        self.update((x, self.before[x]) for x in again)
        self.update(self.work(list(new - again)))


class TaskWords(dict):
    """What one task has worked out for words, bounded in bytes.

    Beyond the bound all is forgotten, and what a slice of text needs is worked out anew.
    It belongs to its task: the worker has its memory back when the task ends.
    """

    #: Of a dictionary's entry itself, beside its key and value.
    ENTRY = 100

    def __init__(self, work: Callable[[list[str]], Iterable[tuple[str, object]]], most_bytes: int):
        super().__init__()
        self.work, self.most, self.bytes = work, most_bytes, 0

    def learn(self, wanted: set[str]) -> None:
        """Afterwards the table has all of these; new ones are worked out together."""
        new = wanted - self.keys()
        if new and self.bytes >= self.most:
            self.clear()
            self.bytes, new = 0, wanted
        for word, value in self.work(list(new)):
            self[word] = value
            self.bytes += sys.getsizeof(word) + sys.getsizeof(value) + self.ENTRY
