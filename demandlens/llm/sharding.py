"""Sharding by extendible hashing, in DataFrame functions alone (operator 10).

A row's hash bits are those of its key; the directory starts with one bucket, and only a
bucket above the byte limit is split, on one more bit of the prefix. The splitting is
decided from sums: rows are added up by a long prefix once, those sums are rolled up to
every shorter prefix, and each long prefix belongs to the shortest one that fits. Where
even the long prefix is above the limit, its rows alone go on to further bits.

A key that many rows share has one hash: after the bits of the key come bits of the
row (its place in the input), so that such a key spreads over shards as well. Only a
single row larger than the limit makes a shard above it.

Defined cases: a null key hashes as an empty text; a null or empty text has no bytes;
an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.llm.common import stored

#: Bits of the key's hash; bits of the row follow.
KEY_BITS = 60
ROW_BITS = 60
#: Further bits that one pass looks at.
STEP_BITS = 6


def key_bits(key: Column) -> Column:
    """The first 60 bits of the key's MD5 as text of zeros and ones."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15)
    return F.lpad(F.conv(digits, 16, 2), KEY_BITS, "0")


def _row_bits(row: Column) -> Column:
    digits = F.substring(F.md5(row.cast("string")), 1, 15)
    return F.lpad(F.conv(digits, 16, 2), ROW_BITS, "0")


def shards(df: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, shard (its prefix bits), depth and shard_bytes per row.

    shard_bytes is above the limit only where the shard is one row.
    """
    rows = df.select(
        F.col(key).alias("key"),
        F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"),
        F.concat(key_bits(F.col(key)), _row_bits(F.monotonically_increasing_id())).alias("bits"),
    )
    rows = stored(rows, "sharding-rows")
    total = rows.agg(F.sum("n_bytes").alias("b")).first().b or 0
    depth, done = 0, []
    left = rows
    longest = min(KEY_BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + STEP_BITS)
    while True:
        leaves = stored(_leaves(left, depth, longest, limit), "sharding-leaves")
        fits = leaves.where("fits")
        done.append(_placed(left, fits, longest))
        if longest == KEY_BITS + ROW_BITS or not leaves.where("NOT fits").limit(1).count():
            done.append(_placed(left, leaves.where("NOT fits"), longest))
            break
        over = leaves.where("NOT fits").select("long_prefix")
        left = _with_prefix(left, longest).join(over, "long_prefix", "left_semi").drop("long_prefix")
        left = stored(left, "sharding-left")
        depth, longest = longest, min(KEY_BITS + ROW_BITS, longest + STEP_BITS)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _with_prefix(rows: DataFrame, bits: int) -> DataFrame:
    return rows.withColumn("long_prefix", F.substring("bits", 1, bits))


def _leaves(rows: DataFrame, depth: int, longest: int, limit: int) -> DataFrame:
    """For each long prefix the shortest one, of `depth` bits at least, within the limit.

    A prefix of one row fits whatever its size, as a row is not cut.
    """
    sums = _with_prefix(rows, longest).groupBy("long_prefix").agg(
        F.sum("n_bytes").alias("b"), F.count("*").alias("n")
    )
    each = sums.select(
        "long_prefix", "b", "n", F.explode(F.sequence(F.lit(depth), F.lit(longest))).alias("depth")
    ).withColumn("prefix", F.expr("substring(long_prefix, 1, depth)"))
    totals = each.groupBy("depth", "prefix").agg(
        F.sum("b").alias("shard_bytes"), F.sum("n").alias("rows")
    )
    small = totals.where((F.col("shard_bytes") <= limit) | (F.col("rows") == 1))
    picked = (
        each.join(small, ["depth", "prefix"])
        .groupBy("long_prefix")
        .agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("leaf"))
    )
    return sums.join(picked, "long_prefix", "left").select(
        "long_prefix",
        F.coalesce("leaf.prefix", "long_prefix").alias("shard"),
        F.coalesce("leaf.shard_bytes", "b").alias("shard_bytes"),
        F.col("leaf").isNotNull().alias("fits"),
    )


def _placed(rows: DataFrame, leaves: DataFrame, longest: int) -> DataFrame:
    return _with_prefix(rows, longest).join(leaves, "long_prefix").select(
        "key", "n_bytes", "shard", F.length("shard").alias("depth"), "shard_bytes"
    )


def directory(placed: DataFrame) -> DataFrame:
    """shard, depth, rows, bytes: the buckets that the directory points to."""
    return placed.groupBy("shard", "depth").agg(
        F.count("*").alias("n_rows"), F.sum("n_bytes").alias("n_bytes")
    )
