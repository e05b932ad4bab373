"""Overlap of streams: exact against sets, estimates within their bounds."""

import itertools

import pytest
from pyspark.sql import functions as F

from demandlens.plans import overlap


def test_exact_overlap_is_that_of_sets(spark):
    rows = [(s, f"q{n}") for s, step in (("x", 2), ("y", 3), ("z", 1)) for n in range(0, 600, step)] * 2
    rows += [("alone", "only here"), (None, "q1"), ("x", None)]
    df = spark.createDataFrame(rows, "stream string, item string").repartition(4)
    sets = {}
    for s, i in rows:
        if s and i:
            sets.setdefault(s, set()).add(i)
    want = {
        (a, b): (len(sets[a]), len(sets[b]), len(sets[a] & sets[b]), len(sets[a] & sets[b]) / len(sets[a] | sets[b]))
        for a, b in itertools.combinations(sorted(sets), 2)
    }
    got = {tuple(r)[:2]: tuple(r)[2:] for r in overlap.exact_overlap(df, "stream", "item").collect()}
    assert got == want
    sketched = overlap.estimated_overlap(overlap.stream_sketches(df, "stream", "item")).collect()
    assert {(r.first, r.second): r.jaccard_estimate for r in sketched} == {k: v[3] for k, v in want.items()}
    assert all(r.jaccard_low == r.jaccard_estimate == r.jaccard_high for r in sketched)
    assert overlap.exact_overlap(df.where("false"), "stream", "item").count() == 0


def test_estimates_hold_their_bounds_on_small_sketches(spark):
    """Sketches of 4,096 hashes over 60,000 items: about 95 of 100 bounds hold the truth."""
    held = []
    for seed in range(12):
        items = spark.range(60000).select(F.concat(F.lit(f"{seed}-"), "id").alias("item"), "id")
        streams = items.where("id < 45000").withColumn("stream", F.lit("a")).unionByName(
            items.where("id >= 15000").withColumn("stream", F.lit("b"))
        )
        r = overlap.estimated_overlap(overlap.stream_sketches(streams, "stream", "item", 12), 12).first()
        held.append(r.jaccard_low <= 0.5 <= r.jaccard_high)
        assert r.jaccard_high - r.jaccard_low < 0.07
    assert sum(held) >= 10


def test_too_many_streams_are_refused(spark):
    df = spark.range(overlap.MOST_STREAMS + 1).select(F.col("id").cast("string").alias("stream"), F.lit("q").alias("item"))
    with pytest.raises(Exception, match="cannot be compared"):
        overlap.exact_overlap(df, "stream", "item").collect()
