"""Live silence: timers ring while it lasts, state survives restarts, sums equal the batch."""

from datetime import datetime, timedelta

from demandlens.streaming import monitor, silence

START = datetime(2026, 8, 12, 10)


def land(spark, folder, rows):
    df = spark.createDataFrame(
        [(START + timedelta(seconds=s), name) for s, name in rows], "received_at timestamp, source string"
    )
    df.coalesce(1).write.mode("append").parquet(str(folder))


def watch(spark, folder, root, tolerance=5):
    stream = spark.readStream.schema("received_at timestamp, source string").parquet(str(folder))
    found = silence.live_silence(stream, tolerance=tolerance, lateness="0 seconds")
    writer = found.writeStream.option("checkpointLocation", f"{root}/checkpoint").outputMode("append")
    writer.trigger(availableNow=True).format("parquet").start(f"{root}/found").awaitTermination()
    rows = spark.read.schema(silence.SCHEMA).parquet(f"{root}/found").collect()
    minute = lambda t: (t - START) // timedelta(minutes=1)
    return sorted((r.source or "", r.kind, minute(r.silent_from), minute(r.silent_until), r.silent_ticks) for r in rows)


def test_timers_ring_and_survive_a_restart(spark, tmp_path):
    folder = tmp_path / "in"
    land(spark, folder, [(0, "a"), (30, "a"), (70, "b"), (130, "b")])
    assert watch(spark, folder, tmp_path) == []
    # Only b talks; the stream was stopped in between. a's fifth silent minute is over.
    land(spark, folder, [(420, "b"), (450, "b"), (480, "b")])
    due = ("a", "silent", 1, 6, 5)
    assert watch(spark, folder, tmp_path) == [due]
    land(spark, folder, [(540, "b"), (610, "b"), (620, None)])
    assert watch(spark, folder, tmp_path) == [due]
    # a comes back after eleven minutes; b was never silent for five.
    land(spark, folder, [(725, "a"), (730, "b"), (900, "b")])
    assert watch(spark, folder, tmp_path) == [("a", "resumed", 1, 12, 11), due]


def test_live_silence_equals_the_batch(spark, tmp_path):
    folder = tmp_path / "in"
    seconds = sorted({(n * n * 37 + n * 613) % 40000 for n in range(150)}) + [40100, 40200]
    half = len(seconds) // 2
    for part in (seconds[:half], seconds[half:]):
        land(spark, folder, [(s, "x") for s in part])
        found = watch(spark, folder, tmp_path)
    whole = spark.read.parquet(str(folder)).where("received_at < timestamp'2026-08-12 21:10:00'")
    batch = monitor.silence_periods(whole).collect()
    minute = lambda t: (t - START) // timedelta(minutes=1)
    want = sorted(("x", "resumed", minute(r.silent_from), minute(r.silent_until), r.silent_ticks) for r in batch)
    assert [r for r in found if r[1] == "resumed"] == want and len(want) > 10
