import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from demandlens import schemas as S
from demandlens.operators import hourly as H
from demandlens.plans.maintenance import drop_expired
from demandlens.plans.store import Store, append_raw, read_raw, write_raw_batch
from demandlens.streaming import ingest, monitor, rollup

START = datetime(2026, 8, 12, 10)
KEY = "11" * 32


def message(kind, at, user, ticket, query="muse"):
    return json.dumps(
        {"kind": kind, "received_at": at.isoformat() + "Z", "user": user, "ticket": ticket,
         "query": query}
    )


def land(folder, name, messages):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(messages) + "\n")


def ingest_all(spark, folder, root):
    messages = ingest.read_messages(spark, str(folder), maxFilesPerTrigger="1")
    once = ingest.suppress_repeats(ingest.accept_messages(messages, KEY))
    query = ingest.write_raw(once, f"{root}/raw", f"{root}/checkpoint", available_now=True)
    query.awaitTermination()
    return query, spark.read.schema(S.RAW_SCHEMA).parquet(f"{root}/raw")


def test_ingest_accepts_pseudonymises_and_suppresses(spark, tmp_path):
    folder = tmp_path / "in"
    minute = timedelta(minutes=1)
    land(folder, "1.json", [
        message("distributed", START, "ann", 1),
        message("distributed_server", START + minute, "ann", 1),
        message("distributed", START + minute, "bob", 1),
        message("branch_level", START, "ann", 9),
        message("distributed", START + 2 * minute, "ann", 2),
    ])
    counters = monitor.LossCounters()
    spark.streams.addListener(counters)
    query, rows = ingest_all(spark, folder, tmp_path)
    assert rows.count() == 3
    assert rows.select("searcher_pseudonym").distinct().count() == 2
    assert "ann" not in str(rows.collect())
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark.streams.removeListener(counters)
    assert counters.totals[str(query.id)] == {
        "received": 4, "dropped": 0, "duplicates_skipped": 1,
    }
    # A repeat in a later batch is suppressed; after a restart nothing is doubled.
    land(folder, "2.json", [
        message("distributed", START + 5 * minute, "ann", 2),
        message("distributed", START + 6 * minute, "cat", 7),
    ])
    _, rows = ingest_all(spark, folder, tmp_path)
    assert rows.count() == 4


def test_live_and_imported_rows_share_a_layer(spark, tmp_path):
    folder, store = tmp_path / "in", Store(str(tmp_path))
    land(folder, "1.json", [message("distributed", START, f"user{i}", i) for i in range(5)])
    messages = ingest.accept_messages(ingest.read_messages(spark, str(folder)), KEY)

    def run(checkpoint):
        ingest.write_raw(
            messages, store.raw, f"{tmp_path}/{checkpoint}", available_now=True
        ).awaitTermination()

    run("one")
    rows = spark.read.schema(S.RAW_SCHEMA).parquet(store.raw).select(*S.RAW_SCHEMA.names)
    imported = spark.createDataFrame(rows.limit(4).collect(), S.RAW_SCHEMA)
    append_raw(imported, store)
    assert read_raw(spark, store).count() == 9
    # A batch written again replaces itself; a stream with a new checkpoint adds.
    write_raw_batch(imported, store.raw, "again")
    write_raw_batch(imported, store.raw, "again")
    assert read_raw(spark, store).count() == 13
    run("two")
    assert read_raw(spark, store).count() == 18
    day = str(START.date())
    assert drop_expired(spark, store.raw, "raw", START + timedelta(days=100)) == [day]
    assert read_raw(spark, store).count() == 0


def parsed_stream(spark, folder):
    return spark.readStream.schema(S.PARSED_SCHEMA).parquet(str(folder))


def test_rollup_increments_merge_to_the_batch_result(spark, tmp_path):
    rows = [
        (START + timedelta(minutes=7 * n), START.date(), f"{n % 11:016d}", n, "q",
         "hot" if n % 3 else f"artist {n % 5}", "", "t", 0.9, 2, 2)
        for n in range(300)
    ]
    parsed = spark.createDataFrame(rows, S.PARSED_SCHEMA)
    folder = tmp_path / "parsed"
    for part in range(3):
        parsed.where(F.col("ticket") % 3 == part).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(S.PARSED_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    rollup.maintain_hourly(
        stream, str(tmp_path / "states"), str(tmp_path / "checkpoint"), available_now=True
    ).awaitTermination()

    def readable(states):
        columns = ("hour_start", "key_epoch", "artist_name", "search_count")
        people = F.theta_sketch_estimate("unique_searchers")
        return sorted(tuple(r) for r in states.select(*columns, people).collect())

    assert len({p.name for p in (tmp_path / "states").glob("hour_date=*/increment=*")}) == 3
    merged = rollup.read_increments(spark, str(tmp_path / "states"))
    assert readable(merged) == readable(H.hourly_states(parsed))
    # A stream with a new checkpoint adds its increments and replaces none.
    rollup.maintain_hourly(
        stream, str(tmp_path / "states"), str(tmp_path / "second"), available_now=True
    ).awaitTermination()
    twice = rollup.read_increments(spark, str(tmp_path / "states"))
    assert twice.agg(F.sum("search_count")).first()[0] == 600


def at_minutes(spark, minutes):
    return spark.createDataFrame(
        [(START + timedelta(minutes=m, seconds=5),) for m in minutes], "received_at timestamp_ntz"
    )


def test_search_rate(spark):
    got = monitor.search_rate(at_minutes(spark, [0, 0, 0, 2])).orderBy("minute").collect()
    assert [(r["received"], r["searches_per_second"]) for r in got] == [(3, 0.05), (1, 1 / 60)]


def test_silence_is_found_within_and_across_days(spark):
    got = monitor.silence_periods(at_minutes(spark, [0, 5, 11, 900, 2000])).orderBy("silent_from")
    expected = []
    for before, after in ((5, 11), (11, 900), (900, 2000)):
        expected.append((
            START + timedelta(minutes=before + 1),
            START + timedelta(minutes=after),
            after - before - 1,
            START + timedelta(minutes=before + 6),
        ))
    assert [tuple(r) for r in got.collect()] == expected


def test_silence_up_to_now_is_reported(spark):
    rows = at_minutes(spark, [0, 1])
    now = rows.agg({"received_at": "max"}).first()[0] + timedelta(minutes=6)
    assert monitor.silence_periods(rows).count() == 0
    assert [r["silent_ticks"] for r in monitor.silence_periods(rows, until=now).collect()] == [5]
    assert monitor.silence_periods(rows, until=now - timedelta(minutes=1)).count() == 0


def test_silent_minutes_have_a_rate_of_zero(spark):
    rate = monitor.every_minute(monitor.search_rate(at_minutes(spark, [0, 0, 3])))
    assert [r["received"] for r in rate.orderBy("minute").collect()] == [2, 0, 0, 1]


def test_watchdog_counts_minutes_not_reports():
    alarms, start = [], datetime(2026, 8, 13)
    dog = monitor.SilenceWatchdog(alarms.append, tolerance=3)
    for second in range(0, 300, 5):
        dog.record(second == 0, start + timedelta(seconds=second))
    assert alarms == [3, 4]
    dog.record(1, start + timedelta(seconds=300))
    assert not dog.record(0, start + timedelta(seconds=400))
    assert alarms == [3, 4]

def test_ingest_statistics(spark):
    rows = [(START, START.date(), "0" * 16, ticket, "q", "distributed") for ticket in (1, 1, 2)]
    row = monitor.ingest_statistics(spark.createDataFrame(rows, S.RAW_SCHEMA)).first()
    assert tuple(row) == (3, 2, 1, 0)
    empty = monitor.ingest_statistics(spark.createDataFrame([], S.RAW_SCHEMA)).first()
    assert tuple(empty) == (0, 0, 0, 0)
