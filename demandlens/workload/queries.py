"""Every operator as a named query over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens import schemas as S
from demandlens.functions import parsing, privacy
from demandlens.functions import text as X
from demandlens.operators import dedup, hourly, resolver
from demandlens.plans import (
    charts, first_seen, fold, imports, lookups, maintenance, overlap, periods, repeats, reprocess,
    scenes, spellings, store, trends,
)
from demandlens.session import apply_defaults, shared_dir
from demandlens.sources import archive, catalogue, raw
from demandlens.streaming import ingest, monitor, rollup, silence
from demandlens.workload import adapters as A

Query = Callable[[SparkSession, str], DataFrame]

# A public dummy key, for tests only.
DEMO_KEY = "11" * 32
SECOND = "yyyy-MM-dd HH:mm:ss"

_registry: dict[str, Query] = {}


def query(build: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(apply_defaults(spark), folder)

    _registry[build.__name__] = run
    return run


def all_queries() -> dict[str, Query]:
    return dict(_registry)


def _text(time: str | Column, name: str | None = None) -> Column:
    """Times leave a query as text, so that engines compare them alike."""
    column = F.col(time) if isinstance(time, str) else time
    return F.date_format(column, SECOND).alias(name or time)


def _artist_hourly(spark: SparkSession, folder: str) -> DataFrame:
    return hourly.hourly_states(A.events_as_parsed(spark, folder), hourly.ARTIST)


def _track_hourly(spark: SparkSession, folder: str) -> DataFrame:
    return hourly.hourly_states(A.events_as_parsed(spark, folder), hourly.TRACK)


def _state_rows(states: DataFrame, *entity: str) -> DataFrame:
    return states.select(
        _text("hour_start"),
        F.col("key_epoch").cast("int").alias("key_epoch"),
        *entity,
        F.col("search_count").alias("searches"),
        F.theta_sketch_estimate("unique_searchers").alias("listeners"),
    )


# -- charts and look-ups ------------------------------------------------------


@query
def artist_chart_week(spark, folder):
    window = periods.resolve_period("week", datetime(2024, 1, 24))
    return charts.artist_chart(_artist_hourly(spark, folder), window)


@query
def artist_chart_day(spark, folder):
    window = periods.resolve_period("day", datetime(2024, 1, 17))
    return charts.artist_chart(_artist_hourly(spark, folder), window)


@query
def artist_chart_cutover_week(spark, folder):
    window = periods.resolve_period("week", datetime(2024, 1, 17))
    return charts.artist_chart(_artist_hourly(spark, folder), window, page_size=200)


def _stored_months(spark, folder, entity):
    """Hourly states of the order lines, written once and read as a table."""
    parsed = dedup.latest_versions(A.order_lines_as_parsed(spark, folder))
    states = hourly.conform_hourly(hourly.hourly_states(parsed, entity), entity)
    path = shared_dir(spark, "months")
    states.write.parquet(path)
    return store.read_layer(spark, path, states.schema)


@query
def artist_chart_month(spark, folder):
    states = _stored_months(spark, folder, hourly.ARTIST)
    window = periods.resolve_period("month", datetime(1997, 3, 15))
    return charts.artist_chart(states, window)


@query
def artist_chart_first_seen(spark, folder):
    """The week's chart with kept first hours, which two loads have brought up to date."""
    place = store.Store(shared_dir(spark, "first-seen"))
    states = hourly.conform_hourly(_artist_hourly(spark, folder), hourly.ARTIST)
    dates = A.events_as_parsed(spark, folder).select("received_date").distinct().collect()
    days = sorted(row["received_date"] for row in dates)
    cut = date(2024, 1, 12)
    for part in ([d for d in days if d >= cut], [d for d in days if d < cut]):
        of_part = states.where(F.col("hour_date").isin(part))
        store.replace_days(of_part, place.artist_hourly, hourly.ARTIST)
        first_seen.update(spark, place, part)
    window = periods.resolve_period("week", datetime(2024, 1, 24))
    return charts.artist_chart(
        store.read_hourly(spark, place), window, first_seen=first_seen.read(spark, place)
    )


@query
def artist_chart_page2(spark, folder):
    window = periods.resolve_period("week", datetime(2024, 1, 24))
    return charts.artist_chart(_artist_hourly(spark, folder), window, page_size=20, offset=20)


@query
def artist_chart_deep_page(spark, folder):
    """The same page cut by range partitions, the way of very deep pages."""
    window = periods.resolve_period("week", datetime(2024, 1, 24))
    return charts.artist_chart(
        _artist_hourly(spark, folder), window, page_size=20, offset=20, top_k_limit=0
    )


@query
def track_chart_week(spark, folder):
    window = periods.resolve_period("week", datetime(2024, 1, 24))
    return charts.track_chart(_track_hourly(spark, folder), window, page_size=200)


@query
def track_chart_month(spark, folder):
    states = _stored_months(spark, folder, hourly.TRACK)
    window = periods.resolve_period("month", datetime(1997, 3, 15))
    return charts.track_chart(states, window)


@query
def chart_movement(spark, folder):
    window = periods.resolve_period("day", datetime(2024, 1, 18))
    chart = charts.artist_chart(_artist_hourly(spark, folder), window, page_size=200)
    return chart.select("position", "artist_name", "movement", "positions")


@query
def chart_share(spark, folder):
    window = periods.resolve_period("week", datetime(2024, 1, 24))
    chart = charts.with_share(charts.artist_chart(_artist_hourly(spark, folder), window))
    return chart.select(
        "position", "artist_name", "searches", F.round("share", 6).alias("share")
    )


@query
def chart_export(spark, folder):
    window = periods.resolve_period("week", datetime(2024, 1, 24))
    return charts.export_frame(charts.artist_chart(_artist_hourly(spark, folder), window))


@query
def artist_time_series(spark, folder):
    series = lookups.artist_time_series(
        _artist_hourly(spark, folder), "artist 07", datetime(2024, 1, 5, 12)
    )
    return series.select(_text("day"), "searches", "listeners")


@query
def artist_top_tracks(spark, folder):
    return lookups.artist_top_tracks(
        _track_hourly(spark, folder), "artist 07", datetime(2024, 1, 18), 50
    )


@query
def artist_detail(spark, folder):
    """Both parts of an artist's page, told apart by ``part``."""
    history, tracks = lookups.artist_detail(
        _artist_hourly(spark, folder),
        _track_hourly(spark, folder),
        "artist 07",
        now=datetime(2024, 1, 31),
        history_days=20,
    )
    return history.select(
        F.lit("history").alias("part"), _text("day", "entry"), "searches", "listeners"
    ).unionAll(
        tracks.select(F.lit("track"), F.col("track_name"), F.col("searches"), F.col("listeners"))
    )


@query
def artist_detail_stored(spark, folder):
    """The same page from the stored hourly tables, which are laid out for it."""
    place = store.Store(shared_dir(spark, "look-up"))
    for states, entity in (
        (_artist_hourly(spark, folder), hourly.ARTIST), (_track_hourly(spark, folder), hourly.TRACK)
    ):
        store.replace_days(hourly.conform_hourly(states, entity), place.hourly(entity), entity)
    history, tracks = lookups.artist_detail(
        store.read_hourly(spark, place), store.read_hourly(spark, place, hourly.TRACK),
        "artist 07", now=datetime(2024, 1, 31), history_days=20,
    )
    return history.select(
        F.lit("history").alias("part"), _text("day", "entry"), "searches", "listeners"
    ).unionAll(
        tracks.select(F.lit("track"), F.col("track_name"), F.col("searches"), F.col("listeners"))
    )


@query
def artist_search(spark, folder):
    return lookups.search_artists(
        _artist_hourly(spark, folder), "ARTIST 1", datetime(2024, 1, 3), 20
    )


@query
def period_windows(spark, folder):
    days = A.table(spark, folder, "events").select(F.to_date("ts").alias("day")).distinct()
    parts = []
    for period in periods.PERIODS:
        windows = periods.with_period(days, "day", period)
        parts.append(
            windows.select(
                F.lit(period).alias("period"),
                _text("day"),
                _text("current_start"),
                _text("current_end"),
                _text("previous_start"),
            )
        )
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


# -- roll-ups -----------------------------------------------------------------


@query
def artist_hourly(spark, folder):
    return _state_rows(_artist_hourly(spark, folder), *hourly.ARTIST)


@query
def track_hourly(spark, folder):
    return _state_rows(_track_hourly(spark, folder), *hourly.TRACK)


@query
def window_merge(spark, folder):
    window = periods.resolve_period("week", datetime(2024, 1, 17))
    states = hourly.in_hours(
        _artist_hourly(spark, folder),
        periods.moment_literal(window.current_start),
        periods.moment_literal(window.current_end),
    )
    merged = hourly.merge_window(states)
    return merged.withColumn("key_epoch", F.col("key_epoch").cast("int"))


@query
def epoch_collapse(spark, folder):
    window = periods.resolve_period("day", datetime(2024, 1, 17))
    states = hourly.in_hours(
        _artist_hourly(spark, folder),
        periods.moment_literal(window.current_start),
        periods.moment_literal(window.current_end),
    )
    return hourly.collapse_epochs(states)


@query
def artist_window_exact(spark, folder):
    return hourly.exact_window(A.events_as_parsed(spark, folder))


@query
def dataset_summary(spark, folder):
    return maintenance.exact_summary(A.events_as_parsed(spark, folder))


# -- raw layer ----------------------------------------------------------------


def _raw_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        _text("received_at"), "searcher_pseudonym", "ticket", "query_text", "source"
    )


@query
def raw_dates_since(spark, folder):
    dates = raw.dates_since(A.events_as_raw(spark, folder), datetime(2024, 1, 9, 13, 30))
    return dates.select(F.col("received_date").cast("string").alias("received_date"))


@query
def raw_scan_since(spark, folder):
    return _raw_rows(raw.rows_since(A.events_as_raw(spark, folder), datetime(2024, 1, 9, 13, 30)))


@query
def raw_incremental_pull(spark, folder):
    remote = A.events_as_raw(spark, folder)
    local = remote.where(F.col("received_at") < datetime(2024, 1, 20))
    return _raw_rows(raw.rows_newer_than(remote, local))


@query
def raw_dedup(spark, folder):
    return _raw_rows(dedup.dedup_raw(A.order_lines_as_raw(spark, folder)))


@query
def parsed_latest_version(spark, folder):
    return dedup.latest_versions(A.order_lines_as_parsed(spark, folder)).select(
        _text("received_at"),
        "searcher_pseudonym",
        "ticket",
        "query_text",
        "artist_name",
        "track_name",
        "parser_version",
    )


@query
def duplicate_rate(spark, folder):
    rate = dedup.duplicate_rate(A.order_lines_as_raw(spark, folder))
    return rate.select(
        _text("minute"),
        "received",
        "distinct_searches",
        "duplicates",
        F.round("duplicate_share", 6).alias("duplicate_share"),
    )


@query
def key_epoch_assign(spark, folder):
    return (
        A.events_as_raw(spark, folder)
        .withColumn("key_epoch", reprocess.key_epoch(F.col("source")))
        .groupBy("source", "key_epoch")
        .agg(F.count("*").alias("row_count"))
    )


@query
def retention_filter(spark, folder):
    """Rows each layer still keeps, per day."""
    as_of = datetime(2024, 1, 31, 9)
    searches = A.events_as_raw(spark, folder)
    states = _artist_hourly(spark, folder)
    parts = [
        maintenance.retained(searches, "raw", as_of).select(
            F.lit("raw").alias("layer"), F.col("received_date").alias("day")
        ),
        maintenance.retained(searches, "parsed", as_of).select(
            F.lit("parsed"), F.col("received_date")
        ),
        maintenance.retained(states, "hourly", as_of).select(F.lit("hourly"), F.col("hour_date")),
    ]
    kept = parts[0].unionAll(parts[1]).unionAll(parts[2])
    return kept.groupBy("layer", F.col("day").cast("string").alias("day")).agg(
        F.count("*").alias("row_count")
    )


@query
def search_rate_per_minute(spark, folder):
    rate = monitor.search_rate(A.events_as_raw(spark, folder))
    return rate.select(
        _text("minute"),
        "received",
        F.round("searches_per_second", 6).alias("searches_per_second"),
    )


@query
def silence_periods(spark, folder):
    gaps = monitor.silence_periods(A.events_as_raw(spark, folder))
    return gaps.select(
        _text("silent_from"), _text("silent_until"), "silent_ticks", _text("restart_due_at")
    )


@query
def search_rate_every_minute(spark, folder):
    """Silent minutes are there with a rate of zero."""
    rate = monitor.every_minute(monitor.search_rate(A.events_as_raw(spark, folder)))
    return rate.select(
        _text("minute"),
        "received",
        F.round("searches_per_second", 6).alias("searches_per_second"),
    )


@query
def silence_so_far(spark, folder):
    """The silence after the last search, an hour long, is reported too."""
    rows = A.events_as_raw(spark, folder)
    last = rows.agg(F.max("received_at").alias("last")).first()["last"]
    gaps = monitor.silence_periods(rows, until=last + timedelta(hours=1))
    return gaps.select(
        _text("silent_from"), _text("silent_until"), "silent_ticks", _text("restart_due_at")
    )


@query
def ingest_statistics(spark, folder):
    return monitor.ingest_statistics(A.order_lines_as_raw(spark, folder))


# -- text ---------------------------------------------------------------------


@query
def take_file_name(spark, folder):
    urls = A.table(spark, folder, "pages").select(F.col("url").alias("query_text"))
    texts = A.document_queries(spark, folder).select("query_text").unionAll(urls)
    return texts.select("query_text", X.take_file_name(F.col("query_text")).alias("file_name"))


@query
def strip_diacritics(spark, folder):
    documents = A.documents(spark, folder)
    return documents.select("doc_id", X.strip_diacritics(F.col("text")).alias("plain_text"))


@query
def normalize_query(spark, folder):
    return A.document_queries(spark, folder).select(
        "doc_id", "piece_no", X.normalize_query(F.col("query_text")).alias("normalized")
    )


@query
def normalize_document(spark, folder):
    """Whole documents through the same chain, new lines and all."""
    return A.documents(spark, folder).select(
        "doc_id", X.normalize_query(F.col("text")).alias("normalized")
    )


@query
def artist_key(spark, folder):
    names = A.document_names(spark, folder)
    with_article = names.withColumn(
        "display_name",
        F.when(F.col("piece_no") % 2 == 0, F.concat("display_name", F.lit(", The"))).otherwise(
            F.concat(F.lit("The "), F.col("display_name"), F.lit(" & Co"))
        ),
    )
    return with_article.select(
        "doc_id", "piece_no", X.artist_key(F.col("display_name")).alias("artist_key")
    )


def _parsed_documents(spark, folder):
    normalized = A.document_queries(spark, folder).select(
        "doc_id", "piece_no", "piece", X.normalize_query(F.col("query_text")).alias("normalized")
    )
    return parsing.parse_queries(normalized, "normalized")


def _parse_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        "doc_id",
        "piece_no",
        "artist_name",
        "album_name",
        "track_name",
        F.round(F.col("parse_confidence").cast("double"), 2).alias("parse_confidence"),
    )


@query
def parse_query(spark, folder):
    return _parse_rows(_parsed_documents(spark, folder))


@query
def parser_accuracy(spark, folder):
    """Each shape of query says what should come out of it."""
    shape, piece = F.col("piece_no") % 6, F.col("piece")
    named = F.when(shape == 3, F.substring_index(piece, " ", 2)).when(
        shape == 5, F.substring_index(piece, " ", 1)
    )
    split_off = F.when(shape.isin(3, 5), A.after_words(piece, 2)).otherwise("")
    labelled = _parsed_documents(spark, folder).select(
        "artist_name",
        "track_name",
        X.normalize_query(F.coalesce(named, piece)).alias("artist_label"),
        X.normalize_query(split_off).alias("track_label"),
    )
    is_match = (F.col("artist_name") == F.col("artist_label")) & (
        F.col("track_name") == F.col("track_label")
    )
    matches = F.count_if(is_match)
    return labelled.agg(
        F.count("*").alias("labelled"),
        matches.alias("matched"),
        F.round(matches / F.count("*"), 6).alias("accuracy"),
    )


def _coverage(resolved: DataFrame, version: int) -> DataFrame:
    covered = F.count_if(parsing.is_chartable(F.col("parse_confidence")))
    return resolved.agg(
        F.lit(version).alias("parser_version"),
        F.count("*").alias("row_count"),
        covered.alias("covered"),
        F.round(covered / F.count("*"), 6).alias("coverage"),
    )


@query
def parser_coverage(spark, folder):
    """Share of queries fit for a chart: separators only, then with a catalogue."""
    queries = A.document_queries(spark, folder)
    known = _catalogue(spark, folder)
    return _coverage(resolver.resolve_queries(queries, "query_text", None), 1).unionAll(
        _coverage(
            resolver.resolve_queries(queries, "query_text", known, ("doc_id", "piece_no")), 2
        )
    )


# -- catalogue and resolution -------------------------------------------------


def _catalogue(spark, folder):
    """The catalogue as users have it: built once, then read as a table."""
    return store.read_catalogue(spark, _new_store(spark, folder))


@query
def catalogue_build(spark, folder):
    built = catalogue.build_catalogue(catalogue.dump_names(A.dump_lines(spark, folder)))
    return built.withColumn("token_count", F.col("token_count").cast("int"))


@query
def catalogue_dump_report(spark, folder):
    return catalogue.dump_report(A.dump_lines(spark, folder))


def _candidates(spark, folder):
    normalized = A.document_queries(spark, folder).select(
        "doc_id", "piece_no", X.normalize_query(F.col("query_text")).alias("normalized")
    )
    return resolver.candidate_keys(normalized, "normalized", ("doc_id", "piece_no"))


@query
def candidate_keys(spark, folder):
    return _candidates(spark, folder)


@query
def candidate_lookup(spark, folder):
    return resolver.existing_candidates(_candidates(spark, folder), _catalogue(spark, folder))


def _matched(spark, folder, strategy):
    normalized = A.document_queries(spark, folder).select(
        "doc_id", "piece_no", X.normalize_query(F.col("query_text")).alias("normalized")
    )
    matched = resolver.match_catalogue(
        normalized, "normalized", _catalogue(spark, folder), ("doc_id", "piece_no"), strategy
    )
    return _parse_rows(matched.where(F.col("artist_name").isNotNull()))


@query
def resolve_catalogue(spark, folder):
    return _matched(spark, folder, "auto")


@query
def resolve_catalogue_shuffled(spark, folder):
    """The plan for catalogues too large to broadcast; same rows."""
    return _matched(spark, folder, "shuffle")


@query
def resolve(spark, folder):
    resolved = resolver.resolve_queries(
        A.document_queries(spark, folder),
        "query_text",
        _catalogue(spark, folder),
        ("doc_id", "piece_no"),
    )
    return _parse_rows(resolved)


# -- identity and archive -----------------------------------------------------


@query
def pseudonymize(spark, folder):
    names = A.table(spark, folder, "customer").select("c_custkey", "c_name")
    return names.select(
        "c_custkey", privacy.pseudonymize(F.col("c_name"), DEMO_KEY).alias("pseudonym")
    )


@query
def derived_ticket(spark, folder):
    return A.events_as_raw(spark, folder).select(
        F.col("ticket").alias("event_id"),
        privacy.derived_ticket_sha256(
            F.col("searcher_pseudonym"), _text("received_at"), F.col("query_text")
        ).alias("ticket"),
    )


@query
def archive_import(spark, folder):
    classified = archive.classify_archive(A.archive_lines(spark, folder))
    imported = archive.imported_rows(classified, ticket=privacy.derived_ticket_sha256)
    return _raw_rows(imported)


@query
def archive_import_tickets(spark, folder):
    """The default BLAKE2b tickets, as counted per day: SQL has no such hash."""
    classified = archive.classify_archive(A.archive_lines(spark, folder))
    imported = archive.imported_rows(classified)
    return imported.groupBy(F.col("received_date").cast("string").alias("received_date")).agg(
        F.count("*").alias("row_count"), F.sum("ticket").alias("ticket_sum")
    )


@query
def archive_reject_report(spark, folder):
    return archive.reject_report(archive.classify_archive(A.archive_lines(spark, folder)))


@query
def archive_import_limit(spark, folder):
    classified = archive.classify_archive(A.archive_lines(spark, folder))
    accepted = classified.where(F.col("reason") == archive.IMPORTED)
    limited = archive.limit_per_file(accepted, limit=1500)
    return limited.select(
        "file", "line_order", "searcher_pseudonym", "query_text", _text("received_at")
    )


def _archive_folder(spark, folder):
    """The archive lines as a plain, a packed and a packed file without its suffix (by file number)."""
    lines = A.archive_lines(spark, folder)
    path = shared_dir(spark, "archive")
    for number, (kind, codec) in enumerate((("plain", None), ("packed", "gzip"), ("renamed", "gzip"))):
        aside = f"{path}-{kind}"
        part = lines.where(F.col("file") == number).select("line")
        part.write.option("compression", codec or "none").text(aside)
        for i, name in enumerate(x for x in store.names_in(spark, aside) if x.startswith("part-")):
            suffix = ".gz" if kind == "packed" else ""
            source, files = store.filesystem(spark, f"{aside}/{name}")
            target, _ = store.filesystem(spark, f"{path}/searches-{kind}-{i}.jsonl{suffix}")
            files.mkdirs(target.getParent())
            files.rename(source, target)
    return path


@query
def archive_files(spark, folder):
    """Files of three kinds through the import job: lines per kind and reason."""
    place = store.Store(shared_dir(spark, "import-store"))
    report = imports.import_archives(spark, place, _archive_folder(spark, folder))
    kind = F.regexp_extract("file", "searches-([a-z]+)-", 1).alias("kind")
    return report.groupBy(kind, "reason").agg(F.sum("line_count").alias("line_count"))


@query
def archive_files_raw(spark, folder):
    """The raw layer after those files were imported, and imported again."""
    place = store.Store(shared_dir(spark, "import-store"))
    path = _archive_folder(spark, folder)
    for _ in range(2):
        imports.import_archives(spark, place, path, ticket=privacy.derived_ticket_sha256)
    return _raw_rows(store.read_raw(spark, place))


# -- jobs that write ----------------------------------------------------------


def typed_searches(spark: SparkSession, folder: str) -> DataFrame:
    """Document queries as raw rows; every second one was relayed twice."""
    queries = A.document_queries(spark, folder)
    copies = F.explode(F.sequence(F.lit(0), F.col("piece_no") % 2)).alias("copy")
    rows = queries.select("*", copies)
    at = F.expr(
        "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(doc_id % 10 as int), "
        "cast(piece_no % 24 as int), cast(doc_id % 59 as int), copy)"
    )
    is_archive = F.col("doc_id") % 10 < 4
    return rows.select(
        at.alias("received_at"),
        F.to_date(at).alias("received_date"),
        A.pseudonym_of(F.col("doc_id") % 97).alias("searcher_pseudonym"),
        (F.col("doc_id") * 100_000 + F.col("piece_no")).alias("ticket"),
        "query_text",
        F.when(is_archive, S.SOURCE_IMPORTED).otherwise(S.SOURCE_DISTRIBUTED).alias("source"),
    )


def _new_store(spark: SparkSession, folder: str) -> store.Store:
    place = store.Store(shared_dir(spark, "store"))
    built = catalogue.build_catalogue(A.document_names(spark, folder))
    catalogue.replace_catalogue(built, place.catalogue)
    return place


@query
def reprocess_full(spark, folder):
    place = _new_store(spark, folder)
    store.append_raw(typed_searches(spark, folder), place)
    reprocess.reprocess(spark, place, rebuild=True)
    return _state_rows(store.read_hourly(spark, place), *hourly.ARTIST)


@query
def reprocess_incremental(spark, folder):
    """Two loads and an incremental run leave what one full run leaves."""
    place = _new_store(spark, folder)
    searches = typed_searches(spark, folder)
    split = F.col("received_at") < datetime(2024, 1, 6, 12)
    store.append_raw(searches.where(split), place)
    reprocess.reprocess(spark, place)
    store.append_raw(searches.where(~split), place)
    reprocess.reprocess(spark, place, incremental=True)
    return _state_rows(store.read_hourly(spark, place), *hourly.ARTIST)


@query
def reprocess_parsed(spark, folder):
    """The parsed layer itself, row by row."""
    parsed = reprocess.parse_raw(typed_searches(spark, folder), _catalogue(spark, folder))
    return parsed.select(
        _text("received_at"),
        "searcher_pseudonym",
        "ticket",
        "artist_name",
        "album_name",
        "track_name",
        F.round(F.col("parse_confidence").cast("double"), 2).alias("parse_confidence"),
        F.col("key_epoch").cast("int").alias("key_epoch"),
    )


@query
def reprocess_watermark(spark, folder):
    newest = reprocess.watermark(A.order_lines_as_parsed(spark, folder))
    return newest.select(_text("watermark"))


@query
def publish_aggregates(spark, folder):
    """Published, read back through the pointer, and merged over all hours."""
    root = shared_dir(spark, "published")
    maintenance.publish(_artist_hourly(spark, folder), root)
    return hourly.collapse_epochs(maintenance.read_published(spark, root))


@query
def reconcile_counts(spark, folder):
    source = A.events_as_raw(spark, folder)
    target = shared_dir(spark, "copy")
    source.write.partitionBy("received_date").parquet(target)
    copy = spark.read.schema(source.schema).parquet(target)
    result = maintenance.reconcile(source, copy, ["received_date"])
    return result.withColumn("received_date", F.col("received_date").cast("string"))


# -- streams ------------------------------------------------------------------


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = A.table(spark, folder, "events").schema
    # A pattern, as a stream takes a plain path for a folder.
    events = spark.readStream.schema(schema).parquet(f"{folder}/{{events}}.parquet")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _drain(query) -> None:
    query.awaitTermination()


@query
def stream_ingest(spark, folder):
    """Messages of three kinds; the accepted ones land in the raw layer."""
    kind = (
        F.when(F.col("event_type") == "error", "ping")
        .when(F.col("event_type") == "click", S.SOURCE_DISTRIBUTED_SERVER)
        .otherwise(S.SOURCE_DISTRIBUTED)
    )
    messages = _stream(spark, folder).select(
        kind.alias("kind"),
        F.col("ts").alias("received_at"),
        F.concat(F.lit("user-"), F.col("user_id")).alias("user"),
        F.col("event_id").alias("ticket"),
        F.col("props").alias("query"),
    )
    root = shared_dir(spark, "ingest")
    accepted = ingest.accept_messages(messages, DEMO_KEY)
    _drain(ingest.write_raw(accepted, f"{root}/raw", f"{root}/checkpoint", available_now=True))
    return _raw_rows(spark.read.schema(S.RAW_SCHEMA).parquet(f"{root}/raw"))


@query
def stream_dedup(spark, folder):
    """Every search arrives twice; the repeats do not reach the raw layer."""
    at, copies = F.col("ts"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("copy")
    searches = _stream(spark, folder).select(
        at.alias("received_at"),
        A.pseudonym_of(F.col("user_id")).alias("searcher_pseudonym"),
        F.col("event_id").alias("ticket"),
        F.col("event_type").alias("query_text"),
        F.lit(S.SOURCE_DISTRIBUTED).alias("source"),
        copies,
    )
    root = shared_dir(spark, "dedup")
    once = ingest.suppress_repeats(searches.drop("copy"))
    _drain(ingest.write_raw(once, f"{root}/raw", f"{root}/checkpoint", available_now=True))
    return _raw_rows(spark.read.schema(S.RAW_SCHEMA).parquet(f"{root}/raw"))


@query
def stream_artist_hourly(spark, folder):
    parsed = A.event_searches(_stream(spark, folder))
    root = shared_dir(spark, "rollup")
    _drain(
        rollup.maintain_hourly(
            parsed, f"{root}/states", f"{root}/checkpoint", available_now=True
        )
    )
    return _state_rows(rollup.read_increments(spark, f"{root}/states"), *hourly.ARTIST)




@query
def stream_then_fold(spark, folder):
    """Two streams that meet in one day, folded into the hourly table.

    The first fold ends between its decision and its table, as after a crash; the second
    completes it before it takes what came since, and a third finds nothing.
    """
    place = store.Store(shared_dir(spark, "live"))
    parsed = A.event_searches(_stream(spark, folder))
    is_early = F.col("received_at") < datetime(2024, 1, 16, 12)
    for name, part in (("early", parsed.where(is_early)), ("late", parsed.where(~is_early))):
        checkpoint = f"{place.root}/checkpoint-{name}"
        _drain(rollup.maintain_hourly(part, place.increments(hourly.ARTIST), checkpoint, available_now=True))
        if name == "early":
            fold.prepare(spark, place)
    fold.fold_increments(spark, place)
    fold.fold_increments(spark, place)
    return _state_rows(store.read_hourly(spark, place), *hourly.ARTIST)


@query
def stream_silence(spark, folder):
    """Silences of each kind of event, found live with keyed state.

    Event time ends with the last whole minute before the newest event.
    """
    searches = _stream(spark, folder).select(
        F.col("ts").alias("received_at"), F.col("event_type").alias("source")
    )
    root = shared_dir(spark, "silence")
    found = silence.live_silence(searches, lateness="0 seconds")
    writer = found.writeStream.option("checkpointLocation", f"{root}/checkpoint").outputMode("append")
    _drain(writer.trigger(availableNow=True).format("parquet").start(f"{root}/found"))
    return spark.read.schema(silence.SCHEMA).parquet(f"{root}/found").where(
        F.col("kind") == silence.RESUMED
    ).select("source", _text("silent_from"), _text("silent_until"), "silent_ticks")


# -- overlap and scenes ---------------------------------------------------------


@query
def stream_overlap(spark, folder):
    """Kinds of events as streams; a person asking for an artist as an item."""
    searches = A.events_as_parsed(spark, folder).select(
        F.substring_index("query_text", " ", 1).alias("stream"),
        F.concat_ws(":", "searcher_pseudonym", "artist_name").alias("item"),
    )
    exact = overlap.exact_overlap(searches, "stream", "item")
    estimated = overlap.estimated_overlap(overlap.stream_sketches(searches, "stream", "item"))
    both = exact.join(estimated, ["first", "second"])
    shares = ("jaccard", "jaccard_estimate", "jaccard_low", "jaccard_high")
    return both.select(
        "first", "second", "first_items", "second_items", "shared_items",
        *(F.round(name, 6).alias(name) for name in shares),
    )


def _order_line_words(spark: SparkSession, folder: str) -> DataFrame:
    return scenes.person_words(A.order_lines_as_parsed(spark, folder))


SCENE_SEEDS = ("11",)


@query
def scene_lift(spark, folder):
    """Every word's lift in the scene of customers who ordered parts of one brand number."""
    lift = scenes.scene_lift(_order_line_words(spark, folder), SCENE_SEEDS)
    return lift.withColumn("lift", F.round("lift", 6))


@query
def scene_recommendation(spark, folder):
    found = scenes.recommended(_order_line_words(spark, folder), SCENE_SEEDS, size=20)
    return found.withColumn("lift", F.round("lift", 6))


@query
def artist_trends(spark, folder):
    """Every artist's share of people, this week against the one before."""
    window = periods.resolve_period("week", datetime(2024, 1, 24))
    found = trends.trends(A.events_as_parsed(spark, folder), window)
    shares = ("share_before", "share_now", "change")
    return found.select(
        "artist_name", "people_before", "people_now", *(F.round(s, 6).alias(s) for s in shares)
    )


def _asked_for_kinds(spark, folder):
    """Searches for kinds of events, which people repeat."""
    return A.events_as_parsed(spark, folder).withColumn("query_text", F.col("track_name"))


@query
def periodic_repeats(spark, folder):
    """How regular every person's repeated search is, by the hour."""
    found = repeats.periodic_repeats(_asked_for_kinds(spark, folder), tolerance=3600)
    return found.withColumn("share", F.round("share", 6))


@query
def search_bursts(spark, folder):
    """Repeats of a search at most a day after the last."""
    found = repeats.bursts(_asked_for_kinds(spark, folder), within=86_400)
    return found.withColumns({c: F.date_format(c, SECOND) for c in ("started_at", "ended_at")})


@query
def artist_chart_spellings(spark, folder):
    """Artists typed in three ways by hour of day, counted together."""
    searches = A.events_as_parsed(spark, folder)
    name, shape = F.col("artist_name"), F.hour("received_at") % 3
    typed = F.when(shape == 0, F.concat(F.lit("The "), name)).when(shape == 1, F.upper(name)).otherwise(name)
    states = hourly.hourly_states(searches.withColumn("artist_name", typed), hourly.ARTIST)
    window = periods.resolve_period("week", datetime(2024, 1, 24))
    return spellings.merged_chart(states, window)
