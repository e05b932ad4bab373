"""Plain-SQL statements of the same queries, for DuckDB over the same tables.

They are written from the meaning of each query rather than from its Spark
plan: global windows, exact distinct counts and step-by-step text rules.
"""

from __future__ import annotations

from datetime import datetime

from demandlens.operators.resolver import COMMON_FIRST_WORDS, PLACEHOLDERS
from demandlens.plans.periods import resolve_period
from demandlens.sources.catalogue import PLACEHOLDER_KEYS
from demandlens.workload.queries import DEMO_KEY, SCENE_SEEDS

# -- the tables as searches ---------------------------------------------------

EVENTS = r"""
events_parsed AS (
    SELECT ts AS received_at, CAST(ts AS DATE) AS received_date,
        lpad(lower(hex(user_id)), 16, '0') AS searcher_pseudonym, event_id AS ticket,
        event_type || ' ' || regexp_extract(props, '"k": ([0-9]+)', 1) AS query_text,
        'artist ' || lpad(regexp_extract(props, '"k": ([0-9]+)', 1), 2, '0') AS artist_name,
        CASE WHEN event_type = 'signup' THEN '' ELSE event_type END AS track_name,
        CASE WHEN event_type = 'error' THEN 0.3 ELSE 0.9 END AS parse_confidence,
        CASE WHEN ts < TIMESTAMP '2024-01-17 11:37:00' THEN 1 ELSE 2 END AS key_epoch,
        CASE WHEN ts < TIMESTAMP '2024-01-17 11:37:00' THEN 'imported' ELSE 'distributed' END
            AS source
    FROM events
)"""

LINES = """
lines_parsed AS (
    SELECT o_orderdate AS received_at, CAST(o_orderdate AS DATE) AS received_date,
        lpad(lower(hex(o_custkey)), 16, '0') AS searcher_pseudonym,
        l_orderkey * 10 + l_linenumber AS ticket,
        lower(p_brand) || ' ' || p_name AS query_text,
        lower(p_brand) AS artist_name, p_name AS track_name, 0.9 AS parse_confidence,
        CAST(1 + l_suppkey % 3 AS INTEGER) AS parser_version,
        CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 1 ELSE 2 END AS key_epoch,
        CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'imported' ELSE 'distributed' END
            AS source
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
)"""

LINES_LATEST = (
    LINES
    + """,
lines_latest AS (
    SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (
            PARTITION BY received_date, searcher_pseudonym, ticket
            ORDER BY parser_version DESC, received_at, query_text, artist_name, track_name,
                parse_confidence, key_epoch) AS rn
        FROM lines_parsed)
    WHERE rn = 1
)"""
)

PIECES = r"""
pieces AS (
    SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS piece_no,
        unnest(parts) AS piece
    FROM (SELECT doc_id, string_split(replace(text, '. ', chr(10)), chr(10)) AS parts
          FROM documents)
),
worded AS (
    SELECT *, string_split(piece, ' ') AS words FROM pieces
),
queries AS (
    SELECT doc_id, piece_no, piece,
        array_to_string(words[1:2], ' ') AS head, array_to_string(words[3:], ' ') AS tail,
        CASE piece_no % 6
            WHEN 0 THEN piece
            WHEN 1 THEN piece || ' [FLAC] 320kbps'
            WHEN 2 THEN 'C:\Music\' || piece || '.flac'
            WHEN 3 THEN array_to_string(words[1:2], ' ') || ' - ' || array_to_string(words[3:], ' ')
            WHEN 4 THEN piece || ' discography'
            ELSE '01 - ' || words[1] || ' - ' || coalesce(words[2], '') || ' - '
                || array_to_string(words[3:], ' ')
        END AS query_text
    FROM worded
),
names AS (
    SELECT doc_id, piece_no,
        array_to_string(words[1:piece_no % 8 + 1], ' ') AS display_name
    FROM worded
)"""


def time_text(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


# -- text rules ---------------------------------------------------------------

NOISE_STEPS = (
    r"\b\d{2,4}\s?kbps\b",
    r"\b(v0|v2|vbr|cbr|abr)\b",
    r"\b(16|24)\s?bit\b",
    r"\b(44\.1|48|88\.2|96|192)\s?khz\b",
    r"\b(flac|mp3|wav|aac|ogg|opus|alac|ape|lossless|lossy)\b",
    r"\b(cd|cdrip|cdq|web|webrip|vinyl|vinylrip|rip|scene)\b",
    r"\b(remaster|remastered|reissue|deluxe|bonus)\b",
    r"\b(19|20)\d{2}\b",
)


def _gsub(text: str, pattern: str, replacement: str) -> str:
    pattern = pattern.replace("'", "''")
    return f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"


def file_name_sql(text: str) -> str:
    return (
        rf"CASE WHEN regexp_matches({text}, '^[A-Za-z]:[\\/]|^[\\/]|[\\/][^\n]*[\\/]') "
        rf"THEN list_extract(string_split(replace({text}, '\', '/'), '/'), -1) ELSE {text} END"
    )


def strip_sql(text: str) -> str:
    return f"strip_accents({text})"


def normalize_sql(text: str) -> str:
    """The tables hold Latin letters only, so ASCII word rules apply once folded."""
    out = strip_sql(f"replace(lower({file_name_sql(text)}), 'ß', 'ss')")
    out = _gsub(out, r"\.(mp3|flac|wav|m4a|aac|ogg|opus|wma|ape|alac|aiff|mpc)\b", " ")
    out = _gsub(out, r"[\[\({][^\]\)}]*[\]\)}]", " ")
    out = _gsub(out, r"^\d{1,2}\s*[-._]\s*", "")
    for step in NOISE_STEPS:
        out = _gsub(out, step, " ")
    out = f"replace(replace({out}, '_', ' '), '.', ' ')"
    out = _gsub(out, r"[^\w\s&'-]", " ")
    return f"trim({_gsub(out, r's+'.replace('s', chr(92) + 's'), ' ')}, ' -')"


def key_sql(name: str) -> str:
    out = normalize_sql(f"regexp_replace({name}, ',\\s*the\\s*$', '', 'i')")
    out = f"regexp_replace({out}, '^the\\s+', '')"
    out = _gsub(f"replace({out}, '&', 'and')", r"[^\w\s]", "")
    return f"trim({_gsub(out, chr(92) + 's+', ' ')})"


NORMALIZED = (
    PIECES
    + f""",
normalized AS (
    SELECT doc_id, piece_no, piece, head, tail, query_text,
        {normalize_sql("query_text")} AS n
    FROM queries
)"""
)

_MARKERS = (
    "discography",
    "full album",
    "complete album",
    "greatest hits",
    "anthology",
    "box set",
    "collection",
)


def _marker_case(result) -> str:
    whens = " ".join(
        rf"WHEN regexp_matches(n, '\b{marker}\b') THEN {result(marker)}" for marker in _MARKERS
    )
    return f"CASE {whens} ELSE '' END"


def _remainder(marker: str) -> str:
    removed = _gsub("n", rf"\b{marker}\b", " ")
    return f"trim({_gsub(removed, chr(92) + 's+', ' ')}, ' -')"


def parse_ctes(source: str) -> str:
    """From ``source`` with normalised text ``n`` to ``parsed``."""
    return f"""
marked AS (
    SELECT *, {_marker_case(lambda m: f"'{m}'")} AS marker, {_marker_case(_remainder)} AS remainder
    FROM {source}
),
fragmented AS (
    SELECT *, remainder <> '' AS is_album,
        list_filter(
            string_split_regex(CASE WHEN remainder <> '' THEN remainder ELSE n END, '\\s+[-–—]\\s+'),
            lambda x: x <> '') AS f
    FROM marked
),
parsed AS (
    SELECT *,
        CASE WHEN n = '' THEN ''
             WHEN is_album AND len(f) <> 2 THEN remainder
             WHEN len(f) >= 2 THEN f[1]
             ELSE n END AS p_artist,
        CASE WHEN is_album AND len(f) = 2 THEN f[2] WHEN is_album THEN marker ELSE '' END AS p_album,
        CASE WHEN n = '' OR is_album THEN '' WHEN len(f) >= 2 THEN f[-1] ELSE '' END AS p_track,
        CAST(CASE WHEN n = '' THEN 0.0 WHEN is_album THEN 0.7 WHEN len(f) = 2 THEN 0.9
             WHEN len(f) > 2 THEN 0.6 ELSE 0.3 END AS DOUBLE) AS p_confidence
    FROM fragmented
)"""


def _quoted(words) -> str:
    return ", ".join("'" + word + "'" for word in words)


USEFUL = f"""length(key) >= 2 AND NOT regexp_matches(key, '^\\d+$')
    AND key NOT IN ({_quoted(PLACEHOLDER_KEYS)})"""

CATALOGUE = f"""
catalogue AS (
    SELECT key AS normalized_name, min(display_name) AS display_name
    FROM (SELECT {key_sql("display_name")} AS key, display_name FROM names)
    WHERE {USEFUL} GROUP BY key
)"""

CANDIDATES = f"""
tokens AS (
    SELECT *, list_filter(string_split(n, ' '), lambda x: regexp_matches(x, '[a-z0-9]')) AS t
    FROM normalized
),
prefixes AS (
    SELECT doc_id, piece_no, t, unnest(range(1, least(len(t), 8) + 1)) AS prefix_length FROM tokens
),
prefix_texts AS (
    SELECT doc_id, piece_no, t, prefix_length,
        array_to_string(t[1:prefix_length], ' ') AS prefix_text
    FROM prefixes
),
candidates AS (
    SELECT doc_id, piece_no, t, CAST(prefix_length AS INTEGER) AS prefix_length, prefix_text,
        {key_sql("prefix_text")} AS artist_key
    FROM prefix_texts
),
matches AS (
    SELECT doc_id, piece_no, max(prefix_length) AS len_matched
    FROM candidates
    WHERE artist_key <> '' AND artist_key IN (SELECT normalized_name FROM catalogue)
        AND artist_key NOT IN ({_quoted(PLACEHOLDERS)})
        AND NOT (prefix_length = 1 AND len(t) > 1
                 AND (length(t[1]) < 3 OR t[1] IN ({_quoted(COMMON_FIRST_WORDS)})))
    GROUP BY doc_id, piece_no
),
matched AS (
    SELECT doc_id, piece_no,
        array_to_string(t[1:len_matched], ' ') AS m_artist,
        array_to_string(t[len_matched + 1:], ' ') AS m_track,
        CASE WHEN len(t) > len_matched THEN 0.8 ELSE 0.85 END AS m_confidence
    FROM matches JOIN tokens USING (doc_id, piece_no)
)"""

RESOLVED = (
    "WITH "
    + NORMALIZED
    + ","
    + CATALOGUE
    + ","
    + CANDIDATES
    + ","
    + parse_ctes("normalized")
    + """,
resolved AS (
    SELECT doc_id, piece_no, query_text,
        coalesce(m_artist, p_artist) AS artist_name,
        CASE WHEN m_artist IS NULL THEN p_album ELSE '' END AS album_name,
        coalesce(m_track, p_track) AS track_name,
        round(CAST(coalesce(m_confidence, p_confidence) AS DOUBLE), 2) AS parse_confidence
    FROM parsed LEFT JOIN matched USING (doc_id, piece_no)
)"""
)

TYPED = (
    RESOLVED
    + """,
copied AS (
    SELECT *, unnest(range(0, piece_no % 2 + 1)) AS copy FROM resolved
),
observed AS (
    SELECT TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 10 AS INTEGER))
            + to_hours(piece_no % 24) + to_minutes(doc_id % 59) + to_seconds(copy) AS received_at,
        lpad(lower(hex(doc_id % 97)), 16, '0') AS searcher_pseudonym,
        doc_id * 100000 + piece_no AS ticket,
        CASE WHEN doc_id % 10 < 4 THEN 1 ELSE 2 END AS key_epoch,
        artist_name, album_name, track_name, parse_confidence
    FROM copied
),
searches AS (
    SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (
            PARTITION BY CAST(received_at AS DATE), searcher_pseudonym, ticket
            ORDER BY received_at) AS rn
        FROM observed)
    WHERE rn = 1
)"""
)

# -- charts -------------------------------------------------------------------


def chart_ctes(source: str, entity: str, period: str, moment: datetime, look_back: bool) -> str:
    """Positions now and before by global windows, people by exact counts."""
    window = resolve_period(period, moment)
    start, end, before = (
        f"TIMESTAMP '{bound}'"
        for bound in (window.current_start, window.current_end, window.previous_start)
    )
    gate = " AND ".join(f"{name} <> ''" for name in entity.split(", "))
    seen = (
        f"""{entity} IN (SELECT {entity} FROM gated
            WHERE date_trunc('hour', received_at) < {before})"""
        if look_back
        else "false"
    )
    return f"""
gated AS (SELECT * FROM {source} WHERE parse_confidence >= 0.5 AND {gate}),
now_by_epoch AS (
    SELECT {entity}, key_epoch, count(*) AS searches,
        count(DISTINCT searcher_pseudonym) AS listeners
    FROM gated
    WHERE date_trunc('hour', received_at) >= {start} AND date_trunc('hour', received_at) < {end}
    GROUP BY {entity}, key_epoch
),
now_all AS (
    SELECT {entity}, CAST(sum(searches) AS BIGINT) AS searches,
        CASE WHEN count(*) = 1 THEN max(listeners) END AS listeners
    FROM now_by_epoch GROUP BY {entity}
),
now_ranked AS (
    SELECT *, row_number() OVER (ORDER BY searches DESC, {entity}) AS position FROM now_all
),
before_ranked AS (
    SELECT {entity}, row_number() OVER (ORDER BY count(*) DESC, {entity}) AS previous_position
    FROM gated
    WHERE date_trunc('hour', received_at) >= {before} AND date_trunc('hour', received_at) < {start}
    GROUP BY {entity}
),
chart AS (
    SELECT position, {entity}, searches, listeners,
        CASE WHEN previous_position IS NULL AND {seen} THEN 're_entry'
             WHEN previous_position IS NULL THEN 'new'
             WHEN previous_position = position THEN 'unchanged'
             WHEN previous_position > position THEN 'up' ELSE 'down' END AS movement,
        previous_position - position AS positions
    FROM now_ranked LEFT JOIN before_ranked USING ({entity})
)"""


def chart_sql(
    tables: str, source: str, entity: str, period: str, moment: datetime,
    page_size: int = 50, offset: int = 0, columns: str = "*",
) -> str:
    ctes = chart_ctes(source, entity, period, moment, look_back=entity == "artist_name")
    return f"""WITH {tables}, {ctes}
SELECT {columns} FROM chart WHERE position > {offset} AND position <= {offset + page_size}"""


def hourly_sql(tables: str, source: str, entity: str) -> str:
    gate = " AND ".join(f"{name} <> ''" for name in entity.split(", "))
    return f"""{tables}
SELECT {time_text("date_trunc('hour', received_at)")} AS hour_start, key_epoch, {entity},
    count(*) AS searches, count(DISTINCT searcher_pseudonym) AS listeners
FROM {source} WHERE parse_confidence >= 0.5 AND {gate}
GROUP BY date_trunc('hour', received_at), key_epoch, {entity}"""


def merged_sql(group: str, where: str, having_epochs: bool, label: str) -> str:
    """Two-step merge of artist rows: by epoch, then over epochs."""
    extra = ", count(*) AS epoch_count" if having_epochs else ""
    return f"""
SELECT {label}, CAST(sum(searches) AS BIGINT) AS searches,
    CASE WHEN count(*) = 1 THEN max(listeners) END AS listeners{extra}
FROM (SELECT {group} AS g, key_epoch, count(*) AS searches,
          count(DISTINCT searcher_pseudonym) AS listeners
      FROM events_parsed WHERE parse_confidence >= 0.5 AND {where}
      GROUP BY g, key_epoch)
GROUP BY g"""


# -- archive ------------------------------------------------------------------

ARCHIVE = (
    EVENTS
    + """,
archive AS (
    SELECT *, ticket % 20 AS kind,
        date_trunc('second', received_at) AS wall_clock,
        strftime(received_at, '%Y-%m-%dT%H:%M:%S')
            || CASE WHEN ticket % 20 = 6 THEN '+02:00' ELSE 'Z' END AS time_text,
        CASE WHEN ticket % 20 = 0 THEN 'blank' WHEN ticket % 20 IN (1, 2) THEN 'malformed'
             WHEN ticket % 20 = 3 THEN 'no_searcher' WHEN ticket % 20 IN (4, 5) THEN 'invalid'
             ELSE 'imported' END AS reason
    FROM events_parsed
)"""
)

_SHA_TICKET = "CAST('0x' || substr(sha256({}), 1, 8) AS BIGINT)"


def _pads() -> tuple[str, str]:
    key = bytes.fromhex(DEMO_KEY).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def pseudonym_sql(name: str) -> str:
    inner, outer = _pads()
    return (
        f"substr(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({name})))), "
        "1, 16)"
    )


# -- all statements -----------------------------------------------------------

RAW_COLUMNS = f"{time_text('received_at')} AS received_at, searcher_pseudonym, ticket, query_text, source"
RESOLVED_COLUMNS = "doc_id, piece_no, artist_name, album_name, track_name, parse_confidence"
WEEK = ("week", datetime(2024, 1, 24))


def all_statements() -> dict[str, str]:
    events = "WITH " + EVENTS
    lines = "WITH " + LINES
    out: dict[str, str] = {}

    def artist(period, moment, **more):
        return chart_sql(EVENTS, "events_parsed", "artist_name", period, moment, **more)

    out["artist_chart_week"] = artist(*WEEK)
    out["artist_chart_day"] = artist("day", datetime(2024, 1, 17))
    out["artist_chart_cutover_week"] = artist("week", datetime(2024, 1, 17), page_size=200)
    out["artist_chart_page2"] = artist(*WEEK, page_size=20, offset=20)
    out["artist_chart_deep_page"] = out["artist_chart_page2"]
    out["artist_chart_month"] = chart_sql(
        LINES_LATEST, "lines_latest", "artist_name", "month", datetime(1997, 3, 15)
    )
    out["track_chart_week"] = chart_sql(
        EVENTS, "events_parsed", "artist_name, track_name", *WEEK, page_size=200
    )
    out["track_chart_month"] = chart_sql(
        LINES_LATEST, "lines_latest", "artist_name, track_name", "month", datetime(1997, 3, 15)
    )
    out["chart_movement"] = artist(
        "day",
        datetime(2024, 1, 18),
        page_size=200,
        columns="position, artist_name, movement, positions",
    )
    out["chart_share"] = artist(
        *WEEK,
        columns="""position, artist_name, searches,
            round(greatest(searches / greatest(max(searches) OVER (), 1) * 100, 2), 6) AS share""",
    )
    out["chart_export"] = out["artist_chart_week"]
    out["artist_chart_first_seen"] = out["artist_chart_week"]
    out["artist_time_series"] = events + merged_sql(
        "date_trunc('day', received_at)",
        "artist_name = 'artist 07' AND date_trunc('hour', received_at) >= TIMESTAMP '2024-01-05 12:00:00'",
        False,
        time_text("g") + " AS day",
    )
    out["artist_top_tracks"] = (
        events
        + merged_sql(
            "track_name",
            "artist_name = 'artist 07' AND track_name <> '' AND received_at >= TIMESTAMP '2024-01-18'",
            False,
            "g AS track_name",
        )
        + " ORDER BY searches DESC, track_name LIMIT 50"
    )
    since = "date_trunc('hour', received_at) >= TIMESTAMP '2024-01-11'"
    history = merged_sql(
        "date_trunc('day', received_at)",
        f"artist_name = 'artist 07' AND {since}",
        False,
        f"'history' AS part, {time_text('g')} AS entry",
    )
    tracks = merged_sql(
        "track_name",
        f"artist_name = 'artist 07' AND track_name <> '' AND {since}",
        False,
        "'track' AS part, g AS entry",
    )
    out["artist_detail"] = (
        f"{events} {history} UNION ALL (SELECT * FROM ({tracks}) ORDER BY searches DESC, entry LIMIT 50)"
    )
    out["artist_detail_stored"] = out["artist_detail"]
    out["artist_search"] = f"""{events}
SELECT artist_name, count(*) AS searches FROM events_parsed
WHERE parse_confidence >= 0.5 AND contains(lower(artist_name), lower('ARTIST 1'))
    AND received_at >= TIMESTAMP '2024-01-03'
GROUP BY artist_name ORDER BY searches DESC, artist_name LIMIT 20"""
    out["period_windows"] = " UNION ALL ".join(
        f"""SELECT '{period}' AS period, {time_text("day")} AS day,
    {time_text(f"date_trunc('{period}', day)")} AS current_start,
    {time_text(f"date_trunc('{period}', day) + INTERVAL 1 {period}")} AS current_end,
    {time_text(f"date_trunc('{period}', day) - INTERVAL 1 {period}")} AS previous_start
FROM (SELECT DISTINCT date_trunc('day', ts) AS day FROM events)"""
        for period in ("day", "week", "month")
    )

    out["artist_hourly"] = hourly_sql(events, "events_parsed", "artist_name")
    out["track_hourly"] = hourly_sql(events, "events_parsed", "artist_name, track_name")
    out["stream_artist_hourly"] = out["artist_hourly"]
    out["stream_then_fold"] = out["artist_hourly"]
    out["window_merge"] = f"""{events}
SELECT artist_name, key_epoch, count(*) AS searches,
    count(DISTINCT searcher_pseudonym) AS listeners
FROM events_parsed WHERE parse_confidence >= 0.5
    AND received_at >= TIMESTAMP '2024-01-15' AND received_at < TIMESTAMP '2024-01-22'
GROUP BY artist_name, key_epoch"""
    out["epoch_collapse"] = events + merged_sql(
        "artist_name",
        "received_at >= TIMESTAMP '2024-01-17' AND received_at < TIMESTAMP '2024-01-18'",
        True,
        "g AS artist_name",
    )
    out["artist_window_exact"] = events + merged_sql("artist_name", "true", False, "g AS artist_name")
    out["publish_aggregates"] = events + merged_sql("artist_name", "true", True, "g AS artist_name")
    out["dataset_summary"] = f"""{events}
SELECT count(*) AS row_count, count(DISTINCT artist_name) AS artists FROM events_parsed"""

    moment = "TIMESTAMP '2024-01-09 13:30:00'"
    out["raw_dates_since"] = f"""{events}
SELECT DISTINCT CAST(received_date AS VARCHAR) AS received_date FROM events_parsed
WHERE received_at >= {moment}"""
    out["raw_scan_since"] = f"""{events}
SELECT {RAW_COLUMNS} FROM events_parsed WHERE events_parsed.received_at >= {moment}"""
    out["raw_incremental_pull"] = f"""{events}
SELECT {RAW_COLUMNS} FROM events_parsed WHERE events_parsed.received_at >
    (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '2024-01-20')"""
    out["raw_dedup"] = f"""{lines}
SELECT {RAW_COLUMNS} FROM (
    SELECT *, row_number() OVER (PARTITION BY received_date, searcher_pseudonym, ticket
        ORDER BY received_at, source, query_text) AS rn FROM lines_parsed)
WHERE rn = 1"""
    out["parsed_latest_version"] = f"""WITH {LINES_LATEST}
SELECT {time_text("received_at")} AS received_at, searcher_pseudonym, ticket, query_text,
    artist_name, track_name, parser_version
FROM lines_latest"""
    out["duplicate_rate"] = f"""{lines}
SELECT {time_text("date_trunc('minute', received_at)")} AS minute, count(*) AS received,
    count(DISTINCT (searcher_pseudonym, ticket)) AS distinct_searches,
    count(*) - count(DISTINCT (searcher_pseudonym, ticket)) AS duplicates,
    round((count(*) - count(DISTINCT (searcher_pseudonym, ticket))) / count(*), 6)
        AS duplicate_share
FROM lines_parsed GROUP BY date_trunc('minute', received_at)"""
    out["key_epoch_assign"] = f"""{events}
SELECT source, CASE WHEN source = 'imported' THEN 1 ELSE 2 END AS key_epoch, count(*) AS row_count
FROM events_parsed GROUP BY source"""
    as_of = "TIMESTAMP '2024-01-31 09:00:00'"
    out["retention_filter"] = f"""{events},
kept AS (
    SELECT 'raw' AS layer, received_date FROM events_parsed
    WHERE received_at >= {as_of} - INTERVAL 14 DAY
    UNION ALL
    SELECT 'parsed', received_date FROM events_parsed
    WHERE received_at >= {as_of} - INTERVAL 30 DAY
    UNION ALL
    SELECT 'hourly', CAST(hour_start AS DATE) FROM (
        SELECT DISTINCT date_trunc('hour', received_at) AS hour_start, key_epoch, artist_name
        FROM events_parsed WHERE parse_confidence >= 0.5)
    WHERE hour_start >= {as_of} - INTERVAL 3 YEAR
)
SELECT layer, CAST(received_date AS VARCHAR) AS day, count(*) AS row_count
FROM kept GROUP BY layer, received_date"""
    out["search_rate_per_minute"] = f"""
SELECT {time_text("date_trunc('minute', ts)")} AS minute, count(*) AS received,
    round(count(*) / 60, 6) AS searches_per_second
FROM events GROUP BY date_trunc('minute', ts)"""
    out["silence_periods"] = f"""
WITH ticks AS (
    SELECT unnest(generate_series(
        (SELECT date_trunc('minute', min(ts)) FROM events),
        (SELECT date_trunc('minute', max(ts)) FROM events), INTERVAL 1 MINUTE)) AS minute
),
silent AS (
    SELECT minute, row_number() OVER (ORDER BY minute) AS rn FROM ticks
    WHERE minute NOT IN (SELECT date_trunc('minute', ts) FROM events)
),
runs AS (
    SELECT min(minute) AS first_minute, max(minute) AS last_minute, count(*) AS silent_ticks
    FROM silent GROUP BY minute - to_minutes(rn)
)
SELECT {time_text("first_minute")} AS silent_from,
    {time_text("last_minute + INTERVAL 1 MINUTE")} AS silent_until, silent_ticks,
    {time_text("first_minute + INTERVAL 5 MINUTE")} AS restart_due_at
FROM runs WHERE silent_ticks >= 5"""
    out["silence_so_far"] = out["silence_periods"].replace(
        "(SELECT date_trunc('minute', max(ts)) FROM events)",
        "(SELECT date_trunc('minute', max(ts)) + INTERVAL 59 MINUTES FROM events)",
    )
    out["stream_silence"] = f"""
WITH busy AS (
    SELECT DISTINCT event_type, date_trunc('minute', ts) AS minute FROM events
    WHERE ts < (SELECT date_trunc('minute', max(ts)) FROM events)
),
gaps AS (
    SELECT event_type, minute,
        lag(minute) OVER (PARTITION BY event_type ORDER BY minute) AS before FROM busy
)
SELECT event_type AS source, {time_text("before + INTERVAL 1 MINUTE")} AS silent_from,
    {time_text("minute")} AS silent_until,
    date_diff('minute', before, minute) - 1 AS silent_ticks
FROM gaps WHERE date_diff('minute', before, minute) - 1 >= 5"""
    out["search_rate_every_minute"] = f"""
WITH ticks AS (
    SELECT unnest(generate_series(
        (SELECT date_trunc('minute', min(ts)) FROM events),
        (SELECT date_trunc('minute', max(ts)) FROM events), INTERVAL 1 MINUTE)) AS minute
)
SELECT {time_text("minute")} AS minute, count(ts) AS received,
    round(count(ts) / 60, 6) AS searches_per_second
FROM ticks LEFT JOIN events ON date_trunc('minute', ts) = minute GROUP BY minute"""
    out["ingest_statistics"] = f"""{lines}
SELECT count(*) AS received,
    count(DISTINCT (received_date, searcher_pseudonym, ticket)) AS written,
    count(*) - count(DISTINCT (received_date, searcher_pseudonym, ticket)) AS duplicates_skipped,
    CAST(0 AS BIGINT) AS dropped
FROM lines_parsed"""

    out["catalogue_dump_report"] = f"""WITH {PIECES}
SELECT count(*) FILTER ((doc_id + piece_no) % 10 <> 0) AS records,
    count(*) FILTER ((doc_id + piece_no) % 10 = 0) AS skipped FROM queries"""
    weeks = [
        (f"SELECT artist_name, searcher_pseudonym FROM events_parsed "
         f"WHERE received_at >= TIMESTAMP '2024-01-{a}' AND received_at < TIMESTAMP '2024-01-{b}'")
        for a, b in ((15, 22), (22, 29))
    ]
    gaps = f"""{events},
asked AS (SELECT DISTINCT searcher_pseudonym, track_name AS query_text, received_at FROM events_parsed),
timed AS (
    SELECT *, lag(received_at) OVER same AS earlier,
        floor((epoch_us(received_at) - epoch_us(lag(received_at) OVER same)) / 1000000) AS gap
    FROM asked WINDOW same AS (PARTITION BY searcher_pseudonym, query_text ORDER BY received_at))"""
    out["periodic_repeats"] = f"""{gaps},
counted AS (
    SELECT searcher_pseudonym, query_text, count(*) AS n,
        CAST(floor((gap + 1800) / 3600) * 3600 AS BIGINT) AS interval_seconds
    FROM timed WHERE gap IS NOT NULL GROUP BY ALL),
placed AS (
    SELECT *, sum(n) OVER (PARTITION BY searcher_pseudonym, query_text) AS gaps,
        row_number() OVER (
            PARTITION BY searcher_pseudonym, query_text ORDER BY n DESC, interval_seconds) AS place
    FROM counted)
SELECT searcher_pseudonym, query_text, CAST(gaps + 1 AS BIGINT) AS searches, interval_seconds,
    n AS steady, round(n / gaps, 6) AS share
FROM placed WHERE place = 1 AND gaps >= 3"""
    out["search_bursts"] = f"""{gaps},
numbered AS (
    SELECT *, sum(CASE WHEN gap <= 86400 THEN 0 ELSE 1 END) OVER (
        PARTITION BY searcher_pseudonym, query_text ORDER BY received_at) AS burst
    FROM timed)
SELECT searcher_pseudonym, query_text, {time_text("min(received_at)")} AS started_at,
    {time_text("max(received_at)")} AS ended_at, count(*) AS searches
FROM numbered GROUP BY searcher_pseudonym, query_text, burst HAVING count(*) >= 3"""
    out["artist_trends"] = f"""{events},
before AS ({weeks[0]}), now AS ({weeks[1]}),
b AS (SELECT artist_name, count(DISTINCT searcher_pseudonym) AS n FROM before GROUP BY artist_name),
c AS (SELECT artist_name, count(DISTINCT searcher_pseudonym) AS n FROM now GROUP BY artist_name),
shares AS (
    SELECT coalesce(b.artist_name, c.artist_name) AS artist_name,
        coalesce(b.n, 0) AS people_before, coalesce(c.n, 0) AS people_now,
        people_before / (SELECT count(DISTINCT searcher_pseudonym) FROM before) AS share_before,
        people_now / (SELECT count(DISTINCT searcher_pseudonym) FROM now) AS share_now
    FROM b FULL JOIN c ON b.artist_name = c.artist_name
)
SELECT artist_name, people_before, people_now, round(share_before, 6) AS share_before,
    round(share_now, 6) AS share_now, round(share_now - share_before, 6) AS change FROM shares"""
    out["artist_chart_spellings"] = f"""{events},
typed AS (
    SELECT *, CASE hour(received_at) % 3 WHEN 0 THEN 'The ' || artist_name
        WHEN 1 THEN upper(artist_name) ELSE artist_name END AS name FROM events_parsed
    WHERE parse_confidence >= 0.5
        AND received_at >= TIMESTAMP '2024-01-22' AND received_at < TIMESTAMP '2024-01-29'
),
names AS (SELECT artist_name, name, count(*) AS n FROM typed GROUP BY ALL),
shown AS (
    SELECT artist_name, arg_min(name, (-n, name)) AS name, count(*) AS spellings
    FROM names GROUP BY artist_name
),
counted AS (
    SELECT artist_name, count(*) AS searches, count(DISTINCT searcher_pseudonym) AS listeners
    FROM typed GROUP BY artist_name
)
SELECT CAST(row_number() OVER (ORDER BY searches DESC, name) AS INTEGER) AS position,
    name AS artist_name, searches, listeners, spellings
FROM shown JOIN counted USING (artist_name) QUALIFY position <= 50"""
    out["stream_overlap"] = f"""{events},
items AS (
    SELECT DISTINCT split_part(query_text, ' ', 1) AS stream,
        searcher_pseudonym || ':' || artist_name AS item FROM events_parsed
),
sizes AS (SELECT stream, count(*) AS n FROM items GROUP BY stream),
pairs AS (
    SELECT a.stream AS first, b.stream AS second, a.n AS first_items, b.n AS second_items,
        (SELECT count(*) FROM items x JOIN items y ON x.item = y.item
            WHERE x.stream = a.stream AND y.stream = b.stream) AS shared_items
    FROM sizes a JOIN sizes b ON a.stream < b.stream
)
SELECT *, round(shared_items / (first_items + second_items - shared_items), 6) AS jaccard,
    jaccard AS jaccard_estimate, jaccard AS jaccard_low, jaccard AS jaccard_high FROM pairs"""
    seeds = ", ".join(f"'{word}'" for word in SCENE_SEEDS)
    lift = f"""{lines},
pairs AS (
    SELECT DISTINCT searcher_pseudonym AS person,
        unnest(regexp_extract_all(lower(query_text), '[\\p{{L}}\\p{{N}}]+')) AS word
    FROM lines_parsed
),
scene AS (SELECT DISTINCT person FROM pairs WHERE word IN ({seeds})),
sizes AS (
    SELECT (SELECT count(*) FROM scene) AS scene, count(DISTINCT person) AS everyone,
        count(DISTINCT word) AS words FROM pairs
),
counts AS (
    SELECT word, count(*) FILTER (person IN (SELECT person FROM scene)) AS scene_people,
        count(*) AS people FROM pairs GROUP BY word
),
lifts AS (
    SELECT word, scene_people, people,
        ((scene_people + 1.0::DOUBLE) / (scene + words)) / ((people + 1.0::DOUBLE) / (everyone + words)) AS lift
    FROM counts, sizes
)"""
    out["scene_lift"] = f"{lift} SELECT word, scene_people, people, round(lift, 6) AS lift FROM lifts"
    out["scene_recommendation"] = f"""{lift}
SELECT CAST(row_number() OVER (ORDER BY round(lift, 9) DESC, scene_people DESC, word) AS INTEGER)
    AS position, word, scene_people, people, round(lift, 6) AS lift
FROM lifts WHERE word NOT IN ({seeds}) AND scene_people >= 2
QUALIFY position <= 20"""

    out["take_file_name"] = f"""WITH {PIECES},
texts AS (SELECT query_text FROM queries UNION ALL SELECT url FROM pages)
SELECT query_text, {file_name_sql("query_text")} AS file_name FROM texts"""
    out["strip_diacritics"] = f"SELECT doc_id, {strip_sql('text')} AS plain_text FROM documents"
    out["normalize_query"] = f"WITH {NORMALIZED} SELECT doc_id, piece_no, n AS normalized FROM normalized"
    out["normalize_document"] = f"SELECT doc_id, {normalize_sql('text')} AS normalized FROM documents"
    out["artist_key"] = f"""WITH {PIECES},
dressed AS (
    SELECT doc_id, piece_no,
        CASE WHEN piece_no % 2 = 0 THEN display_name || ', The'
             ELSE 'The ' || display_name || ' & Co' END AS display_name
    FROM names)
SELECT doc_id, piece_no, {key_sql("display_name")} AS artist_key FROM dressed"""
    out["parse_query"] = f"""WITH {NORMALIZED}, {parse_ctes("normalized")}
SELECT doc_id, piece_no, p_artist AS artist_name, p_album AS album_name, p_track AS track_name,
    round(p_confidence, 2) AS parse_confidence FROM parsed"""
    out["parser_accuracy"] = f"""WITH {NORMALIZED}, {parse_ctes("normalized")},
labels AS (
    SELECT p_artist, p_track,
        CASE piece_no % 6 WHEN 3 THEN head WHEN 5 THEN string_split(piece, ' ')[1] ELSE piece END
            AS artist_label,
        CASE WHEN piece_no % 6 IN (3, 5) THEN tail ELSE '' END AS track_label
    FROM parsed
),
labelled AS (
    SELECT p_artist = {normalize_sql("artist_label")} AND p_track = {normalize_sql("track_label")}
        AS is_match
    FROM labels)
SELECT count(*) AS labelled, CAST(count_if(is_match) AS BIGINT) AS matched,
    round(count_if(is_match) / count(*), 6) AS accuracy
FROM labelled"""
    out["parser_coverage"] = f"""{RESOLVED}
SELECT 1 AS parser_version, count(*) AS row_count, CAST(count_if(p_confidence >= 0.5) AS BIGINT) AS covered,
    round(count_if(p_confidence >= 0.5) / count(*), 6) AS coverage FROM parsed
UNION ALL
SELECT 2, count(*), CAST(count_if(parse_confidence >= 0.5) AS BIGINT),
    round(count_if(parse_confidence >= 0.5) / count(*), 6) FROM resolved"""

    out["catalogue_build"] = f"""WITH {PIECES},
whole AS (SELECT display_name FROM names WHERE (doc_id + piece_no) % 10 <> 0),
spelled AS (
    SELECT display_name FROM whole UNION ALL SELECT upper(replace(display_name, 'ß', 'ss')) FROM whole
    UNION ALL SELECT display_name || ', The' FROM whole),
keyed AS (SELECT {key_sql("display_name")} AS key, display_name FROM spelled)
SELECT key AS normalized_name, min(display_name) AS display_name,
    CAST(least(length(key) - length(replace(key, ' ', '')) + 1, 255) AS INTEGER) AS token_count
FROM keyed WHERE {USEFUL} GROUP BY key"""
    candidates = f"WITH {NORMALIZED}, {CATALOGUE}, {CANDIDATES}"
    out["candidate_keys"] = f"""{candidates}
SELECT doc_id, piece_no, prefix_length, artist_key FROM candidates WHERE artist_key <> ''"""
    out["candidate_lookup"] = f"""{candidates}
SELECT DISTINCT artist_key FROM candidates
WHERE artist_key <> '' AND artist_key IN (SELECT normalized_name FROM catalogue)"""
    out["resolve_catalogue"] = f"""{candidates}
SELECT doc_id, piece_no, m_artist AS artist_name, '' AS album_name, m_track AS track_name,
    CAST(m_confidence AS DOUBLE) AS parse_confidence FROM matched"""
    out["resolve_catalogue_shuffled"] = out["resolve_catalogue"]
    out["resolve"] = f"{RESOLVED} SELECT {RESOLVED_COLUMNS} FROM resolved"

    out["pseudonymize"] = (
        f"SELECT c_custkey, {pseudonym_sql('c_name')} AS pseudonym FROM customer"
    )
    source = f"searcher_pseudonym || '|' || {time_text('received_at')} || '|' || query_text"
    out["derived_ticket"] = f"""{events}
SELECT ticket AS event_id, {_SHA_TICKET.format(source)} AS ticket FROM events_parsed"""
    source = "searcher_pseudonym || '|' || time_text || '|' || query_text"
    out["archive_import"] = f"""WITH {ARCHIVE}
SELECT {time_text("wall_clock")} AS received_at, searcher_pseudonym,
    {_SHA_TICKET.format(source)} AS ticket, query_text, 'imported' AS source
FROM archive WHERE reason = 'imported'"""
    out["archive_reject_report"] = f"""WITH {ARCHIVE}
SELECT reason, count(*) AS line_count FROM archive GROUP BY reason"""
    out["archive_files"] = f"""WITH {ARCHIVE}
SELECT CASE ticket % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'packed' ELSE 'renamed' END AS kind, reason,
    count(*) AS line_count
FROM archive GROUP BY ALL"""
    out["archive_files_raw"] = out["archive_import"]
    out["archive_import_limit"] = f"""WITH {ARCHIVE}
SELECT file, line_order, searcher_pseudonym, query_text, received_at FROM (
    SELECT ticket % 3 AS file, ticket AS line_order, searcher_pseudonym, query_text,
        {time_text("wall_clock")} AS received_at,
        row_number() OVER (PARTITION BY ticket % 3 ORDER BY ticket) AS rn
    FROM archive WHERE reason = 'imported')
WHERE rn <= 1500"""

    out["reprocess_full"] = hourly_sql(TYPED, "searches", "artist_name")
    out["reprocess_incremental"] = out["reprocess_full"]
    out["reprocess_parsed"] = f"""{TYPED}
SELECT {time_text("received_at")} AS received_at, searcher_pseudonym, ticket, artist_name,
    album_name, track_name, parse_confidence, key_epoch FROM searches"""
    out["reprocess_watermark"] = f"""{lines}
SELECT {time_text("max(received_at)")} AS watermark FROM lines_parsed WHERE parser_version = 2"""
    out["reconcile_counts"] = """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS received_date, count(*) AS left_rows,
    count(*) AS right_rows, true AS is_equal
FROM events GROUP BY CAST(ts AS DATE)"""

    out["stream_ingest"] = f"""
SELECT {time_text("ts")} AS received_at,
    {pseudonym_sql("('user-' || user_id)")} AS searcher_pseudonym, event_id AS ticket,
    props AS query_text,
    CASE WHEN event_type = 'click' THEN 'distributed_server' ELSE 'distributed' END AS source
FROM events WHERE event_type <> 'error'"""
    out["stream_dedup"] = f"""
SELECT {time_text("ts")} AS received_at, lpad(lower(hex(user_id)), 16, '0') AS searcher_pseudonym,
    event_id AS ticket, event_type AS query_text, 'distributed' AS source
FROM events"""
    return out
