import random
import sys
import unicodedata

import pandas as pd
from labelled_queries import LABELLED, MINIMUM_ACCURACY
from pyspark.sql import functions as F

from demandlens.functions import parsing
from demandlens.functions import text as X


def column(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    rows = df.select("i", build(F.col("s")).alias("r")).orderBy("i").collect()
    return [row["r"] for row in rows]


def parse(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    normalized = df.withColumn("n", X.normalize_query(F.col("s")))
    rows = parsing.parse_queries(normalized, "n").orderBy("i").collect()
    return [
        (r["artist_name"], r["album_name"], r["track_name"], r["parse_confidence"]) for r in rows
    ]


def test_normalize_examples(spark):
    pairs = {
        "Aphex Twin - Windowlicker [FLAC] 320kbps": "aphex twin - windowlicker",
        "C:\\Music\\Portishead - Glory Box.flac": "portishead - glory box",
        "Björk - Jóga": "bjork - joga",
        "AC/DC - Back in Black": "ac dc - back in black",
        "   ": "",
        "Straße der Einsamen": "strasse der einsamen",
        "ΣΊΣΥΦΟΣ": "σισυφοσ",
        "Кино — Группа крови": "кино группа крови",
        "坂本龍一 - 戦場のメリークリスマス": "坂本龍一 - 戦場のメリークリスマス",
        "song_name.with.dots": "song name with dots",
        "1999 song 24 bit 44.1khz": "song",
        "multi\nline\ttext": "multi line text",
    }
    got = column(spark, pairs, X.normalize_query)
    expected = [
        "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c))
        for v in pairs.values()
    ]
    assert got == expected


def test_missing_text_stays_missing(spark):
    assert column(spark, [None], X.normalize_query) == [None]


def test_file_names(spark):
    pairs = {
        "AC/DC": "AC/DC",
        "a/b/c": "c",
        "/leading": "leading",
        "D:/x": "x",
        "\\\\server\\share\\": "",
        "one\\two": "one\\two",
        "a/\nb/": "a/\nb/",
    }
    assert column(spark, pairs, X.take_file_name) == list(pairs.values())


def test_artist_key_spellings_collapse(spark):
    pairs = [
        ("The Beatles", "beatles"),
        ("Beatles, The", "The Beatles"),
        ("Simon & Garfunkel", "Simon and Garfunkel"),
        ("Sigur Rós", "sigur ros"),
    ]
    for first, second in pairs:
        keys = column(spark, [first, second], X.artist_key)
        assert keys[0] == keys[1] != ""


def test_years_are_noise_even_in_names(spark):
    assert column(spark, ["The 1975"], X.artist_key) == ["the"]


def test_fold_of_every_character(spark):
    codes = [c for c in range(1, sys.maxunicode + 1) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]
    frame = pd.DataFrame({"s": [f"a{chr(c)}b" for c in codes]})
    got = spark.createDataFrame(frame).repartition(8).select("s", X.fold(F.col("s")).alias("r"))
    for row in got.toPandas().itertuples(index=False):
        decomposed = unicodedata.normalize("NFKD", row.s.casefold())
        assert row.r == "".join(c for c in decomposed if not unicodedata.combining(c)), repr(row.s)


def random_queries(count, seed):
    rng = random.Random(seed)
    words = (
        "flac mp3 v0 cbr 16 24 bit 320 kbps 320kbps 44.1 khz 48khz cd rip web 1999 2024 19999 "
        "the and & - -- _ . , .mp3 x.flac [a] (b {c} 01 7 - aphex twin don't été Ä 24-bit _cd_ "
        "discography full album box set greatest hits"
    ).split(" ")
    return [
        rng.choice(["", " ", "-"]).join(rng.choices(words, k=rng.randint(0, 7)))
        if rng.random() < 0.3
        else " ".join(rng.choices(words, k=rng.randint(0, 9)))
        for _ in range(count)
    ]


def test_one_alternation_equals_families_in_turn(spark):
    families = [
        r"\p{Nd}{2,4}[SP]?kbps",
        "v0|v2|vbr|cbr|abr",
        "(?:16|24)[SP]?bit",
        r"(?:44\.1|48|88\.2|96|192)[SP]?khz",
        "flac|mp3|wav|aac|ogg|opus|alac|ape|lossless|lossy",
        "cd|cdrip|cdq|web|webrip|vinyl|vinylrip|rip|scene",
        "remaster|remastered|reissue|deluxe|bonus",
        r"(?:19|20)\p{Nd}{2}",
    ]

    def in_turn(text):
        for family in families:
            pattern = family.replace("[SP]", f"[{X.SPACE}]")
            text = F.regexp_replace(text, f"{X.WORD_START}(?:{pattern}){X.WORD_END}", " ")
        return text

    queries = random_queries(3000, 5)
    df = spark.createDataFrame([(q,) for q in queries], "s string")
    differing = df.where(in_turn(F.col("s")) != F.regexp_replace("s", X.NOISE, " "))
    assert differing.collect() == []


def test_prefix_keys_equal_the_full_key(spark):
    queries = random_queries(3000, 11) + ["_flac_ x", "24 - bit x", "1 -a b", "℡ one", "the x"]
    df = spark.createDataFrame([(q,) for q in queries], "s string")
    cored = df.withColumn("core", X.query_core(X.normalize_query(F.col("s")))).withColumn(
        "plain", X.is_plain_core(F.col("core"))
    )
    prefixes = cored.select(
        "plain", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("n"), "core"
    ).withColumn("prefix", F.expr("substring_index(core, ' ', n)"))
    keyed = prefixes.withColumn("fast", X.prefix_key(F.col("prefix"), F.col("plain"))).withColumn(
        "full", X.artist_key(F.col("prefix"))
    )
    assert keyed.where("fast <> full").collect() == []


def test_parser_accuracy_on_the_labelled_set(spark):
    parsed = parse(spark, [query for query, _, _ in LABELLED])
    matches = [
        (artist, track) == (row[0], row[2])
        for (_, artist, track), row in zip(LABELLED, parsed, strict=True)
    ]
    assert sum(matches) / len(matches) >= MINIMUM_ACCURACY
    assert sum(matches) == 43


def test_parser_shapes(spark):
    queries = [
        "",
        "burial untrue",
        "Amon Tobin - Bricolage full album",
        "the cure greatest hits",
        "collection",
        "a - b - c",
        "full album discography someone",
    ]
    assert parse(spark, queries) == [
        ("", "", "", 0.0),
        ("burial untrue", "", "", 0.3),
        ("amon tobin", "bricolage", "", 0.7),
        ("the cure", "greatest hits", "", 0.7),
        ("collection", "", "", 0.3),
        ("a", "", "c", 0.6),
        ("full album someone", "discography", "", 0.7),
    ]
