"""Quality rules: counted faults, then a likelihood ratio of hashed n-grams (operator 12).

DataFrame functions alone. A text's words are its runs of characters other than space and tab
to carriage return. Its n-grams (single words and pairs of neighbours) are hashed into
`BUCKETS` classes. Two multinomials over these are fitted: raw, on all texts, and target, on
trusted ones, both smoothed by adding one. The score of a text is the mean over its n-grams
of log(target / raw); every text whose score lies below `LEAST_SCORE` falls, and none is drawn
by chance.

Rules before it, from the text alone: too few words (`LEAST_WORDS`), or more than
`MOST_REPEATED` percent of its words in windows of three words found twice or more in it.

Trusted documents are named by their ids; at most `TRUSTED_ROWS` of them, picked by a hash of
the id, are used, so that they fit a broadcast whatever the corpus. The raw side is always
all texts. Learning is one pass whose texts never shuffle: counts are added up per task for
the buckets alone. Scoring is another pass without any shuffle.

Defined cases: a null or empty text, and one of white space alone, has no words, counts 0
and fails; its score is null. Without trusted texts there is no second verdict, the score is
null and the rules alone decide. Repeated rows count, and are judged, each; a null id is never
trusted; an empty table gives no rows; other columns than the two named are not read. Texts of
any length are judged whole: windows are sorted, not compared in pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
TRUSTED_ROWS = 100_000
#: Mean log ratio per n-gram that a text needs.
LEAST_SCORE = -0.06
LEAST_WORDS = 50
MOST_REPEATED = 50
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Weights:
    """log(target / raw) per bucket as text, or None without trusted texts."""

    listed: str | None

    def of(self, bucket: Column) -> Column:
        return F.get(F.split(F.lit(self.listed), ",").cast("array<double>"), bucket)


def words_of(text: Column) -> Column:
    """Runs of characters other than space and tab to carriage return; null texts have none."""
    inner = F.btrim(text, F.lit(SPACE))
    return F.when(inner != "", F.split(inner, "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))


def _hashed(rows: DataFrame, *columns: str) -> DataFrame:
    """Adds `hashes`, one number per word, from which those of n-grams are made."""
    return rows.select(*columns, "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))


def _first(items: Column, less: int) -> Column:
    """All but `less` items fewer than there are words."""
    return F.slice(items, 1, F.greatest(F.size("hashes") - less, F.lit(0)))


def _grams() -> Column:
    """Buckets of all words and of all pairs of neighbours."""
    bucket = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    pairs = F.transform("hashes", lambda a, i: bucket(F.xxhash64(a, F.get("hashes", i + 1))))
    return F.concat(F.transform("hashes", bucket), _first(pairs, 1))


def learn(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text") -> Weights:
    """Weights from all texts and those whose key is in `trusted` (a column of the same name)."""
    spark = docs.sparkSession
    few = F.broadcast(_bounded(trusted.select(F.col(key).alias("key"))).withColumn("is_trusted", F.lit(1)))
    rows = docs.select(F.col(key).alias("key"), words_of(F.col(text)).alias("words"))
    rows = _hashed(rows.join(few, "key", "left"), "is_trusted").select("is_trusted", _grams().alias("grams"))
    # Plain explode would work out the arrays once more to leave out empty ones.
    counts = (
        rows.select("is_trusted", F.explode_outer("grams").alias("bucket")).groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.count("is_trusted").alias("target"))
    )
    counted = lambda name: F.coalesce(name, F.lit(0))
    known = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    known = known.agg(
        F.sort_array(F.collect_list(F.struct("bucket", *(counted(x).alias(x) for x in ("raw", "target"))))).alias("all"),
        F.sum(counted("raw")).alias("n_raw"), F.sum(counted("target")).alias("n_target"),
    )
    share = lambda n, total: (n + 1) / (F.col(total) + BUCKETS)
    weights = F.transform("all", lambda b: F.log(share(b["target"], "n_target") / share(b["raw"], "n_raw")))
    found = known.select("n_target", F.array_join(weights.cast("array<string>"), ",").alias("listed")).first()
    return Weights(found.listed if found.n_target else None)


def _bounded(keys: DataFrame, most: int = TRUSTED_ROWS) -> DataFrame:
    """Distinct keys, or about `most` and never more of them, picked by a hash."""
    keys = keys.where("key IS NOT NULL").distinct()
    n = keys.count()
    if n > most:
        place = F.pmod(F.xxhash64("key"), F.lit(n))
        keys = keys.where(place < most).orderBy(F.xxhash64("key"), "key").limit(most)
    return keys


def judge(docs: DataFrame, weights: Weights, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, the counted faults, base_failed, score, kept."""
    given = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cut = _hashed(given.select("key", "text", words_of(F.col("text")).alias("words")), "key", "text")
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    hashed = lambda i: F.get("hashes", i)
    windows = F.transform("hashes", lambda a, i: F.xxhash64(a, hashed(i + 1), hashed(i + 2)))
    seen = cut.select(
        "key", "words", "hashes", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines"), _first(windows, 2).alias("windows"),
    )
    carried = ("key", "n_words", "word_chars", "n_symbols", "words", "hashes")
    met = seen.select(
        *carried, (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.col("windows"))
        .otherwise(F.array().cast("array<bigint>")).alias("windows"),
        _shifted(F.lit(1), F.length(F.bin(F.size("windows")))).alias("places"),
    )
    ordered = met.select(*carried, "n_dup_lines", "places", F.sort_array(_placed()).alias("ordered"))
    alike = ordered.select(*carried, "n_dup_lines", "places", _alike().alias("alike"))
    ruled = alike.select(*carried, "n_dup_lines", _repeated_words().cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    score = F.col("score")
    judged = ruled.select(
        "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), _score(weights).alias("score"),
    ).withColumn("kept", ~F.col("base_failed") & F.coalesce(score >= LEAST_SCORE, F.lit(True)))
    # A filter on the verdict must not be pushed below the arrays it is made of, which it would
    # then work out once per word: a generated row holds it back.
    return judged.select(F.explode_outer(F.array(F.struct("*"))).alias("row")).select("row.*")


def _shifted(number: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", number.cast("long"), bits.cast("int"))


def _placed() -> Column:
    """Hashes of windows with their places in the lowest bits: in order, equal ones are neighbours."""
    bits = F.length(F.bin("places")) - 1
    return F.transform("windows", lambda h, i: _shifted(h, bits).bitwiseOR(i.cast("long")))


def _alike() -> Column:
    """Windows, in order, whose neighbour has an equal hash."""
    equal = lambda x, j: _same_hash(x, F.get("ordered", j))
    return F.filter("ordered", lambda x, i: equal(x, i - 1) | equal(x, i + 1))


def _same_hash(x: Column, y: Column) -> Column:
    return x.bitwiseXOR(y).between(F.lit(0), F.col("places") - 1)


def _repeated_words() -> Column:
    """Words in windows that occur twice or more.

    Where different windows share a hash, they are sorted by their words, so that the count
    is exact.
    """
    place = lambda x: x.bitwiseAND(F.col("places") - 1).cast("int")
    word = lambda i: F.get("words", i)

    def clash(x: Column, i: Column) -> Column:
        y = F.get("alike", i + 1)
        a, b = place(x), place(y)
        differ = (word(a) != word(b)) | (word(a + 1) != word(b + 1)) | (word(a + 2) != word(b + 2))
        return _same_hash(x, y) & differ

    def spelt(x: Column) -> Column:
        i = place(x)
        return F.struct(F.concat_ws(" ", word(i), word(i + 1), word(i + 2)).alias("of"), i.alias("at"))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda total, n: total + n)

    sorted_out = _let(F.sort_array(F.transform("alike", spelt)), lambda s: F.transform(_with_equal(s), lambda x: x["at"]))
    clashes = F.size(F.filter("alike", clash)) > 0
    places = F.when(clashes, sorted_out).otherwise(F.transform("alike", place))
    return F.when(F.size("alike") > 0, _let(F.sort_array(places), covered)).otherwise(F.lit(0))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _with_equal(ordered: Column) -> Column:
    """Items whose neighbour has an equal `of`."""
    same = lambda x, j: F.coalesce(F.get(ordered, j)["of"] == x["of"], F.lit(False))
    return F.filter(ordered, lambda x, i: same(x, i - 1) | same(x, i + 1))


def _score(weights: Weights) -> Column:
    if weights.listed is None:
        return F.lit(None).cast("double")
    ratios = F.transform(_grams(), weights.of)
    total = F.aggregate(ratios, F.lit(0.0), lambda total, x: total + x)
    return F.when(F.size("hashes") > 0, total / (2 * F.size("hashes") - 1))
