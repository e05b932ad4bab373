"""Secret scans: patterns and a battery of randomness tests (operator 3).

Everything is DataFrame functions. Two sources of spans:

* the base kinds assign, access and hex — fixed patterns, leftmost and not overlapping;
* kind random — tokens of 20 or more characters of an inferred encoding (hexadecimal,
  base 32, 36, 58 or 64) that randomness tests do not refute.

The battery tests "the token is uniform over its alphabet": chi-squared of the symbol
counts (with the exact mean and variance for short tokens), the number of runs above and
below the alphabet's middle, and the lag-one serial correlation. Fisher's method joins the
three. Over all tokens of all documents, per length stratum, the Benjamini-Hochberg
procedure at `fdr` tells which tokens are refuted: at most that share of those that are
thrown out is expected to be random. Short tokens, for which the tests have little power,
are not judged by longer ones, and a token needs 80 bits of alphabet times length.

p-values are counted in bins of a hundredth of a decimal exponent, rounded up, so the
procedure needs only a table of bounded size and no sort of all p-values.

Positions are code points, end exclusive: a pattern's matches alternate with the pieces
between them, so a running sum of lengths places every match in one pass over the text.

Defined cases: a null text is an empty one and has no span; repeated rows are scanned
each; a random token that overlaps a base span is left to the base span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlens.llm.common import stored

# -- fixed values: the base patterns -------------------------------------------
PATTERNS = {
    "assign": (
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
        r"([A-Za-z0-9+/_.=-]+)"
    ),
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "random": r"[A-Za-z0-9+/_-]{20,}",
}
KINDS = tuple(PATTERNS)
ASSIGN_LENGTH = 6
# -- fixed values: alphabets of encodings, narrowest first ----------------------
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "base32": UPPER + "234567",
    "base36": DIGITS + LOWER,
    "BASE36": DIGITS + UPPER,
    "base58": "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz",
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
}
#: Bits of alphabet times length that a random token needs.
LEAST_BITS = 80.0
FDR = 0.05
#: Smaller p-values count as this one.
P_FLOOR = 1e-30


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal (Zelen and Severo's approximation)."""
    t = 1.0 / (1.0 + 0.2316419 * F.abs(z))
    series = t * (
        0.319381530
        + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))
    )
    tail = F.exp(-z * z / 2.0) * 0.3989422804014327 * series
    return F.when(z >= 0, tail).otherwise(1.0 - tail)


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2.0 * _upper_tail(F.abs(z)))


def _total(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + of(x))


def encoding(token: Column) -> Column:
    """The narrowest alphabet that has all characters; null without digit or letter."""
    mixed = token.rlike("[0-9]") & token.rlike("[A-Za-z]")
    found = F.lit(None).cast("string")
    for name in reversed(ALPHABETS):
        found = F.when(token.rlike(f"^[{ALPHABETS[name].replace('-', chr(92) + '-')}]+$"), name).otherwise(found)
    return F.when(mixed, found)


def with_battery(df: DataFrame, token: str) -> DataFrame:
    """Adds encoding, bits and p_random of a token column.

    Columns that start with an underscore are the battery's own and leave again.
    """
    tok, alphabet = F.col(token), F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv])
    df = df.withColumn("encoding", encoding(tok))
    df = df.withColumn("_letters", alphabet[F.col("encoding")])
    df = df.withColumn("_a", F.length("_letters").cast("double"))
    df = df.withColumn("_n", F.length(tok).cast("double"))
    df = df.withColumn("bits", F.col("_n") * F.log2("_a"))
    # Symbols of tokens without an encoding are never looked at.
    chars = F.when(F.col("encoding").isNotNull(), F.split(tok, ""))
    df = df.withColumn("_chars", chars)
    df = df.withColumn(
        "_v", F.transform("_chars", lambda c: F.instr(F.col("_letters"), c).cast("double") - 1.0)
    )
    n, a, v = F.col("_n"), F.col("_a"), F.col("_v")
    later = F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0)))
    # Chi-squared by a gamma law of the same mean and variance (Wilson and Hilferty).
    counts = F.transform(
        F.array_distinct("_chars"), lambda c: n - F.length(F.replace(tok, c, F.lit("")))
    )
    chi = _total(counts, lambda x: x * x) * a / n - n
    spread = 2.0 * (a - 1.0) * (n - 1.0) / n
    scale, dof = spread / (2.0 * (a - 1.0)), 2.0 * (a - 1.0) * (a - 1.0) / spread
    cube = (F.pow(F.greatest(chi, F.lit(0.0)) / (scale * dof), F.lit(1.0 / 3.0)) - (1.0 - 2.0 / (9.0 * dof))) / F.sqrt(2.0 / (9.0 * dof))
    df = df.withColumn("_p_chi", _upper_tail(cube))
    # Runs above and below the middle of the alphabet.
    high = _total(v, lambda x: F.when(x >= a / 2.0, 1.0).otherwise(0.0))
    changes = F.aggregate(
        F.zip_with(F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0))), later,
                   lambda x, y: F.when((x >= a / 2.0) != (y >= a / 2.0), 1.0).otherwise(0.0)),
        F.lit(0.0), lambda s, x: s + x,
    )
    df = df.withColumn("_high", high).withColumn("_runs", changes + 1.0)
    mean = 2.0 * F.col("_high") * (n - F.col("_high")) / n + 1.0
    var = (mean - 1.0) * (mean - 2.0) / (n - 1.0)
    df = df.withColumn(
        "_p_runs",
        F.when(var > 0, _two_sided((F.col("_runs") - mean) / F.sqrt(var))).otherwise(P_FLOOR),
    )
    # Serial correlation of neighbours.
    df = df.withColumn("_m", _total(v, lambda x: x) / n)
    m = F.col("_m")
    square = _total(v, lambda x: (x - m) * (x - m))
    product = F.aggregate(
        F.zip_with(F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0))), later,
                   lambda x, y: (x - m) * (y - m)),
        F.lit(0.0), lambda s, x: s + x,
    )
    df = df.withColumn("_square", square)
    df = df.withColumn(
        "_p_serial",
        F.when(
            F.col("_square") > 0, _two_sided((product / F.col("_square") + 1.0 / n) * F.sqrt(n))
        ).otherwise(P_FLOOR),
    )
    fisher = -sum(
        F.log(F.greatest(F.col(c), F.lit(P_FLOOR))) for c in ("_p_chi", "_p_runs", "_p_serial")
    )
    df = df.withColumn("_half", fisher)
    half = F.col("_half")
    df = df.withColumn("p_random", F.exp(-half) * (1.0 + half + half * half / 2.0))
    return df.drop(*(c for c in df.columns if c.startswith("_") and c != token))


def refuted_below(tokens: DataFrame, fdr: float = FDR) -> DataFrame:
    """Per stratum of length, the bin from which on p-values refute randomness.

    Bins are -100·log10(p) rounded down, so a bin's p-value is never below its tokens'.
    """
    binned = tokens.groupBy("stratum", "p_bin").agg(F.count("*").alias("n"))
    up = Window.partitionBy("stratum").orderBy(F.desc("p_bin"))
    every = Window.partitionBy("stratum")
    ranked = binned.withColumn("at_most", F.sum("n").over(up)).withColumn("m", F.sum("n").over(every))
    passing = F.pow(F.lit(10.0), -F.col("p_bin") / 100.0) <= fdr * F.col("at_most") / F.col("m")
    return ranked.where(passing).groupBy("stratum").agg(F.min("p_bin").alias("refuted_bin"))


def _matches(kind: str) -> Column:
    """Pieces before each match, and the matches, as an array of structs."""
    pattern = F.lit(PATTERNS[kind])
    text = F.col("_text")
    both = F.arrays_zip(
        F.split(text, PATTERNS[kind], -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, pattern, F.lit(2 if kind == "assign" else 0)).alias("value"),
    )
    rows = F.transform(
        F.filter(both, lambda x: x["hit"].isNotNull()),
        lambda x, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind_no"),
            i.alias("match_no"),
            F.length(x["gap"]).alias("gap"),
            F.length(x["hit"]).alias("size"),
            x["value"].alias("value"),
        ),
    )
    empty = F.expr("CAST(array() AS array<struct<kind_no:int,match_no:int,gap:int,size:int,value:string>>)")
    return F.when(text.rlike(PATTERNS[kind]), rows).otherwise(empty)


def scan(
    docs: DataFrame, text: str = "text", key: str = "doc_id", row_no: str | None = None,
    fdr: float = FDR,
) -> DataFrame:
    """One row per document: row_no, key and its spans, sorted by start and kind.

    spans: array<struct<start, kind_no, end>>; row_no tells repeated keys apart.
    """
    number = F.col(row_no) if row_no else F.monotonically_increasing_id()
    rows = docs.select(
        number.alias("row_no"),
        F.col(key).alias("key"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    )
    hits = rows.select(
        "row_no", "key", F.explode_outer(F.concat(*map(_matches, KINDS))).alias("hit")
    ).select("row_no", "key", "hit.*")
    token = F.when(F.col("kind_no") == KINDS.index("random"), F.col("value"))
    judged = with_battery(hits.withColumn("token", token), "token")
    is_token = F.col("encoding").isNotNull() & (F.col("bits") >= LEAST_BITS)
    narrow = judged.select(
        "row_no", "key", "kind_no", "match_no", "gap", "size",
        F.when(is_token, F.floor(F.log2("size"))).alias("stratum"),
        F.when(is_token, F.floor(-100.0 * F.log10(F.greatest("p_random", F.lit(P_FLOOR))))).alias("p_bin"),
        F.when(F.col("kind_no") == 0, F.length("value") >= ASSIGN_LENGTH)
        .when(F.col("kind_no") == KINDS.index("random"), is_token)
        .otherwise(F.col("kind_no").isNotNull()).alias("is_kept"),
    )
    narrow = stored(narrow, "secret-spans")
    cut = refuted_below(narrow.where("p_bin IS NOT NULL"), fdr)
    before = Window.partitionBy("row_no", "kind_no").orderBy("match_no")
    placed = narrow.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before))
    placed = placed.withColumn("start", F.col("end") - F.col("size"))
    # At most one row per power of two in length: small whatever the corpus.
    placed = placed.join(F.broadcast(cut), "stratum", "left")
    is_random = F.col("kind_no") == KINDS.index("random")
    refuted = F.coalesce(is_random & (F.col("p_bin") >= F.col("refuted_bin")), F.lit(False))
    placed = placed.withColumn("is_kept", F.col("is_kept") & ~refuted)
    base = lambda c: F.when(F.col("is_kept") & ~is_random, F.col(c))
    ordered = Window.partitionBy("row_no").orderBy("start", "kind_no")
    left = F.max(base("end")).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    right = F.min(base("start")).over(ordered.rowsBetween(0, Window.unboundedFollowing))
    clash = (F.coalesce(left, F.lit(0)) > F.col("start")) | (
        F.coalesce(right, F.col("end")) < F.col("end")
    )
    placed = placed.withColumn("is_clash", is_random & clash)
    span = F.when(F.col("is_kept") & ~F.col("is_clash"), F.struct("start", "kind_no", "end"))
    return placed.groupBy("row_no").agg(
        F.first("key").alias("key"), F.sort_array(F.collect_list(span)).alias("spans")
    )


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", names[s["kind_no"]], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with each span replaced; overlapping spans become one mask."""
    step = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    cut = F.aggregate(
        spans, step,
        lambda s, x: F.struct(
            F.when(
                x["start"] >= s["at"],
                F.concat(s["out"], F.substring(text, s["at"].cast("int") + 1, (x["start"] - s["at"]).cast("int")), F.lit(mask)),
            ).otherwise(s["out"]).alias("out"),
            F.greatest(s["at"], x["end"]).alias("at"),
        ),
    )
    rest = lambda c: F.concat(c["out"], F.substring(text, c["at"].cast("int") + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.transform(F.array(cut), rest)[0]).otherwise(text)
