"""Normalisation of search text and artist names, as Spark columns.

Everything runs inside the JVM. Character classes are spelled out as Unicode
properties because Java's shorthand classes are ASCII only. Text that holds
nothing beyond ASCII takes the built-in ``lower``; other text is case-folded
and decomposed by the ICU library that ships with Spark.
"""

from __future__ import annotations

import string
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# What describes the file rather than the music.
FILE_EXTENSIONS = "mp3|flac|wav|m4a|aac|ogg|opus|wma|ape|alac|aiff|mpc"
NOISE_WORDS = (
    "v0 v2 vbr cbr abr "
    "flac mp3 wav aac ogg opus alac ape lossless lossy "
    "cd cdrip cdq web webrip vinyl vinylrip rip scene "
    "remaster remastered reissue deluxe bonus"
).split()
NOISE_NUMBERS = (
    r"\p{Nd}{2,4}[SPACE]?kbps",
    r"(?:16|24)[SPACE]?bit",
    r"(?:44\.1|48|88\.2|96|192)[SPACE]?khz",
    r"(?:19|20)\p{Nd}{2}",
)

# Letters and digits listed one by one make a bit set, which Java tests before
# it looks at the properties; most text never gets that far.
PLAIN = string.ascii_lowercase + string.digits
WORD = PLAIN + r"_\p{L}\p{N}"
SPACE = r" \s\x1c-\x1f\x85\p{Z}"
WORD_START = f"(?<![{WORD}])"
WORD_END = f"(?![{WORD}])"


def _any_of(words: list[str]) -> str:
    """Alternatives grouped by their first letter."""
    groups: dict[str, list[str]] = {}
    for word in words:
        groups.setdefault(word[0], []).append(word[1:])
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in groups.items())


PATH_SHAPE = r"^[A-Za-z]:[\\/]|^[\\/]|[\\/][^\n]*[\\/]"
EXTENSION = rf"\.(?:{FILE_EXTENSIONS}){WORD_END}"
BRACKETED = r"[\[({][^\])}]*[\])}]"
LEADING_NUMBER = rf"^\p{{Nd}}{{1,2}}[{SPACE}]*[-._][{SPACE}]*"
# One alternation stands for the families applied in turn: every family begins
# and ends at a word edge, so removing one can never create another.
# The look-ahead rules most places out before the word edge is looked at.
_NOISE_FIRST = "".join(sorted({word[0] for word in NOISE_WORDS})) + string.digits
NOISE = (
    rf"(?=[{_NOISE_FIRST}\p{{Nd}}]){WORD_START}(?:"
    + "|".join(NOISE_NUMBERS).replace("[SPACE]", f"[{SPACE}]")
    + f"|{_any_of(NOISE_WORDS)}){WORD_END}"
)
# Separators, punctuation and white space between what is kept.
BETWEEN_WORDS = rf"[^{PLAIN}&'\-\p{{L}}\p{{N}}]+"
SPACES = rf"[{SPACE}]+"
TRAILING_ARTICLE = rf"(?i),[{SPACE}]*the[{SPACE}]*\z"
NOT_WORD_OR_SPACE = rf"[^{WORD}{SPACE}]"


@lru_cache(maxsize=1)
def combining_marks() -> str:
    """A pattern for every character with a combining class.

    The Latin marks come first; the look-ahead spares other characters the
    walk through the long class. It lets through what Java does not know yet,
    as its tables are older than Python's.
    """
    marks = [code for code in range(sys.maxunicode + 1) if unicodedata.combining(chr(code))]
    spans: list[list[int]] = []
    for code in marks:
        if spans and code == spans[-1][1] + 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    ranges = "".join(rf"\x{{{low:x}}}-\x{{{high:x}}}" for low, high in spans)
    return rf"[\x{{300}}-\x{{34e}}]|(?=[\p{{M}}\p{{Cn}}])[{ranges}]"


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def _decompose(text: Column) -> Column:
    """Compatibility decomposition without combining marks."""
    decomposed = F.reflect(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), text, F.lit(True)
    )
    return F.regexp_replace(decomposed, combining_marks(), "")


def strip_diacritics(text: Column) -> Column:
    """"Björk" and "Bjork" become the same text; case is left alone."""
    return F.when(is_ascii(text), text).when(text.isNotNull(), _decompose(text))


def fold(text: Column, probe: Column | None = None) -> Column:
    """Case folding followed by removal of diacritics.

    ``probe`` is the text tested for being ASCII; it may be a longer original
    when that is cheaper to look at than ``text`` itself.
    """
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), text, F.lit(True))
    looked_at = text if probe is None else probe
    return F.when(is_ascii(looked_at), F.lower(text)).when(
        looked_at.isNotNull(), _decompose(folded)
    )


def take_file_name(text: Column) -> Column:
    """The last segment of path-shaped text; other text unchanged."""
    last_segment = F.substring_index(F.translate(text, "\\", "/"), "/", -1)
    has_separator = F.contains(text, F.lit("/")) | F.contains(text, F.lit("\\"))
    return F.when(has_separator & text.rlike(PATH_SHAPE), last_segment).otherwise(text)


def _squeeze(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, " ")


def _strip_description(text: Column) -> Column:
    """Leading track number and noise words, then separators and punctuation."""
    text = F.regexp_replace(text, LEADING_NUMBER, "")
    text = F.regexp_replace(text, NOISE, " ")
    return F.trim(F.regexp_replace(text, BETWEEN_WORDS, " "), F.lit(" -"))


def normalize_query(text: Column) -> Column:
    """The searchable core of a raw query, or empty text."""
    core = fold(take_file_name(text), probe=text)
    core = F.regexp_replace(core, EXTENSION, " ")
    core = F.regexp_replace(core, BRACKETED, " ")
    return _strip_description(core)


def _drop_article(text: Column) -> Column:
    return F.regexp_replace(text, rf"^the[{SPACE}]+", "")


def _key_of_normalized(text: Column) -> Column:
    key = F.replace(_drop_article(text), F.lit("&"), F.lit("and"))
    return F.trim(_squeeze(F.regexp_replace(key, NOT_WORD_OR_SPACE, "")))


def artist_key(name: Column) -> Column:
    """One key for "The Beatles", "beatles" and "Beatles, The"."""
    return key_without_article(F.regexp_replace(name, TRAILING_ARTICLE, ""))


def key_without_article(name: Column) -> Column:
    """``artist_key`` of a name whose trailing article is gone already."""
    return _key_of_normalized(normalize_query(name))


def query_core(normalized: Column) -> Column:
    """Normalised text without the words that hold no letter or digit.

    Such words can only be made of the three marks normalisation keeps.
    """
    lone = rf"(?:^| )[^{PLAIN} \p{{L}}\p{{N}}]+(?= |\z)"
    has_mark = F.contains(normalized, F.lit("-"))
    for mark in ("&", "'"):
        has_mark = has_mark | F.contains(normalized, F.lit(mark))
    cleaned = F.ltrim(F.regexp_replace(normalized, lone, ""))
    return F.when(has_mark, cleaned).otherwise(normalized)


def is_plain_core(core: Column) -> Column:
    """True when keying a prefix of this text can only drop a leading article."""
    return core.rlike(r"^[a-z0-9 ]*\z") & ~core.rlike(NOISE)


def prefix_key(prefix: Column, plain: Column) -> Column:
    """``artist_key`` of a word prefix of ``query_core`` text.

    The prefix has been through normalisation once; it goes through again, as
    joining words anew can complete a noise pattern or a leading number. Plain
    text is known to pass unchanged. Prefixes that are not plain but ASCII
    cannot hold paths, extensions or brackets any more.
    """
    article_dropped = F.when(prefix.startswith("the "), F.substring(prefix, 5, 1_000_000_000))
    plain_key = F.coalesce(article_dropped, prefix)
    again = _key_of_normalized(_strip_description(fold(prefix)))
    return F.when(plain, plain_key).otherwise(again)
