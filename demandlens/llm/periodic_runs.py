"""Periodic runs of words, caught by dyadic blocks as words are appended (operator 13).

A run is a stretch of words with smallest period q (words q apart are equal), at least
`max(LEAST_WORDS, LEAST_PERIODS * q)` long, that no neighbouring word extends. `Catchers`
takes words in appended slices. Level k keeps the blocks of 2^k words that are completed:
the catcher of such a block compares it, as the suffix read so far, with what stood q words
earlier, for each period q of 2^k up to 2^(k+1) - 1. Two neighbouring blocks caught with one
period are a square; squares of one period merge into a stretch, whose ends are then found
word by word, and a stretch that reaches the last word goes on with the next slice. A run of
period q has 3q words that equal those q before, so it always holds two whole blocks of its
level. Blocks are compared by fingerprints of 64 bits, all catchers of a level at once; since
every stretch is compared word by word, a chance agreement of fingerprints changes nothing.

The work is words times levels, the memory a few numbers per word of one text. Nothing is
shuffled: every text is one row's work, and rows are spread as the table is.

Defined cases: a null or empty text, and one of white space alone, has no words and no runs;
a null id plants no period (see `planted`); repeated rows are treated each; an empty table
gives no rows; columns besides the two that are named are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from demandlens.llm.common import bound_batches

LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Words that are appended at once.
SLICE_WORDS = 1 << 20

SCHEMA = (
    "key {key}, n_words long, n_runs long, start long, length long, period long,"
    " exponent_milli long, runs array<struct<start:long,length:long,period:long>>,"
    " runs_sha256 string, collapsed_sha256 string, collapsed string"
)


class Catchers:
    """Runs of one sequence of numbers that grows at its end."""

    def __init__(self) -> None:
        self.words = np.empty(0, np.int64)
        self._prints: list[np.ndarray] = []
        self._open: dict[int, int] = {}
        self._found: dict[tuple[int, int], int] = {}

    def append(self, words: np.ndarray) -> None:
        before, self.words = len(self.words), np.concatenate([self.words, words])
        n = len(self.words)
        for period, start in list(self._open.items()):
            self._stretch(period, start, before)
        for level in range(max(0, (n // LEAST_PERIODS).bit_length())):
            self._catch(level, before, self._fingerprints(level, n))

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs up to now, by start, then period."""
        whole = [
            (a, b - a, q) for (a, b), q in self._found.items()
            if b - a >= max(LEAST_WORDS, LEAST_PERIODS * q)
        ]
        return sorted(whole, key=lambda r: (r[0], r[2]))

    def _fingerprints(self, level: int, n: int) -> np.ndarray:
        """Those of all 2^level words in a row; earlier ones are kept."""
        if level == len(self._prints):
            self._prints.append(np.empty(0, np.uint64))
        known, size = self._prints[level], 1 << level
        if level == 0:
            more = self.words[len(known):].astype(np.uint64) + np.uint64(1)
        else:
            below = self._prints[level - 1][len(known):]
            half = size >> 1
            more = below[:-half] * np.uint64(0x9E3779B97F4A7C15) + below[half:]
        more ^= more >> np.uint64(29)
        more *= np.uint64(0xBF58476D1CE4E5B9)
        self._prints[level] = np.concatenate([known, more]) if len(known) else more
        return self._prints[level]

    def _catch(self, level: int, before: int, prints: np.ndarray) -> None:
        """Blocks completed since `before`, with the last one of then, against their past."""
        size = 1 << level
        first = max(2, before // size - (4 if level == 0 else 2))
        blocks = prints[first * size :: size]
        if len(blocks) < 2:
            return
        # The places 2^(k+1)-1 ... 2^k words before one block end where the next block's begin.
        past = prints[(first - 2) * size + 1 :][: len(blocks) * size].reshape(-1, size)
        equal = past == blocks[:, None]
        if level == 0:
            square = equal[:-3] & equal[1:-2] & equal[2:-1] & equal[3:]
        else:
            square = equal[:-1] & equal[1:]
        if not square.any():
            return
        for a, b in self._runs_below(size):
            # Inside a run of a smaller period every larger one is its multiple.
            lo, hi = max(0, -(-a // size) - first), b // size - first
            for block in range(lo, min(hi, len(square), lo + 3)):
                reach = (block + first) * size - a
                square[block, max(0, 2 * size - 1 - reach):] = False
            square[lo + 3 : max(lo + 3, hi)] = False
        rows, columns = np.nonzero(square.T)[::-1]
        done: tuple[int, int] = (0, 0)
        for row, column in zip(rows.tolist(), columns.tolist()):
            period, at = 2 * size - 1 - column, (row + first) * size
            if period == done[0] and at < done[1]:
                continue
            done = (period, self._stretch(period, at, at))

    def _runs_below(self, size: int) -> list[tuple[int, int]]:
        return [
            (a, b) for (a, b), q in self._found.items()
            if q < size and b - a >= max(LEAST_WORDS, LEAST_PERIODS * q)
        ]

    def _stretch(self, period: int, start: int, at: int) -> int:
        """Follow words equal to those a period earlier from `at` both ways; where they end.

        `start` is a place known to belong to the stretch, or `at` itself.
        """
        words, n = self.words, len(self.words)
        end, step = at, 64
        while end < n:
            high = min(n, end + step)
            differ = np.flatnonzero(words[end:high] != words[end - period : high - period])
            if len(differ):
                end += int(differ[0])
                break
            end, step = high, 2 * step
        if end == at and start == at:
            return end
        step = 64
        while start > period:
            low = max(period, start - step)
            differ = np.flatnonzero(words[low:start] != words[low - period : start - period])
            if len(differ):
                start = low + int(differ[-1]) + 1
                break
            start, step = low, 2 * step
        self._open.pop(period, None)
        if self._found.get((start - period, at)) == period:
            # What it was when the slice before ended.
            del self._found[start - period, at]
        if end == n:
            self._open[period] = start
        whole = (start - period, end)
        self._found[whole] = min(period, self._found.get(whole, period))
        return end


def find_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of numbers."""
    catchers = Catchers()
    for at in range(0, len(words), SLICE_WORDS):
        catchers.append(words[at : at + SLICE_WORDS])
    return catchers.runs()


def planted(words: np.ndarray, key: int | None) -> np.ndarray:
    """The words with a repeating end for one key in ten, by the key's checksum."""
    n = len(words)
    if key is None or not n:
        return words
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([words[:a], words[a + np.arange(n - a) % period]])


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """False for words that some run holds behind its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) == 0


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", plant: bool = False) -> DataFrame:
    """Per row: key, n_words, its runs, the one repeated most often, the collapsed text.

    Words are runs of characters other than space and tab to carriage return. `collapsed`
    is the words that are no repetition, joined by one space. `plant` first gives every
    tenth key a repeating end.
    """
    bound_batches(docs.sparkSession)
    schema = SCHEMA.format(key=docs.schema[key].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            rows = _scan_texts(batch.column(1), keys.to_pylist() if plant else None)
            columns = [keys, *(pa.array(c, t) for c, t in zip(zip(*rows), _TYPES))]
            yield pa.RecordBatch.from_arrays(columns, names=_NAMES)

    return docs.select(key, text).mapInArrow(run, schema)


_NAMES = [x.split()[0] for x in SCHEMA.replace("<start:long,length:long,period:long>", "").split(", ")]
_RUN = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])
_TYPES = [pa.int64()] * 6 + [pa.list_(_RUN)] + [pa.string()] * 3


def _scan_texts(texts: pa.Array, keys: list | None) -> list[tuple]:
    cut = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "").cast(pa.large_string())))
    coded = pc.dictionary_encode(cut.flatten())
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    known = np.array(coded.dictionary.to_pylist(), dtype=object)
    bounds = cut.offsets.to_numpy() - cut.offsets[0].as_py()
    return [
        _scan_one(codes[a:b], known, None if keys is None else keys[i])
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
    ]


def _scan_one(words: np.ndarray, known: np.ndarray, key: int | None) -> tuple:
    if len(words) == 1 and known[words[0]] == "":
        words = words[:0]
    words = planted(words, key)
    runs = find_runs(words)
    kept = words[kept_words(len(words), runs)] if runs else words
    collapsed = " ".join(known[kept].tolist())
    listed = "".join(f"{a},{length},{q}\n" for a, length, q in runs)
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    most = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (
        len(words), len(runs), *most,
        [{"start": a, "length": b, "period": q} for a, b, q in runs],
        _sha256(listed), _sha256(collapsed), collapsed,
    )


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
