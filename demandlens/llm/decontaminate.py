"""Benchmark decontamination: Smith-Waterman behind an exact filter (operator 5).

A document is contaminated by a test item when their best local alignment by words (match
+2, mismatch and gap -1) reaches `threshold` of the item's full score, 0.5 by default, so
edited and partial copies count. Every such document is found: the filter before the
alignment leaves out only what cannot reach the threshold t.

1. Of an alignment of score 2·t·L with an item of L words, at least t·L - 1 steps from one
   match to the next cost at most one: each takes two words at most one word apart, in item
   and text alike (were more steps dearer, they would cost more than the score allows).
   The alignment spans (3 - 2t)·L words of the text at most.
2. So in that span at least t·L - 1 words of the text begin such a word pair of the item. Of
   an item's words up to half that many, those whose pairs most items share, are not counted;
   as many fewer are asked for then, which is exact as well.
3. Texts are searched for the pairs in blocks of test items of bounded size (`block_grams`).
   Where enough lie in a span, the passage around them is aligned, all passages of a slice
   of texts together. One pass, no shuffle: how often a passage or pair occurs does not matter.

Defined cases: words are runs of letters, digits and underscores in lower case; an item of
so few words that one match reaches the threshold (two, by default) is found by any of its
words; items without words match nothing; null texts are empty; repeated rows and items are
reported each; rows without an item id are left out of the benchmark. The same item id with
several texts counts with its best one. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.llm.common import bound_batches, slices

THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of test items that one pass over the texts takes along.
BLOCK_GRAMS = 2_000_000
#: Pair hits, and cells of one row of the alignments, that a task works on at once.
HITS, CELLS = 4_000_000, 1 << 18
#: Between texts, so that no word pair reaches from one to the next.
_APART = [0, 0]
_WORD = re.compile(r"\w+")
_FOUND = "row_no long, key long, item_id long, score long, full_score long"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class SeedIndex:
    """Word pairs of some test items, and how many of them an alignment needs."""

    def __init__(self, items: list[tuple[int, str]], threshold: float):
        self.threshold = threshold
        self.codes: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item, text in items:
            if words := words_of(text):
                code = [self.codes.setdefault(w, len(self.codes) + 1) for w in words]
                self.items.append((item, np.array(code, np.int64)))
        self.base = len(self.codes) + 1
        size = np.array([len(code) for _, code in self.items], np.int64)
        self.span = np.floor((3 - 2 * threshold) * size + 1e-9).astype(np.int64)
        need = np.ceil(threshold * size - 1e-9).astype(np.int64) - 1
        self.by_word = bool((need < 1).any())
        starts = [self._starts(code.tolist(), n) for (_, code), n in zip(self.items, need, strict=True)]
        shared = Counter(k for each in starts for k in {k for keys in each for k in keys})
        keys, entries = [], []
        for entry, each in enumerate(starts):
            # The words whose pairs are the least shared come first.
            each.sort(key=lambda keys: max(shared[k] for k in keys))
            spared = max(0, int(need[entry]) // 2)
            held = {k for keys in each[: len(each) - spared] for k in keys}
            keys += held
            entries += [entry] * len(held)
            need[entry] = max(1, need[entry] - spared)
        self.need = need
        order = np.lexsort((np.array(entries, np.int64), np.array(keys, np.int64)))
        self.entries = np.array(entries, np.int64)[order]
        self.keys, first = np.unique(np.array(keys, np.int64)[order], return_index=True)
        self.bounds = np.append(first, len(entries))

    def _starts(self, code: list[int], need: int) -> list[list[int]]:
        """Per word of an item the keys of the pairs it begins; of the word if one match is enough."""
        if need < 1:
            return [[a * self.base] for a in code]
        pairs = [[a * self.base + b for b in code[i + 1 : i + 3]] for i, a in enumerate(code)]
        return pairs[:-1]

    def encoded(self, words: list[str]) -> list[int]:
        get = self.codes.get
        return [get(w, 0) for w in words]

    def passages(self, code: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, from, to) of all passages of joined texts that need an alignment."""
        if not len(self.keys):
            return
        places, numbers = [], []
        for away in (1, 2, None):
            if away is None and not self.by_word:
                continue
            a = code if away is None else code[:-away]
            b = np.zeros_like(code) if away is None else code[away:]
            at = np.flatnonzero((a > 0) & (b > 0) if away else a > 0)
            key = a[at] * self.base + b[at]
            number = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[number] == key
            places.append(at[known])
            numbers.append(number[known])
        place, number = np.concatenate(places), np.concatenate(numbers)
        order = np.argsort(place, kind="stable")
        place, number = place[order], number[order]
        count = self.bounds[number + 1] - self.bounds[number]
        # Whole texts are taken together until they have HITS hits.
        before = np.concatenate([[0], np.cumsum(count)])
        text_from = np.searchsorted(place, starts)
        a = 0
        while a < len(starts):
            most = before[text_from[a]] + HITS
            ends = before[np.append(text_from[a + 1 :], len(place))]
            b = a + max(1, int(np.searchsorted(ends, most, "right")))
            low, high = text_from[a], text_from[b] if b < len(starts) else len(place)
            yield from self._spans(place[low:high], number[low:high], count[low:high], code, starts)
            a = b

    def _spans(self, place, number, count, code, starts) -> Iterator[tuple[int, int, int, int]]:
        total = int(count.sum())
        if not total:
            return
        inner = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        entry = self.entries[np.repeat(self.bounds[number], count) + inner]
        hit = np.unique(entry * len(code) + np.repeat(place, count))
        entry, at = np.divmod(hit, len(code))
        text = np.searchsorted(starts, at, "right") - 1
        last = np.arange(len(hit)) + self.need[entry] - 1
        fits = np.minimum(last, len(hit) - 1)
        span = self.span[entry]
        enough = (
            (last < len(hit)) & (entry[fits] == entry) & (text[fits] == text) & (at[fits] - at < span)
        )
        entry, at, text, span = entry[enough], at[enough], text[enough], span[enough]
        if not len(at):
            return
        ends = np.append(starts[1:] - len(_APART), len(code) - len(_APART))
        low, high = np.maximum(at - span, starts[text]), np.minimum(at + span + 2, ends[text])
        # Passages of one text and item that touch become one.
        cut = (entry[1:] != entry[:-1]) | (text[1:] != text[:-1]) | (low[1:] > high[:-1])
        first = np.concatenate([[0], np.flatnonzero(cut) + 1])
        final = np.append(first[1:] - 1, len(at) - 1)
        yield from zip(
            text[first].tolist(), entry[first].tolist(), low[first].tolist(), high[final].tolist(),
            strict=True,
        )

    def found(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item id, score, full score) of the texts' contaminations."""
        joined: list[int] = []
        starts = []
        for text in texts:
            starts.append(len(joined))
            joined += self.encoded(words_of(text))
            joined += _APART
        code = np.array(joined, np.int64)
        pairs: dict[tuple[int, bytes], list[int]] = {}
        for text, entry, low, high in self.passages(code, np.array(starts, np.int64)):
            pairs.setdefault((entry, code[low:high].tobytes()), []).append(text)
        scores = align_all(
            [self.items[entry][1] for entry, _ in pairs],
            [np.frombuffer(passage, np.int64) for _, passage in pairs],
        )
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for ((entry, _), rows), score in zip(pairs.items(), scores, strict=True):
            item, full = self.items[entry][0], MATCH * len(self.items[entry][1])
            if score >= self.threshold * full:
                for text in rows:
                    got = (score / full, score, full)
                    best[text, item] = max(got, best.get((text, item), got))
        for (text, item), (_, score, full) in best.items():
            yield text, item, score, full


def align_all(items: list[np.ndarray], passages: list[np.ndarray]) -> list[int]:
    """The best local alignment score of each item and passage (Smith-Waterman, linear gaps).

    Both are numbers of words; an item has none below one.
    """
    out = [0] * len(items)
    order = sorted(range(len(items)), key=lambda i: len(passages[i]))
    while order:
        # From the longest passage on, as many as fit.
        width = len(passages[order[-1]])
        chunk = order[-max(1, CELLS // (width + 1)) :]
        del order[-len(chunk) :]
        a = np.full((len(chunk), max(len(items[i]) for i in chunk)), -1, np.int32)
        b = np.zeros((len(chunk), width), np.int32)
        for n, i in enumerate(chunk):
            a[n, : len(items[i])], b[n, : len(passages[i])] = items[i], passages[i]
        # Gaps in a row: the best of all cells to the left, less their distance.
        slope = np.arange(width + 1, dtype=np.int32) * -GAP
        row, new = np.zeros((2, len(chunk), width + 1), np.int32)
        best = np.zeros(len(chunk), np.int32)
        for k in range(a.shape[1]):
            step = np.where(b == a[:, k : k + 1], np.int32(MATCH), np.int32(MISMATCH))
            new[:, 0] = 0
            np.maximum(row[:, :-1] + step, row[:, 1:] + np.int32(GAP), out=new[:, 1:])
            np.maximum(new, 0, out=new)
            new += slope
            np.maximum.accumulate(new, axis=1, out=new)
            new -= slope
            np.maximum(best, new.max(axis=1), out=best)
            row, new = new, row
        for i, score in zip(chunk, best.tolist(), strict=True):
            out[i] = score
    return out


def align(item: list[str], passage: list[str]) -> int:
    """The best local alignment score of two word lists."""
    codes: dict[str, int] = {}
    a = np.array([codes.setdefault(w, len(codes) + 1) for w in item], np.int64)
    return align_all([a], [np.array([codes.get(w, 0) for w in passage], np.int64)])[0]


def _found(index: SeedIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = batch.column(2).to_pylist()
            for a, b in slices(texts):
                out = [
                    (rows[a + i], keys[a + i], item, score, full)
                    for i, item, score, full in index.found(texts[a:b])
                ]
                columns = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns],
                    ["row_no", "key", "item_id", "score", "full_score"],
                )

    return run


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", key: str = "doc_id",
    row_no: str | None = None, item_id: str = "item_id", item_text: str = "text",
    threshold: float = THRESHOLD, block_grams: int = BLOCK_GRAMS,
) -> DataFrame:
    """row_no, key, item_id, score, full_score of each contaminated document and item."""
    bound_batches(docs.sparkSession)
    number = F.col(row_no) if row_no else F.monotonically_increasing_id()
    rows = docs.select(number.alias("row_no"), F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    items = benchmark.select(
        F.col(item_id).cast("long").alias("item_id"),
        F.coalesce(F.col(item_text), F.lit("")).alias("item"),
    ).where("item_id IS NOT NULL").distinct()
    words = F.size(F.regexp_extract_all("item", F.lit(r"\w+"), F.lit(0)))
    total = items.agg(F.sum(words).alias("n")).first().n or 0
    blocks = max(1, -(-total // block_grams))
    found = None
    for block in range(blocks):
        # All texts of an item id are in one block.
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        held = [(r.item_id, r.item) for r in part.toLocalIterator()]
        pairs = rows.mapInArrow(_found(SeedIndex(sorted(held), threshold)), _FOUND)
        found = pairs if found is None else found.unionByName(pairs)
    return found
