"""Near-duplicate classes by BagMinHash of word shingles (operator 6).

A text is the multiset of its five-word shingles, and two texts are linked at a weighted
Jaccard similarity of 0.8 or more (sum of the lesser counts over sum of the greater).
Classes are the connected components of those links.

Signatures. A shingle's weight axis is split into the levels (0,1], (1,2], (2,4], (4,8] …
Each level of each shingle has its own Poisson process in time: points come at a rate of
the level's width, each at a random weight inside the level and for a random one of the
signature's places. A text of weight w sees the points at weights up to w; each place
keeps its earliest time. Two texts agree in a place with just the probability of their
weighted Jaccard similarity, and a process is followed only until it is later than
all places.

Search. Places are banded (64 bands of 8: a pair at 0.8 is missed with probability 8e-6,
one at 0.85 with 2e-9), texts with equal words are one node, and

1. each node is verified against the least node it shares a band with;
2. in bands whose nodes are then in more than one component, each node is verified against
   the plainest node it meets there: the one with the greatest share of shingles that other
   of these nodes have too, which lies nearest to what the copies were made from. Those
   still outside a band's largest component meet one node of it per band, picked by hash;
3. in bands that are still mixed, the nodes outside the band's largest component are
   compared with all of the band's nodes of other components. A pair can share no more than
   each has in common with any of these nodes, nor what of one falls where a bit map of the
   other is empty (both bounds are exact); and it must agree in enough of one bit per place
   (a pair at 0.8 does not with probability 4e-6). What is left is verified.

So a group of thousands of near copies costs about one verification each. Verification
compares the multisets (32-bit shingle hashes).

Defined cases: words are runs of letters, digits and underscores in lower case; a text of
one to four words is one shingle; texts without words are linked when equal, null being
an empty text; repeated rows are in one class. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandlens.llm.common import bound_batches, mix64, sent_if_few, slices, stored
from demandlens.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 64, 8
PLACES = BANDS * ROWS
#: Bits of the map of a text's shingles; with 2,048 the pair step took six times as long.
MAP_BITS = 1024
SLICE = 300_000
SIGMAS = 4.5
_WORD = re.compile(r"\w+")
_REMEMBERED = 100_000


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > _REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def shingles(self, words: list[str]) -> np.ndarray:
        """Hashes of the shingles, in text order."""
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        size = min(SHINGLE, len(h))
        with np.errstate(over="ignore"):
            out = np.zeros(len(h) - size + 1 if size else 0, np.uint64)
            for j in range(size):
                out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)]
        return mix64(out + np.uint64(size)) if size else out


def signatures(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Earliest times per text and place, for the distinct shingles of some texts.

    The times of a process are summed in one order always, so equal points of two texts
    are equal numbers.
    """
    times = np.full((n_docs, PLACES), np.inf)
    top = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    level = np.concatenate([np.arange(t + 1) for t in top.tolist()]) if top.any() else np.zeros(len(top), np.int64)
    of = np.repeat(np.arange(len(top)), top + 1)
    width = np.where(level > 0, 1 << np.maximum(level - 1, 0), 1)
    below = np.where(level > 0, width, 0)
    key = mix64(element[of] ^ mix64(level.astype(np.uint64)))
    room, doc_of = weight[of] - below, doc[of]
    total = np.bincount(doc_of, width, n_docs)
    # Points to draw at once: the expected number until all places are filled.
    need = width * PLACES * (np.log(PLACES) + 3.0) / np.maximum(total[doc_of], 1)
    batch = (1 << np.ceil(np.log2(np.maximum(need, 1))).astype(np.int64)).astype(np.int64)
    now, drawn = np.zeros(len(of)), np.zeros(len(of), np.int64)
    alive = np.arange(len(of))
    while len(alive):
        for size in np.unique(batch[alive]).tolist():
            some = alive[batch[alive] == size]
            for at in range(0, len(some), max(1, 400_000 // size)):
                part = some[at : at + max(1, 400_000 // size)]
                number = drawn[part][:, None] + np.arange(size)
                with np.errstate(over="ignore"):
                    first = mix64(key[part][:, None] + number.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
                    second = mix64(first ^ np.uint64(0xA0761D6478BD642F))
                wait = -np.log(((first >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
                wait /= (PLACES * width[part])[:, None]
                wait[:, 0] += now[part]
                when = np.cumsum(wait, axis=1)
                now[part], drawn[part] = when[:, -1], drawn[part] + size
                place = (second % np.uint64(PLACES)).astype(np.int64)
                inside = ((second >> np.uint64(40)).astype(np.int64) * width[part][:, None] >> 24) < room[part][:, None]
                flat = doc_of[part][:, None] * PLACES + place
                np.minimum.at(times.reshape(-1), flat[inside], when[inside])
        last = times.max(axis=1)
        alive = alive[now[alive] < last[doc_of[alive]]]
        batch[alive] = np.maximum(1, batch[alive] // 4)
    return times


def band_keys(times: np.ndarray) -> np.ndarray:
    """One 64-bit key per text and band; the last bits of the times are left out."""
    bits = mix64(times.view(np.uint64) >> np.uint64(12)).reshape(len(times), BANDS, ROWS)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bits.shape[:2]).copy()
        for j in range(ROWS):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) ^ bits[:, :, j])
    return key.view(np.int64)


def bit_sketches(times: np.ndarray) -> np.ndarray:
    """One bit per place: equal places agree, others by chance; PLACES / 64 longs per text."""
    bits = (mix64(times.view(np.uint64) >> np.uint64(12)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


def least_agreement(threshold: float) -> int:
    """Bits in which a pair at the threshold agrees, but for one in 300,000."""
    p = (1.0 + threshold) / 2.0
    return int(PLACES * p - SIGMAS * np.sqrt(PLACES * p * (1.0 - p)))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in slices(texts, SLICE):
            words = [_WORD.findall((x or "").lower()) for x in texts[a:b]]
            keys = [
                hashlib.md5((" ".join(w) if w else "\0" + (x or "")).encode()).digest()
                for w, x in zip(words, texts[a:b], strict=True)
            ]
            counted = [np.unique(hashes.shingles(w), return_counts=True) for w in words]
            sizes = np.array([len(x) for x, _ in counted])
            filled = np.flatnonzero(sizes)
            bands: list[np.ndarray | None] = [None] * (b - a)
            sketches: list[np.ndarray | None] = [None] * (b - a)
            if len(filled):
                times = signatures(
                    np.concatenate([counted[i][0] for i in filled]),
                    np.concatenate([counted[i][1] for i in filled]),
                    np.repeat(np.arange(len(filled)), sizes[filled]),
                    len(filled),
                )
                found = zip(filled.tolist(), band_keys(times), bit_sketches(times), strict=True)
                for i, row, bits in found:
                    bands[i], sketches[i] = row, bits
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    pa.array(keys, pa.binary()),
                    pa.array([int(c.sum()) for _, c in counted], pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(sketches, pa.list_(pa.int64())),
                ],
                ["row_no", "text_key", "weight", "bands", "sketch"],
            )


def _multisets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in slices(texts, SLICE):
            out, maps = [], []
            for text in texts[a:b]:
                h = np.sort(hashes.shingles(_WORD.findall((text or "").lower())))
                # The n-th occurrence of a shingle is an element of its own.
                first = np.searchsorted(h, h)
                out.append((mix64(h + mix64(np.arange(len(h)) - first)) >> np.uint64(32)).astype(np.uint32))
                there = np.zeros(MAP_BITS, np.uint8)
                there[out[-1] % MAP_BITS] = 1
                maps.append(np.packbits(there).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    pa.array([x.view(np.int32) for x in out], pa.list_(pa.int32())),
                    pa.array(maps, pa.list_(pa.int64())),
                ],
                ["node", "items", "map"],
            )


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose multisets overlap enough.

    Pairs are narrow: they are sent to the multisets, of which only those move that meet another.
    """
    pairs = sent_if_few(pairs.select("a", "b"), "to-verify")
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x")).join(pairs, "a")
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    right = right.join(pairs.select("b"), "b", "left_semi")
    common = F.size(F.array_intersect("x", "y"))
    linked = common >= threshold * (F.size("x") + F.size("y") - common)
    return left.join(right, "b").where(linked).select("a", "b")


def _members(banded: DataFrame) -> DataFrame:
    """(node, band, least) of the bands with more than one node; all bands move once."""
    of_band = Window.partitionBy("band")
    least, n = F.min("node").over(of_band), F.count("*").over(of_band)
    counted = banded.select("node", "band", least.alias("least"), n.alias("n"))
    return counted.where("n > 1").drop("n")


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", row_no: str | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document: row_no, key, class_id, class_size, is_kept.

    class_id is the least key of the class; the kept row of a class is the one with the
    least key (nulls last, then the first in the input). `row_no` may name a column of
    distinct longs that are the same whenever the input is read; otherwise rows are
    numbered as they lie in the input and written, as another reading may number otherwise.
    """
    bound_batches(docs.sparkSession)
    number = F.col(row_no) if row_no else F.monotonically_increasing_id()
    rows = docs.select(number.alias("row_no"), F.col(key).alias("key"), F.col(text).alias("text"))
    rows = rows if row_no else stored(rows, "numbered")
    signed = stored(
        rows.select("row_no", "text").mapInArrow(
            _signed, "row_no long, text_key binary, weight long, bands array<long>, sketch array<long>"
        ),
        "signatures",
    )
    reps = stored(signed.groupBy("text_key").agg(F.min("row_no").alias("node")), "texts")
    nodes = stored(
        signed.where("bands IS NOT NULL").join(
            reps.select(F.col("node").alias("row_no")), "row_no", "left_semi"
        ).select(F.col("row_no").alias("node"), "weight", "bands", "sketch"),
        "nodes",
    )
    banded = nodes.select("node", F.explode("bands").alias("band"))
    members = stored(_members(banded), "members")

    first = members.where("node <> least").groupBy("node").agg(F.min("least").alias("b"))
    first = first.withColumnRenamed("node", "a")
    wanted = sent_if_few(members.select("node").distinct(), "wanted")
    candidates = rows.select(F.col("row_no").alias("node"), "text").join(wanted, "node", "left_semi")
    sets = stored(candidates.mapInArrow(_multisets, "node long, items array<int>, map array<long>"), "multisets")
    found = components(_verified(first, sets, threshold))
    mixed = stored(_mixed_bands(members.select("node", "band"), found), "mixed-bands")
    if mixed.limit(1).count():
        facts = stored(_facts(mixed, nodes, sets), "facts")
        found = _joined(found, _to_plainest(mixed, facts), sets, threshold)
        mixed = stored(_mixed_bands(mixed.select("node", "band"), found), "mixed-bands")
        found = _joined(found, _to_picked(mixed, facts, threshold), sets, threshold)
        mixed = _mixed_bands(mixed.select("node", "band"), found)
        pairs = stored(_across(mixed, facts, threshold), "pairs")
        found = _joined(found, pairs, sets, threshold)

    # rows -> equal texts -> components
    placed = rows.select("row_no", "key").join(signed.select("row_no", "text_key"), "row_no")
    placed = placed.join(reps, "text_key").join(found, "node", "left")
    placed = placed.select("row_no", "key", F.coalesce("component", "node").alias("component"))
    placed = stored(placed, "placed")
    classes = placed.groupBy("component").agg(
        F.min("key").alias("class_id"),
        F.count("*").alias("class_size"),
        F.min(F.struct(F.col("key").isNull(), "key", "row_no")).getField("row_no").alias("kept"),
    )
    return placed.join(classes, "component").select(
        "row_no", "key", "class_id", "class_size", (F.col("row_no") == F.col("kept")).alias("is_kept")
    )


def _joined(found: DataFrame, pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The components, with those joined that a verified pair links."""
    known = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(_verified(pairs, sets, threshold).unionByName(known))


def _mixed_bands(members: DataFrame, found: DataFrame) -> DataFrame:
    """(node, band, c, base) of the bands whose nodes are in more than one component.

    c is a node's component, base the component with most of the band's nodes.
    """
    place = found.withColumnRenamed("component", "c")
    known = members.join(place, "node", "left").withColumn("c", F.coalesce("c", "node"))
    largest = (
        known.groupBy("band", "c").agg(F.count("*").alias("n"))
        .groupBy("band").agg(F.max(F.struct("n", "c")).getField("c").alias("base"), F.count("*").alias("of"))
        .where("of > 1").drop("of")
    )
    return known.join(largest, "band").select("node", "band", "c", "base")


def _facts(mixed: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Per node of mixed bands: weight, the longs of sketch and map, and common.

    common counts the shingles that another of these nodes has too.
    """
    inside = sets.join(mixed.select("node").distinct(), "node", "left_semi")
    alone = (
        inside.select("node", F.explode("items").alias("item"))
        .groupBy("item").agg(F.min("node").alias("node"), F.count("*").alias("n")).where("n = 1")
        .groupBy("node").agg(F.count("*").alias("alone"))
    )
    longs = [F.col("sketch")[i].alias(f"k{i}") for i in range(PLACES // 64)]
    longs += [F.col("map")[i].alias(f"m{i}") for i in range(MAP_BITS // 64)]
    common = F.col("weight") - F.coalesce("alone", F.lit(0))
    found = inside.select("node", "map").join(nodes.select("node", "weight", "sketch"), "node")
    return found.join(alone, "node", "left").select("node", "weight", common.alias("common"), *longs)


def _to_plainest(mixed: DataFrame, facts: DataFrame) -> DataFrame:
    """(a, b): each node and the plainest node that it shares a mixed band with."""
    plain = facts.select("node", (F.col("common") / F.col("weight")).alias("share"))
    known = mixed.join(plain, "node")
    top = known.groupBy("band").agg(F.max(F.struct("share", "node", "c")).alias("top"))
    met = known.join(top, "band").where(F.col("c") != F.col("top.c"))
    return met.groupBy(F.col("node").alias("a")).agg(F.max("top").getField("node").alias("b"))


def _to_picked(mixed: DataFrame, facts: DataFrame, threshold: float) -> DataFrame:
    """(a, b): nodes outside a band's largest component, and one node of it per band."""
    inside = mixed.where("c = base").groupBy("band").agg(
        F.max(F.struct(F.xxhash64("node", "band").alias("mark"), "node")).getField("node").alias("s_node")
    )
    met = mixed.where("c <> base").join(inside, "band")
    met = met.select("node", "c", "s_node", F.col("base").alias("s_c")).distinct().join(facts, "node")
    other = facts.select(*(F.col(x).alias(f"s_{x}") for x in facts.columns))
    likely = met.join(other, "s_node").where(_may_link(threshold))
    return likely.select(F.col("node").alias("a"), F.col("s_node").alias("b"))


def _may_link(threshold: float):
    """By common shingles, sketch and map; the other row's columns begin with s_."""
    # Two texts are linked when they share at least this many shingles.
    enough = (F.col("weight") + F.col("s_weight")) * (threshold / (1.0 + threshold)) - 1e-6
    count = lambda x, y, n, by: sum(
        F.bit_count(by(F.col(f"{x}{i}"), F.col(f"{y}{i}"))) for i in range(n // 64)
    )
    differ = count("k", "s_k", PLACES, lambda x, y: x.bitwiseXOR(y))
    lacks = lambda x, y: x.bitwiseAND(F.bitwise_not(y))
    return (
        (F.col("c") != F.col("s_c"))
        & (F.col("common") >= enough) & (F.col("s_common") >= enough)
        & (differ <= PLACES - least_agreement(threshold))
        & (F.col("weight") - count("m", "s_m", MAP_BITS, lacks) >= enough)
        & (F.col("s_weight") - count("s_m", "m", MAP_BITS, lacks) >= enough)
    )


def _across(mixed: DataFrame, facts: DataFrame, threshold: float) -> DataFrame:
    """All pairs of a band in different components, one not in the band's largest."""
    mixed = mixed.join(facts, "node")
    strays = mixed.where("c <> base")
    strays = strays.select(*(F.col(x).alias(f"s_{x}") for x in strays.columns))
    once = (F.col("c") == F.col("base")) | (F.col("node") < F.col("s_node"))
    met = mixed.join(strays, (F.col("band") == F.col("s_band")) & once & _may_link(threshold))
    return met.select(F.greatest("node", "s_node").alias("a"), F.least("node", "s_node").alias("b")).distinct()
