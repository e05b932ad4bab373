"""Token-id files with a minimal perfect hash index (operator 1).

Layout below one folder:

* ``payload/shard-NNNNN.ids`` — the raw ids of consecutive documents in ascending
  key order, little-endian, two bytes each where the vocabulary allows it and four
  otherwise; then the byte offset of each document (and of the end) as uint64; then
  a trailer of four uint64: magic, id width, documents, payload bytes.
* ``index/bucket-NNNNN.mph`` — for the keys that hash to this bucket, the levels of a
  minimal perfect hash function and, per slot, a fingerprint, the shard, the number of
  the key's first document in it and how many documents bear the key.
* ``entries`` — one Parquet row per document and ``directory`` — one per shard.

A key is looked up by one hash to its bucket, a few bit probes to its slot, and one
read of two offsets: constant time. A key that is not in the store fails its
fingerprint (up to one in 2**32).

Defined cases: a null text is an empty one (the end id alone); documents with a null
key come first, in no index, and are read through the directory; repeated keys lie
side by side in the order of the input files and share one slot; an empty table makes
no shard and reads back as no row. Other columns of the input are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.llm.common import bound_batches, mix64, shuffle_partitions, sized_slices

MAGIC = 0x31534449
TRAILER = 32
#: Bytes of pieces and their ids that a worker remembers; what one slice of texts adds comes on top.
REMEMBERED_BYTES = 192 << 20
#: Characters of text that are encoded at once.
ENCODED_CHARS = 4_000_000
#: Pieces that the tokenizer gets as one text.
JOINED = 512
#: Payload bytes read at once.
READ_BYTES = 8 << 20
GAMMA = 2.0

_ENTRY = "doc_key long, shard int, doc_no long, n_tokens long"
_RUN = "doc_key long, shard int, doc_no long, n_docs long"
_READ = "doc_key long, start long, n_tokens long, ids_crc32 long"


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _publish(path: str, chunks: Iterator[bytes] | list[bytes]) -> None:
    """Write beside the name, then move: a repeated task replaces whole files only."""
    files, place = _filesystem(path)
    files.create_dir(os.path.dirname(place), recursive=True)
    aside = f"{place}.{TaskContext.get().taskAttemptId()}.part"
    with files.open_output_stream(aside) as out:
        for chunk in chunks:
            out.write(chunk)
    files.move(aside, place)


# -- encoding -----------------------------------------------------------------


def _divides(token) -> bool:
    """Whether a token always cuts text before all else and takes nothing of its neighbours."""
    strips = token.lstrip or token.rstrip or token.single_word
    return token.special and not token.normalized and not strips and " " not in token.content


class Encoder:
    """Ids of whole texts, through the pieces between single spaces.

    The tokenizer cuts text before a space that stands between two other characters
    and never looks across, so each distinct piece (with its space) is encoded once.
    Texts with other runs of white space at a space are encoded whole. Words stay in
    Arrow: a slice of texts is cut, its pieces are numbered, and the ids of all of them
    are gathered at once; Python sees only the distinct pieces of the slice.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if max(self.tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.end_id = end_id
        special = self.tokenizer.get_added_tokens_decoder().items()
        self.mark = next(((i, x.content) for i, x in special if _divides(x)), None)
        self._forget()

    def _forget(self) -> None:
        """Only the end id is known: piece 0."""
        # The first piece of a text has no space before it.
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}
        self.start, self.size = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.ids = np.array([self.end_id], self.dtype)
        self.held_bytes = 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and how many each has.

        The tokenizer cuts at a special token before all else, so pieces with one between
        them are encoded as if alone, at less cost. Pieces that hold it are encoded alone.
        """
        if self.mark:
            number, text = self.mark
            joined = [text.join(pieces[i : i + JOINED]) for i in range(0, len(pieces), JOINED)]
            flat = np.fromiter(
                chain.from_iterable(chain(x, (number,)) for x in self._encode(joined)), self.dtype
            )
            is_mark = flat == number
            size = np.diff(np.flatnonzero(is_mark), prepend=-1) - 1
            if len(size) == len(pieces):
                return flat[~is_mark], size
        found = self._encode(pieces)
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), self.dtype, int(size.sum())), size

    def _learn(self, known: dict[str, int], before: str, new: list[str]) -> None:
        flat, size = self._encode_pieces([before + x for x in new])
        known.update(zip(new, range(len(self.size), len(self.size) + len(new)), strict=True))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, flat])
        self.held_bytes += sum(map(len, new)) + 160 * len(new) + flat.nbytes

    def _numbers(self, known: dict[str, int], before: str, pieces: pa.Array) -> np.ndarray:
        """The number of every piece; new ones are worked out together."""
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        number = np.array(list(map(known.get, distinct, repeat(-1))), np.int64)
        is_new = number < 0
        if is_new.any():
            number[is_new] = np.arange(is_new.sum()) + len(self.size)
            self._learn(known, before, distinct[is_new].tolist())
        return number[coded.indices.to_numpy()]

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that are cut at their spaces, one after the other, and the ends of each."""
        if self.held_bytes >= REMEMBERED_BYTES:
            self._forget()
        lists = pc.split_pattern(texts, " ")
        edge = lists.offsets.to_numpy().astype(np.int64)
        pieces = lists.flatten()
        edge = edge - edge[0]
        leads = np.zeros(len(pieces), bool)
        leads[edge[:-1]] = True
        # One more place behind every text is piece 0, the end id.
        at = np.arange(len(pieces)) + np.repeat(np.arange(len(texts)), np.diff(edge))
        order = np.zeros(len(pieces) + len(texts), np.int64)
        order[at[leads]] = self._numbers(self.first, "", pieces.filter(pa.array(leads)))
        order[at[~leads]] = self._numbers(self.later, " ", pieces.filter(pa.array(~leads)))
        size = self.size[order]
        ends = np.cumsum(size)
        source = np.repeat(self.start[order] - ends + size, size)
        source += np.arange(len(source))
        return self.ids[source], ends[edge[1:] + np.arange(len(texts))]

    def encode(self, texts: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """The ids of all texts in order, as pieces of one byte string, and each text's number of ids.

        Texts are not null.
        """
        is_whole = pc.match_substring_regex(texts, NOT_CUT).to_numpy(zero_copy_only=False)
        sizes = np.empty(len(texts), np.int64)
        out: list[bytes] = [b""] * len(texts)
        whole = np.flatnonzero(is_whole)
        found = self._encode(texts.take(pa.array(whole)).to_pylist())
        for i, ids in zip(whole.tolist(), found, strict=True):
            out[i], sizes[i] = np.array([*ids, self.end_id], self.dtype).tobytes(), len(ids) + 1
        cut = np.flatnonzero(~is_whole)
        if len(cut):
            ids, ends = self._cut(texts.take(pa.array(cut)))
            sizes[cut] = np.diff(ends, prepend=0)
            if not len(whole):
                return [ids.tobytes()], sizes
            begin = 0
            for i, end in zip(cut.tolist(), ends.tolist(), strict=True):
                out[i], begin = ids[begin:end].tobytes(), end
        return out, sizes


#: Spaces at an end or in runs, and white space other than the plain space and the line feed.
NOT_CUT = (
    r"\A[ \n]|[ \n]\z|  | \n|\n "
    r"|[\t\r\v\f\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


@lru_cache(maxsize=1)
def _encoder(tokenizer: str, end_id: int) -> Encoder:
    """One per Python worker, whatever the number of its tasks."""
    return Encoder(tokenizer, end_id)


def _write_shards(path: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = _encoder(tokenizer, end_id), TaskContext.get().partitionId()
        lengths: list[np.ndarray] = []
        made: list[pa.RecordBatch] = []

        def chunks() -> Iterator[bytes]:
            done = 0
            for batch in batches:
                keys, texts = batch.column(0), pc.fill_null(batch.column(1), "")
                chars = pc.utf8_length(texts).to_numpy()
                for a, b in sized_slices(chars, ENCODED_CHARS):
                    ids, size = encoder.encode(texts.slice(a, b - a))
                    lengths.append(size * encoder.width)
                    number = np.arange(done, done + b - a)
                    done += b - a
                    made.append(
                        pa.RecordBatch.from_arrays(
                            [
                                keys.slice(a, b - a),
                                pa.array(np.full(b - a, shard, np.int32)),
                                pa.array(number),
                                pa.array(size),
                            ],
                            ["doc_key", "shard", "doc_no", "n_tokens"],
                        )
                    )
                    yield from ids
            ends = np.concatenate([np.zeros(1, np.int64), *lengths]).cumsum().astype("<u8")
            yield ends.tobytes()
            yield np.array([MAGIC, encoder.width, done, ends[-1]], "<u8").tobytes()

        first = next(batches, None)
        if first is not None:
            rest = batches

            def all_batches(head=first, tail=rest):
                yield head
                yield from tail

            batches = all_batches()
            _publish(f"{path}/payload/shard-{shard:05d}.ids", chunks())
        yield from made

    return run


# -- minimal perfect hash ------------------------------------------------------


def build_mph(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels of bits and each key's slot, for distinct 64-bit keys.

    A key alone at its place of a level stays there; the others try the next level
    under another hash. The slot is the number of set bits before the place.
    """
    levels, slot, left, seen = [], np.empty(len(keys), np.int64), np.arange(len(keys)), 0
    while len(left):
        size = max(64, int(GAMMA * len(left)))
        place = _place(keys[left], len(levels), size)
        alone = np.bincount(place, minlength=size) == 1
        kept = alone[place]
        slot[left[kept]] = seen + np.cumsum(alone)[place[kept]] - 1
        levels.append(alone)
        seen += int(alone.sum())
        left = left[~kept]
        if len(levels) > 200:
            raise ValueError("keys of a minimal perfect hash must be distinct")
    return levels, slot


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(keys ^ mix64(np.array([level + 1]))) % np.uint64(size)).astype(np.int64)


def probe_mph(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Each key's slot, or -1 where no level has it."""
    slot, left, seen = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, bits in enumerate(levels):
        place = _place(keys[left], level, len(bits))
        hit = bits[place]
        slot[left[hit]] = seen + np.cumsum(bits)[place[hit]] - 1
        seen += int(bits.sum())
        left = left[~hit]
    return slot


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix64(~keys.astype(np.uint64)) >> np.uint64(32)).astype("<u4")


def _index_bytes(runs: pd.DataFrame) -> list[bytes]:
    keys = runs["doc_key"].to_numpy(np.int64).view(np.uint64)
    levels, slot = build_mph(keys)
    put = np.empty(len(keys), np.int64)
    put[slot] = np.arange(len(keys))
    return [
        np.array([MAGIC, len(keys), len(levels), *map(len, levels)], "<u8").tobytes(),
        *(np.packbits(x).tobytes() for x in levels),
        _fingerprint(keys)[put].tobytes(),
        *(runs[c].to_numpy("<i8")[put].tobytes() for c in ("shard", "doc_no", "n_docs")),
    ]


def _read_index(path: str) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    files, place = _filesystem(path)
    with files.open_input_file(place) as f:
        _, n, depth = np.frombuffer(f.read(24), "<u8").tolist()
        sizes = np.frombuffer(f.read(8 * depth), "<u8").tolist()
        levels = [
            np.unpackbits(np.frombuffer(f.read(-(-s // 8)), np.uint8), count=s).astype(bool)
            for s in sizes
        ]
        prints = np.frombuffer(f.read(4 * n), "<u4")
        values = np.frombuffer(f.read(24 * n), "<i8").reshape(3, n)
    return levels, prints, values


# -- writing and reading --------------------------------------------------------


class TokenStore:
    """Ids of documents in shards, and keyed access to them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(
        self, docs: DataFrame, tokenizer: str, end_id: int, key="doc_id", text="text",
        shards: int | None = None, buckets: int | None = None,
    ) -> TokenStore:
        """Encode every text and write shards, directory and index.

        One range shuffle orders the texts; equal keys are told apart by their place in
        the input, so a key that many rows share still spreads over shards. The index
        shuffles one narrow row per key and shard.
        """
        bound_batches(self.spark)
        n = shards or shuffle_partitions(self.spark)
        rows = docs.select(F.col(key).cast("long").alias("doc_key"), F.col(text).alias("text"))
        rows = rows.withColumn("tie", F.monotonically_increasing_id())
        ordered = rows.repartitionByRange(n, "doc_key", "tie").sortWithinPartitions("doc_key", "tie")
        entries = ordered.select("doc_key", "text").mapInArrow(
            _write_shards(self.path, tokenizer, end_id), _ENTRY
        )
        entries.write.parquet(f"{self.path}/entries")
        entries = self._entries()
        entries.groupBy("shard").agg(
            F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"),
            F.count(F.when(F.col("doc_key").isNull(), 1)).alias("n_null"),
        ).write.parquet(f"{self.path}/directory")

        path, m = self.path, buckets or n

        def build(runs: pd.DataFrame) -> pd.DataFrame:
            bucket = int(runs["bucket"].iloc[0])
            _publish(f"{path}/index/bucket-{bucket:05d}.mph", _index_bytes(runs))
            return pd.DataFrame({"bucket": [bucket], "n_keys": [len(runs)]})

        runs = (
            entries.where("doc_key IS NOT NULL")
            .groupBy("doc_key")
            .agg(F.min(F.struct("shard", "doc_no")).alias("at"), F.count("*").alias("n_docs"))
            .select(
                "doc_key", "at.shard", "at.doc_no", "n_docs",
                F.pmod(F.xxhash64("doc_key"), F.lit(m)).alias("bucket"),
            )
        )
        built = runs.groupBy("bucket").applyInPandas(build, "bucket long, n_keys long")
        built.withColumn("buckets", F.lit(m)).write.parquet(f"{self.path}/index_summary")
        return self

    def _entries(self) -> DataFrame:
        return self.spark.read.schema(_ENTRY).parquet(f"{self.path}/entries")

    def _directory(self) -> pd.DataFrame:
        """One row per shard (as many as the writer was told), with the ids before it."""
        kind = "shard int, n_docs long, n_tokens long, n_null long"
        rows = self.spark.read.schema(kind).parquet(f"{self.path}/directory").toPandas()
        rows = rows.sort_values("shard", ignore_index=True)
        rows["base"] = rows["n_tokens"].cumsum() - rows["n_tokens"]
        return rows

    def locate(self, keys: DataFrame, key="doc_id") -> DataFrame:
        """Runs (shard, doc_no, n_docs) of each distinct key that the store has."""
        kind = "bucket long, n_keys long, buckets int"
        summary = self.spark.read.schema(kind).parquet(f"{self.path}/index_summary")
        made = summary.select("buckets").first()
        m = made.buckets if made else 1
        path = self.path

        def probe(group: pd.DataFrame) -> pd.DataFrame:
            levels, prints, values = _read_index(
                f"{path}/index/bucket-{int(group['bucket'].iloc[0]):05d}.mph"
            )
            wanted = group["doc_key"].to_numpy(np.int64).view(np.uint64)
            slot = probe_mph(levels, wanted)
            hit = (slot >= 0) & (prints[np.maximum(slot, 0)] == _fingerprint(wanted))
            shard, doc_no, n_docs = values[:, slot[hit]]
            return pd.DataFrame(
                {"doc_key": group["doc_key"][hit], "shard": shard, "doc_no": doc_no, "n_docs": n_docs}
            )

        wanted = keys.select(F.col(key).cast("long").alias("doc_key")).where("doc_key IS NOT NULL")
        wanted = wanted.distinct().withColumn("bucket", F.pmod(F.xxhash64("doc_key"), F.lit(m)))
        wanted = wanted.join(summary.select("bucket"), "bucket", "left_semi")
        return wanted.groupBy("bucket").applyInPandas(probe, _RUN)

    def null_runs(self) -> DataFrame:
        """Runs of the documents without a key, from the directory."""
        rows = self._directory()
        rows = rows[rows["n_null"] > 0]
        runs = [(None, int(r.shard), 0, int(r.n_null)) for r in rows.itertuples()]
        return self.spark.createDataFrame(runs, _RUN)

    def read(self, runs: DataFrame) -> DataFrame:
        """For each document of the runs: doc_key, start, n_tokens, ids_crc32."""
        shards = self._directory()
        path = self.path
        n_docs = dict(zip(shards["shard"].tolist(), shards["n_docs"].tolist(), strict=True))
        base = dict(zip(shards["shard"].tolist(), shards["base"].tolist(), strict=True))
        order = sorted(n_docs)

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A run that goes on in the next shard becomes one run in each."""
            for batch in batches:
                out: list[tuple] = []
                for key, shard, first, left in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    while left > n_docs[shard] - first:
                        out.append((key, shard, first, n_docs[shard] - first))
                        left -= n_docs[shard] - first
                        shard, first = order[order.index(shard) + 1], 0
                    out.append((key, shard, first, left))
                columns = list(zip(*out, strict=True)) or [()] * 4
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], batch.schema.names
                )

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name, reader = None, None
            for batch in batches:
                shard_of = batch.column(1).to_numpy()
                edges = np.flatnonzero(np.diff(shard_of, prepend=-1, append=-1))
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    if name != shard_of[a]:
                        if reader:
                            reader.close()
                        name = int(shard_of[a])
                        reader = ShardReader(f"{path}/payload/shard-{name:05d}.ids")
                    yield from reader.documents(batch.slice(a, b - a), base[name])

        parts = runs.mapInArrow(split, _RUN)
        dealt = parts.repartition(max(1, len(order)), "shard").sortWithinPartitions("shard", "doc_no")
        return dealt.mapInArrow(fetch, _READ)


class ShardReader:
    """Ids of documents by their number in one shard, in reads of bounded size."""

    def __init__(self, path: str):
        files, place = _filesystem(path)
        self.file = files.open_input_file(place)
        size = self.file.size()
        self.file.seek(size - TRAILER)
        magic, self.width, self.n_docs, self.payload = np.frombuffer(
            self.file.read(TRAILER), "<u8"
        ).tolist()
        if magic != MAGIC:
            raise ValueError(f"{path} is not a shard of token ids")

    def close(self) -> None:
        self.file.close()

    def offsets(self, first: int, count: int) -> np.ndarray:
        self.file.seek(self.payload + 8 * first)
        return np.frombuffer(self.file.read(8 * (count + 1)), "<u8").astype(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        self.file.seek(start)
        return np.frombuffer(self.file.read(end - start), f"<u{self.width}").astype("<u4")

    def _crc(self, start: int, end: int) -> int:
        crc = 0
        for at in range(start, end, READ_BYTES):
            crc = zlib.crc32(self.ids(at, min(end, at + READ_BYTES)).tobytes(), crc)
        return crc

    def documents(self, runs: pa.RecordBatch, base: int) -> Iterator[pa.RecordBatch]:
        """The documents of runs in ascending order; neighbours are read together."""
        first, count = runs.column(2).to_numpy(), runs.column(3).to_numpy()
        run = np.repeat(np.arange(len(count)), count)
        numbers = first[run] + np.arange(len(run)) - (np.cumsum(count) - count)[run]
        for at in range(0, len(numbers), 4096):
            some = numbers[at : at + 4096]
            span = self.offsets(int(some[0]), int(some[-1] - some[0] + 1))
            start, end = span[some - some[0]], span[some - some[0] + 1]
            crcs, held, scale = [], (0, 0, b""), 4 // self.width
            for a, b in zip(start.tolist(), end.tolist(), strict=True):
                if b - a > READ_BYTES:
                    crcs.append(self._crc(a, b))
                    continue
                if not held[0] <= a <= b <= held[1]:
                    stop = max(b, min(int(end[-1]), a + READ_BYTES))
                    held = (a, stop, self.ids(a, stop).tobytes())
                crcs.append(zlib.crc32(held[2][(a - held[0]) * scale : (b - held[0]) * scale]))
            yield pa.RecordBatch.from_arrays(
                [
                    runs.column(0).take(pa.array(run[at : at + 4096])),
                    pa.array(base + start // self.width),
                    pa.array((end - start) // self.width),
                    pa.array(crcs, pa.int64()),
                ],
                ["doc_key", "start", "n_tokens", "ids_crc32"],
            )
