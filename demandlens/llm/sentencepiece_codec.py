"""SentencePiece encoding and decoding by shared-prefix segmentation (operator 4).

`encode` and `decode` are column functions. Every task cuts its texts into words with
marked spaces, walks the distinct new ones in sorted order as a trie (pieces.py), and
joins the ids of each text from the words' ids. There is no shuffle, and memory is
bounded by one slice of text and a table of words of so many bytes. Model and table
end with their task, so what one stage remembers is not held under the next.

Defined cases: null in, null out; an empty text has no ids; runs of spaces are words of
their own; "▁" in a text counts as a space, as for the model itself. Decoding leaves out
control ids, drops the space that encoding puts in front, shows broken byte sequences as
U+FFFD, and fails on ids that the model does not have.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from demandlens.llm.common import TaskWords, bound_batches, slices
from demandlens.llm.pieces import SPACE, PieceModel, Pieces

__all__ = ["decode", "encode"]

#: Bytes of words and their ids that a task remembers.
WORD_BYTES = 48 << 20


@lru_cache(maxsize=2)
def _model(path: str) -> PieceModel:
    """For token counts, which keep it as long as the Python worker."""
    return PieceModel(path)


def _encoded_words(model: PieceModel) -> TaskWords:
    """Words and their ids as bytes."""
    return TaskWords(
        lambda words: ((w, array("i", x).tobytes()) for w, x in model.encode_words(words)),
        WORD_BYTES,
    )


def encode(text: Column, model_path: str) -> Column:
    """The ids of a text as array<int>."""
    bound_batches(SparkSession.active())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = PieceModel(model_path)
        known = _encoded_words(model)
        for batch in batches:
            texts = batch.to_pylist()
            made = []
            for a, b in slices(texts):
                cut = [model.words(x or "") for x in texts[a:b]]
                known.learn(set().union(*cut))
                made += [b"".join(map(known.__getitem__, x)) for x in cut]
            ends = np.cumsum([0, *(len(x) // 4 for x in made)]).astype(np.int32)
            ids = pa.array(np.frombuffer(b"".join(made), np.int32))
            lists = pa.ListArray.from_arrays(pa.array(ends), ids, mask=batch.is_null())
            yield lists

    return F.arrow_udf(_typed(run), "array<int>")(text)


def decode(ids: Column, model_path: str) -> Column:
    """The text of an array of ids."""
    bound_batches(SparkSession.active())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Pieces(model_path)
        raw = pa.array(_piece_bytes(model), pa.binary())
        for batch in batches:
            lists = batch.cast(pa.list_(pa.int32()))
            start = lists.offsets.to_numpy()
            values = lists.values
            if values.null_count:
                raise ValueError("ids hold a null")
            flat = raw.take(values)
            if len(values) and flat.null_count:
                raise ValueError("ids beyond the model's pieces")
            at = np.frombuffer(flat.buffers()[1], np.int32, len(values) + 1)
            data = flat.buffers()[2]
            whole = memoryview(data) if data is not None else memoryview(b"")
            texts = []
            for a, b, ok in zip(at[start[:-1]], at[start[1:]], lists.is_valid().to_pylist(), strict=True):
                text = str(whole[a:b], "utf-8", "replace")
                if model.prefix_space and text[:1] == " ":
                    text = text[1:]
                texts.append(text if ok else None)
            yield pa.array(texts, pa.string())

    return F.arrow_udf(_typed(run), "string")(ids)


def _piece_bytes(model: Pieces) -> list[bytes]:
    shown = {i: x.replace(SPACE, " ").encode() for x, i in model.ids.items()}
    shown |= {i: bytes([b]) for b, i in model.byte_ids.items()}
    shown[model.unknown] = " ⁇ ".encode()
    return [shown.get(i, b"") for i in range(len(model.pieces))]


def _typed(run):
    """Spark reads the kind of an Arrow function from its annotations."""
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return run
