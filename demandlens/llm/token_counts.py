"""Token counts from a trie of pre-tokens (operator 9).

The distinct pre-tokens of a slice of texts are walked as a trie (sorted, depth first);
the forward score of each prefix is computed once and the number of ids at the end of
each word is kept. A text's count is the sum over its words; no ids are made.

Defined cases: a null text counts 0, as does an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from demandlens.llm.common import WordTable, bound_batches, slices
from demandlens.llm.pieces import REMEMBERED
from demandlens.llm.sentencepiece_codec import _model, _typed


@lru_cache(maxsize=1)
def _counted_words(path: str) -> WordTable:
    """One per Python worker: words and their numbers of ids."""
    model = _model(path)
    return WordTable(
        lambda words: ((word, count[len(word)]) for word, _, count in model.walk(words)), REMEMBERED
    )


def token_count(text: Column, model_path: str) -> Column:
    """The number of ids of a text as long."""
    bound_batches(SparkSession.active())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, known = _model(model_path), _counted_words(model_path)
        for batch in batches:
            texts = batch.to_pylist()
            totals: list[int] = []
            for a, b in slices(texts):
                cut = [model.words(x or "") for x in texts[a:b]]
                known.learn(set().union(*cut))
                totals += [sum(map(known.__getitem__, x)) for x in cut]
            yield pa.array(totals, pa.int64())

    return F.arrow_udf(_typed(run), "long")(text)
