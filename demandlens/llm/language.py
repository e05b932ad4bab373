"""Language identification by error-correcting output codes (operator 8).

Each language has a codeword; one binary classifier per bit tells the languages with a
one from those with a zero by character n-grams (one to three letters, hashed to
`FEATURES`). A classifier is a table of log-odds per n-gram, so training is one count of
n-grams per language, which Spark sums over all training texts; only that table (languages
by features) reaches the driver.

Decoding is loss-weighted: a codeword's distance is the sum over bits of the logistic
loss of the margin, weighted by how well the bit tells that language on the training
counts. The nearest codeword wins; where the second is nearly as near, the result is
marked as ambiguous.

Defined cases: a text that is null or has no letter is `und` with score 0, as is any text
when nothing was learned; with one language learned every other text is of it; training
leaves out rows without text or language; repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.llm.common import bound_batches, slices
from demandlens.llm.sentencepiece_codec import _typed

FEATURES = 1 << 14
UNDETERMINED = "und"
#: Up to so many languages every split of them has a bit; beyond, bits are drawn.
EXHAUSTIVE = 6
#: The best language must be so many times as probable as the next.
CLEAR = 3.0
#: n-grams beyond which a longer text does not make a decision surer.
FULL_EVIDENCE = 300
_SPACE = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def features(text: str) -> np.ndarray:
    """Hashed n-grams of the letters of a text, other characters being one space."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[raw]
    if not letter.any():
        return np.zeros(0, np.int64)
    kept = letter | np.concatenate([[True], letter[:-1]])
    c = np.concatenate([[_SPACE], np.where(letter, raw, _SPACE)[kept], [_SPACE]]).astype(np.uint32)
    with np.errstate(over="ignore"):
        two = c[:-1] * np.uint32(0x85EBCA6B) + c[1:] * np.uint32(0xC2B2AE35)
        three = two[:-1] * np.uint32(0x27D4EB2F) + c[2:] * np.uint32(0x165667B1)
        one = c[c != _SPACE] * np.uint32(0x9E3779B1)
    mixed = np.concatenate([one, two, three])
    return ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(18)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of this task: one row per language."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = counts.setdefault(lang, np.zeros(FEATURES, np.int64))
            own += np.bincount(features(text), minlength=FEATURES)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.list_(pa.int64()))],
        ["lang", "counts"],
    )


def codewords(n: int) -> np.ndarray:
    """n rows of ±1, all splits of few languages or the best of some random codes."""
    if n <= EXHAUSTIVE:
        bits = 2 ** (n - 1) - 1
        columns = [[1] + [1 if b >> i & 1 else -1 for i in range(n - 1)] for b in range(bits)]
        return np.array(columns, np.int64).reshape(bits, n).T
    rng, bits = np.random.default_rng(8), 4 * int(np.ceil(np.log2(n))) + 7
    best, apart = None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], (n, bits))
        overlap = code @ code.T - 2 * bits * np.eye(n, dtype=int)
        distance = int((bits - overlap.max()) // 2)
        if distance > apart and (np.abs(code.sum(0)) < n).all():
            best, apart = code, distance
    return best


class Identifier:
    """Codewords, weights of n-grams per bit and weights of bits per language."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        n = len(self.languages)
        self.code = codewords(n) if n else np.zeros((0, 0), np.int64)
        bits = self.code.shape[1]
        if not bits:
            self.weights, self.trust = np.zeros((FEATURES, 0), np.float32), np.zeros((n, 0))
            return
        table = np.array([counts[x] for x in self.languages], np.float64) + 0.5
        share = table / table.sum(1, keepdims=True)
        ones = np.array([share[self.code[:, b] > 0].mean(0) for b in range(bits)])
        zeros = np.array([share[self.code[:, b] < 0].mean(0) for b in range(bits)])
        weights = np.log(ones / zeros)
        margin = share @ weights.T * self.code
        trust = np.maximum(margin, 0.0)
        self.trust = trust / np.maximum(trust.sum(1, keepdims=True), 1e-12)
        # Margins of about one where a bit is right.
        self.weights = (weights / np.maximum(np.abs(margin).mean(0), 1e-12)[:, None]).T.astype(np.float32)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        found = [features(x or "") for x in texts]
        size = np.array([len(x) for x in found])
        if not self.languages:
            return [(UNDETERMINED, 0.0, False)] * len(texts)
        counts = np.zeros((len(texts), FEATURES), np.float32)
        for row, f in zip(counts, found, strict=True):
            row += np.bincount(f, minlength=FEATURES)
        margin = (counts @ self.weights) / np.maximum(size, 1)[:, None]
        loss = np.logaddexp(0.0, -self.code[None] * margin[:, None, :])
        distance = (loss * self.trust[None]).sum(2)
        sure = np.minimum(size, FULL_EVIDENCE)[:, None] / 10.0
        chance = np.exp(-(distance - distance.min(1, keepdims=True)) * sure)
        chance /= chance.sum(1, keepdims=True)
        best = distance.argmin(1)
        second = np.sort(chance, 1)[:, -2] if chance.shape[1] > 1 else np.zeros(len(texts))
        top = chance[np.arange(len(texts)), best]
        return [
            (self.languages[i], float(p), bool(p < CLEAR * q)) if n else (UNDETERMINED, 0.0, False)
            for i, p, q, n in zip(best, top, second, size, strict=True)
        ]


def learn(rows: DataFrame, text: str = "text", lang: str = "lang") -> Identifier:
    """Count the n-grams of every row per language; all rows are used."""
    bound_batches(rows.sparkSession)
    usable = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where(
        "lang IS NOT NULL AND text IS NOT NULL"
    )
    parts = usable.mapInArrow(_counted, "lang string, counts array<long>")
    summed = (
        parts.select("lang", F.posexplode("counts").alias("feature", "n"))
        .where("n > 0").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    )
    counts: dict[str, np.ndarray] = {}
    for lang_, feature, n in zip(*summed.toArrow().to_pydict().values(), strict=True):
        counts.setdefault(lang_, np.zeros(FEATURES, np.int64))[feature] = n
    return Identifier(counts)


def identify(text: Column, model: Identifier) -> Column:
    """struct<lang, score, is_ambiguous> of each text."""

    bound_batches(SparkSession.active())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts, out = batch.to_pylist(), []
            for a, b in slices(texts, 250_000):
                for at in range(a, b, 200):
                    out += model.predict(texts[at : min(b, at + 200)])
            lang, score, unsure = zip(*out, strict=True) if out else ((), (), ())
            yield pa.StructArray.from_arrays(
                [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())],
                ["lang", "score", "is_ambiguous"],
            )

    return F.arrow_udf(_typed(run), "struct<lang:string,score:double,is_ambiguous:boolean>")(text)
