"""Pieces of texts numbered in Arrow give the library's ids, however texts are cut."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from demandlens.llm import token_store
from demandlens.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")
PARTS = ["a", "b", " ", " ", "\n", "\t", "é", "1", ".", "'s", "\x85", "　", "word", "\x1c", "中", "<|endoftext|>"]


def agrees(encoder, texts):
    found, sizes = encoder.encode(pa.array(texts, pa.string()))
    expected = [x.ids + [2] for x in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(x) for x in expected]
    assert np.frombuffer(b"".join(found), encoder.dtype).tolist() == [i for x in expected for i in x]


@pytest.fixture(scope="module")
def encoder():
    return token_store.Encoder(PATH, 2)


def test_random_texts(encoder):
    rnd = random.Random(5)
    texts = ["".join(rnd.choices(PARTS, k=rnd.randint(0, 14))) for _ in range(4000)]
    agrees(encoder, texts)
    agrees(encoder, [" ".join(rnd.choices(PARTS[:2] + PARTS[6:10] + PARTS[12:], k=9)) for _ in range(1000)])


def test_edges(encoder):
    agrees(encoder, [])
    agrees(encoder, ["", " ", "a", "a ", " a", "a  b", "a \nb", "a\n b", "a\nb"])
    agrees(encoder, ["x <|endoftext|> y", "<|endoftext|>x y<|endoftext|>"])
    agrees(encoder, ["word " * 50_000 + "end", "one"])


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(token_store, "REMEMBERED_BYTES", 2_000)
    encoder = token_store.Encoder(PATH, 2)
    for start in range(0, 400, 40):
        agrees(encoder, [" ".join(f"w{i} common" for i in range(start, start + 40))])
        assert len(encoder.later) < 100
