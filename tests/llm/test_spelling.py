"""Spelling variants against all near words found by deleting code points."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from demandlens.llm import queries, spelling

FOLDER = "/root/testdata/sf0.01"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1:] or (len(a) == len(b) and a[i + 1:] == b[i + 1:])


def near_words(words):
    """Words meet on themselves and on what is left without one code point; then all are compared."""
    met, near = defaultdict(set), defaultdict(set)
    for w in words:
        for key in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            met[key].add(w)
    for group in met.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    return near


def expected(counts, ratio=10):
    near, form = near_words(counts), {}
    for w in counts:
        if near[w]:
            best = min(near[w], key=lambda x: (-counts[x], x))
            if counts[best] >= ratio * counts[w]:
                form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()}


def expected_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if doc_id is not None and h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 7:
                counts[w] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def result(df):
    rows = df.collect()
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(found) == len(rows)
    return found


def test_query_over_a_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    want = expected(expected_counts(docs))
    got = result(queries.op11_spelling_variants(spark, FOLDER))
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 50


@pytest.mark.parametrize("group_words", [3, 1500])
def test_open_prefixes_change_nothing(spark, group_words):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = spelling.counted_words(docs, least_letters=2).where("length(word) < 9")
    counts = {r.word: r.n for r in words.collect()}
    assert result(spelling.variants(words, ratio=2, group_words=group_words)) == expected(counts, 2)


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("aabé", max_size=6), max_size=40))
def test_composition_accepts_each_near_pair_once(words):
    pairs = list(spelling.Acceptor(sorted(words)).near_pairs())
    assert len(pairs) == len({frozenset(p) for p in pairs})
    near = near_words(words)
    assert {frozenset(p) for p in pairs} == {frozenset((a, b)) for a in words for b in near[a]}


def test_the_acceptor_is_minimal():
    words = sorted(a + b for a in ("x", "yy", "z") for b in ("", "ing", "ed"))
    assert len(spelling.Acceptor(words).arcs) == 7


def test_damaged_rows(spark):
    rows = [
        (1, None), (2, ""), (3, "12 .. !?"), (None, "Anothing anothing"), (None, "anothing"), (4, "anothign " * 3),
        (4, "anothign " * 3), (5, "ÀNOTHING ànothing " * 2), (6, "q" * 3000 + " " + "q" * 2999), (7, "q" * 3000),
        (8, "q" * 2999 + " short"), (9, "nothing " * 40),
    ]
    df = spark.createDataFrame(
        [(*r, 1, "x", "y") for r in rows], "doc_id long, text string, n int, word string, prefix string"
    ).repartition(3)
    words = spelling.counted_words(df, misspell=True)
    counts = {r.word: r.n for r in words.collect()}
    assert counts == expected_counts(rows)
    assert result(spelling.variants(words)) == expected(counts)
    assert result(spelling.variants(words, group_words=2)) == expected(counts)
    assert spelling.variants(words.where("false")).count() == 0
    given_twice = spark.createDataFrame([("ab", 5, 1), ("ab", 6, 1), ("abc", 1, 1), (None, 9, 1)], "word string, n int, best int")
    assert result(spelling.variants(given_twice)) == {"ab": (None, "ab", 11, 1, None), "abc": ("ab", "ab", 1, 1, 11)}
