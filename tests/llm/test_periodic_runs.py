"""Periodic runs against every period tried at every word, and against slices."""

from __future__ import annotations

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from demandlens.llm import periodic_runs, queries

SMALL = "/root/testdata/sf0.001"


def all_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = q
        while i < len(words):
            at = i
            while i < len(words) and words[i] == words[i - q]:
                i += 1
            whole = (at - q, i)
            if i - at + q >= max(6, 4 * q):
                found.setdefault(whole, q)
            i += 1
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


periodic = st.builds(
    lambda head, body, times, tail: head + body * times + tail,
    *[st.lists(st.integers(0, 3), max_size=12)] * 2, st.integers(0, 9), st.lists(st.integers(0, 3), max_size=12),
)


@settings(max_examples=400, deadline=None)
@given(st.lists(periodic, max_size=4).map(lambda x: sum(x, [])), st.lists(st.integers(0, 200), max_size=5))
def test_runs_are_those_of_every_period(words, cuts):
    want = all_runs(words)
    assert periodic_runs.find_runs(np.array(words, np.int64)) == want
    catchers = periodic_runs.Catchers()
    cuts = sorted(min(c, len(words)) for c in cuts)
    for a, b in zip([0, *cuts], [*cuts, len(words)]):
        catchers.append(np.array(words[a:b], np.int64))
    assert catchers.runs() == want


def expected(doc_id, text):
    words = [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = all_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = None
    for s, length, q in runs:
        if best is None or Fraction(length, q) > Fraction(best[1], best[2]):
            best = (s, length, q)
    most = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *most, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(kept), n)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_over_a_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = as_rows(queries.op13_periodic_runs(spark, SMALL))
    assert got == sorted((expected(*r) for r in docs), key=str)
    assert sum(r[1] > 0 for r in got) > 20


def test_damaged_rows(spark):
    rows = [
        (1, None), (2, ""), (3, " \t\n\v\f\r "), (None, "x " * 50), (None, None), (5, "a b " * 9),
        (5, "a b " * 9), (6, " a b " * 7), (7, "é " * 5), (8, "é " * 6), (9, "w%d " * 3 % (1, 2, 3)),
        (11, " ".join(f"w{i % 97}" for i in range(900))), (12, "k " * 700), (10, "one two three four five"),
    ]
    df = spark.createDataFrame(
        [(*r, 1, "s", "c") for r in rows], "doc_id long, text string, n_runs int, key string, collapsed string"
    ).repartition(3)
    got = periodic_runs.scan(df, plant=True).drop("runs", "collapsed")
    got = got.selectExpr(
        "key", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words"
    )
    assert as_rows(got) == sorted((expected(*r) for r in rows), key=str)
    assert periodic_runs.scan(df.where("false")).count() == 0
    long = spark.createDataFrame([(1, " ".join(f"w{i % 9973}" for i in range(60000)))], "doc_id long, text string")
    assert tuple(periodic_runs.scan(long).first())[1:7] == (60000, 1, 0, 60000, 9973, 6016)
    plain = {r.key: r for r in periodic_runs.scan(df.where("doc_id in (5, 6)")).collect()}
    assert plain[5].runs[0].asDict() == {"start": 0, "length": 18, "period": 2}
    assert plain[5].collapsed == "a b" and plain[6].n_runs == 1
