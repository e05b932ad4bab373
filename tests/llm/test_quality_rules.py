"""Quality rules against a plain restatement; scores against plain sums over hashed n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from demandlens.llm import quality_rules, queries

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, words string, key string, is_trusted int, score double"
TEXTS = [
    (0, None), (1, ""), (2, " \t\n\x0b\x0c\r "), (3, "one"), (4, "one two"), (5, "a b c a b c"), (6, "a a a a a"),
    (7, "a a a\n\na a a\r\n x y   z\n \t \n \t \na a a"), (8, "# $ <b> | & *%*\x1c x"), (None, "no id " * 40),
    (None, "no id " * 40), (9, "word%d " * 70 % tuple(range(70))), (9, "word%d " * 70 % tuple(range(70))),
    (10, "é漢字 𝒳 " * 30), (11, "a b c d e a b c d x e a b c"), (12, "w " * 60000), (13, " ".join(f"w{i % 5003}" for i in range(20000))),
]


def base(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if seen[w] > 1 for j in (i, i + 1, i + 2)}
    n = len(words)
    failed = n < 50 or 100 * len(repeated) > 50 * n
    return (
        n, sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed,
    )


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "w", "k", 1, 2.0) for r in TEXTS], SCHEMA).repartition(3)


def judged(df, weights):
    return [
        (r.key, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed), r.score, r.kept)
        for r in quality_rules.judge(df, weights).collect()
    ]


def test_rules_on_damaged_rows(docs):
    got = judged(docs, quality_rules.Weights(None))
    assert sorted(map(str, ((k, b) for k, b, _, _ in got))) == sorted(str((k, base(t))) for k, t in TEXTS)
    assert all(score is None and kept != b[-1] for _, b, score, kept in got)


def test_windows_that_share_a_hash_are_told_apart(docs, monkeypatch):
    """With one hash for all windows every count comes from the sorted words."""
    same = lambda x, y: y.isNotNull() & F.lit(True)
    monkeypatch.setattr(quality_rules, "_same_hash", same)
    few = docs.where("length(text) < 5000")
    want = sorted(str((k, base(t))) for k, t in TEXTS if t is not None and len(t) < 5000)
    assert sorted(str((k, b)) for k, b, _, _ in judged(few, quality_rules.Weights(None))) == want


def test_rules_over_a_whole_table(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r[0]: tuple(r[1:7]) for r in queries.op12_quality_rules(spark, SMALL).collect()}
    assert got == {k: base(t) for k, t in rows}


def hashed_grams(spark, texts):
    """Buckets of each text's words and pairs, one row each, in no shared code with the operator."""
    rows = []
    for i, text in enumerate(texts):
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        rows += [(i, w, None) for w in words] + [(i, a, b) for a, b in zip(words, words[1:])]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    bucket = F.pmod(F.when(F.col("b").isNull(), F.xxhash64("a")).otherwise(F.xxhash64(F.xxhash64("a"), F.xxhash64("b"))), F.lit(quality_rules.BUCKETS))
    found = [Counter() for _ in texts]
    for r in df.select("i", bucket.alias("h")).collect():
        found[r.i][r.h] += 1
    return found


def test_scores_are_mean_log_ratios(spark, docs):
    trusted = {0, 3, 9, 10, 13}
    weights = quality_rules.learn(docs, spark.createDataFrame([(k,) for k in trusted] * 2 + [(None,)], "doc_id long"))
    grams = hashed_grams(spark, [t for _, t in TEXTS])
    raw, target = sum(grams, Counter()), sum((g for (k, _), g in zip(TEXTS, grams) if k in trusted), Counter())
    n_raw, n_target, b = raw.total(), target.total(), quality_rules.BUCKETS
    ratio = {h: math.log((target[h] + 1) / (n_target + b) / ((raw[h] + 1) / (n_raw + b))) for h in raw}
    want = []
    for (key, text), g in zip(TEXTS, grams):
        score = sum(ratio[h] * n for h, n in g.items()) / g.total() if g else None
        fails = base(text)[-1]
        want.append((key, score, not fails and (score is None or score >= quality_rules.LEAST_SCORE)))
    got = sorted(((k, s, kept) for k, _, s, kept in judged(docs, weights)), key=lambda r: (str(r[0]), r[1] or 0))
    for a, e in zip(got, sorted(want, key=lambda r: (str(r[0]), r[1] or 0)), strict=True):
        assert a[0] == e[0] and a[2] == e[2] and (a[1] == e[1] or abs(a[1] - e[1]) < 1e-9)


def test_verdicts_on_labelled_rows(spark):
    """On a table of the check's kind: good texts stay, junk that passes the rules falls."""
    folder = "/root/testdata/sf0.01"
    found = queries.op12_quality_rules(spark, folder).where("NOT base_failed")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = found.join(labels, "doc_id").select("quality", "kept").collect()
    share = lambda q: sum(r.kept for r in rows if r.quality == q) / sum(r.quality == q for r in rows)
    assert share(1) > 0.98 and share(0) < 0.2


def test_no_rows_and_nobody_trusted(spark, docs):
    nobody = spark.createDataFrame([], "doc_id long")
    assert quality_rules.learn(docs, nobody).listed is None
    none = docs.where("false")
    assert quality_rules.learn(none, docs).listed is None
    assert quality_rules.judge(none, quality_rules.Weights(None)).count() == 0


def test_trusted_rows_are_bounded(spark):
    keys = spark.range(5000).select(F.col("id").alias("key"))
    some = quality_rules._bounded(keys, 300)
    picked = {r.key for r in some.collect()}
    assert 200 < len(picked) <= 300 and picked == {r.key for r in some.repartition(7).collect()}


def test_nothing_runs_in_python(spark):
    plan = queries.op12_quality_rules(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
