"""Stages of the pipeline: rows numbered once, clashing names, contents, memory of a task."""

from __future__ import annotations

import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from demandlens.llm import sentencepiece_codec
from demandlens.llm.common import TaskWords, fresh_name, table
from demandlens.llm.pieces import PieceModel

SMALL = "/root/testdata/sf0.001"
SPLITS = "spark.sql.leafNodeDefaultParallelism"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture()
def splits(spark):
    """Sets how many splits a scan makes; unset again afterwards."""
    yield lambda n: spark.conf.set(SPLITS, n)
    spark.conf.unset(SPLITS)


@pytest.mark.parametrize(
    "stage", [corpus_pipeline.drop_near_duplicates, corpus_pipeline.drop_contaminated, corpus_pipeline.mask_secrets]
)
def test_rows_keep_their_number_when_splits_change(spark, splits, tmp_path, stage):
    path = str(tmp_path / "documents")
    table(spark, SMALL, "documents").repartition(40, "doc_id").write.parquet(path)
    docs = spark.read.parquet(path)
    wanted = sorted(map(tuple, stage(spark, docs, SMALL).select("doc_id", "text").collect()))
    splits(4)
    planned = stage(spark, docs, SMALL).select("doc_id", "text")
    splits(16)
    assert sorted(map(tuple, planned.collect())) == wanted


def test_stages_keep_columns_with_names_of_their_own(spark):
    docs = table(spark, SMALL, "documents").limit(60)
    clashing = ("_found", "__found", "_Spans", "_pipeline_row", "row_no", "key", "spans", "class_id")
    for i, name in enumerate(clashing):
        docs = docs.withColumn(name, F.concat(F.lit(f"{i}:"), F.col("doc_id").cast("string")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        for row in out.collect():
            assert [row[x] for x in clashing] == [f"{i}:{row.doc_id}" for i in range(len(clashing))]


def test_fresh_names(spark):
    frame = spark.createDataFrame([(1, 2)], "a int, _A int")
    assert fresh_name(frame, "b") == "b" and fresh_name(frame, "a") == "__a"


def _jaccard(a: str, b: str) -> float:
    x, y = (
        Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
        for w in (re.findall(r"\w+", t.lower()) for t in (a, b))
    )
    return (x & y).total() / (x | y).total()


def test_near_duplicates_stage_against_all_pairs(spark):
    docs = table(spark, SMALL, "documents").where("length(text) > 40").select("doc_id", "text")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            shorter, longer = sorted((len(texts[i]), len(texts[j])))
            if shorter * 2 > longer and _jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert kept == {find(i) for i in ids}


def test_language_stage_drops_what_has_no_letter(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text", "lang").where("length(text) > 200")
    bad = spark.createDataFrame([(-1, None, "en"), (-2, "", None), (-3, "12 34 !", "en")], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs.unionByName(bad), SMALL).collect()}
    assert not kept & {-1, -2, -3}
    assert len(kept) >= 0.9 * docs.count()


def test_table_of_words_is_bounded_and_its_results_are_not(spark, monkeypatch):
    model = PieceModel(MODEL)
    words = [f"▁word{i}" for i in range(3000)]
    wanted = dict(sentencepiece_codec._encoded_words(model).work(words))
    small = TaskWords(sentencepiece_codec._encoded_words(model).work, 20_000)
    for start in range(0, len(words), 50):
        part = words[start : start + 50] + words[:10]
        small.learn(set(part))
        assert {w: small[w] for w in part} == {w: wanted[w] for w in part}
        # The bound may be passed by what one slice of text needs.
        assert small.bytes <= 20_000 + 60 * 400
