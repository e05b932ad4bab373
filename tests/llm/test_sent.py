"""Texts stay where they lie when few rows are joined with them."""

from pyspark.sql import functions as F

import corpus_pipeline
from demandlens.llm import common


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_few_rows_are_sent_and_many_are_not(spark, monkeypatch):
    rows = spark.createDataFrame([(0, "a"), (1, None), (2, "c"), (2, "d")], "n long, text string")
    gone = spark.createDataFrame([(2,), (2,), (7,)], "row_no long")
    few = corpus_pipeline._without(rows, "n", gone)
    assert "strategy=broadcast" in _plan(few)
    monkeypatch.setattr(common, "MOST_SENT", 1)
    many = corpus_pipeline._without(rows, "n", gone)
    assert "strategy=broadcast" not in _plan(many)
    for kept in (few, many):
        assert sorted(r.text or "" for r in kept.collect()) == ["", "a"]


def test_values_in_rows_are_counted(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_SENT", 3)
    rows = spark.createDataFrame([(1, [1, 2]), (2, [3, 4])], "n long, x array<int>")
    joined = lambda sent: _plan(rows.join(sent, "n", "left_semi"))
    assert "strategy=broadcast" in joined(common.sent_if_few(rows, "sent"))
    assert "strategy=broadcast" not in joined(common.sent_if_few(rows, "sent", F.size("x")))
    assert "strategy=broadcast" in joined(common.sent_if_few(rows.limit(0), "sent", F.size("x")))
