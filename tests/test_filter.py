"""Catalogues too large to broadcast: keys are shuffled, rows are not, and little is left on disk."""

import time

import pytest
from pyspark.sql import functions as F

from demandlens import session
from demandlens.operators import resolver as R
from demandlens.workload import adapters as A


def shuffle_files(spark):
    """Names of the shuffle files there are now."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files, names = manager.getAllFiles().iterator(), set()
    while files.hasNext():
        name = files.next().getName()
        if name.startswith("shuffle"):
            names.add(name)
    return names


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Queries of one to ten words over few words, with names that start some of them."""
    words = [f"w{n}" for n in range(12)] + ["the", "a", "björk", "unknown", "7 -"]
    texts = [" ".join(words[(i * (j + 3)) % 17] for j in range(1 + i % 10)) for i in range(600)]
    rows = [*enumerate(texts), (None, texts[5]), (5, "same key"), (7, None), (8, "")]
    names = {" ".join(t.split(" ")[: 1 + i % 8]) for i, t in enumerate(texts) if i % 3 == 0}
    root = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "id int, q string").write.parquet(f"{root}/queries")
    known = [(name,) for name in sorted(names)] + [("w1",), ("w1",), (None,)]
    spark.createDataFrame(known, "normalized_name string").write.parquet(f"{root}/names")
    return spark.read.parquet(f"{root}/queries"), spark.read.parquet(f"{root}/names")


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(("bits", "names"), [(16, 128), (8, 1_000)])
def test_filter_agrees_with_broadcast(tables, monkeypatch, bits, names):
    """Also where most keys pass by chance."""
    monkeypatch.setattr(R, "MARK_BITS", bits)
    monkeypatch.setattr(R, "NAMES_PER_BLOCK", names)
    by_filter = R.match_catalogue(tables[0], "q", tables[1], ("id",), "filter")
    by_broadcast = R.match_catalogue(tables[0], "q", tables[1], None, "broadcast")
    assert _rows(by_filter) == _rows(by_broadcast)
    assert any(row["artist_name"] is None for row in by_filter.collect())


def test_filter_does_not_shuffle_rows(tables, monkeypatch):
    monkeypatch.setattr(R, "fits_broadcast", lambda catalogue: False)
    matched = R.match_catalogue(tables[0], "q", tables[1], ("id",))
    text = matched._jdf.queryExecution().executedPlan().toString()
    assert text.count("BroadcastHashJoin") == R.MAXIMUM_PREFIX_TOKENS
    assert "SortMergeJoin" not in text and "hashpartitioning" not in text
    resolved = R.resolve_queries(tables[0], "q", tables[1], ("id",))
    by_broadcast = R.resolve_queries(tables[0], "q", tables[1], None, "broadcast")
    assert _rows(resolved) == _rows(by_broadcast)


@pytest.mark.parametrize("limit", [0, 600])
def test_filter_that_does_not_fit_gives_way(tables, monkeypatch, limit):
    """Before or after the keys that pass by chance are known."""
    monkeypatch.setattr(R, "FILTER_LIMIT_BYTES", limit)
    monkeypatch.setattr(R, "MARK_BITS", 8)
    monkeypatch.setattr(R, "NAMES_PER_BLOCK", 1_000)
    matched = R.match_catalogue(tables[0], "q", tables[1], ("id",), "filter")
    assert "_row#" in _plan(matched)
    by_broadcast = R.match_catalogue(tables[0], "q", tables[1], None, "broadcast")
    assert _rows(matched) == _rows(by_broadcast)


@pytest.mark.parametrize("strategy", ["filter", "shuffle"])
def test_no_shuffle_files_are_left_before_the_rows_are_read(spark, tables, strategy):
    before = shuffle_files(spark)
    R.match_catalogue(tables[0], "q", tables[1], ("id",), strategy)
    for _ in range(50):  # they are removed behind the job's back
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before


def test_setting_is_put_back(spark):
    assert spark.conf.get(session.FREE_SHUFFLES, None) is None
    with pytest.raises(ZeroDivisionError), session.shuffles_freed(spark):
        assert spark.conf.get(session.FREE_SHUFFLES) == "true"
        raise ZeroDivisionError
    assert spark.conf.get(session.FREE_SHUFFLES, None) is None


def test_documents_are_dealt_anew_only_where_files_leave_cores_idle(spark, tmp_path):
    texts = spark.range(0, 4_000, 1, 4).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text")
    )
    got = []
    for name, files in (("one", 1), ("eight", 8)):
        texts.repartition(files).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        documents = A.documents(spark, f"{tmp_path}/{name}")
        assert ("Repartition" in _plan(documents)) == (files == 1)
        got.append(_rows(documents))
    assert got[0] == got[1] and len(got[0]) == 4_000
    texts.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert A.documents(spark, f"{tmp_path}/none").count() == 0
