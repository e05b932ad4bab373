import gzip
import hashlib
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from demandlens import schemas as S
from demandlens.sources import archive as A

PERSON = "98dad5a9388387bc"


def record(**fields):
    return json.dumps({"time": "2026-08-12T07:58:31Z", "query": "muse", "user": PERSON} | fields)


CASES = [
    (record(), "imported"),
    ("  " + record() + "  ", "imported"),
    (record(extra=[1, {"user": 2}]), "imported"),
    (record(query=5), "imported"),
    (record(time="2026-08-12T07:58:31.123456+02:00"), "imported"),
    ("", "blank"),
    (" \t ", "blank"),
    (record()[:30], "malformed"),
    ("7", "malformed"),
    ("null", "malformed"),
    ('["user", "query"]', "malformed"),
    (json.dumps({"time": "2026-08-12T07:58:31Z", "query": "q"}), "no_searcher"),
    (json.dumps({"query": "q"}), "no_searcher"),
    (json.dumps({"time": "2026-08-12T07:58:31Z"}), "invalid"),
    (json.dumps({"query": "q", "user": PERSON}), "invalid"),
    (record(user=PERSON[:15]), "invalid"),
    (record(user=None), "invalid"),
    (record(query=None), "invalid"),
    (record(time="junk"), "invalid"),
    (record(time="2026-13-40T00:00:00Z"), "invalid"),
    (record(time=2026), "invalid"),
]


def test_every_line_gets_its_reason(spark):
    df = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(CASES)], "i int, line string")
    got = A.classify_archive(df).orderBy("i").collect()
    assert [row["reason"] for row in got] == [reason for _, reason in CASES]
    report = {r["reason"]: r["line_count"] for r in A.reject_report(A.classify_archive(df)).collect()}
    assert sum(report.values()) == len(CASES)


def test_a_line_is_one_record(spark):
    good = record()
    odd = [good * 2, f"{good},{good}", f"{good} x", f"{good}]", f"{good}}}", f"{good}],[{good}"]
    df = spark.createDataFrame([(x,) for x in (*odd, f"\u00a0{good}\u00a0")], "line string")
    got = [row["reason"] for row in A.classify_archive(df).collect()]
    assert got == [A.MALFORMED] * len(odd) + [A.IMPORTED]


@pytest.mark.parametrize(
    "text",
    [
        "2026-08-12",
        "20260812",
        "2026-08-12T07",
        "2026-08-12T07:58",
        "2026-08-12T07:58:31",
        "20260812T075831",
        "2026-08-12 07:58:31.5",
        "2026-08-12T07:58:31.123456789Z",
        "2026-08-12T07:58:31,25",
        "2026-08-12T07:58:31+02:00",
        "2026-08-12T07:58:31-0530",
        "2026-02-30T00:00:00",
        "2026",
        "2026-08",
        "2026-8-1",
        "12/08/2026",
        "",
    ],
)
def test_times_as_python_reads_them(spark, text):
    try:
        expected = datetime.fromisoformat(text.replace("Z", "+00:00")).replace(tzinfo=None)
    except ValueError:
        expected = None
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(A.wall_clock(F.col("t"))).first()[0] == expected


def test_tickets_are_blake2b_over_the_raw_line_values(spark):
    lines = [record(query=q) for q in ("muse", "björk - jóga", "")]
    df = spark.createDataFrame([(line,) for line in lines], "line string")
    rows = A.imported_rows(A.classify_archive(df)).collect()
    for row in rows:
        source = f"{PERSON}|2026-08-12T07:58:31Z|{row['query_text']}"
        digest = hashlib.blake2b(source.encode(), digest_size=4).digest()
        assert row["ticket"] == int.from_bytes(digest, "big")
    assert len({row["ticket"] for row in rows}) == 3
    assert A.imported_rows(A.classify_archive(df)).schema.names == S.RAW_SCHEMA.names


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "searches-1.jsonl").write_bytes(record().encode() + b"\n\xff\xfe broken\n")
    with gzip.open(tmp_path / "searches-2.jsonl.gz", "wt") as packed:
        packed.write(record(query="packed") + "\n")
    (tmp_path / "other.txt").write_text(record(query="ignored"))
    lines = A.read_archive(spark, str(tmp_path), str(tmp_path / "missing.jsonl"))
    classified = A.classify_archive(lines)
    queries = sorted(r["query_text"] for r in A.imported_rows(classified).collect())
    assert queries == ["muse", "packed"]
    assert lines.where(F.contains("line", F.lit("�"))).count() == 1


def test_nothing_to_import(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        A.read_archive(spark, str(tmp_path / "missing"))


def test_gzip_without_its_suffix(spark, tmp_path):
    (tmp_path / "mounted").write_bytes(gzip.compress((record(query="found") + "\n").encode()))
    lines = A.read_archive_without_suffix(spark, str(tmp_path / "mounted"))
    rows = A.imported_rows(A.classify_archive(lines)).collect()
    assert [r["query_text"] for r in rows] == ["found"]


def test_limit_counts_accepted_lines_per_file_in_order(spark):
    df = spark.createDataFrame(
        [(f, b, f * 1000 + b * 100 + i) for f in (1, 2) for b in range(4) for i in range(7 + f)],
        "file int, block int, line_order int",
    )
    got = A.limit_per_file(df, 12).orderBy("line_order").collect()
    expected = []
    for f in (1, 2):
        expected += sorted(r["line_order"] for r in df.where(F.col("file") == f).collect())[:12]
    assert [r["line_order"] for r in got] == expected
