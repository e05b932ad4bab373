"""Files of every packing, read in ranges and chunks, and the job that imports them."""

import gzip
import io
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from demandlens.plans import imports, store
from demandlens.sources import archive, archive_stream

PERSON = "98dad5a9388387bc"


def record(query, time="2026-08-12T07:58:31Z", user=PERSON):
    return json.dumps({"time": time, "query": query, "user": user}) + "\n"


@given(
    st.lists(st.sampled_from([b"", b"a", b"bc", b"\r", b"long line of text", b"\xff"]), max_size=30),
    st.booleans(), st.integers(1, 40), st.integers(1, 25),
)
@settings(max_examples=300, deadline=None)
def test_ranges_have_each_line_once(parts, ends, step, size):
    data = b"\n".join(parts) + (b"\n" if ends else b"")
    got = []
    for start in range(0, max(len(data), 1), step):
        chunks = archive_stream.range_chunks(io.BytesIO(data), start, min(start + step, len(data)), size)
        got += [x for lines in archive_stream.whole_lines(chunks) for x in lines]
    assert got == data.splitlines()


@given(st.binary(max_size=200), st.integers(1, 50))
@settings(max_examples=100, deadline=None)
def test_packed_members_in_chunks(data, size):
    packed = io.BytesIO(gzip.compress(data) + gzip.compress(data))
    assert b"".join(archive_stream.unpacked(packed, size)) == data + data


@pytest.fixture()
def folder(tmp_path):
    """A plain and a packed file, a packed one without its suffix, a plain one with it."""
    (tmp_path / "searches-1.jsonl").write_text(record("one") + "\n" + record("uno") + "broken\n")
    (tmp_path / "searches-2.jsonl.gz").write_bytes(gzip.compress(record("two").encode()))
    packed = gzip.compress(record("three").encode()) + gzip.compress(record("drei").encode())
    (tmp_path / "searches-3.jsonl").write_bytes(packed)
    (tmp_path / "searches-4.jsonl.gz").write_text(record("four") + record("x", user="short"))
    (tmp_path / "searches-5.jsonl").write_bytes(b"")
    (tmp_path / "other.jsonl").write_text(record("ignored"))
    return str(tmp_path)


def queries(spark, place):
    return sorted(r["query_text"] for r in store.read_raw(spark, place).collect())


def test_import_of_a_folder(spark, folder, tmp_path):
    place = store.Store(str(tmp_path / "store"))
    for _ in range(2):
        report = imports.import_archives(spark, place, folder, f"{folder}/missing.jsonl")
        counts = {(r["file"].rsplit("/", 1)[1][9], r["reason"]): r["line_count"] for r in report.collect()}
        assert counts == {
            ("1", "imported"): 2, ("1", "blank"): 1, ("1", "malformed"): 1, ("2", "imported"): 1,
            ("3", "imported"): 2, ("4", "imported"): 1, ("4", "invalid"): 1,
        }
        # Imported again, the files replace themselves.
        assert queries(spark, place) == ["drei", "four", "one", "three", "two", "uno"]


def test_limit_per_file_is_reported(spark, folder, tmp_path):
    place = store.Store(str(tmp_path / "store"))
    report = imports.import_archives(spark, place, folder, limit=1)
    over = {r["file"].rsplit("/", 1)[1][9]: r["line_count"] for r in report.collect() if r["reason"] == "over_limit"}
    assert over == {"1": 1, "3": 1}
    assert queries(spark, place) == ["four", "one", "three", "two"]
    total = sum(r["line_count"] for r in report.collect())
    assert total == 9


def test_large_plain_files_are_read_in_ranges(spark, tmp_path):
    path = tmp_path / "searches-9.jsonl.gz"
    path.write_text("".join(record(f"q{i}") for i in range(2000)))
    reader = archive_stream.ArchiveLinesReader([str(path)])
    whole = reader.read(archive_stream.FileRange(str(path), 0, path.stat().st_size))
    assert sum(b.num_rows for b in whole) == 2000
    half = path.stat().st_size // 2
    parts = [archive_stream.FileRange(str(path), 0, half), archive_stream.FileRange(str(path), half, 2 * half + 1)]
    lines = [x for p in parts for b in reader.read(p) for x in b.column("line").to_pylist()]
    assert lines == path.read_text().splitlines()


def test_nothing_to_import(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        imports.import_archives(spark, store.Store(str(tmp_path / "store")), str(tmp_path / "missing"))
    assert archive.archive_files(spark, str(tmp_path / "missing")) == []
