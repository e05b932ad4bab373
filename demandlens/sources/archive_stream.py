"""Archive files whose names do not tell how they are packed, as a Spark data source."""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

GZIP_SIGNATURE = b"\x1f\x8b"
#: Bytes of a plain file that one task reads; a packed file cannot be split.
SPLIT_BYTES = 64 << 20
#: Bytes held at once, beside the rest of an unfinished line.
CHUNK_BYTES = 4 << 20


@dataclass
class FileRange(InputPartition):
    """The lines of a file whose first byte lies in a range."""

    path: str
    start: int
    end: int


def open_file(path: str) -> pa.NativeFile:
    """A file of any file system Arrow knows, under its URI or local path."""
    files, place = pafs.FileSystem.from_uri(path)
    return files.open_input_file(place)


class ArchiveLines(DataSource):
    """Lines of files, packed or plain by their first two bytes.

    The option ``paths`` is a JSON list of files. The columns are those of
    ``read_archive``: a plain file is one block per range of bytes, a packed one a
    single block that is unpacked in bounded chunks as its lines go out.
    """

    @classmethod
    def name(cls) -> str:
        return "archive_lines"

    def schema(self) -> str:
        return "line string, file string, block bigint, line_order bigint"

    def reader(self, schema) -> ArchiveLinesReader:
        return ArchiveLinesReader(json.loads(self.options["paths"]))


class ArchiveLinesReader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[FileRange]:
        ranges = []
        for path in self.paths:
            with open_file(path) as f:
                size = f.size()
                step = max(size, 1) if f.read(2) == GZIP_SIGNATURE else SPLIT_BYTES
            starts = range(0, max(size, 1), step)
            ranges += [FileRange(path, start, min(start + step, size)) for start in starts]
        return ranges

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        with open_file(partition.path) as f:
            if f.read(2) == GZIP_SIGNATURE:
                f.seek(0)
                chunks = unpacked(f)
            else:
                chunks = range_chunks(f, partition.start, partition.end)
            done = 0
            for lines in whole_lines(chunks):
                n = len(lines)
                yield pa.RecordBatch.from_pydict(
                    {
                        "line": pa.array([x.decode("utf-8", "replace") for x in lines], pa.string()),
                        "file": pa.array([partition.path] * n, pa.string()),
                        "block": pa.array([partition.start] * n, pa.int64()),
                        "line_order": pa.array(range(done, done + n), pa.int64()),
                    }
                )
                done += n


def unpacked(f, size: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The content of a gzip file, of one member or several, in chunks."""
    with gzip.GzipFile(fileobj=f) as content:
        while chunk := content.read(size):
            yield chunk


def range_chunks(f, start: int, end: int, size: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The bytes of the lines that begin in [start, end), in chunks.

    A line that a range ends in is read to its end here and skipped by the next range.
    Ranges are cut at line feeds alone, so that each line is in just one of them.
    """
    at, is_inside = max(start - 1, 0), start == 0
    f.seek(at)
    while at < end or is_inside:
        chunk = f.read(size)
        if not chunk:
            return
        begin = 0
        if not is_inside:
            begin = chunk.find(b"\n") + 1
            if not begin:
                at += len(chunk)
                continue
            if at + begin >= end:
                return
            is_inside = True
        if at + len(chunk) >= end:
            last = chunk.find(b"\n", max(begin, end - 1 - at))
            if last >= 0:
                yield chunk[begin : last + 1]
                return
        yield chunk[begin:]
        at += len(chunk)


def whole_lines(chunks: Iterable[bytes]) -> Iterator[list[bytes]]:
    """The lines of each chunk; one that goes on in the next is held back until it ends."""
    held: list[bytes] = []
    for chunk in chunks:
        cut = chunk.rfind(b"\n") + 1
        if not cut:
            held.append(chunk)
            continue
        yield b"".join([*held, chunk[:cut]]).splitlines()
        held = [chunk[cut:]]
    rest = b"".join(held)
    if rest:
        yield rest.splitlines()
