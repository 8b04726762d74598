"""Line files that still grow, as a stream: a Python data source whose checkpoint is a byte offset per file.

    spark.dataSource.register(GrowingLines)
    spark.readStream.format("growing_lines").option("path", root).load()   # path, block, line, value

A batch holds the lines completed since the last one. An offset always lies behind a line end, so a line that is still
being written waits, whole, for the batch after its completion; files are only ever appended to, so a retried batch reads
the same bytes. A file shorter than its offset was replaced and is read anew. `line` is where the line begins, which
restores the order of a file whatever batches it came in. Any folder that pyarrow can open by name will do.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from spendmart.sources.transcripts import records_of_lines

TASK_BYTES = 64 << 20
_TAIL = 1 << 16
_BATCH_BYTES = 8 << 20
SCHEMA = "path string, block bigint, line bigint, value string"


def _open_root(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if ":" in root.split("/", 1)[0] else (fs.LocalFileSystem(), root.rstrip("/"))


def _complete(files: fs.FileSystem, path: str, start: int, size: int) -> int:
    """Where the last line end of a file lies, not looking before `start`; found from the end, a block at a time."""
    with files.open_input_file(path) as file:
        stop = size
        while stop > start:
            begin = max(start, stop - _TAIL)
            at = file.read_at(stop - begin, begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            stop = begin
    return start


@dataclass
class Piece:
    """The lines of a file that begin in [start, stop); `first`: start is where a line begins."""

    path: str
    start: int
    stop: int
    first: bool


class Pieces(InputPartition):
    """Work of one task: a part of a large file, or several small ones."""

    def __init__(self, pieces: list[Piece]) -> None:
        super().__init__(pieces)


def pieces_between(start: dict, end: dict, task_bytes: int) -> list[list[Piece]]:
    """The bytes from one offset to the next, in tasks of about `task_bytes`."""
    tasks: list[list[Piece]] = []
    room = 0
    for path in sorted(end):
        begin, stop = start.get(path, 0), end[path]
        if stop < begin:
            begin = 0
        for at in range(begin, stop, task_bytes):
            piece = Piece(path, at, min(stop, at + task_bytes), at == begin)
            if piece.stop - piece.start > room:
                tasks.append([])
                room = task_bytes
            tasks[-1].append(piece)
            room -= piece.stop - piece.start
    return tasks


def lines_of(file, piece: Piece) -> Iterator[tuple[int, bytes]]:
    """(where it begins, line) of the piece's lines. The last one is read to its end, beyond the piece."""
    with io.BufferedReader(file, 1 << 20) as read:
        if piece.first:
            at = piece.start
            read.seek(at)
        else:
            # a line end just before the piece makes its first byte the begin of a line
            read.seek(piece.start - 1)
            at = piece.start - 1 + len(read.readline())
        while at < piece.stop:
            line = read.readline()
            yield at, line
            at += len(line)


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"].rstrip("/")
        self.suffix = options.get("suffix", ".jsonl")
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))
        self.seen: dict[str, tuple[int, int]] = {}  # below root: size, complete; spares unchanged files a second look

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files, base = _open_root(self.root)
        seen = {}
        for info in files.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
            if info.type != fs.FileType.File or not info.path.endswith(self.suffix):
                continue
            below = info.path[len(base) :].lstrip("/")
            size, complete = self.seen.get(below, (0, 0))
            if info.size != size:
                complete = _complete(files, info.path, complete if info.size > size else 0, info.size)
            seen[below] = info.size, complete
        self.seen = seen
        return {below: seen[below][1] for below in sorted(seen) if seen[below][1]}

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        return [Pieces(task) for task in pieces_between(start, end, self.task_bytes)]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        files, base = _open_root(self.root)
        for piece in partition.value:
            found: list[tuple[int, bytes]] = []
            held = 0
            for at, line in lines_of(files.open_input_file(f"{base}/{piece.path}"), piece):
                found.append((at, line))
                held += len(line)
                if held > _BATCH_BYTES:
                    yield self._batch(piece, found)
                    found, held = [], 0
            if found:
                yield self._batch(piece, found)

    def _batch(self, piece: Piece, found: list[tuple[int, bytes]]) -> pa.RecordBatch:
        n = len(found)
        text = [line.rstrip(b"\r\n").decode("utf-8", "replace") for _, line in found]
        columns = [pa.array([f"{self.root}/{piece.path}"] * n), pa.array([piece.start] * n, pa.int64()), pa.array([at for at, _ in found], pa.int64()), pa.array(text, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["path", "block", "line", "value"])

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch."""


class GrowingLines(DataSource):
    """Format `growing_lines`; options: path, suffix (.jsonl), taskBytes. The offset holds one number per file below path."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(dict(self.options))


def stream_growing(spark: SparkSession, root: str, machine_id: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Transcript records of files that may still be written to, each line once, with `ord` as `read_transcripts` has it."""
    spark.dataSource.register(GrowingLines)
    lines = spark.readStream.format("growing_lines").option("path", root).option("taskBytes", task_bytes).load()
    return records_of_lines(lines, root, machine_id)
