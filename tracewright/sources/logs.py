"""The data source `session_logs`: session logs as lines, large ones in several tasks.

    spark.dataSource.register(SessionLogs)
    spark.read.format("session_logs").option("splitBytes", 64 << 20).load("/logs")

Planning lists files and cuts those of lines at byte ranges; small files share a task. A line belongs to the range in which it begins, so a task skips to its first line
and reads beyond its end to finish the last. Whether a log is one of JSON lines or a plain transcript is told by its first line that is not
blank, which each range looks up at the head of the file. JSON documents (.json) are one value and stay whole.

Stores are those of pyarrow.fs (local and mounted folders, file:, s3:, gs:, abfs:, hdfs:); `traces.read` goes by Spark's own reader for any other.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: trace_id: the path; at, k: the byte where a line begins, and its number among those that other separators make of it; form: document, lines, transcript, blank or unreadable.
LINES = "trace_id string, at long, k int, form string, line string"
DOCUMENT, JSON_LINES, TRANSCRIPT, BLANK, UNREADABLE = "document", "lines", "transcript", "blank", "unreadable"
SPLIT, OPEN = 64 << 20, 1 << 20
#: Bytes that are read at once; rows of a batch.
CHUNK, ROWS = 1 << 20, 4096


def filesystem(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, what stands before the path in names of files)."""
    if ":" not in path.split("/", 1)[0]:
        return fs.LocalFileSystem(), path, "file:"
    store, inner = fs.FileSystem.from_uri(path)
    if isinstance(store, fs.LocalFileSystem):
        return store, inner, "file:"
    return store, inner, path[: path.index(inner)] if inner in path else path.split(":", 1)[0] + "://"


def reachable(path: str) -> bool:
    """Whether pyarrow has a file system for the path."""
    try:
        filesystem(path)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def is_json(line: str) -> bool:
    try:
        json.loads(line)
    except (ValueError, RecursionError):
        return False
    return True


def files_under(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files of a folder and all below it, of a pattern, or of one file. Files whose names begin with a dot or underscore are none; folders may."""
    store, inner, _ = filesystem(path)
    pattern = any(c in inner for c in "*?[")
    base = inner[: min(inner.index(c) for c in "*?[" if c in inner)].rsplit("/", 1)[0] or "/" if pattern else inner.rstrip("/") or "/"
    top = store.get_file_info(base)
    if top.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [top] if top.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
    kept = [f for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._" and (not pattern or fnmatch.fnmatch(f.path, inner))]
    return sorted((f.path, f.size) for f in kept)


def whole(path: str) -> bool:
    return path.rsplit("/", 1)[-1].lower().endswith(".json")


@dataclass
class Ranges(InputPartition):
    """(path, first byte, byte after the last) for a task."""

    ranges: list[tuple[str, int, int]]


def planned(files: Sequence[tuple[str, int]], split: int, opening: int = OPEN) -> list[Ranges]:
    """Files cut at `split` bytes, and packed up to as many; opening a file counts as some bytes."""
    pieces = [(p, a, size if whole(p) else min(a + split, size)) for p, size in files for a in ([0] if whole(p) else range(0, max(1, size), split))]
    out: list[Ranges] = []
    room = 0
    for piece in sorted(pieces, key=lambda x: x[1] - x[2]):
        cost = piece[2] - piece[1] + opening
        if not out or cost > room:
            out.append(Ranges([]))
            room = split + opening
        out[-1].ranges.append(piece)
        room -= cost
    return out


class LineReader:
    """The lines of a byte range: those that begin in it, with where they begin."""

    def __init__(self, stream: pa.NativeFile, first: int, last: int, chunk: int = CHUNK) -> None:
        self.stream, self.first, self.last, self.chunk = stream, first, last, chunk

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        """(where it begins, whole lines up to a line end or the end of the file)."""
        at = max(0, self.first - 1)
        self.stream.seek(at)
        held, begun = b"", self.first == 0
        while at < self.last or held:
            read = self.stream.read(self.chunk)
            ended = not read
            if not begun:  # the line that an earlier range has
                cut = read.find(b"\n")
                if cut < 0 and read:
                    at += len(read)
                    if at >= self.last:
                        return
                    continue
                at, read, begun = at + cut + 1, read[cut + 1 :], True
                if at >= self.last:
                    return
            held += read
            # lines that begin before `last`
            over = self.last - at
            stop = held.find(b"\n", max(0, over - 1)) + 1 if over <= len(held) else held.rfind(b"\n") + 1
            if ended:
                stop = len(held)
            if stop:
                yield at, held[:stop]
                at, held = at + stop, held[stop:]
            if at >= self.last or ended:
                return

    def lines(self) -> Iterator[tuple[int, int, str]]:
        for at, block in self.blocks():
            for raw in block.removesuffix(b"\n").split(b"\n"):
                text = raw.decode("utf-8", "replace")
                for k, line in enumerate(text.splitlines() or [""]):
                    yield at, k, line
                at += len(raw) + 1


def form_of(stream: pa.NativeFile) -> str:
    """What the first line that is not blank tells of a file of lines."""
    stream.seek(0)
    for _, _, line in LineReader(stream, 0, 1 << 62).lines():
        if line.strip():
            return JSON_LINES if is_json(line) else TRANSCRIPT
    return BLANK


class LogReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> Sequence[InputPartition]:
        return planned(files_under(self.path), self.split) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _, before = filesystem(self.path)
        schema = pa.schema([("trace_id", pa.string()), ("at", pa.int64()), ("k", pa.int32()), ("form", pa.string()), ("line", pa.string())])
        rows: list[tuple] = []
        size = 0
        for row in self._rows(store, before, partition.ranges):
            rows.append(row)
            size += len(row[4] or "")
            if len(rows) >= ROWS or size >= CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def _rows(self, store: fs.FileSystem, before: str, ranges: list[tuple[str, int, int]]) -> Iterator[tuple]:
        for path, first, last in ranges:
            name = before + path
            try:
                with store.open_input_file(path) as stream:
                    if whole(path):
                        text = stream.read().decode("utf-8", "replace")
                        yield (name, 0, 0, DOCUMENT, text) if text.strip() else (name, 0, 0, BLANK, None)
                        continue
                    form = form_of(stream)
                    if form == BLANK:
                        if first == 0:
                            yield name, 0, 0, BLANK, None
                        continue
                    for at, k, line in LineReader(stream, first, last).lines():
                        if form == TRANSCRIPT or line.strip():
                            yield name, at, k, form, line
            except OSError as error:
                if first == 0:
                    yield name, 0, 0, UNREADABLE, f"The trace could not be read: {error}"


class SessionLogs(DataSource):
    """Options: path, splitBytes (bytes of a task at most, but for longer documents and lines)."""

    @classmethod
    def name(cls) -> str:
        return "session_logs"

    def schema(self) -> str:
        return LINES

    def reader(self, schema: StructType) -> LogReader:
        split = int(self.options.get("splitBytes", SPLIT))
        if split < 1:
            raise ValueError("splitBytes must be positive")
        if "path" not in self.options:
            raise ValueError("session_logs needs a path")
        return LogReader(self.options["path"], split)


def scan(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """The lines of all logs under a path."""
    spark.dataSource.register(SessionLogs)
    return spark.read.format(SessionLogs.name()).option("splitBytes", split).load(path)
