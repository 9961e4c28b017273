"""The data source `session_files`: for each trace a folder with its narrative, report and episodes.

    spark.dataSource.register(SessionFiles)
    df.write.format("session_files").mode("append").save("/out")        # trace_id, narrative, report, episodes

A task writes into a folder of its own below `_staging-...`; its commit message names that folder and its traces. Only the driver's commit moves files to their
places, so a task that fails, or runs twice, leaves neither half a file nor a second one; abort and commit both clear the staging folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from tracewright.sources.logs import filesystem

#: Column and name of its file (fixed values).
FILES = {"narrative": "narrative.md", "report": "field-report.md", "episodes": "episodes.json"}
SCHEMA = "trace_id string, narrative string, report string, episodes string"


def folder_of(trace_id: str) -> str:
    """A name for any trace, also one that is a path; never one that listings pass by."""
    name = quote(trace_id, safe="")
    return f"%{ord(name[0]):02X}{name[1:]}" if name[:1] in (".", "_") else name or "%"


@dataclass
class Written(WriterCommitMessage):
    """(folder of a task, (folder, file) of each file in it)."""

    staged: str
    files: list[tuple[str, str]]


class FilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, f"_staging-{uuid.uuid4().hex}"

    def _store(self) -> tuple[fs.FileSystem, str]:
        store, inner, _ = filesystem(self.path)
        return store, inner.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> Written:
        store, top = self._store()
        staged = f"{top}/{self.job}/{uuid.uuid4().hex}"
        files: list[tuple[str, str]] = []
        for row in iterator:
            folder = folder_of(str(row["trace_id"]))
            store.create_dir(f"{staged}/{folder}", recursive=True)
            for column, name in FILES.items():
                if row[column] is not None:
                    with store.open_output_stream(f"{staged}/{folder}/{name}") as out:
                        out.write(row[column].encode())
                    files.append((folder, name))
        return Written(staged, files)

    def commit(self, messages: list[Written | None]) -> None:
        store, top = self._store()
        if self.overwrite:
            for found in store.get_file_info(fs.FileSelector(top, allow_not_found=True)):
                if found.base_name != self.job:
                    (store.delete_dir if found.type == fs.FileType.Directory else store.delete_file)(found.path)
        for message in filter(None, messages):
            for folder in dict.fromkeys(f for f, _ in message.files):
                store.create_dir(f"{top}/{folder}", recursive=True)
            for folder, name in message.files:
                place = f"{top}/{folder}/{name}"
                if store.get_file_info(place).type != fs.FileType.NotFound:
                    store.delete_file(place)
                store.move(f"{message.staged}/{folder}/{name}", place)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, top = self._store()
        if store.get_file_info(f"{top}/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{top}/{self.job}")


class SessionFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "session_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        if missing := {"trace_id", *FILES} - set(schema.fieldNames()):
            raise ValueError(f"session_files needs columns {', '.join(sorted(missing))}")
        return FilesWriter(self.options["path"], overwrite)


def write_files(relations: dict[str, DataFrame], path: str, mode: str = "append") -> None:
    """The files of all traces of an analysis (what `analyze` gives) under a path. A trace's earlier files are replaced; with mode 'overwrite' so is all else there."""
    episodes = relations["episodes_json"].select("trace_id", F.col("json").alias("episodes"))
    rows = relations["narratives"].join(relations["reports"], "trace_id", "full").join(episodes, "trace_id", "full")
    spark = rows.sparkSession
    spark.dataSource.register(SessionFiles)
    rows.select(rows["trace_id"].cast("string").alias("trace_id"), *FILES).write.format(SessionFiles.name()).mode(mode).save(path)
