"""Files written by tasks: a data source whose rows are files.

Each task writes into a folder of its own under ``_temporary``. Once all are done, the folders of the tasks
that count are renamed into place; a job that fails leaves nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SOURCE = "files"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.job, self.overwrite = path.rstrip("/"), uuid.uuid4().hex, overwrite

    def _open(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = self._open()
        task = uuid.uuid4().hex  # a task that is tried again writes elsewhere
        folder, n = f"{root}/_temporary/{self.job}/{task}", 0
        store.create_dir(folder, recursive=True)
        for name, content in iterator:
            if not name or "/" in name or name in (".", ".."):
                raise ValueError(f"not a file name: {name!r}")
            with store.open_output_stream(f"{folder}/{name}") as out:
                out.write(bytes(content) if content is not None else b"")
            n += 1
        return Written(task, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = self._open()
        if self.overwrite:
            for found in store.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
                if found.base_name.startswith("part-"):
                    store.delete_dir(found.path)
        for message in messages:
            if message is not None and message.files:
                store.move(f"{root}/_temporary/{self.job}/{message.folder}", f"{root}/part-{message.folder}")
        self._clean(store, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean(*self._open())

    def _clean(self, store: pafs.FileSystem, root: str) -> None:
        for path in (f"{root}/_temporary/{self.job}", f"{root}/_temporary"):
            left = store.get_file_info(pafs.FileSelector(path, allow_not_found=True))
            if path.endswith(self.job) or not left:  # another job may be under way
                try:
                    store.delete_dir(path)
                except FileNotFoundError:
                    pass


class FileSink(DataSource):
    """``df.write.format("files")`` for rows ``(name string, content binary)``."""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def write_files(files: DataFrame, folder: str, mode: str = "append") -> None:
    """Write rows ``(name, content)`` as files in folders ``part-*`` below ``folder``, one for each task; no row reaches the
    driver. Names are file names without folders; within a task, a later row of one name replaces an earlier."""
    files.sparkSession.dataSource.register(FileSink)
    files.select("name", files["content"].cast("binary").alias("content")).write.format(SOURCE).mode(mode).save(folder)
