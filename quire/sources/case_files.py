"""Files of cases on disk: a data source writer with a staging folder for each task and one commit.

``rows`` (folder, file_name, content) become ``path``/folder/file_name with exactly the bytes of ``content``. A task writes below a
hidden folder of its own attempt; the driver moves what the attempts that count have written when all are done, and deletes the rest. So readers
see a file whole or not at all, a task that failed or ran twice leaves nothing, and a job that failed leaves no file.

Null contents are empty files. A name that is null, empty, or would leave its folder, and a file that one task writes twice, are errors of the job. Files of
earlier runs stay (a file of the same name is replaced), or go with ``overwrite``. Paths may be of any file system that Arrow knows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT, MOVERS = "casefiles", 16


@dataclass
class Staged(WriterCommitMessage):
    """What one task wrote."""

    folder: str
    files: int


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


class CaseFilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Staged:
        store, root = _place(self.path)
        task = TaskContext.get()
        mine, seen, folders = f"{root}/.staging-{self.run}/{task.partitionId()}-{task.taskAttemptId()}", set(), set()
        try:
            for row in iterator:
                names = row["folder"], row["file_name"]
                if any(not n or n in (".", "..") or "/" in n or n.startswith(".staging-") for n in names) or names in seen:
                    raise ValueError(f"no name for a file, or one given twice: {names}")
                if names[0] not in folders:
                    store.create_dir(f"{mine}/{names[0]}")
                seen.add(names)
                folders.add(names[0])
                with store.open_output_stream(f"{mine}/{names[0]}/{names[1]}") as out:
                    out.write(bytes(row["content"] or b""))
        except BaseException:
            if folders:
                store.delete_dir(mine)
            raise
        return Staged(mine, len(seen))

    def commit(self, messages: list) -> None:
        store, root = _place(self.path)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if old.type == fs.FileType.Directory and not old.base_name.startswith(".staging-"):
                    store.delete_dir(old.path)

        def place(folder: fs.FileInfo) -> None:
            target = f"{root}/{folder.base_name}"
            store.create_dir(target)
            for file in store.get_file_info(fs.FileSelector(folder.path)):
                store.move(file.path, f"{target}/{file.base_name}")

        with ThreadPoolExecutor(MOVERS) as movers:
            for m in messages:
                if m is not None and m.files:
                    list(movers.map(place, store.get_file_info(fs.FileSelector(m.folder))))
        self.abort(messages)

    def abort(self, messages: list) -> None:
        """Deletes what is staged; after a commit that is what no counted task wrote."""
        store, root = _place(self.path)
        staged = f"{root}/.staging-{self.run}"
        if store.get_file_info(staged).type != fs.FileType.NotFound:
            store.delete_dir(staged)


class CaseFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "folder string, file_name string, content binary"

    def writer(self, schema, overwrite: bool) -> CaseFilesWriter:
        return CaseFilesWriter(self.options["path"], overwrite)


def write_files(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write ``rows`` (folder, file_name, content); those of a folder in one task, so that a folder is moved by one mover."""
    rows.sparkSession.dataSource.register(CaseFiles)
    own = rows.selectExpr("CAST(folder AS STRING) AS folder", "file_name", "content").repartition("folder")
    own.write.format(FORMAT).mode("overwrite" if overwrite else "append").option("path", path).save()


def folders(path: str) -> list[str]:
    """Names of the folders that were committed below ``path``."""
    store, root = _place(path)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.Directory and not f.base_name.startswith(".staging-"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """folder, file_name, content of the files below ``path``; Spark leaves empty ones out."""
    parts = "regexp_extract(path, '([^/]+)/([^/]+)$', {})"
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).selectExpr(f"{parts.format(1)} AS folder", f"{parts.format(2)} AS file_name", "content")
