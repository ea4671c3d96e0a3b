"""Exports as files: a data source that writes a named file for each document, and reads them back."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .shared import HELD, parts

SCHEMA = "doc_id string, name string, body string"
#: What tells how each file came out, beside the files; and where a task's files wait until all tasks are done.
OUTCOMES, WAITING = "outcomes.jsonl", "_waiting"
#: Characters that a batch of read files holds, but for its last file.
MOST = 4_000_000


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Part(WriterCommitMessage):
    """A task's folder of files, under the waiting ones."""

    folder: str
    files: int
    failed: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex[:12]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        """Write a task's files to a folder of this attempt alone. A file that cannot be written is told of in the outcomes."""
        fs, root = _place(self.path)
        folder = f"part-{uuid.uuid4().hex}"
        home = posixpath.join(root, WAITING, self.run, folder)
        fs.create_dir(home, recursive=True)
        files = failed = 0
        with fs.open_output_stream(posixpath.join(home, OUTCOMES)) as told:
            for b in parts(batches):
                for doc_id, name, body in zip(*[b.column(c).to_pylist() for c in ("doc_id", "name", "body")], strict=True):
                    raw, error = (body or "").encode("utf-8", "replace"), None
                    try:
                        at = _inside(home, doc_id, name)
                        if fs.get_file_info(at).type != pafs.FileType.NotFound:
                            raise OSError(f"there is a file of this name already: {name}")
                        fs.create_dir(posixpath.dirname(at), recursive=True)
                        with fs.open_output_stream(at) as f:
                            f.write(raw)
                        files += 1
                    except (OSError, ValueError) as e:  # the row says so
                        error, failed = str(e), failed + 1
                    told.write((json.dumps({"doc_id": doc_id, "name": name, "bytes": None if error else len(raw), "error": error}) + "\n").encode())
        return Part(folder, files, failed)

    def commit(self, messages: list[Part | None]) -> None:
        """Move each task's folder to its place: one move a task, whatever the number of its files."""
        fs, root = _place(self.path)
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(root)):
                if f.base_name.startswith("part-"):
                    fs.delete_dir(f.path)
        for m in messages:
            if m is not None:
                fs.move(posixpath.join(root, WAITING, self.run, m.folder), posixpath.join(root, m.folder))
        self._clear(fs, root)

    def abort(self, messages: list[Part | None]) -> None:
        """Leave nothing of a run that failed."""
        self._clear(*_place(self.path))

    def _clear(self, fs: pafs.FileSystem, root: str) -> None:
        for folder in (posixpath.join(root, WAITING, self.run), posixpath.join(root, WAITING)):
            if fs.get_file_info(folder).type == pafs.FileType.Directory and (folder.endswith(self.run) or not fs.get_file_info(pafs.FileSelector(folder))):
                fs.delete_dir(folder)


def _inside(home: str, doc_id: str | None, name: str | None) -> str:
    """Where a document's file lies: in a folder of the document, which names it by its id's UTF-8 in hexadecimal."""
    if not name or "/" in name or "\0" in name or name in (".", ".."):
        raise ValueError(f"no name for a file: {name!r}")
    return posixpath.join(home, "null" if doc_id is None else "id-" + doc_id.encode("utf-8", "replace").hex(), name)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["doc_id", "name", "body"])


@dataclass
class Folder(InputPartition):
    path: str
    value: str = field(default="")


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Folder]:
        """A partition for each part: as many as the write had tasks."""
        fs, root = _place(self.path)
        return [Folder(f.path) for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.base_name.startswith("part-")] or [Folder("")]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        """Files in batches of up to HELD files and about 4 MB: as rows, Spark would hold 10,000 of them as objects."""
        if not partition.path:
            return
        fs, _ = _place(self.path)
        held, room = [], 0
        for f in fs.get_file_info(pafs.FileSelector(partition.path, recursive=True)):
            folder = posixpath.basename(posixpath.dirname(f.path))
            if f.type == pafs.FileType.File and folder != posixpath.basename(partition.path):
                doc_id = None if folder == "null" else bytes.fromhex(folder[3:]).decode("utf-8", "replace")
                with fs.open_input_stream(f.path) as s:
                    held.append((doc_id, f.base_name, s.read().decode("utf-8", "replace")))
                room += len(held[-1][2])
                if len(held) >= HELD or room >= MOST:
                    yield _batch(held)
                    held, room = [], 0
        if held:
            yield _batch(held)


class ExportSource(DataSource):
    """Files of documents under a folder: ``df.write.format("quire_exports").mode("append").save(path)``.

    Rows are (doc_id, name, body). A run that fails leaves no file; one file that cannot be written (a name that is none,
    is too long or is taken) is a row of :func:`outcomes`.
    """

    @classmethod
    def name(cls) -> str:
        return "quire_exports"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: object, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)

    def reader(self, schema: object) -> _Reader:
        return _Reader(self.options["path"])


def write(bodies: DataFrame, path: str, mode: str = "append") -> None:
    """Write ``bodies`` (doc_id, name, body) as files under ``path``, in as many parts as there are partitions."""
    bodies.sparkSession.dataSource.register(ExportSource)
    bodies.selectExpr("cast(doc_id as string) as doc_id", "name", "body").write.format("quire_exports").mode(mode).save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, name, body of the files under ``path``."""
    spark.dataSource.register(ExportSource)
    return spark.read.format("quire_exports").load(path)


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, name, bytes, error of every row that was written to ``path``; bytes are null where there is an error."""
    return spark.read.schema("doc_id string, name string, bytes long, error string").json(f"{path}/part-*/{OUTCOMES}")
