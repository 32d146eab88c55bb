"""Ordered text files from DataFrames, without a row on the driver: a data sink with a commit protocol, and the joining of its parts.

Every task of ``line_parts`` writes its rows, in their order, to a part of its own and answers with
name, bytes, SHA-256 and number of lines. The committer writes these answers, in the order of the partitions, as the
parts' manifest, and removes what no answer names (attempts that were killed). A task that fails removes its
part, and a job that fails leaves no part: its folder is marked first and emptied then, and tasks that are still running
look for the mark once they have begun a part. ``publish`` joins the parts of several files, each in one
task that streams them, checks every part against its answer, hashes the whole, and
puts it in place by a move; a file's SHA-256 is sequential, so one file is one task's work, in memory of one chunk.

Rows without partitions (an empty table) give an empty file, or a header alone. Values may hold line
ends where the format quotes them (csv); for ``text`` a row is a line as it is, and null is an empty one.
"""

from __future__ import annotations

import contextlib
import csv
import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..sources.files import CHUNK, arrow, opened

FORMAT = "line_parts"
MANIFEST = "_manifest.json"
#: Left in a folder whose job has failed: tasks that still run meet it and remove what they have begun.
ABORTED = "_aborted"


class PartsError(ValueError):
    """Parts that are not what their tasks answered."""


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str | None
    size: int
    sha256: str
    lines: int


def _files(folder: str) -> list[tuple]:
    """(file system, path, name) of the files in a folder."""
    from pyarrow import fs

    filesystem, root = opened(folder)
    return [(filesystem, f.path, f.base_name) for f in filesystem.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.File]


def text_bytes(batch: pa.RecordBatch) -> bytes:
    return b"".join((v or "").encode("utf-8", "surrogatepass") + b"\n" for v in batch.column(0).to_pylist())


def csv_bytes(batch: pa.RecordBatch) -> bytes:
    out = io.StringIO(newline="")
    csv.writer(out).writerows(zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return out.getvalue().encode("utf-8", "surrogatepass")


def csv_header(columns: tuple[str, ...]) -> bytes:
    """A byte order mark and the columns' names."""
    out = io.StringIO(newline="")
    csv.writer(out).writerow(columns)
    return b"\xef\xbb\xbf" + out.getvalue().encode()


class LinePartsWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, kind: str):
        self.folder, self.kind = folder, kind

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        filesystem, root = opened(self.folder)
        filesystem.create_dir(root, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        encode = csv_bytes if self.kind == "csv" else text_bytes
        h, size, lines = hashlib.sha256(), 0, 0
        try:
            with filesystem.open_output_stream(f"{root}/{name}", compression=None) as out:
                if filesystem.get_file_info(f"{root}/{ABORTED}").type != FileType.NotFound:
                    raise PartsError("the job has failed")
                for batch in iterator:
                    data = encode(batch)
                    out.write(data)
                    h.update(data)
                    size, lines = size + len(data), lines + batch.num_rows
        except BaseException:
            with contextlib.suppress(FileNotFoundError):  # the job's end may have been first
                filesystem.delete_file(f"{root}/{name}")
            raise
        if not lines:
            filesystem.delete_file(f"{root}/{name}")
        return Written(part, name if lines else None, size, h.hexdigest(), lines)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        kept = sorted((m for m in messages if m is not None and m.name), key=lambda m: m.part)
        names = {m.name for m in kept}
        for filesystem, path, name in _files(self.folder):
            if name not in names:  # of an attempt that never answered
                filesystem.delete_file(path)
        filesystem, root = opened(self.folder)
        filesystem.create_dir(root, recursive=True)
        with filesystem.open_output_stream(f"{root}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps([[m.name, m.size, m.sha256, m.lines] for m in kept]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        filesystem, root = opened(self.folder)
        filesystem.create_dir(root, recursive=True)
        filesystem.open_output_stream(f"{root}/{ABORTED}", compression=None).close()
        for filesystem, path, name in _files(self.folder):
            if name != ABORTED:
                with contextlib.suppress(FileNotFoundError):  # its own task may have been first
                    filesystem.delete_file(path)


class LineParts(DataSource):
    """Options: path, a new folder; kind, text (one column) or csv."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> LinePartsWriter:
        return LinePartsWriter(self.options["path"], self.options.get("kind", "text"))


def write_parts(df: DataFrame, folder: str, kind: str = "text") -> None:
    """The rows, in their order, as parts in a new folder."""
    df.sparkSession.dataSource.register(LineParts)
    df.write.format(FORMAT).option("kind", kind).mode("append").save(folder)


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON object a row, nulls written out."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def publish(spark: SparkSession, files: list[tuple[str, str, bytes]]) -> DataFrame:
    """Join parts into files: (parts' folder, target, header) each. Returns file, bytes, sha256, lines of every target, all moved into place."""

    def run(batches):
        for b in batches:
            for folder, target, header in zip(*(b.column(c).to_pylist() for c in ("folder", "target", "header")), strict=True):
                source, root = opened(folder)
                with source.open_input_stream(f"{root}/{MANIFEST}", compression=None) as f:
                    parts = json.loads(f.read())
                sink, path = opened(target)
                sink.create_dir(path.rpartition("/")[0], recursive=True)
                scratch = f"{path}.{uuid.uuid4().hex}.tmp"
                whole, size, lines = hashlib.sha256(header), len(header), 0
                try:
                    with sink.open_output_stream(scratch, compression=None) as out:
                        out.write(header)
                        for name, told, digest, n in parts:
                            own, met = hashlib.sha256(), 0
                            with source.open_input_stream(f"{root}/{name}", compression=None) as f:
                                while block := f.read(CHUNK):
                                    out.write(block)
                                    own.update(block)
                                    whole.update(block)
                                    met += len(block)
                            if (met, own.hexdigest()) != (told, digest):
                                raise PartsError(f"{name} of {target} differs from what its task wrote")
                            size, lines = size + met, lines + n
                except BaseException:
                    sink.delete_file(scratch)
                    raise
                sink.move(scratch, path)
                yield {"file": [target], "bytes": [size], "sha256": [whole.hexdigest()], "lines": [lines]}

    rows = spark.createDataFrame(files, "folder string, target string, header binary").repartition(max(1, len(files)))
    out = arrow(rows, run, "file string, bytes long, sha256 string, lines long").collect()  # a row a file
    return spark.createDataFrame(out, "file string, bytes long, sha256 string, lines long")
