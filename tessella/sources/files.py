"""Files as executors see them: opening by path or URI, and dealing lists of files to tasks by bytes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle

#: Bytes of files that one task reads (a larger file is one task's alone), and bytes read at once.
TASK_BYTES, CHUNK = 256 << 20, 4 << 20
#: Bytes that could be hashed while a file is opened: what a file counts besides its own.
OPENING = 16 << 10


def opened(uri: str):
    """(file system, path) of a path or URI, whether percent-encoded or not, as executors on any machine see it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        path = re.sub("^file:/+", "/", uri)
        local = fs.LocalFileSystem()
        return (local, path) if "%" not in path or local.get_file_info(path).type != fs.FileType.NotFound else (local, unquote(path))
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def by_bytes(files: DataFrame, length: str = "length", task_bytes: int = TASK_BYTES) -> DataFrame:
    """The rows dealt to tasks by bytes: a task has less than ``task_bytes`` besides its last file.

    Rows are summed within the partitions they come in and placed behind the partitions before, so
    the list of files is shuffled once and gathered nowhere. A larger file counts as ``task_bytes``, so
    there are no more tasks than files.
    """
    dealt = settle(files.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()))
    size = F.least(F.coalesce(F.col(length), F.lit(0)), F.lit(task_bytes))
    sums = dealt.groupBy("__p").agg(F.sum(size).alias("__s"))
    before = sums.select("__p", F.coalesce(F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    total = sums.agg(F.coalesce(F.sum("__s"), F.lit(0)).alias("n")).first().n
    tasks = max(1, -(-total // task_bytes))
    running = F.coalesce(F.sum(size).over(Window.partitionBy("__p").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.join(before, "__p").withColumn("__t", F.least(F.floor((F.col("__b") + running) / task_bytes), F.lit(tasks - 1)).cast("int"))
    return placed.repartitionById(tasks, "__t").drop("__p", "__i", "__b", "__t")


def chunks(uri: str) -> Iterator[bytes]:
    filesystem, path = opened(uri)
    with filesystem.open_input_stream(path, compression=None) as f:
        while block := f.read(CHUNK):
            yield block


def arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with a function from an iterator of record batches to an iterator of dicts of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = T._parse_datatype_string(schema)
    fields = to_arrow_schema(target)

    def run(batches):
        for columns in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in fields], schema=fields)

    return df.mapInArrow(run, target)


def digests(files: DataFrame, path: str = "path", length: str = "length", task_bytes: int = TASK_BYTES) -> DataFrame:
    """(path, sha256, read) of each listed file, read as a stream on the executors; ``read`` is the number of bytes met."""

    def run(batches):
        for b in batches:
            for name in b.column("path").to_pylist():
                h, n = hashlib.sha256(), 0
                for block in chunks(name):
                    h.update(block)
                    n += len(block)
                yield {"path": [name], "sha256": [h.hexdigest()], "read": [n]}

    dealt = by_bytes(files.select(F.col(path).alias("path"), (F.coalesce(F.col(length), F.lit(0)) + OPENING).alias("length")), task_bytes=task_bytes)
    return arrow(dealt.select("path"), run, "path string, sha256 string, read long")
