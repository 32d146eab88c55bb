"""Shared plumbing of the training-data operators: tables, staging in the shared folder, Arrow loops."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder (as a URI or path) that driver and executors share.

    The cluster names its shared folder in ``spark.checkpoint.dir``; only where that is
    unset and the session is local, as in tests, a temporary folder of this machine is set and used.
    """
    key = "spark.checkpoint.dir"
    root = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{key} must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set(key, root)
    return f"{root.rstrip('/')}/tessella-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write to the shared folder as Parquet and read that back."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(col: str, modulus: int):
    """crc32 of the id as text, modulo; null for a null id."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(modulus)).cast("int")


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the number of groups that keyed Python stages are dealt into."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def arrow_map(df: DataFrame, fn: Callable, schema: str | T.StructType) -> DataFrame:
    """mapInArrow with a function from an iterator of record batches to an iterator of dicts of columns."""
    target = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, target)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose ``column`` holds about ``most_bytes`` at most (one row may exceed it)."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


import pyarrow.compute  # noqa: E402,F401
