"""A long history of keyed payloads, stored by key so that what arrives is checked against it without moving it.

The history is a table of keys and payload digests, bucketed and sorted by key: a check deals the arriving rows to the
same buckets and joins there, so the history is read and never shuffled, whatever its size. Arriving rows of one key are
first brought together (pre-aggregated, a row a key), so a very common key is one row of the join.

Null payloads are equal to one another only; null keys equal null keys. Rows that are added must have no
outcome ``conflict``; an empty history makes everything new.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def digests(rows: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Per key (null keys as the text of a null): rows, least and largest payload digest."""
    digest = F.sha2(F.coalesce(F.concat(F.lit("v"), F.col(payload).cast("string")), F.lit("")), 256)
    # join keys never are null, so that null keys meet
    own = [F.coalesce(F.concat(F.lit("k"), F.col(k).cast("string")), F.lit("")).alias(k) for k in keys]
    return rows.select(*own, digest.alias("d")).groupBy(*keys).agg(F.count("*").alias("rows"), F.min("d").alias("low"), F.max("d").alias("high"))


@dataclass
class History:
    spark: SparkSession
    table: str
    keys: list[str]
    buckets: int

    @classmethod
    def create(cls, rows: DataFrame, keys: list[str], payload: str, folder: str, buckets: int = 256) -> History:
        """Store rows, of which each key has one payload, as a new table in a folder of the shared store."""
        made = cls(rows.sparkSession, f"history_{uuid.uuid4().hex}", keys, buckets)
        made._write(digests(rows, keys, payload).select(*keys, F.col("low").alias("digest")), folder)
        return made

    def _write(self, rows: DataFrame, folder: str | None = None) -> None:
        w = rows.repartition(self.buckets, *self.keys).write.format("parquet").bucketBy(self.buckets, *self.keys).sortBy(*self.keys)
        (w.option("path", folder) if folder else w.mode("append")).saveAsTable(self.table)

    def outcomes(self, rows: DataFrame, payload: str) -> DataFrame:
        """Per key that arrives: rows, and status: ``conflict`` (payloads that differ among themselves or from the history), ``duplicate`` or ``new``."""
        known = self.spark.table(self.table).withColumnRenamed("digest", "known")
        joined = digests(rows, self.keys, payload).join(known.hint("merge"), self.keys, "left")
        differs = (F.col("low") != F.col("high")) | (F.col("known").isNotNull() & (F.col("known") != F.col("low")))
        status = F.when(differs, "conflict").when(F.col("known").isNotNull(), "duplicate").otherwise("new")
        shown = [F.when(F.col(k) != "", F.substring(F.col(k), 2, 1 << 30)).alias(k) for k in self.keys]
        return joined.select(*shown, "rows", status.alias("status"), "low")

    def add(self, rows: DataFrame, payload: str) -> None:
        """Take the new keys of rows into the table."""
        o = self.outcomes(rows, payload).where("status = 'new'")
        self._write(o.select(*(F.coalesce(F.concat(F.lit("k"), k), F.lit("")).alias(k) for k in self.keys), F.col("low").alias("digest")))
