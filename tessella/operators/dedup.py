"""Deduplication by key: first wins, last wins, and identical-or-conflict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ConflictError(ValueError):
    """Rows of one key with different payloads."""


def first_wins(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key by a total order. The limit is applied before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: a maximum that is pre-aggregated, without sorting."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(row).select(*keys, "__row.*").select(*df.columns)


def duplicates(df: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """keys, rows, payloads: keys with several rows, and how many different payloads they have."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_distinct(F.coalesce(F.col(payload), F.lit("null"))).alias("payloads")).where("rows > 1")


def conflicts(df: DataFrame, keys: list[str], payload: str) -> DataFrame:
    return duplicates(df, keys, payload).where("payloads > 1")


def collapse_or_fail(df: DataFrame, keys: list[str], payload: str, order: list[str | Column]) -> DataFrame:
    """First of identical rows; a conflict fails at once (an eager check: lazy assertions are pruned)."""
    bad = conflicts(df, keys, payload).select(*keys).limit(5).collect()  # a report of five
    if bad:
        raise ConflictError("conflicting rows for " + "; ".join(str(tuple(r)) for r in bad))
    return first_wins(df, keys, order)


def removed_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows the collapse takes away."""
    return df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("removed"))
