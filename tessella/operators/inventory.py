"""Inventories: required against present, references against assets, equality, contiguity, chunks, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle


def missing(required: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Required rows without a present one; null keys never match and so are missing."""
    return required.join(present.select(*keys).distinct(), keys, "left_anti")


def positions(n: Column) -> Column:
    """1..n, and nothing for n below 1 (a sequence from 1 to 0 would run backwards)."""
    return F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))


def expected_positions(df: DataFrame, keys: list[str], n: str, name: str = "index") -> DataFrame:
    return df.select(*keys, F.explode(positions(F.col(n))).alias(name))


def unknown_references(refs: DataFrame, known: DataFrame, ref: str, key: str) -> DataFrame:
    return refs.join(known.select(F.col(key).alias(ref)).distinct(), ref, "left_anti")


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): the symmetric difference of two key sets, null keys included."""
    a = left.select(F.col(key)).distinct().withColumn("__l", F.lit(True))
    b = right.select(F.col(key)).distinct().withColumn("__r", F.lit(True))
    a, b = a.alias("a"), b.alias("b")
    both = a.join(b, F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "full_outer")
    return both.where("__l is null or __r is null").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), F.when(F.col("__r").isNull(), "left").otherwise("right").alias("side"))


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side, rows): keys that one of two tables has and the other lacks, with their rows there; null keys match nothing. One grouping of both, without a join."""
    both = left.select(F.col(key), F.lit(1).alias("__l"), F.lit(0).alias("__r")).unionByName(right.select(F.col(key), F.lit(0).alias("__l"), F.lit(1).alias("__r")))
    n = both.groupBy(key).agg(F.sum("__l").alias("__l"), F.sum("__r").alias("__r"))
    alone = lambda own, other, side: F.when((F.col(own) > 0) & (F.col(key).isNull() | (F.col(other) == 0)), F.struct(F.lit(side).alias("side"), F.col(own).alias("rows")))
    return n.select(key, F.explode(F.array_compact(F.array(alone("__l", "__r", "left"), alone("__r", "__l", "right")))).alias("x")).select(key, "x.side", "x.rows")


def sets_equal(left: DataFrame, right: DataFrame, key: str) -> bool:
    return difference(left, right, key).isEmpty()


def members(df: DataFrame, keys: list[str], order: str, value: str, name: str = "members") -> DataFrame:
    """Per key the values in order, as an array (ties by value)."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias(name))


def contiguity(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """keys, n, distinct_positions, lowest, highest, contiguous: are positions 1..n, each once?"""
    out = df.groupBy(*keys).agg(F.count(position).alias("n"), F.count_distinct(position).alias("distinct_positions"), F.min(position).alias("lowest"), F.max(position).alias("highest"))
    return out.withColumn("contiguous", (F.col("lowest") == 1) & (F.col("highest") == F.col("n")) & (F.col("n") == F.col("distinct_positions")))


def ambiguous_positions(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    return df.groupBy(*keys, position).count().where("count > 1")


def numbered(df: DataFrame, order: list[str | Column], name: str = "number", parts: list[str] | None = None) -> DataFrame:
    """1-based number of each row by a total order, within ``parts``; over all rows without one task sorting them all.

    Rows are range-partitioned, counted per partition, and numbered within it behind the partitions before.
    """
    if parts:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*parts).orderBy(*order)))
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id() % (1 << 33) + 1)
    dealt = settle(dealt)  # numbers and counts must see one and the same dealing
    counts = dealt.groupBy("__p").count()
    before = counts.withColumn("__b", F.coalesce(F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return dealt.join(F.broadcast(before), "__p").withColumn(name, F.col("__b") + F.col("__i")).drop("__p", "__i", "__b")


def chunks(df: DataFrame, order: str, value: str, size: int) -> DataFrame:
    """(chunk, members): values in order, ``size`` to a chunk, chunks from 1."""
    n = numbered(df.select(order, value), [order], "__n")
    return n.groupBy((F.floor((F.col("__n") - 1) / size) + 1).cast("long").alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", value))), lambda x: x[value]).alias("members"))


def with_status(df: DataFrame, gaps: DataFrame, key: str, name: str = "status") -> DataFrame:
    """'incomplete' where the key has any gap, else 'complete'."""
    marks = gaps.select(F.col(key)).distinct().withColumn("__gap", F.lit(True))
    return df.join(marks, key, "left").withColumn(name, F.when(F.col("__gap"), "incomplete").otherwise("complete")).drop("__gap")


def overlay(base: DataFrame, over: DataFrame, keys: list[str], defaults: dict[str, Column]) -> DataFrame:
    """base with the columns of ``defaults`` from ``over`` where it has the key, else the default."""
    picked = over.select(*keys, *(F.col(c).alias(f"__{c}") for c in defaults), F.lit(True).alias("__has"))
    joined = base.join(picked, keys, "left")
    for c, d in defaults.items():
        joined = joined.withColumn(c, F.when(F.col("__has"), F.col(f"__{c}")).otherwise(d))
    return joined.drop("__has", *(f"__{c}" for c in defaults))


def key_check(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows, distinct keys, unique."""
    g = df.groupBy(*keys).count()
    return g.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_keys")).withColumn("unique", F.col("rows") == F.col("distinct_keys"))


def fingerprint(df: DataFrame, keys: list[str], name: str, digest: str, bucket: Column | None = None) -> DataFrame:
    """Per key one SHA-256 over its members, as a tree of two levels: sorted (name:digest) in each of at most 65,536
    buckets, then the buckets' digests in order. No key gathers its members in one place, however many it has."""
    pair = F.concat_ws(":", F.col(name).cast("string"), digest)
    bucket = F.pmod(F.xxhash64(name), F.lit(65536)) if bucket is None else bucket
    leaves = df.groupBy(*keys, bucket.alias("__b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(pair)), "\n").cast("binary"), 256).alias("__h"))
    return leaves.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__b", "__h"))), lambda x: x["__h"]), "\n").cast("binary"), 256).alias("fingerprint"))
