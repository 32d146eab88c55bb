"""Hash trees of keyed rows, kept as tables: comparing two of them reads only what differs.

A row's leaf is its key and the digest of its payload. Leaves lie in groups by a hash of the key, groups in
buckets, buckets under one root; a group's digest covers its sorted leaves, a bucket's its groups,
the root's its buckets. The number of groups follows the number of rows, so that none gathers more than some
thousands of leaves, and is kept by later versions of the same tree. Leaves are stored by bucket: a comparison
reads the buckets' digests, of differing buckets the groups', and of differing groups the leaves.

Keys are compared as text, null keys apart from all others; a key with several rows is one leaf, whose digest adds up
those of its rows (in no order, aggregated before they are shuffled, so a very common key is gathered nowhere). Null
payloads are equal to one another only. An empty table has a root as well. All digests are SHA-256.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle

BUCKETS = 256
#: Leaves of a group on average.
GROUP_ROWS = 2048


@dataclass
class Tree:
    """A stored tree: leaves (bucket, grp, key, digest), groups (bucket, grp, digest), buckets (bucket, digest)."""

    spark: SparkSession
    folder: str

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    @property
    def leaves(self) -> DataFrame:
        return self._table("leaves", "grp int, key string, digest string, bucket int")

    @property
    def groups(self) -> DataFrame:
        return self._table("groups", "grp int, digest string, bucket int")

    @property
    def buckets(self) -> DataFrame:
        return self._table("buckets", "bucket int, digest string")

    @property
    def width(self) -> int:
        """Groups of a bucket."""
        return self.spark.read.parquet(f"{self.folder}/meta").first().width

    @property
    def root(self) -> str:
        return self.spark.read.parquet(f"{self.folder}/meta").first().root


def _over(df: DataFrame, keys: list[str], name: Column, digest: str) -> DataFrame:
    """The digest of each group's sorted members."""
    pair = F.concat_ws(":", name, F.col(digest))
    return df.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(pair)), "\n").cast("binary"), 256).alias("digest"))


def _nodes(spark: SparkSession, folder: str, width: int) -> Tree:
    """Groups, buckets and root over the leaves in a folder."""
    tree = Tree(spark, folder)
    _over(tree.leaves, ["bucket", "grp"], F.coalesce(F.sha2("key", 256), F.lit("")), "digest").write.parquet(f"{folder}/groups")
    _over(tree.groups, ["bucket"], F.col("grp").cast("string"), "digest").write.parquet(f"{folder}/buckets")
    root = _over(tree.buckets.withColumn("one", F.lit(1)), ["one"], F.col("bucket").cast("string"), "digest").select("digest")
    found = root.first()
    spark.createDataFrame([(width, found.digest if found else "")], "width int, root string").coalesce(1).write.parquet(f"{folder}/meta")
    return tree


def build(rows: DataFrame, key: str, digest: str, folder: str, like: Tree | None = None, group_rows: int = GROUP_ROWS) -> Tree:
    """Store the tree of rows (key, digest of the payload) in a new folder; ``like`` is an earlier version, whose shape it takes."""
    own = F.coalesce(F.col(digest).cast("string"), F.lit("null"))
    slices = [F.sum(F.conv(F.substring(F.sha2(own, 256), 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(5)]
    rows = rows.groupBy(F.col(key).cast("string").alias("key")).agg(F.when(F.count("*") == 1, F.max(own)).otherwise(F.concat_ws(".", F.count("*").cast("string"), *slices)).alias("digest"))
    rows = settle(rows)
    width = like.width if like else max(1, -(-rows.count() // (BUCKETS * group_rows)))
    h = F.xxhash64(F.coalesce(F.concat(F.lit("k"), "key"), F.lit("")))
    place = F.pmod(h, F.lit(BUCKETS * width))
    leaves = rows.select(F.floor(place / width).cast("int").alias("bucket"), F.pmod(place, F.lit(width)).cast("int").alias("grp"), "key", "digest")
    leaves.repartition("bucket").sortWithinPartitions("bucket", "grp").write.partitionBy("bucket").parquet(f"{folder}/leaves")
    return _nodes(rows.sparkSession, folder, width)


def differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of nodes that only one side has or whose digests differ."""
    x, y = a.select(*keys, F.col("digest").alias("__a")), b.select(*keys, F.col("digest").alias("__b"))
    return x.join(y, keys, "full_outer").where(~F.col("__a").eqNullSafe(F.col("__b"))).select(*keys)


def changes(old: Tree, new: Tree) -> DataFrame:
    """(key, change) with change added, removed or changed. Buckets that differ are at most BUCKETS numbers, so the leaves' folders are chosen by them before any leaf is read."""
    if old.root == new.root:
        return old.leaves.limit(0).select("key", F.lit("").alias("change"))
    buckets = [r.bucket for r in differing(old.buckets, new.buckets, ["bucket"]).collect()]
    here = F.col("bucket").isin(buckets)
    groups = differing(old.groups.where(here), new.groups.where(here), ["bucket", "grp"])
    side = lambda t, name: t.leaves.where(here).join(groups, ["bucket", "grp"], "left_semi").select("key", F.col("digest").alias(name))
    both = side(old, "a").alias("o").join(side(new, "b").alias("n"), F.col("o.key").eqNullSafe(F.col("n.key")), "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select(F.coalesce("o.key", "n.key").alias("key"), change.alias("change")).where("change is not null")
