"""Batch files as they arrive: an available-now stream, merged idempotently by batch and content, and first-wins with conflicts kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow.fs import FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.variants import canonical
from ..plans.normalize import is_error, normalize
from ..session import shared_folder
from ..sinks.lines import publish, write_parts
from ..sources.files import opened

#: Where a line stands: its file, the byte range it was read in, and its place among that range's lines.
POSITION = ["file", "block", "place"]


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """(file, block, raw_json): a stream of the JSON lines of files that arrive in a folder."""
    lines = spark.readStream.text(folder)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("raw_json")).where(F.trim("raw_json") != "")


def placed(batch: DataFrame) -> DataFrame:
    """A batch's rows with ``place``: a task reads a range's lines in order, so later lines of a range have larger places."""
    return batch.withColumn("place", F.monotonically_increasing_id())


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str) -> int:
    """Take in all that is there, then stop; a batch that is delivered again overwrites its own partition. Returns the batches done."""
    done = []

    def merge(batch: DataFrame, number: int) -> None:
        rows = placed(batch).withColumn("raw", F.try_parse_json("raw_json")).where("raw is not null")
        rows = rows.where(~F.coalesce(is_error(F.col("raw")), F.lit(False)))
        normalize(rows).drop("raw").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")
        done.append(number)

    arriving(spark, folder).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return len(done)


def take_batch(items: DataFrame, number: int, arrivals: str, target: str, checkpoint: str) -> str:
    """Take in the items (raw_json) of one finished provider batch; returns the digest of its lines.

    The batch becomes one file of the arrivals, named by its number and its content, and goes the way of all files
    there: a batch that is given again, after whatever failure, is the same file and is not taken twice.
    """
    spark, staging = items.sparkSession, shared_folder(items.sparkSession)
    write_parts(items.select("raw_json").orderBy("raw_json"), f"{staging}/parts")
    done = publish(spark, [(f"{staging}/parts", f"{staging}/batch", b"")]).first()
    filesystem, folder = opened(arrivals)
    filesystem.create_dir(folder, recursive=True)
    path = f"{folder}/batch-{number:06d}-{done.sha256[:24]}.jsonl"
    if filesystem.get_file_info(path).type == FileType.NotFound:
        filesystem.move(opened(f"{staging}/batch")[1], path)
    ingest(spark, arrivals, target, checkpoint)
    return done.sha256


def posts(spark: SparkSession, target: str) -> DataFrame:
    """The merged table: per account and post the row of the first batch, file and line."""
    from ..operators.dedup import first_wins

    rows = spark.read.parquet(f"{target}/batch=*").withColumn("__k", F.lower("account"))
    return first_wins(rows, ["__k", "post_id"], ["batch", *POSITION]).drop("__k")


# first wins as state ---------------------------------------------------------------------------

OUTCOME = "key string, post_id string, new boolean, payload string, rows long, conflict boolean"
#: Spark's state store that keeps typed state.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstWins(StatefulProcessor):
    """Per post the digest of its first payload; a micro-batch's rows of a post come out as one row: is it new, its payload then, how many rows, does any differ from the first.

    Within a micro-batch the first row is that of the least position; across micro-batches the earlier one was
    first, so what comes late never takes a post over. Memory is one row a post, however often it repeats.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "digest string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.first.get()[0] if self.first.exists() else None
        best, payload, n, low, high = None, None, 0, None, None
        for part in rows:
            n += len(part)
            a, b = part.digest.min(), part.digest.max()
            low, high = a if low is None else min(low, a), b if high is None else max(high, b)
            if known is None:
                row = part.sort_values(["position", "digest"], kind="stable").iloc[0]
                if best is None or (row.position, row.digest) < best:
                    best, payload = (row.position, row.digest), row.payload
        if best is not None:
            self.first.update((best[1],))
        first = known if best is None else best[1]
        yield pd.DataFrame({"key": [key[0]], "post_id": [key[1]], "new": [best is not None], "payload": [payload], "rows": [n], "conflict": [low != first or high != first]})

    def close(self) -> None:
        pass


def first_wins_stream(rows: DataFrame, position: list[str]) -> DataFrame:
    """What a stream of posts (account, post_id, payload, and the columns of ``position``) holds, per micro-batch and post: see ``FirstWins``.

    Keys are the lower-cased account and the post id; positions (whole numbers or text) are compared column by column. Null payloads are equal
    to the text null.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    place = F.concat_ws("/", *(F.lpad(F.col(c).cast("string"), 20, "0") if rows.schema[c].dataType.typeName() != "string" else F.col(c) for c in position))
    keyed = rows.select(F.lower("account").alias("key"), "post_id", "payload", F.sha2(F.coalesce("payload", F.lit("null")), 256).alias("digest"), place.alias("position"))
    return keyed.groupBy("key", "post_id").transformWithStateInPandas(FirstWins(), outputStructType=OUTCOME, outputMode="Append", timeMode="None")


def deduplicate(spark: SparkSession, source: DataFrame, position: list[str], target: str, checkpoint: str) -> None:
    """Run ``first_wins_stream`` over all that is there, adding what it says to the table at ``target``; a micro-batch that is run again is written once."""
    first_wins_stream(source, position).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def outcome(spark: SparkSession, target: str) -> DataFrame:
    """(key, post_id, payload, rows, conflict) of every post so far: the first payload, rows met, and whether any differed."""
    t = spark.read.schema(OUTCOME).parquet(target)
    return t.groupBy("key", "post_id").agg(F.max_by("payload", "new").alias("payload"), F.sum("rows").alias("rows"), F.bool_or("conflict").alias("conflict"))


def payloads(items: DataFrame) -> DataFrame:
    """Raw items with their payload column: JSON with sorted keys, equal for equal content."""
    return items.withColumn("payload", canonical(F.try_parse_json("raw_json")))
