"""Session factory: the settings the engine's semantics and plans rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution, last-wins duplicate JSON keys; further settings by keyword with underscores for dots."""
    b = SparkSession.builder.appName("tessella")
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.variant.allowDuplicateKeys": "true",
    }
    for k, v in {**settings, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share, which the cluster names in ``spark.checkpoint.dir``.

    Only a session on this machine alone may lack that setting, as in tests: a temporary folder serves then.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessella-")
    return f"{root.rstrip('/')}/settled-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: one dealing of the rows for all that follows, whatever executors are lost."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over four tasks a core where they come in fewer, for work that is dear by row, so that none is the last for long; a larger input stays as it is."""
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)
