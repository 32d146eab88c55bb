"""What identifies a capture: the digests of its files, kept so that a later look hashes only what changed, and one digest over them."""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from .files import arrow, digests
from .text import listed

#: The files of a capture, by their paths below its folder.
PARTS = r"^(posts/[^/]+[.]jsonl|normalized/[^/]+[.]jsonl|profiles/[^/]+[.]json|run_info[.]json|manifest[.]json)$"
FILES = "relative string, path string, length long, modified timestamp, sha256 string"


class StateError(ValueError):
    """A checkpoint that can't be trusted, or a resume with another configuration."""


def fingerprint(value) -> str:
    """SHA-256 of a document's JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()


def known_digests(files: DataFrame, before: DataFrame | None) -> DataFrame:
    """FILES of a listing (relative, path, length, modified): digests of ``before`` where path, length and time of change agree, others read from the files."""
    if before is None:
        return files.join(digests(files).select("path", "sha256"), "path").select("relative", "path", "length", "modified", "sha256")
    same = files.join(before.select("relative", "length", "modified", "sha256"), ["relative", "length", "modified"], "left")
    old = same.where("sha256 is not null")
    new = same.where("sha256 is null").drop("sha256")
    return old.select("relative", "path", "length", "modified", "sha256").unionByName(known_digests(new, None))


def capture_files(spark: SparkSession, root: Path | str, before: DataFrame | None = None) -> DataFrame:
    """FILES of a capture's posts, normalised rows, profiles, run record and manifest; links are refused."""
    base = Path(root).resolve().as_posix()
    files = listed(spark, base).withColumn("relative", F.expr(f"substring_index(path, '{base}/', -1)")).where(F.col("relative").rlike(PARTS))
    files = files.select("relative", "path", "length", F.col("modificationTime").alias("modified"))

    def links(batches):
        for b in batches:
            found = [x for x in b.column("relative").to_pylist() if os.path.islink(f"{base}/{x}")]
            yield {"relative": found}

    if not arrow(files.select("relative"), links, "relative string").isEmpty():
        raise StateError("unsafe capture file")
    return settle(known_digests(files, before))


def digest_of(files: DataFrame) -> str:
    """One digest over all files: of the JSON object of their paths, sorted, and digests. One task streams the sorted list, and holds a batch of it."""

    def run(batches):
        h, n = hashlib.sha256(b"{"), 0
        for b in batches:
            for name, digest in zip(b.column("relative").to_pylist(), b.column("sha256").to_pylist(), strict=True):
                h.update(f"{', ' if n else ''}{json.dumps(name, ensure_ascii=False)}: {json.dumps(digest)}".encode())
                n += 1
        h.update(b"}")
        yield {"digest": [h.hexdigest()]}

    return arrow(files.select("relative", "sha256").orderBy("relative").coalesce(1), run, "digest string").first().digest


def capture_fingerprint(root: Path | str, spark: SparkSession | None = None, keep: str | None = None) -> str:
    """The capture's digest. With ``keep``, a folder, the files' digests stay there, and only files that have changed since are read again."""
    spark = spark or SparkSession.active()
    mark = Path(keep, "LATEST") if keep else None
    before = spark.read.schema(FILES).parquet(f"{keep}/{mark.read_text()}") if mark and mark.exists() else None
    files = capture_files(spark, root, before)
    if files.where(F.col("relative").startswith("posts/")).isEmpty():
        raise StateError("the capture has no post files")
    found = digest_of(files)
    if mark:
        version = f"{int(mark.read_text()) + 1:06d}" if mark.exists() else "000001"
        files.coalesce(1).write.mode("overwrite").parquet(f"{keep}/{version}")  # a row a file of the capture
        scratch = mark.with_name(f".LATEST.{os.getpid()}")
        scratch.write_text(version)
        os.replace(scratch, mark)
    return found
