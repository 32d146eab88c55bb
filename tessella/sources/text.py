"""Scans of accounts, JSON lines (strict and tolerant), post folders, media files, checksums, media trees."""

from __future__ import annotations

import json
import logging
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import clean_handle
from ..functions.media import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS, extension
from ..functions.variants import is_object
from ..operators.dedup import first_wins
from ..session import settle
from .files import arrow, opened
from .ranges import numbered_lines

#: What text.splitlines() breaks lines at.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


class InputError(ValueError):
    """Input that a strict scan refuses."""


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): each file whole, without a byte order mark."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^﻿", "").alias("text"))


def accounts(spark: SparkSession, path: str) -> DataFrame:
    """(account, ord): cleaned handles, blank and # lines dropped, the first of each lower-cased handle."""
    lines = _whole(spark, path).select(F.posexplode(F.split("text", LINE_ENDS)).alias("ord", "line"))
    lines = lines.where((F.trim("line") != "") & ~F.trim("line").startswith("#"))
    cleaned = lines.select(clean_handle(F.col("line")).alias("account"), "ord").where("account <> ''")
    return first_wins(cleaned.withColumn("__k", F.lower("account")), ["__k"], ["ord"]).drop("__k")


def _json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, place, raw_json, raw, ok): non-blank lines, numbered from 1 among all lines of their file, and among the non-blank ones."""
    rows = numbered_lines(spark, path).withColumnRenamed("value", "raw_json").withColumn("line", F.col("line").cast("int"))
    rows = rows.withColumn("raw", F.try_parse_json("raw_json"))
    return rows.withColumn("ok", F.coalesce(is_object(F.col("raw")), F.lit(False)))


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Strict: any line that isn't a JSON object fails at once, named by file and line, its payload not shown."""
    rows = _json_lines(spark, path)
    bad = rows.where(~F.col("ok")).orderBy("file", "line").select("file", "line").limit(1).collect()
    if bad:
        raise InputError(f"{bad[0].file}:{bad[0].line}: not a JSON object")
    return rows.drop("ok")


def jsonl_tolerant(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): rejects are (file, line) of lines that aren't JSON objects."""
    rows = _json_lines(spark, path)
    return rows.where("ok").drop("ok"), rows.where("not ok").select("file", "line")


def with_record_numbers(rows: DataFrame) -> DataFrame:
    """record: 1-based number of each non-blank line within its file, as the scan has numbered it."""
    return rows.withColumn("record", F.col("place"))


def posts(spark: SparkSession, folder: str) -> DataFrame:
    """posts/*.jsonl with source file name, record number, and the file's stem as fallback account."""
    rows = with_record_numbers(jsonl(spark, f"{folder}/posts/*.jsonl"))
    name = F.regexp_extract("file", r"([^/]+)$", 1)
    return rows.withColumn("source_file", F.concat(F.lit("posts/"), name)).withColumn("stem", F.regexp_replace(name, r"\.jsonl$", ""))


def hidden(name: str) -> bool:
    """A component that Spark's file sources leave out."""
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modificationTime) of all files below a folder, those without bytes included; nothing is read of them.

    One task lists the folder itself, many the folders in it, each with all that is below; what they find is written, and none of it passes the driver.
    """
    from pyarrow import fs

    filesystem, base = opened(root)
    if filesystem.get_file_info(base).type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    local = isinstance(filesystem, fs.LocalFileSystem)
    base = (os.path.abspath(base) if local else base).rstrip("/")
    prefix = "file:" if local else root.rstrip("/").removesuffix(base)

    def files(found) -> dict:
        kept = [f for f in found if f.type == fs.FileType.File and (not f.size or not any(map(hidden, f.path.removeprefix(base).strip("/").split("/"))))]
        return {"path": [prefix + f.path for f in kept], "length": [f.size for f in kept], "modificationTime": [f.mtime for f in kept], "folder": [None] * len(kept)}

    def top(batches):
        for b in batches:
            for name in b.column("folder").to_pylist():
                own, _ = opened(root)
                at = own.get_file_info(name)
                found = own.get_file_info(fs.FileSelector(name)) if at.type == fs.FileType.Directory else [at]
                yield files(found)
                folders = [f.path for f in found if f.type == fs.FileType.Directory]
                yield {c: [None] * len(folders) for c in ("path", "length", "modificationTime")} | {"folder": folders}

    def below(batches):
        for b in batches:
            for name in b.column("folder").to_pylist():
                yield files(opened(root)[0].get_file_info(fs.FileSelector(name, recursive=True)))

    schema = "path string, length long, modificationTime timestamp, folder string"
    first = settle(arrow(spark.createDataFrame([(base or "/",)], "folder string").coalesce(1), top, schema))
    folders = first.where("folder is not null").select("folder")
    n, cores = folders.count(), spark.sparkContext.defaultParallelism
    deeper = arrow(folders.repartition(max(1, min(n, max(4 * cores, n // 256)))), below, schema)
    return first.where("folder is null").union(settle(deeper)).drop("folder")


def media_files(spark: SparkSession, root: str, verified: DataFrame | None = None) -> DataFrame:
    """(path, relative, account_dir, post_dir, name, length, modificationTime) of images and videos below root/<account>/<post>/.

    With an inventory (path, bytes, sha256) only listed files are read, with what it says of them
    (expected_bytes, expected_sha256) beside them.
    """
    df = listed(spark, root)
    parts = F.split(F.col("path"), "/")
    at = F.size(parts)
    df = df.where(extension(F.col("path")).isin(*IMAGE_EXTENSIONS, *VIDEO_EXTENSIONS)).withColumns({"account_dir": parts[at - 3], "post_dir": parts[at - 2], "name": parts[at - 1]})
    df = df.withColumn("relative", F.concat_ws("/", "account_dir", "post_dir", "name"))
    keep = ["path", "relative", "account_dir", "post_dir", "name", "length", "modificationTime"]
    if verified is not None:
        df = df.join(verified.select(F.col("path").alias("relative"), F.col("bytes").alias("expected_bytes"), F.col("sha256").alias("expected_sha256")), "relative")
        keep += ["expected_bytes", "expected_sha256"]
    return df.select(*keep)


def verified_inventory(spark: SparkSession, media: str, capture: str) -> DataFrame:
    """(path, bytes, sha256) that a download report of ``media`` vouches for, if it belongs to the capture of this fingerprint and its files are there and no links."""
    report = read_object(Path(media, "download_report.json"))
    if report.get("source_fingerprint") != capture:
        raise InputError("the media belong to another capture")
    rows = [(name, int(r["bytes"]), r["sha256"]) for name, r in report["assets"].items()]
    for name, *_ in rows:
        p = Path(media, name)
        if p.is_symlink() or not p.is_file() or not p.resolve().is_relative_to(Path(media).resolve()):
            raise InputError("the verified inventory has a missing or unsafe file")
    return spark.createDataFrame(rows, "path string, bytes long, sha256 string")


def read_object(path: Path, missing: bool = False, invalid: bool = False) -> dict:
    """One small JSON object; a missing or invalid file is an empty one only if so wanted, other failures are never hidden."""
    try:
        found = json.loads(path.read_text(encoding="utf-8-sig"))
        if not isinstance(found, dict):
            raise ValueError("no JSON object")
    except FileNotFoundError:
        if missing:
            return {}
        raise
    except ValueError:
        if invalid:
            logging.getLogger(__name__).warning("invalid JSON object: %s", path)
            return {}
        raise InputError(f"invalid JSON object: {path}") from None
    return found


def account_directory(files: DataFrame, accounts: DataFrame) -> DataFrame:
    """account -> account_dir, ignoring case; the exact name is preferred, and several others are an error (ambiguous)."""
    dirs = files.select("account_dir").distinct()
    hit = accounts.select("account").distinct().join(dirs, F.lower("account") == F.lower("account_dir"))
    return hit.groupBy("account").agg(
        F.coalesce(F.max(F.when(F.col("account") == F.col("account_dir"), F.col("account_dir"))), F.max("account_dir")).alias("account_dir"),
        ((F.count("*") > 1) & ~F.bool_or(F.col("account") == F.col("account_dir"))).alias("ambiguous"),
    )


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(line, digest, name, ok) of a '<64 hex>  <name>' manifest."""
    pattern = r"^([0-9a-f]{64})  (.+)$"
    return spark.read.text(path).select(
        F.col("value").alias("line"), F.nullif(F.regexp_extract("value", pattern, 1), F.lit("")).alias("digest"), F.nullif(F.regexp_extract("value", pattern, 2), F.lit("")).alias("name"), F.col("value").rlike(pattern).alias("ok")
    )


def media_tree(spark: SparkSession, root: str) -> DataFrame:
    """(account, post_id, meta, raw): per post folder what meta.json and raw.json say (either may be absent)."""
    def side(name: str) -> DataFrame:
        parts = F.split(F.col("file"), "/")
        at = F.size(parts)
        df = spark.read.option("pathGlobFilter", name).option("recursiveFileLookup", "true").text(root, wholetext=True)
        df = df.select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias(name.split(".")[0]))
        return df.select(parts[at - 3].alias("account"), parts[at - 2].alias("post_id"), name.split(".")[0]).where("post_id not in ('profile', 'slideshows')")

    return side("meta.json").join(side("raw.json"), ["account", "post_id"], "full_outer")


def run_info(spark: SparkSession, path: str) -> DataFrame:
    """One row of a capture's run record: its provenance fields, batches projected, complete and error_records derived."""
    schema = (
        "actor string, started_at string, finished_at string, accounts array<string>, settings string, "
        "batches array<struct<batch_index:long,profiles:array<string>,run_id:string,dataset_id:string,status:string,started_at:string,finished_at:string>>, "
        "manifest struct<failed_batches:string,interrupted:string,error_records:long>"
    )
    r = _whole(spark, path).select(F.from_json("text", schema).alias("r")).select("r.*")
    return r.withColumn("complete", capture_complete(F.col("finished_at"), F.col("manifest"), F.col("batches"))).withColumn("error_records", F.coalesce("manifest.error_records", F.lit(0)))


def capture_complete(finished: Column, manifest: Column, batches: Column) -> Column:
    """Finished, nothing failed, not interrupted, no errors, and all batches (if any) succeeded."""
    off = lambda c: c.isNull() | c.isin("", "[]", "{}", "0", "false", "null")
    good = F.forall(F.coalesce(batches, F.array().cast(BATCHES)), lambda b: F.coalesce(b["status"] == "SUCCEEDED", F.lit(False)))
    return (F.coalesce(finished, F.lit("")) != "") & off(manifest["failed_batches"]) & off(manifest["interrupted"]) & (F.coalesce(manifest["error_records"], F.lit(0)) == 0) & good


BATCHES = "array<struct<batch_index:long,profiles:array<string>,run_id:string,dataset_id:string,status:string,started_at:string,finished_at:string>>"
