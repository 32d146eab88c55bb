"""Export of a snapshot: posts with identities, attached media, counts, and the staged publication of a dataset."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import uuid
import zipfile
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import UNKNOWN, account_id, capture_account, export_account, export_post_id, post_uid, safe_component
from ..functions.variants import canonical
from ..operators.dedup import collapse_or_fail, removed_rows
from ..session import settle, shared_folder
from ..sinks.lines import csv_header, json_lines, publish, write_parts
from ..sources import text as scans
from ..sources.capture import capture_fingerprint
from ..sources.files import arrow, by_bytes, chunks, opened
from . import media as M
from . import validate as V
from .normalize import COLUMNS, content_type, normalize, published, spelt, verbatim

# The roles of a post's files, and the versions and names of the package's parts.
ROLES = ("avatar", "cover", "slide", "video")
SCHEMA_VERSION = "creative-dataset-export-v1"
FILES = ("posts.jsonl", "posts.csv", "assets.jsonl", "missing_assets.jsonl", "manifest.json", "README.md")
CHECKSUMS = "checksums.sha256"
CSV_COLUMNS = (
    "post_uid", "account_id", "platform", "account", "post_id", "content_type", "url", "caption", "created_at", "views", "likes", "comments", "shares", "saves",
    "expected_slide_count", "available_slide_count", "video_count", "media_status",
)
PLATFORM = "tiktok"
GUIDE = """# Dataset

posts.jsonl holds one post a line with its identifiers, metadata, raw payload, source and media references; posts.csv is a flat copy for
spreadsheets. assets.jsonl lists every distinct file by content digest; missing_assets.jsonl lists what is required but absent.
manifest.json has counts and completeness; checksums.sha256 covers every other file. Identifiers are text: never read them as numbers.
"""


class ExportError(ValueError):
    """A rule that stops an export before anything is published."""


def _refuse(df: DataFrame, what: str) -> None:
    bad = df.limit(3).collect()  # for the message
    if bad:
        raise ExportError(f"{what}: " + "; ".join(str(r.asDict()) for r in bad))


def load_posts(rows: DataFrame, overlay: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Keyed, deduplicated posts with identities and metadata, and how many identical rows went.

    ``rows`` as sources.text.posts gives them; ``overlay`` likewise from the normalised file, or None.
    """
    r = F.col("raw")

    def keyed(df, fallback):
        df = df.withColumn("own", export_account(r, fallback)).withColumn("post_id", export_post_id(r)).withColumn("payload", canonical(r))
        df = df.withColumn("acct", F.lower("own"))
        _refuse(df.where(F.coalesce("acct", F.lit("")).isin("", UNKNOWN)).select("source_file", "record"), "record without an account")
        _refuse(df.where("post_id is null").select("source_file", "record"), "record without a post identifier")
        return df

    k = keyed(rows, F.col("stem"))
    order = ["source_file", "record"]
    posts = collapse_or_fail(k, ["acct", "post_id"], "payload", order)
    gone = removed_rows(k, ["acct", "post_id"]).first().removed
    keep = posts.columns
    n = normalize(posts.withColumnRenamed("post_id", "key_id"), "raw", "raw_json")
    posts = n.withColumn("own_meta", published(n)).withColumn("post_id", F.col("key_id")).select(*keep, "own_meta")
    if overlay is not None:
        o = collapse_or_fail(keyed(overlay, F.lit(None).cast("string")), ["acct", "post_id"], "payload", order)
        o = o.select("acct", "post_id", F.col("payload").alias("over_meta"), F.col("own").alias("over_account"))
        posts = posts.join(o, ["acct", "post_id"], "left")
    else:
        posts = posts.withColumn("over_meta", F.lit(None).cast("string")).withColumn("over_account", F.lit(None).cast("string"))
    base = capture_or(posts)
    account = F.coalesce(F.when(F.lower(base) != UNKNOWN, base), F.col("own"))
    posts = posts.withColumn("account", account)
    out = posts.select(
        post_uid(F.col("account"), F.col("post_id")).alias("post_uid"), account_id(F.col("account")).alias("account_id"), F.lit(PLATFORM).alias("platform"), "account", "post_id",
        content_type(r).alias("content_type"), F.try_parse_json(F.coalesce("over_meta", "own_meta")).alias("metadata"), "raw",
        F.struct(F.lit("selected").alias("root"), F.col("source_file").alias("file"), F.col("record").alias("record")).alias("source"), "acct",
    )
    out = settle(out)  # two checks and every later plan read it
    _refuse(out.where(~safe_component(F.col("account")) | ~safe_component(F.col("post_id"))).select("account", "post_id"), "unsafe path component")
    _refuse(out.groupBy("post_uid").count().where("count > 1"), "post_uid collision")
    return out, gone


def capture_or(posts: DataFrame):
    """The account the metadata name: the overlay's, else what the normaliser found."""
    return F.coalesce("over_account", F.get_json_object("own_meta", "$.account"))


def snapshot(posts: DataFrame, files: DataFrame) -> dict:
    """envelopes, gaps, assets, files by role: all DataFrames of an export, nothing written."""
    folders = scans.account_directory(files, posts.select("account"))
    _refuse(folders.where("ambiguous").select("account"), "ambiguous media folder of an account")
    hashed = settle(M.hashed(files))  # hashing is dear, and several plans use it
    if "expected_sha256" in hashed.columns:
        _refuse(hashed.where("sha256 <> expected_sha256 or length <> expected_bytes").select("relative"), "verified media changed before the export")
        hashed = hashed.drop("expected_sha256", "expected_bytes")
    hashed = hashed.join(folders.select("account_dir").distinct(), "account_dir", "left_semi")
    held = M.held(posts, hashed)
    refs, gaps, assets, problems = M.attachments(held)
    gaps, assets = settle(gaps), settle(assets)
    _refuse(problems, "media that fits no rule")
    empty = gaps.where("reason = 'empty_file'")
    used = hashed.select("relative", "length", "account_dir", "post_dir", "name", "media_type")
    roles = refs.select("kind", "relative", "length")
    lost = used.where("length = 0").withColumn("kind", F.when(F.col("post_dir") == "profile", "avatar").when(F.col("media_type") == "video", "video").when(F.col("name").startswith("cover."), "cover").otherwise("slide"))
    lost = lost.join(empty.select(F.lower("account").alias("a")).distinct(), F.lower("account_dir") == F.col("a"), "left_semi").select("kind", "relative", "length")
    # each is read by several counts and writes
    return {"posts": settle(M.envelopes(posts, held)), "missing": gaps, "assets": assets, "files": settle(roles.unionByName(lost))}


def counts(posts: DataFrame, gaps: DataFrame, assets: DataFrame, refs_files: DataFrame, duplicates: int) -> dict:
    """The manifest's counts: one grouping each of posts, assets, gaps and files. A file is counted once for each role it has."""
    p = posts.agg(F.count("*").alias("posts"), F.count_distinct("account_id").alias("accounts")).first()
    a = {r.media_type: r for r in assets.groupBy("media_type").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).orderBy("media_type").collect()}  # a few types
    g = gaps.groupBy("post_uid").count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count("post_uid").alias("p")).first()
    of = [F.max(F.col("kind") == k).alias(k) for k in ROLES]
    each = refs_files.groupBy("relative").agg(F.max(F.col("length") == 0).alias("empty"), *of)
    f = each.agg(F.count("relative").alias("n"), F.count_if("empty").alias("e"), *(F.count_if(k).alias(k) for k in ROLES)).first()
    roles = {k: f[k] for k in ROLES if f[k]}
    types = {r["content_type"]: r["count"] for r in posts.groupBy("content_type").count().orderBy("content_type").collect()}  # a few kinds
    return {
        "posts": p.posts, "accounts": p.accounts, "content_types": types, "duplicate_post_rows_removed": duplicates, "source_media_files": f.n, "empty_media_files": f.e,
        "source_media_by_role": roles, "unique_assets": sum(r.n for r in a.values()), "unique_assets_by_type": {k: r.n for k, r in a.items()}, "asset_bytes": sum(r.b or 0 for r in a.values()),
        "missing_assets": g.n, "posts_with_missing_assets": g.p,
    }


def manifest(parts: dict, duplicates: int, capture: dict | None, lineage: dict | None = None, sources: dict | None = None) -> dict:
    n = counts(parts["posts"], parts["missing"], parts["assets"], parts["files"], duplicates)
    whole = n["missing_assets"] == 0
    done = capture["complete"] if capture else None
    return {
        "schema_version": SCHEMA_VERSION, "exported_at": datetime.now(UTC).isoformat(), "snapshot": "selected_only", "capture": capture, "includes_history": False, "includes_analysis": False,
        "completion": {"capture": done, "media": whole, "complete": bool(done and whole)}, "pipeline": lineage, "sources": sources or {}, "counts": n,
    }


def atomic_write(path: Path, data: bytes) -> None:
    """Write beside the target, sync, replace: the old content stays until the new is whole."""
    scratch = path.with_name(f".{path.name}.{os.getpid()}.tmp")
    try:
        with scratch.open("wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(scratch, path)
    finally:
        scratch.unlink(missing_ok=True)


def csv_rows(posts: DataFrame) -> DataFrame:
    """The flat columns: the envelope's value, else the metadata's; nulls empty."""
    own = set(posts.columns)
    value = lambda c: F.size("media.videos") if c == "video_count" else F.col(c) if c in own else F.try_variant_get("metadata", f"$.{c}", "string")
    return posts.select(*(F.coalesce(value(c).cast("string"), F.lit("")).alias(c) for c in CSV_COLUMNS))


def normalized_csv(df: DataFrame) -> DataFrame:
    """The flat copy of normalised rows (with their ``raw``): values as the payload has them, hashtags joined by a bar, nothing for null."""
    values = verbatim(df)
    shown = lambda c: F.array_join("hashtags", "|") if c == "hashtags" else F.when(~F.is_variant_null(values[c]), spelt(values[c])) if c in values else F.col(c)
    return df.select(*(F.coalesce(shown(c), F.lit("")).alias(c) for c in COLUMNS))


def append_lines(path: Path, rows: list[dict]) -> None:
    """Add a batch of JSON lines with one flush to disk; readers skip a last line that was cut off."""
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("a", encoding="utf-8") as f:
        f.writelines(json.dumps(r, ensure_ascii=False, default=str) + "\n" for r in rows)
        f.flush()
        os.fsync(f.fileno())


def write_profiles(profiles: DataFrame, folder: str) -> None:
    """A partition per account with its profile as one JSON line; a full rewrite, so accounts that left go as well."""
    rows = profiles.select("account", F.to_json(F.struct("account", "captured_at", F.try_parse_json("author").alias("authorMeta"))).alias("value"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("account").text(folder)


def write_by_account(good: DataFrame, folder: str) -> None:
    """Raw lines in a partition per account; a full rewrite, so partitions of accounts that left go as well.

    Rows are rebalanced by account: small accounts share tasks, and adaptive execution splits a large one into several of the advised size, each with a file of its own.
    """
    rows = good.select(capture_account(F.col("raw")).alias("account"), F.col("raw_json").alias("value"))
    rows.hint("rebalance", "account").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("account").text(folder)


def rows_per_account(good: DataFrame) -> DataFrame:
    return good.groupBy(capture_account(F.col("raw")).alias("account")).count()


def copy_assets(assets: DataFrame, staged: Path | str) -> None:
    """Copy each asset's file on the executors in chunks, dealt to tasks by bytes and hashed again on the way; both ends are paths or URIs that all of them share."""
    root = str(staged)

    def copy(batches):
        for b in batches:
            for name, file, digest in zip(*(b.column(c).to_pylist() for c in ("path", "file", "sha256")), strict=True):
                sink, target = opened(f"{root}/{name}")
                sink.create_dir(target.rpartition("/")[0], recursive=True)
                h, scratch = hashlib.sha256(), f"{target}.{uuid.uuid4().hex}"
                try:
                    with sink.open_output_stream(scratch, compression=None) as out:
                        for block in chunks(file):
                            h.update(block)
                            out.write(block)
                    if h.hexdigest() != digest:
                        raise ExportError(f"{name} changed while it was copied")
                except BaseException:
                    sink.delete_file(scratch)
                    raise
                sink.move(scratch, target)
                yield {"path": [name]}

    arrow(by_bytes(assets.select("path", "file", "sha256", "bytes"), "bytes"), copy, "path string").write.format("noop").mode("overwrite").save()


def write_tables(parts: dict, told: dict, staged: Path, scratch: str) -> None:
    """All files of a package but its assets, in ``staged``: tables by the ordered sink, whose parts lie below ``scratch``, and checksums of everything. No row passes the driver."""
    spark = parts["posts"].sparkSession
    ordered = parts["posts"].orderBy("acct", "post_id")
    posts = ordered.select("post_uid", "account_id", "platform", "account", "post_id", "content_type", "metadata", "raw", "source", "media", "expected_slide_count", "available_slide_count", "media_status")
    tables = {
        "posts.jsonl": (json_lines(posts), "text", b""), "posts.csv": (csv_rows(ordered), "csv", csv_header(CSV_COLUMNS)), "assets.jsonl": (json_lines(parts["assets"].drop("file").orderBy("asset_id")), "text", b""),
        "missing_assets.jsonl": (json_lines(parts["missing"].orderBy("account", "post_id", "kind", "index")), "text", b""),
    }
    for name, (df, kind, _) in tables.items():
        write_parts(df, f"{scratch}/{name}", kind)
    done = publish(spark, [(f"{scratch}/{name}", str(staged / name), header) for name, (_, _, header) in tables.items()])
    small = {"manifest.json": json.dumps(told, indent=2, ensure_ascii=False, default=str).encode(), "README.md": GUIDE.encode()}
    for name, data in small.items():
        atomic_write(staged / name, data)
    own = spark.createDataFrame([(n, hashlib.sha256(d).hexdigest()) for n, d in small.items()], "name string, sha256 string")
    own = own.union(done.select(F.regexp_extract("file", "([^/]+)$", 1), "sha256")).union(parts["assets"].select("path", "sha256"))
    write_parts(own.orderBy("name").select(F.concat_ws("  ", "sha256", "name").alias("value")), f"{scratch}/{CHECKSUMS}")
    publish(spark, [(f"{scratch}/{CHECKSUMS}", str(staged / CHECKSUMS), b"")])


def write_zip(path: Path, staged: Path, top: str) -> None:
    """ZIP64, one top folder, members sorted; assets stored, text deflated."""
    scratch = path.with_name(f".{path.name}.tmp")
    with zipfile.ZipFile(scratch, "w", allowZip64=True) as z:
        for p in sorted(x for x in staged.rglob("*") if x.is_file()):
            name = p.relative_to(staged).as_posix()
            z.write(p, f"{top}/{name}", zipfile.ZIP_STORED if name.startswith("assets/") else zipfile.ZIP_DEFLATED)
    os.replace(scratch, path)


def ensure_zip(folder: Path) -> Path:
    """The published folder's ZIP: made if it is missing, else verified, member by member."""
    path = folder.with_suffix(".zip")
    if path.is_symlink():
        raise ExportError("the ZIP is a link")
    if not path.exists():
        write_zip(path, folder, folder.name)
    if not verify_zip(path, folder):
        raise ExportError("the ZIP differs from the published folder")
    return path


def verify_zip(path: Path, folder: Path) -> bool:
    """Do the members equal the folder's files, by name and content?"""
    with zipfile.ZipFile(path) as z:
        members = {n.partition("/")[2]: n for n in z.namelist()}
        files = {p.relative_to(folder).as_posix() for p in folder.rglob("*") if p.is_file()}
        return set(members) == files and all(hashlib.sha256(z.read(m)).digest() == hashlib.sha256((folder / n).read_bytes()).digest() for n, m in members.items())


def guard_destination(out: Path, roots: list[Path], archive: Path | None = None) -> None:
    """Nothing may exist there, be a link, or overlap an input."""
    for p in filter(None, (out, archive)):
        if p.exists() or p.is_symlink():
            raise ExportError(f"{p} exists")
        for r in roots:
            a, b = p.resolve(), r.resolve()
            if a == b or a in b.parents or b in a.parents:
                raise ExportError(f"{p} overlaps an input")


def witnessed(*roots: Path) -> dict[str, tuple[int, int, int, int]]:
    """Device, inode, size and time of change of every file below the roots; links are refused."""
    out = {}
    for root in roots:
        for folder, folders, files in os.walk(root):
            for name in [*folders, *files]:
                p = os.path.join(folder, name)
                if os.path.islink(p):
                    raise ExportError(f"{name} is a link")
                if name in files:
                    x = os.stat(p)
                    out[p] = (x.st_dev, x.st_ino, x.st_size, x.st_mtime_ns)
    return out


def export_dataset(spark: SparkSession, selected: str, media: str, out: str, archive: bool = False, dry_run: bool = False, verified: DataFrame | None = None, lineage: dict | None = None, require_verified: bool = False) -> dict:
    """Read, check, and (unless dry) publish a dataset folder by staging and rename; returns the manifest."""
    target, roots = Path(out), [Path(selected), Path(media)]
    bundle = target.with_suffix(".zip") if archive else None
    guard_destination(target, roots, bundle)
    listed = witnessed(*roots)
    if require_verified:
        verified = scans.verified_inventory(spark, media, capture_fingerprint(Path(selected)))
    over = Path(selected, "normalized/posts.jsonl")
    overlay = None
    if over.exists():
        overlay = scans.with_record_numbers(scans.jsonl(spark, str(over))).withColumn("source_file", F.lit("normalized/posts.jsonl")).withColumn("stem", F.lit(None).cast("string"))
    rows = scans.posts(spark, selected)
    if rows.isEmpty():
        raise ExportError("the selected snapshot is empty")
    posts, gone = load_posts(rows, overlay)
    files = scans.media_files(spark, media, verified=verified)
    parts = snapshot(posts, files)
    capture = None
    info = Path(selected, "run_info.json")
    if info.exists():
        r = scans.run_info(spark, str(info)).first()
        capture = {k: r[k] for k in ("actor", "started_at", "finished_at", "accounts", "settings")} | {"batches": [b.asDict() for b in r.batches or []], "complete": r.complete, "error_records": r.error_records}
    told = manifest(parts, gone, capture, lineage, {"selected": f"selected:{Path(selected).name}", "media": f"media:{Path(media).name}"})
    if dry_run:
        return told
    staged = target.with_name(f".{target.name}.staging")
    shutil.rmtree(staged, ignore_errors=True)
    staged.mkdir(parents=True)
    try:
        copy_assets(parts["assets"], staged)
        write_tables(parts, told, staged, shared_folder(spark))
        if listed != witnessed(*roots):
            raise ExportError("a source changed during the export")
        report = V.validate(spark, str(staged))
        if not report["ok"]:
            raise ExportError(f"the staged dataset is invalid: {report['issues'][:3]}")
        if bundle:
            write_zip(bundle, staged, target.name)
        os.rename(staged, target)
    except BaseException:
        shutil.rmtree(staged, ignore_errors=True)
        if bundle:
            bundle.unlink(missing_ok=True)
        raise
    return told
