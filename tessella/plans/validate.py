"""Validation of a published dataset: every rule gives its violations as (rule, key, detail); valid means none."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.variants import get, is_array, is_object, is_string, items, kind, text
from ..operators.inventory import difference
from ..session import settle
from ..sources.files import digests
from ..sources.text import InputError, checksums, jsonl, listed

VERSION = "creative-dataset-export-v1"
PARTS = ("posts.jsonl", "posts.csv", "assets.jsonl", "missing_assets.jsonl", "manifest.json", "README.md")
SUMS = "checksums.sha256"
NAMES = ("post_uid", "post_id", "account_id", "account", "platform")
LISTS = ("covers", "avatars", "videos", "slides")


def safe_path(c: Column) -> Column:
    """POSIX, relative, no backslash, no empty, dot or dot-dot part."""
    return (c != "") & ~c.contains("\\") & ~c.startswith("/") & ~c.rlike(r"(^|/)\.{1,2}(/|$)")


def _v(df: DataFrame, rule: str, key: Column, detail: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), F.lit(detail).alias("detail"))


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The rows, written once, and how many there are, as the one scan has observed it."""
    met = Observation(name)
    return settle(df.observe(met, F.count(F.lit(1)).alias("n"))), met.get["n"]


def asset_facts(assets: DataFrame) -> DataFrame:
    """Of each asset row what the rules ask for; ok: id and path are text."""
    a = assets.select(get(F.col("raw"), "asset_id").alias("id"), get(F.col("raw"), "path").alias("p"), get(F.col("raw"), "sha256").alias("h"), F.try_variant_get("raw", "$.bytes", "long").alias("bytes"))
    return a.select(text(F.col("id")).alias("asset_id"), text(F.col("p")).alias("path"), text(F.col("h")).alias("sha256"), "bytes", (is_string(F.col("id")) & (text(F.col("id")) != "") & is_string(F.col("p"))).alias("ok"))


def file_violations(sums: DataFrame, files: DataFrame, b: DataFrame) -> list[DataFrame]:
    """sums (line, digest, name, ok), files (name, length, sha256), assets as ``asset_facts`` gives them: checksums, assets, inventories."""
    good = sums.where("ok")
    listed = b.join(good.select(F.col("name").alias("path"), F.col("digest")), "path", "left")
    sized = b.join(files.select(F.col("name").alias("path"), "length"), "path", "left")
    spark = sums.sparkSession
    names = spark.createDataFrame([(x,) for x in PARTS], "name string")
    expected = names.union(b.where("path is not null").select("path")).distinct()
    return [
        _v(sums.where("not ok"), "V2", F.lit("checksum line"), "malformed checksum line"),
        _v(good.groupBy("name").count().where("count > 1"), "V2", F.col("name"), "checksum name listed twice"),
        _v(good.join(files.select("name", "sha256"), "name", "left").where("sha256 is null or sha256 <> digest"), "V3", F.col("name"), "file is absent or differs from its checksum"),
        _v(b.where("not coalesce(ok, false)"), "V4", F.col("asset_id"), "asset id or path is no text"),
        _v(b.groupBy("asset_id").count().where("count > 1"), "V4", F.col("asset_id"), "asset id listed twice"),
        _v(listed.where("not coalesce(startswith(path, 'assets/'), false) or digest is null or sha256 is null or digest <> sha256"), "V5", F.col("asset_id"), "asset path or checksum differs from the inventory"),
        _v(b.where("asset_id is null or sha256 is null or asset_id <> concat('sha256:', sha256)"), "V6", F.col("asset_id"), "asset id differs from its digest"),
        _v(sized.where("length is null or bytes is null or length <> bytes"), "V7", F.col("asset_id"), "asset size differs from its file"),
        _v(difference(good.select("name"), expected, "name"), "V8", F.col("name"), "checksums and package parts differ"),
        _v(difference(files.where(F.col("name") != SUMS).select("name"), expected, "name"), "V9", F.col("name"), "a file is missing or not listed"),
        _v(good.where(~safe_path(F.col("name"))), "V24", F.col("name"), "unsafe path"),
        _v(b.where("path is not null").where(~safe_path(F.col("path"))), "V24", F.col("path"), "unsafe path"),
    ]


def post_facts(posts: DataFrame) -> DataFrame:
    """Of each post, in one projection, what the rules ask for: its own violations (V10, V12 to V15) as an array, keys, status, slide counts and media references (null where one is no text)."""
    r = F.col("raw")
    named = F.lit(True)
    for n in NAMES:
        named = named & F.coalesce(is_string(get(r, n)) & (text(get(r, n)) != ""), F.lit(False))
    lists = F.coalesce(is_object(get(r, "media")), F.lit(False))
    for n in LISTS:
        lists = lists & F.coalesce(is_array(get(r, f"media.{n}")), F.lit(False))
    slides = items(get(r, "media.slides"))
    whole = lambda v: F.coalesce(kind(v).isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.lit(False))  # noqa: E731  booleans are none
    index = lambda s: F.try_variant_get(s, "$.index", "long")
    order = F.transform(slides, index)
    sound = {
        ("V10", "a post identifier is no filled text"): named,
        ("V12", "content type, raw or metadata is invalid"): text(get(r, "content_type")).isin("video", "slideshow") & is_object(get(r, "raw")) & is_object(get(r, "metadata")),
        ("V13", "media lists are invalid"): lists,
        ("V14", "slide index is no number from 1"): ~F.exists(slides, lambda s: ~whole(get(s, "index")) | (F.coalesce(index(s), F.lit(0)) < 1)),
        ("V15", "slide positions aren't strictly increasing"): F.array_sort(F.array_distinct(order)) == order,
    }
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.lit(detail).alias("detail"))) for (rule, detail), ok in sound.items())))
    m = lambda k: items(get(r, f"media.{k}"))
    # an absent slide asset must stay visible, as a null reference
    flat = F.concat(m("covers"), m("avatars"), m("videos"), F.transform(m("slides"), lambda s: get(s, "asset_id")))
    return posts.select(
        text(get(r, "post_uid")).alias("uid"), text(get(r, "platform")).alias("pf"), F.lower(text(get(r, "account"))).alias("ac"), text(get(r, "post_id")).alias("pid"), text(get(r, "media_status")).alias("status"),
        F.try_variant_get(r, "$.available_slide_count", "long").alias("n"), F.size(slides).alias("have"), F.transform(flat, lambda x: F.when(is_string(x), text(x))).alias("assets"), broken.alias("broken"),
    )


def post_violations(facts: DataFrame, assets: DataFrame, gaps: DataFrame) -> list[DataFrame]:
    """facts as ``post_facts`` gives them, assets (asset_id), gaps (post_uid): no payload is read here."""
    own = facts.select("uid", F.explode("broken").alias("b")).select("b.rule", F.col("uid").alias("key"), "b.detail")
    refs = facts.select("uid", F.explode("assets").alias("asset"))
    known = assets.select(F.col("asset_id").alias("asset")).distinct()
    marks = gaps.where("post_uid is not null").select(F.col("post_uid").alias("uid")).distinct().withColumn("gap", F.lit(True))
    told = facts.select("uid", "status", "n", "have").join(marks, "uid", "left").withColumn("want", F.when(F.col("gap"), "incomplete").otherwise("complete"))
    return [
        own,
        _v(facts.groupBy("uid").count().where("count > 1"), "V11", F.col("uid"), "post_uid listed twice"),
        _v(facts.groupBy("pf", "ac", "pid").count().where("count > 1"), "V11", F.concat_ws("/", "pf", "ac", "pid"), "post listed twice"),
        _v(refs.where("asset is null").unionByName(refs.where("asset is not null").join(known, "asset", "left_anti").select(*refs.columns)), "V16", F.col("uid"), "reference to an unknown asset"),
        _v(gaps.join(facts.select(F.col("uid").alias("post_uid")).distinct(), "post_uid", "left_anti"), "V18", F.col("post_uid"), "gap of an unknown post"),
        _v(told.where("status is null or status <> want"), "V19", F.col("uid"), "media status disagrees with the gaps"),
        _v(told.where("n is null or n <> have"), "V20", F.col("uid"), "slide count disagrees with the slides"),
    ]


def manifest_violations(manifest: dict, n_posts: int, n_assets: int, n_missing: int) -> list[tuple[str, str, str]]:
    """Rules on the one manifest document: version, counts, completion."""
    out = []
    if manifest.get("schema_version") != VERSION:
        out.append(("V1", "schema_version", "unsupported version"))
    n = manifest.get("counts", {})
    if not isinstance(n, dict) or (n.get("posts"), n.get("unique_assets"), n.get("missing_assets")) != (n_posts, n_assets, n_missing):
        out.append(("V21", "counts", "counts differ from the tables"))
    done = manifest.get("completion")
    if done is not None:
        capture = manifest.get("capture")
        state = capture.get("complete") if isinstance(capture, dict) else None
        if (capture is not None and not isinstance(capture, dict)) or not isinstance(done, dict) or not {"capture", "media", "complete"} <= set(done) or (state is not None and not isinstance(state, bool)) or done.get("capture") is not state:
            out.append(("V22", "completion", "capture completion disagrees with its provenance"))
        elif done["media"] is not (n_missing == 0) or done["complete"] is not (state is True and n_missing == 0):
            out.append(("V23", "completion", "completion disagrees with the gaps"))
    return out


def violations(spark: SparkSession, root: str) -> DataFrame:
    """All violations of the dataset in a folder, in one DataFrame (rule, key, detail)."""
    folder = Path(root)
    try:
        posts, assets, gaps = (jsonl(spark, f"{root}/{n}.jsonl").select("raw") if (folder / f"{n}.jsonl").stat().st_size else spark.createDataFrame([], "j string").select(F.try_parse_json("j").alias("raw")) for n in ("posts", "assets", "missing_assets"))
        sums = checksums(spark, f"{root}/{SUMS}")
        manifest = json.loads((folder / "manifest.json").read_text(encoding="utf-8"))
        if not isinstance(manifest, dict):
            raise InputError("manifest.json: not a JSON object")
        links = [p for p in folder.rglob("*") if p.is_symlink()]
    except (InputError, OSError, ValueError) as e:
        return spark.createDataFrame([("V0", "package", str(e)[:300])], "rule string, key string, detail string")
    files = listed(spark, root)
    base = folder.resolve().as_posix()
    files = settle(files.join(digests(files).select("path", "sha256"), "path").select(F.expr(f"substring_index(path, '{base}/', -1)").alias("name"), "length", "sha256"))
    facts, n_posts = counted(post_facts(posts), "posts")
    assets, n_assets = counted(asset_facts(assets), "assets")
    gaps, n_gaps = counted(gaps.select(text(get(F.col("raw"), "post_uid")).alias("post_uid")), "gaps")
    rows = manifest_violations(manifest, n_posts, n_assets, n_gaps) + [("V24", p.relative_to(folder).as_posix(), "symbolic link") for p in links]
    rows += [] if n_posts else [("V17", "posts", "the dataset is empty")]
    out = spark.createDataFrame(rows, "rule string, key string, detail string")
    for v in file_violations(settle(sums), files, assets) + post_violations(facts, assets, gaps):
        out = out.unionByName(v)
    return out


def validate(spark: SparkSession, root: str, most: int = 100) -> dict:
    """{ok, posts, assets, missing_assets, issues}: issues in rule order, at most ``most`` of them in the report."""
    found = violations(spark, root)
    issues = [f"{r.rule}: {r.detail} ({r.key})" for r in found.orderBy(F.substring("rule", 2, 9).cast("int"), "key").limit(most).collect()]
    size = lambda n: sum(1 for x in Path(root, n).open(encoding="utf-8") if x.strip()) if Path(root, n).exists() else 0
    return {"ok": not issues, "posts": size("posts.jsonl"), "assets": size("assets.jsonl"), "missing_assets": size("missing_assets.jsonl"), "issues": issues}
