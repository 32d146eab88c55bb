"""Engine functions over captured posts and media files that are made from the driver's tables, each with the same result in SQL.

Orders stand for captured posts (customers for accounts), order lines for media files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, redaction
from ..functions import media as U
from ..functions.variants import get, parsed_once
from ..operators import hashtree, history, inventory
from ..session import settle, shared_folder, spread
from ..sinks import lines
from ..sources import files as disk
from ..sources import provider, ranges
from ..sources import text as scans
from ..streaming import ingest
from . import export, media, normalize

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(fn):
        QUERIES[fn.__name__] = fn
        SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.select(*columns) if columns else df


def captured(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as captured items: some without id, some errors, slideshows by flag, by slides, and neither."""
    k = F.col("o_orderkey")
    key, cust = k.cast("string"), F.col("o_custkey").cast("string")
    slides = F.transform(inventory.positions(k % 4), lambda i: F.struct(F.concat(F.lit("https://a.example/"), key, F.lit("/"), i.cast("string")).alias("tiktokLink"), F.when(i % 2 == 0, F.concat(F.lit("https://b.example/"), key)).alias("downloadLink")))
    item = F.struct(
        F.when(k % 5 != 0, key).alias("id"), F.concat(F.lit(" @Cust"), cust, F.lit(" ")).alias("input"), F.when(k % 3 == 0, F.lit(True)).alias("isSlideshow"), F.when(k % 3 != 1, slides).alias("slideshowImageLinks"),
        F.struct(F.concat(F.lit("cust"), cust).alias("name"), F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("https://av.example/"), cust)).alias("avatar"), F.when(F.col("o_custkey") % 7 > 0, F.col("o_custkey") % 7).alias("fans")).alias("authorMeta"),
        F.struct(F.concat(F.lit("v"), key).alias("id"), F.when(k % 2 == 0, F.concat(F.lit("https://c.example/"), key)).alias("originalCoverUrl"), F.when(k % 4 == 0, F.concat(F.lit("https://c.example/"), key)).alias("coverUrl")).alias("videoMeta"),
        (k % 1000).alias("playCount"), F.when(k % 6 == 0, F.lit("many")).alias("diggCount"), F.col("o_orderpriority").alias("desc"), F.array(F.col("o_orderstatus"), F.lit(""), F.lit("null")).alias("hashtags"),
        F.when(k % 10 == 7, "gone").alias("error"), F.concat(F.lit("https://www.tiktok.com/@x/video/"), key).alias("webVideoUrl"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("createTimeISO"),
        F.struct(F.concat(F.lit("https://cdn.example/"), key, F.lit(".mp4?x=1")).alias("play"), F.concat(F.lit("https://cdn.example/"), key, F.lit(".jpg")).alias("download")).alias("files"),
    )
    rows = spread(table(spark, sf, "orders")).select("o_orderkey", "o_custkey", F.to_json(item).alias("raw_json"))
    return rows.withColumns({"raw": F.try_parse_json("raw_json"), "stem": F.lit("file"), "source_file": F.lit("posts/x.jsonl"), "record": k})


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as hashed media files of the order's post (of repeated lines the smallest part); digests repeat by part, some files are empty."""
    n = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").repartition("l_orderkey")  # for the grouping and for the join
    n = n.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey")
    l = n.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    name = F.when(F.col("l_linenumber") == 1, "cover.jpg").when(F.col("l_linenumber") == 2, "video.mp4").otherwise(F.concat(F.lit("slide_00"), (F.col("l_linenumber") - 2).cast("string"), F.lit(".jpeg")))
    l = l.select(F.concat(F.lit("cust"), F.col("o_custkey").cast("string")).alias("account_dir"), F.col("l_orderkey").cast("string").alias("post_dir"), name.alias("name"), F.when(F.col("l_partkey") % 9 == 0, 0).otherwise(F.col("l_partkey")).cast("long").alias("length"), F.sha2(F.col("l_partkey").cast("string").cast("binary"), 256).alias("sha256"))
    l = l.withColumn("relative", F.concat_ws("/", "account_dir", "post_dir", "name"))
    return l.withColumns({"path": F.concat(F.lit("file:///"), F.col("relative")), "media_type": U.media_type(F.col("name"))})


def keyed(spark: SparkSession, sf: str) -> DataFrame:
    """Captured posts as an export keys them."""
    c, r = captured(spark, sf), F.col("raw")
    c = c.withColumns({"account": identity.export_account(r, F.col("stem")), "post_id": identity.export_post_id(r)})
    return c.select(identity.post_uid(F.col("account"), F.col("post_id")).alias("post_uid"), "account", "post_id", normalize.content_type(r).alias("content_type"), "raw", F.lower("account").alias("acct"))


def held(spark: SparkSession, sf: str) -> DataFrame:
    """Posts with their files, written once as an export does; of the payload goes on what media are held against."""
    return media.held(settle(media.facts(keyed(spark, sf)).drop("raw", "acct")), files(spark, sf))


_POSTS = """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, 'Cust' || o_custkey AS account, CAST(o_orderkey AS VARCHAR) AS pid,
CASE WHEN o_orderkey % 3 = 0 THEN 'slideshow' WHEN o_orderkey % 3 = 2 AND o_orderkey % 4 > 0 THEN 'slideshow' ELSE 'video' END AS kind,
CASE WHEN o_orderkey % 3 <> 1 THEN o_orderkey % 4 ELSE 0 END AS slides, o_orderstatus, o_orderpriority, o_orderdate FROM orders)"""
_FILES = """, l AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey),
f AS (SELECT o.k, o.c, o.account, o.pid, CASE l_linenumber WHEN 1 THEN 'cover' WHEN 2 THEN 'video' ELSE 'slide' END AS role, CASE WHEN l_linenumber > 2 THEN l_linenumber - 2 END AS idx,
CASE WHEN l_partkey % 9 = 0 THEN 0 ELSE l_partkey END AS length, sha256(CAST(l_partkey AS VARCHAR)) AS h,
'cust' || o.c || '/' || o.pid || '/' || CASE l_linenumber WHEN 1 THEN 'cover.jpg' WHEN 2 THEN 'video.mp4' ELSE 'slide_00' || (l_linenumber - 2) || '.jpeg' END AS relative
FROM l JOIN o ON o.k = l.l_orderkey)"""


@query(_POSTS + """SELECT CASE WHEN k % 5 = 0 THEN 'v' || k ELSE pid END AS post_id, account, 'https://www.tiktok.com/@x/video/' || k AS url, o_orderpriority AS caption, strftime(o_orderdate, '%Y-%m-%d') AS created_at,
FALSE AS is_pinned, CAST(k % 1000 AS BIGINT) AS views, CAST(NULL AS BIGINT) AS likes, o_orderstatus || '|null' AS hashtags, 'cust' || c AS author_name, CASE WHEN c % 7 > 0 THEN CAST(c % 7 AS BIGINT) END AS followers FROM o WHERE k % 10 <> 7""")
def normalized_columns(spark, sf):
    """F4, F9 (items with an id), F15, P1."""
    n = normalize.normalize(normalize.split_items(captured(spark, sf))[0])
    return n.select("post_id", "account", "url", "caption", "created_at", "is_pinned", "views", "likes", F.array_join("hashtags", "|").alias("hashtags"), "author_name", "followers")


@query(_POSTS + """SELECT CASE WHEN k % 5 = 0 THEN 'v' || k ELSE pid END AS post_id, '{"views":' || (k % 1000) || ',"likes":' || CASE WHEN k % 6 = 0 THEN '"many"' ELSE 'null' END || ',"hashtags":["' || o_orderstatus || '","null"],"is_pinned":false}' AS published FROM o""")
def published_values(spark, sf):
    """Values keep their own JSON type in what is published."""
    n = normalize.normalize(captured(spark, sf))
    n = parsed_once(n.select("post_id", F.try_parse_json(normalize.published(n)).alias("j")), "j")
    j = F.col("j")
    return n.select("post_id", F.to_json(F.struct(*(get(j, c).alias(c) for c in ("views", "likes", "hashtags", "is_pinned"))), {"ignoreNullFields": "false"}).alias("published"))


@query(_POSTS + """SELECT k AS o_orderkey, account, pid AS post_id, 'POST-' || upper(substr(sha1(account || chr(0) || pid), 1, 12)) AS post_uid, 'ACC-' || upper(substr(sha1(lower(account)), 1, 12)) AS account_id, kind AS content_type, TRUE AS safe FROM o""")
def export_keys(spark, sf):
    """F6, F7, F8, F12, F13, F18, F34."""
    c, r = captured(spark, sf), F.col("raw")
    c = c.withColumns({"account": identity.export_account(r, F.col("stem")), "post_id": identity.export_post_id(r)})
    safe = identity.safe_component(F.col("account")) & identity.safe_component(F.col("post_id"))
    return c.select("o_orderkey", "account", "post_id", identity.post_uid(F.col("account"), F.col("post_id")).alias("post_uid"), identity.account_id(F.col("account")).alias("account_id"), normalize.content_type(r).alias("content_type"), safe.alias("safe"))


@query("SELECT page_id, coalesce(nullif(regexp_extract(url, '/es/(\\d+)', 1), ''), '') AS post_id FROM pages")
def url_post_id(spark, sf):
    """an id from a post page's URL, through the resolver of downloads."""
    p = table(spark, sf, "pages", "page_id", "url")
    raw = F.to_json(F.struct(F.regexp_replace("url", "/es/", "/video/").alias("webVideoUrl")))
    p = p.withColumn("raw_json", raw).withColumn("raw", F.try_parse_json("raw_json"))
    found = identity.download_post_id(F.col("raw"), F.col("raw_json"))
    return p.select("page_id", F.when(found.startswith("sha1_"), "").otherwise(found).alias("post_id"))


@query("SELECT c_custkey, c_name AS handle FROM customer")
def handle_clean(spark, sf):
    """handles out of profile URLs, with marks, slashes and blanks around them."""
    c = table(spark, sf, "customer", "c_custkey", "c_name")
    name = F.replace("c_name", F.lit("#"), F.lit("."))
    shown = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" https://www.TikTok.com/@"), name, F.lit("?lang=en "))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("@@"), name, F.lit("/"))).otherwise(F.concat(F.lit("/"), name, F.lit("/ ")))
    return c.select("c_custkey", F.replace(identity.clean_handle(shown), F.lit("."), F.lit("#")).alias("handle"))


@query(_POSTS + "SELECT CAST(count(*) AS BIGINT) AS total, count(*) FILTER (WHERE k % 10 = 7) AS errors, count(*) FILTER (WHERE k % 10 <> 7) AS kept, count(*) FILTER (WHERE k % 10 <> 7) AS posts FROM o")
def error_split(spark, sf):
    """Error rows apart, and what is left after deduplication."""
    return normalize.capture_counts(captured(spark, sf), ["source_file", "record"])


@query(_POSTS + "SELECT account, count(*) AS count FROM o WHERE k % 10 <> 7 GROUP BY account")
def rows_per_account(spark, sf):
    """A1."""
    return export.rows_per_account(normalize.split_items(captured(spark, sf))[0])


@query(_POSTS + "SELECT account, post_id, kind FROM (SELECT account, pid AS post_id, kind FROM o) WHERE lower(account) IN ('cust1', 'cust5', 'cust7')")
def account_subset(spark, sf):
    """P3."""
    return media.only_accounts(keyed(spark, sf), ["@CUST1", " cust5/", "https://www.tiktok.com/@Cust7?x"]).select("account", "post_id", F.col("content_type").alias("kind"))


@query(_POSTS + "SELECT account, pid AS post_id FROM o WHERE k % 11 = 0")
def post_subset(spark, sf):
    """P4."""
    k = keyed(spark, sf).select("account", "post_id")
    return media.only_posts(k, k.where(F.col("post_id").cast("long") % 11 == 0).select(F.upper("account").alias("account"), "post_id"))


@query(_POSTS + """, j AS (SELECT 'cover' AS kind, account, pid AS post_id, CAST(NULL AS INTEGER) AS "index", 1 AS n, account || '/' || pid || '/cover.jpg' AS path FROM o WHERE k % 2 = 0
UNION ALL SELECT 'slide', account, pid, CAST(i AS INTEGER), CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END, account || '/' || pid || '/slide_00' || i || '.jpg' FROM (SELECT *, unnest(range(1, CAST(slides AS BIGINT) + 1)) AS i FROM o)
UNION ALL SELECT DISTINCT 'avatar', account, NULL, NULL, 1, account || '/profile/avatar.jpg' FROM o WHERE c % 2 = 0) SELECT kind, account, post_id, "index", CAST(n AS INTEGER) AS n, path FROM j""")
def media_jobs(spark, sf):
    """F22, G-1, G-2, G-3, P15, T2, W5, W6."""
    planned = media.plan_posts(captured(spark, sf))
    return media.download_jobs(planned).select("kind", "account", "post_id", "index", F.size("candidates").alias("n"), "path")


@query(_POSTS + """SELECT count(*) AS posts, count(*) FILTER (WHERE kind = 'video') AS video_posts, count(DISTINCT account) AS accounts,
CAST(count(*) FILTER (WHERE k % 2 = 0) + sum(slides) + count(DISTINCT c) FILTER (WHERE c % 2 = 0) AS BIGINT) AS media_jobs_total,
CAST(sum(slides) + count(DISTINCT c) FILTER (WHERE c % 2 = 0) + count(*) FILTER (WHERE k % 4 = 2) AS BIGINT) AS pending FROM o""")
def plan_report(spark, sf):
    """A18, A19, G-16: covers of every second planned post are there, one in four of them empty."""
    planned = media.plan_posts(captured(spark, sf))
    jobs = settle(media.download_jobs(planned).select("kind", "account", "post_id", "path"))  # read as jobs and as what is there
    k = F.col("post_id").cast("long")
    present = jobs.where("kind = 'cover'").select("path", F.when(k % 4 == 0, 10).otherwise(0).alias("length"))
    return media.plan_report(planned, jobs, present).withColumn("accounts", F.size("accounts").cast("long"))


@query(_POSTS + """SELECT 'Cust' || c AS account, pid AS post_id, 'https://www.tiktok.com/@x/video/' || k AS url, 'https://cdn.example/' || k || '.mp4?x=1' || CASE WHEN k % 3 = 2 AND k % 4 = 3 THEN ' https://b.example/' || k ELSE '' END AS direct, CAST(k % 1000 AS VARCHAR) AS views FROM o
WHERE NOT (k % 3 = 0 OR k % 10 = 3) AND k % 2 = 1""")
def video_plan(spark, sf):
    """F3, F21, F23, F24, G-5, J13, L3, P5: post folders with raw.json, some without the page's URL, some with slides on disk."""
    c = captured(spark, sf).where("o_orderkey % 2 = 1")
    raw = F.try_parse_json(F.when(F.col("o_orderkey") % 4 == 1, F.regexp_replace("raw_json", '"webVideoUrl"', '"other"')).otherwise(F.col("raw_json")))
    folder = F.col("o_orderkey").cast("string")
    tree = c.select(F.concat(F.lit("Cust"), F.col("o_custkey").cast("string")).alias("account"), folder.alias("post_id"), F.try_parse_json(F.to_json(F.struct(folder.alias("post_id")))).alias("meta"), raw.alias("raw"))
    slides = c.where("o_orderkey % 10 = 3").select(F.concat(F.lit("Cust"), F.col("o_custkey").cast("string")).alias("account"), folder.alias("post_id"))
    return media.video_plan(tree, slides).select("account", "post_id", "url", F.array_join("direct_urls", " ").alias("direct"), "views")


_MANIFEST = """SELECT 'image' AS kind, event_id, CASE event_type WHEN 'click' THEN 'downloaded' WHEN 'view' THEN 'existing' ELSE 'failed' END AS status, CAST(round(value * 100) AS BIGINT) AS bytes, 'i/' || event_id AS path FROM events WHERE event_id % 3 > 0
UNION ALL SELECT 'video', event_id, 'downloaded', CAST(round(value * 100) AS BIGINT), 'v/' || event_id FROM events WHERE event_id % 6 = 0
UNION ALL SELECT 'video', event_id, 'failed', NULL, NULL FROM events WHERE event_id % 6 = 3"""


def _manifests(spark, sf):
    e = table(spark, sf, "events", "event_id", "event_type", "value")
    size, name = F.round(F.col("value") * 100).cast("long").alias("bytes"), F.col("event_id").cast("string")
    status = F.when(F.col("event_type") == "click", "downloaded").when(F.col("event_type") == "view", "existing").otherwise("failed").alias("status")
    digest = F.sha2(name.cast("binary"), 256).alias("sha256")
    images = e.where("event_id % 3 > 0").select(F.lit("image").alias("kind"), "event_id", status, size, F.concat(F.lit("i/"), name).alias("path"), digest)
    videos = e.where("event_id % 6 = 0").select(F.lit("video").alias("kind"), "event_id", F.lit("downloaded").alias("status"), size, F.concat(F.lit("v/"), name).alias("path"), digest)
    return images, videos, e.where("event_id % 6 = 3").select(F.lit("video").alias("kind"), "event_id", F.lit("failed").alias("status"))


@query(_MANIFEST)
def manifest_union(spark, sf):
    """T1."""
    return media.merged_manifest(*_manifests(spark, sf)).drop("sha256")


@query(f"SELECT status, count(*) AS count FROM ({_MANIFEST}) GROUP BY status")
def download_status_counts(spark, sf):
    """A17."""
    return media.status_counts(media.merged_manifest(*_manifests(spark, sf)))


@query(f"SELECT path, bytes, sha256(split_part(path, '/', 2)) AS sha256 FROM ({_MANIFEST}) WHERE status IN ('downloaded', 'existing')")
def report_inventory(spark, sf):
    """P10."""
    return media.report_inventory(media.merged_manifest(*_manifests(spark, sf)))


@query(f"SELECT count(*) FILTER (WHERE status = 'failed' AND kind = 'image') AS images_failed, count(*) FILTER (WHERE status = 'failed' AND kind = 'video') AS videos_failed FROM ({_MANIFEST})")
def failure_totals(spark, sf):
    """A22."""
    return media.failure_totals(media.merged_manifest(*_manifests(spark, sf)))


@query("""SELECT count(*) FILTER (WHERE event_id % 3 = 0) AS discovered_video_posts, count(*) FILTER (WHERE event_id % 6 = 0) AS downloaded_or_cached,
CAST(sum(CAST(round(value * 100) AS BIGINT)) FILTER (WHERE event_id % 6 = 0) AS BIGINT) AS total_bytes, count(*) FILTER (WHERE event_id % 6 = 3) AS failed FROM events""")
def video_report(spark, sf):
    """A20."""
    _, videos, failed = _manifests(spark, sf)
    return media.video_report(table(spark, sf, "events", "event_id").where("event_id % 3 = 0"), videos.withColumnRenamed("bytes", "file_size_bytes"), failed)


@query("SELECT 'i/' || event_id AS path FROM events WHERE event_id % 3 > 0 AND event_id % 4 > 0 AND event_id % 5 > 0 AND round(value * 100) > 0")
def usable_cache(spark, sf):
    """G-14, J11, P9: attested files, of which some have other bytes and some another source by now."""
    images, _, _ = _manifests(spark, sf)
    f = images.select("path", "event_id", "sha256", F.col("bytes").alias("length")).withColumn("source_fingerprint", F.lit("s"))
    now = f.select("path", F.when(F.col("event_id") % 4 == 0, "t").otherwise("s").alias("source_fingerprint"), "sha256", (F.col("length") + (F.col("event_id") % 5 == 0).cast("long")).alias("bytes"))
    return media.usable(now, media.attested(f)).select("path")


@query(_POSTS + _FILES + """SELECT 'POST-' || upper(substr(sha1(account || chr(0) || pid), 1, 12)) AS post_uid, role AS kind, CAST(idx AS INTEGER) AS "index", relative, 'sha256:' || h AS asset_id FROM f WHERE length > 0""")
def media_references(spark, sf):
    """Files attached to posts, folders in other case than the account."""
    return media.attachments(held(spark, sf))[0].select("post_uid", "kind", "index", "relative", "asset_id")


_GAPS = """, g AS (SELECT k, role AS kind, idx, 'empty_file' AS reason FROM f WHERE length = 0
UNION ALL SELECT k, 'cover', NULL, 'not_found' FROM o WHERE k NOT IN (SELECT k FROM f WHERE role = 'cover')
UNION ALL SELECT k, 'avatar', NULL, 'not_found' FROM o WHERE c % 2 = 0
UNION ALL SELECT k, 'video', NULL, 'not_found' FROM o WHERE kind = 'video' AND k NOT IN (SELECT k FROM f WHERE role = 'video')
UNION ALL SELECT k, 'slide', i, 'not_found' FROM (SELECT k, unnest(range(1, CAST(slides AS BIGINT) + 1)) AS i FROM o WHERE kind = 'slideshow') e WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.k = e.k AND f.role = 'slide' AND f.idx = e.i)
UNION ALL SELECT k, 'slide', NULL, 'no_slide_inventory' FROM o WHERE kind = 'slideshow' AND slides = 0 AND k NOT IN (SELECT k FROM f WHERE role = 'slide' AND length > 0))"""


@query(_POSTS + _FILES + _GAPS + """SELECT g.kind, CAST(idx AS INTEGER) AS "index", reason, pid AS post_id FROM g JOIN o ON o.k = g.k""")
def media_gaps(spark, sf):
    """J4, J5, T3."""
    return media.attachments(held(spark, sf))[1].select("kind", "index", "reason", "post_id")


@query(_POSTS + _FILES + """, r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY lower(account), pid, CASE role WHEN 'video' THEN 2 ELSE 0 END, relative) AS n FROM f WHERE length > 0)
SELECT 'sha256:' || h AS asset_id, 'assets/' || CASE role WHEN 'video' THEN 'videos/' ELSE 'images/' END || h || CASE role WHEN 'video' THEN '.mp4' ELSE '.jpg' END AS path,
CASE role WHEN 'video' THEN 'video/mp4' ELSE 'image/jpeg' END AS mime_type, CAST(length AS BIGINT) AS bytes, (SELECT count(*) FROM r q WHERE q.h = r.h) AS n_sources FROM r WHERE n = 1""")
def asset_inventory(spark, sf):
    """A12, F29, F30, J6, W7."""
    a = media.attachments(held(spark, sf))[2]
    return a.select("asset_id", "path", "mime_type", "bytes", F.size("source_paths").cast("long").alias("n_sources"))


@query(_POSTS + _FILES + _GAPS + """SELECT pid AS post_id, CAST(slides AS INTEGER) AS expected_slide_count, CAST((SELECT count(DISTINCT idx) FROM f WHERE f.k = o.k AND role = 'slide' AND length > 0) AS INTEGER) AS available_slide_count,
CASE WHEN k IN (SELECT k FROM g) THEN 'incomplete' ELSE 'complete' END AS media_status,
CAST((SELECT count(DISTINCT h) FROM f WHERE f.k = o.k AND role = 'video' AND length > 0) AS INTEGER) AS videos FROM o""")
def post_envelopes(spark, sf):
    """A11, A13, A14."""
    e = media.enveloped(held(spark, sf))
    return e.select("post_id", "expected_slide_count", "available_slide_count", "media_status", F.size("media.videos").alias("videos"))


@query(_POSTS + _FILES + """, a AS (SELECT DISTINCT k, role, idx, h FROM f WHERE length > 0) SELECT pid AS post_id, role, count(*) AS n FROM a JOIN o ON o.k = a.k GROUP BY ALL""")
def referenced_assets(spark, sf):
    """A reader joins envelopes with the inventory."""
    h = held(spark, sf)
    named = media.with_assets(media.enveloped(h), media.attachments(h)[2])
    return named.groupBy("post_id", "role").agg(F.count("*").alias("n"))


@query(_POSTS + _FILES + "SELECT 'cust' || c AS account_dir, pid AS post_dir, 'file:///' || relative AS path FROM f WHERE role = 'video' AND length > 0")
def largest_video(spark, sf):
    """O5."""
    return media.largest_file(files(spark, sf))


@query("""SELECT 'Cust' || c_custkey AS account, CASE WHEN c_custkey % 4 = 0 THEN 'Cust' || c_custkey ELSE 'cust' || c_custkey END AS account_dir, c_custkey % 4 = 3 AS ambiguous FROM customer""")
def folder_of_account(spark, sf):
    """Folders in other case; the exact name wins; two others are ambiguous."""
    c = table(spark, sf, "customer", "c_custkey")
    k = F.col("c_custkey").cast("string")
    of = lambda head, cond: c.where(cond).select(F.concat(F.lit(head), k).alias("account_dir"))
    dirs = of("cust", F.lit(True)).union(of("Cust", "c_custkey % 4 = 0")).union(of("CUST", "c_custkey % 4 = 3"))
    return scans.account_directory(dirs, c.select(F.concat(F.lit("Cust"), k).alias("account")))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'b' WHEN event_id % 4 = 1 THEN 'a' WHEN event_id % 4 = 2 THEN 'c' END AS source, 3 - CASE WHEN event_id % 4 = 1 THEN 2 ELSE 0 END AS tried FROM events""")
def first_success(spark, sf):
    """L2: candidates in order; what follows the first success is never needed."""
    e = table(spark, sf, "events", "event_id")
    m = F.col("event_id") % 4
    a = F.array(F.struct(F.lit(2).alias("n"), (m == 0).alias("ok"), F.lit("b").alias("source")), F.struct(F.lit(3).alias("n"), (m == 2).alias("ok"), F.lit("c").alias("source")), F.struct(F.lit(1).alias("n"), (m == 1).alias("ok"), F.lit("a").alias("source")))
    return e.select("event_id", U.first_success(a)["source"].alias("source"), F.when(m == 1, 1).otherwise(3).alias("tried"))


@query("""SELECT event_id, event_type || ':' || CASE WHEN event_id % 2 = 0 THEN '404,500' ELSE '404' END || ':e2,e3' AS summary FROM events""")
def failure_summary(spark, sf):
    """Per candidate its HTTP statuses and last two errors."""
    e = table(spark, sf, "events", "event_id", "event_type")
    a = F.array(F.struct(F.col("event_type").alias("source"), F.array(F.lit(404), F.lit(None).cast("int"), F.when(F.col("event_id") % 2 == 0, 500)).alias("statuses"), F.array(F.lit("e1"), F.lit("e2"), F.lit("e3")).alias("errors")))
    s = U.failure_summary(a)[0]
    return e.select("event_id", F.concat_ws(":", s["source"], F.array_join(s["statuses"].cast("array<string>"), ","), F.array_join(s["errors"], ",")).alias("summary"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN TRUE ELSE FALSE END AND event_id % 7 > 0 AND event_id % 3 > 0 AS ok FROM events""")
def http_acceptable(spark, sf):
    """200, a body, and an image's, a plain binary's or no content type."""
    e, k = table(spark, sf, "events", "event_id"), F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("Image/PNG; q=1", "application/octet-stream", "", "text/html", "application/json"))), (k % 5 + 1).cast("int"))
    return e.select("event_id", U.acceptable_image(F.when(k % 7 == 0, 404).otherwise(200), kind, F.when(k % 3 == 0, 0).otherwise(9)).alias("ok"))


@query("""SELECT page_id, page_id % 4 = 0 AS provider, page_id % 4 = 3 AS platform FROM pages""")
def url_hosts(spark, sf):
    """F25, F26."""
    p, k = table(spark, sf, "pages", "page_id"), F.col("page_id")
    url = F.element_at(F.array(*map(F.lit, ("https://API.apify.com/v2?x=1", "http://apify.com/", "https://notapify.com/", "https://p16.TikTokCDN.com/a.jpg"))), (k % 4 + 1).cast("int"))
    return p.select("page_id", U.is_provider_url(url).alias("provider"), U.is_platform_url(url).alias("platform"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber - 1 = 0 THEN NULL ELSE CAST(l_partkey AS DOUBLE) / (l_linenumber - 1) END AS fps FROM lineitem")
def frame_rates(spark, sf):
    """F32."""
    l = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return l.select("*", U.frame_rate(F.concat_ws("/", F.col("l_partkey").cast("string"), (F.col("l_linenumber") - 1).cast("string"))).alias("fps"))


@query("""SELECT page_id, '[REDACTED]' AS api_key, 'x ' || CASE WHEN page_id % 2 = 0 THEN 'Bearer [REDACTED]' ELSE 'plain' END AS note, '{"a": {"secret_id": "[REDACTED]", "n": [' || page_id || ', "?token=[REDACTED]&b"]}}' AS nested FROM pages""")
def redacted_fields(spark, sf):
    """secret-named keys whole, credentials by pattern, at any depth."""
    p, k = table(spark, sf, "pages", "page_id"), F.col("page_id").cast("string")
    m = redaction.redact_fields(F.create_map(F.lit("api_KEY"), k, F.lit("note"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("x Bearer "), k)).otherwise("x plain")))
    nested = F.concat(F.lit('{"a": {"secret_id": [1, "z"], "n": ['), k, F.lit(', "?token=abc&b"]}}'))
    return p.select("page_id", m["api_KEY"].alias("api_key"), m["note"].alias("note"), redaction.redact_json(nested).alias("nested"))


@query("""SELECT page_id, CAST(2 AS BIGINT) AS line, CASE page_id % 4 WHEN 0 THEN 'AWS key' WHEN 1 THEN 'GitHub token' WHEN 2 THEN 'personal machine path' ELSE 'private key' END AS category FROM pages""")
def secret_lines(spark, sf):
    """Location and category of each finding, never the match."""
    p, k = table(spark, sf, "pages", "page_id", "html"), F.col("page_id")
    planted = F.element_at(F.array(F.concat(F.lit("AKIA"), F.lit("ABCD" * 4)), F.concat(F.lit("ghp_"), F.repeat(F.lit("a1"), 16)), F.lit("see /home/someone/x"), F.concat(F.lit("-----BEGIN "), F.lit("RSA PRIVATE KEY-----"))), (k % 4 + 1).cast("int"))
    text = F.concat(F.lit("first\n"), planted, F.lit("\nlast "), F.regexp_replace("html", r"[^a-z ]", " "))
    found = redaction.audit(p.select(k.alias("file"), text.alias("text")))
    return found.select(F.col("file").alias("page_id"), F.col("line").cast("long").alias("line"), "category")


@query("SELECT page_id AS file, CAST(page_id + 1 AS VARCHAR) || '.md' AS target FROM pages WHERE page_id + 1 NOT IN (SELECT page_id FROM pages WHERE page_id % 2 = 0)")
def broken_links(spark, sf):
    """Relative targets that are no file; addresses and anchors don't count."""
    p, k = table(spark, sf, "pages", "page_id"), F.col("page_id")
    docs = p.select(k.alias("file"), F.concat(F.lit("see [x]("), (k + 1).cast("string"), F.lit(".md) and [y](https://e.org/z) and [z](#top)")).alias("text"))
    return redaction.broken_links(docs, p.where("page_id % 2 = 0").select(F.concat(k.cast("string"), F.lit(".md")).alias("file")))


@query("SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def ambiguous_positions(spark, sf):
    """W11."""
    return inventory.ambiguous_positions(table(spark, sf, "lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey"], "l_linenumber")


@query("SELECT user_id AS account, CAST(max(event_id) AS VARCHAR) AS name FROM events GROUP BY user_id")
def account_profiles(spark, sf):
    """The last author record of each account."""
    e = table(spark, sf, "events", "user_id", "event_id")
    raw = F.to_json(F.struct(F.col("user_id").cast("string").alias("input"), F.struct(F.col("event_id").cast("string").alias("name")).alias("authorMeta")))
    p = normalize.profiles(e.select(F.try_parse_json(raw).alias("raw"), "event_id"), ["event_id"])
    return p.select(F.col("account").cast("long").alias("account"), F.get_json_object("author", "$.name").alias("name"))


@query(_POSTS + """SELECT account, pid AS post_id, kind AS content_type, CAST(k % 1000 AS VARCHAR) AS views, '' AS likes, CAST(0 AS VARCHAR) AS video_count, CAST(slides AS VARCHAR) AS expected_slide_count FROM o""")
def flat_posts(spark, sf):
    """K6, K7: the flat copy takes the envelope's value, else the metadata's, and nothing for null."""
    posts = settle(keyed(spark, sf))
    n = F.try_parse_json(F.to_json(F.struct(get(F.col("raw"), "playCount").alias("views"))))
    empty = files(spark, sf).where("false")
    e = media.envelopes(posts, media.held(posts, empty)).withColumns({"metadata": n, "account_id": F.lit(""), "platform": F.lit("")})
    return export.csv_rows(e).select("account", "post_id", "content_type", "views", "likes", "video_count", "expected_slide_count")


@query(_POSTS + """SELECT CASE WHEN k % 5 = 0 THEN 'v' || k ELSE pid END AS post_id, 'False' AS is_pinned, CAST(k % 1000 AS VARCHAR) AS views, CASE WHEN k % 6 = 0 THEN 'many' ELSE '' END AS likes, o_orderstatus || '|null' AS hashtags, '' AS error_code FROM o""")
def normalized_csv(spark, sf):
    """K6."""
    return export.normalized_csv(normalize.normalize(captured(spark, sf))).select("post_id", "is_pinned", "views", "likes", "hashtags", "error_code")


@query(_POSTS + """SELECT pid AS post_id, kind = 'slideshow' AND k % 3 = 0 AS is_slideshow, CAST(k % 1000 AS BIGINT) AS views, CAST(slides AS INTEGER) AS slide_count, 'cust' || c AS author, o_orderstatus || ',null' AS hashtags FROM o""")
def compact_metadata(spark, sf):
    """F17."""
    m = normalize.compact_metadata(captured(spark, sf), "stem").select("meta.*")
    return m.select("post_id", "is_slideshow", "views", "slide_count", F.col("author.name").alias("author"), F.array_join("hashtags", ",").alias("hashtags"))


@query(_POSTS + "SELECT CAST(row_number() OVER (ORDER BY lower(account), strftime(o_orderdate, '%Y-%m-%d'), CASE WHEN k % 5 = 0 THEN 'v' || k ELSE pid END) AS BIGINT) AS position, CASE WHEN k % 5 = 0 THEN 'v' || k ELSE pid END AS post_id FROM o WHERE k % 10 <> 7")
def normalized_order(spark, sf):
    """Deduplicated rows in their published order, numbered without one task that sorts them all."""
    n = normalize.normalized_posts(normalize.split_items(captured(spark, sf))[0], ["source_file", "record"])
    n = n.select("post_id", F.lower("account").alias("a"), F.coalesce("created_at", F.lit("")).alias("c"))
    return inventory.numbered(n, ["a", "c", "post_id"], "position").select("position", "post_id")


@query("""WITH o AS (SELECT 'cust' || o_custkey AS account, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders),
p AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY d DESC, '{"id":"' || o_orderkey || '"}') AS position FROM o)
SELECT account, position, d AS created_at, CAST(o_orderkey AS VARCHAR) AS post_id FROM p WHERE position <= 5 AND d >= '1994-03-01' AND d <= '1997-09-30'""")
def provider_bounds(spark, sf):
    """Orders as a provider's pages, read through the source with its pushed post limit and dates."""
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    folder = shared_folder(spark)
    provider.publish(o.select(F.concat(F.lit("cust"), F.col("o_custkey").cast("string")).alias("account"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"), F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("id"))).alias("item")), folder)
    got = provider.requested(provider.items(spark, folder), max_posts=5, oldest="1994-03-01", newest="1997-09-30")
    return got.select("account", "position", "created_at", F.get_json_object("item", "$.id").alias("post_id"))


@query("""WITH j AS (SELECT o_orderkey AS k, '{"o_orderkey":' || o_orderkey || ',"status":"' || o_orderstatus || '","class":"' || o_orderpriority || '"}' || chr(10) AS l, o_orderkey || ',' || o_orderstatus || ',' || o_orderpriority || chr(13) || chr(10) AS c FROM orders)
SELECT 'orders.jsonl' AS file, CAST(coalesce(sum(octet_length(encode(l))), 0) AS BIGINT) AS bytes, sha256(coalesce(string_agg(l, '' ORDER BY k), '')) AS sha256, count(*) AS lines FROM j
UNION ALL SELECT 'orders.csv', CAST(coalesce(sum(octet_length(encode(c))), 0) + 28 AS BIGINT), sha256(chr(65279) || 'o_orderkey,status,class' || chr(13) || chr(10) || coalesce(string_agg(c, '' ORDER BY k), '')), count(*) FROM j""")
def published_lines(spark, sf):
    """K2, K7: orders through the ordered sink, as JSON lines and CSV; what the joining of the parts answers for each file."""
    o = table(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority").withColumnsRenamed({"o_orderstatus": "status", "o_orderpriority": "class"}).orderBy("o_orderkey")
    folder = shared_folder(spark)
    lines.write_parts(lines.json_lines(o), f"{folder}/j")
    lines.write_parts(o.select(F.col("o_orderkey").cast("string"), "status", "class"), f"{folder}/c", "csv")
    done = lines.publish(spark, [(f"{folder}/j", f"{folder}/orders.jsonl", b""), (f"{folder}/c", f"{folder}/orders.csv", lines.csv_header(("o_orderkey", "status", "class")))])
    return done.select(F.regexp_extract("file", "([^/]+)$", 1).alias("file"), "bytes", "sha256", "lines")


def document_files(spark: SparkSession, sf: str) -> str:
    """A folder with a file of each document's text, a thousand ids to a folder in it."""
    folder = shared_folder(spark)

    def write(batches):
        filesystem, root = disk.opened(folder)
        made = set()
        filesystem.create_dir(root, recursive=True)
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if (own := i // 1000) not in made:
                    filesystem.create_dir(f"{root}/{own}", recursive=True)
                    made.add(own)
                with filesystem.open_output_stream(f"{root}/{own}/{i}.txt", compression=None) as f:
                    f.write((t or "").encode())
                yield {"doc_id": [i]}

    disk.arrow(table(spark, sf, "documents", "doc_id", "text"), write, "doc_id long").write.format("noop").mode("overwrite").save()
    return folder


@query("SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS length, sha256(coalesce(text, '')) AS sha256 FROM documents")
def file_digests(spark, sf):
    """a file of each document's text, listed, dealt to tasks by bytes and hashed as streams."""
    found = scans.listed(spark, document_files(spark, sf))
    hashed = found.join(disk.digests(found).select("path", "sha256"), "path")
    return hashed.select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).cast("long").alias("doc_id"), "length", "sha256")


@query("""SELECT o_orderkey, CAST(place + coalesce(sum(CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line, place
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders)""")
def numbered_records(spark, sf):
    """Orders as one file of JSON lines, some blank, scanned by byte ranges; every line's numbers as in the whole file."""
    o = table(spark, sf, "orders", "o_orderkey").orderBy("o_orderkey")
    line = F.concat(F.to_json(F.struct("o_orderkey")), F.when(F.col("o_orderkey") % 7 == 0, F.lit("\n  \r")).otherwise(F.lit("\r")))
    folder = shared_folder(spark)
    lines.write_parts(o.select(line.alias("value")), f"{folder}/parts")
    lines.publish(spark, [(f"{folder}/parts", f"{folder}/orders.jsonl", b"")])
    got = ranges.numbered_lines(spark, f"{folder}/orders.jsonl", 1 << 16)
    return got.select(F.get_json_object("value", "$.o_orderkey").cast("long").alias("o_orderkey"), "line", "place")


@query("""WITH o AS (SELECT 'cust' || (o_custkey % 40) AS key, CAST(o_orderkey % 61 AS VARCHAR) AS post_id, o_orderstatus AS payload, o_orderkey % 3 AS batch, o_orderkey FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY key, post_id ORDER BY batch, o_orderkey) AS n FROM o)
SELECT key, post_id, max(CASE WHEN n = 1 THEN payload END) AS payload, count(*) AS rows, count(DISTINCT payload) > 1 AS conflict FROM r GROUP BY key, post_id""")
def stateful_first_wins(spark, sf):
    """W1, W3 on a stream: orders arrive in three batches, and the state keeps who was first."""
    folder = shared_folder(spark)
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    rows = o.select(F.concat(F.lit("Cust"), (F.col("o_custkey") % 40).cast("string")).alias("account"), (F.col("o_orderkey") % 61).cast("string").alias("post_id"), F.col("o_orderstatus").alias("payload"), F.col("o_orderkey").cast("long").alias("line"))
    for batch in range(3):
        rows.where(F.col("line") % 3 == batch).write.mode("append").parquet(f"{folder}/in")
        ingest.deduplicate(spark, spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), ["line"], f"{folder}/out", f"{folder}/mark")
    return ingest.outcome(spark, f"{folder}/out")


@query("""WITH n AS (SELECT CASE WHEN doc_id % 89 = 3 THEN doc_id + 1000000000 ELSE doc_id END AS id, CASE WHEN doc_id % 97 = 5 THEN coalesce(text, '') || '!' ELSE text END AS t FROM documents WHERE doc_id % 101 <> 7)
SELECT CAST(coalesce(d.doc_id, n.id) AS VARCHAR) AS key, CASE WHEN d.doc_id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM documents d FULL OUTER JOIN n ON d.doc_id = n.id WHERE d.doc_id IS NULL OR n.id IS NULL OR d.text IS DISTINCT FROM n.t""")
def changed_documents(spark, sf):
    """A21's tree: two versions of the documents as stored hash trees, and what differs between them."""
    d = table(spark, sf, "documents", "doc_id", "text")
    later = d.where("doc_id % 101 <> 7").select(F.when(F.col("doc_id") % 89 == 3, F.col("doc_id") + 1_000_000_000).otherwise(F.col("doc_id")).alias("doc_id"), F.when(F.col("doc_id") % 97 == 5, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")).alias("text"))
    leaf = lambda df: df.select("doc_id", F.sha2("text", 256).alias("digest"))
    folder = shared_folder(spark)
    old = hashtree.build(leaf(d), "doc_id", "digest", f"{folder}/1")
    return hashtree.changes(old, hashtree.build(leaf(later), "doc_id", "digest", f"{folder}/2", old))


@query(_POSTS + _FILES + _GAPS + """, u AS (SELECT * FROM f WHERE length > 0), a AS (SELECT h, arg_min(role, (lower(account), pid, CASE role WHEN 'video' THEN 2 ELSE 0 END, relative)) AS role, any_value(length) AS length FROM u GROUP BY h)
SELECT 'posts' AS name, count(*) AS n FROM o UNION ALL SELECT 'accounts', count(DISTINCT account) FROM o UNION ALL SELECT 'content_types.' || kind, count(*) FROM o GROUP BY kind
UNION ALL SELECT 'duplicate_post_rows_removed', 3 UNION ALL SELECT 'source_media_files', count(DISTINCT relative) FROM u UNION ALL SELECT 'empty_media_files', 0 UNION ALL SELECT 'source_media_by_role.' || role, count(DISTINCT relative) FROM u GROUP BY role
UNION ALL SELECT 'unique_assets', count(*) FROM a UNION ALL SELECT 'unique_assets_by_type.' || CASE role WHEN 'video' THEN 'video' ELSE 'image' END, count(*) FROM a GROUP BY 1
UNION ALL SELECT 'asset_bytes', CAST(coalesce(sum(length), 0) AS BIGINT) FROM a UNION ALL SELECT 'missing_assets', count(*) FROM g UNION ALL SELECT 'posts_with_missing_assets', count(DISTINCT k) FROM g""")
def manifest_counts(spark, sf):
    """The manifest's counts, a row each."""
    h = held(spark, sf)
    refs, gaps, assets, _ = media.attachments(h)
    n = export.counts(h.withColumn("account_id", identity.account_id(F.col("account"))), gaps, assets, refs.select("kind", "relative", "length"), 3)
    rows = [(k, v) for k, v in n.items() if not isinstance(v, dict)] + [(f"{k}.{x}", v) for k, d in n.items() if isinstance(d, dict) for x, v in d.items()]
    return spark.createDataFrame(rows, "name string, n long")  # a few figures


@query(_POSTS + _FILES + """, r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY lower(account), pid, CASE role WHEN 'video' THEN 2 ELSE 0 END, relative) AS n FROM f WHERE length > 0)
SELECT 'sha256:' || h AS asset_id, 'media/' || relative AS first_source FROM r WHERE n = 1""")
def asset_sources(spark, sf):
    """the label of the file that each asset was seen in first."""
    return media.attachments(held(spark, sf))[2].select("asset_id", F.col("source_paths")[0].alias("first_source"))


@query("""SELECT p_partkey, 'sha1_' || substr(sha1('{"a": ' || p_partkey || ', "b": "' || p_name || '", "c": [1, null]}'), 1, 20) AS post_id FROM part""")
def payload_identities(spark, sf):
    """F9's fallback, F10: items that carry no id are named by their payload's digest, keys sorted."""
    p = table(spark, sf, "part", "p_partkey", "p_name")
    p = p.withColumn("raw_json", F.to_json(F.struct(F.array(F.lit(1), F.lit(None).cast("int")).alias("c"), F.col("p_name").alias("b"), F.col("p_partkey").alias("a")), {"ignoreNullFields": "false"}))
    return p.select("p_partkey", identity.capture_post_id(F.try_parse_json("raw_json"), F.col("raw_json")).alias("post_id"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 10 <> 9 THEN CAST(l_quantity AS DOUBLE) / 4 END AS duration_seconds, CASE WHEN l_partkey % 10 <> 9 THEN l_partkey END AS file_size_bytes,
CASE WHEN l_partkey % 10 <> 9 AND l_partkey % 3 > 0 THEN 'h26' || (l_partkey % 3) END AS video_codec, CASE WHEN l_partkey % 10 <> 9 AND l_partkey % 3 > 0 THEN l_suppkey END AS width,
CASE WHEN l_partkey % 10 <> 9 AND l_partkey % 3 > 0 AND l_suppkey % 4 > 0 THEN CAST(l_suppkey AS DOUBLE) / (l_suppkey % 4) END AS fps, CASE WHEN l_partkey % 10 <> 9 THEN l_linenumber % 2 = 0 END AS has_audio,
CASE WHEN l_partkey % 10 <> 9 AND l_linenumber % 2 = 0 THEN 'aac' END AS audio_codec FROM lineitem""")
def probe_columns(spark, sf):
    """A media probe's answers to columns; some have a duration that is no number, some no video, some a frame rate over zero."""
    l = spread(table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    text = lambda c: F.col(c).cast("string")
    part = F.col("l_partkey")
    shape = F.struct(F.when(part % 10 == 9, "N/A").otherwise((F.col("l_quantity").cast("double") / 4).cast("string")).alias("duration"), text("l_partkey").alias("size"))
    stream = lambda kind, name, width, rate: F.struct(F.lit(kind).alias("codec_type"), name.alias("codec_name"), width.cast("long").alias("width"), rate.alias("r_frame_rate"))
    none = F.lit(None).cast("string")
    video = F.when(part % 3 > 0, stream("video", F.concat(F.lit("h26"), (part % 3).cast("string")), F.col("l_suppkey"), F.concat(text("l_suppkey"), F.lit("/"), (F.col("l_suppkey") % 4).cast("string"))))
    audio = F.when(F.col("l_linenumber") % 2 == 0, stream("audio", F.lit("aac"), F.lit(None), none))
    answer = F.to_json(F.struct(shape.alias("format"), F.array_compact(F.array(audio, video)).alias("streams")))
    found = l.select("l_orderkey", "l_linenumber", answer.alias("answer")).select("l_orderkey", "l_linenumber", U.probe(F.col("answer")).alias("p"))
    return found.select("l_orderkey", "l_linenumber", *(f"p.{c}" for c in ("duration_seconds", "file_size_bytes", "video_codec", "width", "fps", "has_audio", "audio_codec")))


@query("""WITH h AS (SELECT o_orderkey AS k, o_orderstatus AS p FROM orders WHERE o_orderkey % 3 > 0), a AS (SELECT l_orderkey AS k, CASE WHEN l_orderkey % 7 = 0 THEN 'X' WHEN l_orderkey % 11 = 0 AND l_linenumber = 1 THEN 'Y' ELSE o_orderstatus END AS p
FROM lineitem JOIN orders ON o_orderkey = l_orderkey) SELECT CAST(a.k AS VARCHAR) AS k, count(*) AS rows, CASE WHEN count(DISTINCT a.p) > 1 OR bool_or(h.p <> a.p) THEN 'conflict' WHEN any_value(h.k) IS NOT NULL THEN 'duplicate' ELSE 'new' END AS status
FROM a LEFT JOIN h ON a.k = h.k GROUP BY a.k""")
def history_outcomes(spark, sf):
    """W3, W4, W5 against a history: order lines arrive, and are held against the orders stored by key."""
    o = table(spark, sf, "orders", "o_orderkey", "o_orderstatus")
    stored = history.History.create(o.where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("p")), ["k"], "p", shared_folder(spark), 16)
    l = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    p = F.when(F.col("l_orderkey") % 7 == 0, "X").when((F.col("l_orderkey") % 11 == 0) & (F.col("l_linenumber") == 1), "Y").otherwise(F.col("o_orderstatus"))
    return stored.outcomes(l.select(F.col("l_orderkey").alias("k"), p.alias("p")), "p").select("k", "rows", "status")


@query("""WITH v AS (SELECT l_orderkey, 'file:///m/' || l_orderkey || '/v' || l_linenumber || '_' || l_partkey || '.mp4' AS path, l_partkey % 4 * 100 AS length FROM lineitem)
SELECT CAST(l_orderkey AS VARCHAR) AS post_dir, arg_max(path, (length, path)) AS path FROM v WHERE length > 0 GROUP BY l_orderkey""")
def largest_of_several(spark, sf):
    """Of several videos of a folder the largest, of equal ones the last path; empty ones don't count."""
    l = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    key = F.col("l_orderkey").cast("string")
    path = F.concat(F.lit("file:///m/"), key, F.lit("/v"), F.col("l_linenumber").cast("string"), F.lit("_"), F.col("l_partkey").cast("string"), F.lit(".mp4"))
    found = media.largest_file(l.select(F.lit("m").alias("account_dir"), key.alias("post_dir"), path.alias("path"), (F.col("l_partkey") % 4 * 100).cast("long").alias("length")))
    return found.select("post_dir", "path")


def again(rows: DataFrame, where: str, record: str) -> DataFrame:
    """Some of the rows once more, at another place."""
    return rows.where(where).withColumn("record", F.expr(record).cast("long"))


@query(_POSTS + "SELECT account, pid AS post_id, CASE WHEN k % 2 = 0 THEN k + 1000000000 WHEN k % 5 = 1 THEN k + 2000000000 ELSE k END AS record FROM o")
def repeated_posts_planned(spark, sf):
    """Identical posts of one capture are planned once, as the last of them."""
    c = captured(spark, sf).withColumn("record", F.col("record").cast("long"))
    rows = c.unionByName(again(c, "o_orderkey % 2 = 0", "record + 1000000000")).unionByName(again(c, "o_orderkey % 2 = 1 and o_orderkey % 5 = 1", "record + 2000000000"))
    return media.plan_posts(rows).select("account", "post_id", "record")


@query(_POSTS + """SELECT CASE WHEN k % 5 = 0 THEN 'v' || k ELSE pid END AS post_id, CASE WHEN k % 3 = 1 THEN 'earlier ' ELSE '' END || o_orderpriority AS caption FROM o WHERE k % 10 <> 7""")
def repeated_posts_normalized(spark, sf):
    """Of posts that come again with another text the first stays, by record."""
    c = captured(spark, sf).withColumn("record", F.col("record").cast("long"))
    other = lambda rows, word: rows.withColumn("raw_json", F.regexp_replace("raw_json", '"desc":"', f'"desc":"{word} ')).withColumn("raw", F.try_parse_json("raw_json"))
    rows = c.unionByName(other(again(c, "o_orderkey % 3 = 0", "record + 1000000000"), "later")).unionByName(other(again(c, "o_orderkey % 3 = 1", "record - 1000000000"), "earlier"))
    return normalize.normalized_posts(normalize.split_items(rows)[0], ["source_file", "record"]).select("post_id", "caption")
