"""The engine's operators on the driver's tables: one query each, with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, media, redaction
from ..functions.variants import first_value, text
from ..operators import dedup, inventory
from . import capture_queries

QUERIES: dict = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def query(sql: str):
    def register(fn):
        QUERIES[fn.__name__] = fn
        SQL[fn.__name__] = sql
        return fn

    return register


def queries() -> dict:
    return QUERIES | capture_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL | capture_queries.SQL


@query("SELECT c_custkey, 'ACC-' || upper(substr(sha1(lower(c_name)), 1, 12)) AS account_id FROM customer")
def stable_account_id(spark, sf):
    return table(spark, sf, "customer", "c_custkey", "c_name").select("c_custkey", identity.account_id(F.col("c_name")).alias("account_id"))


@query("SELECT o_orderkey, 'POST-' || upper(substr(sha1(CAST(o_custkey AS VARCHAR) || chr(0) || CAST(o_orderkey AS VARCHAR)), 1, 12)) AS post_uid FROM orders")
def stable_post_uid(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey")
    return o.select("o_orderkey", identity.post_uid(F.col("o_custkey").cast("string"), F.col("o_orderkey")).alias("post_uid"))


@query("""SELECT 'sha256:' || sha256(text) AS asset_id, min(doc_id) AS first_seen, count(*) AS copies, CAST(any_value(octet_length(encode(text))) AS BIGINT) AS bytes
FROM documents GROUP BY sha256(text)""")
def asset_dedup(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"), F.octet_length("text").cast("long").alias("b"))
    return d.groupBy("h").agg(F.min("doc_id").alias("first_seen"), F.count("*").alias("copies"), F.first("b").alias("bytes")).select(F.concat(F.lit("sha256:"), "h").alias("asset_id"), "first_seen", "copies", "bytes")


@query("SELECT doc_id, source, 'not_found' AS reason FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_companions(spark, sf):
    gone = inventory.missing(table(spark, sf, "documents", "doc_id", "source"), table(spark, sf, "labels", "doc_id"), ["doc_id"])
    return gone.select("doc_id", "source", F.lit("not_found").alias("reason"))


@query("SELECT event_id, coalesce(nullif(json_extract_string(props, '$.missing'), ''), nullif(json_extract_string(props, '$.k'), '')) AS value FROM events")
def json_first_value(spark, sf):
    e = table(spark, sf, "events", "event_id", "props").withColumn("raw", F.try_parse_json("props"))
    return e.select("event_id", text(first_value(F.col("raw"), "missing", "k")).alias("value"))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS rows, count(DISTINCT l_partkey) AS payloads, CASE WHEN count(DISTINCT l_partkey) > 1 THEN 'conflict' ELSE 'identical' END AS verdict
FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_or_conflict(spark, sf):
    d = dedup.duplicates(table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").withColumn("p", F.col("l_partkey").cast("string")), ["l_orderkey", "l_linenumber"], "p")
    return d.withColumn("verdict", F.when(F.col("payloads") > 1, "conflict").otherwise("identical"))


@query("SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS removed FROM lineitem")
def duplicate_rows_removed(spark, sf):
    return dedup.removed_rows(table(spark, sf, "lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("SELECT conv_id, string_agg(role, '|' ORDER BY turn) AS roles, count(*) AS n FROM conversations GROUP BY conv_id")
def ordered_members(spark, sf):
    m = inventory.members(table(spark, sf, "conversations", "conv_id", "turn", "role"), ["conv_id"], "turn", "role")
    return m.select("conv_id", F.array_join("members", "|").alias("roles"), F.size("members").cast("long").alias("n"))


@query("""SELECT user_id, event_type, event_id, value FROM (
SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1""")
def first_wins_dedup(spark, sf):
    e = table(spark, sf, "events", "user_id", "event_type", "ts", "event_id", "value")
    return dedup.first_wins(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""SELECT user_id, event_type, event_id, value FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def last_wins_profile(spark, sf):
    e = table(spark, sf, "events", "user_id", "event_type", "event_id", "value", "ts")
    return dedup.last_wins(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""SELECT conv_id, count(turn) AS n, count(DISTINCT turn) AS distinct_positions, min(turn + 1) AS lowest, max(turn + 1) AS highest,
(min(turn + 1) = 1 AND max(turn + 1) = count(turn) AND count(turn) = count(DISTINCT turn)) AS contiguous FROM conversations GROUP BY conv_id""")
def contiguous_positions(spark, sf):
    c = table(spark, sf, "conversations", "conv_id", "turn").withColumn("p", F.col("turn") + 1)
    return inventory.contiguity(c, ["conv_id"], "p")


@query("""SELECT 'order_without_item' AS rule, o_orderkey AS key FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
UNION ALL SELECT DISTINCT 'item_without_order' AS rule, l_orderkey AS key FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)""")
def referential_violations(spark, sf):
    found = inventory.unmatched(table(spark, sf, "orders", F.col("o_orderkey").alias("key")), table(spark, sf, "lineitem", F.col("l_orderkey").alias("key")), "key")
    left = F.col("side") == "left"  # an order once for each of its rows, an item's key once
    return found.select(F.when(left, "order_without_item").otherwise("item_without_order").alias("rule"), "key", F.when(left, F.col("rows")).otherwise(1).alias("n")).select("rule", "key", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int")))).select("rule", "key")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN -1 ELSE l.quality END AS quality, CASE WHEN l.doc_id IS NULL THEN 0 ELSE l.toxic END AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def overlay_join(spark, sf):
    return inventory.overlay(table(spark, sf, "documents", "doc_id"), table(spark, sf, "labels"), ["doc_id"], {"quality": F.lit(-1), "toxic": F.lit(0)})


@query("SELECT lang AS content_type, count(*) AS posts, count(DISTINCT source) AS accounts FROM documents GROUP BY lang")
def content_type_counts(spark, sf):
    return table(spark, sf, "documents", "lang", "source").groupBy(F.col("lang").alias("content_type")).agg(F.count("*").alias("posts"), F.count_distinct("source").alias("accounts"))


@query("""SELECT source, count(*) AS posts, count(*) FILTER (WHERE l.doc_id IS NULL) AS incomplete,
CASE WHEN count(*) FILTER (WHERE l.doc_id IS NULL) > 0 THEN 'incomplete' ELSE 'complete' END AS status
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY source""")
def status_rollup(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "source")
    s = inventory.with_status(d, inventory.missing(d, table(spark, sf, "labels", "doc_id"), ["doc_id"]), "doc_id")
    n = F.count_if(F.col("status") == "incomplete")
    return s.groupBy("source").agg(F.count("*").alias("posts"), n.alias("incomplete"), F.when(n > 0, "incomplete").otherwise("complete").alias("status"))


@query("SELECT CAST((n - 1) // 4 + 1 AS BIGINT) AS chunk, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY n) AS members FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer) GROUP BY 1")
def batch_chunks(spark, sf):
    c = inventory.chunks(table(spark, sf, "customer", "c_custkey").withColumn("v", F.col("c_custkey").cast("string")), "c_custkey", "v", 4)
    return c.select("chunk", F.array_join("members", ",").alias("members"))


@query("""SELECT 'orders' AS name, count(*) AS rows, count(DISTINCT o_orderkey) AS distinct_keys, count(*) = count(DISTINCT o_orderkey) AS "unique" FROM orders
UNION ALL SELECT 'lineitem', count(*), count(DISTINCT (l_orderkey, l_linenumber)), count(*) = count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem""")
def unique_key_check(spark, sf):
    a = inventory.key_check(table(spark, sf, "orders", "o_orderkey"), ["o_orderkey"]).withColumn("name", F.lit("orders"))
    return a.unionByName(inventory.key_check(table(spark, sf, "lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"]).withColumn("name", F.lit("lineitem")))


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'left' ELSE 'right' END AS side
FROM (SELECT DISTINCT doc_id FROM documents) a FULL JOIN (SELECT DISTINCT doc_id FROM labels) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL""")
def set_equality(spark, sf):
    return inventory.difference(table(spark, sf, "documents", "doc_id"), table(spark, sf, "labels", "doc_id"), "doc_id")


@query("SELECT c_custkey, row_number() OVER (ORDER BY lower(c_mktsegment), coalesce(c_name, ''), c_custkey) AS position FROM customer")
def normalized_sort_rank(spark, sf):
    c = table(spark, sf, "customer", "c_custkey", "c_mktsegment", "c_name").withColumns({"k1": F.lower("c_mktsegment"), "k2": F.coalesce("c_name", F.lit(""))})
    return inventory.numbered(c, ["k1", "k2", "c_custkey"], "position").select("c_custkey", "position")


@query("""SELECT source, count(*) AS posts, count(DISTINCT sha256(text)) AS unique_assets, count(*) - count(DISTINCT sha256(text)) AS duplicate_rows,
count(*) FILTER (WHERE l.doc_id IS NULL) AS missing, CASE WHEN count(*) FILTER (WHERE l.doc_id IS NULL) > 0 THEN 'incomplete' ELSE 'complete' END AS status
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY source""")
def inventory_slice(spark, sf):
    """Publish-ready inventory: posts, distinct assets, duplicates, missing companions and status per source."""
    d = table(spark, sf, "documents", "doc_id", "source", "text").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    have = table(spark, sf, "labels", "doc_id").distinct().withColumn("have", F.lit(True))
    one = d.join(have, "doc_id", "left")
    gone, kinds = F.count_if(F.col("have").isNull()), F.count_distinct("h")
    return one.groupBy("source").agg(F.count("*").alias("posts"), kinds.alias("unique_assets"), (F.count("*") - kinds).alias("duplicate_rows"), gone.alias("missing"), F.when(gone > 0, "incomplete").otherwise("complete").alias("status"))


@query("""SELECT source, sha256(string_agg(h, chr(10) ORDER BY b)) AS fingerprint FROM (
SELECT source, doc_id % 65536 AS b, sha256(string_agg(CAST(doc_id AS VARCHAR) || ':' || sha256(text), chr(10) ORDER BY CAST(doc_id AS VARCHAR) || ':' || sha256(text))) AS h
FROM documents GROUP BY 1, 2) GROUP BY source""")
def snapshot_fingerprint(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "source", "text").withColumn("h", F.sha2(F.col("text").cast("binary"), 256))
    return inventory.fingerprint(d.select("source", "doc_id", "h"), ["source"], "doc_id", "h", F.pmod("doc_id", F.lit(65536)))


@query("""SELECT page_id, url AS first_url, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 2 END AS n FROM pages""")
def candidate_urls(spark, sf):
    p = table(spark, sf, "pages", "page_id", "url")
    c = media.candidates(("original", F.concat(F.lit(" "), "url")), ("empty", F.lit("  ")), ("other", F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.concat("url", F.lit("?copy")))))
    return p.select("page_id", c[0]["url"].alias("first_url"), F.size(c).alias("n"))


@query("""SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[EMAIL]', 'g'),
'(?i)(authorization\\s*[:=]\\s*(?:bearer\\s+)?|bearer\\s+|[?&](?:token|key|api_key|access_token)=)([^\\s&"'']+)', '\\1[REDACTED]', 'g')) AS redacted_sha256 FROM documents""")
def redact_text(spark, sf):
    t = F.regexp_replace("text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]")
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.sha2(redaction.redact(t).cast("binary"), 256).alias("redacted_sha256"))


@query("""SELECT conv_id, CAST(p AS INTEGER) AS position FROM (SELECT conv_id, unnest(range(1, n + 1)) AS p FROM (SELECT conv_id, max(turn) + 1 AS n FROM conversations GROUP BY conv_id))
WHERE (conv_id, p - 1) NOT IN (SELECT (conv_id, turn) FROM conversations WHERE role = 'user')""")
def expected_minus_present(spark, sf):
    c = table(spark, sf, "conversations", "conv_id", "turn", "role")
    want = inventory.expected_positions(c.groupBy("conv_id").agg((F.max("turn") + 1).alias("n")), ["conv_id"], "n", "position")
    have = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).cast("int").alias("position"))
    return inventory.missing(want, have, ["conv_id", "position"])


@query("SELECT user_id, max_by(event_id, (value, -event_id)) AS event_id, max(value) AS value FROM events GROUP BY user_id")
def largest_wins(spark, sf):
    e = table(spark, sf, "events", "user_id", "event_id", "value").withColumn("o", -F.col("event_id"))
    return dedup.last_wins(e, ["user_id"], ["value", "o"]).select("user_id", "event_id", "value")
