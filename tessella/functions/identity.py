"""Handles, stable identifiers, and the resolvers of account and post id, each with its own order."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .variants import first_string, first_truthy, first_value, get, is_object, text, truthy

# The host that handles may come with, and the shape of post URLs.
HANDLE_URL = r"(?i)tiktok\.com/@([^/?#]+)"
POST_URL = r"/(?:video|photo)/(\d+)"
UNKNOWN = "unknown"


def clean_handle(c: Column) -> Column:
    """Trim; take the handle out of a profile URL; strip leading @ and surrounding slashes; case stays."""
    c = F.trim(c)
    found = F.regexp_extract(c, HANDLE_URL, 1)
    return F.regexp_replace(F.regexp_replace(F.when(found != "", found).otherwise(c), r"^@+", ""), r"^/+|/+$", "")


def normalize_account(c: Column) -> Column:
    """Trim, drop one leading @, lower case (handles are ASCII where they reach a path)."""
    return F.lower(F.regexp_replace(F.trim(c), r"^@", ""))


def account_id(c: Column) -> Column:
    return F.concat(F.lit("ACC-"), F.upper(F.substring(F.sha1(normalize_account(c).cast("binary")), 1, 12)))


def post_uid(account: Column, post_id: Column) -> Column:
    """Display case counts, unlike in account_id."""
    return F.concat(F.lit("POST-"), F.upper(F.substring(F.sha1(F.concat(F.trim(account), F.char(F.lit(0)), F.trim(post_id.cast("string"))).cast("binary")), 1, 12)))


def capture_account(raw: Column) -> Column:
    """Of a captured item: non-blank strings only, else 'unknown'."""
    found = first_string(raw, "input", "authorMeta.name", "authorMeta.uniqueId", "author.uniqueId", "author.unique_id", "authorMeta.nickName")
    return F.coalesce(clean_handle(found), F.lit(UNKNOWN))


def download_account(raw: Column, fallback: Column) -> Column:
    """Of a post to plan downloads for."""
    found = F.coalesce(first_string(raw, "account", "input", "authorMeta.name"), F.when(F.trim(fallback) != "", fallback))
    return F.coalesce(clean_handle(found), F.lit(UNKNOWN))


def export_account(raw: Column, fallback: Column) -> Column:
    """Of a post to export: any truthy value; the author is authorMeta, or author where that is falsy."""
    author = F.when(truthy(get(raw, "authorMeta")), get(raw, "authorMeta")).otherwise(get(raw, "author"))
    own = F.coalesce(*(F.when(truthy(get(raw, p)), text(get(raw, p))) for p in ("account", "input")))
    inner = F.when(is_object(author), text(first_truthy(author, "name", "uniqueId", "unique_id")))
    return F.coalesce(clean_handle(F.coalesce(own, inner)), fallback)


def _url_id(raw: Column, *paths: str) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(F.coalesce(text(get(raw, p)), F.lit("")), POST_URL, 1), F.lit("")) for p in paths))


def _plain_ids(raw: Column) -> Column:
    value = lambda p: F.trim(text(get(raw, p)))
    return F.coalesce(*(F.nullif(value(p), F.lit("")) for p in ("post_id", "id", "idStr", "postId", "awemeId", "aweme_id")))


@F.pandas_udf(T.StringType())
def payload_id(raw_json: pd.Series) -> pd.Series:
    """'sha1_' and 20 hex digits of the payload's JSON with sorted keys, for items that carry no id."""
    return raw_json.map(lambda t: None if t is None else "sha1_" + hashlib.sha1(json.dumps(json.loads(t), sort_keys=True, ensure_ascii=False, default=str).encode("utf-8", "surrogatepass")).hexdigest()[:20])


def capture_post_id(raw: Column, raw_json: Column) -> Column:
    found = first_value(raw, "id", "idStr", "postId", "awemeId", "aweme_id", "videoMeta.id", "video.id")
    return F.coalesce(text(found), payload_id(F.when(found.isNull(), raw_json)))


def download_post_id(raw: Column, raw_json: Column) -> Column:
    found = F.coalesce(_plain_ids(raw), _url_id(raw, "webVideoUrl", "url", "postUrl"))
    return F.coalesce(found, payload_id(F.when(found.isNull(), raw_json)))


def export_post_id(raw: Column) -> Column:
    """Null where there is none: the export then refuses the row, eagerly, as a violation."""
    return F.coalesce(_plain_ids(raw), _url_id(raw, "url", "webVideoUrl", "postUrl"))


def safe_component(c: Column) -> Column:
    """May be one component of a path."""
    return c.rlike(r"^[a-zA-Z0-9_.@-]+$") & ~c.isin(".", "..")
