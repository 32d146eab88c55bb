"""The 26-column normaliser, compact metadata, profiles, content type, and the split of captured items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import capture_account, capture_post_id, download_account, download_post_id
from ..functions.variants import first_truthy, first_value, get, is_object, is_string, items, kind, parsed_once, present, text, truthy
from ..operators.dedup import first_wins, last_wins

# The candidate paths of each output column, in their order.
FIRST_OF = {
    "url": ("webVideoUrl", "url", "postUrl", "videoUrl", "shareUrl"),
    "caption": ("text", "desc", "description", "caption"),
    "created_at": ("createTimeISO", "createTime", "create_time", "timestamp", "publishedAt"),
    "is_pinned": ("isPinned", "pinned", "is_pinned"),
    "views": ("playCount", "stats.playCount", "stats.play_count", "views"),
    "likes": ("diggCount", "stats.diggCount", "stats.likeCount", "likes"),
    "comments": ("commentCount", "stats.commentCount", "comments"),
    "shares": ("shareCount", "stats.shareCount", "shares"),
    "saves": ("collectCount", "stats.collectCount", "stats.saveCount", "saves"),
}
AUTHOR = {"author_id": "id", "author_name": "name", "author_nickname": "nickName", "followers": "fans", "following": "following", "author_total_likes": "heart", "author_total_videos": "video"}
VIDEO = {"video_duration": "duration", "video_width": "width", "video_height": "height"}
MUSIC = {"music_name": ("musicName", "title", "name"), "music_author": ("musicAuthor", "authorName", "author")}
NUMBERS = {"views", "likes", "comments", "shares", "saves", "followers", "following", "author_total_likes", "author_total_videos"}
COLUMNS = (
    "account", "post_id", "url", "caption", "created_at", "is_pinned", "views", "likes", "comments", "shares", "saves", "hashtags", "author_id", "author_name", "author_nickname",
    "followers", "following", "author_total_likes", "author_total_videos", "video_duration", "video_width", "video_height", "music_name", "music_author", "error", "error_code",
)


def either(raw: Column, a: str, b: str) -> Column:
    """The object at a, or at b where a is falsy; null unless it is an object."""
    v = F.when(truthy(get(raw, a)), get(raw, a)).otherwise(get(raw, b))
    return F.when(is_object(v), v)


def spelt(v: Column) -> Column:
    """A JSON scalar as plain text, its words for nothing, true and false written out as the published files have them."""
    return F.when(kind(v) == "VOID", "None").when(kind(v) == "BOOLEAN", F.initcap(text(v))).otherwise(text(v))


def hashtags(v: Column, names: tuple[str, ...] = ("name", "title", "hashtagName"), scalars: bool = True) -> Column:
    """Strings and named objects of an array as strings; others spelt out where wanted; empty ones dropped."""
    other = spelt if scalars else lambda x: F.lit(None).cast("string")
    one = lambda x: F.when(is_object(x), spelt(first_truthy(x, *names))).when(is_string(x), text(x)).otherwise(other(x))
    return F.filter(F.transform(items(v), one), lambda t: t.isNotNull() & (t != ""))


def verbatim(df: DataFrame, raw: str = "raw") -> dict[str, Column]:
    """COLUMNS but the identities as the payload has them (VARIANT): what is published keeps each value's own type and digits."""
    r = F.col(raw)
    author, video, music = either(r, "authorMeta", "author"), either(r, "videoMeta", "video"), either(r, "musicMeta", "music")
    out = {name: first_value(r, *paths) for name, paths in FIRST_OF.items()}
    out["caption"] = F.coalesce(out["caption"], F.parse_json(F.lit('""')))
    out["is_pinned"] = F.coalesce(out["is_pinned"], F.parse_json(F.lit("false")))
    out |= {name: get(author, key) for name, key in AUTHOR.items()}
    out |= {name: get(video, key) for name, key in VIDEO.items()}
    out |= {name: first_or_last(music, *keys) for name, keys in MUSIC.items()}
    return out | {"error": get(r, "error"), "error_code": get(r, "errorCode")}


def first_or_last(v: Column, *keys: str) -> Column:
    """The first value that counts as true, else the last as it is."""
    return F.coalesce(first_truthy(v, *keys), get(v, keys[-1]))


def published(df: DataFrame, raw: str = "raw") -> Column:
    """The normalised row as JSON with every column, identities from ``account`` and ``post_id``, values verbatim."""
    values = verbatim(df, raw)
    return F.to_json(F.struct(*(values.get(c, F.col(c)).alias(c) for c in COLUMNS)), {"ignoreNullFields": "false"})


def normalize(df: DataFrame, raw: str = "raw", raw_json: str = "raw_json") -> DataFrame:
    """COLUMNS for every row, typed for analysis: one projection. A metric that is no whole number is null, never zero and never rounded.

    What is published has the payload's own values instead: see ``published``.
    """
    r = F.col(raw)
    author, video, music = either(r, "authorMeta", "author"), either(r, "videoMeta", "video"), either(r, "musicMeta", "music")
    whole = lambda v: F.when(kind(v).isin("BIGINT"), F.try_variant_get(v, "$", "long"))
    number = lambda v: F.when(kind(v).rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(v, "$", "double"))
    out = {"account": capture_account(r), "post_id": capture_post_id(r, F.col(raw_json))}
    for name, paths in FIRST_OF.items():
        v = first_value(r, *paths)
        out[name] = whole(v) if name in NUMBERS else F.when(v.isNull(), False).when(kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean")) if name == "is_pinned" else text(v)
    out["caption"] = F.coalesce(out["caption"], F.lit(""))
    out["hashtags"] = hashtags(get(r, "hashtags"))
    for name, key in AUTHOR.items():
        out[name] = whole(get(author, key)) if name in NUMBERS else text(get(author, key))
    for name, key in VIDEO.items():
        out[name] = number(get(video, key)) if name == "video_duration" else whole(get(video, key)).try_cast("int")
    for name, keys in MUSIC.items():
        out[name] = text(first_truthy(music, *keys))
    out["error"], out["error_code"] = text(get(r, "error")), text(get(r, "errorCode"))
    return df.select("*", *(out[c].alias(c) for c in COLUMNS))


def is_error(raw: Column) -> Column:
    return truthy(get(raw, "error")) | truthy(get(raw, "errorCode"))


def split_items(items_df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, errors): error items are kept out of every derived table."""
    items_df = parsed_once(items_df)
    bad = F.coalesce(is_error(F.col("raw")), F.lit(False))
    return items_df.where(~bad), items_df.where(bad)


def capture_counts(items_df: DataFrame, order: list[str]) -> DataFrame:
    """One row: all rows, error rows, rows kept, and posts after deduplication."""
    good, _ = split_items(items_df)
    bad = F.coalesce(is_error(F.col("raw")), F.lit(False))
    n = normalized_posts(good, order).agg(F.count("*").alias("posts"))
    return items_df.agg(F.count("*").alias("total"), F.count_if(bad).alias("errors"), F.count_if(~bad).alias("kept")).crossJoin(n)  # one row each


def normalized_posts(good: DataFrame, order: list[str]) -> DataFrame:
    """One row per post in ingest order (first wins), with its sort position's columns."""
    n = normalize(good).withColumn("__k", F.lower("account"))
    return first_wins(n, ["__k", "post_id"], order).drop("__k")


def sort_normalized(df: DataFrame) -> DataFrame:
    return df.orderBy(F.lower("account"), F.coalesce("created_at", F.lit("")), "post_id")


def profiles(good: DataFrame, order: list[str]) -> DataFrame:
    """(account, captured_at, author): the last author record of each account."""
    rows = good.select(capture_account(F.col("raw")).alias("account"), F.to_json(get(F.col("raw"), "authorMeta")).alias("author"), *order)
    last = last_wins(rows.where("author is not null and author <> 'null'"), ["account"], order)
    return last.select("account", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured_at"), "author")


def content_type(raw: Column) -> Column:
    """slideshow or video: the flag if its key is there (null counts as false), else whether slides are listed."""
    flag = F.when(present(raw, "isSlideshow"), truthy(get(raw, "isSlideshow"))).otherwise(truthy(get(raw, "slideshowImageLinks")))
    return F.when(F.coalesce(flag, F.lit(False)), "slideshow").otherwise("video")


def discovered_slideshow(meta: Column, raw: Column, has_slides: Column) -> Column:
    flag = lambda v: F.when(v.isNotNull() & ~F.is_variant_null(v), truthy(v))
    return F.coalesce(flag(get(meta, "is_slideshow")), flag(get(raw, "isSlideshow")), has_slides)


def compact_metadata(df: DataFrame, fallback: str = "stem") -> DataFrame:
    """One struct column ``meta`` per post: flat fields, author, music, cover and avatar URLs."""
    r = F.col("raw")
    own = lambda p: F.when(truthy(get(r, p)) & is_object(get(r, p)), get(r, p))
    author, video, music = own("authorMeta"), own("videoMeta"), own("musicMeta")
    s = lambda v, k: text(get(v, k))
    number = lambda k: F.try_variant_get(r, f"$.{k}", "long")
    flag = lambda k: F.coalesce(truthy(get(r, k)), F.lit(False))
    fields = {
        "post_id": download_post_id(r, F.col("raw_json")), "account": download_account(r, F.col(fallback)), "url": s(r, "webVideoUrl"), "caption": s(r, "text"), "created_at": s(r, "createTimeISO"),
        "is_slideshow": flag("isSlideshow"), "is_pinned": flag("isPinned"), "is_ad": flag("isAd"), "is_sponsored": flag("isSponsored"),
        "views": number("playCount"), "likes": number("diggCount"), "comments": number("commentCount"), "shares": number("shareCount"), "saves": number("collectCount"), "reposts": number("repostCount"),
        "hashtags": hashtags(get(r, "hashtags"), ("name", "title"), scalars=False), "slide_count": F.size(items(get(r, "slideshowImageLinks"))),
        "author": F.struct(s(author, "id").alias("id"), s(author, "name").alias("name"), s(author, "nickName").alias("nickname"), *(F.try_variant_get(author, f"$.{k}", "long").alias(n) for k, n in (("fans", "followers"), ("following", "following"), ("heart", "total_likes"), ("video", "total_videos")))),
        "music": F.struct(s(music, "musicId").alias("id"), s(music, "musicName").alias("name"), s(music, "musicAuthor").alias("author")),
        "cover_original_url": s(video, "originalCoverUrl"), "cover_url": s(video, "coverUrl"), "avatar_original_url": s(author, "originalAvatarUrl"), "avatar_url": s(author, "avatar"),
    }
    return df.withColumn("meta", F.struct(*(c.alias(n) for n, c in fields.items())))
