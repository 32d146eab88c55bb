"""Media helpers: candidate lists, URL tests, file classification, failure summaries."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import walk
from .variants import get, is_string, text

# The file types, their MIME types, and hosts.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".gif", ".avif")
VIDEO_EXTENSIONS = (".mp4", ".mov", ".m4v", ".webm", ".mkv")
MIME_TYPES = {
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".webp": "image/webp", ".gif": "image/gif", ".avif": "image/avif",
    ".mp4": "video/mp4", ".mov": "video/quicktime", ".m4v": "video/x-m4v", ".webm": "video/webm", ".mkv": "video/x-matroska",
}
PROVIDER_DOMAINS = ("apify.com", "apifyusercontent.com")
PLATFORM_HOSTS = ("tiktok", "tiktokcdn", "byteoversea", "ibyteimg", "muscdn", "akamaized")
VIDEO_KEYS = ("video", "play", "download", "playaddr", "downloadaddr")
VIDEO_MARKS = (".mp4", "video/tos", "v16-webapp", "v19-webapp", "mime_type=video")
PLATFORM_SITE = "tiktok.com"
POST_PAGES = ("/video/", "/photo/", "/v/")
#: Direct video URLs that are tried at most.
DIRECT_LIMIT = 8
CANDIDATES = "array<struct<source:string,url:string>>"


def any_of(*conditions: Column) -> Column:
    return reduce(or_, conditions)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"(?<=.)\.[^.]*$", "")


def media_type(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(*IMAGE_EXTENSIONS), "image").when(ext.isin(*VIDEO_EXTENSIONS), "video")


def mime_type(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in MIME_TYPES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("application/octet-stream"))


def asset_path(path: Column, sha256: Column) -> Column:
    """assets/<images|videos>/<digest><extension>, .jpeg as .jpg."""
    ext = F.when(extension(path) == ".jpeg", ".jpg").otherwise(extension(path))
    return F.concat(F.lit("assets/"), media_type(path), F.lit("s/"), sha256, ext)


def slide_index(path: Column) -> Column:
    """The number of slide_<digits>; null where the stem has another form or the number is below 1."""
    n = F.regexp_extract(stem(path), r"^slide_(\d+)$", 1).try_cast("int")
    return F.when(n >= 1, n)


def candidates(*labelled: tuple[str, Column]) -> Column:
    """(source, url) of non-blank string URLs in order, each URL once."""
    rows = F.array(*(F.struct(F.lit(label).alias("source"), F.trim(url).alias("url")) for label, url in labelled))
    rows = F.filter(rows, lambda x: x["url"].isNotNull() & (x["url"] != ""))
    new = lambda out, x: F.when(F.exists(out, lambda y: y["url"] == x["url"]), out).otherwise(F.concat(out, F.array(x)))
    return F.aggregate(rows, F.array().cast(CANDIDATES), new)


def url_candidates(raw: Column, *labelled: tuple[str, str]) -> Column:
    return candidates(*((label, F.when(is_string(get(raw, p)), text(get(raw, p)))) for label, p in labelled))


def first_success(attempts: Column) -> Column:
    """Of attempts (order, ok, ...) the first that succeeded; later ones are never needed."""
    return F.try_element_at(F.filter(F.array_sort(attempts), lambda a: a["ok"]), F.lit(1))


def is_provider_url(url: Column) -> Column:
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    match = F.lit(False)
    for d in PROVIDER_DOMAINS:
        match = match | (host == d) | host.endswith("." + d)
    return (F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & match


def is_platform_url(url: Column) -> Column:
    host = F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))
    match = F.lit(False)
    for h in PLATFORM_HOSTS:
        match = match | host.contains(h)
    return match


def frame_rate(ratio: Column) -> Column:
    """'a/b' as a number; null for a zero denominator or anything else."""
    parts = F.split(ratio, "/")
    return F.try_divide(parts[0].try_cast("double"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("1")).try_cast("double"))


# The parts of a media probe's answer.
PROBE = "format struct<duration:string,size:string>, streams array<struct<codec_type:string,codec_name:string,width:long,height:long,r_frame_rate:string>>"


def probe(answer: Column) -> Column:
    """A media probe's JSON as duration_seconds, file_size_bytes, video_codec, width, height, fps, has_audio, audio_codec; null if it is no object, or its duration or size is no number.

    Of several streams of a kind the last speaks, of frame rates the last that is a ratio; a ratio over zero is null.
    """

    def columns(x: Column) -> Column:
        j = x["j"]
        streams = F.coalesce(j["streams"], F.array().cast("array<struct<codec_type:string,codec_name:string,width:long,height:long,r_frame_rate:string>>"))
        of = lambda kind: F.filter(streams, lambda s: s["codec_type"] == kind)
        last = lambda y: F.try_element_at(y, F.lit(-1))
        video, audio = last(of("video")), last(of("audio"))
        rate = last(F.filter(of("video"), lambda s: s["r_frame_rate"].rlike(r"^\s*[-+]?[0-9.]+\s*/\s*[-+]?[0-9.]+\s*$")))["r_frame_rate"]
        duration, size = j["format"]["duration"].try_cast("double"), j["format"]["size"].try_cast("long")
        sound = x["sound"] & (j["format"]["duration"].isNull() | duration.isNotNull()) & (j["format"]["size"].isNull() | size.isNotNull())
        return F.when(
            sound,
            F.struct(
                duration.alias("duration_seconds"), size.alias("file_size_bytes"), video["codec_name"].alias("video_codec"), video["width"].alias("width"), video["height"].alias("height"), frame_rate(rate).alias("fps"),
                F.coalesce(F.size(of("audio")) > 0, F.lit(False)).alias("has_audio"), audio["codec_name"].alias("audio_codec"),
            ),
        )

    # parsed once for all columns, which the optimiser would read by a parse each
    return walk.bound(F.struct(F.from_json(answer, PROBE).alias("j"), (F.trim(answer).startswith("{") & F.try_parse_json(answer).isNotNull()).alias("sound")), columns)


def tail(x: Column, n: int) -> Column:
    """The last n elements of an array (all of a shorter one)."""
    return F.slice(x, F.greatest(F.size(x) - (n - 1), F.lit(1)), n)


def failure_summary(attempts: Column) -> Column:
    """Per attempted candidate: source, its HTTP statuses, its last two errors."""
    return F.transform(attempts, lambda a: F.struct(a["source"].alias("source"), F.filter(a["statuses"], lambda s: s.isNotNull()).alias("statuses"), tail(a["errors"], 2).alias("errors")))


def is_direct_video(key: Column, url: Column) -> Column:
    """A URL that names a video by its own words or by the key it stands under; no image, no profile page."""
    low = F.lower(url)
    path = F.substring_index(low, "?", 1)
    named = any_of(*(key.contains(k) for k in VIDEO_KEYS), *(low.contains(m) for m in VIDEO_MARKS))
    return (url.startswith("http://") | url.startswith("https://")) & named & ~any_of(*(path.endswith(e) for e in IMAGE_EXTENSIONS)) & ~low.contains(f"{PLATFORM_SITE}/@")


def direct_video_urls(raw_json: Column) -> Column:
    """Direct video URLs anywhere in a payload, in document order, each once."""
    return F.array_distinct(walk.strings_under(raw_json, is_direct_video, lambda c: c.startswith("http") | c.contains("\\")))


def first_direct_urls(raw_json: Column) -> Column:
    """The direct video URLs that are tried: the first few."""
    return F.slice(direct_video_urls(raw_json), 1, DIRECT_LIMIT)


def find_post_url(raw_json: Column) -> Column:
    """Of the post pages' URLs in a payload the one that stands last."""
    page = lambda u: F.lower(u).contains(PLATFORM_SITE) & any_of(*(F.lower(u).contains(x) for x in POST_PAGES))
    return F.try_element_at(F.filter(walk.values(raw_json, lambda c: F.lower(c).contains(PLATFORM_SITE) | c.contains("\\")), page), F.lit(-1))


def acceptable_image(status: Column, content_type: Column, length: Column) -> Column:
    """A response that may be kept as an image: 200, a body, and an image's, a plain binary's or no content type."""
    kind = F.lower(F.split(F.coalesce(content_type, F.lit("")), ";")[0])
    return (status == 200) & (length > 0) & ((kind == "") | kind.startswith("image/") | (kind == "application/octet-stream"))


def error_tail(c: Column, most: int = 5000) -> Column:
    """The last characters of an error's text."""
    return F.when(F.char_length(c) > most, F.right(c, F.lit(most))).otherwise(c)
