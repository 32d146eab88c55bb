"""Folds over JSON text against plain recursion over the parsed value."""

import json
import random
import re

from pyspark.sql import functions as F

from tessella.functions import media, redaction, walk


def plain_strings(value, key=""):
    if isinstance(value, str):
        return [(key, value)]
    inner = [(k.lower(), v) for k, v in value.items()] if isinstance(value, dict) else [(key, v) for v in value] if isinstance(value, list) else []
    return [x for k, v in inner for x in plain_strings(v, k)]


def plain_urls(value):
    found = []
    for key, url in plain_strings(value):
        low = url.lower()
        named = any(k in key for k in media.VIDEO_KEYS) or any(m in low for m in media.VIDEO_MARKS)
        if named and re.match("https?://", url) and not low.split("?")[0].endswith(media.IMAGE_EXTENSIONS) and "tiktok.com/@" not in low and url not in found:
            found.append(url)
    return found


def plain_page(value):
    pages = [u for _, u in plain_strings(value) if "tiktok.com" in u.lower() and any(x in u.lower() for x in media.POST_PAGES)]
    return pages[-1] if pages else None


def plain_redacted(value):
    if isinstance(value, dict):
        return {k: redaction.MARK if re.search(redaction.SECRET_FIELDS, k) else plain_redacted(v) for k, v in value.items()}
    if isinstance(value, list):
        return [plain_redacted(v) for v in value]
    return re.sub(redaction.CREDENTIAL, lambda m: m[1] + redaction.MARK, value) if isinstance(value, str) else value


WORDS = [
    "", "x", 'a"b', "back\\", '\\"', "\\\\\"", "{[", "]}", ",:", "line\nend\t", "é中\U0001f600", "\x1f", "https://h/v.mp4", "https://h/1", "http://h/x.JPG?video", "https://www.tiktok.com/@x", "https://TikTok.com/video/1",
    "https://www.tiktok.com/@x/photo/2", "Bearer abc", "?token=q&r", "authorization: bearer zz yy", "12", "true",
]
KEYS = ["a", "Video", "playAddr", "my_token", "API_KEY", 'k"', "k\\", "secret{", "é", ":", "plain", "password"]


def value_of(rng, depth):
    kind = rng.random()
    if depth and kind < 0.35:
        return {k: value_of(rng, depth - 1) for k in rng.sample(KEYS, rng.randrange(5))}
    if depth and kind < 0.6:
        return [value_of(rng, depth - 1) for _ in range(rng.randrange(4))]
    return rng.choice(WORDS) if kind < 0.9 else rng.choice([None, True, False, 0, -3, 1.5, 12345678901234567890])


def results(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, j string").select("i", media.direct_video_urls(F.col("j")).alias("urls"), media.find_post_url(F.col("j")).alias("page"), redaction.redact_json(F.col("j")).alias("redacted"))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    return rows.orderBy("i").collect()


def test_random_payloads(spark):
    rng = random.Random(7)
    values = [value_of(rng, 6) for _ in range(400)]
    texts = [json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for v in values]
    for v, row in zip(values, results(spark, texts), strict=True):
        assert row.urls == plain_urls(v) and row.page == plain_page(v)
        assert json.loads(row.redacted) == plain_redacted(v)


def test_written_form(spark):
    texts = ['{"a":[1.50,1e5,{}],"t\\u006fken":{"x":[1,{"y":"]"}]},"b":"\\/"}', '"Bearer x"', "[]", "7", "not json", None, "", '{"a": "x}', '{"secret": 1}', '[{"key_secret": "v", "b": 1}, {"password": []}]']
    got = [r.redacted for r in results(spark, texts)]
    mark = redaction.MARK
    assert got[:4] == ['{"a": [1.50, 1e5, {}], "token": "' + mark + '", "b": "/"}', '"Bearer ' + mark + '"', "[]", "7"]
    assert got[4:8] == [None] * 4
    assert got[8:] == ['{"secret": "' + mark + '"}', '[{"key_secret": "' + mark + '", "b": 1}, {"password": "' + mark + '"}]']


def test_long_and_deep(spark):
    deep = "[" * 400 + '{"video": ' + "[" * 400 + '"https://h/deep"' + "]" * 400 + "}" + "]" * 400
    many = {"items": [{"play": [f"https://h/{i}"], "n": i, "token": [i, ["x"]]} for i in range(walk.CHUNK * 12 + 1)]}
    escapes = {"video": ['\\"' * 50_000, "https://h/end"]}
    rows = results(spark, [deep, json.dumps(many), json.dumps(escapes)])
    assert rows[0].urls == ["https://h/deep"] and rows[1].urls == plain_urls(many) and rows[2].urls == ["https://h/end"]
    assert json.loads(rows[1].redacted) == plain_redacted(many) and json.loads(rows[2].redacted) == escapes


def test_tokens_that_cannot_matter_change_nothing(spark):
    texts = ['{"a":"x","video":"https://e.org/1","b":{"play":{"n":1,"u":"https://e.org/2"},"z":"https://e.org/3"},"download":["q",{"k":"http:\\\\/\\\\/e.org\\\\/4"},"https://e.org/5"],"w":"\\\\u0068ttps://e.org/6.mp4"}', '["https://e.org/7.mp4",{"play":[["https://e.org/8"]]}]']
    df = spark.createDataFrame([(t.replace("\\\\", "\\"),) for t in texts], "j string")
    all_of, some = (df.select(F.array_distinct(walk.strings_under(F.col("j"), media.is_direct_video, *extra)).alias("u")).collect() for extra in ((), (lambda c: c.startswith("http") | c.contains("\\"),)))
    assert all_of == some and [len(r.u) for r in some] == [3, 2]
