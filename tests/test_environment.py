
import json

import pytest

from tessella.functions import media, redaction
from tessella.plans import state


def test_options():
    state.check_options({"batch_size": 4, "retries": 0, "timeout": 35.0, "max_charge_usd": None})
    for bad in ({"batch_size": 0}, {"concurrency": True}, {"retries": -1}, {"timeout": 0}, {"timeout": float("inf")}, {"max_charge_usd": float("nan")}, {"max_posts": 1.5}):
        with pytest.raises(ValueError):
            state.check_options(bad)
    with pytest.raises(state.StateError, match="accounts"):
        state.require_keys({"out": 1}, {"out", "accounts"})


def test_payload_walks(spark):
    payload = {"a": [{"playAddr": "https://h/1"}, "https://www.tiktok.com/@x/video/1"], "cover": "https://h/v.mp4", "video": {"img": "https://h/x.jpg", "b": ["https://h/1", "https://www.tiktok.com/@x"]}, "z": {"u": "https://www.tiktok.com/v/2"}}
    texts = [json.dumps(x) for x in (payload, [payload, {"q": "https://tiktok.com/photo/9"}], [{"a": 1}, []])]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, j string").select("i", media.direct_video_urls("j").alias("urls"), media.find_post_url("j").alias("page")).orderBy("i").collect()
    assert rows[0].urls == ["https://h/1", "https://h/v.mp4"]
    assert [r.page for r in rows] == ["https://www.tiktok.com/v/2", "https://tiktok.com/photo/9", None]


def test_secret_values(spark):
    env = {"MY_TOKEN": "abcd", "KEY": "abc", "HOME": "/x", "db_password": "hunter22"}
    assert redaction.secret_values(env) == ("abcd", "hunter22")
    from pyspark.sql import functions as F

    assert spark.range(1).select(redaction.redact(F.lit("x abcd hunter22 Bearer zzz"), redaction.secret_values(env)).alias("r")).first().r == "x [REDACTED] [REDACTED] Bearer [REDACTED]"


def test_probe_answers(spark):
    from pyspark.sql import functions as F

    rows = [
        '{"format": {"duration": "1.5", "size": "20"}, "streams": [{"codec_type": "video", "codec_name": "a", "r_frame_rate": "30/1"}, {"codec_type": "audio", "codec_name": "x"}, {"codec_type": "video", "codec_name": "b", "width": 4, "height": 3, "r_frame_rate": "25"}, {"codec_type": "audio"}]}',
        "{}", '{"streams": null, "format": null}', '{"format": {"duration": "x"}}', "[1]", "not json", None, '{"streams": [{"codec_type": "video", "r_frame_rate": "1/0"}]}',
    ]
    got = [r.p for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, j string").orderBy("i").select(media.probe(F.col("j")).alias("p")).collect()]
    assert tuple(got[0]) == (1.5, 20, "b", 4, 3, 30.0, True, None)
    assert tuple(got[1]) == tuple(got[2]) == (None,) * 6 + (False, None)
    assert got[3:7] == [None] * 4 and got[7].fps is None and got[7].has_audio is False
