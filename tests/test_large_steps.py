"""Plans whose work must not pile up as tables grow."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import media as U
from tessella.operators import inventory
from tessella.operators.dedup import ConflictError
from tessella.plans import media
from tessella.session import spread


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_unmatched_keys_are_one_grouping(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long")
    right = spark.createDataFrame([(2,), (3,), (3,), (None,)], "k long")
    df = inventory.unmatched(left, right, "k")
    assert {tuple(r) for r in df.collect()} == {(1, "left", 2), (3, "right", 2), (None, "left", 1), (None, "right", 1)}
    assert "Join" not in plan(df)


def test_a_probe_is_parsed_once(spark):
    answer = '{"format":{"duration":"2.5","size":"7"},"streams":[{"codec_type":"video","codec_name":"h","width":3,"r_frame_rate":"30/1"},{"codec_type":"audio","codec_name":"a"}]}'
    df = spark.createDataFrame([(answer,), ("[]",), (None,)], "a string").repartition(1).select(U.probe(F.col("a")).alias("p"))
    p = df.select("p.duration_seconds", "p.file_size_bytes", "p.fps", "p.audio_codec")
    assert [tuple(r) for r in p.collect()] == [(2.5, 7, 30.0, "a"), (None,) * 4, (None,) * 4]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_few_rows_are_spread_over_several_tasks_a_core(spark):
    assert spread(spark.range(100, numPartitions=4)).rdd.getNumPartitions() == 16
    assert spread(spark.range(100, numPartitions=20)).rdd.getNumPartitions() == 20


def test_posts_are_planned_in_one_shuffle_and_compared_by_payload(spark):
    rows = [(j, "f", "x", i) for i, j in enumerate(['{"id":1,"input":"A","n":[1]}', '{"n":[1],"input":"A","id":1}', '{"id":2,"input":"a"}'])]
    posts = spark.createDataFrame(rows, "raw_json string, stem string, source_file string, record long").withColumn("raw", F.try_parse_json("raw_json"))
    got = media.plan_posts(posts)
    assert {(r.post_id, r.record) for r in got.collect()} == {("1", 1), ("2", 2)} and "raw_json" not in got.columns
    other = posts.withColumn("raw_json", F.when(F.col("record") == 1, '{"id":1,"input":"a","n":[2]}').otherwise(F.col("raw_json"))).withColumn("raw", F.try_parse_json("raw_json"))
    with pytest.raises(ConflictError, match="a/1"):
        media.plan_posts(other)
