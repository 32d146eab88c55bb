"""The sink of ordered lines: bytes as by plain writing, commit, abort, killed tasks, damaged parts."""

import csv
import hashlib
import json
import os
import time
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessella.sinks import lines


def ordered(spark, n=1000, parts=7):
    df = spark.range(n).select(F.col("id"), F.concat(F.lit('é, "x"\n'), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 3 > 0, F.col("id") / 4).alias("x"))
    return df.repartitionByRange(parts, "id").sortWithinPartitions("id")


def test_json_lines_are_what_plain_writing_gives(spark, tmp_path):
    df = lines.json_lines(ordered(spark))
    want = "".join(r.value + "\n" for r in df.collect()).encode()
    lines.write_parts(df, f"{tmp_path}/p")
    told = json.loads((tmp_path / "p" / lines.MANIFEST).read_text())
    assert len(told) > 1 and {x[0] for x in told} | {lines.MANIFEST} == set(os.listdir(tmp_path / "p"))
    row = lines.publish(spark, [(f"{tmp_path}/p", f"{tmp_path}/out/posts.jsonl", b"")]).first()
    assert (tmp_path / "out/posts.jsonl").read_bytes() == want
    assert (row.bytes, row.sha256, row.lines) == (len(want), hashlib.sha256(want).hexdigest(), 1000)
    assert os.listdir(tmp_path / "out") == ["posts.jsonl"]


def test_csv_reads_back_and_has_one_header(spark, tmp_path):
    df = ordered(spark).select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("id", "text", "x")))
    lines.write_parts(df, f"{tmp_path}/p", "csv")
    lines.publish(spark, [(f"{tmp_path}/p", f"{tmp_path}/o.csv", lines.csv_header(("id", "text", "x")))])
    with open(tmp_path / "o.csv", encoding="utf-8-sig", newline="") as f:
        got = list(csv.reader(f))
    assert got == [["id", "text", "x"], *([r.id, r.text, r.x] for r in df.collect())]


def test_empty_table_is_an_empty_file_or_a_header(spark, tmp_path):
    df = spark.createDataFrame([], "value string")
    for k, header in enumerate((b"", b"head\r\n")):
        lines.write_parts(df, f"{tmp_path}/p{k}")
        row = lines.publish(spark, [(f"{tmp_path}/p{k}", f"{tmp_path}/{k}", header)]).first()
        assert (tmp_path / str(k)).read_bytes() == header and row.lines == 0


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    bad = ordered(spark, 5000).select(F.when(F.col("id") == 4321, F.raise_error("stop")).otherwise(F.col("text")).alias("value"))
    with pytest.raises(PySparkException):
        lines.write_parts(bad, f"{tmp_path}/p")
    assert left(tmp_path) <= {lines.ABORTED}


def left(folder, seconds=20):
    """The files that remain once the job's other tasks have ended as well."""
    for _ in range(seconds):
        found = {p.name for p in Path(folder).rglob("*") if p.is_file()}
        if found <= {lines.ABORTED}:
            break
        time.sleep(1)
    return found


def test_a_killed_task_leaves_nothing(spark, tmp_path):
    def die(batches):
        for b in batches:
            if 4321 in b.column("id").to_pylist():
                os._exit(9)
            yield b.select(["text"])

    with pytest.raises(Exception, match="(?i)python worker|abort"):
        lines.write_parts(ordered(spark, 5000).mapInArrow(die, "text string"), f"{tmp_path}/p")
    assert left(tmp_path) <= {lines.ABORTED}
    with pytest.raises(Exception, match="has failed"):  # nor is the folder written to later
        lines.write_parts(ordered(spark, 10).select("text"), f"{tmp_path}/p")
    assert left(tmp_path) <= {lines.ABORTED}


def test_files_of_attempts_that_never_answered_are_removed(tmp_path):
    folder = tmp_path / "p"
    folder.mkdir()
    for name in ("part-a", "part-b", "lost"):
        (folder / name).write_bytes(b"x\n")
    w = lines.LinePartsWriter(str(folder), "text")
    w.commit([lines.Written(1, "part-b", 2, "h", 1), None, lines.Written(0, "part-a", 2, "h", 1), lines.Written(2, None, 0, "h", 0)])
    assert sorted(os.listdir(folder)) == [lines.MANIFEST, "part-a", "part-b"]
    assert [x[0] for x in json.loads((folder / lines.MANIFEST).read_text())] == ["part-a", "part-b"]


def test_a_damaged_part_is_refused_and_the_target_stays(spark, tmp_path):
    lines.write_parts(lines.json_lines(ordered(spark)), f"{tmp_path}/p")
    part = next(p for p in (tmp_path / "p").iterdir() if p.name.startswith("part-") and not p.name.endswith(".crc"))
    data = bytearray(part.read_bytes())
    data[5] ^= 1
    part.write_bytes(data)
    (tmp_path / "t").write_text("before")
    with pytest.raises(PySparkException, match="differs"):
        lines.publish(spark, [(f"{tmp_path}/p", f"{tmp_path}/t", b"")])
    assert (tmp_path / "t").read_text() == "before" and sorted(os.listdir(tmp_path)) == ["p", "t"]


def test_files_are_dealt_by_bytes_and_hashed_as_streams(spark, tmp_path):
    from tessella.sources import files

    rows = []
    for i in range(60):
        p = tmp_path / f"f {i}%.bin"
        p.write_bytes(bytes([i]) * (i * 37 % 500))
        rows.append((f"file:{p}", p.stat().st_size))
    big = tmp_path / "big"
    with big.open("wb") as f:
        f.truncate((2 << 30) + 5)  # sparse, and longer than a row may be
    rows.append((str(big), (2 << 30) + 5))
    df = spark.createDataFrame(rows, "path string, length long").repartition(3)
    dealt = files.by_bytes(df.where("length < 1000"), task_bytes=2000)
    loads = [r.s for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("length").alias("s")).collect()]
    assert len(loads) > 4 and max(loads) < 2000 + 500 and dealt.count() == 60
    assert files.by_bytes(df, task_bytes=2000).rdd.getNumPartitions() <= 61  # one large file makes no more tasks than one
    got = {r.path: (r.sha256, r.read) for r in files.digests(df, task_bytes=2000).collect()}
    h = hashlib.sha256()
    for k in range(2049):
        h.update(bytes(1 << 20) if k < 2048 else bytes(5))
    want = {p: (hashlib.sha256(Path(p[5:]).read_bytes()).hexdigest(), n) for p, n in rows[:-1]} | {str(big): (h.hexdigest(), (2 << 30) + 5)}
    assert got == want
