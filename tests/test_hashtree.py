"""Hash trees: changes against a plain comparison, what is read, and captures that hash changed files only."""

import hashlib
import json
import os
import random

import pytest

from tessella.operators import hashtree
from tessella.sources import capture, files

SCHEMA = "k string, d string, bucket int"


def build(spark, rows, folder, like=None):
    return hashtree.build(spark.createDataFrame([(k, d, 1) for k, d in rows], SCHEMA), "k", "d", str(folder), like, group_rows=1)


def test_changes_are_those_of_a_plain_comparison(spark, tmp_path):
    r = random.Random(1)
    old = [(f"k{i}", f"d{i}") for i in range(600)] + [(None, "n"), ("twice", "a"), ("twice", "b"), ("none", None), ("", "empty")]
    new = [(k, d + "!" if k == "k7" or r.random() < 0.01 and d else d) for k, d in old if k not in ("k3", "k500")] + [("new", "x"), ("k1", "again")]
    new[new.index(("none", None))] = ("none", "null?")
    a = build(spark, old, tmp_path / "a")
    b = build(spark, new, tmp_path / "b", a)
    gather = lambda rows: {k: sorted(str(d) for q, d in rows if q == k) for k in {k for k, _ in rows}}
    x, y = gather(old), gather(new)
    want = {(k, "removed" if k not in y else "added" if k not in x else "changed") for k in x.keys() | y.keys() if x.get(k) != y.get(k)}
    assert {tuple(c) for c in hashtree.changes(a, b).collect()} == want and a.root != b.root
    shuffled = old[:]
    r.shuffle(shuffled)
    same = build(spark, shuffled, tmp_path / "c", a)
    assert same.root == a.root and hashtree.changes(a, same).count() == 0
    twice = build(spark, [*old[:-2], ("twice", "x")], tmp_path / "d", a)
    assert ("twice", "changed") in {tuple(c) for c in hashtree.changes(a, twice).collect()}


def test_only_differing_buckets_are_read(spark, tmp_path):
    rows = [(f"k{i}", "d") for i in range(3000)]
    a = build(spark, rows, tmp_path / "a")
    b = build(spark, [*rows[:-1], ("k2999", "other")], tmp_path / "b", a)
    assert a.width > 1
    files_read = hashtree.changes(a, b)
    plan = files_read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and [tuple(x) for x in files_read.collect()] == [("k2999", "changed")]
    (bucket,) = [r.bucket for r in hashtree.differing(a.buckets, b.buckets, ["bucket"]).collect()]
    assert hashtree.differing(a.groups, b.groups, ["bucket", "grp"]).select("bucket").distinct().first().bucket == bucket


def test_empty_tables(spark, tmp_path):
    a = build(spark, [], tmp_path / "a")
    b = build(spark, [("x", "y")], tmp_path / "b", a)
    assert hashtree.changes(a, a).count() == 0 and [tuple(r) for r in hashtree.changes(a, b).collect()] == [("x", "added")]


def plain(root):
    out = {p.relative_to(root).as_posix(): hashlib.sha256(p.read_bytes()).hexdigest() for g in ("posts/*.jsonl", "normalized/*.jsonl", "profiles/*.json", "run_info.json", "manifest.json") for p in root.glob(g)}
    return capture.fingerprint(out)


def test_a_second_look_reads_only_changed_files(spark, tmp_path, monkeypatch):
    root, keep = tmp_path / "capture", str(tmp_path / "keep")
    for d in ("posts", "profiles", "normalized", "other"):
        (root / d).mkdir(parents=True)
    for i in range(12):
        (root / "posts" / f"é {i}.jsonl").write_text(json.dumps({"id": i}))
    (root / "posts" / "empty.jsonl").write_text("")
    (root / "profiles" / "a.json").write_text("{}")
    (root / "other" / "x.jsonl").write_text("not part of it")
    (root / "run_info.json").write_text("{}")
    os.makedirs(keep)
    read = []
    monkeypatch.setattr(capture, "digests", lambda f, *a: (read.extend(sorted(r.relative for r in f.select("relative").collect())), files.digests(f, *a))[1])
    assert capture.capture_fingerprint(root, spark, keep) == plain(root) and len(read) == 15
    read.clear()
    assert capture.capture_fingerprint(root, spark, keep) == plain(root) and read == []
    (root / "posts" / "é 3.jsonl").write_text("changed in length")
    (root / "posts" / "new.jsonl").write_text("{}")
    os.remove(root / "posts" / "é 4.jsonl")
    assert capture.capture_fingerprint(root, spark, keep) == plain(root) and read == ["posts/new.jsonl", "posts/é 3.jsonl"]
    (root / "posts" / "link.jsonl").symlink_to(root / "run_info.json")
    with pytest.raises(capture.StateError, match="unsafe"):
        capture.capture_fingerprint(root, spark)
