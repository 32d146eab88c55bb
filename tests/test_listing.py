"""Listings are made by tasks, and ranges are dealt to many of them."""

import os

from tessella.sources import ranges, text


def test_listed_by_tasks(spark, tmp_path):
    for name, data in {"a.txt": b"1", "d/b.txt": b"22", "d/e/c.txt": b"", "d/e/.hidden": b"3", "_x/y": b"4", "f g/ü%20.txt": b"555", "d/_empty": b""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    for root in (str(tmp_path), f"file://{tmp_path}", os.path.relpath(tmp_path)):
        df = text.listed(spark, root)
        assert {r.path: r.length for r in df.collect()} == {f"file:{tmp_path}/{n}": k for n, k in {"a.txt": 1, "d/b.txt": 2, "d/e/c.txt": 0, "f g/ü%20.txt": 3, "d/_empty": 0}.items()}
        assert "binaryFile" not in df._jdf.queryExecution().toString()


def test_small_ranges_fill_many_tasks(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("".join(f"{i}\n" for i in range(20000)))
    got = ranges.numbered_lines(spark, str(tmp_path / "x.jsonl"), 1 << 10)
    assert got.rdd.getNumPartitions() == 16  # four a core, where adaptive execution made one of them all
    assert [r.value for r in got.orderBy("line").collect()] == [str(i) for i in range(20000)]
