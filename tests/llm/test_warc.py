import base64
import hashlib

from tessella.llm import warc
from tessella.llm.common import shared_dir


def test_write_index_read(spark):
    same = "<p>é\r\n\r\nWARC/1.1</p>"
    rows = [(5, "http://a/\r\nX: y%41", same), (3, None, same), (9, "u", None), (10, "u", ""), (2, "z", "own"), (3, "again", same), (None, "n", "x" * 100_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, file string")
    folder = shared_dir(spark)
    index = warc.write(df, folder)
    got = sorted(((r.page_id, r.url, bytes(r.payload) if r.payload is not None else None, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(index, folder).collect()), key=str)
    first = {}
    for i, _, h in rows:
        first.setdefault(h or "", []).append(i)
    want = []
    for i, u, h in rows:
        data = (h or "").encode()
        least = min(first[h or ""], key=lambda x: -1 if x is None else x)
        revisit = i != least
        want.append((i, u, None if revisit else data, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", least if revisit else None))
    assert got == sorted(want, key=str)
    part = warc.read(index.where("page_id = 2"), folder).collect()
    assert [bytes(r.payload) for r in part] == [b"own"]


def test_empty_and_threshold(spark):
    schema = "page_id long, url string, html string"
    folder = shared_dir(spark)
    assert warc.read(warc.write(spark.createDataFrame([], schema), folder), folder).count() == 0
    folder = shared_dir(spark)
    index = warc.write(spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy")], schema), folder, least=3)
    assert {r.record_type for r in warc.read(index, folder).collect()} == {"response"}


def test_coalesce():
    got = list(warc.coalesce_ranges([("a", 0, 10), ("a", 10, 5), ("a", 100, 5), ("b", 105, 1)], gap=20, most=50))
    assert got == [("a", 0, 15, [(0, 10), (10, 5)]), ("a", 100, 105, [(100, 5)]), ("b", 105, 106, [(105, 1)])]


def test_very_long_payloads(spark):
    long = "<p>é " * 1_500_000
    rows = [(1, "u", long), (2, "v", long), (3, "w", long[:-1])]
    folder = shared_dir(spark)
    index = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to, hashlib.sha1(r.payload).digest() if r.payload is not None else None) for r in warc.read(index, folder).collect()}
    own = lambda t: (len(t.encode()), "response", None, hashlib.sha1(t.encode()).digest())
    assert got == {1: own(long), 2: (len(long.encode()), "revisit", 1, None), 3: own(long[:-1])}
