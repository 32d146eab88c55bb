"""Integer product quantisation against plain Python integers, on odd tables too."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest

from tessella.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v int"


def brute(rows, parts=codes.PARTS, entries=codes.ENTRIES, rounds=codes.ROUNDS):
    """(vec_id, embedding, label) rows, in Python's unbounded integers, to sorted result rows."""
    rows = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not rows:
        return []
    dim = len(rows[0][1])
    rows = [r for r in rows if len(r[1]) == dim]
    limit, width = codes.bound(dim), -(-dim // parts)
    whole = [[max(-limit, min(limit, math.floor(256 * x))) for x in v] + [0] * (width * parts - dim) for _, v, _ in rows]
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for v in whole]
    books = [[x[p] for x in cut[:entries]] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min((square(x, e), i) for i, e in enumerate(book)) for x, book in zip(v, books, strict=True)] for v in cut]
    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            groups = {}
            for v, f in zip(cut, found, strict=True):
                groups.setdefault(f[p][1], []).append(v[p])
            for i, g in groups.items():
                books[p][i] = tuple(sum(x) // len(g) for x in zip(*g, strict=True))
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    labels = {}
    for (_, _, label), e in zip(rows, errors, strict=True):
        labels[label] = labels.get(label, 0) + e
    h = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{c:02x}" for _, c in f), e, labels[lb], h) for (i, _, lb), f, e in zip(rows, found, errors, strict=True)), key=str)


def run(spark, tmp_path, rows, partitions=3):
    df = spark.createDataFrame([(i, v, lb, "clash", 7) for i, v, lb in rows], SCHEMA)
    df.repartition(partitions).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = codes.op12_codes(spark, str(tmp_path)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    return sorted((tuple(r) for r in out), key=str)


def f32(x):
    return [float(y) for y in np.array(x, np.float32)]


def test_odd_rows(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, f32([r.gauss(0, 1) for _ in range(32)]), r.choice([None, 1, 2])) for i in range(200)]
    rows += [(300, None, 1), (301, [], 1), (302, [None] * 32, 1), (303, [float("nan")] + [0.0] * 31, 2), (304, [float("inf")] * 32, 2), (305, [1.0] * 5, 2)]
    rows += [(None, f32([r.gauss(0, 1) for _ in range(32)]), None), (7, f32([0.5] * 32), 9), (7, f32([0.5] * 32), 9), (306, f32([-1e-30] * 32), 1), (307, [0.0] * 32, 1)]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_fewer_rows_than_entries_and_a_length_that_parts_do_not_divide(spark, tmp_path):
    r = random.Random(5)
    rows = [(-i, f32([r.uniform(-2, 2) for _ in range(21)]), i % 3) for i in range(30)]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_values_at_the_bound_of_64_bits(spark, tmp_path):
    big = 3e38
    rows = [(i, f32([s * big if (i >> k) & 1 else -s * big for k in range(16)]), None) for i, s in itertools.product(range(80), (1,))]
    rows += [(100, [float(x) for x in range(16)], 1)]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_ties_go_to_the_lower_entry_and_unused_entries_stay():
    book = np.array([[4], [0], [4], [9]], np.int64)
    code, error = codes.nearest(np.array([[2], [4], [100]], np.int64), book)
    assert code.tolist() == [0, 0, 3] and error.tolist() == [4, 0, 91**2]


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, [], 1) == []


def test_one_label_for_all_and_many_labels(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(codes, "MOST_LABELS", 0)
    r = random.Random(6)
    rows = [(i, f32([r.gauss(0, 1) for _ in range(16)]), None if i % 3 else i) for i in range(120)]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_decoded_vectors_are_near(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(64, 16)).astype(np.float32)
    rows = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(64)], "vec_id long, v array<float>")
    books = codes.fit(rows, 16)
    back = {x.vec_id: x.embedding for x in codes.decode(codes.encode(rows, books, 16), books, 16).collect()}
    assert all(np.abs(np.array(back[i]) - v[i]).max() <= 1 / 512 + 1e-6 for i in range(64))  # every vector is its own entry


@pytest.mark.parametrize("dim", [1, 16, 64, 1536, 10**6])
def test_bound_is_the_largest(dim):
    assert dim * (2 * codes.bound(dim)) ** 2 < 2**63 <= dim * (2 * codes.bound(dim) + 4) ** 2
