import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessella.llm import suffixes as S


def brute(rows, length):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, *_), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.diff(np.concatenate(([False], gone)).astype(int))
        out.append((d, len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=False) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    passage = [" ".join(word() for _ in range(n)) for n in (40, 60, 150, 400)]
    rows = []
    for d in range(80):
        parts = [" ".join(word() for _ in range(r.randint(0, 80)))]
        for _ in range(r.randint(0, 2)):
            p = r.choice(passage)
            a = r.randint(0, len(p) // 3)
            parts += [p[a : a + r.randint(50, 900)], " ".join(word() for _ in range(r.randint(0, 60)))]
        rows.append((d, "".join(parts)))
    rows += [(100 + i, rows[i][1]) for i in range(6)]
    for i in range(15):  # near copies
        w = passage[3].split(" ")
        w[r.randrange(len(w))] = "edit"
        rows.append((200 + i, " ".join(w)))
    rows += [(300, "ab" * 700), (301, "x" * 199), (302, "x" * 200), (303, "y" * 201), (304, None), (305, ""), (None, passage[2]), (306, "é" * 150), (2, "again")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,block,hot", [(0, 6000, 4000), (1, 1 << 20, 4000), (2, 6000, 2)])
def test_against_brute_force(spark, monkeypatch, seed, block, hot):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "'x' as range").repartition(3)
    monkeypatch.setattr(S, "HOT", hot)
    got = sorted((tuple(x) for x in S.repeat_digests(df, block=block).collect()), key=str)
    assert got == brute(rows, 200)


def test_spans_and_other_lengths(spark):
    rows = [(1, "0123456789abcdefghijKLMNOP"), (2, "..abcdefghijKLMN--"), (3, "no repeats here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: ([(s.start, s.end) for s in x.spans], bytes(x.kept)) for x in S.repeated_spans(df, length=8, core=5, symbol=4).collect()}
    assert got == {1: ([(10, 24)], b"0123456789OP"), 2: ([(2, 16)], b"..--"), 3: ([], b"no repeats here")}


def test_merge_orders_suffixes_of_all_shards():
    r = random.Random(4)
    base = bytes(r.choice(b"ab") for _ in range(300))
    shards = [[base[i : i + r.randint(200, 260)] for i in r.sample(range(40), 5)] for _ in range(4)]
    every = [t for s in shards for t in s]
    count = Counter(t[i : i + 200] for t in every for i in range(len(t) - 199))
    for texts, found in zip(shards, S.repeated_windows(shards, 200, 50), strict=True):
        for t, hit in zip(texts, found, strict=True):
            assert hit.tolist() == [count[t[i : i + 200]] > 1 for i in range(len(t) - 199)]


def test_common_prefixes_of_merged_shards():
    r = random.Random(5)
    shards = [[bytes(r.choice(b"ab") for _ in range(r.randint(1, 40))) for _ in range(r.randint(1, 4))] for _ in range(3)]
    built, names = [], []
    for texts in shards:
        lengths = np.array([len(t) + 1 for t in texts])
        starts = np.cumsum(lengths) - lengths
        symbols = np.concatenate([np.frombuffer(t + b"\0", np.uint8).astype(np.int64) for t in texts])
        order, before = S.transform(symbols, starts, lengths, 1, 6)
        built.append((order, before.astype(np.int32)))
        suffixes = [t[i:] + b"\0" for t in texts for i in range(len(t) + 1)]
        names.append([suffixes[i][:6] for i in order])
    source, shared = S.merge(built, 6)
    rest = [iter(n) for n in names]
    merged = [next(rest[s]) for s in source]
    assert merged == sorted(merged)
    common = lambda a, b: 6 if a == b else next(i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y)
    count, size = Counter(merged), S.interval_sizes(shared, 6).tolist()
    for i, (a, b) in enumerate(zip(merged, merged[1:], strict=False), 1):
        assert shared[i] == common(a, b) or (a == b and a.endswith(b"\0"))  # a text goes on with its own beginning after its mark
    assert all(n == count[m] for m, n in zip(merged, size, strict=True) if not m.endswith(b"\0")) and max(size) > 1
    assert len(S.interval_sizes(np.empty(0, np.uint8), 6)) == 0


def test_empty(spark):
    assert S.repeat_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
