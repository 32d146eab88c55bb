"""The discriminant against a direct numpy fit, its folds, held-out separation, odd rows."""

import math
import os
import random
import zlib

import numpy as np
import pytest

from tessella.llm import quality as Q

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


def fold(i):
    return 0 if i is None else zlib.crc32(str(i).encode()) % 5


def corpus(seed=1, n=400):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    rows, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        w = [word() if good or r.random() < 0.5 else word().upper() + r.choice(["!!", "%%", "|"]) for _ in range(r.randint(5, 80))]
        rows.append((i, " ".join(w) + ("." if good else "")))
        if i % 2:
            labels.append((i, int(good)))
    return rows, labels


def direct(rows, labels, threshold=0.3):
    """The same model by numpy's own means and covariances over the training rows."""
    known = dict(labels)
    x = {i: np.array(Q.statistics(t)) for i, t in rows}
    part = [np.array([x[i] for i, y in known.items() if y == k and i in x and fold(i)]) for k in (0, 1)]
    n = [len(p) for p in part]
    cov = [np.cov(p.T, bias=True) for p in part]
    pooled = sum(c * m for c, m in zip(cov, n, strict=True)) / sum(n)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    log = []
    for k in (0, 1):
        c = ((1 - Q.SHRINK_POOLED) * cov[k] + Q.SHRINK_POOLED * pooled) / np.outer(scale, scale)
        c = (1 - Q.SHRINK_IDENTITY) * c + Q.SHRINK_IDENTITY * np.eye(len(c))
        inverse, (_, logdet) = np.linalg.inv(c), np.linalg.slogdet(c)
        d = {i: (v - part[k].mean(axis=0)) / scale for i, v in x.items()}
        log.append({i: -0.5 * (v @ inverse @ v) - 0.5 * logdet for i, v in d.items()})
    out = {}
    for i in x:
        odds = (log[1][i] - log[0][i]) / Q.TEMPERATURE + math.log(n[1] / n[0])
        s = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
        out[i] = (fold(i) == 0, s, int(s >= threshold))
    return out


def run(spark, tmp_path, rows, labels, name="a"):
    folder = f"{tmp_path}/{name}"
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as x", "'c' as score").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return Q.op5_quality(spark, folder).collect()


def test_against_a_direct_fit(spark, tmp_path):
    rows, labels = corpus()
    got = {x.doc_id: (x.held_out, x.score, x.predicted) for x in run(spark, tmp_path, rows, labels)}
    want = direct(rows, labels)
    assert set(got) == set(want)
    for i, (held, score, predicted) in want.items():
        assert got[i][0] == held and got[i][1] == pytest.approx(score, abs=1e-8)
        assert got[i][2] == predicted or abs(score - 0.3) < 1e-6
    held = [i for i, _ in labels if fold(i) == 0]
    y = dict(labels)
    pairs = [(a, b) for a in held if y[a] for b in held if not y[b]]
    assert sum(got[a][1] > got[b][1] for a, b in pairs) >= 0.95 * len(pairs)


def test_held_out_labels_are_never_learnt(spark, tmp_path):
    rows, labels = corpus(2)
    turned = [(i, 1 - y if fold(i) == 0 else y) for i, y in labels]
    a, b = (sorted(tuple(x) for x in run(spark, tmp_path, rows, l, n)) for l, n in ((labels, "a"), (turned, "b")))
    for x, y in zip(a, b, strict=True):
        assert x[:2] == y[:2] and x[2] == pytest.approx(y[2], abs=1e-9)


def test_odd_rows_and_labels(spark, tmp_path):
    rows, labels = corpus(3, 120)
    rows += [(500, None), (501, ""), (502, " \n"), (None, "null id"), (503, "x" * 300_000), (504, "word " * 80_000), (7, rows[7][1]), (505, "漢字 ßä"), (506, "\x00\x01")]
    labels += [(1, None), (3, 5), labels[4], (9999, 1), (None, 0)]
    got = run(spark, tmp_path, rows, labels)
    assert len(got) == len(rows)
    for x in got:
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3)
        assert x.held_out == (fold(x.doc_id) == 0)
    assert len({round(x.score, 9) for x in got if x.doc_id in (500, 501)}) == 1


def test_empty_tables_and_one_class(spark, tmp_path):
    rows, labels = corpus(4, 40)
    assert run(spark, tmp_path, [], labels, "a") == []
    assert {x.score for x in run(spark, tmp_path, rows, [], "b")} == {0.5}
    one = run(spark, tmp_path, rows, [(i, 1) for i, _ in rows], "c")
    assert len({x.score for x in one}) == 1 and one[0].score > 0.9


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
def test_held_out_accuracy_on_the_table(spark):
    y = {x.doc_id: x.quality for x in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    got = [x for x in Q.op5_quality(spark, DATA).collect() if x.held_out and x.doc_id in y]
    good, bad = ([x.score for x in got if y[x.doc_id] == k] for k in (1, 0))
    assert good and bad
    assert sum(a > b for a in good for b in bad) >= 0.98 * len(good) * len(bad)
    assert sum(s >= 0.3 for s in good) >= 0.98 * len(good)


def test_very_long_texts_are_scored_whole(spark):
    rows, labels = corpus()
    good, bad = rows[1][1] + " ", rows[0][1] + " "
    long = [(10_001, good * 20_000), (10_002, (good * 10_000) + ("JUNK!!%% " * 200_000)), (10_003, bad * 20_000)]
    known = spark.createDataFrame([(i, y, 0) for i, y, *_ in labels], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in Q.classify(spark.createDataFrame([*rows, *long], SCHEMA), known).collect()}
    assert len(got) == len(rows) + 3 and all(0 <= got[i] <= 1 for i, _ in long)
    assert got[10_001] > got[10_002]  # what stands after the first megabyte counts
