import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tessella.llm import lm
from tessella.llm.common import materialize, shared_dir


def corpus():
    r = random.Random(2)
    v = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(r.choices(v, [1 / (k + 1) for k in range(40)], k=r.randint(0, 60))).title() + ("\v\tX" if i % 7 == 0 else "")) for i in range(400)]
    return rows + [(900, None), (901, ""), (902, " \n"), (None, "w1 w2"), (3, "w1 again"), (903, "w5 w6 " * 3000)]


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def fold(i):
    return 0 if i is None else zlib.crc32(str(i).encode()) % 10


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_plain_dictionaries(spark, order):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "'x' as range").repartition(3)
    folder = shared_dir(spark)
    counts = materialize(lm.counted_blocks(docs, folder, order, 1500, 8))
    model = lm.fit(counts, folder, order)
    grams = [Counter() for _ in range(order)]
    n_docs = 0
    for i, t in rows:
        if fold(i):
            seq = ["<b>"] * (order - 1) + tokens(t)
            n_docs += 1
            for j in range(order - 1, len(seq)):
                for o in range(order):
                    grams[o][tuple(seq[j - o : j + 1])] += 1
    total, distinct = sum(grams[0].values()), len(grams[0])
    assert (model.tokens, model.distinct) == (total, distinct)
    assert np.allclose(model.weights.sum(axis=1), 1) and (model.weights[:, 0] > 0).all()

    def probability(seq, j):
        p, bucket = [grams[0][(seq[j],)] / total], 0
        for o in range(1, order):
            before = tuple(seq[j - o : j])
            c = n_docs if before[-1] == "<b>" else grams[o - 1][before]
            p.append(grams[o][tuple(seq[j - o : j + 1])] / c if c else 0.0)
            if c:
                bucket = o * lm.LEVELS + min(int(math.log2(c)), lm.LEVELS - 1)
        w = model.weights[bucket]
        return w[0] / (distinct + 1) + sum(a * b for a, b in zip(w[1:], p, strict=True))

    want = []
    for i, t in rows:
        seq = ["<b>"] * (order - 1) + tokens(t)
        own = seq[order - 1 :]
        base = sum(math.log10((grams[0][(x,)] + 0.1) / (total + 0.1 * (distinct + 1))) for x in own)
        full = sum(math.log10(probability(seq, j)) for j in range(order - 1, len(seq)))
        want.append((i, fold(i) == 0, len(own), sum(grams[0][(x,)] > 0 for x in own), total, base, full))
    got = [tuple(r) for r in lm.score(counts, folder, model).collect()]
    key = lambda r: (str(r[0]), r[2])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)
    held = [r for r in got if r[1]]
    if order > 1:  # a proper distribution: over all words and one unknown it sums to 1
        seq = ["<b>"] * (order - 1) + tokens(rows[1][1])
        j = order
        words = [g[0] for g in grams[0]]
        assert sum(probability(seq[:j] + [x], j) for x in [*words, "never seen"]) == pytest.approx(1, abs=1e-9)
    # the mixture learns how far to trust each order, so on held-out texts it is no worse than its best part
    assert sum(r[6] for r in held) >= sum(r[5] for r in held) - 0.02 * abs(sum(r[5] for r in held))


def test_em_finds_known_weights():
    # held-out events: order 1 predicts with 1/4, uniform with 1/1024, half of the mass each
    cells = np.array([2 * 2, 127])  # bins: p = 2^-2 and zero
    w = lm.learn(cells, np.array([700.0, 300.0]), 1, 1023)
    q = w[0, 1]
    assert q == pytest.approx(0.7, abs=0.01)


def test_empty_and_untrained(spark):
    schema = "doc_id long, text string"
    assert lm.train_and_score(spark.createDataFrame([], schema)).count() == 0
    (r,) = lm.train_and_score(spark.createDataFrame([(None, "a b")], schema)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_beats_the_base_on_held_out_texts(spark, tmp_path):
    r = random.Random(8)
    names = [f"w{i}" for i in range(300)]
    follow = {a: r.sample(names, 5) for a in names}  # a language in which the word before tells much
    rows = []
    for i in range(1500):
        w = [r.choice(names)]
        while len(w) < 60:
            w.append(r.choice(follow[w[-1]]))
        rows.append((i, " ".join(w)))
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "0 as held_out").write.parquet(f"{tmp_path}/documents.parquet")
    held = [x for x in lm.op7_interpolation(spark, str(tmp_path)).collect() if x.held_out]
    assert len(held) > 100
    assert sum(x.score for x in held) > 0.9 * sum(x.base_score for x in held)
    assert sum(x.score > x.base_score for x in held) > 0.95 * len(held)


def test_regular_words_are_told_apart(spark):
    def word(n, a, b):
        return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))

    rows = []
    for n in (1024, 2048):
        rows += [(2 * n, f"{word(n, 'a', 'b')} x"), (2 * n + 1, f"{word(n, 'b', 'a')} x")]
    train = [r for r in rows if fold(r[0])]
    got = {x.doc_id: x for x in lm.train_and_score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    known = {w for _, t in train for w in t.split()}
    for i, t in rows:
        assert got[i].n_known == sum(w in known for w in t.split()) + 1
