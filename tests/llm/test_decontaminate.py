import random

from tessella.llm import decontaminate as D


def shingles(w, k):
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(docs, items):
    out = set()
    for d, t in docs:
        w = (t or "").encode().lower().split()
        best = {}
        for i, x in items:
            v = (x or "").encode().lower().split()
            if not v:
                continue
            k = min(5, len(v))
            s = shingles(v, k)
            n = len(s & shingles(w, k))
            if 5 * n >= 4 * len(s) and (i not in best or n * best[i][1] > best[i][0] * len(s)):
                best[i] = (n, len(s))
        out |= {(d, i, *v) for i, v in best.items()}
    return sorted(out, key=str)


def fixture():
    r = random.Random(5)
    v = [f"w{i}" for i in range(200)]
    item = lambda n: [r.choice(v) for _ in range(n)]
    items = [(i, " ".join(item(r.choice((1, 3, 4, 5, 9, 30, 60))))) for i in range(30)] + [(30, None), (31, " "), (3, "another text for three of them")]
    docs = []
    for d in range(60):
        w = item(r.randint(0, 400))
        for i, t in r.sample(items, 2):
            part = (t or "").split()
            for _ in range(r.randint(0, 3)):
                if part and r.random() < 0.3:
                    part[r.randrange(len(part))] = "changed"
            at = r.randint(0, len(w))
            w[at:at] = part
        docs.append((d, " ".join(w).upper() if d % 3 else "\n".join(w)))
    docs += [(100, None), (101, ""), (102, "x " * 50000 + items[7][1]), (None, items[8][1])]
    return docs, items


def test_both_paths_against_brute_force(spark):
    docs, items = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'clash' as item_id")
    i = spark.createDataFrame(items + items[:3], "item_id long, text string").selectExpr("*", "1 as doc_id")
    want = brute(docs, items)
    assert want
    assert sorted((tuple(r) for r in D.contained_items(d, i).collect()), key=str) == want
    assert sorted((tuple(r) for r in D.contained_items(d, i, most_broadcast=0).collect()), key=str) == want


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert D.contained_items(docs, some.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert D.contained_items(some, items).count() == 0


def test_regular_words_are_told_apart(spark):
    word = lambda n, a, b: "".join((a, b)[bin(i).count("1") & 1] for i in range(n))
    docs, items = [], []
    for i, n in enumerate((1024, 2048)):
        docs += [(2 * i, f"x y {word(n, 'a', 'b')} z x y z"), (2 * i + 1, f"x y {word(n, 'b', 'a')} z x y z")]
        items += [(2 * i, f"y {word(n, 'a', 'b')} z x y"), (2 * i + 1, word(n, "b", "a"))]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert {x[:2] for x in want} == {(0, 0), (1, 1), (2, 2), (3, 3)}
    assert sorted((tuple(r) for r in D.contained_items(d, i).collect()), key=str) == want
    assert sorted((tuple(r) for r in D.contained_items(d, i, most_broadcast=0).collect()), key=str) == want


def test_items_anywhere_in_very_long_documents(spark):
    r = random.Random(7)
    words = [f"w{i}" for i in range(5000)]
    item = " ".join(r.choices(words, k=30))
    filler = lambda n: " ".join(r.choices(words, k=n))
    docs = [(1, f"{item} {filler(200_000)}"), (2, f"{filler(200_000)} {item}"), (3, f"{filler(100_000)} {item} {filler(100_000)}"), (4, filler(200_000))]
    items = [(9, item), (8, filler(40))]
    got = D.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(x.doc_id for x in got.collect()) == sorted(d for d, i, *_ in brute(docs, items)) == [1, 2, 3]
