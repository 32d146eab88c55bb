import random

from pyspark.sql import types as T

from tessella.llm import graph, jaccard

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("key", T.StringType()), T.StructField("n", T.LongType())])


def shingles(text, k=3):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows):
    sets = [(d, shingles(t)) for d, t, *_ in rows if d is not None]
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 90 * len(x | y):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return sorted((d, len(shingles(t)), root(d) if d is not None else None) for d, t, *_ in rows if d is not None)


def corpus(seed=0):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    common = [r.choice(vocabulary) for _ in range(60)]
    rows, n = [], 0

    def add(words):
        nonlocal n
        n += r.randint(1, 3)
        rows.append((n, " ".join(words), "clash", 1))

    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.randint(1, 250))]
        for _ in range(r.randint(1, 4)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            add(w)
    base = [r.choice(vocabulary) for _ in range(148)]
    for _ in range(90):  # a large group of near copies
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        add(w)
    for _ in range(30):  # a passage that many share
        add(common + [r.choice(vocabulary) for _ in range(r.randint(1, 20))])
    for _ in range(20):
        add(base)
    rows += [(n + 1, None, None, None), (n + 2, "", None, None), (n + 3, " \t\n", None, None), (n + 4, "One", None, None), (n + 5, "one", None, None), (n + 6, "a b", None, None), (n + 6, "a b", None, None)]
    rows += [(n + 7, "word " * 30000, None, None)]
    r.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    for seed in (0, 1):
        rows = corpus(seed)
        got = sorted(tuple(r) for r in jaccard.jaccard_classes(spark.createDataFrame(rows, SCHEMA)).collect())
        assert got == brute(rows)


def test_combinations_of_frequent_tokens(spark, monkeypatch):
    # many shingles count as frequent: the pairs of tokens carry the search
    monkeypatch.setattr(jaccard, "FREQUENT", 1)
    rows = corpus(3)
    got = sorted(tuple(r) for r in jaccard.jaccard_classes(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute(rows)


def test_empty_and_null_ids(spark):
    assert jaccard.jaccard_classes(spark.createDataFrame([], SCHEMA)).count() == 0
    got = jaccard.jaccard_classes(spark.createDataFrame([(None, "a b c d", "", 1), (None, "a b c d", "", 1)], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(None, 2, None)] * 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (7, 7), (None, 3), (200, 150), (150, 200)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100, 102: 100, 150: 150, 200: 150}


def test_each_text_of_a_repeated_id_links(spark):
    r = random.Random(5)
    words = lambda n: [f"v{r.randrange(500)}" for _ in range(n)]
    rows, want = [], {}
    for i in range(40):  # four texts of one id, each with a near copy of another id
        for j in range(4):
            text = words(80)
            rows += [(1000 + i, " ".join(text), None, None), (2000 + 4 * i + j, " ".join([*text, "end"]), None, None)]
            want |= {1000 + i: 1000 + i, 2000 + 4 * i + j: 1000 + i}
    r.shuffle(rows)
    found = jaccard.jaccard_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows) and {x.doc_id: x.component_id for x in found} == want


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


def test_regular_words_do_not_link(spark):
    rows = []
    for i, n in enumerate((1024, 2048, 4096)):
        rows += [(10 * i, thue_morse(n, "a", "b"), "", 1), (10 * i + 1, thue_morse(n, "b", "a"), "", 1), (10 * i + 2, f"x {thue_morse(n, 'a', 'b')} y z", "", 1), (10 * i + 3, f"x {thue_morse(n, 'b', 'a')} y z", "", 1)]
    got = sorted(tuple(r) for r in jaccard.jaccard_classes(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute(rows)


def test_large_group_of_near_copies_in_several_components(spark):
    r = random.Random(9)
    vocabulary = [f"g{i}" for i in range(400)]
    base = [r.choice(vocabulary) for _ in range(150)]
    rows = []
    for i in range(500):  # from copies that link with nearly all to some that link with none
        w = list(base)
        for _ in range(r.choice((0, 1, 2, 3, 4, 6, 9, 12))):
            w[r.randrange(len(w))] = f"u{r.randrange(10**6)}"
        rows.append((i, " ".join(w), None, None))
    want = brute(rows)
    assert len({x[2] for x in want}) > 5
    got = sorted(tuple(x) for x in jaccard.jaccard_classes(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == want


def test_candidates_are_linear_in_a_growing_group(spark, monkeypatch):
    made = []
    keep = jaccard.pairs_of
    monkeypatch.setattr(jaccard, "pairs_of", lambda *a: made.append(keep(*a)) or made[-1])

    def run(n):
        r = random.Random(10)
        base, rows = [f"g{r.randrange(300)}" for _ in range(120)], []
        for i in range(n):
            w = list(base)
            for _ in range(r.choice((0, 1, 2, 4, 8, 12))):
                w[r.randrange(len(w))] = f"u{r.randrange(10**6)}"
            rows.append((i, " ".join(w), None, None))
        made.clear()
        jaccard.jaccard_classes(spark.createDataFrame(rows, SCHEMA)).count()
        return sum(x.count() for x in made)

    small, large = run(100), run(400)
    assert large <= 8 * small  # sixteen times as many, were all pairs tried
