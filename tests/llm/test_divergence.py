"""Divergence of sources against whole vectors in plain Python, on odd tables too; the SQL holds the driver's tables."""

import random
import re

from tessella.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "text string, lang string, source string, part string, value long, n int"


def brute(rows, scale=1_000_000_000, top=200):
    """(text, lang, source) rows to sorted result rows, from vectors with all their zeros."""
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    docs = [(lang or "", source or "", TERM.findall(lower(text))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = {}
        for _, _, ts in mine:
            for t in set(ts):
                seen[t] = seen.get(t, 0) + 1
        keep = sorted(t for t, n in seen.items() if n >= 3)
        count = {s: dict.fromkeys(keep, 0) for _, s, _ in mine}
        for _, s, ts in mine:
            for t in ts:
                if t in count[s]:
                    count[s][t] += 1
        p = lambda c: {t: 1 + scale * (c[t] + 1) // (sum(c.values()) + len(keep)) for t in keep}
        shares = {s: p(c) for s, c in count.items()}
        q = p({t: sum(c[t] for c in count.values()) for t in keep})
        f = lambda a, b: (a - b) ** 2 // b
        for s, mine_p in shares.items():
            pairs = [(-sum(f(mine_p[t], o[t]) for t in keep), h.encode(), h) for h, o in shares.items() if h != s]
            terms = [(-f(mine_p[t], q[t]), t.encode(), t) for t in keep if count[s][t] and mine_p[t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, i) for i, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def run(spark, rows, partitions=3):
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA).repartition(partitions)
    return sorted(tuple(r) for r in divergence.audit(df).select("lang", "source", "part", "item", "value", "rank").collect())


def made(n=150, sources=6, seed=3):
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "ÉTÉ", "été", "naïve", "x", "日本", "ß", "delta", "OMEGA", "zeta1eta"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    return [(" ".join(r.choices(words[: r.randint(3, len(words))], k=r.randint(1, 60))), r.choice(["en", "fr"]), f"s{min(r.randrange(sources * 2), sources)}") for _ in range(n)]


def test_odd_rows(spark):
    rows = made() + [(None, None, None), ("", "en", "only empty"), ("42 -- 7", "de", "no terms"), (None, "de", "null"), ("one two three", "de", "rare"), ("same " * 50, None, ""), ("same", "", "a"), ("same thing", "", "b")]
    rows += [("copy of a text", "en", "s1")] * 30 + [("@[`{\x7f\x80\x85 _ under_score", "en", "é"), ("under\x85score \x80", "en", "é"), ("under_\x85", "fr", "é")] * 2
    assert run(spark, rows) == brute(rows)


def test_small_memory_many_shards_and_blocks(spark, monkeypatch):
    for name, v in {"HELD": 20, "SHARD_BYTES": 3000, "ROWS": 9, "MOST_PAIRS": 7}.items():
        monkeypatch.setattr(divergence, name, v)
    rows = made(80, seed=5)
    assert run(spark, rows) == brute(rows)


def test_more_terms_than_ranks(spark):
    r = random.Random(9)
    words = [chr(97 + i) + chr(97 + j) for i in range(20) for j in range(20)]
    rows = [(" ".join(words), "en", "all") for _ in range(3)] + [(" ".join(r.sample(words, 300)), "en", f"s{i % 3}") for i in range(9)]
    assert run(spark, rows) == brute(rows)


def test_one_group_and_a_very_long_text(spark):
    rows = [("Ünï code " * 200_000, "en", "a"), ("code", "en", "a"), ("code ünï", "en", "a")]
    got = run(spark, rows)
    assert got == brute(rows)


def test_empty_table(spark):
    assert run(spark, [], 1) == []
