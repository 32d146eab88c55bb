import functools
import hashlib
import math
import os
import random
import re
import time

import pytest

from tessella.llm import secrets

MODEL = secrets.GuessCost()


def guesses(text):
    return [text[a:b] for a, k, b in secrets.scan(text, MODEL) if secrets.KINDS[k] == "guess"]


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("DB_PASSWORD=P@x9!vQz7#Lm", "P@x9!vQz7#Lm"),
        ("db_pwd: x9vQz7LmTr4", "x9vQz7LmTr4"),
        ('user_pass = "x9vQz7LmTr4"', "x9vQz7LmTr4"),
        ('MyPassword = "P@x9!vQz7#Lm"', "P@x9!vQz7#Lm"),
        ('client_secret: "P@x9!vQz7#Lm"', "P@x9!vQz7#Lm"),
        ("auth_token: P@x9!vQz7#Lm", "P@x9!vQz7#Lm"),
        ('secret_key = "x9vQz7LmTr4!!aa"', "x9vQz7LmTr4!!aa"),
        ('access_token="$x9vQz7LmTr4"', "$x9vQz7LmTr4"),
        ("the --db-password-file -> x9vQz7LmTr4", "x9vQz7LmTr4"),
        ("my_password is x9vQz7LmTr4", "x9vQz7LmTr4"),
        ('password: "correct horse battery staple"', "correct horse battery staple"),
        ("passphrase = 'correct horse battery staple' # mine", "correct horse battery staple"),
        ("passenger_secret: pwd is x9vQz7LmTr4", "x9vQz7LmTr4"),
    ],
)
def test_keywords_inside_identifiers_and_quoted_blanks(text, value):
    assert value in guesses(text)


def test_ordinary_words_are_no_context():
    for text in ("author: Wilhelmina", "the passengers: Wilhelmina", "a compass is malfunctioning", "the author is unaccompanied", 'password: "not closed\nWilhelmina"'):
        assert guesses(text) == []


def test_base_spans_stay():
    text = 'password: "correct horse battery staple"'
    assert (0, 0, text.index(" horse")) in secrets.scan(text, MODEL)


def test_contexts_in_linear_time():
    start = time.monotonic()
    for unit in ("pass", "pass=", "pass-", "pass ", 'pass="', "pass: ", "auth is pwd ", "author"):
        list(secrets.contexts(unit * 100_000))
    assert time.monotonic() - start < 20


DATA = "/root/testdata/sf0.001"


def plain_base(text):
    """The three base kinds by the contract's patterns, nothing shared with the operator."""
    text = text or ""
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    out = [(m.start(), 0, m.end()) for m in re.finditer(f"({word})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def check_rows(rows, got):
    kinds = ("assign", "access", "hex")
    want = []
    for i, t in rows:
        spans = plain_base(t)
        shown = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)
        want.append((i, *(sum(x[1] == k for x in spans) for k in range(3)), hashlib.sha256(shown.encode()).hexdigest()))
    key = lambda x: str(x)
    assert sorted(((x.doc_id, x.n_assign, x.n_access, x.n_hex, x.base_sha256) for x in got), key=key) == sorted(want, key=key)
    for x in got:  # base spans stay among all spans, which are in order
        spans = [s.split(":") for s in x.spans.split(",") if s]
        base = ",".join(":".join(s) for s in spans if s[0] != "guess")
        assert hashlib.sha256(base.encode()).hexdigest() == x.base_sha256
        order = [(int(a), secrets.KINDS.index(k)) for k, a, _ in spans]
        assert order == sorted(order)


def odd_rows():
    r = random.Random(2)
    bits = ["password", "PassWd", "secret", "TOKEN", "api_key", "apikey", '"', "'", " ", ":", "=", "abc123", "AKIA" + "Z9" * 8, "AKIAZZ", "0123456789abcdef" * 2, "deadbeef", "é", "\n", "x" * 7, "ſecret: abcdefgh", "toKen=abcdefg", "-._/+="]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(1, 40)))) for i in range(400)]
    return [*rows, (1000, None), (1001, ""), (1002, "a" * 50_000 + " token: " + "b" * 70_000), (None, "secret=abcdef"), (1003, "tie password=abcdef"), (1003, "tie password=abcdef")]


def test_base_spans_like_a_plain_scan(spark, tmp_path):
    rows = odd_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as found", "'x' as kind")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    check_rows(rows, secrets.op9_secrets(spark, str(tmp_path)).collect())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
def test_whole_table_like_a_plain_scan(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    check_rows([tuple(d) for d in docs], secrets.op9_secrets(spark, DATA).collect())


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.find_secrets(df).count() == 0 and secrets.redact(df).count() == 0


def every_segmentation(model, value):
    """The least cost over all ways to cut a short value, by the costs of single segments."""
    low, plain = value.lower(), value.lower().translate(secrets.LEET)
    runs = model._runs(value, low)
    dates = {(m.start(), m.end()) for m in secrets.DATE.finditer(value)}

    def single(i, j):
        out = [sum(map(secrets._size, value[i:j]))]
        if j - i >= 2 and j - i <= model.longest:
            if (rank := model.rank.get(low[i:j])) is not None:
                up = sum(c.isupper() for c in value[i:j])
                out.append(math.log10(rank + 1) + (up > 0) * (math.log10(2) if up in (1, j - i) else math.log10(math.comb(j - i, up))))
            elif plain[i:j] != low[i:j] and (rank := model.rank.get(plain[i:j])) is not None:
                out.append(math.log10(rank + 1) + sum(a != b for a, b in zip(low[i:j], plain[i:j], strict=True)) * math.log10(2))
        if (i, j) in dates:
            out.append(math.log10(365 * 120 if j - i > 4 else 120))
        return min([*out, *(c for _, e, c in runs.get(i, ()) if e == j)])

    @functools.cache
    def best(i):
        return 0.0 if i == len(value) else min(single(i, j) + math.log10(2) + best(j) for j in range(i + 1, len(value) + 1))

    return best(0)


def test_cheapest_segmentation_against_all():
    r = random.Random(4)
    parts = ["password", "P@ssw0rd", "dragon", "1987", "2019-04-05", "qwerty", "asdf", "aaaa", "abcabcabc", "12345", "x", "Z", "!", "kQ7", "é", "SUMMER"]
    for _ in range(150):
        value = "".join(r.choice(parts) for _ in range(r.randint(1, 4)))[:18]
        cost, segments = MODEL.segments(value)
        assert cost == pytest.approx(every_segmentation(MODEL, value), abs=1e-9), value
        assert [s[1] for s in segments] == [0, *(s[2] for s in segments[:-1])] and segments[-1][2] == len(value)


def test_repeats_of_any_period():
    unit = "kQ7x9vZ2mTr4LpWs8"
    one, many = MODEL.segments(unit)[0], MODEL.segments(unit * 6)[0]
    assert many < one + 2
    assert any(k == "repeat" for k, _, _ in MODEL.segments(unit * 6)[1])


def test_words_of_the_corpus_are_cheap(spark):
    docs = [(i, "the transaction is incorrect and was malfunctioning again") for i in range(50)] + [(99, "password is incorrect"), (98, None), (97, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert secrets.corpus_words(df, most=3) == ["incorrect", "again", "and"]
    assert {x.doc_id for x in secrets.find_secrets(df).collect() if x.found} == set()
    assert {x.doc_id for x in secrets.find_secrets(df, words=secrets.WORDS).collect() if x.found} == {99}


def test_time_is_linear_in_the_length_of_a_value():
    """A value that repeats its own first half after a gap, doubled five times."""
    r, model = random.Random(8), secrets.GuessCost()
    noise = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=n))
    took = []
    for n in (8_000, 16_000, 32_000, 64_000, 128_000):
        w = noise(n)
        value = w + noise(n + 50) + w
        t = time.process_time()
        model._runs(value, value.lower())
        took.append(time.process_time() - t)
    assert took[-1] < 16 * 2 * max(took[0], 0.02)


def test_repeats_are_found_as_by_trying_every_distance():
    """The runs of long periods, with their memory of distances, against a search without it."""
    r, model = random.Random(9), secrets.GuessCost()
    for _ in range(300):
        parts = ["".join(r.choices("abcd", k=r.randint(3, 14))) for _ in range(3)]
        value = "".join(r.choices(parts, k=r.randint(2, 9)))
        got = {(i, e) for i, found in model._runs(value, value).items() for k, e, _ in found if k == "repeat"}
        want, n = set(), len(value)
        for size in (4, 12):
            seen, i = {}, 0
            while i + size <= n:
                p, seen[value[i : i + size]] = seen.get(value[i : i + size]), i
                if p is not None and i - p > model.unit:
                    d = i - p
                    j = next((j for j in range(i + size, n) if value[j] != value[j - d]), n)
                    if j - p >= 2 * d:
                        want.add((p, p + (j - p) // d * d))
                        i = j - size
                i += 1
        assert want <= got
