"""The codec against the tokenizers library: odd texts, whole documents, streaming with its lookahead."""

import hashlib
import os
import random

import pytest
import tokenizers

from tessella.llm import bpe

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(decoded)


def odd_texts():
    r = random.Random(3)
    alphabet = "aábcdeé fgh\n\t 0123.,;'’-_<>|=ßÄ漢字かな한국어​ \U0001f600́\x00\x85"
    texts = ["", " ", "  ", " \n \n a", "a  b", "it's we'll I'M", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext", "aaaa" * 500, "1234567890" * 300, "é" * 3000, "--" * 2000, "\n" * 5000]
    texts += ["".join(r.choice(alphabet) for _ in range(r.randint(1, 400))) for _ in range(300)]
    texts += ["".join(r.choice("abcdefghij") for _ in range(70_000)), "".join(r.choice("xyz漢") for _ in range(3000)), " ".join("word" * r.randint(1, 3) for _ in range(40_000)), "ab" * 100_000 + " end  \n", " " * 140_000 + "x"]
    return texts


def test_odd_texts_like_the_library(library):
    codec = bpe.codec(bpe.default_path())
    for t in odd_texts():
        ids = library.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == ids, t[:80]
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False), t[:80]


def test_ill_formed_bytes_decode_like_the_library(library):
    codec, r = bpe.codec(bpe.default_path()), random.Random(1)
    for _ in range(500):
        ids = [r.randrange(len(codec.v.ids)) for _ in range(r.randint(0, 30))]
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_memory_stays_within_the_lookahead(library):
    v = bpe.codec(bpe.default_path()).v
    assert v.lookahead > v.max_token
    r = random.Random(5)
    for text in ("".join(r.choice("aeiounrst") for _ in range(60_000)), "aa" * 30_000, "=" * 50_000):
        t, held, out = bpe.Transducer(v), 0, []
        data = text.encode()
        for i in range(0, len(data), bpe.LONG):
            out += t.push(data[i : i + bpe.LONG])
            held = max(held, len(t.buf))
        assert out + t.finish() == library.encode(text, add_special_tokens=False).ids
        assert held <= v.lookahead + 2 * v.max_token + bpe.LONG


def test_query_on_odd_rows(spark, library):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "null id"), (4, "tie"), (5, "tie"), (6, "long " * 60_000)] + [(10 + i, t) for i, t in enumerate(odd_texts()[:60])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as ids", "'x' as n_tokens", "2 as t")
    got = sorted(((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in bpe.round_trip(df).collect()), key=str)
    assert got == sorted(((i, *want(library, t)) for i, t in rows), key=str)
    assert bpe.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
    encoded = bpe.encode_texts(df.select("doc_id", "text"))
    back = bpe.decode_ids(encoded.where("doc_id is not null"))
    assert {x.doc_id: x.text for x in back.collect() if x.doc_id in (2, 3, 6)} == {2: "", 3: "a b", 6: "long " * 60_000}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
def test_whole_table_like_the_library(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(x) for x in bpe.op6_bpe(spark, DATA).collect())
    assert got == sorted((d.doc_id, *want(library, d.text)) for d in docs)
