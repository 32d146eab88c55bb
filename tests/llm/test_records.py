"""Length-delimited records: checksums, frames, whole texts against the tokenizers library, damage, shuffled reads."""

import itertools
import os
import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessella.llm import records

DATA = "/root/testdata/sf0.001"
ODD = [
    "", None, " ", "\n\n\t", "Don't we'll IT'S 'tis !'s x''s", "naïve Café ÉCOLE ﬁ ß İstanbul ΣΑΣ ς", "é ́a a ̣̈b", "12345 a1b2 ½ ٣٤",
    "<|startoftext|>a <|endoftext|><|endoftext|> <|ENDOFTEXT|> <| x|>", "a\x1cb\x1d c\x85d\xa0e f　g", "\x00\x01 \x7f a\x0bb\x0cc", "日本語のテキスト 한국어 \U0001f600\U0001f468‍\U0001f469",
    "x" * 5000, ("long words " + "ab1!" * 30 + " ") * 40, "it's" * 50, "'" * 9 + "s", "a�b ퟿",
]


def plain(data: bytes) -> int:
    r = 0xFFFFFFFF
    for b in data:
        r ^= b
        for _ in range(8):
            r = (r >> 1) ^ (records.POLYNOMIAL if r & 1 else 0)
    return r ^ 0xFFFFFFFF


def whole():
    t = Tokenizer.from_file(records.default_path())
    t.no_truncation()
    t.no_padding()
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_checksums_of_any_length():
    assert plain(b"123456789") == 0xE3069283  # the published check value
    data = np.random.default_rng(1).integers(0, 256, 3000, np.uint8).tobytes()
    cuts = [0, 0, 1, 3, 7, 71, 135, 136, 400, 1500, 1564, 2999, 3000]
    got = records.crc32c(data, np.array(cuts[:-1]), np.array(cuts[1:]))
    assert got.tolist() == [plain(data[a:b]) for a, b in itertools.pairwise(cuts)]


def test_frames_are_what_the_docstring_says_and_damage_is_told():
    framed = records.frames([b"", b"abc", b"x" * 100])
    for f, p in zip(framed, (b"", b"abc", b"x" * 100), strict=True):
        masked = lambda d: (((c := plain(d)) >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF
        assert f == struct.pack("<Q", len(p)) + struct.pack("<I", masked(struct.pack("<Q", len(p)))) + p + struct.pack("<I", masked(p))
    data = b"".join(framed)
    at = [(0, 16), (16, 19), (35, 116)]
    assert [bytes(p) for p in records.payloads(data, at)] == [b"", b"abc", b"x" * 100]
    for i in range(len(data)):
        bad = bytearray(data)
        bad[i] ^= 4
        with pytest.raises(records.Damaged):
            records.payloads(bytes(bad), at)
    with pytest.raises(records.Damaged):
        records.payloads(data, [(1, 16)])


def test_words_encode_as_the_whole_text_does():
    want, e = whole(), records.Encoder(records.default_path())
    for _ in range(2):  # the second time from memory
        assert [e.encode(t).tolist() for t in ODD] == [want(t) for t in ODD]
    assert all(len(w) <= records.LONG for w in e.words)


def test_every_character_alone_and_between_letters():
    want, e = whole(), records.Encoder(records.default_path())
    for c in [*map(chr, range(0x600)), *map(chr, range(0x1E00, 0x2100)), "\u212a", "\ufb01"]:
        for t in (c, f"a{c}B", f"{c}'s{c}1"):
            assert e.encode(t).tolist() == want(t), (hex(ord(c)), t)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(records, "CACHE", 10)
    e, want = records.Encoder(records.default_path()), whole()
    for k in range(5):
        text = " ".join(f"word{k}{i}" for i in range(30))
        assert e.encode(text).tolist() == want(text)
        assert len(e.words) <= 10 and len(e.words.old) <= 10


def brute(rows):
    """Rows (doc_id, text) in order to doc_id, start, n_tokens, ids_crc32."""
    want, at, out = whole(), 0, []
    for d, t in rows:
        ids = np.array([*want(t), records.END], "<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_odd_rows_files_and_shuffled_reads(spark, tmp_path):
    rows = [(i * 7 % 17, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, None), (3, "again"), (2**62, "big"), (-5, "negative")]
    df = spark.createDataFrame([(t, d, "other", 1) for d, t in rows], "text string, doc_id long, start string, part int").coalesce(1)
    for file_bytes in (records.FILE_BYTES, 2000):
        folder = str(tmp_path / f"f{file_bytes}")
        index = records.write(df, folder, file_bytes=file_bytes)
        assert index.select("file").distinct().count() > (file_bytes == 2000)
        got = records.read(records.in_order(index), folder).collect()
        found = sorted((r.start, r.doc_id, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got)
        ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
        assert found == [(s, d, n, c) for d, s, n, c in brute(ordered)]
        one, two, other = (records.read(records.shuffled(index, seed).coalesce(1), folder).collect() for seed in (1, 1, 2))
        assert one == two != other and sorted(map(str, one)) == sorted(map(str, got)) == sorted(map(str, other))


def test_empty_table(spark, tmp_path):
    index = records.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "e"))
    assert index.count() == 0 and records.read(records.in_order(index), str(tmp_path / "e")).count() == 0


def test_very_long_text(spark, tmp_path):
    text = "Ünïcode words, 42 of them; " * 60_000
    index = records.write(spark.createDataFrame([(1, text), (2, "after")], "doc_id long, text string"), str(tmp_path / "l"))
    got = {r.doc_id: r for r in records.read(records.in_order(index), str(tmp_path / "l")).collect()}
    ids = whole()(text)
    assert got[1].ids == [*ids, 1] and got[2].start == len(ids) + 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
def test_whole_table_as_the_library_does(spark):
    docs = sorted(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in records.op11_records(spark, DATA).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == brute([(r.doc_id, r.text) for r in docs])


def test_end_characters_are_remembered():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    e, library = records.Encoder(path), Tokenizer.from_file(path)
    assert all(e.words.ends[c.encode()] for c in "!,.:")
    for text in ("word! Word, WORD. x: y; z? (a) b) c\" d' e1 f- g\x00", "a! a, a.", "naïve. Ünder!"):
        assert e.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
