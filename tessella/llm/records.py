"""Token ids as length-delimited binary records with an offset index (operator 11).

A data file is a run of frames. A frame is the payload's length (8 bytes, little-endian), the masked
CRC-32C of those 8 bytes (4), the payload, and the masked CRC-32C of the payload (4), so that a
flipped bit or a wrong offset is told before anything is believed. A payload is ``HEAD`` (flags,
bytes an id, document id) and the ids, in as few bytes each as the vocabulary needs.

Writing: rows are range-partitioned and sorted by document id; every task encodes its texts and
streams frames into a file of its own. It yields one row a record, and those rows, behind which
prefix sums over the files put the number of ids before each document, are written as a Parquet
table beside the files: the offset index. Spark's committer decides which attempt's rows count, and
a file that no row names is never read, so a retried task or a lost executor does no harm.

Reading: index rows, selected and ordered as wanted (``shuffled`` orders them by a seeded hash), are
fetched by coalesced byte ranges, and both checksums of every frame are verified.

Texts are encoded word by word: no match of the splitting pattern holds white space, no character
composes with ASCII white space, and lower-casing goes by single characters, so the words between
ASCII white space encode as they do within the text. Words go to the tokenizers library once while
they are remembered, in a memory of fixed size.

Null texts are empty (the end id alone). Null document ids come first; rows of one id stand in the
order of the table's files. Texts of any length are written whole, as one record. An empty table gives an empty
index. Repeated rows are records each, ties in the order can't change an id; columns of other names
are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, materialize, shared_dir, slices, table
from .warc import _filesystem, coalesce_ranges

INDEX = "part long, seq long, file string, offset long, length long, doc_id long, n_tokens long, before long"
#: A payload's head: flags (1: the document has an id), bytes an id, two unused, the document's id.
HEAD = struct.Struct("<BBHq")
LENGTH, CHECK = struct.Struct("<Q"), struct.Struct("<I")
#: Bytes of a frame around its payload.
FRAME = 16
#: Texts of about so many bytes go to one data file.
FILE_BYTES = 64 << 20
#: Bytes of records that one task reads back.
TASK_BYTES = 32 << 20
#: Words remembered, and the longest that are (in bytes).
CACHE, LONG = 600_000, 64
END = 1

# CRC-32C --------------------------------------------------------------------------------------

#: Fixed value: the reflected Castagnoli polynomial.
POLYNOMIAL = 0x82F63B78
#: Bytes that one row of the parallel register run takes.
ROW = 64


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


_TABLE = _byte_table()


def _through(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit registers, given by its values on single bytes."""
    return tables[0][x & 255] ^ tables[1][(x >> 8) & 255] ^ tables[2][(x >> 16) & 255] ^ tables[3][x >> 24]


def _advances(count: int = 40) -> list[np.ndarray]:
    """For each j the map of a register over ROW * 2^j zero bytes."""
    x = (np.arange(256, dtype=np.uint32)[None, :] << np.array([0, 8, 16, 24], np.uint32)[:, None]).astype(np.uint32)
    for _ in range(ROW):
        x = _TABLE[x & 255] ^ (x >> 8)
    out = [x]
    for _ in range(count - 1):
        out.append(_through(out[-1], out[-1]))
    return out


_ADVANCE = _advances()


def crc32c(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32C of each data[start:end], all at once.

    Every string is cut into rows of ROW bytes, counted from its end (zeros before its first byte
    leave a zero register alone); rows run through the byte table side by side, then each row's
    register moves over the rows behind it, and a string's registers are added up.
    """
    starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
    size = ends - starts
    out = np.zeros(len(size), np.uint32)
    short = np.flatnonzero(size < 4)
    for i in short:
        r = 0xFFFFFFFF
        for b in data[starts[i] : ends[i]]:
            r = int(_TABLE[(r ^ b) & 255]) ^ (r >> 8)
        out[i] = r ^ 0xFFFFFFFF
    many = np.flatnonzero(size >= 4)
    if not len(many):
        return out
    rows = -(-size[many] // ROW)
    first = np.concatenate(([0], np.cumsum(rows)))
    flat = np.zeros(first[-1] * ROW, np.uint8)
    source = np.frombuffer(data, np.uint8)
    for k, i in enumerate(many):
        a = first[k + 1] * ROW - size[i]
        flat[a : a + size[i]] = source[starts[i] : ends[i]]
        flat[a : a + 4] ^= 255  # the register begins with all ones
    register = np.zeros(first[-1], np.uint32)
    for column in np.ascontiguousarray(flat.reshape(-1, ROW).T):
        register = _TABLE[(register ^ column) & 255] ^ (register >> 8)
    behind = np.repeat(first[1:], rows) - 1 - np.arange(first[-1])
    j = 0
    while (behind >> j).any():
        on = np.flatnonzero((behind >> j) & 1)
        register[on] = _through(_ADVANCE[j], register[on])
        j += 1
    out[many] = np.bitwise_xor.reduceat(register, first[:-1]) ^ np.uint32(0xFFFFFFFF)
    return out


def mask(crc: np.ndarray) -> np.ndarray:
    """The stored form of a checksum, so that a checksum of data that hold checksums stays sound: rotated, plus a constant."""
    crc = crc.astype(np.uint32)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


class Damaged(ValueError):
    """A frame whose length or payload doesn't match its checksum."""


def frames(payloads: list[bytes]) -> list[bytes]:
    """Each payload with its length and both checksums around it."""
    lengths = b"".join(LENGTH.pack(len(p)) for p in payloads)
    at = np.arange(len(payloads)) * LENGTH.size
    heads = mask(crc32c(lengths, at, at + LENGTH.size)).tolist()
    ends = np.cumsum([len(p) for p in payloads])
    bodies = mask(crc32c(b"".join(payloads), ends - [len(p) for p in payloads], ends)).tolist()
    return [LENGTH.pack(len(p)) + CHECK.pack(h) + p + CHECK.pack(b) for p, h, b in zip(payloads, heads, bodies, strict=True)]


def payloads(data: bytes | memoryview, ranges: list[tuple[int, int]]) -> list[memoryview]:
    """The payloads of the frames at (offset, length); raises Damaged where a checksum fails."""
    view = memoryview(data)
    at = np.array([o for o, _ in ranges], np.int64)
    size = np.array([n for _, n in ranges], np.int64)
    told = np.array([LENGTH.unpack_from(view, o)[0] if n >= FRAME else 0 for o, n in ranges], np.uint64)
    heads = np.array([CHECK.unpack_from(view, o + 8)[0] if n >= FRAME else 0 for o, n in ranges], np.uint32)
    if (size < FRAME).any() or (mask(crc32c(view, at, at + 8)) != heads).any() or (told != (size - FRAME).astype(np.uint64)).any():
        raise Damaged("a frame's length is damaged")
    ends = at + size - 4
    if (mask(crc32c(view, at + 12, ends)) != np.array([CHECK.unpack_from(view, e)[0] for e in ends.tolist()], np.uint32)).any():
        raise Damaged("a frame's payload is damaged")
    return [view[o + 12 : e] for o, e in zip(at.tolist(), ends.tolist(), strict=True)]


# encoding -------------------------------------------------------------------------------------


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is printable, else the next free one from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


class Encoder:
    """Token ids of whole texts by the tokenizers library, each distinct word encoded once while it is remembered.

    A word of ASCII and Latin-1 letters is its own normal form once it is lower-cased, so what the
    splitting pattern finds in it goes straight to the library's model; others go through the whole library.
    """

    #: Words that need no normal form, and what the tokenizer's own pattern finds in them once they are lower-cased.
    SIMPLE = re.compile(r"[\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
    PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\t-\r a-z0-9\xdf-\xf6\xf8-\xff]+")
    LETTERS = _byte_letters()

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        stored = [i.to_bytes(self.kind.itemsize, "little") for i in range(size)]
        simple, find, letters, tokenize = self.SIMPLE.fullmatch, self.PIECES.findall, self.LETTERS, tokenizer.model.tokenize

        class Words(dict):
            """A word's ids as they are stored. Two generations of words, so that common ones stay when memory is full."""

            def __init__(self):
                self.old: dict[bytes, bytes] = {}
                #: The ids of single characters that stand behind letters.
                self.ends = {bytes([i]): b"".join([stored[t.id] for t in tokenize(chr(i).translate(letters))]) for i in range(128)}

            def __missing__(self, word: bytes) -> bytes:
                ids = self.old.get(word)
                if ids is None:
                    ids = self.encode(word)
                if len(word) <= LONG:
                    if len(self) >= CACHE:
                        self.old = dict(self)
                        self.clear()
                    self[word] = ids
                return ids

            def encode(self, word: bytes) -> bytes:
                if word.isalpha():  # ASCII letters are one piece, whatever stands behind them but an apostrophe's
                    return b"".join([stored[t.id] for t in tokenize(word.lower().decode())])
                if word[:-1].isalpha() and word[-1] < 128:
                    return self[word[:-1]] + self.ends[word[-1:]]
                text = word.decode()
                if simple(text) and "<|" not in text:
                    return b"".join([stored[t.id] for p in find(text.lower()) for t in tokenize(p.encode().decode("latin-1").translate(letters))])
                return b"".join([stored[i] for i in tokenizer.encode(text, add_special_tokens=False).ids])

        self.words = Words()

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.words.__getitem__, (text or "").encode("utf-8", "replace").split())), self.kind)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def payload(doc_id: int | None, ids: np.ndarray) -> bytes:
    return HEAD.pack(doc_id is not None, ids.itemsize, 0, doc_id or 0) + ids.tobytes()


def parse(data: memoryview) -> tuple[int | None, np.ndarray]:
    """A payload's document id and its token ids, unsigned 32-bit little-endian."""
    flags, size, _, doc_id = HEAD.unpack_from(data)
    return doc_id if flags else None, np.frombuffer(data, f"<u{size}", offset=HEAD.size).astype("<u4")


# files ----------------------------------------------------------------------------------------


def write(docs: DataFrame, folder: str, path: str | None = None, end: int = END, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write (doc_id, text) rows as data files in ``folder``, and return the offset index, itself written there as Parquet.

    Index columns: part, seq (the order of files, and of records in them), file, offset, length,
    doc_id, n_tokens, start (ids of all documents before). One shuffle, by ranges of doc_id; rows
    of one id may be dealt to several files, so that a repeated id doesn't fill one task.
    """
    path = path or default_path()
    names = [x.split(" ")[0] for x in INDEX.split(", ")]
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("place", F.monotonically_increasing_id())
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text") + FRAME), F.lit(0)).alias("b")).first().b
    files = max(1, -(-size // file_bytes))

    def run(batches):
        from pyspark import TaskContext

        filesystem, root = _filesystem(folder)
        filesystem.create_dir(root, recursive=True)
        part, seq, at, before, e = TaskContext.get().partitionId(), 0, 0, 0, encoder(path)
        name = f"{part:06d}-{uuid.uuid4().hex}.records"
        with filesystem.open_output_stream(f"{root}/{name}", compression=None) as out:
            for whole in batches:
                for b in slices(whole, "text", 2 << 20):
                    doc_ids = b.column("doc_id").to_pylist()
                    ids = [np.append(e.encode(t), e.kind.type(end)) for t in b.column("text").to_pylist()]
                    framed = frames([payload(d, x) for d, x in zip(doc_ids, ids, strict=True)])
                    out.write(b"".join(framed))
                    lengths = np.array([len(f) for f in framed], np.int64)
                    counts = np.array([len(x) for x in ids], np.int64)
                    n = len(ids)
                    yield dict(zip(names, ([part] * n, np.arange(seq, seq + n), [name] * n, at + np.cumsum(lengths) - lengths, lengths, doc_ids, counts, before + np.cumsum(counts) - counts), strict=True))
                    seq, at, before = seq + n, at + int(lengths.sum()), before + int(counts.sum())

    dealt = rows.repartitionByRange(files, "doc_id", "place").sortWithinPartitions("doc_id", "place")
    raw = materialize(arrow_map(dealt, run, INDEX))
    # one row a file: the ids in all files before it
    totals = raw.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    index = raw.join(bases, "part").select(*names[:-1], (F.col("base") + F.col("before")).alias("start"))
    index.write.parquet(f"{folder}/index")
    return docs.sparkSession.read.schema(index.schema).parquet(f"{folder}/index")


def ascending(rows: list[tuple]) -> Iterator[list[tuple[str, int, int]]]:
    """Rows' (file, offset, length) in the runs that go forwards in one file: only within one may ranges be read together."""
    run: list[tuple[str, int, int]] = []
    for file, offset, length, *_ in rows:
        if run and (file != run[-1][0] or offset < run[-1][1]):
            yield run
            run = []
        run.append((file, offset, length))
    if run:
        yield run


def fetch(rows: DataFrame, folder: str, each, schema: str) -> DataFrame:
    """The records that index rows (file, offset, length, start, n_tokens) name, read in the rows' own order: ``each`` turns (start, doc_id, ids) lists into columns."""

    def run(batches):
        filesystem, root = _filesystem(folder)
        name, source = None, None
        for b in batches:
            wanted = list(zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length", "start", "n_tokens")), strict=True))
            done = 0
            for file, first, last, ranges in chain.from_iterable(coalesce_ranges(x, gap=1 << 12) for x in ascending(wanted)):
                if file != name:
                    name, source = file, filesystem.open_input_file(f"{root}/{file}")
                data = source.read_at(last - first, first)
                found = [parse(p) for p in payloads(data, [(o - first, n) for o, n in ranges])]
                part = wanted[done : done + len(ranges)]
                done += len(ranges)
                if any(len(ids) != w[4] for (_, ids), w in zip(found, part, strict=True)):
                    raise Damaged(f"records of {file} don't match the index")
                yield each([w[3] for w in part], [d for d, _ in found], [ids for _, ids in found])

    return arrow_map(rows.select("file", "offset", "length", "start", "n_tokens"), run, schema)


def in_order(index: DataFrame) -> DataFrame:
    """Index rows dealt to tasks by bytes, in the order of the files."""
    # index rows are small, what they stand for isn't: the number of tasks follows the bytes to read
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("b")).first().b
    return index.repartitionByRange(max(1, -(-size // TASK_BYTES)), "file", "offset").sortWithinPartitions("file", "offset")


def shuffled(index: DataFrame, seed: int) -> DataFrame:
    """Index rows dealt to tasks by bytes in a seeded order, the same for the same seed and index (one epoch of shuffled reads)."""
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("b")).first().b
    order = F.xxhash64(F.lit(seed), "part", "seq")
    return index.withColumn("order", order).repartitionByRange(max(1, -(-size // TASK_BYTES)), "order").sortWithinPartitions("order", "part", "seq")


def read(rows: DataFrame, folder: str) -> DataFrame:
    """doc_id, start and ids (array<long>) of the index rows given, in their order."""
    return fetch(rows, folder, lambda starts, doc_ids, ids: {"doc_id": doc_ids, "start": starts, "ids": ids}, "doc_id long, start long, ids array<long>")


def op11_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    index = write(table(spark, sf_dir, "documents"), folder)
    each = lambda starts, doc_ids, ids: {"doc_id": doc_ids, "start": starts, "n_tokens": [len(x) for x in ids], "ids_crc32": [zlib.crc32(x) for x in ids]}
    return fetch(in_order(index), folder, each, "doc_id long, start long, n_tokens long, ids_crc32 long")
