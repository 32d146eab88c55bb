"""Blocks of whole documents in the shared folder, and rows that go by hash range and come back by block."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard

from .common import slices
from .warc import _filesystem


def cuts_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(keys))


def squeeze(x) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x if isinstance(x, bytes) else x.tobytes())


def expand(x: bytes, kind=None):
    data = zstandard.ZstdDecompressor().decompress(x)
    return data if kind is None else np.frombuffer(data, kind)


def dump(columns: dict) -> bytes:
    """Columns of one length as an Arrow stream: plain data, of which nothing is ever run when it is read."""
    batch = pa.record_batch(list(columns.values()), names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def load(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as r:
        return r.read_next_batch()


class Store:
    """Blocks of documents in the shared folder, under names and with contents that a retry makes again."""

    def __init__(self, folder: str):
        self.filesystem, self.root = _filesystem(folder)

    def put_bytes(self, number: int, data: bytes) -> None:
        self.filesystem.create_dir(self.root, recursive=True)
        scratch = f"{self.root}/{number}.{uuid.uuid4().hex}"
        with self.filesystem.open_output_stream(scratch, compression=None) as f:
            f.write(data)
        self.filesystem.move(scratch, f"{self.root}/{number}")

    def get_bytes(self, number: int) -> bytes:
        with self.filesystem.open_input_stream(f"{self.root}/{number}", compression=None) as f:
            return f.read()

    def put(self, number: int, ids: list, texts: list[bytes]) -> None:
        self.put_bytes(number, zstandard.ZstdCompressor(level=3).compress(dump({"ids": pa.array(ids, pa.int64()), "texts": pa.array(texts, pa.large_binary())})))

    def get(self, number: int) -> tuple[list, list[bytes]]:
        b = load(zstandard.ZstdDecompressor().decompress(self.get_bytes(number)))
        return b.column("ids").to_pylist(), b.column("texts").to_pylist()


def blocks_of(batches, most: int):
    ids, texts, total = [], [], 0
    for whole in batches:
        for b in slices(whole, "text"):
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                data = (t or "").encode("utf-8", "surrogatepass")
                if ids and total + len(data) > most:
                    yield ids, texts
                    ids, texts, total = [], [], 0
                ids.append(i)
                texts.append(data)
                total += len(data)
    if ids:
        yield ids, texts


def grouped(batches, key: str, columns: tuple[str, ...]):
    """(key, rows) of rows that are sorted by key, across batches."""
    now, held = None, []
    for b in batches:
        for k, *row in zip(*(b.column(c).to_pylist() for c in (key, *columns)), strict=True):
            if k != now:
                if held:
                    yield now, held
                now, held = k, []
            held.append(row)
    if held:
        yield now, held


def pack(x: np.ndarray) -> bytes:
    """Integers by byte planes, so that high bytes, which are mostly alike, take no room."""
    return squeeze(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T))


def unpack(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(expand(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit integers as the gaps between them."""
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)
