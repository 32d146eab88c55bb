"""Removal of repeated byte strings by merged Burrows-Wheeler transforms of shards (operator 3).

Every byte covered by a string of ``length`` bytes that also starts anywhere else goes. How the
suffixes of a corpus are dealt out: each window of ``length`` bytes belongs to the smallest hash
of the ``core``-byte strings in it, which depends on its bytes alone, so equal windows meet
wherever they stand. Consecutive windows of one such hash form a context, at most ``CAP`` windows
long. Equal contexts are counted by digest first (pre-aggregated in each block of documents):
copies are repeated as a whole and are not sent. Where a hash has different contexts and one of
them is single, or a single context repeats itself, one copy of each is sent to the task of its
hash range.

There, the contexts of each block are a shard. A symbol is a string of ``SYMBOL`` bytes; each
shard's transform is of bounded order (length / SYMBOL symbols), over the suffixes at all byte
positions. The shards' transforms are merged by refining their interleave: in each round the
sources are dealt stably by the symbol before, and blocks of equal prefixes split where symbol or
earlier block differ. A boundary that round r is the first to draw lies between suffixes that share
r - 1 symbols, and later rounds leave it where it is: so the rounds write down the common prefixes
of neighbours, and runs of neighbours that share all symbols are the repeated intervals. No suffix
of one shard is ever compared with one of another.

A hash with more than ``HOT`` different contexts (a passage in a large share of all documents)
isn't gathered: digests of its windows are spread by their own value and counted instead.

Null and empty texts keep nothing and lose nothing; repeated rows are documents each, hence
remove each other where long enough; null ids are processed like others. Texts of any length are
processed whole (a block is larger where one document is, and a long text's windows are hashed a
piece at a time); of equal contexts the first block's copy is the one that is sent, which changes
no result; an empty table gives an empty table; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .blocks import Store, blocks_of, cuts_of, expand, grouped, squeeze
from .common import arrow_map, materialize, parallelism, shared_dir, table

LENGTH, CORE, SYMBOL, CAP, HOT = 200, 120, 50, 256, 4000
#: Bytes of text in a block (more only where one document has more), and for each hash range.
BLOCK_BYTES, RANGE_BYTES = 8 << 20, 4 << 20
REPEATED, SEND, SPREAD, LOOP = 1, 2, 4, 4
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


_P = 0x9E3779B97F4A7C15
#: Bytes that are mixed together, at every position: no regular text (Thue-Morse words, say) cancels out in the sums.
LANE = 4
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _tables.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, (1 << 19) + 4096), base, np.uint64)
        x[0] = 1
        with np.errstate(over="ignore"):
            have = _tables[base] = np.multiply.accumulate(x)
    return have[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running sums of the mixed lanes, weighted by powers: what the hashes of spans of ``LANE`` bytes or more are taken from."""
    n = max(0, len(data) - LANE + 1)
    lanes = np.ndarray((n,), "<u4", np.ascontiguousarray(data), 0, (1,)).astype(np.uint64) if n else np.empty(0, np.uint64)
    out = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(K.mix(lanes + np.uint64(_P)) * _powers(_P, n), out=out[1:])
    return out


def span_hashes(run: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit digests of the spans [start, end) of the bytes whose prefix hashes are given."""
    inverse = _powers(pow(_P, -1, 1 << 64), len(run))
    with np.errstate(over="ignore"):
        return K.mix((run[end - (LANE - 1)] - run[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hashes(run: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all strings of k bytes."""
    lanes = k - (LANE - 1)
    n = len(run) - lanes
    with np.errstate(over="ignore"):
        return K.mix((run[lanes:] - run[:n]) * _powers(pow(_P, -1, 1 << 64), len(run))[:n])


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours: running minima of blocks of w from both sides."""
    n = len(h)
    x = np.full(-(-n // w) * w, np.uint64(2**64 - 1), np.uint64)
    x[:n] = h
    x = x.reshape(-1, w)
    left = np.minimum.accumulate(x, axis=1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


class Contexts:
    """The contexts of a block: by document, first window, number of windows, hash, and digest; and distinct (hash, digest)."""

    def __init__(self, texts: list[bytes], length: int, core: int):
        self.texts, self.length = texts, length
        parts = []
        for d, t in enumerate(texts):
            for base in range(0, max(1, len(t) - length + 1), 1 << 19):  # long texts a piece at a time
                piece = t[base : base + (1 << 19) + length - 1]
                if len(piece) < length:
                    continue
                run = prefix_hashes(np.frombuffer(piece, np.uint8))
                gram = gram_hashes(run, core)
                low = sliding_min(gram, length - core + 1)
                cut = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1, [len(low)]))
                size = np.diff(cut)
                first = cut[:-1]
                if len(size) and size.max() > CAP:
                    more = -(-size // CAP)
                    step = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
                    first, size = np.repeat(first, more) + step * CAP, np.minimum(np.repeat(size, more) - step * CAP, CAP)
                loops = self._loops(gram, low, first, size, length - core)
                parts.append((np.full(len(first), d), first + base, size, low[first], span_hashes(run, first, first + size + length - 1), loops))
        every = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool)]
        self.doc, self.first, self.size, self.low, self.digest, loops = every
        order = np.lexsort((self.digest, self.low))
        low, digest = self.low[order], self.digest[order]
        new = np.concatenate(([True], (low[1:] != low[:-1]) | (digest[1:] != digest[:-1]))) if len(low) else np.empty(0, bool)
        self.number = np.empty(len(order), np.int64)  # of each context, among the distinct ones
        self.number[order] = np.cumsum(new) - 1
        self.own = order[new]  # an occurrence of each distinct one
        self.keys, self.digests = low[new], digest[new]
        self.times = np.minimum(np.bincount(self.number, minlength=len(self.keys)), 2).astype(np.uint8) | (loops[self.own] * np.uint8(LOOP)).astype(np.uint8)

    @staticmethod
    def _loops(gram: np.ndarray, low: np.ndarray, first: np.ndarray, size: np.ndarray, reach: int) -> np.ndarray:
        """Whether a context holds its smallest string twice: only then can a window be repeated within the context."""
        top = np.uint64(2**64 - 1)
        edge = np.full(reach, top)
        highest = top - sliding_min(np.concatenate([edge, top - low, edge]), reach + 1)  # of the windows around each place
        at = np.flatnonzero(gram == highest)  # every place that is the smallest of some window
        a, b = np.searchsorted(at, first), np.searchsorted(at, first + size + reach)
        n = b - a
        place = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        mine = np.repeat(np.arange(len(first)), n)
        return np.bincount(mine[gram[at[place]] == low[first[mine]]], minlength=len(first)) > 1

    def bytes_of(self, i: int) -> bytes:
        return self.texts[self.doc[i]][self.first[i] : self.first[i] + self.size[i] + self.length - 1]


def transform(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, symbol: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard's bounded-order transform: for its suffixes in order, where they begin and the symbol before them.

    ``symbols`` has a number from 1 for the symbol at each byte position, 0 where too few bytes are
    left (the end mark); a suffix's next symbol is ``symbol`` bytes on. Each text has a position
    after its last byte, so that each of its ``symbol`` phases, which are the strings, ends with a
    mark. Ranks of the first 1, 2, 4, ... symbols come from ranks of half as many.
    """
    n = len(symbols)
    rank, have = symbols, 1
    at = np.arange(n)
    end = np.repeat(starts + lengths, lengths)
    while have < order:
        step = min(have, order - have)
        ahead = at + step * symbol
        other = np.where(ahead < end, rank[np.minimum(ahead, n - 1)], 0)
        pair = rank.astype(np.int64) << 32 | other
        by = np.argsort(pair, kind="stable")
        fresh = np.concatenate(([0], (np.diff(pair[by]) != 0).cumsum()))
        rank = np.empty(n, np.int64)
        rank[by] = fresh + 1
        have += step
    order_of = np.argsort(rank, kind="stable")
    back = order_of - symbol
    before = np.where(back >= np.repeat(starts, lengths)[order_of], symbols[np.maximum(back, 0)], 0)
    return order_of, before


def merge(shards: list[tuple[np.ndarray, np.ndarray]], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave the shards' transforms: the source of each place in the merged order, and how many symbols (``rounds`` at most) its suffix shares with the one before.

    After its end mark a text goes on with its own beginning, so equal suffixes that hold a mark may be told apart.
    """
    source = np.repeat(np.arange(len(shards), dtype=np.uint16 if len(shards) < 65536 else np.int64), [len(s[0]) for s in shards])
    before = np.concatenate([s[1] for s in shards])
    block = np.zeros(len(source), np.int32)
    shared = np.full(len(source), rounds, np.uint8)
    shared[:1] = 0
    for r in range(rounds):
        by_source = np.argsort(source, kind="stable")  # place of each shard's next suffix
        symbol = np.empty(len(source), before.dtype)
        symbol[by_source] = before
        deal = np.argsort(symbol, kind="stable")
        source, symbol, block = source[deal], symbol[deal], block[deal]
        split = np.empty(len(source), bool)
        split[:1] = False
        np.not_equal(symbol[1:], symbol[:-1], out=split[1:])
        split[1:] |= block[1:] != block[:-1]
        shared[split & (shared == rounds)] = r
        block = np.cumsum(split, dtype=np.int32)
    return source, shared


def interval_sizes(shared: np.ndarray, rounds: int) -> np.ndarray:
    """For each place the number of suffixes in its interval, the longest run of neighbours that share ``rounds`` symbols."""
    first = np.flatnonzero(np.concatenate(([True], shared[1:] < rounds))) if len(shared) else np.empty(0, np.int64)
    size = np.diff(first, append=len(shared))
    return np.repeat(size, size)


def repeated_windows(shards: list[list[bytes]], length: int = LENGTH, symbol: int = SYMBOL) -> list[list[np.ndarray]]:
    """Per shard and text: which of its windows (by start) occur at another place of any text of any shard."""
    rounds = length // symbol
    hashes = []
    for texts in shards:
        for t in texts:
            g = gram_hashes(prefix_hashes(np.frombuffer(t, np.uint8)), symbol) if len(t) >= symbol else np.empty(0, np.uint64)
            hashes.append(g)
    distinct, index = np.unique(np.concatenate(hashes), return_inverse=True)
    out, at, built, where = [], 0, [], []
    k = 0
    for texts in shards:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        starts = np.cumsum(lengths) - lengths
        numbers = np.zeros(lengths.sum(), np.int64)
        for s, t in zip(starts.tolist(), texts, strict=True):
            m = len(hashes[k])
            numbers[s : s + m] = index[at : at + m] + 1
            at += m
            k += 1
        order_of, before = transform(numbers, starts, lengths, symbol, rounds)
        built.append((order_of, before.astype(np.int32)))
        where.append((order_of, lengths, starts))
    source, shared = merge(built, rounds)
    size = interval_sizes(shared, rounds)
    for n, (order_of, lengths, starts) in enumerate(where):
        mine = np.empty(len(order_of), np.int64)
        mine[order_of] = size[source == n]  # a shard's suffixes keep their order in any interleave
        out.append([mine[s : s + m - length] > 1 for s, m in zip(starts.tolist(), lengths.tolist(), strict=True)])
    return out


def mark_contexts(docs: DataFrame, folder: str, ranges: int, length: int, core: int, most: int) -> DataFrame:
    """(block, range, code): for a block's distinct contexts, in order, the flags REPEATED, SEND, SPREAD."""
    bits = max(1, (ranges - 1).bit_length())

    def send(batches):
        from pyspark import TaskContext

        store = Store(folder)
        for n, (ids, texts) in enumerate(blocks_of(batches, most)):
            number = TaskContext.get().partitionId() << 24 | n
            store.put(number, ids, texts)
            c = Contexts(texts, length, core)
            cuts = cuts_of(c.keys, bits)
            yield {"block": [number], "range": [-1], "keys": [b""], "digests": [b""], "times": [b""]}  # every block has a row, contexts or not
            for r in np.flatnonzero(np.diff(cuts)).tolist():
                lo, hi = int(cuts[r]), int(cuts[r + 1])
                yield {"block": [number], "range": [r], "keys": [c.keys[lo:hi].tobytes()], "digests": [c.digests[lo:hi].tobytes()], "times": [squeeze(c.times[lo:hi])]}

    def add(batches):
        for r, rows in grouped(batches, "range", ("block", "keys", "digests", "times")):
            if r < 0:
                yield {"block": [x[0] for x in rows], "range": [-1] * len(rows), "code": [None] * len(rows)}
                continue
            key = np.concatenate([np.frombuffer(x[1], np.uint64) for x in rows])
            digest = np.concatenate([np.frombuffer(x[2], np.uint64) for x in rows])
            times = np.concatenate([expand(x[3], np.uint8) for x in rows]).astype(np.int64)
            order = np.lexsort((digest, key))  # stable: of equal contexts the first block's comes first
            key, digest = key[order], digest[order]
            group = np.concatenate(([0], (key[1:] != key[:-1]).cumsum()))
            first = np.concatenate(([True], (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])))
            which = np.cumsum(first) - 1
            total = np.bincount(which, weights=times[order] & 3)
            loop = np.bincount(which, weights=times[order] & LOOP) > 0
            single = np.bincount(group[first], weights=total == 1) > 0
            distinct = np.bincount(group[first])
            wanted = (single & (distinct > 1))[group] | ((total == 1) & loop)[which]
            code = np.where(total[which] > 1, REPEATED, 0) | np.where(wanted & first, SEND, 0) | np.where(wanted & first & (distinct > HOT)[group], SPREAD, 0)
            back = np.empty(len(code), np.uint8)
            back[order] = code
            at = 0
            for x in rows:
                m = len(x[1]) // 8
                yield {"block": [x[0]], "range": [r], "code": [squeeze(back[at : at + m])]}
                at += m

    sent = arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), send, "block long, range int, keys binary, digests binary, times binary")
    dealt = sent.repartition(ranges, F.when(F.col("range") < 0, -F.col("block")).otherwise(F.col("range"))).sortWithinPartitions("range", "block")
    return arrow_map(dealt, add, "block long, range int, code binary")


def _codes(c: Contexts, rows: list) -> np.ndarray:
    parts = [expand(x, np.uint8) for _, x in sorted(((r, x) for r, x in rows if r >= 0))]
    code = np.concatenate(parts) if parts else np.empty(0, np.uint8)
    if len(code) != len(c.keys):
        raise RuntimeError("a block and its answers don't belong together")
    return code


def find_repeats(codes: DataFrame, folder: str, ranges: int, length: int, core: int, symbol: int) -> DataFrame:
    """(block, range, which, bits): of the contexts a block sent, by number, the windows that are repeated."""
    bits = max(1, (ranges - 1).bit_length())

    def send(batches):
        store = Store(folder)
        for number, rows in grouped(batches, "block", ("range", "code")):
            c = Contexts(store.get(number)[1], length, core)
            code = _codes(c, rows)
            plain = np.flatnonzero((code & SEND > 0) & (code & SPREAD == 0))
            cuts = cuts_of(c.keys[plain], bits)
            for r in np.flatnonzero(np.diff(cuts)).tolist():
                which = plain[cuts[r] : cuts[r + 1]]
                texts = [c.bytes_of(c.own[i]) for i in which]
                yield {"range": [r], "kind": [0], "block": [number], "which": [which.astype(np.int64).tobytes()], "keys": [c.keys[which].tobytes()], "sizes": [np.array([len(t) for t in texts], np.int32).tobytes()], "data": [squeeze(b"".join(texts))]}
            spread = np.flatnonzero(code & SPREAD > 0)
            if len(spread):
                digest, owner, offset = [], [], []
                for i in spread:
                    g = gram_hashes(prefix_hashes(np.frombuffer(c.bytes_of(c.own[i]), np.uint8)), length)
                    digest.append(g)
                    owner.append(np.full(len(g), i))
                    offset.append(np.arange(len(g)))
                digest, owner, offset = map(np.concatenate, (digest, owner, offset))
                order = np.argsort(digest, kind="stable")
                digest, owner, offset = digest[order], owner[order], offset[order]
                cuts = cuts_of(digest, bits)
                for r in np.flatnonzero(np.diff(cuts)).tolist():
                    part = slice(int(cuts[r]), int(cuts[r + 1]))
                    yield {"range": [r], "kind": [1], "block": [number], "which": [owner[part].tobytes()], "keys": [digest[part].tobytes()], "sizes": [offset[part].astype(np.int32).tobytes()], "data": [None]}

    def answer(batch: list, length=length):
        """One group of contexts of whole hashes, a shard for each block."""
        shards: dict[int, tuple[list, list]] = {}
        for block, which, text in batch:
            own = shards.setdefault(block, ([], []))
            own[0].append(which)
            own[1].append(text)
        found = repeated_windows([x[1] for x in shards.values()], length, symbol)
        for (block, (which, _)), got in zip(shards.items(), found, strict=True):
            for i, hit in zip(which, got, strict=True):
                if hit.any():
                    starts = np.flatnonzero(hit)
                    yield block, i, starts

    def search(batches):
        for (kind, r), rows in _grouped2(batches):
            if kind == 1:
                digest = np.concatenate([np.frombuffer(x[2], np.uint64) for x in rows])
                _, index, count = np.unique(digest, return_inverse=True, return_counts=True)
                hit, at = count[index] > 1, 0
                for x in rows:
                    m = len(x[2]) // 8
                    mine = np.flatnonzero(hit[at : at + m])
                    at += m
                    if len(mine):
                        yield {"block": [x[0]], "range": [r], "which": [np.frombuffer(x[1], np.int64)[mine].tobytes()], "start": [np.frombuffer(x[3], np.int32)[mine].tobytes()]}
                continue
            items = []
            for block, which, keys, sizes, data in rows:
                sizes = np.frombuffer(sizes, np.int32)
                ends = np.cumsum(sizes)
                data = expand(data)
                items += zip(np.frombuffer(keys, np.uint64).tolist(), [block] * len(sizes), np.frombuffer(which, np.int64).tolist(), [data[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)], strict=True)
            items.sort(key=lambda x: x[0])
            i = 0
            out: dict[int, tuple[list, list]] = {}
            while i < len(items):  # whole hashes, about a megabyte at a time
                j, total = i, 0
                while j < len(items) and (total < 1 << 20 or items[j][0] == items[j - 1][0]):
                    total += len(items[j][3])
                    j += 1
                for block, n, starts in answer(sorted((x[1:] for x in items[i:j]), key=lambda x: x[0])):
                    own = out.setdefault(block, ([], []))
                    own[0].append(np.full(len(starts), n, np.int64))
                    own[1].append(starts.astype(np.int32))
                i = j
            for block, (which, start) in out.items():
                yield {"block": [block], "range": [r], "which": [np.concatenate(which).tobytes()], "start": [np.concatenate(start).tobytes()]}

    def _grouped2(batches):
        for r, rows in grouped(batches, "range", ("kind", "block", "which", "keys", "sizes", "data")):
            for kind in (0, 1):
                own = [x[1:] for x in rows if x[0] == kind]
                if own:
                    yield (kind, r), own

    by_block = codes.repartition("block").sortWithinPartitions("block", "range").select("block", "range", "code")
    sent = arrow_map(by_block, send, "range int, kind int, block long, which binary, keys binary, sizes binary, data binary")
    dealt = sent.repartition(ranges, "range").sortWithinPartitions("range", "kind", "block")
    return arrow_map(dealt, search, "block long, range int, which binary, start binary")


def removed_spans(c: Contexts, code: np.ndarray, which: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """Per document the maximal runs of bytes to remove, as rows (start, end)."""
    whole = (code & REPEATED > 0)[c.number] if len(c.number) else np.empty(0, bool)
    docs, lo, hi = [c.doc[whole]], [c.first[whole]], [c.first[whole] + c.size[whole] + c.length - 1]
    own = c.own[which]
    docs.append(c.doc[own])
    lo.append(c.first[own] + start)
    hi.append(c.first[own] + start + c.length)
    docs, lo, hi = map(np.concatenate, (docs, lo, hi))
    order = np.lexsort((lo, docs))
    docs, lo, hi = docs[order], lo[order], hi[order]
    out = [np.empty((0, 2), np.int64)] * len(c.texts)
    bounds = np.searchsorted(docs, np.arange(len(c.texts) + 1))
    for d in np.unique(docs):
        a, b = lo[bounds[d] : bounds[d + 1]], np.maximum.accumulate(hi[bounds[d] : bounds[d + 1]])
        new = np.concatenate(([True], a[1:] > b[:-1]))
        first = np.flatnonzero(new)
        out[d] = np.stack([a[first], b[np.append(first[1:], len(a)) - 1]], axis=1)
    return out


def _plan(docs: DataFrame, length: int, core: int, symbol: int, block: int):
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b
    ranges = 1 << (max(4, parallelism(spark), math.ceil(size / RANGE_BYTES)) - 1).bit_length()
    folder = shared_dir(spark)
    codes = materialize(mark_contexts(docs, folder, ranges, length, core, block))
    repeats = materialize(find_repeats(codes, folder, ranges, length, core, symbol))
    rows = codes.select("block", "range", "code", F.lit(None).cast("binary").alias("which"), F.lit(None).cast("binary").alias("start"))
    rows = rows.union(repeats.select("block", "range", F.lit(None).cast("binary"), "which", "start"))
    return folder, rows.repartition("block").sortWithinPartitions("block", "range")


def _with_spans(batches, folder: str, length: int, core: int):
    store = Store(folder)
    for number, rows in grouped(batches, "block", ("range", "code", "which", "start")):
        ids, texts = store.get(number)
        c = Contexts(texts, length, core)
        code = _codes(c, [(r, x) for r, x, w, _ in rows if w is None])
        join = lambda n, kind: np.concatenate([np.empty(0, kind)] + [np.frombuffer(x[n], kind) for x in rows if x[n] is not None])
        yield ids, texts, removed_spans(c, code, join(2, np.int64), join(3, np.int32).astype(np.int64))


def _kept(text: bytes, spans: np.ndarray) -> bytes:
    out, at = [], 0
    for a, b in spans.tolist():
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def repeated_spans(docs: DataFrame, length: int = LENGTH, core: int = CORE, symbol: int = SYMBOL, block: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, spans array of (start, end) in bytes, kept binary) for every row."""
    folder, rows = _plan(docs, length, core, symbol, block)

    def run(batches):
        for ids, texts, spans in _with_spans(batches, folder, length, core):
            for i in range(0, len(ids), 500):
                part = slice(i, i + 500)
                yield {"doc_id": ids[part], "spans": [[{"start": a, "end": b} for a, b in s.tolist()] for s in spans[part]], "kept": [_kept(t, s) for t, s in zip(texts[part], spans[part], strict=True)]}

    return arrow_map(rows, run, "doc_id long, spans array<struct<start:long,end:long>>, kept binary")


def repeat_digests(docs: DataFrame, length: int = LENGTH, core: int = CORE, symbol: int = SYMBOL, block: int = BLOCK_BYTES) -> DataFrame:
    """RESULT's columns for every row, without the texts leaving the tasks."""
    folder, rows = _plan(docs, length, core, symbol, block)

    def run(batches):
        for ids, texts, spans in _with_spans(batches, folder, length, core):
            for i in range(0, len(ids), 5000):
                part = slice(i, i + 5000)
                yield {
                    "doc_id": ids[part], "n_bytes": [len(t) for t in texts[part]], "n_removed": [int((s[:, 1] - s[:, 0]).sum()) for s in spans[part]], "n_spans": [len(s) for s in spans[part]],
                    "kept_sha256": [hashlib.sha256(_kept(t, s)).hexdigest() for t, s in zip(texts[part], spans[part], strict=True)],
                }

    return arrow_map(rows, run, RESULT)


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH h AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents),
p AS (SELECT doc_id, x, octet_length(x) AS n, unnest(range(CAST(octet_length(x) AS BIGINT))) AS i FROM h),
g AS (SELECT doc_id, i, hex(array_slice(x, i + 1, i + 1)) AS b, CASE WHEN n >= i + 200 THEN md5_number(array_slice(x, i + 1, i + 200)) END AS w FROM p),
f AS (SELECT w FROM g WHERE w IS NOT NULL GROUP BY w HAVING count(*) > 1),
m AS (SELECT doc_id, i, b, max(CASE WHEN f.w IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone FROM g LEFT JOIN f ON f.w = g.w),
k AS (SELECT *, gone - coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) AS step FROM m),
a AS (SELECT doc_id, sum(gone) AS n_removed, count(*) FILTER (WHERE step = 1) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM k GROUP BY doc_id)
SELECT h.doc_id, CAST(octet_length(x) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM h LEFT JOIN a ON a.doc_id = h.doc_id
"""
