"""Language-model scoring by deleted interpolation (operator 7).

Maximum-likelihood n-gram estimates of all orders, and a uniform one, are mixed. The weights
depend on a bucket: the longest context that was seen, by the power of two of its count. They are
learned by expectation-maximisation on counts held out of the estimates: one tenth of the
training documents (crc32 of the id mod 10 = 1) is deleted from the counts for that, and put back
for scoring. EM runs on a histogram of all held-out events by bucket and binned probabilities,
whose size doesn't grow with the corpus.

How the counts get to the texts: one pass cuts every partition into blocks of a bounded number of
tokens, writes each block's token stream to the shared folder (a name and content that a retried
task makes again alike) and sends each distinct n-gram hash of the block once, packed in sorted
arrays by hash range. Each range is summed over all blocks, and each block gets back just the
counts in the order of the hashes it sent. Hot n-grams are thus pre-aggregated, texts are never
shuffled, and no vocabulary is gathered anywhere. Words are counted by 64-bit hashes; longer n-grams
by slots, 2^(``SLOT_BITS`` - 2) or more for every four bytes of the corpus and each order, so that fewer
than one in a thousand shares its slot with another, whatever the corpus's size.

Null and empty texts are one end token; texts of any length are scored whole (a block is larger
where one document is). Rows of a null id are scored, count as held out and are
never learnt from; repeated rows are documents each. Without training documents base scores
are 0 and all weight is on the uniform estimate. An empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .blocks import Store, cuts_of, dump, grouped, load, pack, pack_sorted, unpack, unpack_sorted
from .common import arrow_map, materialize, parallelism, shared_dir, slices, table

ORDER = 3
#: Slots of n-grams of two words and more: so many bits beyond the corpus's size, two of them for the order.
SLOT_BITS, LEAST_BITS = 13, 44
#: Tokens of a block; more only where one document has more.
BLOCK_TOKENS = 1_000_000
#: Bytes of text for each range of hashes.
RANGE_BYTES = 6 << 20
LEVELS, ZERO, STEPS = 21, 127, 60
_END, _BEGIN = np.uint64(0xE4D0E4D0E4D0E4D1), np.uint64(0xBE61BE61BE61BE63)
SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def ngram_keys(h: np.ndarray, position: np.ndarray, order: int, bits: int) -> list[np.ndarray]:
    """The hashes of the n-grams that end at each token: of words alone (64 bits), then of orders 2..n in one array (``bits`` bits, the two lowest tell the order)."""
    more = []
    for o in range(2, order + 1):
        acc = K.mix(h)
        for s in range(1, o):
            before = np.roll(h, s)
            before[position < s] = _BEGIN
            with np.errstate(over="ignore"):
                acc = K.mix(acc * np.uint64(0x9E3779B97F4A7C15) + before + np.uint64(s))
        more.append(acc >> np.uint64(64 - bits) & ~np.uint64(3) | np.uint64(o - 1))
    return [K.mix(h), np.concatenate(more) if more else h[:0]]


class Block:
    """Documents of a block: ids, folds, tokens of each, and the tokens as indices into distinct hashes."""

    def __init__(self, ids, folds, lengths, index, distinct):
        self.ids, self.folds, self.lengths, self.index, self.distinct = ids, folds, lengths, index, distinct

    def dump(self) -> bytes:
        docs = dump({"ids": pa.array(self.ids, pa.int64()), "folds": pa.array(self.folds, pa.int8()), "lengths": pa.array(self.lengths, pa.int64())})
        return dump({"parts": pa.array([docs, pack(self.index), pack_sorted(self.distinct)], pa.large_binary())})

    @classmethod
    def load(cls, data: bytes) -> Block:
        docs, index, distinct = load(data).column("parts").to_pylist()
        docs = load(docs)
        return cls(docs.column("ids").to_pylist(), docs.column("folds").to_numpy(), docs.column("lengths").to_numpy(), unpack(index, np.int32), unpack_sorted(distinct))

    def keys(self, order: int, bits: int) -> list[np.ndarray]:
        h = self.distinct[self.index]
        ends = np.cumsum(self.lengths)
        position = np.arange(len(h)) - np.repeat(ends - self.lengths, self.lengths)
        return ngram_keys(h, position, order, bits)

    def token_folds(self) -> np.ndarray:
        return np.repeat(self.folds, self.lengths)


def _blocks(batches, most: int):
    """Blocks of whole documents, in the order of the rows."""
    ids, parts, lengths, total = [], [], [], 0

    def make():
        h = np.concatenate(parts)
        distinct, index = np.unique(h, return_inverse=True)
        folds = np.array([0 if i is None else zlib.crc32(str(i).encode()) % 10 for i in ids], np.int8)
        return Block(list(ids), folds, np.array(lengths), index.astype(np.int32), distinct)

    for whole in batches:
        for b in slices(whole, "text", 1 << 20):
            h, offsets = K.batch_hashes(b.column("text").to_pylist())
            for r, i in enumerate(b.column("doc_id").to_pylist()):
                own = np.append(h[offsets[r] : offsets[r + 1]], _END)
                if ids and total + len(own) > most:
                    yield make()
                    ids, parts, lengths, total = [], [], [], 0
                ids.append(i)
                parts.append(own)
                lengths.append(len(own))
                total += len(own)
    if ids:
        yield make()


def slot_bits(size: int) -> int:
    return min(62, max(LEAST_BITS, SLOT_BITS + int(size // 4 + 1).bit_length()))


def _check(keys: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(K.mix(keys)).view(np.int64)) if len(keys) else 0


#: What a block sends: words, and longer n-grams, each with counts from estimation (a) and held-out documents (e).
#: What it gets back: the corpus's counts from estimation documents (a), and from all training documents (t).
_SENT = "block long, range int, keys1 binary, a1 binary, e1 binary, keys2 binary, a2 binary, e2 binary"
_BACK = "block long, range int, check long, a1 binary, t1 binary, a2 binary, t2 binary, sums array<long>"


def counted_blocks(docs: DataFrame, folder: str, order: int = ORDER, block: int = BLOCK_TOKENS, ranges: int = 64, bits: int = LEAST_BITS) -> DataFrame:
    """_BACK: counts of each block's n-grams, from estimation and held-out documents, in the order of their hashes.

    Rows with block -1 hold the sums of each range: distinct and all tokens, without and with the held-out ones.
    """
    top = max(1, (ranges - 1).bit_length())

    def send(batches):
        from pyspark import TaskContext

        store = Store(folder)
        for n, blk in enumerate(_blocks(batches, block)):
            number = TaskContext.get().partitionId() << 24 | n
            store.put_bytes(number, blk.dump())  # a retry puts the same content there
            fold, parts = blk.token_folds(), []
            for keys, width in zip(blk.keys(order, bits), (64, bits), strict=True):
                distinct, index = np.unique(keys, return_inverse=True)
                of = np.tile(fold, len(keys) // len(fold))
                a = np.bincount(index[of > 1], minlength=len(distinct)).astype(np.uint32)
                e = np.bincount(index[of == 1], minlength=len(distinct)).astype(np.uint32)
                parts.append((cuts_of(distinct << np.uint64(64 - width), top), distinct, a, e))
                del keys, index, of
            for r in np.flatnonzero(np.diff(parts[0][0]) + np.diff(parts[1][0])).tolist():
                row = {"block": [number], "range": [r]}
                for k, (cuts, distinct, a, e) in enumerate(parts, 1):
                    own = slice(int(cuts[r]), int(cuts[r + 1]))
                    row |= {f"keys{k}": [pack_sorted(distinct[own])], f"a{k}": [pack(a[own])], f"e{k}": [pack(e[own])]}
                yield row

    def add(batches):
        """All blocks' rows of a range stand together: sum them, answer each block."""
        for r, rows in grouped(batches, "range", ("block", "keys1", "a1", "e1", "keys2", "a2", "e2")):
            checks, answers, sums = [0] * len(rows), [[] for _ in rows], None
            for k in (1, 2):
                keys = [unpack_sorted(x[3 * k - 2]) for x in rows]
                distinct, index = np.unique(np.concatenate(keys), return_inverse=True)
                total = [np.bincount(index, weights=np.concatenate([unpack(x[3 * k - 1 + j], np.uint32) for x in rows]), minlength=len(distinct)).astype(np.int64) for j in (0, 1)]
                if k == 1:
                    a, e = total
                    sums = [int((a > 0).sum()), int((a + e > 0).sum()), int(a.sum()), int((a + e).sum())]
                at = 0
                for i, own in enumerate(keys):
                    mine = index[at : at + len(own)]
                    at += len(own)
                    checks[i] ^= _check(own)
                    answers[i] += [pack(total[0][mine]), pack((total[0] + total[1])[mine])]
            yield {"block": [-1], "range": [r], "check": [0], "sums": [sums]} | {c: [None] for c in ("a1", "t1", "a2", "t2")}
            for x, check, own in zip(rows, checks, answers, strict=True):
                yield {"block": [x[0]], "range": [r], "check": [check], "sums": [None]} | dict(zip(("a1", "t1", "a2", "t2"), ([v] for v in own), strict=True))

    sent = arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), send, _SENT)
    dealt = sent.repartition("range").sortWithinPartitions("range", "block")
    return arrow_map(dealt, add, _BACK)


def _with_counts(batches, folder: str, order: int, bits: int):
    """Each block with the counts (order, token) of its n-grams, of either kind."""
    store = Store(folder)
    for number, rows in grouped(batches, "block", ("check", "c1", "c2")):
        blk = Block.load(store.get_bytes(number))
        check, count = 0, []
        for x in rows:
            check ^= x[0]
        for k, keys in enumerate(blk.keys(order, bits)):
            distinct, index = np.unique(keys, return_inverse=True)
            own = np.concatenate([unpack(x[k + 1], np.int64) for x in rows])
            check ^= _check(distinct)
            if len(own) != len(distinct):
                raise RuntimeError(f"block {number} and its counts don't belong together")
            count.append(own[index].reshape(-1, len(blk.index)))
        if check:
            raise RuntimeError(f"block {number} and its counts don't belong together")
        yield blk, np.concatenate(count)


def estimates(count: np.ndarray, first: np.ndarray, docs: float, tokens: float) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood probabilities by order (rows) and the bucket of each token; ``first``: the token begins a document."""
    p = np.zeros(count.shape)
    p[0] = count[0] / max(tokens, 1)
    bucket = np.zeros(count.shape[1], np.int64)
    for o in range(1, len(count)):
        context = np.roll(count[o - 1], 1).astype(np.float64)
        context[first] = docs
        seen = context > 0
        p[o] = np.where(seen, count[o] / np.maximum(context, 1), 0.0)
        bucket = np.where(seen, o * LEVELS + np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64), LEVELS - 1), bucket)
    return p, bucket


def bins(p: np.ndarray) -> np.ndarray:
    """Probabilities in half powers of two; zero apart."""
    return np.where(p > 0, np.minimum(np.rint(-2 * np.log2(np.maximum(p, 1e-300))), ZERO - 1), ZERO).astype(np.int64)


def learn(cells: np.ndarray, weight: np.ndarray, order: int, distinct: float, steps: int = STEPS) -> np.ndarray:
    """EM: weights (bucket, order 0..n; 0 is uniform) from cells packed by bucket and bins."""
    n = order * LEVELS
    p = np.empty((len(cells), order + 1))
    p[:, 0] = 1 / (distinct + 1)
    rest = cells.copy()
    for o in range(1, order + 1):
        q = rest & 127
        p[:, o] = np.where(q == ZERO, 0.0, 2.0 ** (-q / 2))
        rest >>= 7
    able = np.arange(order + 1)[None, :] <= (np.arange(n) // LEVELS + 1)[:, None]  # orders whose context a bucket has
    prior = able / able.sum(axis=1)[:, None]
    out = prior.copy()
    for _ in range(steps):
        share = out[rest] * p
        share *= (weight / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        total = prior.copy()  # one event's worth, so that no weight of an able order dies out
        np.add.at(total, rest, share)
        out = total / total.sum(axis=1)[:, None]
    return out


def _first(blk: Block) -> np.ndarray:
    out = np.zeros(len(blk.index), bool)
    out[np.cumsum(blk.lengths) - blk.lengths] = True
    return out


def portions(blk: Block, most: int = 200_000):
    """(documents, tokens) of a block as slices of about ``most`` tokens (one document may exceed it): a bound on the memory of estimates."""
    ends = np.cumsum(blk.lengths)
    start = 0
    while start < len(ends):
        base = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield slice(start, stop), slice(base, int(ends[stop - 1]))
        start = stop


class Model:
    def __init__(self, order: int, weights: np.ndarray, tokens: int, distinct: int):
        self.order, self.weights, self.tokens, self.distinct = order, weights, tokens, distinct


def _by_block(counts: DataFrame, kind: str) -> DataFrame:
    """The answers of one kind (a or t), each block's together and in the order of ranges."""
    rows = counts.where("block >= 0").select("block", "range", "check", F.col(f"{kind}1").alias("c1"), F.col(f"{kind}2").alias("c2"))
    return rows.repartition("block").sortWithinPartitions("block", "range").select("block", "check", "c1", "c2")


def fit(counts: DataFrame, folder: str, order: int = ORDER, bits: int = LEAST_BITS) -> Model:
    """The mixture weights and the corpus sums; only sums of fixed size come to the driver."""
    s = counts.where("block = -1").agg(*(F.coalesce(F.sum(F.col("sums")[i]), F.lit(0)).alias(n) for i, n in enumerate(("va", "v", "na", "n")))).first()

    def events(batches):
        for blk, count in _with_counts(batches, folder, order, bits):
            mine = blk.token_folds() == 1
            if not mine.any():
                continue
            docs = float(count[0][blk.lengths[0] - 1])  # every document ends alike
            first, cells = _first(blk), []
            for _, own in portions(blk):
                p, bucket = estimates(count[:, own], first[own], docs, float(s.na))
                cell = bucket[mine[own]]
                for o in range(order, 0, -1):
                    cell = cell << 7 | bins(p[o - 1][mine[own]])
                cells.append(cell)
            cell, weight = np.unique(np.concatenate(cells), return_counts=True)
            yield {"cell": cell, "weight": weight}

    got = arrow_map(_by_block(counts, "a"), events, "cell long, weight long").groupBy("cell").agg(F.sum("weight").alias("weight")).toArrow()
    weights = learn(got.column("cell").to_numpy(), got.column("weight").to_numpy().astype(float), order, float(s.va))
    if not s.n:
        weights[:] = np.eye(order + 1)[0]
    return Model(order, weights, int(s.n), int(s.v))


def score(counts: DataFrame, folder: str, model: Model, bits: int = LEAST_BITS) -> DataFrame:
    """SCORE's columns for every document of the blocks."""

    def run(batches):
        for blk, count in _with_counts(batches, folder, model.order, bits):
            docs, first = float(count[0][blk.lengths[0] - 1]), _first(blk)
            for part, own in portions(blk):
                c = count[:, own]
                p, bucket = estimates(c, first[own], docs, float(model.tokens))
                w = model.weights[bucket]
                mixed = w[:, 0] / (model.distinct + 1)
                for o in range(model.order):
                    mixed += w[:, o + 1] * p[o]
                base = np.log10((c[0] + 0.1) / (model.tokens + 0.1 * (model.distinct + 1)))
                lengths = blk.lengths[part]
                starts = np.cumsum(lengths) - lengths
                add = lambda x, at=starts: np.add.reduceat(x, at)
                yield {
                    "doc_id": blk.ids[part], "held_out": blk.folds[part] == 0, "n_tokens": lengths, "n_known": add((c[0] > 0).astype(np.int64)),
                    "train_tokens": np.full(len(starts), model.tokens), "base_score": add(base), "score": add(np.log10(mixed)),
                }

    return arrow_map(_by_block(counts, "t"), run, SCORE)


def train_and_score(docs: DataFrame, order: int = ORDER, block: int = BLOCK_TOKENS) -> DataFrame:
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b
    folder, bits = shared_dir(spark), slot_bits(size)
    ranges = max(4, parallelism(spark), math.ceil(size / RANGE_BYTES))
    counts = materialize(counted_blocks(docs, folder, order, block, ranges, bits))
    return score(counts, folder, fit(counts, folder, order, bits), bits)


def op7_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_and_score(table(spark, sf_dir, "documents"))
