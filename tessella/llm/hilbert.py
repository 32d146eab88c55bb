"""Approximate nearest neighbours by shifted space-filling curves (operator 1).

Each of several curves projects the unit vectors by its own random orthonormal map onto a few
dimensions, shifts them, and orders them by Hilbert key. Exact key histograms of a fixed size
(all rows, no sampling) cut every order into blocks of about equal size. A query meets the rows
of the blocks around its own on every curve, a window of ``share`` of the order (at least the own
block and its neighbours); the windows' results merge per query and are ranked again by exact
cosine in double precision on the original vectors.

``share`` is what recall costs. On vectors with structure a few thousandths do; on isotropic
vectors, where neighbours hardly stand out in any projection, 0.9 of recall takes a large part of
the rows, and the search is then a blocked scan for the stated queries, in bounded memory.

Rows whose id is null, or whose vector is null, empty, zero, of another length than most, or
holds null or non-finite components, take no part. Of equal vectors only the ids that can be
among a query's nearest are searched (the smallest k+1, cut before the shuffle), which loses no
result. Repeated rows of an id count once. A query never finds its own id; equal scores go to the
smaller id; of several vectors of one id the nearest counts. Vectors of any size of components
are scaled by powers of two, which changes no digit. A block that is larger than ``BLOCK`` rows
twice over, since many near-equal vectors share a key, is split by hash, and its queries visit
every part. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import arrow_map, materialize, table

CURVES, DIMENSIONS, BITS, SHARE = 8, 6, 8, 0.25
#: Rows of a block at most, on average; and bits of the key that the histogram holds (65,536 counts a curve).
BLOCK, HISTOGRAM_BITS = 20_000, 16
FOUND = "query_id long, vec_id long, score double"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points (one a row), 'bits' bits an axis.

    After J. Skilling, "Programming the Hilbert curve" (AIP Conf. Proc. 707, 2004).
    Works from the top bit down on all points at once: axes are exchanged or inverted as the
    curve's orientation asks, then the Gray code of the interleaved bits is undone.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = np.int64(1) << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            x[0] = np.where(high, x[0] ^ p, x[0])
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= t
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.int64(1) << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b) & 1
    return key


class Curve:
    def __init__(self, number: int, width: int, dimensions: int = DIMENSIONS, bits: int = BITS):
        r = np.random.default_rng([20_000, number])
        d = min(dimensions, width)
        self.map = np.linalg.qr(r.standard_normal((width, d)))[0] * math.sqrt(width)  # unit variance for isotropic vectors
        self.shift, self.bits = r.uniform(-0.5, 0.5, d), bits

    def keys(self, unit: np.ndarray) -> np.ndarray:
        cells = np.clip((unit @ self.map + self.shift + 3.5) / 7 * (1 << self.bits), 0, (1 << self.bits) - 1)
        return hilbert_keys(cells.astype(np.int64), self.bits)


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that no square overflows or vanishes; directions and roundings stay."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, initial=0))[1][:, None])


def unit_rows(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / np.linalg.norm(v, axis=1)[:, None]


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows paired one to one, each computed the same way wherever it stands."""
    a, b = scaled(a), scaled(b)
    norm = lambda v: np.sqrt((v * v).sum(axis=1))
    return np.clip((a * b).sum(axis=1) / (norm(a) * norm(b)), -1.0, 1.0)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): rows with an id and a valid vector, as doubles."""
    v = F.col("v")
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & good)


def neighbours(
    vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", curves: int = CURVES, share: float = SHARE, block: int = BLOCK
) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest found; queries: ids divisible by ``every``."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    shape = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, total = shape["w"], shape["count"]
    rows = rows.where(F.size("v") == width)
    same = Window.partitionBy(F.xxhash64("v"), F.hash("v")).orderBy("vec_id")
    kept = rows.dropDuplicates(["vec_id", "v"]).withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).select("vec_id", "v")
    blocks = max(math.ceil(total / block), math.ceil(3 / share) if share < 1 else 1)
    blocks = max(1, min(blocks, total // 64))  # a few rows are one block, searched whole
    reach = max(1, round(share * blocks / 2 - 0.5)) if blocks > 1 else 0
    keyed = materialize(_keyed(kept, width, curves))
    down = key_bits(width) - HISTOGRAM_BITS
    slot = F.shiftright("key", down) if down > 0 else F.col("key")
    counts = keyed.groupBy("curve", slot.alias("slot")).count().toArrow()  # at most 2^16 rows a curve
    starts, splits = [], []
    for c in range(curves):
        of = np.zeros(1 << HISTOGRAM_BITS, np.int64)
        mine = counts.column("curve").to_numpy() == c
        of[counts.column("slot").to_numpy()[mine]] = counts.column("count").to_numpy()[mine]
        middle = np.cumsum(of) - of / 2  # a slot goes where its middle row falls
        starts.append(np.minimum((middle * blocks / max(1, of.sum())).astype(np.int32), blocks - 1))
        splits.append(np.maximum(1, np.bincount(starts[-1], weights=of, minlength=blocks) // (2 * block)).astype(np.int32))
    places = spark.sparkContext.broadcast(np.stack(starts))  # fixed size: 256 KB a curve
    parts_of = spark.sparkContext.broadcast(np.stack(splits))  # one number a block
    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])

    def assign(batches):
        at = places.value
        for b in batches:
            curve, key = b.column("curve").to_numpy(), b.column("key").to_numpy()
            own = at[curve, key >> max(0, down)]
            salt = K.mix(b.column("vec_id").to_numpy().view(np.uint64)) % parts_of.value[curve, own].astype(np.uint64)
            yield {"curve": curve, "block": own, "part": salt, "q": np.zeros(len(own), bool), "vec_id": b.column("vec_id"), "v": b.column("v")}

    def ask(batches):
        at = places.value
        for b in batches:
            curve, key = b.column("curve").to_numpy(), b.column("key").to_numpy()
            own = at[curve, key >> max(0, down)]
            for step in range(-reach, reach + 1):
                near = own + step
                # at an end of the order the window goes on at its other side, so every window is of one width
                near = np.where(near < 0, own + reach - near, np.where(near >= blocks, own - reach - (near - blocks + 1), near))
                keep = (near >= 0) & (near < blocks)
                at_c, at_b = curve[keep], near[keep]
                n = parts_of.value[at_c, at_b]
                which = np.repeat(np.flatnonzero(keep), n)  # once for each part of the block
                part = b.take(pa.array(which))
                salt = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                yield {"curve": np.repeat(at_c, n), "block": np.repeat(at_b, n), "part": salt, "q": np.ones(len(which), bool), "vec_id": part.column("vec_id"), "v": part.column("v")}

    shape_of = "curve int, block int, part int, q boolean, vec_id long, v binary"
    dealt = arrow_map(keyed, assign, shape_of).union(arrow_map(_keyed(queries, width, curves), ask, shape_of))
    dealt = dealt.repartition("curve", "block", "part").sortWithinPartitions("curve", "block", "part", "q")

    def search(batches):
        """A block's rows come first and stay; its queries stream past them."""
        now, held, held_ids, unit, parts, part_ids = None, None, None, None, [], []
        for b in batches:
            curve, isq = (b.column(n).to_numpy(zero_copy_only=False) for n in ("curve", "q"))
            blk = b.column("block").to_numpy().astype(np.int64) << 32 | b.column("part").to_numpy()
            vec = np.frombuffer(b"".join(b.column("v").to_pylist()), np.float64).reshape(-1, width)
            ids = b.column("vec_id").to_numpy()
            cut = np.flatnonzero((np.diff(curve) != 0) | (np.diff(blk) != 0) | (np.diff(isq) != 0)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(ids)], strict=True):
                if lo == hi:
                    continue
                if now != (curve[lo], blk[lo]):
                    now, held, parts, part_ids = (curve[lo], blk[lo]), None, [], []
                if not isq[lo]:
                    parts.append(vec[lo:hi])
                    part_ids.append(ids[lo:hi])
                elif parts:
                    if held is None:
                        held, held_ids = np.concatenate(parts), np.concatenate(part_ids)
                        unit = unit_rows(held)
                    for i in range(lo, hi, 256):
                        yield _top(vec[i : min(i + 256, hi)], ids[i : min(i + 256, hi)], held, held_ids, unit, k)

    found = arrow_map(dealt, search, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def key_bits(width: int) -> int:
    return min(DIMENSIONS, width) * BITS


def _keyed(rows: DataFrame, width: int, curves: int) -> DataFrame:
    def run(batches):
        orders = [Curve(c, width) for c in range(curves)]
        for b in batches:
            v = np.array(b.column("v").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)
            unit = unit_rows(v)
            data = [x.tobytes() for x in v]
            for c, curve in enumerate(orders):
                yield {"curve": np.full(len(v), c, np.int32), "key": curve.keys(unit), "vec_id": b.column("vec_id"), "v": data}

    return arrow_map(rows, run, "curve int, key long, vec_id long, v binary")


def _top(queries: np.ndarray, query_ids: np.ndarray, held: np.ndarray, held_ids: np.ndarray, unit: np.ndarray, k: int) -> dict:
    """Each query's k best in a block: a matrix product picks a few more, exact scores decide."""
    rough = unit_rows(queries) @ unit.T
    rough[query_ids[:, None] == held_ids[None, :]] = -np.inf
    # everything within rounding of the k-th is looked at, so ties can't be lost
    at = len(held) - min(k, len(held))
    edge = np.partition(rough, at, axis=1)[:, at] - 1e-9
    i, j = np.nonzero((rough >= edge[:, None]) & np.isfinite(rough))
    score = exact_scores(queries[i], held[j])
    order = np.lexsort((held_ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    first = np.searchsorted(i, i)
    keep = np.arange(len(i)) - first < k
    return {"query_id": query_ids[i[keep]], "vec_id": held_ids[j[keep]], "score": score[keep]}


def op1_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))
