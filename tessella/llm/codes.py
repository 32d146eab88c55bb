"""Vector codes by integer product quantisation (operator 12).

Components become integers (floor of 256 times their value) and vectors are cut into equal parts.
Every part position has a codebook of integer entries, which are small and are broadcast. Tasks take
the vectors as Arrow batches and compute all distances of a batch by norm expansion,
|x|^2 - 2 x.c + |c|^2, with exact 64-bit integer matrix products; the first least entry wins. In each
round a task adds up the parts of every entry and sends one row an entry; a grouped shuffle merges
them, and each entry becomes the floor of its mean. All arithmetic is exact, so results depend
neither on how rows are dealt nor on which task is repeated.

Vectors that are null or empty, or hold null or non-finite components, take no part; neither do
those whose length isn't that of the first kept vector (by vec_id, then content). Where the length
isn't a multiple of the number of parts, zeros are added at the end. Integers are held within the
largest bound for which no distance can leave 64 bits (for 64 components some 379 million, which is
a component of 1.4 million). Null ids come last in the order; rows of equal ids are
ordered by their vectors; repeated rows are coded each. With fewer vectors than entries codebooks
are shorter; with none the result is empty. Columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, materialize, table

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Vectors whose distances to the entries are held at once.
BLOCK = 2048
#: Labels up to so many have their sums broadcast (some tens of bytes each); beyond it they are joined by a shuffle.
MOST_LABELS = 1_000_000


def kept(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is there, isn't empty, and has finite components only."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, sound))


def bound(dim: int) -> int:
    """Integers within it have squared distances whose sum over all components fits 64 bits."""
    return max(1, (math.isqrt((2**63 - 1) // max(dim, 1)) - 1) // 2)


def integers(values: np.ndarray, dim: int, parts: int, scale: int) -> np.ndarray:
    """Rows of float components to integers by part: (rows, parts, components of a part)."""
    limit = bound(dim)
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(values.astype(np.float64).reshape(-1, dim) * scale), -limit, limit).astype(np.int64)
    width = -(-dim // parts)
    if width * parts > dim:
        whole = np.concatenate([whole, np.zeros((len(whole), width * parts - dim), np.int64)], axis=1)
    return whole.reshape(len(whole), parts, width)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one part's vectors (rows, width) each the first least entry of (entries, width), and its squared distance."""
    # products and norms may wrap round in 64 bits; their sum is the distance, which fits, and so is exact
    with np.errstate(over="ignore"):
        distances = (x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)[None, :]
    first = distances.argmin(axis=1)
    return first, distances[np.arange(len(x)), first]


def _vectors(batch, dim: int, parts: int, scale: int):
    """(start, integer vectors) of a batch, in blocks."""
    column = batch.column("v")
    for at in range(0, len(column), BLOCK):
        part = column.slice(at, BLOCK)
        yield at, integers(part.flatten().to_numpy(zero_copy_only=False), dim, parts, scale)


def first_entries(rows: DataFrame, dim: int, parts: int, entries: int, scale: int) -> np.ndarray:
    """The parts of the first vectors by id (then content), as codebooks (parts, entries, width). Bounded by ``entries`` rows."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    return np.ascontiguousarray(integers(np.array([r.v for r in first], np.float64), dim, parts, scale).transpose(1, 0, 2))


def refine(rows: DataFrame, books: np.ndarray, dim: int, scale: int) -> np.ndarray:
    """One round: every part goes to its nearest entry, used entries become the floor of their parts' mean."""
    parts, entries, width = books.shape
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(books)

    def run(batches):
        total = np.zeros((parts, entries, width), np.int64)
        count = np.zeros((parts, entries), np.int64)
        for b in batches:
            for _, x in _vectors(b, dim, parts, scale):
                for p in range(parts):
                    code, _ = nearest(x[:, p], shared.value[p])
                    count[p] += np.bincount(code, minlength=entries)
                    np.add.at(total[p], code, x[:, p])
        used = np.argwhere(count)
        yield {"part": used[:, 0], "entry": used[:, 1], "n": count[count > 0], "sums": list(total[count > 0])}

    sent = arrow_map(rows.select("v"), run, "part int, entry int, n long, sums array<long>")
    # sums as decimals, so that no number of rows makes them wrap round; the result has parts x entries x width numbers, the size of the model
    sums = [F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(width)]
    out = books.copy()
    for r in sent.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():
        out[r.part, r.entry] = [int(s) // r.n for s in r[3:]]
    return out


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def fit(rows: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """Codebooks (parts, entries, width) of (vec_id, v) rows of one length."""
    books = first_entries(rows, dim, parts, entries, scale)
    for _ in range(rounds):
        books = refine(rows, books, dim, scale)
    return books


def encode(rows: DataFrame, books: np.ndarray, dim: int, scale: int = SCALE) -> DataFrame:
    """The rows' columns but v, with code (two hex digits a part) and error (squared distances summed over parts); one narrow pass."""
    parts = len(books)
    names = [c for c in rows.columns if c != "v"]
    shared = rows.sparkSession.sparkContext.broadcast(books)
    hexes = np.array([f"{i:02x}" for i in range(max(books.shape[1], 1))])

    def run(batches):
        for b in batches:
            codes, errors = [], []
            for _, x in _vectors(b, dim, parts, scale):
                found = [nearest(x[:, p], shared.value[p]) for p in range(parts)]
                codes += ["".join(c) for c in hexes[np.stack([c for c, _ in found], axis=1)].tolist()]
                errors += sum(e for _, e in found).tolist()
            yield {c: b.column(c) for c in names} | {"code": codes, "error": errors}

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "v")
    return arrow_map(rows, run, f"{kinds}, code string, error long")


def decode(coded: DataFrame, books: np.ndarray, dim: int, scale: int = SCALE, out: str = "embedding") -> DataFrame:
    """vec_id and the vector that its code stands for (the middle of each integer's interval)."""
    shared = coded.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for b in batches:
            code = np.array([list(bytes.fromhex(c)) for c in b.column("code").to_pylist()], np.int64).reshape(-1, len(books))
            whole = np.concatenate([shared.value[p][code[:, p]] for p in range(len(books))], axis=1)[:, :dim]
            yield {"vec_id": b.column("vec_id"), out: list((whole + 0.5) / scale)}

    return arrow_map(coded.select("vec_id", "code"), run, f"vec_id long, `{out}` array<double>")


def with_label_error(coded: DataFrame) -> DataFrame:
    """label_error: error summed over equal labels, nulls together. Sums are aggregated before they are shuffled."""
    sums = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "l"))
    side = F.broadcast(sums) if sums.count() <= MOST_LABELS else sums
    return coded.join(side, F.col("label").eqNullSafe(F.col("l"))).drop("l")


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept(table(spark, sf_dir, "embeddings")).select(F.col("vec_id").cast("long"), F.col("label"), F.col("embedding").alias("v"))
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").select(F.size("v").alias("n")).first()
    dim = first.n if first else 1
    rows = rows.where(F.size("v") == dim)
    books = fit(rows, dim)
    coded = materialize(encode(rows, books, dim))
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The same in SQL: parts as rows, distances by joining the codebook, two rounds and a last assignment."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT x.vec_id, x.p, b.e, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i])))::BIGINT AS d
    FROM parts x JOIN b{r} b USING (p)
  ) GROUP BY ALL
)""")
        if r < ROUNDS:
            steps.append(f"""
s{r} AS MATERIALIZED (
  SELECT p, e, i, sum(v)::BIGINT AS s, count(*) AS n FROM (
    SELECT x.p, a.e, unnest(range(1, len(x.v) + 1)) AS i, unnest(x.v) AS v FROM parts x JOIN a{r} a USING (vec_id, p)
  ) GROUP BY ALL
),
m{r} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS v FROM s{r} GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m USING (p, e))""")
    return f"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS v FROM k, range({PARTS}) r(p)
), b0 AS MATERIALIZED (
  SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS e, v FROM parts
  WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {ENTRIES})
), {",".join(steps)},
h AS (SELECT sha256(string_agg(t, ',' ORDER BY p, e)) AS h FROM (SELECT p, e, array_to_string(v, ',') AS t FROM b{ROUNDS})),
c AS (SELECT vec_id, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256
FROM c JOIN k USING (vec_id), h
"""


#: For rows with distinct ids and vectors of one length, a multiple of the parts.
ORACLE_SQL = _sql()
