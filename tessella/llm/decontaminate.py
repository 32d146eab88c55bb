"""Benchmark decontamination by size-partitioned MinHash containment search (operator 4).

Items (short) and documents (long) are sets of hashed 5-word shingles. Items are partitioned by
size into powers of two. An item of q shingles is contained if at least ceil(c q) of them are in
the document, so at most q - ceil(c q) are missing: of its smallest q - ceil(c q) + 1 hash values
(a bottom-k MinHash sketch) one at least is in any document that contains the item. The sketches
are one sorted index; a document's hashes are looked up in it, all documents of a batch at once, so
a document costs its own length however many items there are. A hit counts only in the size
partitions that the document is large enough for. Documents aren't cut to sketches themselves: a
short item inside a long document would be lost. What is found is verified by exact containment of
the shingles, told apart by two independent hashes each. The search therefore has no false
negatives and no false positives.

The index travels to the documents' tasks if it takes at most ``most_broadcast`` hashes (their
number is counted first), so documents aren't shuffled. Beyond that the sketches are joined with
the documents' shingles by key, and only candidates meet texts and item sets again.

Items with fewer words than a shingle are matched as one whole sequence against documents' equal
runs of that many words. Null and empty items match nothing, null and empty texts contain
nothing; texts of any length are searched whole; repeated item rows count once per item id and
text; rows of null ids match like others. A document row gives at most one result row per item
id, of texts that share an id the one with the largest share, at equal shares the one of the
smaller size. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import arrow_map, materialize, slices, table

SHINGLE, CONTAINMENT = 5, (4, 5)
MOST_BROADCAST = 4_000_000
MATCH = "doc_id long, item_id long, n_shared long, n_item long"


def need(q, share: tuple[int, int] = CONTAINMENT):
    return (q * share[0] + share[1] - 1) // share[1]


def item_sets(items: DataFrame, k: int = SHINGLE, share: tuple[int, int] = CONTAINMENT) -> DataFrame:
    """item, item_id, width (words in a shingle), q, part (the size's power of two), shingles (wide), sketch."""

    def run(batches):
        for b in batches:
            rows = {n: [] for n in ("item", "item_id", "width", "q", "part", "shingles", "sketch")}
            for i, t in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                n = len(K.words(t))
                if not n:
                    continue
                s = K.wide_sets([t], k)[0]  # sorted: the smallest hashes come first
                q = len(s)
                size = q - need(q, share) + 1
                own = int.from_bytes(hashlib.blake2b(s.tobytes() + bytes([min(k, n)]), digest_size=8).digest(), "little", signed=True)
                for name, value in zip(rows, (own, i, min(k, n), q, q.bit_length(), s.tobytes(), s[:size, 0].tobytes()), strict=True):
                    rows[name].append(value)
            yield rows

    # repeated rows of an id and a text have the same set
    return arrow_map(items.select(F.col("item_id").cast("long"), "text"), run, "item long, item_id long, width int, q long, part int, shingles binary, sketch binary").dropDuplicates(["item", "item_id", "width"])


def fullest(found: list[tuple[int | None, int, int]]) -> list[tuple[int | None, int, int]]:
    """Of the (item_id, shared, q) of one document, one for each id."""
    best: dict[int | None, tuple[int, int]] = {}
    for item_id, shared, q in found:
        old = best.get(item_id)
        if old is None or (shared * old[1], -q) > (old[0] * q, -old[1]):
            best[item_id] = (shared, q)
    return [(i, *v) for i, v in best.items()]


def windows(h: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of ``width`` words of a batch's documents, and the document of each."""
    if len(h) < width:
        return h[:0], np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(h) - width + 1]
    inside = np.arange(len(owner)) + width <= offsets[owner + 1]
    return K.shingles(h, width)[inside], owner[inside]


class Index:
    """Sketches of all items by width as sorted keys with their items, and each item's size partition and whole set."""

    def __init__(self, rows: list, share: tuple[int, int]):
        self.share = share
        self.items = [(r["item_id"], r["q"], np.frombuffer(r["shingles"], np.uint64).reshape(-1, 2)) for r in rows]
        least: dict[tuple[int, int], int] = {}  # the fewest shingles that an item of a size partition needs
        for r in rows:
            at = r["width"], r["part"]
            least[at] = min(least.get(at, 1 << 62), need(r["q"], share))
        self.width = [r["width"] for r in rows]
        self.least = np.array([least[r["width"], r["part"]] for r in rows], np.int64)
        self.keys: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in sorted({r["width"] for r in rows}):
            members = [n for n, r in enumerate(rows) if r["width"] == width]
            keys = np.concatenate([np.frombuffer(rows[n]["sketch"], np.uint64) for n in members])
            owner = np.repeat(np.array(members), [len(rows[n]["sketch"]) // 8 for n in members])
            order = np.argsort(keys, kind="stable")
            distinct, first = np.unique(keys[order], return_index=True)
            self.keys[width] = distinct, np.append(first, len(keys)), owner[order]

    def candidates(self, h: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Distinct (document of the batch, item), by document, whose sketches meet in a partition that fits."""
        out = []
        for width, (keys, first, owner) in self.keys.items():
            own, doc = windows(h, offsets, width)
            at = np.searchsorted(keys, own)
            at[at == len(keys)] = 0
            hit = np.flatnonzero(keys[at] == own)
            at, doc = at[hit], doc[hit]
            n = first[at + 1] - first[at]
            item = owner[np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            doc = np.repeat(doc, n)
            enough = np.diff(offsets)[doc] - width + 1 >= self.least[item]
            out.append(np.unique(np.stack([doc[enough], item[enough]], axis=1), axis=0))
        return [tuple(x) for x in np.concatenate(out).tolist()] if out else []

    def search(self, texts: list, k: int) -> list[tuple[int, int | None, int, int]]:
        """(document of the batch, item_id, shared, q) of the items that documents contain."""
        found: dict[int, list] = {}
        wide: tuple[int, dict] = (-1, {})
        for doc, n in sorted(self.candidates(*K.batch_hashes(texts))):
            item_id, q, s = self.items[n]
            if wide[0] != doc:
                wide = (doc, {})  # one document's sets at a time
            width = self.width[n]
            if width not in wide[1]:
                wide[1][width] = K.wide_sets([texts[doc]], width)[0]
            both = K.shared(s, wide[1][width])
            if both >= need(q, self.share):
                found.setdefault(doc, []).append((item_id, both, q))
        return [(doc, *x) for doc, rows in found.items() for x in fullest(rows)]


def contained_items(docs: DataFrame, items: DataFrame, k: int = SHINGLE, share: tuple[int, int] = CONTAINMENT, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) for every document row and item that it contains."""
    found = materialize(item_sets(items, k, share))
    size = found.agg(F.coalesce(F.sum((F.length("shingles") + F.length("sketch")) / 8), F.lit(0)).alias("s")).first().s
    if size <= most_broadcast:
        index = docs.sparkSession.sparkContext.broadcast(Index([r.asDict() for r in found.collect()], share))  # within the counted bound
        return search_local(docs, index, k)
    return search_joined(docs, found, share)


def search_local(docs: DataFrame, index, k: int = SHINGLE) -> DataFrame:
    def run(batches):
        ix = index.value
        for whole in batches:
            for b in slices(whole, "text", 1 << 20):
                ids = b.column("doc_id").to_pylist()
                rows = ix.search(b.column("text").to_pylist(), k)
                yield {"doc_id": [ids[r[0]] for r in rows]} | {name: [r[j] for r in rows] for j, name in enumerate(("item_id", "n_shared", "n_item"), 1)}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, MATCH)


def search_joined(docs: DataFrame, found: DataFrame, share: tuple[int, int] = CONTAINMENT) -> DataFrame:
    """The same by joins: documents' shingles meet the sketches; the candidates' texts and item sets are verified together."""
    widths = [r.width for r in found.select("width").distinct().orderBy("width").collect()]  # at most k of them

    def explode(batches):
        for whole in batches:
            for b in slices(whole, "text", 1 << 20):
                h, offsets = K.batch_hashes(b.column("text").to_pylist())
                ids = b.column("own").to_numpy()
                for w in widths:
                    own, doc = windows(h, offsets, w)
                    key = np.unique(np.stack([doc.astype(np.uint64), own], axis=1), axis=0) if len(own) else np.empty((0, 2), np.uint64)
                    for i in range(0, len(key), 1 << 18):
                        part = key[i : i + (1 << 18)]
                        at = part[:, 0].astype(np.int64)
                        yield {"own": ids[at], "width": np.full(len(part), w, np.int32), "key": np.ascontiguousarray(part[:, 1]).view(np.int64), "size": (np.diff(offsets) - w + 1)[at]}

    def unpack(batches):
        for b in batches:
            sets = [np.frombuffer(x, np.int64) for x in b.column("sketch").to_pylist()]
            n = [len(x) for x in sets]
            yield {c: np.repeat(b.column(c).to_numpy(), n) for c in ("item", "width", "part", "q")} | {"key": np.concatenate(sets) if sets else []}

    def check(batches):
        for whole in batches:
            for b in slices(whole, "text", 1 << 20):
                out = {"row": [], "item_id": [], "n_shared": [], "n_item": []}
                for row, t, i, w, q, s in zip(*(b.column(c).to_pylist() for c in ("own", "text", "item_id", "width", "q", "shingles")), strict=True):
                    if len(K.words(t)) < w:
                        continue
                    both = K.shared(np.frombuffer(s, np.uint64).reshape(-1, 2), K.wide_sets([t], w)[0])
                    if both >= need(q, share):
                        for name, value in zip(out, (row, i, both, q), strict=True):
                            out[name].append(value)
                yield out

    # every document row has a key of its own, so rows that share an id stay apart
    rows = materialize(docs.select(F.col("doc_id").cast("long"), "text").withColumn("own", F.monotonically_increasing_id()))
    keys = arrow_map(rows.select("own", "text"), explode, "own long, width int, key long, size long")
    sketches = arrow_map(found.select("item", "width", "part", "q", "sketch"), unpack, "item long, width int, part int, q long, key long").distinct()
    least = sketches.groupBy("width", "part").agg(F.min(F.ceil(F.col("q") * share[0] / share[1])).alias("least"))
    hit = keys.join(sketches.join(least, ["width", "part"]), ["key", "width"]).where("size >= least").select("own", "item", "width").distinct()
    pairs = hit.join(found.select("item", "item_id", "width", "q", "shingles"), ["item", "width"]).join(rows.select("own", "text"), "own")
    good = arrow_map(pairs.select("own", "text", "item_id", "width", "q", "shingles"), check, "row long, item_id long, n_shared long, n_item long")
    best = good.groupBy("row", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("c"), (-F.col("n_item")).alias("m"), "n_shared", "n_item")).alias("b"))
    return rows.select("doc_id", F.col("own").alias("row")).join(best, "row").select("doc_id", "item_id", F.col("b.n_shared").alias("n_shared"), F.col("b.n_item").alias("n_item"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TOKENS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""
ORACLE_SQL = rf"""
WITH i AS (SELECT item_id, {_TOKENS} AS w FROM benchmark),
d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
iw AS (SELECT item_id, w, least(5, len(w)) AS k FROM i WHERE len(w) > 0),
s AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: list_aggregate(w[j:j + k - 1], 'string_agg', ' '))) AS g FROM iw),
q AS (SELECT item_id, k, count(*) AS n_item FROM s GROUP BY item_id, k),
ks AS (SELECT DISTINCT k FROM iw),
t AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: list_aggregate(w[j:j + k - 1], 'string_agg', ' '))) AS g FROM d, ks WHERE len(w) >= k)
SELECT t.doc_id, s.item_id, count(*) AS n_shared, any_value(q.n_item) AS n_item
FROM t JOIN s ON t.g = s.g AND t.k = s.k JOIN q ON q.item_id = s.item_id AND q.k = s.k
GROUP BY t.doc_id, s.item_id HAVING 5 * count(*) >= 4 * any_value(q.n_item)
"""
