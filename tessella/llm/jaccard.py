"""N-gram Jaccard join with token-combination prefixes (operator 10).

A document's set holds the hashes of its distinct k-word shingles. Sets that are equal form a
class and only its representative goes on. Shingles are put in one global order, rarest first, by
the number of documents that hold them, counted over all documents. If two sets
link, of a set of n shingles at most m = n - ceil(t n) are missing in the other, so their first
common shingle c1 stands among the first m+1 of both, and their second, c2, among the first m+2.
If c1 is rare, it is indexed alone. If it is frequent, so is c2, and the pair (c1, c2) is
indexed. Pairs of tokens grow with the square of a set, so of sets of more than ``BIG`` shingles
the frequent ones are indexed alone (from 0.9 of that on, both ways, so that no linked pair falls
between): a rule of cost, the results are the same.

Every index entry says how many shingles of its set stand before it, which the other set lacks if
this is their first common key. What both miss, and the difference of what is still to come, can't
exceed the shingles in which linked sets may differ: entries that no other entry of their key can
link with by that bound are cut first, in time linear in the entries, by the two least of each key.
What is left of each key is held against up to ``LEADERS`` of its entries (one of each hash class,
so that a hot key is aggregated before it is shuffled). Linked sets are components by then, and
only entries of different components of a key can still add a link: the linear cut is made again
against other components, and the pairs that pass the bound are tried. Every candidate pair is
verified on the full sets by two independent hashes of each shingle, so no link is lost and none
is false.

Null and empty texts have empty sets, link with nothing and are their own component; so do rows
of a null id, whose component is null. Rows of one id are one node, and each of their texts links
for it. Texts of any length are one set each; an empty table gives an empty table; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .blocks import Store, blocks_of, cuts_of, expand, grouped, pack_sorted, squeeze, unpack_sorted
from .common import arrow_map, materialize, parallelism, shared_dir, slices, table
from .graph import components

SHINGLE = 3
#: Link if DEN * intersection >= NUM * union.
NUM, DEN = 90, 100
#: A shingle in more documents is frequent (counts stop at 255); slots of the frequency count have so many bits beyond the corpus's size.
FREQUENT, SLOT_BITS = 254, 8
#: Bytes of text in a block (more only where one document has more), and for each range of slots.
BLOCK_BYTES, RANGE_BYTES = 8 << 20, 8 << 20
#: Bits of the filter that keeps scans from making sets that are in no list (4 MB, whatever the input).
FILTER_BITS = 25
BIG, LEADERS = 1000, 8


def needed(n: np.ndarray | int, num: int = NUM, den: int = DEN):
    """The least intersection that a set of n shingles has with any set it links with."""
    return (n * num + den - 1) // den


def document_frequencies(docs: DataFrame, folder: str, k: int, ranges: int, bits: int, block: int = BLOCK_BYTES) -> DataFrame:
    """(block, range, df): in how many documents each distinct shingle slot of a block occurs, in the order of the slots.

    A slot is a shingle hash cut to ``bits`` bits. Blocks send their slots as sorted gaps, by slot
    range, and get back one byte for each (255 and more are alike); the blocks' texts stay in the folder.
    """
    top = max(1, (ranges - 1).bit_length())

    def send(batches):
        from pyspark import TaskContext

        store = Store(folder)
        for n, (ids, texts) in enumerate(blocks_of(batches, block)):
            number = TaskContext.get().partitionId() << 24 | n
            store.put(number, ids, texts)
            yield {"block": [number], "range": [-1], "gaps": [b""], "times": [b""]}  # every block has a row
            slots, times = np.unique(all_slots(texts, k, bits), return_counts=True)
            cuts = cuts_of(slots << np.uint64(64 - bits), top)
            for r in np.flatnonzero(np.diff(cuts)).tolist():
                lo, hi = int(cuts[r]), int(cuts[r + 1])
                yield {"block": [number], "range": [r], "gaps": [pack_sorted(slots[lo:hi])], "times": [squeeze(np.minimum(times[lo:hi], 255).astype(np.uint8))]}

    def add(batches):
        for r, rows in grouped(batches, "range", ("block", "gaps", "times")):
            if r < 0:
                yield {"block": [x[0] for x in rows], "range": [-1] * len(rows), "df": [None] * len(rows)}
                continue
            slots = [unpack_sorted(x[1]) for x in rows]
            _, index = np.unique(np.concatenate(slots), return_inverse=True)
            total = np.minimum(np.bincount(index, weights=np.concatenate([expand(x[2], np.uint8) for x in rows])), 255).astype(np.uint8)[index]
            at = 0
            for x, own in zip(rows, slots, strict=True):
                yield {"block": [x[0]], "range": [r], "df": [squeeze(total[at : at + len(own)])]}
                at += len(own)

    sent = arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), send, "block long, range int, gaps binary, times binary")
    dealt = sent.repartition(ranges, F.when(F.col("range") < 0, -F.col("block")).otherwise(F.col("range"))).sortWithinPartitions("range", "block")
    return arrow_map(dealt, add, "block long, range int, df binary")


def all_slots(texts: list[bytes], k: int, bits: int) -> np.ndarray:
    """The slots of all documents' sets, one document after the other."""
    out = [np.empty(0, np.uint64)]
    for part in _portions(texts):
        out += K.shingle_sets(part, k)
    return np.concatenate(out) >> np.uint64(64 - bits)


def _portions(texts: list[bytes], most: int = 1 << 20):
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > most:
            yield texts[start:i]
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield texts[start:]


def index_entries(s: np.ndarray, df: np.ndarray, num: int = NUM, den: int = DEN) -> tuple[np.ndarray, np.ndarray]:
    """(keys, misses) of a sorted set: its index keys and, for each, how many of its shingles a set lacks that has it as the first common key."""
    n = len(s)
    if n < 2:  # a set of one shingle links with its equals only
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    miss = n - needed(n, num, den)
    # one order for all documents: by frequency, then by the hash (s is sorted and the sort is stable)
    order = np.argsort(df, kind="stable")[: miss + 2]
    s, df = s[order], df[order]
    rare = int(np.searchsorted(df[: miss + 1], FREQUENT, "right"))
    alone = int(np.searchsorted(df[:rare], 1, "right"))  # what is in one document only is in no other set
    keys, misses = [s[alone:rare]], [np.arange(alone, rare)]
    left = miss + 1 - rare
    if left > 0:
        often = s[rare:]
        if n >= BIG * num // den:
            keys.append(often[:left])
            misses.append(np.arange(rare, rare + left))
        if n <= BIG:
            i, j = np.triu_indices(len(often), 1)
            with np.errstate(over="ignore"):
                keys.append(K.mix(K.mix(often[i] + np.uint64(7)) + often[j]))
            misses.append(rare + j - 1)
    return np.concatenate(keys), np.concatenate(misses).astype(np.int32)


def shingle_classes(frequencies: DataFrame, folder: str, k: int, bits: int, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n, free (shingles that others hold too), sig (digest of the set), keys and misses (the prefix's index entries, packed) of every document of the blocks."""

    def run(batches):
        store = Store(folder)
        for number, rows in grouped(batches, "block", ("range", "df")):
            ids, texts = store.get(number)
            slots, index = np.unique(all_slots(texts, k, bits), return_inverse=True)
            df = np.concatenate([np.empty(0, np.uint8)] + [expand(x, np.uint8) for r, x in rows if r >= 0])
            if len(df) != len(slots):
                raise RuntimeError("a block and its answers don't belong together")
            df, at, start = df[index], 0, 0
            del slots, index
            for part in _portions(texts):
                n, free, sig, keys, misses = [], [], [], [], []
                for s in K.shingle_sets(part, k):
                    own = df[at : at + len(s)]
                    entries = index_entries(s, own, num, den)
                    n.append(len(s))
                    free.append(int((own > 1).sum()))
                    sig.append(digest(s))
                    keys.append(entries[0].tobytes())
                    misses.append(entries[1].tobytes())
                    at += len(s)
                yield {"doc_id": ids[start : start + len(part)], "n": n, "free": free, "sig": sig, "keys": keys, "misses": misses}
                start += len(part)

    by_block = frequencies.repartition("block").sortWithinPartitions("block", "range").select("block", "range", "df")
    return arrow_map(by_block, run, "doc_id long, n int, free int, sig binary, keys binary, misses binary")


def digest(s: np.ndarray) -> bytes | None:
    """What equal sets share; None for the empty set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def postings(reps: DataFrame) -> DataFrame:
    """(key, doc, tag, n, free, miss) for every index entry of every representative."""

    def run(batches):
        for b in batches:
            docs, tags, sizes, free = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tag", "n", "free"))
            keys = [np.frombuffer(x, np.int64) for x in b.column("keys").to_pylist()]
            misses = [np.frombuffer(x, np.int32) for x in b.column("misses").to_pylist()]
            at = 0
            while at < len(keys):  # a bounded number of keys at a time
                end, total = at, 0
                while end < len(keys) and (end == at or total + len(keys[end]) <= 500_000):
                    total += len(keys[end])
                    end += 1
                count = [len(x) for x in keys[at:end]]
                yield {"key": np.concatenate(keys[at:end]), "doc": np.repeat(docs[at:end], count), "tag": np.repeat(tags[at:end], count), "n": np.repeat(sizes[at:end], count), "free": np.repeat(free[at:end], count), "miss": np.concatenate(misses[at:end])}
                at = end

    return arrow_map(reps.select("doc", "tag", "n", "free", "keys", "misses"), run, "key long, doc long, tag long, n int, free int, miss int")


def within(x: str, y: str, num: int, den: int) -> str:
    """The exact bound on two entries of a key: what both lack before it and the difference of what follows fit into linked sets' difference."""
    return f"{den + num} * ({x}.miss + {y}.miss + abs(({x}.n - {x}.miss) - ({y}.n - {y}.miss))) <= {den - num} * ({x}.n + {y}.n)"


def cut(entries: DataFrame, node: str, num: int, den: int) -> DataFrame:
    """The entries whose key has an entry of another node that the bound allows: an entry's part of the bound against the least part of the others'.

    Only the two least parts of each key are needed, which are cut down before they are shuffled.
    Where both are of the entry's own node (two texts of one id) the least stands for the others:
    fewer are cut, never more.
    """
    part = f"cast({den + num} as long) * miss - cast({den - num} as long) * n"
    parts = entries.select("key", node, F.expr(part).alias("p"))
    if node != "doc":  # many entries of a node in a key
        parts = parts.groupBy("key", node).agg(F.min("p").alias("p"))
    ranked = parts.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("p", node))).where("r <= 2")
    least = ranked.groupBy("key").agg(F.min(F.struct("p", node)).alias("u"), F.max(F.struct("p", node)).alias("v"), F.count("*").alias("c")).where("c = 2").select("key", F.col("u.p").alias("up"), F.col(f"u.{node}").alias("un"), F.col("v.p").alias("vp"), F.col(f"v.{node}").alias("vn"))
    other = f"case when un <> {node} then up when vn <> {node} then vp else up end"
    return entries.join(materialize(least), "key").where(f"{part} + ({other}) <= 0").select(entries.columns)


def pairs_of(x: DataFrame, y: DataFrame, apart: str, num: int, den: int) -> DataFrame:
    """(a, ta, b, tb), a < b: the distinct pairs of entries of x and y that share a key, differ in the column ``apart`` and pass the bound."""
    first = F.expr("x.doc < y.doc")
    met = x.alias("x").join(y.alias("y"), "key").where(f"x.doc <> y.doc and x.{apart} <> y.{apart} and {within('x', 'y', num, den)}")
    return met.select(F.least("x.doc", "y.doc").alias("a"), F.when(first, F.col("x.tag")).otherwise(F.col("y.tag")).alias("ta"), F.greatest("x.doc", "y.doc").alias("b"), F.when(first, F.col("y.tag")).otherwise(F.col("x.tag")).alias("tb")).distinct()


def id_filter(ids: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit array of fixed size with a bit for each id; ids that aren't there may share a bit."""
    slot = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(1 << bits))
    words = ids.select(slot.alias("s")).groupBy(F.shiftright("s", 5).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 32 as int))")).alias("b"))
    out = np.zeros(1 << (bits - 5), np.uint32)
    got = words.toArrow()  # at most 2^(bits-5) rows of 12 bytes
    out[got.column("w").to_numpy()] = got.column("b").to_numpy().astype(np.uint32)
    return out


def sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(doc, tag, shingles) of every text of the documents whose ids are listed (column doc) and of few others, made again from their texts."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(id_filter(ids, "doc"))

    def run(batches):
        have = bits.value
        size = np.int64(len(have) * 32 - 1)
        for whole in batches:
            slot = whole.column("h").to_numpy(zero_copy_only=False) & size
            keep = (have[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1
            part = whole.filter(pa.array(keep.astype(bool)))
            for b in slices(part, "text", 1 << 20):
                texts = b.column("text").to_pylist()
                yield {"doc": b.column("doc"), "sig": [digest(x) for x in K.shingle_sets(texts, k)], "shingles": [x.tobytes() for x in K.wide_sets(texts, k)]}

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), "text", F.xxhash64(F.col("doc_id").cast("long")).alias("h"))
    return arrow_map(rows, run, "doc long, sig binary, shingles binary").select("doc", F.xxhash64("sig").alias("tag"), "shingles").dropDuplicates(["doc", "tag"])


def verify(pairs: DataFrame, sets: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """The pairs (a, b) whose sets (of tags ta, tb) link, with their intersection and union."""
    joined = pairs.join(sets.select(F.col("doc").alias("a"), F.col("tag").alias("ta"), F.col("shingles").alias("x")), ["a", "ta"])
    joined = joined.join(sets.select(F.col("doc").alias("b"), F.col("tag").alias("tb"), F.col("shingles").alias("y")), ["b", "tb"])

    def run(batches):
        for b in batches:
            out = {"a": [], "b": [], "both": [], "either": []}
            for a, c, x, y in zip(*(b.column(n).to_pylist() for n in ("a", "b", "x", "y")), strict=True):
                x, y = (np.frombuffer(s, np.uint64).reshape(-1, 2) for s in (x, y))
                both = K.shared(x, y)
                either = len(x) + len(y) - both
                if both and den * both >= num * either:
                    for name, value in zip(out, (a, c, both, either), strict=True):
                        out[name].append(value)
            yield out

    return arrow_map(joined.select("a", "b", "x", "y"), run, "a long, b long, both long, either long")


def jaccard_classes(docs: DataFrame, k: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b
    ranges = 1 << (max(4, parallelism(spark), size // RANGE_BYTES) - 1).bit_length()
    bits = min(62, SLOT_BITS + int(size // 4 + 1).bit_length())  # a few hundred slots for each shingle of the corpus
    folder = shared_dir(spark)
    frequencies = materialize(document_frequencies(docs, folder, k, ranges, bits))
    rows = materialize(shingle_classes(frequencies, folder, k, bits, num, den))
    classes = (
        rows.where("sig is not null and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("doc"), F.count("*").alias("rows"), *(F.first(c).alias(c) for c in ("n", "free", "keys", "misses")))
    )
    # a class goes by its smallest id, and by a tag of its set as rows of one id may differ in text
    classes = materialize(classes.withColumn("tag", F.xxhash64("sig")))
    posted = materialize(postings(classes.where("n > 1")))
    entries = materialize(cut(posted, "doc", num, den))
    # leaders: of each hash class of a key the most central set, with the most shingles that others
    # hold, so that the keys of one group mostly share theirs
    best = F.max(F.struct("free", F.xxhash64("doc").alias("h"), "doc", "tag", "n", "miss")).alias("s")
    leaders = materialize(entries.groupBy("key", F.pmod(F.xxhash64("doc"), F.lit(LEADERS)).alias("class")).agg(best).select("key", "s.doc", "s.tag", "s.n", "s.miss"))
    pairs = materialize(pairs_of(entries, leaders, "doc", num, den))
    sets = materialize(sets_of(docs, entries.select("doc").distinct(), k))
    links = materialize(verify(pairs, sets, num, den))
    # rows of one class link with its representative, and rows of one id are one node
    own = rows.select("doc_id", "n", "sig").join(classes.where("rows > 1").select("sig", F.col("doc").alias("rep")), "sig", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    same = own.where("rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(links.select("a", "b").union(same))
    # only sets of different components can still add a link
    labelled = entries.join(found.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", "tag", "n", "miss", F.coalesce("component", "doc").alias("component"))
    split = materialize(labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key"))
    rest = materialize(cut(labelled.join(split, "key", "left_semi"), "component", num, den))
    # of two entries of different components one at least isn't in the key's largest component
    largest = rest.groupBy("key", "component").count().groupBy("key").agg(F.max(F.struct("count", "component")).alias("s")).select("key", F.col("s.component").alias("most"))
    others = rest.join(materialize(largest), "key").where("component <> most").drop("most")
    more = materialize(verify(pairs_of(others, rest, "component", num, den), sets, num, den))
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more.select("a", "b")))
    return own.join(found, own.doc_id == found.node, "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


_TOKENS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""
ORACLE_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda j: w[j] || ' ' || w[j + 1] || ' ' || w[j + 2]) END) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n AS na ON na.doc_id = p.a JOIN n AS nb ON nb.doc_id = p.b WHERE 100 * k >= 90 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT node, min(other) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id
"""
