"""How far sources of a language drift apart, by term frequencies (operator 13).

Tasks count terms of whole texts by (lang, source) and send partial counts to shards, which are
hashes of language and term, so that everything about a term is in one shard. Each shard is counted
by vectorised SQL in DuckDB: terms in too few documents go, the rest keep one row a source. Spark
adds up the groups' totals; a second SQL pass in each shard then yields partial pair sums and the best
terms of its own, and Spark merges sums and rankings.

With p(g, t) = 1 + floor(SCALE (count + 1) / (N + V)) and f(p, q) = floor((p - q)^2 / q), the sum over all
V terms of a language is taken apart by inclusion and exclusion: V f(p0, q0) for terms that neither
source has, a correction for the terms of one (from the histogram of its counts, not from terms), and
one for terms that both have, which is the only one that needs pairs, of sources that share a term,
within a shard. So no vector of zeros is ever made. Integers are exact: 128 bits in DuckDB, 38 digits in Spark.

Counts travel as Arrow tables, one a task's portion and shard, not as rows, so that little but bytes passes
through Spark's own row formats. Shards are of bounded text, so their number grows with it; a portion
sends each shard one table at most, and in the worst case (terms that never repeat) a row is a table.

Null text, lang and source read as ''. Texts of any length are counted whole; ties rank by item in
UTF-8 order; repeated rows count each (as documents, too); a group without terms has a total of 0 and
pairs with all others of its language; a language without kept terms has pair values of 0. An empty
table gives an empty table; columns of other names are ignored.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow.fs import FileSelector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import dump, expand, load, squeeze
from .common import arrow_map, materialize, shared_dir, slices, table
from .warc import _filesystem

LEAST_DOCUMENTS, TOP, SCALE = 3, 200, 1_000_000_000
#: A-Z in lower case; letters and all bytes from 0x80 on stay; the rest parts terms.
_TERM = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Partial counts that a task holds before it sends them (a bound on memory: the shards add them up).
HELD = 250_000
#: Bytes of text whose terms one shard gets on average.
SHARD_BYTES = 16 << 20
#: Rows of one Arrow table of counts.
ROWS = 100_000
#: Pairs of sources that a shard holds sums of at once.
MOST_PAIRS = 250_000
_EXACT = "decimal(38,0)"
#: A document, added to the occurrences of its terms, so that one integer counts both.
_DOCUMENT = 1 << 40


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and characters from U+0080 on, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM).split()


def partial_counts(docs: DataFrame, shards: int) -> DataFrame:
    """shard, counts: tables of lang, source, term, n (occurrences), docs (documents), added up within a task's portions of the rows."""

    def tables(held):
        rows = [(lang, source, t, c) for (lang, source), mine in held.items() for t, c in mine.items()]
        if not rows:
            return
        lang, source, term, both = zip(*rows, strict=True)
        both = np.array(both, np.int64)
        seeds = {x: xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in set(lang)}
        shard = np.array([xxhash.xxh3_64_intdigest(t, seed=seeds[x]) % shards for x, t in zip(lang, term, strict=True)], np.int64)
        order = np.argsort(shard, kind="stable")
        columns = {"lang": pa.array(lang), "source": pa.array(source), "term": pa.array(term, pa.binary()).cast(pa.string()), "n": pa.array(both % _DOCUMENT), "docs": pa.array(both // _DOCUMENT)}
        whole = pa.record_batch(list(columns.values()), names=list(columns)).take(pa.array(order))
        bounds = np.flatnonzero(np.diff(shard[order], prepend=-1, append=shards))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield {"shard": [int(shard[order[a]])], "counts": [squeeze(dump(dict(zip(columns, whole.slice(a, b - a).columns, strict=True))))]}

    def run(batches):
        held: dict[tuple[str, str], dict[bytes, int]] = {}
        size = seen = 0
        for whole in batches:
            for b in slices(whole, "text"):
                for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                    mine = held.setdefault((lang, source), {})
                    before, get = len(mine), mine.get
                    for t, n in Counter(terms(text)).items():
                        mine[t] = get(t, 0) + n + _DOCUMENT
                    size, seen = size + len(mine) - before, seen + 1
                    if size > HELD or seen >= 1 << 20:
                        yield from tables(held)
                        held, size, seen = {}, 0, 0
        yield from tables(held)

    return arrow_map(named(docs), run, "shard int, counts binary")


def named(docs: DataFrame) -> DataFrame:
    """lang, source ('' for null) and text."""
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), "text")


_COUNT = """
CREATE TABLE kept AS SELECT lang, source, term, n, row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AS lead
FROM (SELECT lang, term, source, CAST(sum(n) AS BIGINT) AS n, sum(sum(docs)) OVER (PARTITION BY lang, term) AS d FROM part GROUP BY lang, term, source)
WHERE d >= {least}
"""

_HISTOGRAM = "SELECT lang, source, n, count(*) AS k, count(*) FILTER (lead) AS leads FROM kept GROUP BY lang, source, n"

_SCORE = """
CREATE TABLE r AS SELECT lang, term, source, n, p0, lang_total, terms,
  CAST(1 + ({scale}::HUGEINT * (n + 1)) // (total + terms) AS BIGINT) AS p FROM part JOIN groups USING (lang, source)
"""

_TERMS = """
SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS VARCHAR) AS value FROM (
  SELECT *, CAST(1 + ({scale}::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 1)) // (lang_total + terms) AS BIGINT) AS q FROM r
) WHERE p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) // q DESC, term) <= {top}
"""

#: f of both, less what the histograms add for each of the two, plus what neither's share took twice.
_PAIRS = """
SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(sum(
  CAST((a.p - b.p) * (a.p - b.p) // b.p AS HUGEINT) - (a.p - b.p0) * (a.p - b.p0) // b.p0
  - (a.p0 - b.p) * (a.p0 - b.p) // b.p + (a.p0 - b.p0) * (a.p0 - b.p0) // b.p0) AS VARCHAR) AS value
FROM r a JOIN r b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
WHERE hash(a.source) % {blocks} = {block} GROUP BY a.lang, a.source, b.source
"""


def _shard(batches, columns: str):
    """A DuckDB connection of one thread and bounded memory, whose table ``part`` holds the counts of the shard's tables."""
    import duckdb

    db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": "", "preserve_insertion_order": "false"})
    db.execute(f"CREATE TABLE part ({columns})")
    for b in batches:
        for data in b.column("counts"):
            db.register("chunk", pa.Table.from_batches([load(expand(data.as_py()))]))
            db.execute("INSERT INTO part BY NAME SELECT * FROM chunk")
            db.unregister("chunk")
    return db


def _results(db, sql: str):
    for b in db.execute(sql).to_arrow_reader(ROWS):
        yield {n: b.column(n) for n in b.schema.names}


def shard_counts(partial: DataFrame, shards: int, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """Of every shard the counts of terms in at least ``least`` documents of the language, as tables of lang, source, term, n
    (shard, counts), and their histogram: lang, source, n, k terms with n occurrences, of which ``leads`` are the first of their term."""

    def run(batches):
        none = lambda **x: {"shard": None, "counts": None, "lang": None, "source": None, "n": None, "k": None, "leads": None} | x
        first = next(batches, None)
        if first is None:
            return
        number = first.column("shard")[0].as_py()
        with _shard(chain([first], batches), "lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT") as db:
            db.execute(_COUNT.format(least=least))
            for x in _results(db, "SELECT lang, source, term, n FROM kept"):
                yield none(**{k: [None] for k in ("lang", "source", "n", "k", "leads")}, shard=[number], counts=[squeeze(dump(x))])
            for x in _results(db, _HISTOGRAM):
                size = len(x["n"])
                yield none(**x | {"shard": [number] * size, "counts": [None] * size})

    dealt = partial.repartitionById(shards, "shard")
    return arrow_map(dealt, run, "shard int, counts binary, lang string, source string, n long, k long, leads long")


def _share(n: str, scale: int) -> Column:
    """p of a term with n occurrences in a group: 1 + floor(scale (n + 1) / (total + terms)), exactly; null without kept terms."""
    return F.expr(f"CASE WHEN terms > 0 THEN 1 + (CAST({scale} AS DECIMAL(19,0)) * CAST({n} + 1 AS DECIMAL(19,0))) div CAST(total + terms AS DECIMAL(38,0)) END")


def group_totals(docs: DataFrame, histogram: DataFrame, scale: int = SCALE) -> DataFrame:
    """Per (lang, source): total (of its kept terms), terms (V of the language), lang_total, p0 (p of a term that it has not; null if V is 0)."""
    groups = named(docs).select("lang", "source").distinct()
    own = histogram.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("k")).alias("total"), F.sum("leads").alias("leads"))
    every = groups.join(own, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("leads", F.lit(0)).alias("leads"))
    langs = every.groupBy("lang").agg(F.sum("leads").alias("terms"), F.sum("total").alias("lang_total"))
    return every.join(langs, "lang").select("lang", "source", "total", "terms", "lang_total").withColumn("p0", _share("0", scale))


def shard_sums(counts: DataFrame, groups: str, shards: int, blocks: int, scale: int = SCALE, top: int = TOP) -> DataFrame:
    """Of every shard: lang, source, part, item, value (decimal): its best terms of each group, and its partial sums of pairs that share terms.

    ``groups`` is the folder of the groups' totals; tasks read it from there, a file at a time, and keep the languages they have.
    """

    def run(batches):
        import pyarrow.parquet as pq

        with _shard(batches, "lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT") as db:
            db.execute("CREATE TABLE groups (lang VARCHAR, source VARCHAR, total BIGINT, terms BIGINT, lang_total BIGINT, p0 BIGINT)")
            db.execute("CREATE TABLE langs AS SELECT DISTINCT lang FROM part")
            filesystem, root = _filesystem(groups)
            for x in filesystem.get_file_info(FileSelector(root)):
                if x.base_name.endswith(".parquet"):
                    db.register("chunk", pq.read_table(x.path, filesystem=filesystem))
                    db.execute("INSERT INTO groups BY NAME SELECT * FROM chunk WHERE lang IN (SELECT lang FROM langs)")
                    db.unregister("chunk")
            db.execute(_SCORE.format(scale=scale))
            db.execute("DROP TABLE part")
            yield from _results(db, _TERMS.format(scale=scale, top=top))
            for block in range(blocks):  # sums of some pairs at a time, so that memory doesn't grow with the square of the sources
                yield from _results(db, _PAIRS.format(blocks=blocks, block=block))

    dealt = counts.where("counts is not null").select("shard", "counts").repartitionById(shards, "shard")
    out = arrow_map(dealt, run, "lang string, source string, part string, item string, value string")
    return out.withColumn("value", F.col("value").cast(_EXACT))


def apart(histogram: DataFrame, groups: DataFrame, scale: int = SCALE) -> DataFrame:
    """lang, source, item, value: every pair's sum over all V terms as if none were shared, from the groups' histograms of counts."""
    f = lambda p, q: f"CAST(({p} - {q}) * ({p} - {q}) div {q} AS DECIMAL(38,0))"
    own = histogram.groupBy("lang", "source", "n").agg(F.sum("k").alias("k")).join(groups, ["lang", "source"]).withColumn("p", _share("n", scale))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    met = own.select("lang", "source", "k", "p", "p0").join(other, "lang").where("source <> item")
    one = met.select("lang", "source", "item", F.expr(f"CAST(k AS DECIMAL(38,0)) * ({f('p', 'q0')} - {f('p0', 'q0')})").cast(_EXACT).alias("value"))
    two = met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.expr(f"CAST(k AS DECIMAL(38,0)) * ({f('q0', 'p')} - {f('q0', 'p0')})").cast(_EXACT).alias("value"))
    base = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", F.expr(f"coalesce(CAST(terms AS DECIMAL(38,0)) * {f('p0', 'q0')}, 0)").cast(_EXACT).alias("value"))
    return base.unionByName(one).unionByName(two)


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, scale: int = SCALE, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank of documents (lang, source, text), as the module says."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b
    shards = max(1, -(-size // SHARD_BYTES))
    counts = materialize(shard_counts(partial_counts(docs, shards), shards, least))
    histogram = counts.where("counts is null").select("lang", "source", "n", "k", "leads")
    folder = shared_dir(docs.sparkSession)
    group_totals(docs, histogram, scale).write.parquet(folder)
    groups = docs.sparkSession.read.parquet(folder)
    pairs = groups.groupBy("lang").count().agg(F.coalesce(F.sum(F.col("count") * F.col("count")), F.lit(0)).alias("n")).first().n
    sums = materialize(shard_sums(counts, folder, shards, max(1, -(-pairs // MOST_PAIRS)), scale, top))
    pairs = apart(histogram, groups, scale).unionByName(sums.where("part = 'pair'").drop("part"))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value")).withColumn("part", F.lit("pair"))
    best = sums.where("part = 'term'").withColumn("value", F.col("value").cast("long"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ("lang", "source", "part", "item", "value", "rank")
    ranked = pairs.withColumn("rank", F.row_number().over(w)).select(*columns)
    return ranked.unionByName(best.withColumn("rank", F.row_number().over(w)).where(f"rank <= {top}").select(*columns))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


#: Every vector written out with its zeros, and all pairs of them.
ORACLE_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
), w AS MATERIALIZED (SELECT lang, source, id, unnest(t) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 3),
c AS MATERIALIZED (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS MATERIALIZED (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY ALL) USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source)
), x AS MATERIALIZED (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (total + v) AS p
  FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(total) + any_value(v)) AS q
  FROM c JOIN (SELECT lang, any_value(v) AS v, sum(total) AS total FROM g GROUP BY lang) USING (lang) GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(any_value(s), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT y.lang, y.source, z.source AS item, sum((y.p - z.p) * (y.p - z.p) // z.p) AS s
    FROM x y JOIN x z ON y.lang = z.lang AND y.term = z.term AND y.source <> z.source GROUP BY ALL
  ) t ON t.lang = a.lang AND t.source = a.source AND t.item = b.source
  GROUP BY ALL
), best AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM x JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM best)
) WHERE part = 'pair' OR rank <= 200
"""
