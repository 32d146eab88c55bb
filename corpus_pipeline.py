"""Training-data pipeline: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns the columns of ``documents`` (doc_id, text,
lang, source, n_chars; whatever columns docs has), but the last, which returns the token ids.
The tables are: quality labels and benchmark items of ``sf_dir``. Each stage's input is written
as Parquet and read again, so a lost executor repeats one stage's tasks only.

Nulls, empty texts, repeated rows and empty tables are treated as each operator says; every filter
judges a row by its own text, also where its id is null or other rows have it. Further columns pass
every stage but the last untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, decontaminate, jaccard, quality, secrets
from tessella.llm.common import materialize, table

#: A document goes if its score is below this.
QUALITY = 0.3


def own_key(docs: DataFrame) -> str:
    """A name for the rows' own keys inside a stage that no column of docs has, in whatever case."""
    taken, name = {c.lower() for c in docs.columns}, "_row_key"
    while name in taken:
        name += "_"
    return name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quadratic discriminant, learnt from the labelled rows among docs, doesn't reject."""
    x = materialize(quality.features(docs))
    model = quality.fit(x, table(spark, sf_dir, "labels"))
    return quality.keep(docs, model, QUALITY)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents (five-word shingles, Jaccard 0.8) the one with the smallest id.

    Where ids are null or repeated every row gets a key of its own, so each is judged by its own
    text: of linked rows the smallest by id (null ids last), then digest of the text, stays.
    """
    ids = docs.groupBy("doc_id").count()
    if ids.where("doc_id is null or count > 1").isEmpty():
        classes = jaccard.jaccard_classes(docs, k=5, num=80, den=100)
        gone = classes.where("component_id <> doc_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    key = own_key(docs)
    rows = materialize(docs.withColumn(key, F.monotonically_increasing_id()))
    classes = jaccard.jaccard_classes(rows.select(F.col(key).alias("doc_id"), "text"), k=5, num=80, den=100).select(F.col("doc_id").alias(key), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "digest", key)
    linked = classes.join(classes.where(f"component_id <> {key}").select("component_id").distinct(), "component_id", "left_semi")
    linked = linked.join(rows.select(key, "doc_id", F.sha1(F.col("text").cast("binary")).alias("digest")), key)
    first = linked.groupBy("component_id").agg(F.min(order)[key].alias(key))
    gone = linked.select(key).join(first, key, "left_anti")
    return rows.join(gone, key, "left_anti").select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no benchmark item, each judged by its own text, whatever its id."""
    ids = docs.groupBy("doc_id").count()
    unique = ids.where("doc_id is null or count > 1").isEmpty()
    key = own_key(docs)
    rows = docs.withColumn(key, F.col("doc_id")) if unique else materialize(docs.withColumn(key, F.monotonically_increasing_id()))
    found = decontaminate.contained_items(rows.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return rows.join(found.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with every secret span of their texts replaced by a mark; n_chars follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns) if "n_chars" in docs.columns else clean


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of their decoding, for every row left."""
    return bpe.round_trip(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("BPE encoding and decoding", tokens_stage),
]
#: SQL can't express the classifier, the guess costs or the tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs = materialize(docs)
    return docs
