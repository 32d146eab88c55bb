"""Provider datasets: captured items kept as pages, and a data source that reads only the pages a query's bounds leave.

``publish`` lays items out by account, newest first, in files of JSON lines with two tables beside
them: ``pages`` (account, positions, dates and byte range of each page) and ``parts`` (what each file
spans). The source ``provider_items`` takes what a capture request may bound through pushed filters: accounts
(=, in), the number of posts of an account (position <= n), and oldest and newest dates (created_at). The
driver leaves out parts by their spans, tasks leave out pages by theirs, and what remains is
filtered item by item, so Spark has nothing to filter again. Positions count per account from 1, over all
its items, so a limit by position keeps the newest.

Null accounts and dates are kept: null dates come last; a filter on a null value keeps nothing. Ties of
dates are ordered by the item's text. An empty dataset has no parts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from ..session import settle
from .files import arrow, opened

FORMAT = "provider_items"
SCHEMA = "account string, position long, created_at string, item string"
PAGES = "part long, page long, file string, offset long, length long, account string, seq long, n long, newest string, oldest string"
#: Items of a page, and bytes of a data file.
PAGE_ITEMS, PART_BYTES = 500, 64 << 20
_KINDS = {EqualTo: "=", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", IsNotNull: "filled"}
_TAKEN = {"account": {"=", "in", "filled"}, "position": {"=", "in", ">", ">=", "<", "<=", "filled"}, "created_at": {"=", "in", ">", ">=", "<", "<=", "filled"}}


def publish(items: DataFrame, folder: str, page_items: int = PAGE_ITEMS, part_bytes: int = PART_BYTES) -> None:
    """Write (account, created_at, item) rows as a provider dataset. One shuffle, by ranges of account and date, so that a large account fills several files."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("item") + 32), F.lit(0)).alias("n")).first().n
    order = [F.asc_nulls_first("account"), F.desc_nulls_last("created_at"), F.asc_nulls_first("item")]

    def run(batches):
        from pyspark import TaskContext

        filesystem, root = opened(folder)
        filesystem.create_dir(root, recursive=True)
        part, page, at, out = TaskContext.get().partitionId(), 0, 0, None
        name = f"{part:06d}-{uuid.uuid4().hex}.jsonl"
        held: list[tuple] = []
        seq: dict = {}

        def flush():
            nonlocal page, at, out
            if out is None:
                out = filesystem.open_output_stream(f"{root}/{name}", compression=None)
            data = b"".join(json.dumps(x, ensure_ascii=False).encode("utf-8", "surrogatepass") + b"\n" for x in held)
            out.write(data)
            account, dates = held[0][0], [d for _, d, _ in held]
            filled = [d for d in dates if d is not None]
            first = seq.get(account, 0)
            seq.clear()  # accounts come in order
            seq[account] = first + len(held)
            row = (part, page, name, at, len(data), account, first, len(held), max(filled, default=None), min(filled, default=None) if len(filled) == len(dates) else None)
            page, at = page + 1, at + len(data)
            held.clear()
            return dict(zip([c.split(" ")[0] for c in PAGES.split(", ")], ([v] for v in row), strict=True))

        try:
            for b in batches:
                for row in zip(*(b.column(c).to_pylist() for c in ("account", "created_at", "item")), strict=True):
                    if held and (row[0] != held[0][0] or len(held) >= page_items):
                        yield flush()
                    held.append(row)
            if held:
                yield flush()
        finally:
            if out is not None:
                out.close()

    dealt = items.select("account", F.col("created_at").cast("string"), "item").repartitionByRange(max(1, -(-size // part_bytes)), *order).sortWithinPartitions(*order)
    raw = settle(arrow(dealt, run, PAGES))
    # an account's items in the parts before: a row an account and part
    own = raw.groupBy("part", "account").agg(F.sum("n").alias("m"))
    before = own.select("part", F.col("account").alias("a"), F.coalesce(F.sum("m").over(Window.partitionBy("account").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    pages = raw.join(before.withColumnRenamed("part", "p"), (F.col("part") == F.col("p")) & F.col("account").eqNullSafe(F.col("a")))
    pages = pages.withColumn("position", F.col("before") + F.col("seq") + 1).select("part", "page", "file", "offset", "length", "account", "position", "n", "newest", "oldest")
    pages.repartition("part").sortWithinPartitions("part", "page").write.partitionBy("part").parquet(f"{folder}/pages")
    spans = pages.groupBy("part").agg(
        F.min("account").alias("account_from"), F.max("account").alias("account_to"), F.max("newest").alias("newest"), F.min("oldest").alias("oldest"), F.count_if(F.col("oldest").isNull()).alias("undated"),
        F.min("position").alias("position_from"), F.max(F.col("position") + F.col("n") - 1).alias("position_to"),
    )
    spans.coalesce(1).write.parquet(f"{folder}/parts")  # a row a data file


class _Part(InputPartition):
    def __init__(self, part: int):
        super().__init__(part)
        self.part = part


def _parquet(folder: str) -> pa.Table | None:
    import pyarrow.parquet as pq
    from pyarrow import fs

    filesystem, root = opened(folder)
    files = sorted(f.path for f in filesystem.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.endswith(".parquet"))
    tables = [pq.ParquetFile(filesystem.open_input_file(f)).read() for f in files]
    return pa.concat_tables(tables) if tables else None


def _spans(low, high, kind: str, value) -> bool:
    """May values from low to high (either null: unbounded) hold one that passes?"""
    if kind == "in":
        return any(_spans(low, high, "=", v) for v in value)
    if kind == "filled" or value is None:
        return kind == "filled"
    return not ((kind in ("=", "<", "<=") and low is not None and (low > value or (kind == "<" and low == value))) or (kind in ("=", ">", ">=") and high is not None and (high < value or (kind == ">" and high == value))))


class ProviderReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.bounds = folder, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            kind, column = _KINDS.get(type(f)), ".".join(f.attribute) if hasattr(f, "attribute") else ""
            value = getattr(f, "value", None)
            if kind in _TAKEN.get(column, ()):
                self.bounds.append((column, kind, list(value) if kind == "in" else value))
            else:
                yield f

    def _left(self, row: dict) -> bool:
        """May a part or page with these spans hold an item that passes every bound?"""
        spans = {"account": (row["account_from"], row["account_to"]), "position": (row["position_from"], row["position_to"]), "created_at": (row["oldest"], row["newest"])}
        return all(_spans(*spans[c], kind, value) for c, kind, value in self.bounds)

    def partitions(self) -> list[InputPartition]:
        parts = _parquet(f"{self.folder}/parts")
        return [_Part(r["part"]) for r in (parts.sort_by("part").to_pylist() if parts is not None else []) if self._left(r)] or [_Part(-1)]

    def pages(self, part: int) -> list[dict]:
        """The pages of a part that its bounds leave, in order."""
        found = _parquet(f"{self.folder}/pages/part={part}") if part >= 0 else None
        if found is None:
            return []
        rows = (r | {"account_from": r["account"], "account_to": r["account"], "position_from": r["position"], "position_to": r["position"] + r["n"] - 1} for r in found.sort_by("page").to_pylist())
        return [r for r in rows if self._left(r)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        filesystem, root = opened(self.folder)
        schema = pa.schema([("account", pa.string()), ("position", pa.int64()), ("created_at", pa.string()), ("item", pa.string())])
        source = name = None
        for r in self.pages(partition.part):
            if r["file"] != name:
                name, source = r["file"], filesystem.open_input_file(f"{root}/{r['file']}")
            rows = [json.loads(x) for x in source.read_at(r["length"], r["offset"]).splitlines() if x]
            columns = [[x[0] for x in rows], list(range(r["position"], r["position"] + len(rows))), [x[1] for x in rows], [x[2] for x in rows]]
            yield self._filtered(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))

    def _filtered(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        tests = {"=": pc.equal, ">": pc.greater, ">=": pc.greater_equal, "<": pc.less, "<=": pc.less_equal}
        for column, kind, value in self.bounds:
            c = batch.column(column)
            if kind == "filled":
                keep = pc.is_valid(c)
            elif kind == "in":
                keep = pc.is_in(c, pa.array([v for v in value if v is not None], c.type))
            else:
                keep = tests[kind](c, pa.scalar(value, c.type))
            batch = batch.filter(keep)  # null keeps nothing
        return batch


class ProviderItems(DataSource):
    """Options: path, the dataset's folder."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ProviderReader:
        return ProviderReader(self.options["path"])


def items(spark: SparkSession, folder: str) -> DataFrame:
    """(account, position, created_at, item) of a provider dataset; filters on the first three reach the pages."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ProviderItems)
    return spark.read.format(FORMAT).load(folder)


def requested(rows: DataFrame, accounts: list[str] | None = None, max_posts: int | None = None, oldest: str | None = None, newest: str | None = None) -> DataFrame:
    """A capture request's bounds as predicates: handles, posts of each, oldest and newest date (all inclusive, each optional)."""
    if accounts is not None:
        rows = rows.where(F.col("account").isin(accounts))
    if max_posts is not None:
        rows = rows.where(F.col("position") <= max_posts)
    if oldest is not None:
        rows = rows.where(F.col("created_at") >= oldest)
    return rows if newest is None else rows.where(F.col("created_at") <= newest)
