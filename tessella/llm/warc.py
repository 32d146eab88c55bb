"""WARC archives: an index first, then coalesced byte-range reads (operator 2).

Writing: every task streams its records into an archive of its own in a shared folder (one gzip
member per record, so any record can be read alone) and yields a row per record with file,
offset, length, URL and digest. Those rows are the index; Spark's committer decides which
attempt's rows count, and a file that no index row names is never read, so a retried task or a
lost executor does no harm. Payloads are written once; equal ones become revisit records.

Reading: the selected index rows are range-partitioned and sorted by file and offset, runs of
nearby ranges are fetched in one read of bounded size, and each record is inflated, parsed and
its payload digest verified.

Null payloads are empty; null URLs give records without a target; control characters in URLs
are percent-encoded. A null page id takes part like the smallest one. Rows that repeat the
smallest page id of a payload are responses each, all others revisit that id. Payloads shorter
than ``least`` bytes are responses always. Payloads of any length are written and read whole; an empty
table gives an empty index and no records. Columns of other names are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, shared_dir, slices, table

INDEX = "file string, offset long, length long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: Ranges with gaps of up to GAP bytes are fetched together, in reads of up to READ bytes.
GAP, READ = 1 << 16, 8 << 20
#: Bytes of records that one task reads back.
TASK_BYTES = 16 << 20
#: A new archive is begun beyond this size.
ROLL = 1 << 30
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _filesystem(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def _sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, date: str = "2000-01-01T00:00:00Z") -> bytes:
    """One uncompressed WARC/1.1 record; revisits have HTTP headers only, with the size of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_id(page_id)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%\ud800-\udfff]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        head += [f"WARC-Refers-To: {_id(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The record's fields; its payload digest is verified where the payload is there."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or _sha1(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    number = lambda x: None if x is None or x == _id(None) else int(x[len("<urn:x-page:") : -1])
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": url and re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url), "payload": payload if kind == "response" else None,
        "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To")),
    }


def _deflate(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def mark_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html with ``first``: the smallest page id of a payload that several rows share, else null.

    Only payloads that repeat are joined back, so the payload's key never gathers its rows: the
    counts are pre-aggregated and the join can be split where a payload is very common.
    """
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("key"))
    shared = (
        pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("p"))
        .where(F.octet_length("p") >= least)
        .groupBy(F.sha1("p").alias("key"))
        .agg(F.count("*").alias("n"), F.min(F.coalesce("page_id", F.lit(-(2**63)))).alias("first"))
        .where("n > 1")
        .select("key", "first")
    )
    return rows.join(shared, "key", "left").select("page_id", "url", "html", "first")


def write(pages: DataFrame, folder: str, least: int = 0, level: int = 3) -> DataFrame:
    """Write archives into ``folder`` and return the committed index, itself written there as Parquet."""

    def run(batches):
        filesystem, root = _filesystem(folder)
        filesystem.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for whole in batches:
                for b in slices(whole, "html"):
                    rows = []
                    for page_id, url, html, first in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "first")), strict=True):
                        if out is None or at > ROLL:
                            if out is not None:
                                out.close()
                            name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                            out = filesystem.open_output_stream(f"{root}/{name}", compression=None)
                        payload = (html or "").encode("utf-8", "surrogatepass")
                        digest = _sha1(payload)
                        own = -(2**63) if page_id is None else page_id
                        kind = "response" if first is None or own == first else "revisit"
                        refers = first if kind == "revisit" and first != -(2**63) else None
                        data = _deflate(record(page_id, url, payload, digest, kind, refers), level)
                        out.write(data)
                        rows.append((name, at, len(data), page_id, url, len(payload), digest, kind, refers))
                        at += len(data)
                    yield dict(zip([x.split(" ")[0] for x in INDEX.split(", ")], map(list, zip(*rows, strict=True)), strict=True)) if rows else {x.split(" ")[0]: [] for x in INDEX.split(", ")}
        finally:
            if out is not None:
                out.close()

    index = arrow_map(mark_revisits(pages, least), run, INDEX)
    index.write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(index.schema).parquet(f"{folder}/index")


def coalesce_ranges(rows: list[tuple[str, int, int]], gap: int = GAP, most: int = READ) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (file, offset, length) to reads: (file, start, end, the ranges within)."""
    now: list | None = None
    for file, offset, length in rows:
        if now and now[0] == file and offset - now[2] <= gap and max(now[2], offset + length) - now[1] <= most:
            now[2] = max(now[2], offset + length)
            now[3].append((offset, length))
        else:
            if now:
                yield tuple(now)
            now = [file, offset, offset + length, [(offset, length)]]
    if now:
        yield tuple(now)


def read(index: DataFrame, folder: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The records that the (selected) index rows name, by sorted and coalesced byte-range reads."""
    fields = [x.split(" ") for x in RECORD.split(", ")]
    fields = [f for f in fields if not columns or f[0] in columns]

    def run(batches):
        filesystem, root = _filesystem(folder)
        name, source = None, None
        for b in batches:
            wanted = zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True)
            for file, start, end, ranges in coalesce_ranges(wanted):
                if file != name:
                    name, source = file, filesystem.open_input_file(f"{root}/{file}")
                data = memoryview(source.read_at(end - start, start))
                found = [parse(zlib.decompress(data[o - start : o - start + n], 31)) for o, n in ranges]
                yield {k: [x[k] for x in found] for k, _ in fields}

    # index rows are small, what they stand for isn't: the number of tasks follows the bytes to read
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("b")).first().b
    tasks = max(1, -(-size // TASK_BYTES))
    rows = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return arrow_map(rows, run, ", ".join(" ".join(f) for f in fields))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    index = write(table(spark, sf_dir, "pages"), folder)
    return read(index, folder, ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d
)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (j // 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (j % 4) AS INTEGER)) & 31) AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""
