"""Lines of text files by byte ranges: a file of any size is scanned by many tasks, and its lines keep their numbers.

A line belongs to the range in which its first byte lies; a task reads on beyond its range to the end of its
last line. Lines end at CR LF, LF or CR. Each range is read twice: once to count its lines, and, behind the
prefix sums of the counts over each file's ranges, once to yield them with their numbers, so no line is shuffled.
Ranges follow from a file's length alone, so both readings, and repeated tasks, see the same ones.

A byte order mark at a file's start is left out; bytes that are no UTF-8 are replaced; a file
without bytes has no lines; the empty rest behind a last line end is blank, like lines of white space.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import settle
from .files import CHUNK, arrow, opened

#: Bytes of a range.
RANGE_BYTES = 64 << 20
MARK = b"\xef\xbb\xbf"
#: White space that makes a line blank.
BLANK = b" \t\n\x0b\x0c\r"


def line_blocks(source, size: int, start: int, end: int, chunk: int = CHUNK) -> Iterator[list[bytes]]:
    """The lines, without their ends, whose first byte is in [start, end) of an open file of ``size`` bytes, in blocks of about a chunk."""
    at, held = max(start - 1, 0), b""
    skipping = start > 0  # until a line end, from the byte before the range on, so that one just before it counts
    while True:
        if skipping and at >= end:
            return
        data = source.read_at(min(chunk, size - at), at)
        last = at + len(data) >= size
        if skipping:
            cuts = [i for i in (data.find(b"\n"), data.find(b"\r")) if i >= 0]
            if not cuts:
                if last:
                    return
                at += len(data)
                continue
            i = min(cuts)
            if data[i : i + 1] == b"\r" and i + 1 == len(data) and not last:
                at += i  # whether LF follows is in the next chunk
                if len(data) == 1:
                    data = source.read_at(min(2, size - at), at)
                    i = 0
                else:
                    continue
            at += i + (2 if data[i : i + 2] == b"\r\n" else 1)
            skipping = False
            if at >= min(end, size):
                return
            continue
        first, data, at = at - len(held), held + data, at + len(data)
        whole = data.splitlines(keepends=True)
        if not last:  # a line that may go on waits, also for the LF behind a CR
            held = whole.pop() if whole else b""
        out = []
        for line in whole:
            if first >= end:
                break
            out.append(line.rstrip(b"\r\n") if line.endswith((b"\r", b"\n")) else line)
            first += len(line)
        if out:
            yield out
        if last or first >= end:
            return


def lines_of(file: str, size: int, start: int, end: int) -> Iterator[list[bytes]]:
    filesystem, path = opened(file)
    with filesystem.open_input_file(path) as source:
        for k, block in enumerate(line_blocks(source, size, start, end)):
            yield [block[0].removeprefix(MARK), *block[1:]] if start == 0 and k == 0 else block


def ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, path, length, start, end) of (file, path, length) rows."""
    f = files.where("length > 0").withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))))
    return f.withColumn("end", F.least(F.col("start") + range_bytes, "length"))


def numbered_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, line, place, value) of the files' lines that aren't blank: numbered from 1 among all lines of their file, and among these."""

    def count(batches):
        for b in batches:
            for file, name, size, start, end in zip(*(b.column(c).to_pylist() for c in ("file", "path", "length", "start", "end")), strict=True):
                n = filled = 0
                for block in lines_of(name, size, start, end):
                    n += len(block)
                    filled += sum(1 for x in block if x.strip(BLANK))
                yield {"file": [file], "path": [name], "length": [size], "start": [start], "end": [end], "n": [n], "filled": [filled]}

    def read(batches):
        for b in batches:
            for file, name, size, start, end, line, place in zip(*(b.column(c).to_pylist() for c in ("file", "path", "length", "start", "end", "line", "place")), strict=True):
                for block in lines_of(name, size, start, end):
                    kept = [(line + i, x) for i, x in enumerate(block, 1) if x.strip(BLANK)]
                    line += len(block)
                    yield {"file": [file] * len(kept), "line": [i for i, _ in kept], "place": range(place + 1, place + 1 + len(kept)), "value": [x.decode("utf-8", "replace") for _, x in kept]}
                    place += len(kept)

    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), "path", "length")
    cut = ranges(files, range_bytes)
    total = cut.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("bytes")).first()
    # a task has several small ranges at most, whatever their rows weigh: adaptive execution would put them all in one
    tasks = max(1, min(total.n, max(4 * spark.sparkContext.defaultParallelism, total.bytes // RANGE_BYTES)))
    spread = cut.repartition(tasks, "path", "start")
    counted = settle(arrow(spread, count, "file string, path string, length long, start long, end long, n long, filled long"))
    w = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    behind = counted.select("file", "path", "length", "start", "end", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("line"), F.coalesce(F.sum("filled").over(w), F.lit(0)).alias("place"))
    return arrow(settle(behind).repartition(tasks, "path", "start"), read, "file string, line long, place long, value string")
