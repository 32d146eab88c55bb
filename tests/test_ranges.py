"""Lines by byte ranges: any cut of a file gives the lines and numbers of the whole file."""

import re

import pytest

from tessella.sources import ranges
from tessella.sources import text as scans

TEXTS = [
    b"a\nbb\r\nccc\rd", b"\n\n\r\n\r\r\n  \t\nx\n", b"\xef\xbb\xbf{\"a\": 1}\r\n{\"b\": \"\xc3\xa9\xe2\x80\xa8\x85\"}\r\n\r\n", b"no end", b"\r", b"\r\n", b"\n", b"long" * 20 + b"\r\n" + b"x" * 33 + b"\r" + b"y", b"\xff\xfe\nz",
]


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def whole(data):
    return re.split(b"\r\n|[\n\r]", data)


@pytest.mark.parametrize("data", TEXTS)
@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1000])
def test_every_cut_in_two_and_every_size_of_ranges(data, chunk):
    want = whole(data)
    want = want[:-1] if want[-1] == b"" else want  # nothing stands behind the last line end
    for cut in range(1, len(data)):
        got = [x for a, b in ((0, cut), (cut, len(data))) for block in ranges.line_blocks(Bytes(data), len(data), a, b, chunk) for x in block]
        assert got == want, cut
    for size in range(1, len(data) + 1):
        got = [x for a in range(0, len(data), size) for block in ranges.line_blocks(Bytes(data), len(data), a, min(a + size, len(data)), chunk) for x in block]
        assert got == want, size


@pytest.mark.parametrize("size", [1, 5, 16, 1 << 20])
def test_numbers_are_those_of_the_whole_file(spark, tmp_path, size):
    for i, data in enumerate([*TEXTS, b""]):
        (tmp_path / f"f {i}.jsonl").write_bytes(data)
    got = {}
    for r in ranges.numbered_lines(spark, f"{tmp_path}/*.jsonl", size).collect():
        got.setdefault(re.sub("%20", " ", r.file.rsplit("/", 1)[1]), []).append((r.line, r.place, r.value))
    for i, data in enumerate(TEXTS):
        want, place = [], 0
        for n, line in enumerate(whole(data.removeprefix(ranges.MARK)), 1):
            if line.strip(ranges.BLANK):
                place += 1
                want.append((n, place, line.decode("utf-8", "replace")))
        assert sorted(got.get(f"f {i}.jsonl", [])) == want, i


def test_a_file_beyond_two_gigabytes_is_counted_by_ranges():
    """The ranges of a long file, met through a reader that makes its bytes as they are asked for."""
    line = b'{"n": 1}' + b" " * 55 + b"\n"
    size = (2 << 30) + len(line) * 3
    size -= size % len(line)

    class Made:
        def read_at(self, n, at):
            shift = at % len(line)
            return (line * (n // len(line) + 2))[shift : shift + n]

    for a in (0, 1 << 30, (2 << 30) - 7, size - 1000):
        b = min(a + (1 << 20), size)
        n = sum(len(x) for x in ranges.line_blocks(Made(), size, a, b))
        assert n == -(-b // len(line)) - -(-a // len(line))


def test_strict_scan_names_file_and_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"b": 2}\nnot json\n')
    with pytest.raises(scans.InputError, match=r"a\.jsonl:4"):
        scans.jsonl(spark, f"{tmp_path}/a.jsonl")
    good, bad = scans.jsonl_tolerant(spark, f"{tmp_path}/a.jsonl")
    assert [(r.line, r.place) for r in good.orderBy("line").collect()] == [(1, 1), (3, 2)] and [r.line for r in bad.collect()] == [4]
