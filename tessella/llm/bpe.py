"""BPE encoding and decoding by a bounded-lookahead streaming transducer (operator 6).

A text is read as a stream of blocks, cut where white space begins, which the split pattern never
reads across; a block's pieces (what the split pattern yields) go to the transducer one by one.
Encoding reads a piece's bytes from left to right. For every
prefix it keeps the last token of that prefix's encoding: the longest token ending there that is
compatible with the last token of what precedes it (two tokens are compatible if merging their
joined bytes by the merge list gives back exactly those two). All later prefixes can only build
on the last ``max_token`` positions, so a token is stable, and is emitted, as soon as the
back-pointers of all those positions meet; ``sufficient_lookahead``, computed from the merge list,
says after how many bytes a token is stable at the latest, and is the bound at which tokens are
emitted where the pointers have not met. So the transducer never keeps more than that many bytes
and a chunk, however long a piece is. Short pieces are remembered, in a memory of fixed size.
Decoding maps ids to bytes and feeds an incremental UTF-8 state machine, which
replaces ill-formed sequences as the tokenizers library does.

Nulls encode like empty text; special tokens' literal strings in a text become their ids, as the
library does by default. Texts of any length are encoded whole. Repeated rows are encoded each,
ties can't arise; an empty table gives an empty table; columns of other names are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, slices, table

#: The split of byte-level vocabularies; the alternatives for letters and the contractions exclude each other, so letters may come first.
PATTERN = r" ?\p{L}+|'(?:s|t|re|ve|m|ll|d)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of the piece cache of one Python worker, then it starts anew; a bound on memory, not on input.
CACHE = 150_000
PAIRS = 400_000
#: Pieces longer than this go through the transducer in chunks of this many bytes and aren't remembered.
LONG = 256
#: Characters of a block of a text, about; more only where white space is farther apart.
BLOCK = 1 << 16
_SPACE_BEGINS = re.compile(r"(?<=\S)\s")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stays, others move to 256 and up."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        plain = lambda s: bytes(alphabet[c] for c in s)
        model = spec["model"]
        self.ids = {plain(s): i for s, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = [(plain(a), plain(b)) for a, b in merges]
        self.ranks = {m: r for r, m in enumerate(self.merges)}
        self.max_token = max(map(len, self.ids))
        self.lookahead = sufficient_lookahead(self.merges, self.max_token)


def sufficient_lookahead(merges: list[tuple[bytes, bytes]], max_token: int) -> int:
    """An upper bound of the bytes after a token's end that can still change it.

    A later byte changes an earlier token only through a chain of merges in which each overlaps
    the one before and outranks it. best[c] is the longest such chain, in bytes, that begins
    with byte c among merges so far; going down the list, each merge extends what it overlaps.
    Chains whose links have the same first byte share one entry, so this is from above.
    """
    best, most = [0] * 256, 0
    for a, b in merges:
        length = len(a) + len(b) + max(best[c] for c in set(b))
        best[a[0]] = max(best[a[0]], length)
        most = max(most, length)
    return most + max_token


class Transducer:
    """Bytes in, stable token ids out: push() as they come, finish() at the end of the piece."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.length = {i: len(b) for b, i in vocabulary.ids.items()}
        self.rank = {(vocabulary.ids[a], vocabulary.ids[b]): r for r, (a, b) in enumerate(vocabulary.merges)}
        self.halves = {vocabulary.ids[a + b]: (vocabulary.ids[a], vocabulary.ids[b], r) for r, (a, b) in reversed(list(enumerate(vocabulary.merges)))}
        # the states read so far: the longest end of the input that begins a token; made as they are met
        self.token_at = vocabulary.ids
        self.begins = {b[:k] for b in vocabulary.ids for k in range(1, len(b) + 1)}
        self.numbers: dict[bytes, int] = {b"": 0}
        self.names: list[bytes] = [b""]
        self.ending: list[tuple[tuple[int, int], ...]] = [()]  # by state: tokens that end here, longest first
        self.step: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.buf = b""  # bytes from the first position kept
        self.last = [-1]  # last token of each kept prefix; [0]: the base, before which all is emitted
        self.before = -1  # the last token emitted
        self.state = 0

    def _next(self, state: int, byte: int) -> int:
        name = self.names[state] + bytes((byte,))
        while name not in self.begins:
            name = name[1:]
        if name not in self.numbers:
            self.numbers[name] = len(self.names)
            self.names.append(name)
            self.ending.append(tuple((self.token_at[name[k:]], len(name) - k) for k in range(len(name)) if name[k:] in self.token_at))
        new = self.step[state << 8 | byte] = self.numbers[name]
        return new

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The parts that stand at a token's edge while it grows, smallest first, each with the rank that takes it in."""
        out, taken = [(token, float("inf"))], float("inf")
        while token in self.halves:
            left, right, taken = self.halves[token]
            token = right if side else left
            out.append((token, taken))
        return out[::-1]

    def _pair(self, a: int, b: int) -> bool:
        """Does the boundary between a and b survive the merges, lowest rank first and leftmost at equal ranks?"""
        x, y, i, j = self._spine(a, 1), self._spine(b, 0), 0, 0
        while True:
            (p, until_p), (q, until_q) = x[i], y[j]
            r = self.rank.get((p, q))
            if r is not None and r < until_p and r <= until_q:
                return False
            if until_p == until_q == float("inf"):
                return True
            if until_p <= until_q:
                i += 1
            else:
                j += 1

    def _extend(self, data: bytes) -> None:
        self.state = self._read(data, self.last, self.state, self.before)
        self.buf += data

    def _read(self, data: bytes, last: list[int], state: int, before: int) -> int:
        """Append to ``last`` the last token of each longer prefix."""
        pairs, step, ending, n = self.pairs, self.step.get, self.ending, len(last)
        for byte in data:
            new = step(state << 8 | byte)
            state = self._next(state, byte) if new is None else new
            for token, length in ending[state]:
                if length > n:  # it would begin before the base
                    continue
                p = last[n - length]
                if p < 0:
                    p = before
                if p >= 0:
                    ok = pairs.get(p << 20 | token)
                    if ok is None:
                        if len(pairs) > PAIRS:
                            pairs.clear()
                        ok = pairs[p << 20 | token] = self._pair(p, token)
                    if not ok:
                        continue
                last.append(token)
                n += 1
                break
            else:
                raise ValueError("the vocabulary has no token for a byte")
        return state

    def push(self, data: bytes) -> list[int]:
        self._extend(data)
        longest, n = self.v.max_token, len(self.buf)
        if n <= 2 * longest:
            return []
        # positions any later prefix can build on; go back until their paths meet
        live = set(range(n - longest, n + 1))
        while len(live) > 1:
            top = max(live)
            live.discard(top)
            live.add(top - self.length[self.last[top]])
        stable = live.pop()
        if stable == 0 and n > self.v.lookahead:
            # paths that haven't met differ only in what the lookahead can still change
            stable = n
            while stable > n - self.v.lookahead:
                stable -= self.length[self.last[stable]]
        if stable <= 0:
            return []
        out = self._path(stable)
        self.before = self.last[stable]
        self.buf = self.buf[stable:]
        self.last = [-1, *self.last[stable + 1 :]]
        return out

    def _path(self, end: int) -> list[int]:
        out, last, length = [], self.last, self.length
        while end:
            out.append(last[end])
            end -= length[last[end]]
        out.reverse()
        return out

    def finish(self) -> list[int]:
        out = self._path(len(self.buf))
        self.reset()
        return out

    def short(self, piece: bytes) -> list[int]:
        """A whole piece at once, where nothing has to be forgotten."""
        last = [-1]
        self._read(piece, last, 0, -1)
        out, length, n = [], self.length, len(piece)
        while n:
            token = last[n]
            out.append(token)
            n -= length[token]
        out.reverse()
        return out

    def encode(self, piece: bytes) -> list[int]:
        if len(piece) <= LONG:
            return self.short(piece)
        self.reset()
        out = []
        for i in range(0, len(piece), LONG):
            out += self.push(piece[i : i + LONG])
        return out + self.finish()

    def encode_long(self, text: str, start: int, end: int) -> Iterator[tuple[int, ...]]:
        """Tokens of the piece text[start:end] as they become stable."""
        self.reset()
        for i in range(start, end, LONG):
            if out := self.push(text[i : min(i + LONG, end)].encode("utf-8", "replace")):
                yield tuple(out)
        yield tuple(self.finish())


class Codec:
    """Encodes texts to ids and decodes ids to text, for one tokenizer file."""

    def __init__(self, path: str):
        import regex

        self.v = Vocabulary(path)
        general = regex.compile(PATTERN, regex.V1)
        kinds = {k: "".join(f"\\x{c:02x}" for c in range(256) if regex.match(k, chr(c))) for k in (r"\p{L}", r"\p{N}", r"\s", r"\S")}
        # the same pattern with the classes spelt out, for texts of Latin-1 characters only
        narrow = PATTERN.replace(r"[^\s\p{L}\p{N}]", "[^" + kinds[r"\s"] + kinds[r"\p{L}"] + kinds[r"\p{N}"] + "]")
        for k, v in kinds.items():
            narrow = narrow.replace(k, f"[{v}]")
        narrow = re.compile(narrow)

        def split(text: str) -> list[str]:
            try:
                if not text.isascii():
                    text.encode("latin-1")
            except UnicodeEncodeError:
                return general.findall(text)
            return narrow.findall(text)

        self.split, self.general = split, general
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.v.special)) + ")") if self.v.special else None
        self.transducer = Transducer(self.v)
        codec = self

        class Pieces(dict):
            """Pieces seen lately: when full, the entries become the old half, from which hits move back."""

            old: dict = {}

            def __missing__(self, piece: str) -> tuple[int, ...]:
                ids = self.old.get(piece)
                if ids is None:
                    ids = tuple(codec.transducer.encode(piece.encode("utf-8", "replace")))
                if len(piece) <= LONG:
                    if len(self) >= CACHE:
                        self.old = dict(self)
                        self.clear()
                    self[piece] = ids
                return ids

        self.pieces = Pieces()

    def blocks(self, text: str) -> Iterator[str]:
        """The text in blocks that begin where white space begins: no piece reaches over that place."""
        at = 0
        while len(text) - at > BLOCK:
            cut = _SPACE_BEGINS.search(text, at + BLOCK)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """What stands between special tokens, and those (true), in order."""
        if self.cut is None or not any(s in text for s in self.v.special):
            yield text, False
            return
        at = 0
        for m in self.cut.finditer(text):
            yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        yield text[at:], False

    def stream(self, text: str) -> Iterator[tuple[int, ...]]:
        """Tokens of a text, piece by piece, as they become stable."""
        for part, special in self.parts(text):
            if special:
                yield (self.v.special[part],)
                continue
            for block in self.blocks(part):
                if len(block) <= 2 * BLOCK:
                    yield from map(self.pieces.__getitem__, self.split(block))
                else:  # hardly any white space: its pieces one at a time
                    for m in self.general.finditer(block):
                        if m.end() - m.start() <= LONG:
                            yield self.pieces[m[0]]
                        else:
                            yield from self.transducer.encode_long(block, m.start(), m.end())

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.stream(text))) if text else []

    def decode(self, ids: Iterable[int]) -> str:
        """Bytes of the ids through an incremental state machine, a block of ids at a time."""
        machine, get, out, block = codecs.getincrementaldecoder("utf-8")("replace"), self.v.bytes.get, [], []
        for i in ids:
            block.append(get(i, b""))
            if len(block) == 4096:
                out.append(machine.decode(b"".join(block)))
                block = []
        out.append(machine.decode(b"".join(block), final=True))
        return "".join(out)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, out: str = "ids") -> DataFrame:
    """Per row its id column and the token ids (array<int>) of the text; one narrow pass."""
    path = path or default_path()

    def run(batches):
        c = codec(path)
        for whole in batches:
            for b in slices(whole, "t", 2 << 20):
                yield {id_col: b.column("i"), out: [c.encode(t) for t in b.column("t").to_pylist()]}

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), run, f"`{id_col}` {kind}, `{out}` array<int>")


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None, out: str = "text") -> DataFrame:
    """Per row its id column and the text its token ids decode to (null ids: empty text)."""
    path = path or default_path()

    def run(batches):
        c = codec(path)
        for b in batches:
            yield {id_col: b.column("i"), out: [c.decode(x or ()) for x in b.column("x").to_pylist()]}

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(F.col(id_col).alias("i"), F.col(ids_col).alias("x")), run, f"`{id_col}` {kind}, `{out}` string")


def round_trip(df: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of encoding and of decoding those ids again.

    Ids never leave the task: both hashes grow block by block, so memory is that of one text.
    """
    path = path or default_path()

    def digest(c: Codec, text: str | None) -> tuple[int, str, str]:
        ids_hash, text_hash, n, lead = hashlib.sha256(), hashlib.sha256(), 0, ""
        machine, get = codecs.getincrementaldecoder("utf-8")("replace"), c.v.bytes.__getitem__
        if text:
            stream = c.stream(text)
            block: list[int] = []
            done = False
            while not done:
                done, block = True, []
                for ids in stream:
                    block += ids
                    if len(block) >= 8192:
                        done = False
                        break
                if block:
                    n += len(block)
                    ids_hash.update((lead + str(block)[1:-1].replace(" ", "")).encode())
                    lead = ","
                    text_hash.update(machine.decode(b"".join(map(get, block))).encode())
        text_hash.update(machine.decode(b"", final=True).encode())
        return n, ids_hash.hexdigest(), text_hash.hexdigest()

    def run(batches):
        c = codec(path)
        for whole in batches:
            for b in slices(whole, "text"):
                got = [digest(c, t) for t in b.column("text").to_pylist()]
                yield {"doc_id": b.column("doc_id"), "n_tokens": [x[0] for x in got], "ids_sha256": [x[1] for x in got], "decoded_sha256": [x[2] for x in got]}

    return arrow_map(df.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
