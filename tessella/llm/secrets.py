"""Secret scans with password guess-cost dynamic programming (operator 9).

Base patterns find assignments, access keys and hexadecimal runs. On top of them, values in
credential context (what follows an identifier with password, pwd, passphrase, ... in it, quoted
values with their blanks) are cut into words, dates, repeats, keyboard walks, sequences and brute-force spans at
the least guess cost; a value that is dear to guess is a secret of kind ``guess``. Cheap values
(placeholders, common words) add nothing; base spans always stay.

Words are ranked: first the fixed ones that people choose, then those of the corpus itself, by the
number of documents that hold them (counted over all documents, the ``RANKED`` most frequent ones
are kept: the size of the model, which the cost of a word depends on only by its logarithm).

Null and empty texts have no spans; repeated rows are scanned each (and counted each); texts and
values of any length are judged whole, in time linear in their length. Spans that begin at one
place are ordered by kind; words of equal count by the alphabet; segmentations of equal cost by
the first found. Rows of null ids are scanned like others; an empty table gives an empty table;
columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, materialize, slices, table

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
HINTS = ("passw", "secret", "token", "apikey", "api_key")
#: Keywords of the added spans; they may stand anywhere in an identifier (DB_PASSWORD, MyPassword, client_secret, secret_key).
KEYWORD = re.compile(r"pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|credential|auth|private[_-]?key", re.I | re.A)
#: From the end of a keyword: the rest of its identifier; then = : -> or is; then a value up to the closing quote on its line, or up to white space.
REST = re.compile(r"\w*+(?:-\w++)*+", re.A)
BETWEEN = re.compile(r"""["']?[ \t]*+(?:[:=]+>?|->|(is[ \t]))[ \t]*+""", re.I | re.A)
VALUE = re.compile(r"""(?:"([^"\r\n]+)"|'([^'\r\n]+)'|([^\s"'<>,;]+))""", re.A)
#: Ordinary words that hold a keyword but name no credential.
ORDINARY = re.compile(r"author(?:s|ed|ity|ities|ship)?|pass(?:age|enger|ion|port)s?|passive(?:ly)?|(?:by|com|encom|over|sur|tres|under)pass(?:es|ed)?|secretar(?:y|ies|iat)|tokeni[sz]\w*", re.I | re.A)
CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "api", "credential", "auth", "private")
#: Words of the corpus that the model ranks behind the fixed ones.
RANKED = 20_000
#: Words by assumed rank, most usual first.
WORDS = (
    "password passwd pass secret token admin user test example changeme default welcome login letmein master root guest "
    "dragon monkey football baseball iloveyou sunshine princess shadow superman trustno hello love summer winter spring "
    "autumn abc key api private public none null true false placeholder your here xxx redacted hidden unknown value string "
    "required field reset forgot the and for with this that from not"
).split()
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)?\d\d|(?:19|20)\d\d")
#: A word of prose: letters between white space, with marks around it at most.
PROSE = re.compile(rb"(?<!\S)[\"'(]?([a-z]{3,24})[.,;:?!)\"']*(?!\S)")
LEET = str.maketrans("@4031!5$7+", "aaoeiisstt")
#: A value at least this dear to guess (log10 of guesses) is a secret.
MIN_LOG10_GUESSES = 9.0


def _neighbours() -> dict[str, str]:
    """For each key those next to it: in its row, and in the rows above and below at the slant of a keyboard."""
    at = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
    place = {p: c for c, p in at.items()}
    near = lambda r, i: "".join(place.get(p, "") for p in ((r, i - 1), (r, i + 1), (r - 1, i), (r - 1, i + 1), (r + 1, i - 1), (r + 1, i)))
    return {c: near(*p) for c, p in at.items()}


NEAR = _neighbours()


def _size(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100)


class GuessCost:
    """log10 of the guesses that a value takes, by the cheapest segmentation."""

    def __init__(self, words: Iterable[str] = WORDS, longest_repeat_unit: int = 8):
        self.rank = {}
        for i, w in enumerate(words, 1):
            self.rank.setdefault(w.lower(), i)
        self.longest = max(map(len, self.rank), default=0)
        self.unit = longest_repeat_unit

    def segments(self, value: str) -> tuple[float, list[tuple[str, int, int]]]:
        """Cost and (kind, start, end) of the cheapest segmentation; segments tile the value."""
        n = len(value)
        low = value.lower()
        plain = low.translate(LEET)
        best = [math.inf] * (n + 1)  # cheapest cost of a prefix
        best[0] = 0.0
        back: list[tuple[str, int]] = [("", 0)] * (n + 1)
        brute, brute_from = math.inf, 0  # cheapest prefix that ends inside a brute-force span
        ends = self._runs(value, low)
        dates: dict[int, list[int]] = {}
        for m in DATE.finditer(value):
            dates.setdefault(m.start(), []).append(m.end())
        turn = math.log10(2)  # each further segment doubles the orders to try

        def offer(i: int, j: int, kind: str, cost: float) -> None:
            if best[i] + cost + turn < best[j]:
                best[j], back[j] = best[i] + cost + turn, (kind, i)

        for i in range(n):
            # a brute-force span begins here or goes on
            if best[i] + turn < brute:
                brute, brute_from = best[i] + turn, i
            for j in range(i + 2, min(n, i + self.longest) + 1):
                rank = self.rank.get(low[i:j])
                if rank is not None:
                    upper = sum(c.isupper() for c in value[i:j])
                    offer(i, j, "word", math.log10(rank + 1) + (math.log10(2) if upper in (0, 1, j - i) else math.log10(math.comb(j - i, upper))) * (upper > 0))
                elif plain[i:j] != low[i:j] and (rank := self.rank.get(plain[i:j])) is not None:
                    swapped = sum(a != b for a, b in zip(low[i:j], plain[i:j], strict=True))
                    offer(i, j, "word", math.log10(rank + 1) + swapped * math.log10(2))
            for j in dates.get(i, ()):
                offer(i, j, "date", math.log10(365 * 120 if j - i > 4 else 120))
            for kind, j, cost in ends.get(i, ()):
                offer(i, j, kind, cost)
            brute += _size(value[i])
            if brute < best[i + 1]:
                best[i + 1], back[i + 1] = brute, ("brute", brute_from)
        out, i = [], n
        while i:
            kind, j = back[i]
            out.append((kind, j, i))
            i = j
        return best[n], out[::-1]

    def _runs(self, value: str, low: str) -> dict[int, list[tuple[str, int, float]]]:
        """Maximal repeats, walks and sequences by their start, with their costs."""
        out: dict[int, list[tuple[str, int, float]]] = {}
        n = len(low)

        def runs(step, kind, least, cost):
            i = 0
            while i + 1 < n:
                j = i + 1
                while j < n and step(low[j - 1], low[j]):
                    j += 1
                if j - i >= least:
                    out.setdefault(i, []).append((kind, j, cost(i, j)))
                    i = j
                else:
                    i += 1 if j == i + 1 else j - i - 1 or 1

        runs(lambda a, b: b in NEAR.get(a, ""), "walk", 3, lambda i, j: math.log10(len(NEAR)) + (j - i - 1) * math.log10(2.0) * 0.5 + math.log10(j - i))
        for d in (1, -1):
            runs(lambda a, b, d=d: a.isascii() and b.isascii() and a.isalnum() and b.isalnum() and ord(b) - ord(a) == d, "sequence", 3, lambda i, j: math.log10(36 * (j - i)))
        # longer periods show in the distance to where the same few characters stood last
        for size in (4, 12):
            seen: dict[str, int] = {}
            reach: dict[int, int] = {}  # per distance the end of its last run: a place within it would run to that end again, from a later start
            i = 0
            while i + size <= n:
                gram = value[i : i + size]
                p = seen.get(gram)
                seen[gram] = i
                if p is not None and i - p > self.unit and reach.get(i - p, 0) < i + size:
                    j = i + size
                    while j < n and value[j] == value[j - (i - p)]:
                        j += 1
                    reach[i - p] = j
                    if j - p >= 2 * (i - p):
                        times = (j - p) // (i - p)
                        out.setdefault(p, []).append(("repeat", p + times * (i - p), sum(map(_size, value[p:i])) + math.log10(times)))
                        i = j - size
                i += 1
        for u in range(1, self.unit + 1):
            i = 0
            while i + 2 * u <= n:
                j = i + u
                while j < n and value[j] == value[j - u]:
                    j += 1
                if j - i >= max(3, 2 * u):
                    end = i + (j - i) // u * u
                    out.setdefault(i, []).append(("repeat", end, sum(map(_size, value[i : i + u])) + math.log10((end - i) // u)))
                    i = j - u + 1
                else:
                    i = max(i + 1, j - u + 1)
        return out


_HEX_BYTES = bytes(ord("x") if chr(b) in "0123456789abcdef" else 32 for b in range(256))


def _edge(text: str, i: int) -> bool:
    """Whether a part of an identifier may begin or end at i: no letters on both sides, but where lower case meets upper."""
    a, b = text[i - 1 : i], text[i : i + 1]
    return not (a.isascii() and a.isalpha() and b.isascii() and b.isalpha()) or a.islower() and b.isupper()


def contexts(text: str) -> Iterable[tuple[int, int]]:
    """(start, end) of every value in credential context, in linear time.

    With = : -> the keyword may have letters on either side (dbpassword, secretkey) unless they make
    an ordinary word; with "is", as in prose, it must be a part of its own.
    """
    at = 0
    while m := KEYWORD.search(text, at):
        at = REST.match(text, m.end()).end()  # the whole identifier has one value
        between = BETWEEN.match(text, at)
        if not between:
            continue
        keys = KEYWORD.finditer(text, m.start(), at)
        if between[1]:
            if not any(_edge(text, k.start()) and _edge(text, k.end()) for k in keys):
                continue
        elif all(_ordinary(text, k) for k in keys):
            continue
        at = between.end()
        if value := VALUE.match(text, at):
            a, b = value.span(value.lastindex)
            yield a, b
            # a bare word may be the next keyword (secret: password = ...), anything else is done with
            if value.lastindex < 3 or ":" in (inner := text[a:b].rstrip(":=")) or "=" in inner:
                at = value.end()


def _ordinary(text: str, key: re.Match) -> bool:
    """Whether the letters around a keyword (a few at each side suffice) are an ordinary word."""
    a, b = key.span()
    while a > 0 and key.start() - a < 8 and text[a - 1].isascii() and text[a - 1].isalpha():
        a -= 1
    while b < len(text) and b - key.end() < 16 and text[b].isascii() and text[b].isalpha():
        b += 1
    return ORDINARY.fullmatch(text, a, b) is not None


def scan(text: str | None, model: GuessCost, least: float = MIN_LOG10_GUESSES) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of all spans, sorted; offsets are code points, ends exclusive."""
    if not text:
        return []
    low, out = text.lower(), []
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in text.encode("utf-8", "surrogatepass").translate(_HEX_BYTES):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if any(h in low for h in CONTEXT_HINTS):
        for a, b in contexts(text):
            if b - a >= 6 and model.segments(text[a:b])[0] >= least:
                out.append((a, 3, b))
    return sorted(out)


def corpus_words(df: DataFrame, text_col: str = "text", most: int = RANKED) -> list[str]:
    """The words of prose in most documents, most frequent first; counted over all rows, aggregated before they are shuffled."""

    def run(batches):
        total: dict[bytes, int] = {}
        for whole in batches:
            for b in slices(whole, "t"):
                for t in b.column("t").to_pylist():
                    if t:
                        for w in set(PROSE.findall(t.encode("utf-8", "replace").lower())):
                            total[w] = total.get(w, 0) + 1
                if len(total) > 200_000:  # a bound on memory: what was counted goes out, the shuffle adds it up
                    yield {"word": [w.decode() for w in total], "n": list(total.values())}
                    total = {}
        yield {"word": [w.decode() for w in total], "n": list(total.values())}

    counts = materialize(arrow_map(df.select(F.col(text_col).alias("t")), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    # a histogram by sixteenths of powers of two (a thousand bins at most) says from which count on words are wanted,
    # so that no task sends words that others outrank
    size = F.floor(F.log2("n") * 16).alias("bin")
    least, seen = 0, 0
    for r in sorted(counts.groupBy(size).count().collect(), reverse=True):
        least, seen = r.bin, seen + r["count"]
        if seen >= most:
            break
    return [r.word for r in counts.where(size >= least).orderBy(F.desc("n"), "word").limit(most).collect()]


def model_words(df: DataFrame, text_col: str = "text") -> list[str]:
    """The fixed words and behind them the corpus's own."""
    return list(dict.fromkeys([*WORDS, *corpus_words(df, text_col)]))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: Iterable[str] | None = None, least: float = MIN_LOG10_GUESSES) -> DataFrame:
    """Per row its id column and ``found``: array of (kind, start, end), by start, then kind. One narrow pass (and one over the words, where none are given)."""
    words = df.sparkSession.sparkContext.broadcast(model_words(df, text_col) if words is None else list(words))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        model = GuessCost(words.value)
        for whole in batches:
            for b in slices(whole, text_col):
                found = [scan(t, model, least) for t in b.column(text_col).to_pylist()]
                yield {id_col: b.column(id_col), "found": [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for x in found]}

    return arrow_map(df.select(id_col, text_col), run, f"`{id_col}` {kind}, found array<struct<kind:string,start:long,end:long>>")


def cover(text: str | None, spans: list[tuple[int, int, int]], mark: str) -> str | None:
    """The text with every span (overlapping ones joined) replaced by the mark."""
    if not spans:
        return text
    out, at, end = [], 0, -1
    for s, _, e in spans:
        if s >= end:
            if end >= 0:
                out.append(mark)
                at = end
            out.append(text[at:s])
            at, end = s, e
        else:
            end = max(end, e)
    return "".join([*out, mark, text[end:]])


def redact(df: DataFrame, text_col: str = "text", words: Iterable[str] | None = None, least: float = MIN_LOG10_GUESSES, mark: str = "[secret]") -> DataFrame:
    """The same rows and columns with every span (overlapping ones joined) replaced by ``mark``; null stays null."""
    words = df.sparkSession.sparkContext.broadcast(model_words(df, text_col) if words is None else list(words))
    names = df.columns

    def run(batches):
        model = GuessCost(words.value)
        for whole in batches:
            for b in slices(whole, text_col):
                columns = {c: b.column(c) for c in names}
                columns[text_col] = [cover(t, scan(t, model, least), mark) for t in b.column(text_col).to_pylist()]
                yield columns

    return arrow_map(df, run, df.schema)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")

    def run(batches):
        for b in batches:
            rows = b.column("found").to_pylist()
            texts = [[f"{x['kind']}:{x['start']}:{x['end']}" for x in r] for r in rows]
            base = [",".join(t for t, x in zip(ts, r, strict=True) if x["kind"] != "guess") for ts, r in zip(texts, rows, strict=True)]
            yield {"doc_id": b.column("doc_id")} | {f"n_{k}": [sum(x["kind"] == k for x in r) for r in rows] for k in KINDS} | {
                "base_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in base],
                "spans": [",".join(ts) for ts in texts],
            }

    return arrow_map(find_secrets(docs), run, "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")
