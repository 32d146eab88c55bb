"""Chat formatting with budgeted windows (operator 8).

A conversation's turns, in order, become training windows. Prefix sums of turn tokens choose
where a window ends: the last turn whose sum still fits the budget (a turn longer than the budget
gets a window of its own, never cut). Every window retains the leading system turn, repeats a
limited history of the turns before it, and masks what it repeats: each assistant text carries
loss in exactly one window.

The template marks turns with ``<turn>``, ``<text>`` and ``</turn>`` and escapes backslashes and ``<`` inside
roles and texts, so no text can forge a marker and reading back is exact. Offsets are code points.

Rows are sorted inside their partition and read as a stream, so a task holds one window of turns,
however long a conversation is. Turn tokens are those of the BPE codec for a given tokenizer file,
plus ``MARKERS`` for the template; without a file, runs of non-space characters. Null roles and texts are empty; rows of a null conv_id form one
conversation; rows of a null turn come first; equal turns are ordered by role, then text, and
repeated rows are turns each; an empty table gives no windows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import arrow_map, table

BUDGET, HISTORY, MARKERS = 512, 128, 12
_TOKEN = re.compile(r"\S+")
WINDOW = "conv_id long, window long, formatted string, loss array<struct<start:long,end:long>>, n_fixed int, n_history int, n_new int"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text is in it."""
    head = f"<turn>{escape(role)}<text>"
    body = escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


_TURN = re.compile(r"<turn>((?:[^\\<]|\\.)*)<text>((?:[^\\<]|\\.)*)</turn>\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted window, unescaped."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


class Windows:
    """Turns of one conversation in, finished windows out; holds at most one window and its history."""

    def __init__(self, conv_id, budget: int, history: int, count=lambda role, text: len(_TOKEN.findall(text)) + 1):
        self.conv_id, self.budget, self.history, self.count = conv_id, budget, history, count
        self.system: tuple[str, str] | None = None
        self.sums = [0]  # prefix sums of the tokens of the turns held
        self.turns: list[tuple[str, str]] = []
        self.past = 0  # how many of the turns held are history
        self.fixed = 0
        self.n = self.seen = 0

    def add(self, role: str, text: str) -> list[dict]:
        tokens = self.count(role, text)
        out = []
        if not self.seen and role == "system":
            self.system, self.fixed = (role, text), tokens
        else:
            room = max(0, self.budget - self.fixed)
            self.turns.append((role, text))
            self.sums.append(self.sums[-1] + tokens)
            # the last turn that fits, by the prefix sums; at least one new turn goes into every window
            fits = bisect_right(self.sums, self.sums[0] + room) - 1
            if fits < len(self.turns) and len(self.turns) - 1 > self.past:
                out.append(self._emit(len(self.turns) - 1))
                self._shrink(room)
        self.seen += 1
        return out

    def _shrink(self, room: int) -> None:
        """Drop history from the left while the window is over its budget."""
        while self.past and self.sums[-1] - self.sums[0] > room:
            self.turns.pop(0)
            self.sums.pop(0)
            self.past -= 1

    def _emit(self, stop: int) -> dict:
        """A window of the turns before ``stop``; the last of them within the history limit stay as history."""
        parts, loss, at = [], [], 0
        rows = ([(self.system, self.n == 0)] if self.system else []) + [(t, k >= self.past) for k, t in enumerate(self.turns[:stop])]
        for (role, text), fresh in rows:
            shown, a, b = render(role, text)
            if fresh and role == "assistant":
                loss.append({"start": at + a, "end": at + b})
            parts.append(shown)
            at += len(shown)
        row = {"conv_id": self.conv_id, "window": self.n, "formatted": "".join(parts), "loss": loss, "n_fixed": int(bool(self.system)), "n_history": self.past, "n_new": stop - self.past}
        keep = stop
        while keep and self.sums[stop] - self.sums[keep - 1] <= self.history:
            keep -= 1
        self.turns, self.sums, self.past = self.turns[keep:], self.sums[keep:], stop - keep
        self.n += 1
        return row

    def close(self) -> list[dict]:
        if len(self.turns) > self.past or (self.system and not self.n):
            return [self._emit(len(self.turns))]
        return []


def _ordered(df: DataFrame, *by: str) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions(*by)


def format_conversations(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str | None = None) -> DataFrame:
    """Windows of all conversations: see WINDOW for the columns; budgets are in tokens of the tokenizer file, if one is given."""
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        count = Windows.__init__.__defaults__[0]
        if tokenizer:
            codec = bpe.codec(tokenizer)
            count = lambda role, text: sum(map(len, codec.stream(escape(text)))) + sum(map(len, codec.stream(escape(role)))) + MARKERS
        now: Windows | None = None
        for b in batches:
            out = []
            for c, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
                if now is None or now.conv_id != c:
                    out += now.close() if now else []
                    now = Windows(c, budget, history, count)
                out += now.add(role, text)
                if len(out) >= 500:
                    yield _columns(out)
                    out = []
            yield _columns(out)
        if now:
            yield _columns(now.close())

    return arrow_map(_ordered(rows, "conv_id", "turn", "role", "text"), run, WINDOW)


def _columns(rows: list[dict]) -> dict:
    names = ("conv_id", "window", "formatted", "loss", "n_fixed", "n_history", "n_new")
    return {k: [r[k] for r in rows] for k in names}


class _Digest:
    def __init__(self, conv_id):
        self.conv_id, self.n, self.loss_n, self.chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, window: int, formatted: str, loss: list[dict], n_fixed: int, n_history: int) -> None:
        skip = n_history + (n_fixed if window else 0)
        for k, (role, text) in enumerate(parse(formatted)):
            if n_fixed and not window and k == 0 or k >= skip and (window or k >= n_fixed):
                self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                self.n += 1
        for x in loss:
            text = unescape(formatted[x["start"] : x["end"]])
            self.loss.update(text.encode("utf-8", "surrogatepass"))
            self.loss_n += len(text)
        self.chars += len(formatted)


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation what its windows say when parsed again: turns, text under the loss mask, sizes."""

    def rows(done):
        return {
            "conv_id": [d.conv_id for d in done], "n_turns": [d.n for d in done], "turns_sha256": [d.turns.hexdigest() for d in done], "loss_chars": [d.loss_n for d in done],
            "loss_sha256": [d.loss.hexdigest() for d in done], "formatted_chars": [d.chars for d in done],
        }

    def run(batches):
        now: _Digest | None = None
        for b in batches:
            done = []
            for r in b.to_pylist():
                if now is None or now.conv_id != r["conv_id"]:
                    done += [now] if now else []
                    now = _Digest(r["conv_id"])
                now.add(r["window"], r["formatted"], r["loss"], r["n_fixed"], r["n_history"])
            yield rows(done)
        if now:
            yield rows([now])

    return arrow_map(_ordered(windows, "conv_id", "window"), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


EXTRA = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(turns.unionByName(extra), tokenizer=bpe.default_path()))
