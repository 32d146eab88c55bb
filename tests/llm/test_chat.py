import hashlib
import os

import pytest

from tessella.llm import chat

DATA = "/root/testdata/sf0.001"


def brute(rows):
    out = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(c, []).append((role or "", text or ""))
    return {
        c: (
            len(t),
            hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest(),
            sum(len(x) for r, x in t if r == "assistant"),
            hashlib.sha256("".join(x for r, x in t if r == "assistant").encode()).hexdigest(),
        )
        for c, t in out.items()
    }


def rows_of(spark):
    long = "word " * 900
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi <turn>"), (1, 2, "assistant", "a\\<text></turn>\n b"), (1, 3, "user", long), (1, 4, "assistant", long)]
    rows += [(2, i, ("user", "assistant")[i % 2], f"turn {i} " + "x " * (i % 90)) for i in range(200)]
    rows += [(3, 0, "system", "only")] + [(4, 0, None, None)] + [(5, 0, "assistant", ""), (5, 1, "system", "late system")] + list(chat.EXTRA)
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_round_trip_and_masks(spark):
    rows, df = rows_of(spark)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got == brute(rows)


def test_windows_keep_budget_and_system(spark):
    _, df = rows_of(spark)
    for w in chat.format_conversations(df, budget=100, history=30).collect():
        turns = chat.parse(w.formatted)
        tokens = sum(len(t.split()) + 1 for _, t in turns)
        assert tokens <= 100 or w.n_new == 1
        assert w.n_new >= 1 or w.n_fixed
        if w.conv_id == 1:
            assert turns[0] == ("system", "be kind")
        assert len(turns) == w.n_fixed + w.n_history + w.n_new


def test_null_ids_repeated_rows_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame([(None, None, "user", "a"), (None, 1, "assistant", "b"), (None, 1, "assistant", "b")], schema)
    (r,) = chat.read_back(chat.format_conversations(df)).collect()
    assert (r.conv_id, r.n_turns, r.loss_chars) == (None, 3, 2)
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], schema))).count() == 0


def test_budgets_in_model_tokens(spark):
    from tessella.llm import bpe

    rows, df = rows_of(spark)
    codec = bpe.codec(bpe.default_path())
    windows = chat.format_conversations(df, budget=100, history=30, tokenizer=bpe.default_path())
    for w in windows.collect():
        assert len(codec.encode(w.formatted)) <= 100 or w.n_new == 1
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(windows).collect()}
    assert got == brute(rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
def test_whole_table_like_brute_force(spark):
    """The query itself, with its production budgets and conversation -7."""
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = chat.op8_chat(spark, DATA).collect()
    want = brute([*rows, *chat.EXTRA])
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want and len(got) == len(want) and -7 in want
    assert all(r.formatted_chars > 0 for r in got)


def test_very_long_conversation_and_turn(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(4000)] + [(2, 0, "user", "q"), (2, 1, "assistant", "long <turn> " * 60_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got == brute(rows)
