"""The stored history: outcomes as by plain comparison, added batches, and a plan that never moves it."""

import re

from tessella.operators.history import History

SCHEMA = "k string, part int, p string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def outcomes(h, df):
    return sorted(((r.k, r.part, r.rows, r.status) for r in h.outcomes(df, "p").collect()), key=str)


def test_outcomes_and_added_batches(spark, tmp_path):
    h = History.create(frame(spark, [("a", 1, "x"), ("a", 1, "x"), ("b", 1, None), (None, 2, "n"), ("", 3, "e")]), ["k", "part"], "p", str(tmp_path / "h"), 8)
    batch = frame(spark, [("a", 1, "x"), ("a", 2, "x"), ("b", 1, None), ("b", 1, "null"), (None, 2, "n"), ("", 3, "other"), ("c", 1, "1"), ("c", 1, "2"), ("k", None, "z")])
    want = [("a", "1", 1, "duplicate"), ("a", "2", 1, "new"), ("b", "1", 2, "conflict"), (None, "2", 1, "duplicate"), ("", "3", 1, "conflict"), ("c", "1", 2, "conflict"), ("k", None, 1, "new")]
    assert outcomes(h, batch) == sorted(want, key=str)
    h.add(frame(spark, [("a", 2, "x"), ("k", None, "z"), ("a", 1, "x")]), "p")
    assert spark.table(h.table).count() == 6
    later = dict(((k, part), status) for k, part, _, status in outcomes(h, batch))
    assert later["a", "2"] == later["k", None] == "duplicate"


def test_empty_history_and_empty_batch(spark, tmp_path):
    h = History.create(frame(spark, []), ["k"], "p", str(tmp_path / "h"), 4)
    got = h.outcomes(frame(spark, [("a", 1, "x")]), "p").collect()
    assert [(r.k, r.status) for r in got] == [("a", "new")]
    assert h.outcomes(frame(spark, []), "p").count() == 0


def test_the_history_is_never_shuffled(spark, tmp_path):
    rows = [(f"k{i}", i % 3, f"p{i}") for i in range(500)]
    h = History.create(frame(spark, rows), ["k"], "p", str(tmp_path / "h"), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = h.outcomes(frame(spark, rows[:50]), "p")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    scan = next(i for i, x in enumerate(lines) if "FileScan" in x)
    depth = lambda x: len(re.match(r"[ :|+-]*", x)[0])
    join = next(i for i, x in enumerate(lines) if "SortMergeJoin" in x)
    above, at = [], depth(lines[scan])
    for x in reversed(lines[join + 1 : scan]):
        if depth(x) < at:
            above.append(x)
            at = depth(x)
    assert "Bucketed: true" in plan and not any("Exchange" in x for x in above), plan
