import json
import os
import threading

import pytest

from tessella import __main__ as cli
from tessella.plans import state
from tessella.streaming import ingest


def test_checkpoint_forms(tmp_path):
    p = tmp_path / "run.json"
    good = state.new_run(p, {"a": 1})
    assert state.load(p, {"a": 1})["run_id"] == good["run_id"]
    with pytest.raises(state.StateError):
        state.load(p, {"a": 2})
    with pytest.raises(state.StateError):
        state.new_run(p, {})
    changes = [{"schema_version": "x"}, {"run_id": "short"}, {"status": "odd"}, {"config": []}, {"config_fingerprint": "0"}, {"publication": True}, {"publication": -1}, {"stages": {}}, {"stages": good["stages"] | {"export": {"status": "completed", "attempts": "1"}}}]
    for c in changes:
        p.write_text(json.dumps(good | c))
        before = p.read_bytes()
        with pytest.raises(state.StateError):
            state.load(p)
        assert p.read_bytes() == before


def test_stage_machine(tmp_path):
    p = tmp_path / "run.json"
    s = state.new_run(p, {})
    with pytest.raises(OSError):
        state.run_stage(p, s, "scrape", lambda: (_ for _ in ()).throw(OSError("secret")))
    assert state.load(p)["stages"]["scrape"] | {"started_at": 0, "finished_at": 0} == {"status": "failed", "attempts": 1, "error": "OSError", "started_at": 0, "finished_at": 0}
    calls = []
    for x in state.STAGES:
        state.run_stage(p, s, x, lambda x=x: calls.append(x) or {"complete": x != "download"})
    state.run_stage(p, s, "scrape", lambda: calls.append("again"), lambda r: True)
    assert calls == list(state.STAGES) and state.finish(p, s)["status"] == "partial"
    with pytest.raises(KeyboardInterrupt):
        state.run_stage(p, s, "export", lambda: (_ for _ in ()).throw(KeyboardInterrupt()))
    assert state.load(p)["status"] == "interrupted"


def test_one_writer(tmp_path):
    got = []

    def other():
        try:
            with state.single_writer(tmp_path):
                got.append("in")
        except state.StateError:
            got.append("refused")

    with state.single_writer(tmp_path), state.single_writer(tmp_path):
        t = threading.Thread(target=other)
        t.start()
        t.join()
    other()
    assert got == ["refused", "in"]
    assert state.next_revision(tmp_path).name == "0001"


def test_batches_and_actions(spark):
    accounts = spark.createDataFrame([(f"a{i}", i) for i in range(5)], "account string, ord int")
    assert [tuple(r) for r in state.batches(accounts, 2).orderBy("batch_index").collect()] == [(1, ["a0", "a1"]), (2, ["a2", "a3"]), (3, ["a4"])]
    planned = spark.createDataFrame([(i, "h") for i in range(1, 7)], "batch_index long, items_sha256 string")
    old = [(1, "completed", "SUCCEEDED", "h", "r"), (2, "completed", "SUCCEEDED", "other", "r"), (3, "launch_unknown", None, None, None), (4, "waiting", "RUNNING", None, "r"), (5, "waiting", "FAILED", None, "r")]
    got = state.batch_action(planned, spark.createDataFrame(old, "batch_index long, checkpoint string, status string, items_sha256 string, run_id string"))
    assert {r.batch_index: r.action for r in got.collect()} == {1: "skip", 2: "wait", 3: "refuse", 4: "wait", 5: "start", 6: "start"}


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    row = lambda i, n: json.dumps({"id": str(i), "input": "A", "playCount": n}) + "\n"
    (src / "1.jsonl").write_text(row(1, 5) + row(2, 6) + '{"error": "x"}\n')
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    assert ingest.ingest(spark, str(src), out, mark) == 1
    (src / "2.jsonl").write_text(row(1, 9) + row(3, 7))
    assert ingest.ingest(spark, str(src), out, mark) == 1 and ingest.ingest(spark, str(src), out, mark) == 0
    assert {r.post_id: r.views for r in ingest.posts(spark, out).collect()} == {"1": 5, "2": 6, "3": 7}


def test_command_line(tmp_path, capsys):
    assert cli.main(["valdate"]) == 2 and "validate" in capsys.readouterr().err
    assert cli.main(["--root", str(tmp_path), "init"]) == 0
    assert cli.main(["--root", str(tmp_path), "status"]) == 0
    assert json.loads(capsys.readouterr().out) == dict.fromkeys(cli.AREAS, 0)
    assert cli.main([]) == 2


def test_first_line_of_a_file_wins(spark, tmp_path):
    src, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    src.mkdir()
    (src / "a.jsonl").write_text("".join(json.dumps({"id": "1", "input": "A", "text": t}) + "\n" for t in ("zzz first line", "aaa second line", "mmm third")))
    ingest.ingest(spark, str(src), out, mark)
    assert [r.caption for r in ingest.posts(spark, out).collect()] == ["zzz first line"]
    (src / "0.jsonl").write_text(json.dumps({"id": "1", "input": "a", "text": "a late file"}) + "\n")
    ingest.ingest(spark, str(src), out, mark)
    assert [r.caption for r in ingest.posts(spark, out).collect()] == ["zzz first line"]


def test_state_of_first_payloads_over_batches_replays_and_late_files(spark, tmp_path):
    schema = "account string, post_id string, payload string, file string, line long"
    batches = [
        [("A", "1", "x", "f1", 2), ("a", "1", "y", "f1", 10), ("A", "2", "p", "f1", 3), ("B", "1", None, "f1", 4), ("A", "3", "s", "f2", 1), ("A", "3", "r", "f1", 9)],
        [("A", "1", "x", "f1", 2), ("a", "1", "y", "f1", 10), ("A", "2", "p", "f1", 3)],  # the first batch's rows again
        [("A", "2", "q", "f0", 1), ("C", "9", "new", "f0", 2), ("B", "1", None, "f0", 3)],  # a file that sorts before, but comes late
    ]
    source = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        for _ in range(2):  # a second run finds nothing new
            ingest.deduplicate(spark, spark.readStream.schema(schema).parquet(source), ["file", "line"], str(tmp_path / "out"), str(tmp_path / "mark"))
    got = sorted(tuple(r) for r in ingest.outcome(spark, str(tmp_path / "out")).collect())
    assert got == [("a", "1", "x", 4, True), ("a", "2", "p", 3, True), ("a", "3", "r", 2, True), ("b", "1", None, 2, False), ("c", "9", "new", 1, False)]


def test_a_finished_batch_is_taken_once(spark, tmp_path):
    places = [str(tmp_path / n) for n in ("in", "out", "mark")]
    batch = lambda *items: spark.createDataFrame([(json.dumps(x),) for x in items], "raw_json string")
    one = batch({"id": "1", "input": "A", "text": "first"}, {"id": "2", "input": "A", "text": "two"}, {"error": "gone"})
    digest = ingest.take_batch(one, 1, *places)
    assert ingest.take_batch(one.repartition(3), 1, *places) == digest  # again, dealt otherwise
    ingest.take_batch(batch({"id": "1", "input": "a", "text": "later"}, {"id": "3", "input": "B", "text": "three"}), 2, *places)
    assert len(os.listdir(tmp_path / "in")) == 2
    assert {(r.post_id, r.caption) for r in ingest.posts(spark, places[1]).collect()} == {("1", "first"), ("2", "two"), ("3", "three")}
    assert spark.read.parquet(f"{places[1]}/batch=*").count() == 4


def test_a_run_that_ended_after_publishing_finds_its_revision(tmp_path):
    lineage = {"run_id": "r", "inputs": "i"}
    for name, told in (("0001", {"pipeline": {"run_id": "other", "inputs": "i"}}), ("0002", {"pipeline": lineage}), ("0003", {})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(json.dumps(told))
    (tmp_path / "0004").mkdir()
    assert state.published_by(tmp_path, lineage).name == "0002" and state.published_by(tmp_path, {"run_id": "r", "inputs": "changed"}) is None
