import hashlib
import random

import pytest

import corpus_pipeline as P
from tessella.llm import bpe, quality, secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_last_stages_on_a_fixture(spark, tmp_path):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    good = lambda n: " ".join(word() for _ in range(n)) + "."
    bad = lambda n: " ".join(word().upper() + "!!%%" for _ in range(n))
    item = good(20)
    rows = [(i, good(r.randint(60, 120))) for i in range(60)]
    rows += [(100 + i, bad(r.randint(60, 120))) for i in range(30)]
    rows += [(200, rows[3][1]), (201, rows[4][1] + " more")]
    rows += [(210, good(40) + " " + item + " " + good(40))]
    rows += [(220, good(50) + " token = \"a9f3c2d4e5b60718293a4b5c6d7e8f90\" " + good(10)), (230, None), (231, "")]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, _ in rows[:90]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d, sf = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    seen = []
    for name, stage in P.STAGES[:-1]:
        d = stage(spark, d, sf)
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        seen.append({x.doc_id: x.text for x in d.collect()})
    assert not set(range(100, 130)) & set(seen[0]) and set(range(60)) <= set(seen[0])
    assert set(seen[0]) - set(seen[1]) <= {200, 201, 231} and {200, 201} & set(seen[1]) == set()
    assert set(seen[1]) - set(seen[2]) == {210}
    assert "a9f3c2" not in seen[3][220] and "[secret]" in seen[3][220]
    c = bpe.codec(bpe.default_path())
    want = sorted((i, hashlib.sha256(",".join(map(str, c.encode(t))).encode()).hexdigest()) for i, t in seen[3].items())
    got = sorted((x.doc_id, x.ids_sha256) for x in P.run(spark, sf).collect())
    assert got == want
    model = secrets.GuessCost()
    assert all(not secrets.scan(t, model) for t in seen[3].values())
    assert len(quality.statistics("")) == len(quality.FEATURES)


def test_rows_of_null_and_shared_ids(spark, tmp_path):
    r = random.Random(2)
    text = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    item, a, b, c = text(20), text(60), text(60), text(60)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def left(stage, rows):
        docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        return sorted(((x.doc_id, x.text) for x in got.collect()), key=str)

    hit = f"{a} {item} {b}"
    rows = [(None, hit), (None, a), (1, hit), (1, b), (2, c)]
    assert left(P.decontamination_stage, rows) == sorted([(None, a), (1, b), (2, c)], key=str)
    rows = [(None, a), (None, b), (1, a), (1, c), (2, f"{c} end"), (3, c)]
    assert left(P.near_duplicate_stage, rows) == sorted([(None, b), (1, a), (1, c)], key=str)


@pytest.mark.parametrize("names", [("_row_key", "_row_key_", "score", "found", "x", "component_id", "digest", "count"), ("_ROW_KEY",)])
def test_further_columns_stay_as_they_are(spark, tmp_path, names):
    r = random.Random(3)
    text = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)) + "."
    item, a = text(20), text(60)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    # keys of their own are given where ids repeat or are null
    texts = (a, text(60), f"{text(30)} password = hunter2hunter2 {text(30)}", a)
    d = spark.createDataFrame([(i, t, "en", "s", len(t), *[99 + k] * len(names)) for k, (i, t) in enumerate(zip((1, 1, None, 4), texts, strict=True))], f"{SCHEMA}, " + ", ".join(f"`{n}` int" for n in names))
    columns = d.columns
    for stage_name, stage in P.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == columns, stage_name
    got = d.collect()
    assert all({x[n] for n in names} == {x[names[0]]} for x in got) and sorted(x[names[0]] for x in got) == [99, 100, 101]
    assert P.tokens_stage(spark, d, str(tmp_path)).count() == 3
