"""Operators whose whole result SQL can express, against it on the smallest tables."""

import os

import duckdb
import pytest

from tessella.llm import queries

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    sql = duckdb.connect()
    for t in TABLES:
        sql.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    r = sql.execute(queries.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    assert sorted(tuple(map(str, x)) for x in df.select(*columns).collect()) == sorted(tuple(str(x[names.index(c)]) for c in columns) for x in r.fetchall())


def test_pipeline_counts_as_a_query(spark):
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and {f"op{n}" for n in range(1, 14)} <= {q.split("_")[0] for q in entry.queries()}
