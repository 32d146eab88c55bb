"""The provider source: pages, positions, and bounds that reach the pages."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tessella.sources import provider

SCHEMA = "account string, created_at string, item string, position int"


def rows(n=400, seed=1):
    r = random.Random(seed)
    out = [(f"a{min(r.randrange(9), 4)}", f"2024-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", json.dumps({"id": i, "text": 'é\n" '}), 7) for i in range(n)]
    return out + [(None, "2024-05-05", "{}", 1), ("a1", None, "{}", 1), ("a1", None, "{}", 1), ("a2", "2024-06-01", None, 1), ("z z", "2024-06-01", "", 1)]


def positions(data):
    """account -> items newest first, as the module says."""
    key = lambda r: (r[1] is not None, r[1] or "")
    out = []
    for account, group in itertools.groupby(sorted(data, key=lambda r: (r[0] is not None, r[0] or "")), key=lambda r: r[0]):
        ordered = sorted(sorted(group, key=lambda r: (r[2] is not None, (r[2] or "").encode())), key=key, reverse=True)
        out += [(account, i, r[1], r[2]) for i, r in enumerate(ordered, 1)]
    return out


@pytest.fixture(scope="module")
def dataset(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("provider") / "d")
    provider.publish(spark.createDataFrame(rows(), SCHEMA), folder, page_items=7, part_bytes=4000)
    return folder


BOUNDS = [
    {}, {"accounts": ["a1", "z z"]}, {"accounts": []}, {"max_posts": 3}, {"oldest": "2024-03-04"}, {"newest": "2024-03-04"}, {"accounts": ["a4"], "max_posts": 40, "oldest": "2024-02-01", "newest": "2024-11-30"}, {"max_posts": 0},
]


@pytest.mark.parametrize("bounds", BOUNDS)
def test_bounds_give_what_filtering_all_items_gives(spark, dataset, bounds):
    got = provider.requested(provider.items(spark, dataset), **bounds).collect()
    b = {"accounts": None, "max_posts": None, "oldest": None, "newest": None} | bounds
    want = [
        r for r in positions(rows())
        if (b["accounts"] is None or r[0] in b["accounts"]) and (b["max_posts"] is None or r[1] <= b["max_posts"]) and (b["oldest"] is None or (r[2] is not None and r[2] >= b["oldest"])) and (b["newest"] is None or (r[2] is not None and r[2] <= b["newest"]))
    ]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_bounds_leave_out_parts_and_pages(dataset):
    def left(*bounds):
        reader = provider.ProviderReader(dataset)
        reader.bounds = list(bounds)
        parts = [p.part for p in reader.partitions()]
        return len(parts), sum(len(reader.pages(p)) for p in parts)

    parts, pages = left()
    assert parts > 5 and pages > 50
    some, few = left(("account", "=", "a0"))
    assert some < parts / 2 and few < pages / 4
    assert left(("position", "<=", 3))[1] <= 7
    assert left(("created_at", ">=", "2025-01-01"))[1] == 0 and left(("created_at", ">=", "2024-12-01"))[1] < pages / 2
    assert left(("account", "in", ["nobody"])) == (1, 0)


def explained(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_predicates_are_in_the_plan_and_spark_filters_nothing_again(spark, dataset):
    plan = explained(provider.requested(provider.items(spark, dataset), ["a1"], 5, "2024-01-01"))
    pushed = next(x for x in plan.splitlines() if "PushedFilters" in x)
    assert all(x in pushed for x in ("position", "5", "created_at", "2024-01-01", "account", "a1")) and "Filter" not in plan.replace("PushedFilters", "").replace("RuntimeFilters", "")
    other = provider.items(spark, dataset).where(F.col("item").contains("id") & (F.col("position") <= 2))
    assert "Filter (" in explained(other) and other.count() > 0


def test_empty_dataset(spark, tmp_path):
    provider.publish(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"))
    assert provider.requested(provider.items(spark, str(tmp_path / "e")), max_posts=3).count() == 0
