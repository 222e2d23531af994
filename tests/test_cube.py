"""Counts of many column sets against counts of each by itself."""

import random
from collections import Counter
from itertools import combinations

import pytest

from stratalens.functions import cube


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(rng.choice([None, 0, 1]), rng.choice(["x", "y", None]), i if i % 50 else None, rng.randint(0, 40), i % 7) for i in range(600)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "a int, `b.c` string, id int, d int, e int")


def test_counts_of_all_sets(df, rows, monkeypatch):
    names = df.columns
    sets = [s for k in range(4) for s in combinations(names, k)]
    for at_once, few in ((12, 0), (2, 0), (12, 8)):
        monkeypatch.setattr(cube, "AT_ONCE", at_once)
        monkeypatch.setattr(cube, "FEW_COLUMNS", few)
        c = cube.Cube(df, sets)
        assert len(c.roots) == 1 if few else 1 <= len(c.roots) < 12
        for s in sets[:: 1 if at_once == 12 else 5]:
            order = [x for x in c.columns if x in s]
            found = Counter({tuple(r[c.number(x)] for x in order): r["n"] for r in c.table(s).collect()})
            assert found == Counter(tuple(r[names.index(x)] for x in order) for r in rows), s
        plain = cube.Cube(df, sets, weighed=False)
        for s in sets[:: 3]:
            assert plain.table(s).count() == len({tuple(r[names.index(x)] for x in s) for r in rows}), s
    held = c.complete(("a", "b.c")).collect()
    assert sum(r["n"] for r in held) == sum(r[0] is not None and r[1] is not None for r in rows)


def test_scans_do_not_grow_with_the_sets(spark, df, tmp_path):
    df.write.parquet(f"{tmp_path}/t")
    source = spark.read.parquet(f"{tmp_path}/t")
    scans = []
    cube_few, cube.FEW_COLUMNS = cube.FEW_COLUMNS, 0
    for sets in (list(combinations(df.columns, 2)), [("a",), ("a", "e"), ("a", "b.c"), ("b.c",), ("e",), ("d",)]):
        c = cube.Cube(source, sets)
        every = cube.union_of([c.table(s).selectExpr("count(1) AS k", "sum(n) AS n") for s in sets])
        assert {r["n"] for r in every.collect()} == {600}
        every = cube.union_of([c.table(s).selectExpr("count(1) AS k", "sum(n) AS n") for s in sets])
        every.collect()
        plan = every._jdf.queryExecution().executedPlan().toString()
        plan = plan.split("== Initial Plan ==")[0]
        scans.append(plan.count("FileScan parquet") )
        assert "ReusedExchange" in plan
    cube.FEW_COLUMNS = cube_few
    assert scans == [1, 1]
