"""Compressed position sets, and absent combinations without multiplying domains."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

import stratalens as st
from stratalens.context import POSITION
from stratalens.functions import blocks
from stratalens.operators import pairs


def test_blocks_of_positions(spark):
    rng = random.Random(2)
    sets = [[], [0], [0, 1, 2], list(range(32760, 32780)), sorted(rng.sample(range(200_000), 5000)), [1 << 40, (1 << 40) + 7], [32767, 32768, 65535, 65536]]
    for numbers in sets:
        rows = spark.createDataFrame([(n,) for n in [*numbers, *numbers[:3]]], f"{POSITION} bigint")
        made = blocks.compressed(rows, POSITION)
        assert sorted(r[0] for r in blocks.expanded(made, POSITION).collect()) == numbers
        if numbers and len(numbers) < 5000:
            near = sorted({m for n in numbers for m in (n - 1, n, n + 1, n + 8) if m >= 0})
            found = blocks.within(spark.createDataFrame([(n,) for n in near], f"{POSITION} bigint"), made, POSITION)
            assert sorted(r[0] for r in found.collect()) == numbers
    runs = blocks.compressed(spark.range(40_000, 3_000_000).select(F.col("id").alias(POSITION)), POSITION)
    assert runs.where("bits is not null").count() == 0 and runs.agg(F.sum("n")).first()[0] == 2_960_000


def test_a_scope_of_a_million_rows_through_a_table(spark, tmp_path):
    df = spark.range(0, 1_500_000, 1, 4).select((F.col("id") % 7).alias("a"), (F.col("id") % 3 == 0).alias("third"), F.when(F.col("id") % 2 == 0, 1).alias("even"))
    df.write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    scope = st.Scope.where(df, "not third", name="two thirds")
    result = st.missingness(df, features=["even"], scope=scope)
    with pytest.raises(ValueError):
        result.recompute(df)  # neither listed nor saved
    kept = scope.save(f"{tmp_path}/scope")
    result = st.missingness(df, features=["even"], scope=kept)
    again = st.Result.from_dict(json.loads(json.dumps(result.to_dict())))
    assert again["scope"]["evaluated_rows"] == 1_000_000 and again["scope"]["selection_positions"] is None
    assert again["availability"][0]["populated"] == 500_000
    assert again.recompute(df)["availability"] == result["availability"]
    found = again.select(df, again.findings[0]["id"])
    assert found.rows.count() == 500_000 and found.parent == "two thirds"


@pytest.mark.parametrize("most", [None, 1, 5, 37, 1000])
def test_absent_combinations_against_all(spark, most):
    rng = random.Random(5)
    pick = lambda n: rng.choice([None, *range(n)])
    seen = {(pick(12), pick(9)) for _ in range(60)} | {(3, b) for b in (None, *range(9))}
    ever = seen | {(40, 2), (5, 41)}
    a, b = [*range(-2, 13), None, 40], [*range(11), 41, None]
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    cells, whole = frame([(x, y, 1) for x, y in seen], "a int, b int, n int"), frame([(x, y, 1) for x, y in ever], "a int, b int, n int")
    found = pairs.absent_table(cells, frame([(x,) for x in [*a, 3]], "a int"), frame([(x,) for x in b], "b int"), whole, most)
    key = lambda r: tuple((x is None, x or 0) for x in r[:2])
    here = [{x[i] for x in seen} for i in (0, 1)]
    some = [{x[i] for x in ever} for i in (0, 1)]
    reason = lambda x, y: "within_observed_margins" if x in here[0] and y in here[1] else "level_absent_under_parent" if x in some[0] and y in some[1] else "zero_support"
    want = sorted(((x, y, reason(x, y)) for x, y in itertools.product(a, b) if (x, y) not in seen), key=key)
    assert sorted((tuple(r) for r in found.collect()), key=key) == want[:most]


def test_first_absent_of_large_domains(spark):
    cells = spark.range(300_000).select((F.col("id") % 100_000).alias("a"), ((F.col("id") * 7919) % 100_003).alias("b"), F.lit(1).alias("n"))
    found = pairs.absent_table(cells, cells.select("a"), cells.select("b"), most=1000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    rows = sorted((r["a"], r["b"]) for r in found.collect())
    seen = {0: {(7919 * k * 100_000) % 100_003 for k in range(3)}}
    assert rows == [(0, b) for b in range(1010) if b not in seen[0]][:1000]
