"""Recipes, and deliveries whose missingness adds up."""

import pytest
from pyspark.sql import functions as F

import stratalens as st
from stratalens.operators.deliveries import SignatureState
from stratalens.operators.relate import side_table
from stratalens.streaming.deliveries import record_batches

ROWS = [(i, None if i % 3 == 0 else i, "x" if i % 4 else "", float("nan") if i % 5 == 0 else 1.0, i % 2) for i in range(60)]
SCHEMA = "id int, a int, b string, f double, day int"


def counts(table):
    return sorted((r["feature"], r["populated"], r["missing"], r["denominator"]) for r in table.collect())


def full(df):
    r = st.missingness(df, features=["a", "b", "f"], missing={"b": [""]})
    return sorted((x["feature"], x["populated"], x["missing"], x["denominator"]) for x in r["availability"])


def test_old_and_new_add_up(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    state = SignatureState(spark, f"{tmp_path}/s", df.schema, ["a", "b", "f"], missing={"b": [""]})
    assert state.availability().count() == 0
    old, new = df.where("id < 40"), df.where("id >= 40")
    state.record("2024-01", old)
    state.record("2024-02", new.limit(3))  # the job failed after some rows, and runs again
    state.record("2024-02", new)
    again = SignatureState(spark, f"{tmp_path}/s", df.schema, ["a", "b", "f"], missing={"b": [""]})
    assert counts(again.availability()) == full(df) and counts(again.availability(["2024-01"])) == full(old)
    change = {r["feature"]: r["delta"] for r in again.changes(["2024-01"], ["2024-02"]).collect()}
    other = st.compare(*(st.missingness(x, features=["a", "b", "f"], missing={"b": [""]}) for x in (old, new)))
    assert {r["feature"]: r["populated_fraction_delta"] for r in other["changes"]} == pytest.approx(change)
    with pytest.raises(ValueError):
        state.record("a/b", df)
    with pytest.raises(KeyError):
        SignatureState(spark, f"{tmp_path}/s", df.schema, ["none"])


def test_stream_that_is_stopped_and_started_with_late_rows(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    state = SignatureState(spark, f"{tmp_path}/s", df.schema, ["a", "b", "f"], by=["day"], missing={"b": [""]})

    def run():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = record_batches(stream, state).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination(120)

    df.where("day = 0 and id < 30").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    df.where("day = 1").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    df.where("day = 0 and id >= 30").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")  # of a day that has been
    run()
    run()
    assert counts(state.availability()) == full(df)
    found = {(r["day"], r["feature"]): (r["populated"], r["denominator"]) for r in state.by_context().collect()}
    for day in (0, 1):
        assert {c: found[day, c] for c in "abf"} == {c: (n, d) for c, n, _, d in full(df.where(F.col("day") == day))}
    # a batch that runs again replaces itself
    before = counts(state.availability())
    state.record("batch-1", state.spark.read.schema(df.schema).parquet(f"{tmp_path}/in").where("day = 1"))
    state.record("batch-0", state.spark.read.schema(df.schema).parquet(f"{tmp_path}/in").where("day = 0 and id < 30"))
    assert counts(state.availability()) == before


def test_recipe_faults(tmp_path):
    assert st.Recipe("levels", {"top_n": 2}, "a note").to_dict() == {"version": "1.0", "operation": "levels", "parameters": {"top_n": 2}, "notes": "a note"}
    st.Recipe("paths").save(tmp_path / "r.json")
    assert st.Recipe.load(tmp_path / "r.json") == st.Recipe("paths")
    assert len(st.Recipe.operations()) == 13
    for wrong in ({"operation": "other"}, {"operation": "levels", "version": "2"}, {"operation": "levels", "parameters": {"scope": 1}}, {"operation": "levels", "parameters": {"timeout": 1}}, {"operation": "levels", "parameters": {"x": float("nan")}}):
        with pytest.raises(ValueError):
            st.Recipe(**wrong)
    with pytest.raises(TypeError):
        st.Recipe("levels", {"x": object()})


def test_keys_of_a_side_with_one_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("string").alias("k"), (F.col("id") % 7).cast("string").alias("v"), F.when(F.col("id") % 2 == 0, "w").alias("w"))
    table = side_table(df, [F.col("k")], [F.col("v"), F.col("w")])
    assert "Expand" not in table._jdf.queryExecution().executedPlan().toString()
    found = {r["key"][0]: (r["n"], r["d0"], r["d1"], r["v1"]) for r in table.collect()}
    assert found["0"] == (1000, 2, 1, "w") and found["1"] == (1, 1, 0, None) and found["2"] == (1, 1, 1, "w") and len(found) == 2001
