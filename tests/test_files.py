"""Positions and hashes of rows over many files, under different splits."""

import pytest
from pyspark.sql import functions as F

import stratalens as st
from stratalens import context
from stratalens.sources import files


@pytest.fixture
def source(spark, tmp_path):
    """Five files of different sizes whose rows know the number that they should get, and a reader with a given split size."""
    n, sizes = 0, {"e": 40, "a": 3000, "c": 1, "b": 900, "d": 2500}
    starts = {}
    for name in sorted(sizes):
        starts[name] = n
        n += sizes[name]
    for name, rows in sizes.items():  # written in another order than that of their names
        df = spark.range(starts[name], starts[name] + rows, 1, 1).select(F.col("id").alias("want"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
        df.coalesce(1).write.option("parquet.block.size", 20_000).parquet(f"{tmp_path}/{name}")

    def read(split="128m", names="abcde"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", split)
        return spark.read.parquet(*(f"{tmp_path}/{x}" for x in names))

    yield read
    for k in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{k}")


def test_numbers_under_two_split_sizes(source):
    for split in ("128m", "30k"):
        df = source(split)
        parts = df.rdd.getNumPartitions()
        assert parts < 6 if split == "128m" else parts > 8
        rows = context.positioned(df).select("want", context.POSITION).collect()
        assert len(rows) == 6441 and all(r["want"] == r[context.POSITION] for r in rows)


def test_numbers_when_paths_hash_alike_or_are_too_many(source, monkeypatch):
    for options in ({"key": lambda path: F.length(path) * 0}, {"broadcast": 2}):
        found = files.numbered(source("30k"), "_n", **options)
        assert found.where("want <> _n or _n is null").count() == 0 and found.count() == 6441
    monkeypatch.setattr(files, "LISTED_FILES", 2)
    found = files.numbered(source("30k"), "_n")
    assert found.where("want <> _n").count() == 0 and found.count() == 6441
    plan = files.numbered(source("30k"), "_n", broadcast=2)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


def test_numbers_of_filtered_and_renamed_rows(source):
    df = source("30k").where("want % 3 = 1").select(F.col("want").alias("_metadata"), F.lit(1).alias("_place"))
    rows = context.positioned(df).collect()
    places = [r[context.POSITION] for r in rows]
    assert len(rows) == 2147 and len(set(places)) == len(rows)
    assert [r["_metadata"] for r in sorted(rows, key=lambda r: r[context.POSITION])] == sorted(r["_metadata"] for r in rows)


def test_plans_that_repeat_rows_keep_the_read_order(spark, source):
    df = source()
    twice = df.withColumn("again", F.explode(F.array(F.lit(1), F.lit(2))))
    assert files.metadata(twice) is None and files.metadata(df.join(df.select(F.col("want").alias("w")), F.col("want") == F.col("w"))) is None
    assert files.metadata(spark.range(3)) is None and files.metadata(df.groupBy("want").count()) is None
    numbers = context.positioned(twice).select(context.POSITION).distinct().count()
    assert numbers == 2 * 6441


def test_a_saved_scope_fits_the_same_files_under_other_splits(source):
    scope = st.Scope.where(source("128m"), "want % 1000 = 7")
    df = source("30k")
    assert st.fingerprint(df) == scope.dataset_id
    result = st.levels(df, ["want"], scope=scope)
    assert result["scope"]["selection_positions"] == [7, 1007, 2007, 3007, 4007, 5007, 6007]


def test_hashes_of_files_are_kept(source, tmp_path):
    state = f"{tmp_path}/state"
    first = source(names="abce")
    name = st.fingerprint(first, state=state)
    assert name == st.fingerprint(first)
    more = source("30k")
    meta = files.metadata(more)
    cells = [F.col("want"), F.col("text")]
    kept = f"{tmp_path}/kept"
    assert files.source_hash(first, files.metadata(first), cells, kept, "x")[2] == 4
    found = files.source_hash(more, meta, cells, kept, "x")
    assert found[2] == 1 and found[:2] == files.source_hash(more, meta, cells)[:2]
    assert files.source_hash(more, meta, cells, kept, "x")[2] == 0
    assert files.source_hash(more, meta, cells, kept, "other columns")[2] == 5
    fewer = source(names="ad")  # files that have gone are passed over
    assert files.source_hash(fewer, files.metadata(fewer), cells, kept, "x") == (*files.source_hash(fewer, files.metadata(fewer), cells)[:2], 0)
    assert st.fingerprint(more, state=state) == st.fingerprint(more) != name
    assert st.levels(more, ["text"], max_levels=1, identify=state)["source"]["dataset_id"] == st.fingerprint(more)
    with pytest.raises(ValueError):
        st.fingerprint(more.where("want > 3"), state=state)
