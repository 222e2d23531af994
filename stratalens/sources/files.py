"""Numbers and hashes for the rows of Parquet sources that follow from the files alone, however Spark splits them.

A row's number is its place in its file, which the reader knows, after all rows of the files before it in the order of paths. The
files' first numbers are running sums over a table of one row per file. In the same way a source's hash is put together from one
sum per file, so that hashes of files that have not changed can be kept from one call to the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Nodes of a plan that hand on every row of the source at most once, and none other.
KEEPING = {"Project", "Filter", "SubqueryAlias", "View"}
#: Up to so many files are numbered on the driver, and up to so many are broadcast as two numbers each (some 60 MB).
LISTED_FILES, BROADCAST_FILES = 20_000, 2_000_000
#: Changed files that are named in a filter, by which Spark reads no others; with more the source is read whole.
NAMED_FILES = 10_000


def _source(df: DataFrame):
    """The relation at the bottom of df's plan if nothing above it repeats or mixes rows, and whether it stands alone."""
    plan, alone = df._jdf.queryExecution().analyzed(), True
    while plan.nodeName() in KEEPING:
        plan, alone = plan.children().head(), False
    return (plan, alone) if plan.nodeName() == "LogicalRelation" else (None, False)


def metadata(df: DataFrame) -> Column | None:
    """The reader's metadata of each row, None if df is no Parquet source whose rows have numbers of their own."""
    if _source(df)[0] is None:
        return None
    try:
        found = df.metadataColumn("_metadata")
        df.select(found["row_index"])
    except AnalysisException:
        return None
    return found


def _before(rows: str) -> Column:
    """The sum over all files of smaller path; one row per file meets in this window."""
    return F.coalesce(F.sum(rows).over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")


def first_numbers(df: DataFrame, meta: Column, files: int, key: Callable[[Column], Column]) -> tuple[DataFrame, Callable[[Column], Column]]:
    """(_file, _first) of every file, and the function of a path that gives _file: key, or the path itself where two keys are equal."""
    spark = df.sparkSession
    table = df.groupBy(meta["file_path"].alias("path")).agg((F.max(meta["row_index"]) + 1).alias("rows"))
    if files <= LISTED_FILES:
        named = sorted((r["path"], r["rows"]) for r in table.collect())
        firsts, total = [], 0
        for path, rows in named:
            firsts.append((path, total))
            total += rows
        table = spark.createDataFrame(firsts, "path string, _first bigint")
    else:
        table = table.select("path", _before("rows").alias("_first"))
    found = table.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key(F.col("path"))).alias("keys")).first()
    if found["keys"] < found["n"]:
        key = lambda path: path
    return table.select(key(F.col("path")).alias("_file"), "_first"), key


def numbered(df: DataFrame, name: str, key: Callable[[Column], Column] = F.xxhash64, broadcast: int = BROADCAST_FILES) -> DataFrame | None:
    """df with a column `name` that numbers the source's rows by path and place in the file; None if df is no Parquet source.

    Files are told apart by a hash of their path, so that the broadcast table is small; if two paths hash alike, by the path. With
    over `broadcast` files the two sides are joined by a sort. A filter leaves gaps, and a file changes the numbers of later files only
    by how many rows it gives.
    """
    meta = metadata(df)
    if meta is None:
        return None
    files = len(df.inputFiles())
    if files <= 1:
        return df.select("*", meta["row_index"].cast("bigint").alias(name))
    firsts, key = first_numbers(df, meta, files, key)
    firsts = F.broadcast(firsts) if files <= broadcast else firsts.hint("merge")
    # df's columns go as one, as they may have any name
    rows = df.select(F.struct("*").alias("row"), meta["row_index"].alias("place"), key(meta["file_path"]).alias("of"))
    joined = rows.join(firsts, F.col("of") == F.col("_file"))
    return joined.select(*(F.col("row")[c].alias(c) for c in df.columns), (F.col("_first") + F.col("place")).cast("bigint").alias(name))


#: (path, size, modified) names a version of a file; rows are those that df gives, last is one more than the last place, sum their hashes'.
FILE_STATE = "source string, path string, size bigint, modified timestamp, rows bigint, last bigint, sum decimal(38,0)"


def _hashed(df: DataFrame, meta: Column, cells: list[Column]) -> DataFrame:
    version = [meta[c].alias(n) for c, n in (("file_path", "path"), ("file_size", "size"), ("file_modification_time", "modified"))]
    sums = [F.count(F.lit(1)).alias("rows"), (F.max(meta["row_index"]) + 1).alias("last"), F.sum(F.xxhash64(meta["row_index"], *cells).cast("decimal(38,0)")).alias("sum")]
    return df.groupBy(*version).agg(*sums)


def source_hash(df: DataFrame, meta: Column, cells: list[Column], state: str | None = None, source: str = "") -> tuple[str, int, int]:
    """A hash of all rows in their order, the number of rows, and of how many files the rows were read.

    With `state`, a folder, the sums of files are kept there as a table under the name `source`. Files of unchanged path, size
    and modification time are then not read again, apart from their footers; it takes a source that is read as it is, without
    filters or projections, and is added to by each call that meets new files.
    """
    spark = df.sparkSession
    if state is None:
        table = _hashed(df, meta, cells)
        read = len(df.inputFiles())
    else:
        if not _source(df)[1]:
            raise ValueError("hashes of files are kept for sources that are read as they are")
        table, read = _with_state(df, meta, cells, state, source)
    table = table.select(_before("last").alias("first"), "rows", "sum")
    found = table.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.xxhash64("first", "rows", "sum").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return str(found["h"]), found["n"], read


def _with_state(df: DataFrame, meta: Column, cells: list[Column], state: str, source: str) -> tuple[DataFrame, int]:
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(state)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    kept = spark.read.schema(FILE_STATE).parquet(state) if there else spark.createDataFrame([], FILE_STATE)
    version = ["path", "size", "modified"]
    # two calls at once may both have added a file; they have added the same
    kept = kept.where(F.col("source") == source).drop("source").dropDuplicates(version)
    here = df.groupBy(meta["file_path"].alias("path"), meta["file_size"].alias("size"), meta["file_modification_time"].alias("modified")).agg(F.lit(1).alias("_here")).drop("_here")
    new = here.join(kept, version, "left_anti").select("path").limit(NAMED_FILES + 1).collect()
    if new:
        part = df.where(meta["file_path"].isin([r["path"] for r in new])) if len(new) <= NAMED_FILES else df
        added = _hashed(part, meta, cells).join(kept, version, "left_anti")
        added.select(F.lit(source).alias("source"), *version, "rows", "last", "sum").write.mode("append").parquet(state)
        kept = spark.read.schema(FILE_STATE).parquet(state).where(F.col("source") == source).drop("source").dropDuplicates(version)
    # files that have gone or changed stay in the table and are passed over
    return kept.join(here, version, "left_semi"), len(new)
