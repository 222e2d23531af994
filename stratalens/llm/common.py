"""Helpers shared by the corpus operators: scratch tables, word rules, skew-safe running sums."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A word is a run of anything but these six ASCII white-space characters.
WORD_SEPARATORS = "\\x20\\x09-\\x0D"

#: Texts that a Python worker turns into objects of its own at a time.
ROWS = 256

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only in local mode with none set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Scratch tables that stand: the JVM, a weak reference to the table's list of files in it, the table's path, and how to delete it.
_standing: list[tuple] = []


def sweep(spark: SparkSession) -> None:
    """Remove the scratch tables that no plan reads any more.

    Every DataFrame that is derived from a table, and every query that runs on it, holds the table's list of files; once the JVM
    has collected that list, nobody can ask for the table again.
    """
    for entry in list(_standing):
        jvm, files, path, delete = entry
        if jvm is not spark.sparkContext._gateway:  # of a JVM that has ended, which removed its tables
            _standing.remove(entry)
        elif files.get() is None:
            _standing.remove(entry)
            delete(path, True)


def cut(df: DataFrame, options: dict | None = None) -> DataFrame:
    """Write df as a table in the shared scratch folder, with options of Spark's writer, and read it back.

    This cuts the lineage, so a lost executor costs a reread and not the work before it. Once the table stands
    nothing needs the shuffles that made it, so Spark is told to remove their files. The table goes at some later cut() when
    nothing refers to it any more, at the latest when the driver's JVM ends.
    """
    spark = df.sparkSession
    sweep(spark)
    path = f"{scratch_dir(spark)}/scratch-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.options(**options or {}).parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = where.getFileSystem(spark._jsc.hadoopConfiguration())
    folder.deleteOnExit(where)
    table = spark.read.schema(df.schema).parquet(path)
    files = table._jdf.queryExecution().analyzed().relation().location()
    _standing.append((spark.sparkContext._gateway, spark._jvm.java.lang.ref.WeakReference(files), where, folder.delete))
    return table


@contextmanager
def batches_of(spark: SparkSession, size: int):
    """What runs inside hands rows to Python in Arrow batches of about `size` bytes (a larger row alone).

    A batch lies outside the executor's heap twice, as vectors and as bytes to be sent, each in a buffer that grows by doubling, and
    by default has up to 10,000 rows.
    """
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(size))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def keyed(docs: DataFrame) -> DataFrame:
    """docs as a scratch table with _row, a number of its own for every row."""
    return cut(docs.withColumn("_row", F.monotonically_increasing_id()))


def chosen(rows: DataFrame, numbers: DataFrame, most: int = 1 << 14) -> DataFrame:
    """The rows of a scratch table whose _row is in the one column of numbers; the rows stay where they are.

    The numbers become bitmaps of 32,768 rows each, one bit a row, which up to `most` bitmaps (64 MB) are broadcast; the
    texts, which may be as large as the input, are not shuffled to drop some of them.
    """
    n = F.col(numbers.columns[0])
    dealt = numbers.select(F.shiftright(n, 15).alias("_block"), n.bitwiseAND(F.lit(32767)).alias("_at")).repartition("_block")
    blocks = cut(dealt.groupBy("_block").agg(F.bitmap_construct_agg("_at").alias("_bits")))
    if blocks.count() <= most:
        blocks = F.broadcast(blocks)
    at = F.col("_row").bitwiseAND(F.lit(32767)).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), at.bitwiseAND(F.lit(7)) + 1))
    joined = rows.join(blocks, F.shiftright("_row", 15) == F.col("_block"))
    return joined.where(bit > 0).select(*(F.col(f"`{c}`") for c in rows.columns))


def word_count(text: Column) -> Column:
    """Number of words, 0 for null: each word shrinks to one letter, then what is left is measured."""
    marks = F.regexp_replace(text, f"[{WORD_SEPARATORS}]*+[^{WORD_SEPARATORS}]++", "x")
    return F.coalesce(F.length(F.regexp_replace(marks, f"[{WORD_SEPARATORS}]++", "")), F.lit(0)).cast("long")


def slices(batches, rows: int = ROWS):
    """The Arrow batches in slices, so that what a worker holds besides the batch does not grow with the batch."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def field(name: str, kind: T.DataType | str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind) if isinstance(kind, str) else kind)


def unit_hash(*parts: Column) -> Column:
    """A reproducible number in [0, 1) from 52 bits of the MD5 of the parts."""
    digest = F.md5(F.concat_ws(",", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def running_sums(df: DataFrame, group: str, order: Column, ties: list[Column], measures: list[str], rows: int, most: int = 20_000) -> DataFrame:
    """Add before_<m>, the sum of m over the rows of the group that come earlier, and before_rows, their number.

    order must be a number in [0, 1) that is spread evenly. Each group is dealt into ranges of order with about
    `rows` rows each (more once there would be over `most` ranges in all), so a group that holds a third of the
    table is sorted by many tasks; the ranges' totals are a small table whose running sums are joined back.
    df is read twice and should come from cut().
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    total = df.count()
    step = max(rows, total // most + 1)
    sizes = sizes.select(F.col(group).alias("_g"), F.ceil(F.col("_n") / step).cast("int").alias("_k"))
    # the number of groups is that of configured sources or of distinct lengths, so Spark may broadcast this side
    dealt = (
        df.withColumn("_order", order)
        .join(sizes, F.col(group).eqNullSafe(F.col("_g")), "left")
        .withColumn("_part", F.floor(F.col("_order") * F.col("_k")).cast("int"))
        .drop("_g", "_k")
    )
    parts = dealt.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(
        *(F.sum(m).alias(f"_sum_{m}") for m in measures), F.count(F.lit(1)).alias("_sum_rows")
    )
    earlier = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    names = [*measures, "rows"]
    parts = parts.select("_g", "_p", *(F.coalesce(F.sum(f"_sum_{m}").over(earlier), F.lit(0)).alias(f"_base_{m}") for m in names))
    inside = Window.partitionBy(group, "_part").orderBy("_order", *ties).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("_one", F.lit(1).cast("long"))
    dealt = dealt.withColumns({f"_in_{m}": F.coalesce(F.sum("_one" if m == "rows" else m).over(inside), F.lit(0)) for m in names})
    joined = dealt.join(parts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")), "left")
    return joined.select(*df.columns, "_order", *((F.col(f"_base_{m}") + F.col(f"_in_{m}")).cast("long").alias(f"before_{m}") for m in names))
