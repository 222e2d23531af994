"""Sets of row positions as a table of blocks: a run of positions, or one bit for each.

A block covers the 32768 positions that Spark's bitmap functions put into one bucket, so a set has at most a row for so many
positions, and of a set of long stretches each row is but a few numbers. Rows are looked up by a semi-join over blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of each block its number, how many positions it has, the least and greatest of their places in it, and one bit for each unless they are a run.
BLOCKS = "block bigint, n bigint, first bigint, last bigint, bits binary"


def place(position: Column) -> tuple[Column, Column]:
    """The block of a position and its place there; positions are not negative, and buckets begin at 1."""
    return F.bitmap_bucket_number(position + 1), F.bitmap_bit_position(position + 1)


def compressed(rows: DataFrame, position: str) -> DataFrame:
    """The positions of rows as blocks; repeated ones count once."""
    block, at = place(F.col(position))
    placed = rows.select(block.alias("block"), at.alias("_at"))
    made = placed.groupBy("block").agg(F.bitmap_construct_agg("_at").alias("bits"), F.min("_at").alias("first"), F.max("_at").alias("last"))
    made = made.withColumn("n", F.bitmap_count("bits"))
    run = F.col("n") == F.col("last") - F.col("first") + 1
    return made.select("block", "n", "first", "last", F.when(~run, F.col("bits")).alias("bits"))


def expanded(blocks: DataFrame, position: str) -> DataFrame:
    """The positions of blocks, one to a row."""
    every = blocks.select("block", "bits", F.explode(F.sequence("first", "last")).alias("_at")).where(F.col("bits").isNull() | _set(F.col("bits"), F.col("_at")))
    return every.select(((F.col("block") - 1) * 32768 + F.col("_at")).cast("bigint").alias(position))


def _set(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.expr("1") == F.call_function("getbit", byte, (at % 8).cast("int")).cast("int")


def within(rows: DataFrame, blocks: DataFrame, position: str) -> DataFrame:
    """Those of rows whose position is in the set."""
    names = rows.columns
    block, at = place(F.col(position))
    placed = rows.select("*", block.alias("_block"), at.alias("_place"))
    held = blocks.select(F.col("block").alias("_b"), F.col("first").alias("_f"), F.col("last").alias("_l"), F.col("bits").alias("_bits"))
    inside = F.col("_place").between(F.col("_f"), F.col("_l")) & (F.col("_bits").isNull() | _set(F.col("_bits"), F.col("_place")))
    return placed.join(held, (F.col("_block") == F.col("_b")) & inside, "left_semi").select(*(F.col("`" + c.replace("`", "``") + "`") for c in names))
