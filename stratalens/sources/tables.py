"""Reading tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalens.functions.values import kind_of, normalised, quoted


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def normalise(df: DataFrame, missing: dict | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The analysed columns with missing values as nulls, without positions, and their kinds; one lazy projection."""
    fields = [f for f in df.schema.fields if kind_of(f.dataType)]
    kinds = {f.name: kind_of(f.dataType) for f in fields}
    return df.select(*(normalised(quoted(f.name), f.dataType, (missing or {}).get(f.name, ())).alias(f.name) for f in fields)), kinds
