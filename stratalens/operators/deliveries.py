"""Missingness of deliveries that add up: what is kept of each is the counts of its presence signatures.

The counts of two deliveries added are those of both together, so a new delivery is compared with all earlier ones, or joined to
them, without reading any of these again. Counts may be kept apart by the values of some columns (a day, a site); rows that
come late then add to the values that they belong to. Each delivery has a folder of its own that is written whole, so one that is
recorded again after a failure replaces what it has left.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.context import columns
from stratalens.functions.counts import rows_
from stratalens.functions.values import kind_of, normalised, quoted
from stratalens.operators.availability import availability_table, signature

NAME = re.compile(r"[A-Za-z0-9_.-]+")


class SignatureState:
    """Presence signatures of a table's deliveries, kept in a folder."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, features: Iterable[str] | None = None, by: Iterable[str] = (), missing: Mapping | None = None):
        """schema is that of every delivery; features are the columns whose presence is kept, by those that counts are kept apart by."""
        types = {f.name: f.dataType for f in schema.fields}
        self.features = list(types) if features is None else list(features)
        self.by = list(by)
        for c in [*self.features, *self.by]:
            if c not in types:
                raise KeyError(c)
            if kind_of(types[c]) is None:
                raise TypeError(f"Column {c!r}: unsupported value type {types[c].typeName()}")
        self.spark, self.folder, self.types, self.missing = spark, folder.rstrip("/"), types, dict(missing or {})
        fields = [*(T.StructField(f"_b{i}", types[c]) for i, c in enumerate(self.by)), T.StructField("signature", T.StringType()), T.StructField("n", T.LongType())]
        self.schema = T.StructType([*fields, T.StructField("delivery", T.StringType())])

    def record(self, delivery: str, df: DataFrame) -> None:
        """Keep the counts of a delivery in place of what was kept under its name."""
        if not NAME.fullmatch(delivery):
            raise ValueError("a delivery's name has letters, digits, _, . and - only")
        columns(df, [*self.features, *self.by])
        value = lambda c: normalised(quoted(c), self.types[c], self.missing.get(c, ()))
        rows = df.select(*(value(c).alias(f"_b{i}") for i, c in enumerate(self.by)), *(value(c).alias(f"_f{i}") for i, c in enumerate(self.features)))
        counts = rows.groupBy(*(f"_b{i}" for i in range(len(self.by))), signature([f"_f{i}" for i in range(len(self.features))]).alias("signature")).agg(rows_().alias("n"))
        counts.write.mode("overwrite").parquet(f"{self.folder}/delivery={delivery}")

    def counts(self, deliveries: Iterable[str] | None = None) -> DataFrame:
        """(_b0.., signature, n, delivery) of all deliveries, or of some."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], self.schema)
        kept = self.spark.read.schema(self.schema).parquet(self.folder)
        return kept if deliveries is None else kept.where(F.col("delivery").isin(list(deliveries)))

    def signatures(self, deliveries: Iterable[str] | None = None) -> DataFrame:
        """(signature, n) of the deliveries together."""
        return self.counts(deliveries).groupBy("signature").agg(F.sum("n").alias("n"))

    def availability(self, deliveries: Iterable[str] | None = None) -> DataFrame:
        """(feature, populated, missing, denominator) of the deliveries together."""
        return availability_table(self.signatures(deliveries), self.features)

    def by_context(self, deliveries: Iterable[str] | None = None) -> DataFrame:
        """The columns of `by`, feature, populated and denominator; rows that came late are with the values that they belong to."""
        held = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), (F.substring("signature", i + 1, 1) == "1").alias("there")) for i, c in enumerate(self.features)))).alias("c")
        cells = self.counts(deliveries).select(*(F.col(f"_b{i}").alias(c) for i, c in enumerate(self.by)), "n", held)
        return cells.groupBy(*map(quoted, self.by), F.col("c.feature").alias("feature")).agg(F.sum(F.when(F.col("c.there"), F.col("n")).otherwise(0)).alias("populated"), F.sum("n").alias("denominator"))

    def changes(self, before: Iterable[str], after: Iterable[str]) -> DataFrame:
        """(feature, before, after, delta): populated fractions of two groups of deliveries and how they differ."""
        old, new = (self.availability(x).select("feature", (F.col("populated") / F.col("denominator")).alias("share")) for x in (before, after))
        joined = old.withColumnRenamed("share", "before").join(new.withColumnRenamed("share", "after"), "feature", "full_outer")
        return joined.withColumn("delta", F.col("after") - F.col("before"))
