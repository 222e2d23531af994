"""Token counts for every context limit from an exact histogram of encoded lengths."""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalens.llm import tokens
from stratalens.llm.common import cut, slices

RANGE = 256  # lengths whose running sums one window works out


def _lengths(batches, path: str):
    for batch in slices(batches):
        ids = tokens.encoder(path).encode_many(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([len(x) // 4 for x in ids], pa.int64())], ["length"])


def histogram(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """(length, n_docs): documents by their number of token ids; null and empty texts have length 0. Other columns are not read."""
    encoded = docs.select(F.col(text_col).alias("text")).mapInArrow(partial(_lengths, path=path or tokens.default_path()), "length bigint")
    return encoded.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def limits(counts: DataFrame) -> DataFrame:
    """One row per length that occurs, taken as a context limit.

    n_docs documents have this length, n_longer more tokens than that, with longer_tokens in all; kept_tokens is the
    corpus cut to the limit; share is the part of documents that fit whole, so the quantile q is the first limit with
    share >= q. Between two limits kept_tokens grows by n_longer a token, so these rows answer every limit.
    Sums run over ranges of lengths and then inside each, so no window sees all lengths. The histogram is read twice
    and is cut first, so the documents are encoded once.
    """
    counts = cut(counts)
    counts = counts.withColumn("tokens", F.col("length") * F.col("n_docs")).withColumn("_range", F.floor(F.col("length") / RANGE))
    after = lambda by: by.rowsBetween(1, Window.unboundedFollowing)
    ranges = counts.groupBy(F.col("_range").alias("_r")).agg(F.sum("n_docs").alias("_n"), F.sum("tokens").alias("_t"))
    above = after(Window.orderBy("_r"))
    ranges = ranges.select("_r", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_docs_above"), F.coalesce(F.sum("_t").over(above), F.lit(0)).alias("_tokens_above"), F.sum("_n").over(Window.partitionBy()).alias("_all"), F.sum("_t").over(Window.partitionBy()).alias("_all_tokens"))
    inside = after(Window.partitionBy("_range").orderBy("length"))
    joined = counts.join(ranges, F.col("_range") == F.col("_r"))
    joined = joined.withColumn("n_longer", F.col("_docs_above") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0)))
    joined = joined.withColumn("longer_tokens", F.col("_tokens_above") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    kept = F.col("_all_tokens") - F.col("longer_tokens") + F.col("length") * F.col("n_longer")
    return joined.select(F.col("length").alias("context_limit"), "n_docs", "n_longer", "longer_tokens", kept.alias("kept_tokens"), F.col("_all_tokens").alias("total_tokens"), ((F.col("_all") - F.col("n_longer")) / F.col("_all")).alias("share"))


def truncated_total(answers: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut to `limit`, from the rows of limits()."""
    low = answers.where(F.col("context_limit") <= limit).orderBy(F.desc("context_limit")).first()
    if low:
        return low["kept_tokens"] + (limit - low["context_limit"]) * low["n_longer"]
    first = answers.orderBy("context_limit").first()
    return limit * (first["n_docs"] + first["n_longer"]) if first else 0


def quantile(answers: DataFrame, q: float) -> int | None:
    row = answers.where(F.col("share") >= q).orderBy("context_limit").first()
    return row["context_limit"] if row else None
