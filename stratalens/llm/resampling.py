"""Importance resampling: documents are drawn by how much more their words occur in a target text than in the corpus.

Every run of words is a feature that falls into one of a fixed number of buckets. A bucket's gain is the log-ratio of its smoothed
share in the target to that in the corpus, and a document's weight the mean gain of its features. Gumbel noise from a hash of the
id is added to the weight, so taking the highest scores is a weighted draw without replacement.

Native Spark throughout. The n-gram arrays are turned to bucket numbers and stored once, and exploded twice: for the counts of
the buckets, and to be joined with the gains, a broadcast table of one row per bucket. Ranks come from one range sort: a row's
rank is its place in its partition plus the sizes of the partitions before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalens.llm.common import cut

#: A word is a run of ASCII letters and digits and all characters beyond ASCII; only A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NGRAMS, BUCKETS = 1, 10_000
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Bits of monotonically_increasing_id() that number the rows of one partition.
PLACE_BITS = 33


def words_of(text: Column) -> Column:
    """The array of a text's words, repeats included; no words for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def runs(words: Column, most: int) -> Column:
    """All runs of 1 to `most` consecutive words, joined by one space."""
    if most == 1:
        return words
    none = F.array().cast("array<string>")

    def of(k: int) -> Column:
        last = F.size(words) - F.lit(k - 1)
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, k), " "))).otherwise(none)

    return F.flatten(F.array(words, *map(of, range(2, most + 1))))


def bucket_numbers(df: DataFrame, text_col: str, ngrams: int, buckets: int, *carried: Column) -> DataFrame:
    """The carried columns, n_words, and the array of the features' bucket numbers."""
    named = df.select(*carried, words_of(F.col(text_col)).alias("_words"))
    features = runs(F.col("_words"), ngrams)
    return named.select(
        *(c for c in named.columns if c != "_words"),
        F.size("_words").cast("long").alias("n_words"),
        F.transform(features, lambda f: (F.crc32(f.cast("binary")) % buckets).cast("int")).alias("buckets"),
    )


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket, from the bucket arrays of both sides; as many rows as there are buckets."""
    count = lambda df, name: df.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    held = cut(every.join(count(corpus, "s"), "bucket", "left").join(count(target, "t"), "bucket", "left").na.fill(0, ["s", "t"]).coalesce(1))
    all_ = held.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    more, less = (F.col("t") + 1.0) * F.lit(float(all_["s"] + buckets)), (F.col("s") + 1.0) * F.lit(float(all_["t"] + buckets))
    return held.select("bucket", F.floor(F.lit(1000.0) * F.log(more / less)).alias("gain"))


def gumbel(id_: Column, seed: int) -> Column:
    """Noise in thousandths from the first eight hex digits of the SHA-256 of `seed:id`; a null id is written as nothing."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def numbered_in_order(df: DataFrame, order: list[Column], counted: Column) -> DataFrame:
    """df in one range sort, with place (1, 2, 3... over all rows) and of (how many rows are counted in all).

    The sort's last columns must tell all rows apart that the caller tells apart. Only one row per partition meets in a window.
    """
    ordered = cut(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_m", PLACE_BITS), F.col("_m").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.sum(counted.cast("long")).alias("_counted"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_counted").over(Window.partitionBy()).alias("of"))
    # as many rows as the sort has partitions
    placed = ordered.join(F.broadcast(sizes), part == F.col("_part"))
    return placed.select(*df.columns, (F.col("_before") + inside + 1).alias("place"), "of")


def importance_sample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", ngrams: int = NGRAMS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """One row per document: id, n_words, n_features, weight, score, rank (1, 2, 3... by falling score; null if not drawn).

    Of the documents with at least least_words words, percent in a hundred (rounded down) are drawn; equal scores go to the smaller
    id, null last, then to fewer features. Null text has no words, weight 0 and is never drawn while least_words is over 0. Rows that
    repeat an id are documents of their own with the same noise. An empty target leaves a gain for being rare in the corpus; an
    empty corpus gives an empty result. Other columns of docs and target are not read.
    """
    rows = cut(bucket_numbers(docs, text_col, ngrams, buckets, F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id")))
    wanted = cut(bucket_numbers(target, target_text_col, ngrams, buckets))
    gains = bucket_gains(rows, wanted, buckets)
    # one row per document and task reaches the shuffle, as a document's features are all in one task
    found = rows.select("row", "id", "n_words", F.size("buckets").cast("long").alias("n_features"), F.explode_outer("buckets").alias("bucket"))
    summed = found.join(F.broadcast(gains), "bucket", "left").groupBy("row", "id", "n_words", "n_features").agg(F.coalesce(F.sum("gain"), F.lit(0)).alias("_sum"))
    weight = F.expr("div(_sum - pmod(_sum, greatest(n_features, 1)), greatest(n_features, 1))")
    scored = summed.withColumn("weight", F.when(F.col("n_features") > 0, weight).otherwise(F.lit(0)).cast("long"))
    scored = scored.select("row", "id", "n_words", "n_features", "weight", (F.col("weight") + gumbel(F.col("id"), seed)).cast("long").alias("score"), (F.col("n_words") >= least_words).alias("eligible"))
    order = [F.col("eligible").desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features"), F.col("row")]
    placed = numbered_in_order(scored, order, F.col("eligible"))
    drawn = F.col("eligible") & (F.col("place") <= F.expr(f"div({percent} * of, 100)"))
    return placed.select("id", "n_words", "n_features", "weight", "score", F.when(drawn, F.col("place")).alias("rank"))


#: DuckDB's statement of the same draw of `documents` towards `benchmark`. It has no crc32, so distinct words are worked out by byte.
ORACLE = r"""
WITH bits AS (SELECT i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) r(i)),
step AS (SELECT i, list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM bits),
tab AS (SELECT list(c ORDER BY i) AS t FROM step),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
dw AS (SELECT r, unnest(words) AS w FROM d),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
distinct_words AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
bytes AS (SELECT w, list_prepend(4294967295::BIGINT, list_transform(range(CAST(len(x) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))) AS b FROM distinct_words),
crc AS (SELECT w, xor(list_reduce(b, lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, tab),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN crc USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN crc USING (w) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS all_s, (SELECT coalesce(sum(t), 0) FROM t) AS all_t),
gains AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), totals),
sums AS (SELECT r, count(*) AS n, sum(gain) AS total FROM dw JOIN crc USING (w) JOIN gains USING (bucket) GROUP BY r),
weighed AS (SELECT d.r, doc_id, CAST(len(words) AS BIGINT) AS n_features, CAST(coalesce((total - ((total % n) + n) % n) // n, 0) AS BIGINT) AS weight,
    CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN sums USING (r)),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM weighed),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST, n_features) AS place, count(*) OVER () AS eligible FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * eligible // 100 THEN place END AS rank FROM scored LEFT JOIN ranked USING (r)
"""
