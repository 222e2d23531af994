"""Fill-in-middle: a text is cut into prefix, middle and suffix, and written with its middle last.

A text is an array of units, each a run of ASCII letters or one other character. Digits of a SHA-256 over the document's id
choose the two cuts, whether the text is left plain, and which of two arrangements is written:

    psm   <P> prefix <S> suffix <M> middle
    spm   <S> suffix <P> prefix <M> middle

A text that holds a sentinel itself is left plain, so that the sentinels of an arranged one can be found again and the text put
back together from what was written and its form alone. Everything is one projection of DataFrame functions: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINEL = "<[PSM]>"
#: Of 100 documents so many are arranged, and of 100 arranged ones so many have the suffix first.
ARRANGED, SUFFIX_FIRST = 90, 20
SEED = 1


def draws(id_: Column, seed: int, n: int = 4) -> list[Column]:
    """The first n groups of eight hex digits of the SHA-256 of `seed:id`, as numbers; a null id is written as nothing."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, arranged: int = ARRANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row per document: id, n (units), form (plain, psm or spm), prefix, middle, suffix (null if plain), output.

    Null text is empty, and an empty text is plain. Rows that repeat an id are cut by the same draws; a null id has draws of its own.
    Other columns of docs are not read, and an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), *(h.alias(f"_h{i}") for i, h in enumerate(draws(F.col(id_col), seed))))
    base = base.withColumn("units", F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)))
    base = base.withColumn("n", F.size("units").cast("long"))
    a, b = (F.col(h) % (F.col("n") + 1) for h in ("_h0", "_h1"))
    plain = (F.col("n") == 0) | F.col("text").rlike(SENTINEL) | (F.col("_h2") % 100 >= arranged)
    form = F.when(plain, "plain").when(F.col("_h3") % 100 < suffix_first, "spm").otherwise("psm")
    base = base.select("id", "text", "units", "n", form.alias("form"), F.least(a, b).cast("int").alias("_a"), F.greatest(a, b).cast("int").alias("_b"))
    piece = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, length), ""))
    base = base.select(
        "id", "n", "form", "text",
        piece(F.lit(1), F.col("_a")).alias("prefix"),
        piece(F.col("_a") + 1, F.col("_b") - F.col("_a")).alias("middle"),
        piece(F.col("_b") + 1, F.col("n").cast("int") - F.col("_b")).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return base.select("id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that fill_in_middle wrote as output, from output and form alone; null where the sentinels are not those of the form."""
    part = lambda i: F.get(F.split(output, SENTINEL), F.lit(i))
    marks = F.array_join(F.regexp_extract_all(output, F.lit(SENTINEL), F.lit(0)), "")
    psm = F.when((marks == PREFIX + SUFFIX + MIDDLE) & (part(0) == ""), F.concat(part(1), part(3), part(2)))
    spm = F.when((marks == SUFFIX + PREFIX + MIDDLE) & (part(0) == ""), F.concat(part(2), part(3), part(1)))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)


#: DuckDB's statement of the same rows. The restored text is what stands between the sentinels, put in order.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
h AS (SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || substr(digest, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(digest, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(digest, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(digest, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c),
o AS (SELECT *, CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END AS output FROM p),
s AS (SELECT *, CASE WHEN form <> 'plain' THEN str_split(replace(replace(output, '<S>', '<P>'), '<M>', '<P>'), '<P>') END AS parts FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars, sha256(output) AS output_sha256,
    sha256(CASE form WHEN 'psm' THEN parts[2] || parts[4] || parts[3] WHEN 'spm' THEN parts[3] || parts[4] || parts[2] ELSE output END) AS restored_sha256
FROM s
"""
