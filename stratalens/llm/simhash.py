"""Near-duplicate documents by SimHash and deletion-variant signatures.

A fingerprint is cut into k // 2 + 1 segments, so that of two fingerprints that differ in at most k bits some
segment differs in at most one. Each segment is indexed once per bit with that bit wiped out; two fingerprints with
such a segment share one of these variants, so an equality join finds every link and the whole fingerprints are then
compared.

A large group of near copies would give all its pairs. So fingerprints are first linked to the smallest and the
largest one with an equal segment, and the join looks only for links between different components of those links:
what is already connected is never listed again, and no connection is lost.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.llm.common import chosen, cut, field, keyed, slices

BITS = 64
SEED = 42


def simhash(text: bytes | None, words: int = 4) -> int:
    """Signed 64-bit SimHash of the text's word shingles, repeats included; 0 without words."""
    found = (text or b"").lower().split()  # bytes know only ASCII letters and white space
    if not found:
        return 0
    joined, one = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        hashes = [one(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [one(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist())]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[at : at + (1 << 14)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(set_bits.view("<i8")[0])


def _fingerprint(batches, words: int):
    for batch in slices(batches):
        prints = [simhash(t, words) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp) per document."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return base.mapInArrow(partial(_fingerprint, words=words), T.StructType([field("id", docs.schema[id_col].dataType), field("fp", "bigint")]))


def segments(k: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the fewest segments of which one differs by at most one bit when k bits differ."""
    n = k // 2 + 1
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _segment(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def _variants(fp: Column, k: int) -> Column:
    """All one-wildcard variants: the segment without one bit, and above it the number of that bit."""
    out = []
    for low, width in segments(k):
        part = _segment(fp, low, width)
        out += [part.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << i))) + F.lit((low + i) << 40) for i in range(width)]
    return F.array(*out)


def _first_shared(diff: Column, k: int) -> Column:
    """The bit whose variant is the first that two fingerprints with this difference share."""
    out = F.lit(-1)
    for low, width in reversed(segments(k)):
        part = _segment(diff, low, width)
        # of equal segments the lowest bit's variant is the first; of others only the differing bit's is shared
        bit = F.when(part == 0, F.lit(low)).otherwise(F.lit(low) + F.round(F.log2(part.cast("double"))).cast("int"))
        out = F.when(F.bit_count(part) <= 1, bit).otherwise(out)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), root being the smallest node that it is connected with.

    Large-star and small-star steps in turn (Kiveris et al., 2014): every node hands its neighbours the smallest one,
    until the links are stars. Each step is an aggregation and a join; what a step changed is told from sums.
    """
    links = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        links = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = links.groupBy("u").agg(F.min("v").alias("m"))
        near = links.join(low, "u")
        links = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        links = cut(links)
        sums = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sums) == state:
            break
        state = tuple(sums)
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_links(prints: DataFrame, k: int = 4) -> DataFrame:
    """(a, b) pairs of distinct fingerprints fp that differ in at most k bits, enough of them to connect all that links connect."""
    prints = cut(prints.select("fp").distinct())
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= k
    parts = F.array(*(_segment(F.col("fp"), low, width) + F.lit(low << 40) for low, width in segments(k)))
    equal = prints.select("fp", F.explode(parts).alias("sig"))
    ends = equal.groupBy("sig").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    stars = equal.join(ends, "sig").select("fp", F.explode(F.array("lo", "hi")).alias("b"))
    stars = cut(stars.where((F.col("fp") != F.col("b")) & near(F.col("fp"), F.col("b"))).select(F.col("fp").alias("a"), "b").distinct())
    known = components(stars)
    labelled = prints.join(known, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))
    # a scratch table of few files is spread first, as each row becomes as many as there are bits
    index = labelled.repartition("fp").select("fp", "root", F.explode(_variants(F.col("fp"), k)).alias("sig"))
    left, right = index.select("sig", F.col("fp").alias("a"), F.col("root").alias("ra")), index.select("sig", F.col("fp").alias("b"), F.col("root").alias("rb"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    joined = left.join(right, (left.sig == right.sig) & (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & (F.bit_count(diff) <= k))
    bit = F.shiftright(left.sig, 40).cast("int")
    found = joined.where(bit == _first_shared(diff, k)).select("a", "b")
    return stars.unionByName(found)


def near_duplicates(docs: DataFrame, k: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fp, component (the smallest id that links of at most k differing bits reach).

    Null and blank texts have fingerprint 0 and are linked like any other. Rows that repeat an id stay rows of
    their own; a null id never names a component unless all ids in it are null. Other columns are not read.
    """
    prints = cut(fingerprints(docs, id_col, text_col, words))
    roots = components(near_links(prints, k))
    first = prints.groupBy("fp").agg(F.min("id").alias("least"))
    named = first.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    names = named.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component"))
    classes = cut(named.join(names, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component"))
    return prints.join(classes, F.col("fp") == F.col("f")).select("id", "fp", "component")


def keep_least(rows: DataFrame, node: str, roots: DataFrame, id_col: str) -> DataFrame:
    """rows, a scratch table whose _row is unique, with one row of each component of (_n, root): the smallest (id, _row), a null id last.

    A node that is not in roots is a component of its own.
    """
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_row").alias("row"))
    least = rows.groupBy(F.col(node).alias("_m")).agg(F.min(order).alias("_least"))
    named = least.join(roots, F.col("_m") == F.col("_n"), "left")
    keep = named.groupBy(F.coalesce("root", "_m").alias("_root")).agg(F.min("_least").alias("_least")).select(F.col("_least.row").alias("_keep"))
    return chosen(rows, keep)


def keep_first(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs with exactly one row of each group of near duplicates: the smallest id, null last; of equal ids any one row."""
    rows = keyed(docs)
    found = near_duplicates(rows, id_col="_row", **options)
    roots = found.select(F.col("id").alias("_n"), F.col("component").alias("root"))
    return keep_least(rows, "_row", roots, id_col).select(*(F.col(f"`{c}`") for c in docs.columns))
