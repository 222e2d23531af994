"""Near-duplicate documents by the Jaccard similarity of their sets of word shingles.

The least values of a shingle set under many permutations are cut into bands; documents with an equal band are
candidates, and a candidate pair is a link only if the similarity of the two whole sets, worked out from the texts,
reaches the bound. With similarity s, a pair shares no band with probability (1 - s^ROWS)^BANDS: about 0.0004 at 0.8.

As in simhash, documents are first compared with the smallest and the largest one of their band, and then only with
those that these links leave in another component. Documents with the same words in the same order are one node.

Many documents that are alike but not enough would give all their pairs there, so the join has a further condition
that every link meets: each shingle toggles one of MARKS bits, so two sets differ in at least as many shingles as
their bits differ in places, and at similarity s they may differ in at most (1 - s) / (1 + s) of both sizes together.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.llm.common import chosen, cut, field, slices
from stratalens.llm.simhash import SEED, components, keep_least, simhash
from stratalens.llm.simhash import near_links as simhash_links

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 5
MARKS = 512
#: Permutations of 64-bit numbers: exclusive or, then multiplication by an odd number.
_RANDOM = np.random.default_rng(SEED)
FLIPS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
FACTORS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(found: list[bytes], words: int = WORDS) -> set[bytes]:
    """The runs of so many words; all words as one if there are fewer, nothing without words."""
    return {b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def signature(found: list[bytes], words: int = WORDS) -> tuple[list[int], int, list[int]]:
    """Signed 64-bit hashes of the bands, the number of shingles and the marks; no bands without words, which are all one node."""
    if not found:
        return [], 0, [0] * (MARKS // 64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles(found, words)), np.uint64)
    toggled = np.bincount((hashes % np.uint64(MARKS)).astype(np.int64), minlength=MARKS) % 2
    marks = np.packbits(toggled.astype(np.uint8), bitorder="little").view("<i8").tolist()
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[at : at + 4096, None] ^ FLIPS) * FACTORS).min(axis=0))
    digests = [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
    return np.array(digests, np.uint64).view(np.int64).tolist(), len(hashes), marks


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes know only ASCII letters and white space


def _sign(batches, at: int, words: int, prints: bool):
    for batch in slices(batches):
        found = [split(t) for t in batch.column(at).to_pylist()]
        joined = [b" ".join(x) for x in found]
        nodes = np.array([xxhash.xxh64_intdigest(x, SEED) for x in joined], np.uint64).view(np.int64)
        signs = [(*signature(x, words), simhash(t) if prints else 0) for x, t in zip(found, joined)]
        kinds = (pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.int64())
        columns = [pa.array([x[i] for x in signs], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64()), *columns], [*batch.schema.names, "_node", "_bands", "_size", "_marks", "_fp"])


def _verify(batches, words: int, similarity: float):
    for batch in slices(batches):
        sets: dict[int, set] = {}
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        good = []
        for x, y, tx, ty in zip(a, b, batch.column("_ta"), batch.column("_tb")):
            for node, text in ((x, tx), (y, ty)):
                if node not in sets:
                    if len(sets) > 1000:
                        sets.clear()
                    sets[node] = shingles(split(text.as_py()), words)
            # the other one may have gone when the sets were cleared
            sx = sets[x] if x in sets else shingles(split(tx.as_py()), words)
            both = len(sx & sets[y])
            good.append(both >= similarity * (len(sx) + len(sets[y]) - both) - 1e-9)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def verified(pairs: DataFrame, nodes: DataFrame, signed: DataFrame, text_col: str, words: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose shingle sets are as similar as asked. Only the texts of these nodes are moved."""
    pairs = cut(pairs)
    ends = pairs.select(F.col("a").alias("_n")).unionByName(pairs.select(F.col("b").alias("_n"))).distinct()
    texts = cut(chosen(signed, nodes.join(ends, F.col("node") == F.col("_n"), "left_semi").select("one")).select("_node", F.col(f"`{text_col}`").alias("_t")))
    a, b = texts.select(F.col("_node").alias("a"), F.col("_t").alias("_ta")), texts.select(F.col("_node").alias("b"), F.col("_t").alias("_tb"))
    return cut(pairs.join(a, "a").join(b, "b").select("a", "b", "_ta", "_tb").mapInArrow(partial(_verify, words=words, similarity=similarity), "a bigint, b bigint"))


def print_links(nodes: DataFrame, bits: int) -> DataFrame:
    """(a, b): each node with the smallest one that links of fingerprints (operator 1's) lead to, if that is another."""
    roots = components(simhash_links(nodes.select(F.col("_fp").alias("fp")), bits)).select(F.col("node").alias("_f"), "root")
    classes = cut(nodes.join(roots, F.col("_fp") == F.col("_f"), "left").select("node", F.coalesce("root", "_fp").alias("class")))
    least = classes.groupBy("class").agg(F.min("node").alias("a"))
    return cut(classes.join(least, "class").where("a <> node").select("a", F.col("node").alias("b")))


def near_links(nodes: DataFrame, signed: DataFrame, text_col: str, words: int = WORDS, similarity: float = SIMILARITY, known: DataFrame | None = None) -> DataFrame:
    """(a, b) pairs of nodes at least so similar, enough of them to connect all that the candidate pairs connect, and the known links.

    What known links (a, b), b in one link only, connect already is not compared. nodes (node, one, _bands, _size, _marks) has the number of one
    row of signed for each node.
    """
    check = partial(verified, nodes=nodes, signed=signed, text_col=text_col, words=words, similarity=similarity)
    index = nodes.select("node", F.explode("_bands").alias("sig"))
    ends = index.groupBy("sig").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    shared = cut(index.join(ends, "sig"))
    stars = shared.select(F.col("node").alias("u"), F.explode(F.array("lo", "hi")).alias("v")).where("u <> v")
    stars = stars.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    if known is not None:
        ra, rb = (known.select(F.col("b").alias(f"_{x}"), F.col("a").alias(f"_r{x}")) for x in "ab")
        stars = stars.join(ra, F.col("a") == F.col("_a"), "left").join(rb, F.col("b") == F.col("_b"), "left")
        stars = stars.where(F.coalesce("_ra", "a") != F.coalesce("_rb", "b")).select("a", "b")
    stars = check(stars)
    if known is not None:
        stars = stars.unionByName(known)
    roots = components(stars).select(F.col("node").alias("_n"), "root")
    labelled = cut(shared.join(roots, F.col("node") == F.col("_n"), "left").select("node", "sig", F.coalesce("root", "node").alias("root")))
    apart = labelled.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("sig")
    labelled = labelled.join(apart, "sig", "left_semi").join(nodes.select("node", "_size", "_marks"), "node")
    parts = [F.col("_marks")[i].alias(f"m{i}") for i in range(MARKS // 64)]
    labelled = cut(labelled.select("node", "sig", "root", F.col("_size").alias("n"), *parts))
    left, right = (labelled.select("sig", *(F.col(c).alias(f"{c}_{side}") for c in labelled.columns if c != "sig")) for side in "ab")
    differ = sum((F.bit_count(F.col(f"m{i}_a").bitwiseXOR(F.col(f"m{i}_b"))) for i in range(MARKS // 64)), F.lit(0))
    possible = differ <= F.lit((1 - similarity) / (1 + similarity)) * (F.col("n_a") + F.col("n_b")) + 1e-6
    joined = left.join(right, (left.sig == right.sig) & (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & possible)
    joined = joined.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    return stars.unionByName(check(joined))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, bits: int | None = None) -> DataFrame:
    """docs with exactly one row of each group of near duplicates: the smallest id, null last; of equal ids any one row.

    With bits, operator 1's fingerprints that differ in at most so many bits are links too, and come first. Texts without words
    are equal to each other.
    """
    keyed = docs.withColumn("_row", F.monotonically_increasing_id())
    made = {"_node": "bigint", "_bands": "array<bigint>", "_size": "bigint", "_marks": "array<bigint>", "_fp": "bigint"}
    schema = T.StructType([*keyed.schema.fields, *(field(*x) for x in made.items())])
    signed = cut(keyed.mapInArrow(partial(_sign, at=docs.columns.index(text_col), words=words, prints=bits is not None), schema))
    nodes = cut(signed.groupBy(F.col("_node").alias("node")).agg(F.min("_row").alias("one"), *(F.first(c).alias(c) for c in ("_bands", "_size", "_marks", "_fp"))))
    known = None if bits is None else print_links(nodes, bits)
    roots = components(near_links(nodes, signed, text_col, words, similarity, known)).select(F.col("node").alias("_n"), "root")
    return keep_least(signed, "_node", roots, id_col).select(*(F.col(f"`{c}`") for c in docs.columns))
