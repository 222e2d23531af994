"""Document fingerprints by spot signatures.

An anchor is a word so common that it stands everywhere in running text. A spot signature is an anchor with the chain of content
words that follow it, other anchors being passed over; the start of a text is an anchor too. The set of a text's signatures is its
fingerprint, so what is not running text (menus, lists of names) hardly counts, and an edit changes only the signatures near it.
Anchors are learned from all documents: a word that makes up a given share of all words, so there are at most 1 / share of them.

Fingerprints are compared by the Jaccard similarity of the sets. Two sets are at least t alike only if the smaller has at least
t times the size of the larger one, so sets are partitioned by size, each class reaching to 1 / t of its least size: only equal and
neighbouring classes can match. Within them a set is looked up by its rarest signatures only, as two sets that share none of
their (1 - t) * size + 1 rarest ones cannot reach t.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stratalens.llm.common import cut, field, slices
from stratalens.llm.resampling import words_of
from stratalens.llm.simhash import components

#: Content words of a chain, share of all words from which on a word is an anchor, and the similarity of near duplicates.
CHAIN, COMMON, SIMILARITY = 2, 0.005, 0.8
#: Bytes of a text as its words see them: separators as blanks, A-Z in lower case. These are the words of resampling.WORD.
_PLAIN = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
FIRST, LAST = 1, 2
#: Bytes of a word from which on its digest takes its place.
LONG = 64


def anchor_words(docs: DataFrame, text_col: str = "text", common: float = COMMON) -> frozenset[bytes]:
    """The words that make up at least the share `common` of the words of all texts; at most 1 / common of them exist."""
    counts = docs.select(F.explode(words_of(F.col(text_col))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # the most frequent words and the number of all, from one shuffle; no word after these can have such a share
    most = counts.orderBy(F.desc("n"), "word").limit(int(1 / common) + 1)
    found = cut(most.unionByName(counts.agg(F.lit(None).cast("string").alias("word"), F.sum("n").alias("n")))).collect()
    total = next(r["n"] for r in found if r["word"] is None) or 0
    return frozenset(r["word"].encode() for r in found if r["word"] is not None and r["n"] >= common * total)


def signatures(data: bytes, anchors: frozenset[bytes], chain: int = CHAIN) -> np.ndarray:
    """The sorted set of 32-bit hashes of a text's spot signatures. A text without content words is one signature by itself.

    Very long words stand in as their digests, so that a chain is short however often it follows an anchor.
    """
    content: list[bytes] = []
    spots = {(b"", 0)}
    for word in data.translate(_PLAIN).split(b" "):
        if word in anchors:
            spots.add((word, len(content)))
        elif word:
            content.append(word if len(word) <= LONG else xxhash.xxh64_digest(word))
    if not content:
        return np.array([xxhash.xxh32_intdigest(b"\0" + data)], np.uint32)
    n, one = len(content), xxhash.xxh32_intdigest
    return np.array(sorted({one(b" ".join((a, *content[k : k + chain]))) for a, k in spots if k < n}), np.uint32)


def likeness(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """Jaccard similarity of two sets; 0 without comparing them where their sizes keep it under at_least."""
    small, large = sorted((len(a), len(b)))
    if not large or small < at_least * large:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    found = both / (small + large - both)
    return found if found >= at_least else 0.0


def _packed(hashes: np.ndarray) -> bytes:
    return hashes.astype(">u4").tobytes()


def _sign(batches, anchors, chain: int):
    for batch in slices(batches):
        texts = batch.column(1).to_pylist()
        prints = [_packed(signatures((t or "").encode(), anchors, chain)) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(prints, pa.binary())], ["id", "n_chars", "print"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchors: frozenset[bytes] | None = None, chain: int = CHAIN) -> DataFrame:
    """(id, n_chars, print) of each document; print is the sorted set of its signatures, four bytes each. Null text is empty."""
    anchors = anchor_words(docs, text_col) if anchors is None else anchors
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([field("id", docs.schema[id_col].dataType), field("n_chars", "bigint"), field("print", "binary")])
    return base.mapInArrow(partial(_sign, anchors=anchors, chain=chain), schema)


# ---- a document, its edited text and the next document ------------------------------------------------------

MEASURED = "n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _measured(text: str, own: np.ndarray, after: str, next_: np.ndarray, anchors, chain: int) -> tuple:
    half = len(text) // 2
    edited = (text[: len(text) - half] + after[:half]).encode()
    changed = signatures(edited, anchors, chain)
    return len(text), hashlib.sha256(edited).hexdigest(), _packed(own), _packed(changed), likeness(own, changed), likeness(own, next_)


def _in_order(batches, schema: pa.Schema, anchors, chain: int):
    """Rows of one partition in order: each is measured once its successor is read; the first and last text go out as edges."""
    held = None
    for batch in slices(batches):
        out = []
        for id_, text, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            own = signatures(text.encode(), anchors, chain)
            if held is None:
                out.append((None, part, FIRST, text, *[None] * 6))
            else:
                out.append((held[0], part, 0, None, *_measured(held[1], held[2], text, own, anchors, chain)))
            held = (id_, text, own, part)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    if held is not None:
        last = (held[0], held[3], LAST, held[1], *[None] * 6)
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(last, schema)], schema=schema)


def _edges(batches, schema: pa.Schema, anchors, chain: int):
    for batch in slices(batches):
        out = []
        for id_, text, after in zip(*(batch.column(i).to_pylist() for i in range(3))):
            own, next_ = (signatures(t.encode(), anchors, chain) for t in (text, after))
            out.append((id_, *_measured(text, own, after, next_, anchors, chain)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def compared_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", common: float = COMMON, chain: int = CHAIN) -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next id, null last, and after the last one the first; of rows with equal ids the order is that
    of the texts' hashes. The edited text has the second half of its code points (the smaller one) replaced by as many first
    ones of the next document, or all it has. Null text is empty; a single document is its own next one. Other columns are not read.

    One range sort brings each document to its successor. Only the last document of a partition misses it: the first and
    last text of every partition are joined afterwards, two rows per partition.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    anchors = anchor_words(docs, text_col, common)
    kind = docs.schema[id_col].dataType
    measured = T._parse_datatype_string(MEASURED).fields
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("_row"))
    order = [F.col("id").asc_nulls_last(), F.xxhash64("text"), F.col("_row")]
    placed = base.orderBy(*order).select("id", "text", F.spark_partition_id().alias("part"))
    schema = T.StructType([field("id", kind), field("part", "int"), field("edge", "int"), field("text", "string"), *measured])
    found = cut(placed.mapInArrow(partial(_in_order, schema=to_arrow_schema(schema), anchors=anchors, chain=chain), schema))
    first, last = (found.where(F.col("edge") == e).select("id", "part", "text") for e in (FIRST, LAST))
    by_part = Window.orderBy("part")
    follows = first.select("part", F.coalesce(F.lead("part").over(by_part), F.min("part").over(Window.partitionBy())).alias("_next"))
    pairs = last.join(follows, "part").join(first.select(F.col("part").alias("_next"), F.col("text").alias("_after")), "_next")
    schema = T.StructType([field("id", kind), *measured])
    ends = pairs.select("id", "text", "_after").mapInArrow(partial(_edges, schema=to_arrow_schema(schema), anchors=anchors, chain=chain), schema)
    return found.where(F.col("edge") == 0).select("id", *(f.name for f in measured)).unionByName(ends)


# ---- near duplicates -----------------------------------------------------------------------------------------


def size_classes(at_least: float, most: int = 1 << 31) -> list[int]:
    """The least sizes of the classes: a set and one that is at least so similar lie in the same class or in neighbours."""
    out = [1]
    while out[-1] < most and at_least > 0:
        out.append(int(out[-1] / at_least) + 1)
    return out


def _unpacked(batches):
    for batch in slices(batches):
        lists = [np.frombuffer(x, ">u4").astype(np.int64) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int64()))], ["node", "sigs"])


def _alike(batches, at_least: float):
    for batch in slices(batches):
        sets = ([np.frombuffer(x, ">u4") for x in batch.column(c).to_pylist()] for c in ("_pa", "_pb"))
        good = [likeness(x, y, at_least) > 0 for x, y in zip(*sets)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def rare_index(nodes: DataFrame, at_least: float) -> DataFrame:
    """(sig, class, node, size, home) of the rarest signatures of each node, in its size class and, as a guest, in the next one."""
    listed = cut(nodes.select("node", "print").mapInArrow(_unpacked, "node bigint, sigs array<bigint>"))
    every = listed.select("node", F.size("sigs").alias("size"), F.explode("sigs").alias("sig"))
    held = every.groupBy("sig").agg(F.count(F.lit(1)).alias("held"))
    rarest = every.join(held, "sig").groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("held", "sig"))).alias("order"))
    prefix = F.col("size") - F.ceil(F.col("size") * at_least - 1e-9).cast("int") + 1
    chosen = rarest.select("node", "size", F.explode(F.slice("order", F.lit(1), prefix)).alias("s")).where("s.held > 1")
    number = F.size(F.filter(F.array(*map(F.lit, size_classes(at_least))), lambda b: b <= F.col("size")))
    cells = F.array(F.struct(number.alias("class"), F.lit(True).alias("home")), F.struct((number + 1).alias("class"), F.lit(False).alias("home")))
    return chosen.select(F.col("s.sig").alias("sig"), "node", "size", F.explode(cells).alias("c")).select("sig", "c.class", "node", "size", "c.home")


def similar_documents(docs: DataFrame, at_least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", common: float = COMMON, chain: int = CHAIN) -> DataFrame:
    """One row per document: id, component, the smallest id that links of at least so similar fingerprints reach.

    Each set is first compared with the smallest and largest set at home in its cells (signature and size class); then only those
    pairs of a cell are compared that these links leave apart. Null text is empty, and equal texts are alike; a null id never names
    a component unless all of its ids are null. Rows that repeat an id are documents of their own.
    """
    if not 0 < at_least <= 1:
        raise ValueError("at_least must be over 0 and at most 1")
    prints = cut(fingerprints(docs, id_col, text_col, chain=chain, anchors=anchor_words(docs, text_col, common)).withColumn("node", F.xxhash64("print")))
    nodes = cut(prints.groupBy("node").agg(F.first("print").alias("print"), F.min("id").alias("least")))

    def alike(pairs: DataFrame) -> DataFrame:
        a, b = (nodes.select(F.col("node").alias(x), F.col("print").alias(f"_p{x}")) for x in "ab")
        return cut(pairs.join(a, "a").join(b, "b").select("a", "b", "_pa", "_pb").mapInArrow(partial(_alike, at_least=at_least), "a bigint, b bigint"))

    index, cell = cut(rare_index(nodes, at_least)), ["sig", "class"]
    possible = lambda n, m: F.least(n, m) >= F.greatest(n, m) * at_least - 1e-9
    best = F.when(F.col("home"), F.struct("node", "size"))
    ends = index.groupBy(*cell).agg(F.min(best).alias("lo"), F.max(best).alias("hi")).where("lo is not null")
    stars = index.join(ends, cell).select("node", "size", F.explode(F.array("lo", "hi")).alias("to"))
    stars = stars.where((F.col("node") != F.col("to.node")) & possible(F.col("size"), F.col("to.size")))
    stars = alike(stars.select(F.least("node", "to.node").alias("a"), F.greatest("node", "to.node").alias("b")).distinct())
    known = components(stars).select(F.col("node").alias("_n"), "root")
    labelled = cut(index.join(known, F.col("node") == F.col("_n"), "left").select(*index.columns, F.coalesce("root", "node").alias("root")))
    apart = labelled.groupBy(*cell).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(*cell)
    labelled = cut(labelled.join(apart, cell, "left_semi"))
    left, right = (labelled.select(*cell, *(F.col(c).alias(f"{c}_{x}") for c in ("node", "size", "home", "root"))) for x in "ab")
    pairs = left.join(right, cell).where((F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & (F.col("home_a") | F.col("home_b")) & possible(F.col("size_a"), F.col("size_b")))
    rest = alike(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct())
    roots = components(stars.unionByName(rest)).select(F.col("node").alias("_n"), "root")
    named = nodes.join(roots, F.col("node") == F.col("_n"), "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    names = named.groupBy(F.col("root").alias("_r")).agg(F.min("least").alias("component"))
    classes = cut(named.join(names, F.col("root") == F.col("_r")).select(F.col("node").alias("_m"), "component"))
    return prints.join(classes, F.col("node") == F.col("_m")).select("id", "component")
