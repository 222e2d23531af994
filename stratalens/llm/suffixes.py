"""Repeated passages by sparse suffix arrays.

Of all suffixes of all documents only those are kept that start at a minimiser: the word whose 8-word hash is the
smallest of 26 neighbours. A passage of 50 words holds 26 whole 8-word windows in a row from its first word on, so both
of its copies choose the same word of it, and at least 25 of its words follow there. The kept suffixes, as the hash of
their first 25 words, are sorted by ranges over all machines and compared with their neighbours. Where neighbours agree
the text is extended to the left and right: each 50-word window that chose this minimiser is looked up among the windows
of the other candidates, again by sorting and comparing neighbours. Windows in a row that chose the same minimiser travel
as one row, under the hash of its suffix; equal windows choose equal suffixes, so they meet there, and what is found comes
back as ranges of places. That is exact for every split of the 50 words into a left and a right part, and lists no pairs,
so a passage that a third of all documents share costs as many rows as it has copies.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stratalens.llm.common import cut, field, slices

PASSAGE, GRAM, NEIGHBOURS = 50, 8, 26
PREFIX = PASSAGE - NEIGHBOURS + 1
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
#: Bytes of text that are hashed at a time (a larger text alone), and the longest word that is hashed together with others.
TEXTS, WORD = 1 << 20, 64

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out) if n else out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words data[start:end], eight bytes at a time for all words that have them; long words one by one."""
    length = ends - starts
    eights = np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    out = length.astype(np.uint64) * np.uint64(BASE)
    out = _mixed(out ^ (eights[starts] & FIRST_BYTES[np.minimum(length, 8)]))
    for at in range(8, WORD, 8):
        more = np.flatnonzero(length > at)
        if not len(more):
            break
        out[more] = _mixed(out[more] * np.uint64(BASE) ^ (eights[starts[more] + at] & FIRST_BYTES[np.minimum(length[more] - at, 8)]))
    for i in np.flatnonzero(length > WORD):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]])
    return out


class Rolling:
    """Hashes of all windows of the words of some texts in a row, by a polynomial modulo 2**64; windows that leave their text count for nothing.

    bounds are the numbers of words before each text and in all, ends the number of words up to the end of each word's text.
    """

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        cuts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[cuts[0] : cuts[-1]]
        cuts = cuts - cuts[0]
        word = ~SPACE[data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        inner = cuts[(cuts > 0) & (cuts < len(data))]  # texts follow each other without a space
        first[inner], last[inner - 1] = word[inner], word[inner - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.n = len(starts)
        self.bounds = np.searchsorted(starts, cuts)
        self.ends = np.repeat(self.bounds[1:], np.diff(self.bounds))
        hashes = word_hashes(data, starts, ends)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * _powers(BASE, self.n), dtype=np.uint64)))
        self.back = _powers(BACK, self.n)

    def windows(self, size: int) -> np.ndarray:
        n = max(0, self.n - size + 1)
        x = (self.sums[size : size + n] - self.sums[:n]) * self.back[:n]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ x >> np.uint64(32)

    def passages(self) -> tuple[np.ndarray, np.ndarray]:
        """The places of all windows of 50 words and of the minimisers that they choose, the first of equals; both ascend."""
        n = max(0, self.n - PASSAGE + 1)
        at = np.flatnonzero(np.arange(n) + PASSAGE <= self.ends[:n])
        return at, minimisers(self.windows(GRAM))[at]


def minimisers(grams: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """The place of the least of each so many neighbours, by the upper half of their hashes; the first of equals."""
    low = np.uint64((1 << 32) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width < neighbours and len(least):
        step = min(width, neighbours - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return (least & low).astype(np.int64)


def _texts(batches):
    """The batches in pieces of about TEXTS bytes of their second column."""
    for batch in slices(batches):
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(sizes, dtype=np.int64) // TEXTS
        starts = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1]))) if len(batch) else []
        for start, end in zip(starts, [*starts[1:], len(batch)]):
            yield batch.slice(start, end - start)


def _suffixes(batches):
    for batch in _texts(batches):
        roll = Rolling(batch.column(1))
        at = np.unique(roll.passages()[1])
        yield _rows(batch.column(0), roll, roll.windows(PREFIX)[at], at)


def _windows(batches):
    """The 50-word windows around the candidates of a document, those of one minimiser in a row."""
    for batch in _texts(batches):
        roll = Rolling(batch.column(1))
        found = batch.column(2)
        marked = np.zeros(roll.n, bool)
        marked[np.repeat(roll.bounds[:-1], pc.list_value_length(found).to_numpy()) + found.flatten().to_numpy()] = True
        at, chosen = roll.passages()
        at, chosen = at[marked[chosen]], chosen[marked[chosen]]
        starts = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1]))) if len(at) else np.array([], np.int64)
        cuts = pa.py_buffer((np.append(starts, len(at)) * 8).astype(np.int32))
        hashes = pa.Array.from_buffers(pa.binary(), len(starts), [None, cuts, pa.py_buffer(roll.windows(PASSAGE)[at])])
        yield _rows(batch.column(0), roll, roll.windows(PREFIX)[chosen[starts]], at[starts], hashes)


def _rows(ids, roll, hashes, at, *more):
    """Rows for places among the words of texts: hash, id, place in the text, and more."""
    text = np.searchsorted(roll.bounds, at, side="right") - 1
    places = (at - roll.bounds[text]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), ids.take(pa.array(text)), pa.array(places), *more], ["hash", "id", "at", "windows"][: 3 + len(more)])


def _equal_ids(ids: pa.StructArray) -> np.ndarray:
    """Whether each id equals the one before it, for all but the first; nulls are equal."""
    same = np.ones(len(ids) - 1, bool)
    for part in ids.flatten():
        x, y = part[1:], part[:-1]
        equal = pc.or_(pc.fill_null(pc.equal(x, y), False), pc.and_(pc.is_null(x), pc.is_null(y)))
        same &= equal.to_numpy(zero_copy_only=False)
    return same


def _neighbours(batches, within: bool = False):
    """Ranges of places whose windows are found in another text too (or again in the same one, with within), and single windows that are open.

    Windows of equal hash are in another text if their ids differ, or if they are at the same place of texts with the same id, as
    only those of a repeated document are. They have equal keys, so only those of a batch's first and last key may have others
    elsewhere. Of these the first stays open, as an earlier one may lead, and while no other text is seen all do.
    """
    from pyspark import TaskContext

    before = TaskContext.get().partitionId() << 32
    for number, rows in enumerate(batches):
        if not len(rows):
            continue
        key, start = rows.column(0).to_numpy(), rows.column(2).to_numpy()
        text = np.cumsum(np.concatenate(([True], (key[1:] != key[:-1]) | ~_equal_ids(rows.column(1)))))
        if "windows" in rows.schema.names:
            sizes = pc.binary_length(rows.column("windows")).to_numpy() // 8
            hashes = np.frombuffer(b"".join(rows.column("windows").to_pylist()), np.int64)
        else:
            sizes, hashes = np.ones(len(rows), np.int64), key
        row = np.repeat(np.arange(len(rows)), sizes)
        at = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes - start, sizes)
        order = np.argsort(hashes, kind="stable")  # equal windows stay in order of id and place
        h, t, p = hashes[order], text[row[order]], at[order]
        near = h[1:] == h[:-1]
        group = np.concatenate(([0], np.cumsum(~near)))
        again = near if within else near & ((t[1:] != t[:-1]) | (p[1:] == p[:-1]))
        twin = (np.bincount(group[1:][again], minlength=group[-1] + 1) > 0)[group]
        lead = np.concatenate(([True], ~near))
        edge = ((key == key[0]) | (key == key[-1]))[row[order]]
        marks = np.empty(len(h), np.int8)  # 1: found in another text, 2: leads, 4: open
        marks[order] = twin + 2 * lead + 4 * (edge & (lead | ~twin))
        cuts = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (marks[1:] != marks[:-1]) | (marks[1:] > 3))))
        last = np.append(cuts[1:], len(h)) - 1
        keep = (marks[cuts] & 5) > 0
        cuts, last = cuts[keep], last[keep]
        marks = marks[cuts]
        found = [hashes[cuts], at[cuts].astype(np.int32), at[last].astype(np.int32), *((marks & m) > 0 for m in (1, 2, 4)), np.full(len(cuts), before + number)]
        yield pa.RecordBatch.from_arrays([rows.column(1).take(pa.array(row[cuts])), *map(pa.array, found)], ["id", "hash", "at", "to", "twin", "lead", "open", "part"])


def repeated(rows: DataFrame, within: bool = False) -> DataFrame:
    """(id, at, to, lead): ranges of places of the rows (hash, id, at) whose hash is found in another text too; lead marks the first of them in order of id and at.

    Rows may hold windows, the hashes of this place and those after it; then these are looked for, and hash is a key that equal ones
    have in common. With within, hashes that are found at another place of the same text count as well.

    Sorted by ranges of (hash, id, at), so equal hashes may spread over many partitions; what meets at the ends of
    their batches is settled from few of each batch. The rows are cut first, as the sort by ranges reads them twice.
    """
    ordered = cut(rows).repartitionByRange("hash", "id", "at").sortWithinPartitions("hash", "id", "at")
    kinds = {"hash": "bigint", "at": "int", "to": "int", "twin": "boolean", "lead": "boolean", "open": "boolean", "part": "bigint"}
    schema = T.StructType([field("id", rows.schema["id"].dataType), *(field(n, k) for n, k in kinds.items())])
    seen = cut(ordered.mapInArrow(partial(_neighbours, within=within), schema))
    ends = seen.where("open")
    met = ends.groupBy("hash", "id", "at").agg(F.count(F.lit(1)).alias("n"), F.bool_or("twin").alias("twin"), F.min("part").alias("part"))
    others = (F.min("id") != F.max("id")) | (F.max("n") > 1) | F.bool_or("twin")
    if within:
        others = others | (F.count(F.lit(1)) > 1)
    met = met.groupBy(F.col("hash").alias("h")).agg(others.alias("others"), F.min("part").alias("p")).where("others")
    settled = ends.join(met, F.col("hash") == F.col("h")).select("id", "at", "to", (F.col("lead") & (F.col("part") == F.col("p"))).alias("lead"))
    return seen.where("twin and not open").select("id", "at", "to", "lead").unionByName(settled)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", within: bool = False) -> DataFrame:
    """(id, text_hash, start, end, first): spans of words (end exclusive) that lie in passages of 50 words or more found in two or more texts.

    Words are runs of non-white-space (ASCII) and are compared exactly. first tells the spans that are the earliest copy, by id
    (null last), text_hash and place, from those that can be removed. text_hash tells texts that share an id; rows equal in both are
    copies of each other, and their spans are given once as first and once as not first. What only repeats within one text is left
    alone, unless `within` asks for it: its later places are then spans that are not first. Null and short texts have no passages.
    Other columns are not read.
    """
    text = F.col(text_col).cast("binary")
    known = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"))
    base = docs.select(known.alias("id"), text.alias("text"))
    kind = base.schema["id"].dataType
    schema = T.StructType([field("hash", "bigint"), field("id", kind), field("at", "int")])
    found = repeated(base.mapInArrow(_suffixes, schema), within)
    # a text's places once, however many rows hold it: no more numbers than the text has words
    places = found.groupBy(F.col("id").alias("_id")).agg(F.collect_set("at").alias("places"))
    around = base.join(places, F.col("id") == F.col("_id")).select("id", "text", "places")
    rows = T.StructType([*schema.fields, field("windows", "binary")])
    copies = repeated(around.mapInArrow(_windows, rows), within)
    by_place = Window.partitionBy("id", "lead").orderBy("at", "to")
    before = F.max("to").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    copies = copies.distinct().withColumn("_new", (F.col("at") - before > PASSAGE).cast("int"))
    spans = copies.withColumn("_span", F.sum(F.coalesce("_new", F.lit(0))).over(by_place))
    spans = spans.groupBy("id", "lead", "_span").agg(F.min("at").alias("start"), (F.max("to") + PASSAGE).alias("end"))
    return spans.select("id.id", "id.text_hash", "start", "end", F.col("lead").alias("first"))
