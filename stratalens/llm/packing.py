"""Packing documents into training sequences: Martello-Toth reduction, then best fit.

Token lengths are whole numbers of at most the sequence length, so an instance of any size is a histogram with that
many counters. The driver plans on the histogram: the reduction fixes sets that provably dominate all alternatives
for the largest item they hold, as often as the counters allow, and best fit decreasing packs what is left, again many
equal sequences at a time. The plan says, for the items of one length by their number, which sequences they go to. Its
size depends on the sequence length, not on the number of documents. Numbering the items of a length and
looking up their places are distributed.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.llm import tokens
from stratalens.llm.common import cut, field, running_sums, slices, unit_hash

CAPACITY = 2048


class Stock:
    """Counts of items by size, with the sizes that are in stock kept in order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {s: n for s, n in counts.items() if n}
        self.sizes = sorted(self.counts)

    def take(self, size: int, n: int) -> None:
        self.counts[size] -= n
        if not self.counts[size]:
            del self.counts[size], self.sizes[bisect_left(self.sizes, size)]

    def largest(self, most: int, without: int = 0) -> int:
        """Largest size of at most `most`, when one item of size `without` is already used; 0 if none."""
        i = bisect_right(self.sizes, most) - 1
        if i >= 0 and self.sizes[i] == without and self.counts[without] < 2:
            i -= 1
        return self.sizes[i] if i >= 0 else 0

    def smallest(self, n: int, without: int) -> list[int]:
        """Up to n smallest items when one item of size `without` is used."""
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(n, self.counts[s] - (s == without))
            if len(out) >= n:
                break
        return out[:n]


def _dominating(stock: Stock, w: int, capacity: int) -> list[int] | None:
    """Sizes to put with one item of size w in a set that dominates every feasible set with that item, or None."""
    room = capacity - w
    k = stock.largest(room, w)
    if not k:
        return []
    if k == room:
        return [k]  # fills the sequence: whatever else could stand beside w fits into k's place
    low = stock.smallest(3, w)
    if len(low) < 2 or low[0] + low[1] > room:
        return [k]  # only one more item fits, so the largest is best
    if len(low) == 3 and sum(low) <= room:
        return None  # sets of four and more are not looked into
    # The best second item for each first one, the larger of the two first.
    pairs = []
    for a in stock.sizes:
        left = stock.counts[a] - (a == w)
        b = stock.largest(min(a, room - a), w) if left and a < room else 0
        if b == a and left < 2:
            b = stock.largest(a - 1 if a - 1 <= room - a else room - a, w)
        if b:
            pairs.append((a, b))
    if max(a + b for a, b in pairs) <= k:
        return [k]
    a, b = max(pairs, key=lambda p: (p[0] + p[1], p[0]))
    if k <= a and all((x <= a and y <= b) or x + y <= a for x, y in pairs):
        return [a, b]
    return None


def reduce_instance(stock: Stock, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Fix dominating sets until none is found; the stock keeps the rest. Gives (pattern, number of sequences)."""
    fixed, again = [], True
    while again:
        again = False
        for w in sorted(stock.sizes, reverse=True):
            while stock.counts.get(w):
                beside = _dominating(stock, w, capacity)
                if beside is None:
                    break
                need: dict[int, int] = {}
                for s in [w, *beside]:
                    need[s] = need.get(s, 0) + 1
                # Taking items away leaves fewer alternatives, so the set dominates as long as it is in stock.
                n = min(stock.counts[s] // q for s, q in need.items())
                for s, q in need.items():
                    stock.take(s, n * q)
                fixed.append((sorted(need.items(), reverse=True), n))
                again = True
    return fixed


def best_fit(stock: Stock, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit decreasing on counts: each size fills the tightest open sequences first."""
    open_: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern, n: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((pattern, n))

    for w in sorted(stock.sizes, reverse=True):
        left = stock.counts[w]
        while left:
            i = bisect_left(rooms, w)
            if i < len(rooms):
                room = rooms[i]
                pattern, n = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[i]
                q = min(room // w, left)  # after one item the same sequence is still the tightest with room
                m = min(n, left // q)
                if n > m:
                    put(room, pattern, n - m)
            else:
                room, pattern = capacity, []
                q = min(room // w, left)
                m = left // q
            put(room - q * w, [*pattern, (w, q)], m)
            left -= q * m
    return [x for groups in open_.values() for x in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Where items go: rows (size, first, q, sequence, offset), sorted by size and first.

    Item number r of that size, from `first` up to the next row's, stands in sequence + (r - first) // q, at
    offset + ((r - first) % q) * size.
    """
    stock = Stock(counts)
    patterns = reduce_instance(stock, capacity) + best_fit(stock, capacity)
    rows, used, sequence = [], dict.fromkeys(counts, 0), 0
    for pattern, n in patterns:
        offset = 0
        for size, q in pattern:
            rows.append((size, used[size], q, sequence, offset))
            used[size] += n * q
            offset += size * q
        sequence += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {name: table[:, i] for i, name in enumerate(("size", "first", "q", "sequence", "offset"))}


def _pieces(batches, path: str, capacity: int):
    """Documents to pieces; whatever is longer than a sequence is cut, its first piece taking what is left over."""
    for batch in slices(batches):
        ids, out = [], {"piece": [], "start": [], "length": [], "crc": []}
        for row, blob in enumerate(tokens.encoder(path).encode_many(batch.column(1).to_pylist())):
            blob += b"\0\0\0\0"
            n = len(blob) // 4
            head = n % capacity or capacity
            start = 0
            for piece, end in enumerate(range(head, n + 1, capacity)):
                ids.append(row)
                out["piece"].append(piece)
                out["start"].append(start)
                out["length"].append(end - start)
                out["crc"].append(zlib.crc32(blob[4 * start : 4 * end]))
                start = end
        of = pa.array(ids, pa.int64())
        columns = [batch.column(0).take(of), batch.column(2).take(of), pa.array(out["piece"], pa.int32()), *(pa.array(out[c], pa.int64()) for c in ("start", "length", "crc"))]
        yield pa.RecordBatch.from_arrays(columns, ["id", "row", "piece", "start", "length", "crc"])


def _places(batches, where: dict[str, np.ndarray], capacity: int):
    key = where["size"] << 48 | where["first"]  # sorted as the plan is
    for batch in batches:
        size, number = batch.column(3).to_numpy(), batch.column(5).to_numpy()
        at = np.searchsorted(key, size << 48 | number, side="right") - 1
        number = number - where["first"][at]
        q = where["q"][at]
        place = [where["sequence"][at] + number // q, where["offset"][at] + number % q * size]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], *map(pa.array, place)], [*batch.schema.names[:5], "sequence_id", "offset"])


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, crc, sequence_id, offset.

    A null text is an empty document, which is its end token alone. Rows that repeat an id are documents of their
    own, and equal ones are interchangeable. An empty table packs into nothing. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    schema = T.StructType([field("id", kind), field("row", "bigint"), field("piece", "int"), field("start", "bigint"), field("length", "bigint"), field("crc", "bigint")])
    pieces = cut(base.mapInArrow(partial(_pieces, path=path or tokens.default_path(), capacity=capacity), schema))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    where = plan(counts, capacity)
    # by row, as many rows may have one id or none
    order = unit_hash(F.col("row"), F.col("piece"))
    numbered = running_sums(pieces, "length", order, [F.col("row"), F.col("piece")], [], 256)
    numbered = numbered.select("id", "piece", "start", "length", "crc", F.col("before_rows").alias("number"))
    out = T.StructType([*(f for f in schema.fields if f.name != "row"), field("sequence_id", "bigint"), field("offset", "bigint")])
    return numbered.mapInArrow(partial(_places, where=where, capacity=capacity), out)
