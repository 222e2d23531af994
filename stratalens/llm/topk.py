"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors are cut into blocks of consecutive ids. For each dimension (a "term" of the vector) a block keeps its largest
and its smallest value; summed over the dimensions, the larger of the two products with the query's value bounds every
score in the block. A query visits the blocks it meets in order of these bounds, scores them through their forward
indexes and stops at the first whose bound is below its k-th best score so far.

Blocks come in ranges of a few, queries in groups of many, and a task streams ranges past a group that it holds. Three
passes: every query finds the range with its highest bound; these ranges are scored, which sets a threshold; then the
bounds tell which other ranges a group needs at all, and only those are sent to it. What is written is the k best of a query
per deck of ranges, one row for a group and a range, and never a row for a query and a block. A bound that equals the
threshold is still visited, so ties are exact.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalens.llm.common import cut

BLOCK = 512
RANGE = 4  # blocks in a range
GROUP = 1024  # queries in a group
LEAST, MOST = -(2**63) + 1, 2**63 - 1  # scores beyond a long are held at its ends

_ITEMS = "dim int, item bigint, ids binary, rows binary, values binary, hi binary, lo binary"
_SCORES = "qrow bigint, query bigint, grp bigint, q int, vec bigint, row bigint, score bigint"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, id, dim, v) of the vectors that take part: null ones and those with null or non-finite components do not."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.coalesce(F.col(vector_col).isNotNull() & fine, F.lit(False)) & F.col(id_col).isNotNull())
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), F.size(vector_col).alias("dim"), v.alias("v"))


def _runs(batches, size: int, scale: int):
    """(dim, ids, rows, matrix of floor(scale * x)) for runs of up to `size` vectors of one length, from rows sorted by dim."""
    held, n, dim = [], 0, -1

    def done():
        ids, rows, m = (np.concatenate(x) for x in zip(*held))
        return dim, ids, rows, np.clip(np.floor(m * scale), -1.7e308, 1.7e308)

    for batch in batches:
        dims, at = batch.column("dim").to_numpy(), 0
        while at < len(dims):
            if n and (dims[at] != dim or n == size):
                yield done()
                held, n = [], 0
            dim = int(dims[at])
            end = min(int(np.searchsorted(dims, dim, "right")), at + size - n)
            part = batch.slice(at, end - at)
            held.append((part.column("id").to_numpy(), part.column("row").to_numpy(), part.column("v").flatten().to_numpy().reshape(end - at, dim)))
            n, at = n + end - at, end
    if n:
        yield done()


def _row(*values):
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds)], names=[c.split()[0] for c in _ITEMS.split(", ")])


def _ranges(batches, scale: int, block: int, blocks: int):
    """Forward indexes: one row per range, with the bounds of its blocks by dimension."""
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 24
    with np.errstate(over="ignore"):
        for i, (dim, ids, rows, m) in enumerate(_runs(batches, block * blocks, scale)):
            parts = [m[a : a + block] for a in range(0, len(m), block)]
            hi, lo = np.array([x.max(0) for x in parts]), np.array([x.min(0) for x in parts])
            small = not m.size or np.abs(m).max() < 1 << 31
            yield _row(dim, first + i, ids.tobytes(), rows.tobytes(), m.astype("<i4" if small else "<f8").tobytes(), hi.tobytes(), lo.tobytes())


def _groups(batches, scale: int, size: int):
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 24
    with np.errstate(over="ignore"):
        for i, (dim, ids, rows, m) in enumerate(_runs(batches, size, scale)):
            yield _row(dim, first + i, ids.tobytes(), rows.tobytes(), m.tobytes(), None, None)


class Queries:
    """A group of queries with what is known of their k best so far."""

    def __init__(self, r: dict, k: int):
        self.grp, self.dim, self.k = r["grp"], r["dim"], k
        self.ids, self.rows = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["rows"], np.int64)
        self.m = np.frombuffer(r["values"]).reshape(len(self.ids), self.dim)
        self.up, self.down = np.maximum(self.m, 0), np.minimum(self.m, 0)
        known = {x["q"]: x for x in r["known"] or ()}
        self.limit = np.array([known[q]["kth"] if q in known and known[q]["kth"] is not None else LEAST for q in range(len(self.ids))], np.int64)
        self.seen = np.array([known[q]["item"] if q in known else -1 for q in range(len(self.ids))], np.int64)
        self.best: dict[int, tuple] = {}

    def bounds(self, hi: bytes, lo: bytes, asked=slice(None)) -> np.ndarray:
        """Of asked queries by blocks; no score in a block is above, whatever the rounding."""
        hi, lo = (np.frombuffer(x).reshape(-1, self.dim) if self.dim else np.zeros((1, 0)) for x in (hi, lo))
        with np.errstate(over="ignore", invalid="ignore"):
            b = self.up[asked] @ hi.T + self.down[asked] @ lo.T
            size = np.abs(self.m[asked]) @ np.maximum(np.abs(hi), np.abs(lo)).T
            return np.where(np.isfinite(b) & np.isfinite(size), b + 1e-9 * size, np.inf)

    def products(self, asked: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Exact integer inner products, held at the ends of a long."""
        q = self.m[asked]
        most = float(np.abs(q).max(initial=0)) * float(np.abs(m).max(initial=0)) * max(1, self.dim)
        if most < 1 << 53:
            return (q @ m.T).astype(np.int64)
        if most < 1 << 62:
            return q.astype(np.int64) @ m.astype(np.int64).T
        whole = lambda x: np.array([[int(y) for y in r] for r in x.tolist()], object).reshape(x.shape)
        return np.clip(whole(q) @ whole(m).T, LEAST, MOST).astype(np.int64)

    def visit(self, r: dict, block: int) -> None:
        ids, rows = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["rows"], np.int64)
        small = len(r["values"]) == 4 * len(ids) * self.dim
        m = np.frombuffer(r["values"], "<i4" if small else "<f8").reshape(len(ids), self.dim).astype(float)
        asked = np.array(r["asked"], np.int64)
        bounds = self.bounds(r["hi"], r["lo"], asked)
        order = np.argsort(-bounds, axis=1, kind="stable")
        for turn in range(bounds.shape[1]):
            at = order[:, turn]
            live = bounds[np.arange(len(asked)), at] >= self.limit[asked].astype(float)
            if not live.any():
                break  # bounds only fall from here on
            for b in np.unique(at[live]):
                self._score(asked[live & (at == b)], ids[b * block : (b + 1) * block], rows[b * block : (b + 1) * block], m[b * block : (b + 1) * block])

    def _score(self, asked, ids, rows, m) -> None:
        scores = self.products(asked, m)
        hits = (scores >= self.limit[asked][:, None]) & (rows[None, :] != self.rows[asked][:, None])
        for i in np.flatnonzero(hits.any(axis=1)):
            q, at = int(asked[i]), np.flatnonzero(hits[i])
            s, v, w = scores[i, at], ids[at], rows[at]
            if q in self.best:
                s, v, w = (np.concatenate(x) for x in zip(self.best[q], (s, v, w)))
            top = np.lexsort((w, v, -s))[: self.k]
            self.best[q] = s[top], v[top], w[top]
            if len(top) == self.k:
                self.limit[q] = max(self.limit[q], s[top[-1]])

    def result(self):
        found = sorted(self.best.items())
        q = np.repeat(np.array([x for x, _ in found], np.int64), [len(b[0]) for _, b in found])
        s, v, w = (np.concatenate(x) for x in zip(*(b for _, b in found))) if found else [np.array([], np.int64)] * 3
        columns = [self.rows[q], self.ids[q], np.full(len(q), self.grp), q.astype(np.int32), v, w, s]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in _SCORES.split(", ")])


def _segments(batches, k: int):
    """(queries, row of a range, or None at the end of a group's deck)."""
    group = None
    for batch in batches:
        for i in range(len(batch)):
            r = batch.slice(i, 1).to_pylist()[0]
            if r["kind"]:
                yield group, r
                continue
            if group:
                yield group, None
            group = Queries(r, k)
    if group:
        yield group, None


def _favourites(batches):
    """Per query the range with its highest bound."""
    best = item = None
    for group, r in _segments(batches, 1):
        if best is None:
            best, item = np.full(len(group.ids), -np.inf), np.full(len(group.ids), -1)
        if r is None:
            columns = [np.full(len(best), group.dim, np.int32), np.full(len(best), group.grp), np.arange(len(best), dtype=np.int32), item, best]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["dim", "grp", "q", "item", "bound"]).filter(pa.array(item >= 0))
            best = None
            continue
        b = group.bounds(r["hi"], r["lo"]).max(axis=1)
        better = (b > best) | (item < 0)
        best, item = np.where(better, b, best), np.where(better, r["item"], item)


def _needed(batches):
    """Ranges that a group has still to visit, and which of its queries do."""
    for group, r in _segments(batches, 1):
        if r is not None:
            b = group.bounds(r["hi"], r["lo"]).max(axis=1)
            asked = np.flatnonzero((b >= group.limit.astype(float)) & (group.seen != r["item"]))
            if len(asked):
                row = [group.dim, group.grp, r["item"], asked.tolist(), float(b[asked].max())]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.float64()))], names=["dim", "grp", "item", "asked", "bound"])


def _visits(batches, k: int, block: int):
    for group, r in _segments(batches, k):
        if r is None:
            yield group.result()
        else:
            group.visit(r, block)


_HEAD = ["dim", "grp", "deck", "kind", "item", "ids", "rows", "values", "hi", "lo", "known", "asked", "bound"]


def _meet(groups: DataFrame, items: DataFrame, decks: int) -> DataFrame:
    """Groups, each once per deck, and after each the items (with dim, grp, deck) of that group and deck, by falling bound."""
    heads = groups.withColumn("deck", F.explode(F.sequence(F.lit(0), F.lit(decks - 1)))).withColumn("kind", F.lit(0))
    items = items.withColumn("kind", F.lit(1))
    both = [x.select(*(F.col(c) if c in x.columns else F.lit(None).cast(kind).alias(c) for c, kind in _kinds().items())) for x in (heads, items)]
    return both[0].unionByName(both[1]).repartition("grp", "deck").sortWithinPartitions("grp", "deck", "kind", F.desc("bound"), "item")


def _kinds() -> dict[str, str]:
    kinds = {c.split()[0]: c.split()[1] for c in _ITEMS.split(", ")}
    kinds |= {"grp": "bigint", "deck": "int", "kind": "int", "known": "array<struct<q:int,item:bigint,kth:bigint>>", "asked": "array<int>", "bound": "double"}
    return {c: kinds[c] for c in _HEAD}


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qrow").orderBy(F.desc("score"), "vec", "row")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(query, rank, vec, score): for each row whose id is divisible by `every`, the k rows of highest integer inner product.

    A query meets every other row of its own length, also one that repeats its id or its values, but not itself; ties
    go to the smaller id. Only vectors that are null or hold null or non-finite components, and rows with a null id, take no part;
    empty vectors meet each other with score 0. Scores are exact whatever the components' size; one beyond a long is
    held at its end. An empty table gives no rows. Columns other than the two named are not read.
    """
    rows = cut(usable(vectors, id_col, vector_col))
    asks = F.col("id") % every == 0
    total, asking = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(asks.cast("int")), F.lit(0))).first()
    n = max(1, total // (4 * block * RANGE))
    ranged = rows.repartitionByRange(n, "dim", "id", "row").sortWithinPartitions("dim", "id", "row")
    ranges = cut(ranged.mapInArrow(partial(_ranges, scale=scale, block=block, blocks=RANGE), _ITEMS))
    queries = rows.where(asks).repartition(max(1, asking // (4 * group))).sortWithinPartitions("dim", "id", "row")
    groups = cut(queries.mapInArrow(partial(_groups, scale=scale, size=group), _ITEMS).withColumnRenamed("item", "grp").drop("hi", "lo"))
    # Few groups are met by many decks, so that there is work for many tasks; many groups need few decks.
    decks = max(1, min(ranges.count(), max(4, 256 // max(1, groups.count()))))
    deck = F.pmod(F.xxhash64("item"), F.lit(decks)).cast("int").alias("deck")

    outlines = ranges.select("dim", "item", deck, "hi", "lo")
    keys = groups.select("dim", "grp", F.explode(F.sequence(F.lit(0), F.lit(decks - 1))).alias("deck"))
    outlines = outlines.join(keys, ["dim", "deck"])
    liked = _meet(groups, outlines, decks).mapInArrow(_favourites, "dim int, grp bigint, q int, item bigint, bound double")
    liked = cut(liked.groupBy("dim", "grp", "q").agg(F.max_by("item", F.struct("bound", "item")).alias("item")))
    wanted = liked.groupBy("dim", "grp", "item").agg(F.collect_list("q").alias("asked")).withColumn("bound", F.lit(0.0))  # at most `group` of them

    def score(asked: DataFrame, known: DataFrame) -> DataFrame:
        items = ranges.withColumn("deck", deck).join(asked, ["dim", "item"])
        return _meet(known, items, decks).mapInArrow(partial(_visits, k=k, block=block), _SCORES)

    first = cut(score(wanted, groups))
    kth = _best(first, k).where(F.col("rank") == k).select("grp", "q", F.col("score").alias("kth"))
    known = liked.join(kth, ["grp", "q"], "left").groupBy("grp").agg(F.collect_list(F.struct("q", "item", "kth")).alias("known"))
    informed = cut(groups.join(known, "grp", "left"))
    needed = cut(_meet(informed, outlines, decks).mapInArrow(_needed, "dim int, grp bigint, item bigint, asked array<int>, bound double"))
    scores = first.unionByName(score(needed, informed))
    return _best(scores, k).select("query", F.col("rank").cast("int").alias("rank"), "vec", "score")


#: DuckDB's statement of the same search over `embeddings`.
ORACLE = """
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
  CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM q a, q b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
