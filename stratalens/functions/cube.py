"""Counts of many sets of columns from few passes over the rows.

Sets that are contained in others need no rows: each is summed up from the smallest set above it that is counted anyway. What
is left are the largest sets. Those whose union has few groups, or hardly more than the larger one of them, are counted together as that
union, and the remaining ones in one pass, as grouping sets. What is expected comes from one pass that sketches the sets' numbers of
groups; a few columns are one union without asking. The counts are one lazy plan, in which Spark runs the pass over the rows
once, for all that is derived from it.
"""

from __future__ import annotations

from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.functions.values import quoted

#: A union of sets is counted in their place if it is expected to have at most one group for so many rows.
ROWS_PER_GROUP = 16
#: So many times the groups of the larger of two sets may their union have, to be counted in their place.
HARDLY_MORE = 1.5
#: Up to so many columns are counted as one set without a sketch.
FEW_COLUMNS = 12
#: Grouping sets of one pass: each repeats the rows once before they are added up.
AT_ONCE = 12


def sizes_of(frame: DataFrame, sets) -> tuple[int, dict[frozenset, int]]:
    """The number of rows and, within a few percent, the number of groups of each set and each column of one; one pass."""
    sets = {frozenset(s) for s in sets}
    wanted = sorted(sets | {frozenset([c]) for s in sets for c in s}, key=sorted)
    # hash functions pass over missing values, so each value goes with whether it is there
    each = [F.approx_count_distinct(F.xxhash64(*(x for c in sorted(s) for x in (quoted(c), quoted(c).isNull())))) if s else F.lit(1) for s in wanted]
    found = frame.agg(F.count(F.lit(1)).alias("rows"), *(x.alias(f"_{i}") for i, x in enumerate(each))).first()
    return found["rows"], {s: max(1, found[f"_{i}"] or 1) for i, s in enumerate(wanted)}


class Cube:
    """Counts of given sets of columns of a frame, missing being a value.

    A set's table has the columns _c<number of the column> and n; number() tells which. An empty set's table is one row. With
    weighed=False n may be left out, where only the groups are asked for.
    """

    def __init__(self, frame: DataFrame, sets, rows: int | None = None, sizes: dict[frozenset, int] | None = None, weighed: bool = True):
        wanted = {frozenset(s) for s in sets}
        self.columns = sorted({c for s in wanted for c in s})
        self.names = {c: f"_c{i}" for i, c in enumerate(self.columns)}
        # of few columns, that is, if some set has a good part of them: else their union is no use to any set
        few = len(self.columns) <= FEW_COLUMNS and 2 * max(map(len, wanted), default=0) >= len(self.columns)
        if not few and sizes is None:
            rows, sizes = sizes_of(frame, wanted)
        self.rows, self.sizes, self.weighed = rows, sizes, weighed
        self.frame = frame.select(*(quoted(c).alias(self.names[c]) for c in self.columns))
        self.tables: dict[frozenset, DataFrame] = {}
        self.roots = [frozenset(self.columns)] if few else self._roots(wanted)
        for at in range(0, len(self.roots), AT_ONCE):
            self._count(self.roots[at : at + AT_ONCE])
        for s in sorted(wanted - self.tables.keys(), key=lambda s: (-len(s), sorted(s))):
            self.tables[s] = self._derived(s)

    def expected(self, columns) -> int:
        """The expected number of groups: the known one, or the product of the columns' levels, at most the number of rows.

        Without a sketch more columns are taken to have more groups.
        """
        if self.sizes is None:
            return len(columns)
        known = self.sizes.get(frozenset(columns))
        return known if known is not None else min(self.rows, prod(self.sizes[frozenset([c])] for c in columns))

    def _roots(self, wanted: set[frozenset]) -> list[frozenset]:
        largest = [s for s in wanted if not any(s < other for other in wanted)]
        out: list[frozenset] = []
        for s in sorted(largest, key=lambda s: (self.expected(s), sorted(s))):
            fits = [r for r in out if self.expected(r | s) <= max(self.rows // ROWS_PER_GROUP, HARDLY_MORE * max(self.expected(r), self.expected(s)))]
            if fits:
                best = min(fits, key=lambda r: self.expected(r | s))
                out[out.index(best)] = best | s
            else:
                out.append(s)
        return [r for i, r in enumerate(out) if not any(r < o or (r == o and i > j) for j, o in enumerate(out))]

    def _named(self, columns) -> list[str]:
        return [self.names[c] for c in self.columns if c in columns]

    def _count(self, roots: list[frozenset]) -> None:
        if len(roots) == 1:
            rows = self.frame.select(*self._named(roots[0]))
            self.tables[roots[0]] = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")) if self.weighed else rows.distinct()
            return
        used = self._named(frozenset().union(*roots))
        counted = self.frame.groupingSets([list(map(F.col, self._named(r))) for r in roots], *map(F.col, used)).agg(F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("n"))
        for r in roots:
            number = sum(1 << (len(used) - 1 - i) for i, c in enumerate(used) if c not in self._named(r))
            # the condition names n so that it stays above the counts, which all sets then share
            self.tables[r] = counted.where(F.when(F.col("n") > 0, F.col("_set")) == number).select(*self._named(r), "n")

    def _derived(self, columns: frozenset) -> DataFrame:
        above = min((t for t in self.tables if columns <= t), key=lambda t: (self.expected(t), len(t), sorted(t)))
        if not self.weighed:
            return self.tables[above].select(*self._named(columns)).distinct()
        return self.tables[above].groupBy(*self._named(columns)).agg(F.sum("n").alias("n"))

    def number(self, column: str) -> str:
        return self.names[column]

    def table(self, columns) -> DataFrame:
        """The counts of a set that was asked for."""
        return self.tables[frozenset(columns)]

    def complete(self, columns, needed=None) -> DataFrame:
        """The same without groups in which one of the needed columns (all of them, by default) is missing."""
        out = self.table(columns)
        for c in self._named(frozenset(columns if needed is None else needed)):
            out = out.where(F.col(c).isNotNull())
        return out


def union_of(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


