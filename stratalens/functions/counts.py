"""The aggregations that all analyses are made of. Each is one lazy plan over a normalised frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalens.functions.cube import FEW_COLUMNS, Cube, sizes_of, union_of
from stratalens.functions.values import melt, quoted, widened

def rows_() -> Column:
    return F.count(F.lit(1))


def complete(frame: DataFrame, columns) -> DataFrame:
    """Rows without a missing value in the columns."""
    for c in columns:
        frame = frame.where(quoted(c).isNotNull())
    return frame


def value_counts(frame: DataFrame, kinds: dict, columns: list[str], dropna: bool = False) -> DataFrame:
    """(feature, value, n) of all columns in one pass."""
    held = {kinds[c] for c in columns}
    cells = melt(frame, kinds, columns, narrow=held)
    if dropna:
        cells = cells.where(~F.col("value.absent"))
    return cells.groupBy("feature", "value").agg(rows_().alias("n")).select("feature", widened(F.col("value"), held).alias("value"), "n")


def ranked(counts: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Counts with their rank within `by`, most frequent first and ties in canonical order."""
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), *order)))


#: Ranks up to which Spark keeps the first rows of each partition before a window's exchange (its own default), and shares of a group beyond.
GROUP_LIMIT, SHARES = 1000, 64


def first_ranked(counts: DataFrame, by: list[str], order: list[Column], most: int | None) -> DataFrame:
    """The first `most` of ranked(), where no task sees more of a group than it needs.

    Without a group every task keeps its own first rows. With many ranks per group, first the first rows of each hash share of a
    group are kept. None asks for all ranks, which one task per group then has to sort.
    """
    if most is None:
        return ranked(counts, by, order)
    if not by:
        return ranked(counts.orderBy(F.desc("n"), *order).limit(most), by, order)
    if most > GROUP_LIMIT:
        names = [c for c in counts.columns if c not in by]
        counts = counts.withColumn("_share", F.pmod(F.xxhash64(*(quoted(c) for c in names)), F.lit(SHARES)))
        counts = ranked(counts, [*by, "_share"], order).where(F.col("rank") <= most).drop("_share", "rank")
    return ranked(counts, by, order).where(F.col("rank") <= most)


#: Rows whose numbers one task adds up when rows are numbered by blocks.
BLOCK = 1 << 16


def earlier_sum(sizes: DataFrame, number: str, size: str) -> DataFrame:
    """(number, before): for each of the rows, numbered without gaps to speak of, the sum of size over smaller numbers.

    Sums of blocks of numbers are added up first, then the rows inside each block, so no task sees more than a block or the blocks.
    """
    block = F.floor(F.col(number) / BLOCK).alias("_block")
    blocks = sizes.groupBy(block).agg(F.sum(size).alias("_in_block"))
    order = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("_block").alias("_b"), F.coalesce(F.sum("_in_block").over(order), F.lit(0)).alias("_blocks"))
    inside = Window.partitionBy("_block").orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.select(number, size, block).withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return rows.join(blocks, F.col("_block") == F.col("_b")).select(number, (F.col("_blocks") + F.col("_inside")).alias("before"))


def group_sizes(frame: DataFrame, keys: list[str], targets: list[str], kinds: dict, by: list[str] = (), position: str | None = None) -> DataFrame:
    """(_g0.., feature, value, n): rows per group and value of each target, the finest counts of a dependency test.

    The grouping columns go by number, so that a column may have any name. With position, first is the least position of the rows.
    """
    keep = list(dict.fromkeys([*by, *keys]))
    wanted = list(targets)
    held = {kinds[t] for t in wanted}
    extra = [] if position is None else [quoted(position).alias("_p")]
    named = frame.select(*(quoted(c).alias(f"_g{i}") for i, c in enumerate(keep)), *(quoted(t).alias(f"_t{i}") for i, t in enumerate(wanted)), *extra)
    cells = melt(named, {f"_t{i}": kinds[t] for i, t in enumerate(wanted)}, [f"_t{i}" for i in range(len(wanted))], [*numbered(keep), *(["_p"] if extra else [])], labels=wanted, narrow=held)
    counts = cells.groupBy(*numbered(keep), "feature", "value").agg(rows_().alias("n"), *([F.min("_p").alias("first")] if extra else []))
    return counts.select(*numbered(keep), "feature", widened(F.col("value"), held).alias("value"), "n", *(["first"] if extra else []))


def numbered(columns) -> list[str]:
    return [f"_g{i}" for i in range(len(columns))]


def modal(counts: DataFrame, groups: list[str], dropna: bool = True, missing_first: bool = True) -> DataFrame:
    """Per group and feature: size, rows with a missing target, size of the mode, distinct targets, the mode itself; first if counts have it.

    With dropna the missing target is left out of size, mode and distinct. Ties go to the smallest value; a missing
    one counts as the smallest if missing_first, else as the largest.
    """
    absent = F.col("value.absent")
    first = [F.min(F.when(~absent, F.col("first")) if dropna else F.col("first")).alias("first")] if "first" in counts.columns else []
    counted = F.when(~absent, F.col("n")) if dropna else F.col("n")
    order = F.struct((-counted).alias("n"), (~absent if missing_first else absent).alias("a"), F.col("value").alias("v"))
    best = F.min(F.when(~absent, order) if dropna else order)
    return counts.groupBy(*map(quoted, groups), "feature").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(~absent, F.col("n"))), F.lit(0)).alias("observed"),
        F.coalesce(F.sum(counted), F.lit(0)).alias("size"),
        F.coalesce(F.max(counted), F.lit(0)).alias("largest"),
        F.count(counted).alias("distinct"),
        best["v"].alias("mode"),
        *first,
    )


def dependency_measures(groups: DataFrame, by: list[str] = ()) -> DataFrame:
    """The measures of key -> feature from modal() rows, per context and feature."""
    real = F.col("size") > 0
    broken, again = F.col("distinct") > 1, F.col("size") > 1
    some = lambda c, x=None: F.coalesce(F.sum(F.when(c, F.lit(1) if x is None else x)), F.lit(0)).cast("bigint")
    out = groups.groupBy(*map(quoted, by), "feature").agg(
        F.sum("rows").alias("determinant_evaluated_rows"),
        F.sum("observed").alias("target_observed_rows"),
        F.sum("size").alias("evaluated_rows"),
        some(real).alias("evaluated_groups"),
        some(broken).alias("violating_groups"),
        some(broken, F.col("size")).alias("affected_rows"),
        F.sum(F.col("size") - F.col("largest")).alias("repair_rows"),
        some(again).alias("repeated_groups"),
        some(again, F.col("size")).alias("repeated_rows"),
        some(F.col("size") == 1).alias("singleton_groups"),
    )
    return out


#: Sets counted in one job.
SETS = 60


def distinct_groups(frame: DataFrame, sets: list[tuple[str, ...]], rows: int | None = None, sizes: dict | None = None) -> list[int]:
    """How many distinct value combinations each set of columns has, missing being a value.

    rows and sizes are what is expected of the frame, if that is known (see Cube).
    """
    found: dict[int, int] = {}
    if sizes is None and len(sets) > SETS:
        rows, sizes = sizes_of(frame, sets)
    for at in range(0, len(sets), SETS):
        part = sets[at : at + SETS]
        cube = Cube(frame, part, rows, sizes, weighed=False)
        counts = union_of([cube.table(s).agg(F.lit(i).alias("i"), rows_().alias("k")) for i, s in enumerate(part, at)])
        found |= {r["i"]: r["k"] for r in counts.collect()}
    return [found[i] for i in range(len(sets))]


def impurity(frame: DataFrame, sets: list[tuple[str, ...]], label: Column) -> list[float]:
    """For each set of columns the share of rows without the most common label of their group."""
    if not sets:
        return []
    labelled = frame.withColumn("_label", label)
    cube = Cube(labelled, [(*s, "_label") for s in sets])
    parts = []
    for i, s in enumerate(sets):
        groups = cube.table((*s, "_label")).groupBy(*(cube.number(c) for c in s)).agg(F.sum("n").alias("n"), F.max("n").alias("m"))
        parts.append(groups.agg(F.lit(i).alias("i"), F.sum("n").alias("n"), F.sum("m").alias("m")))
    found = {r["i"]: (1 - r["m"] / r["n"] if r["n"] else 0.0) for r in union_of(parts).collect()}
    return [found[i] for i in range(len(sets))]


#: Counts in one aggregation.
SUMS = 200


def complete_counts(frame: DataFrame, sets) -> dict[frozenset, int]:
    """How many rows have all columns of each set, in one pass for some hundred sets."""
    wanted = sorted({frozenset(s) for s in sets}, key=sorted)
    found: dict[frozenset, int] = {}
    for at in range(0, len(wanted), SUMS):
        part = wanted[at : at + SUMS]
        each = []
        for i, s in enumerate(part):
            held = F.lit(True)
            for c in sorted(s):
                held = held & quoted(c).isNotNull()
            each.append(F.count_if(held).alias(f"_{i}"))
        row = frame.agg(*each).first()
        found |= {s: row[f"_{i}"] for i, s in enumerate(part)}
    return found


class GroupCounts:
    """Distinct counts of column sets over populations of complete cases, each asked of Spark once.

    A population is named by the columns that its rows have; columns without gaps do not narrow it.
    """

    def __init__(self, frame: DataFrame, rows: int, columns):
        self.frame, self.rows, self.columns = frame, rows, list(columns)
        self.known: dict[tuple[frozenset, frozenset], int] = {}
        self.sizes: dict[frozenset, int] = {frozenset(): rows}
        self._gaps: set[str] | None = None
        self._sizes: tuple[int, dict] | None = None

    @property
    def gaps(self) -> set[str]:
        if self._gaps is None:
            held = self.frame.agg(*(F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(self.columns))).first() if self.columns else ()
            self._gaps = {c for c, n in zip(self.columns, held) if n < self.rows}
        return self._gaps

    def size(self, population=()) -> int:
        where = frozenset(population) & self.gaps if population else frozenset()
        if where not in self.sizes:
            self.sizes[where] = complete(self.frame, sorted(where)).count()
        return self.sizes[where]

    def ask(self, sets, population=()) -> dict[frozenset, int]:
        where = frozenset(population) & self.gaps if population else frozenset()
        wanted = [frozenset(s) for s in dict.fromkeys(map(frozenset, sets))]
        new = [s for s in wanted if (where, s) not in self.known]
        if new:
            if self._sizes is None and len(self.columns) > FEW_COLUMNS:  # of all rows, a bound for every population
                self._sizes = sizes_of(self.frame, [(c,) for c in self.columns])
            found = distinct_groups(complete(self.frame, sorted(where)), [tuple(sorted(s)) for s in new], *(self._sizes or (None, None)))
            self.known |= {(where, s): n for s, n in zip(new, found)}
        return {s: self.known[where, s] for s in wanted}
