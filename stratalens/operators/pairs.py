"""pairs: the relation and association of column pairs, overall and in contexts, with combinations that never occur."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalens.context import Prepared, budgets, columns, prepare
from stratalens.functions.counts import first_ranked, rows_
from stratalens.functions.cube import Cube
from stratalens.functions.values import json_value, quoted, typed
from stratalens.operators.dependencies import collected
from stratalens.operators.levels import check_roles
from stratalens.result import Result
from stratalens.runtime import operation, phase

LIMITS = {"max_pairs": 15, "max_contexts": 32, "max_absence_cells": 1000, "max_marginal_levels": 10_000}


def association_table(cells: DataFrame) -> DataFrame:
    """One row from pair counts (a, b, n): rows, cells, levels of each side, widest fan-out each way, and the chi-square term.

    The margins come from windows over the pair counts, which are partitioned by one side at a time.
    """
    wa, wb = Window.partitionBy("a"), Window.partitionBy("b")
    wide = cells.select("a", "b", "n", F.sum("n").over(wa).alias("na"), F.count(F.lit(1)).over(wa).alias("fan_a"))
    wide = wide.select("*", F.sum("n").over(wb).alias("nb"), F.count(F.lit(1)).over(wb).alias("fan_b"))
    term = F.col("n").cast("double") * F.col("n") / (F.col("na").cast("double") * F.col("nb"))
    return wide.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        rows_().alias("cells"),
        F.count_distinct(F.struct("a")).alias("levels_a"),
        F.count_distinct(F.struct("b")).alias("levels_b"),
        F.coalesce(F.max("fan_a"), F.lit(0)).alias("fan_a"),
        F.coalesce(F.max("fan_b"), F.lit(0)).alias("fan_b"),
        F.coalesce(F.sum(term), F.lit(0.0)).alias("term"),
    )


def relation_table(cells: DataFrame) -> DataFrame:
    """association_table with the relation's class and Cramér's V (uncorrected)."""
    t = association_table(cells)
    many_a, many_b = F.col("fan_a") > 1, F.col("fan_b") > 1  # an a with several b's; a b with several a's
    relation = F.when(F.col("rows") == 0, None).when(many_a & many_b, "n:m").when(many_a, "1:n").when(many_b, "n:1").otherwise("1:1")
    least = F.least("levels_a", "levels_b") - 1
    n = F.col("rows").cast("double")
    v = F.when(least > 0, F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0.0), n * F.col("term") - n) / (n * least))))
    return t.select("rows", "cells", "levels_a", "levels_b", relation.alias("relation"), v.alias("cramers_v"))


def margin_table(cells: DataFrame, side: str) -> DataFrame:
    """(v, n): every level of one side of the pair counts with its rows."""
    return cells.groupBy(F.col(side).alias("v")).agg(F.sum("n").alias("n"))


def absent_table(cells: DataFrame, domain_a: DataFrame, domain_b: DataFrame, whole: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(a, b, reason) of the combinations of two domains that are never observed; with most, the first so many by a, then b, missing last.

    whole holds the pair counts of the whole population when cells are those of a context: levels that are found there
    but not here are absent under their parent.

    The domains are not multiplied. The levels of b are numbered in order, and what is absent for a level of a are the gaps between the
    numbers that are observed with it. For the first ones only the first levels of a that have a gap are looked at, and of b as many
    levels as those can have observed ones and gaps before the last one asked for.
    """
    in_order = lambda c: F.col(c).asc_nulls_last()
    levels_b = domain_b.select("b").distinct()
    size_b = levels_b.agg(rows_().alias("_size"))
    known = domain_a.select("a").distinct().withColumnRenamed("a", "_da")
    # the pairs inside both domains; what else is observed is absent from neither
    inside = cells.select("a", "b").join(levels_b.withColumnRenamed("b", "_db"), F.col("b").eqNullSafe(F.col("_db")), "left_semi")
    held = inside.groupBy("a").agg(rows_().alias("_held"))
    rows = known.join(held, F.col("_da").eqNullSafe(F.col("a")), "left").select(F.col("_da").alias("a"), F.coalesce("_held", F.lit(0)).alias("_held"))
    # the size of b's domain is one number, which a lazy table joins as one row
    rows = rows.join(F.broadcast(size_b), F.lit(True)) if most is None else rows.withColumn("_size", F.lit(size_b.first()[0]))
    rows = rows.where(F.col("_held") < F.col("_size"))
    if most is not None:
        before = Window.orderBy(in_order("a")).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.orderBy(in_order("a")).limit(most)  # each has a gap, so no more can be needed
        rows = rows.withColumn("_before", F.coalesce(F.sum(F.col("_size") - F.col("_held")).over(before), F.lit(0))).where(F.col("_before") < most)
        furthest = rows.agg(F.max("_held")).first()[0] or 0
        levels_b = levels_b.orderBy(in_order("b")).limit(most + furthest)
    numbers = levels_b.select(F.col("b").alias("_db"), F.row_number().over(Window.orderBy(in_order("b"))).alias("_i"))
    chosen = rows.select(F.col("a").alias("_ca"), *(["_before"] if most is not None else []), F.least("_size", F.lit(most) + F.col("_held") if most is not None else F.col("_size")).alias("_end"))
    seen = inside.join(chosen, F.col("a").eqNullSafe(F.col("_ca"))).join(numbers, F.col("b").eqNullSafe(F.col("_db"))).where(F.col("_i") <= F.col("_end"))
    marks = seen.select(*chosen.columns, "_i").unionByName(chosen.withColumn("_i", (F.col("_end") + 1).cast("int")))
    by_a = Window.partitionBy("_ca").orderBy("_i")
    gaps = marks.withColumn("_low", F.coalesce(F.lag("_i").over(by_a), F.lit(0)) + 1).where(F.col("_low") < F.col("_i"))
    last = F.col("_i") - 1
    if most is not None:
        earlier = F.coalesce(F.sum(F.col("_i") - F.col("_low")).over(by_a.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        gaps = gaps.withColumn("_room", F.lit(most) - F.col("_before") - earlier).where(F.col("_room") > 0)
        last = F.least(last, F.col("_low") + F.col("_room") - 1)
    absent = gaps.select(F.col("_ca").alias("a"), F.explode(F.sequence(F.col("_low").cast("bigint"), last.cast("bigint"))).alias("_at"))
    absent = absent.join(numbers, F.col("_at") == F.col("_i")).select("a", F.col("_db").alias("b"))
    for mark, among in (("here", cells), ("ever", whole if whole is not None else cells)):
        for side in "ab":
            found = among.select(F.col(side).alias("_seen")).distinct().withColumn(f"_{mark}_{side}", F.lit(True))
            absent = absent.join(found, F.col(side).eqNullSafe(F.col("_seen")), "left").drop("_seen")
    here, ever = (F.col(f"_{m}_a").isNotNull() & F.col(f"_{m}_b").isNotNull() for m in ("here", "ever"))
    return absent.select("a", "b", F.when(here, "within_observed_margins").when(ever, "level_absent_under_parent").otherwise("zero_support").alias("reason"))


@operation("pairs")
def pairs(df: DataFrame, dimensions, *, dropna: bool = False, include_absence: bool = False, reference_domains=None, pair_contexts=None, schema=None, limits=None, scope=None, missing=None, table_id: str = "table") -> Result:
    """Relation class, Cramér's V and margins of every column pair, overall and in each given context."""
    limit = budgets(limits, LIMITS)
    names = columns(df, dimensions)
    if len(names) < 2:
        raise ValueError("pairs needs at least two dimensions")
    given = [dict(c) for c in pair_contexts or []]
    fields = list(dict.fromkeys(c for g in given for c in g))
    columns(df, fields)
    domains = {c: list(v) for c, v in (reference_domains or {}).items()}
    columns(df, domains)
    ordered = [{}] + sorted((g for g in given if g), key=lambda g: sorted((k, str(type(v)), str(v)) for k, v in g.items()))
    p: Prepared = prepare(df, list(dict.fromkeys([*names, *fields])), scope=scope, missing=missing, table_id=table_id)
    asked = list(combinations(names, 2))
    chosen, used = asked[: limit["max_pairs"]], ordered[: max(1, limit["max_contexts"])]
    left = limit["max_absence_cells"]
    p.base["pairs"] = []
    tasks = [(a, b, context) for a, b in chosen for context in used]  # of each pair first without a context
    if any(set(context) & {a, b} for a, b, context in tasks):
        raise ValueError("a context column cannot be part of the pair")
    with phase("pairs", len(tasks)) as step:
        tables = cell_tables(p.frame, tasks, dropna)
        relations = {r["i"]: r for r in collected([relation_table(t).select(F.lit(i).alias("i"), "*") for i, t in enumerate(tables)])}
        sides: dict = {}
        for r in collected([_margins(p, t, i, s, tasks[i], limit["max_marginal_levels"]) for i, t in enumerate(tables) for s in "ab"]):
            sides.setdefault((r["i"], r["side"]), []).append((r["rank"], json_value(r["v"]), r["n"]))
        counted = _context_rows(p, used)
        for i, (a, b, context) in enumerate(tasks):
            k = i % len(used)
            shown = [[x[1:] for x in sorted(sides.get((i, s), ()), key=lambda x: x[0])] for s in "ab"]
            record, left = _pair(p, a, b, context, (tables[i], tables[i - k]), relations[i], shown, counted[k], include_absence, domains, left)
            p.base["pairs"].append(record)
            step()
    p.base["coverage"] = {"pair_candidates": len(asked), "pairs_evaluated": len(chosen), "contexts_requested": len(ordered), "contexts_evaluated": len(used)}
    p.base["warnings"] = check_roles(schema, columns(df), p.kinds)
    p.base["parameters"] = {"dimensions": names, "dropna": dropna, "include_absence": include_absence, "reference_domains": {c: list(map(json_value, v)) for c, v in domains.items()}, "pair_contexts": [{k: json_value(v) for k, v in g.items()} for g in given], "schema": schema, "limits": limit}
    return Result("pairs", p.base)


def cell_tables(frame: DataFrame, tasks: list[tuple[str, str, dict]], dropna: bool) -> list[DataFrame]:
    """The pair counts (a, b, n) of every pair in every context, all from one cube of their columns."""
    cube = Cube(frame, [{a, b, *context} for a, b, context in tasks])
    out = []
    for a, b, context in tasks:
        columns = {a, b, *context}
        cells = cube.complete(columns) if dropna else cube.table(columns)
        for c, v in context.items():
            cells = cells.where(F.col(cube.number(c)).eqNullSafe(F.lit(v)))
        out.append(cells.select(F.col(cube.number(a)).alias("a"), F.col(cube.number(b)).alias("b"), "n"))
    return out


def _margins(p: Prepared, cells: DataFrame, i: int, side: str, task: tuple, most: int) -> DataFrame:
    first = first_ranked(margin_table(cells, side), [], [F.col("v").asc_nulls_last()], most)
    kind = p.kinds[task["ab".index(side)]]
    return first.select(F.lit(i).alias("i"), F.lit(side).alias("side"), "rank", typed(F.col("v"), kind).alias("v"), "n")


def _context_rows(p: Prepared, contexts: list[dict]) -> list[int]:
    """How many rows each context has, in one pass."""
    if not any(contexts):
        return [p.rows] * len(contexts)
    sums = []
    for i, context in enumerate(contexts):
        here = F.lit(True)
        for c, v in context.items():
            here = here & quoted(c).eqNullSafe(F.lit(v))
        sums.append(F.count_if(here).alias(f"_{i}"))
    return list(p.frame.agg(*sums).first())


def _pair(p: Prepared, a, b, context, tables, r, sides, rows, include_absence, domains, left):
    cells, everywhere = tables
    n, v = r["rows"], r["cramers_v"]
    record = {
        "columns": [a, b],
        "context": {c: json_value(x) for c, x in context.items()},
        "evaluated_rows": n,
        "missing_excluded_rows": rows - n,
        "restriction_excluded_rows": p.rows - rows,
        "relation": r["relation"],
        "relation_reason": None if n else "empty_population",
        "cramers_v": v,
        "cramers_v_reason": None if v is not None else "constant_dimension" if n else "empty_population",
        "marginals": {c: [{"value": x, "count": k} for x, k in s] for c, s in zip((a, b), sides)},
        "omitted_marginal_levels": {a: r["levels_a"] - len(sides[0]), b: r["levels_b"] - len(sides[1])},
        "observed_cells": r["cells"],
        "domains": {a: r["levels_a"], b: r["levels_b"]},
    }
    if not include_absence:
        return record, left
    cells = cells.persist()  # for the jobs of this pair
    try:
        whole = everywhere if context else cells
        # Domains that are not declared, and the levels' support, are those of the whole population.
        sizes, frames, ever = [], [], 1
        spark = p.frame.sparkSession
        for c, s in ((a, "a"), (b, "b")):
            t = p.frame.schema[c].dataType.simpleString()
            seen = whole.select(s).distinct()
            levels = seen.count() if context else r[f"levels_{s}"]
            ever *= levels
            if c in domains:
                seen = spark.createDataFrame([(x,) for x in domains[c]], f"{s} {t}").union(seen).distinct()
                levels = seen.count()
            sizes.append(levels)
            frames.append(seen)
        total = sizes[0] * sizes[1] - r["cells"]
        here = r["levels_a"] * r["levels_b"]
        inner = here - r["cells"]
        sampled = []
        if left and total:
            absent = absent_table(cells, *frames, whole, left).orderBy(F.col("a").asc_nulls_last(), F.col("b").asc_nulls_last())
            sampled = [{"a": json_value(x["a"]), "b": json_value(x["b"]), "reason": x["reason"]} for x in absent.collect()]
            left -= len(sampled)
        record["absence"] = {"absent_cells": total, "zero_support_cells": sizes[0] * sizes[1] - ever, "level_absent_under_parent_cells": ever - here, "within_observed_margins_cells": inner, "sample": sampled, "omitted_cells": total - len(sampled)}
        return record, left
    finally:
        cells.unpersist()
