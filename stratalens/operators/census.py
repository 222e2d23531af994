"""census: a bounded tree of observed column prefixes with exact counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalens.context import Prepared, columns, prepare, whole
from stratalens.functions.counts import complete, earlier_sum, first_ranked, numbered, rows_
from stratalens.functions.values import json_value, quoted
from stratalens.operators.levels import _limits, check_roles
from stratalens.result import Result
from stratalens.runtime import operation, phase


def top_values(frame: DataFrame, column: str, top_n: int, parents: list[str] = ()) -> DataFrame:
    """The most frequent values of a column, for each combination of the parent columns if there are any."""
    names = [*parents, column]
    counts = frame.groupBy(*(quoted(c).alias(f"_g{i}") for i, c in enumerate(names))).agg(rows_().alias("n"))
    order = first_ranked(counts, numbered(parents), [F.col(f"_g{len(parents)}").asc_nulls_last()], top_n)
    return order.select(*(F.col(f"_g{i}").alias(c) for i, c in enumerate(names)))


def same(pairs) -> Column:
    """Whether all the pairs of columns are equal, missing being equal to missing."""
    out = F.lit(True)
    for a, b in pairs:
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def _semi(frame: DataFrame, kept: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose values are among the kept ones, missing being equal to missing."""
    kept = kept.select(*(quoted(c).alias(f"_k{i}") for i, c in enumerate(on)))
    match = F.lit(True)
    for i, c in enumerate(on):
        match = match & quoted(c).eqNullSafe(F.col(f"_k{i}"))
    return frame.join(kept, match, "left_semi")


#: Values that a pre-selection lists per column, at least; the rest is counted.
KEPT_VALUES = 10_000


def preselect(frame: DataFrame, dims: list[str], top_n: int, per_parent: bool) -> DataFrame:
    """Rows all of whose levels are among the top ones, overall or within their parents."""
    if per_parent:
        for i in range(len(dims)):
            frame = _semi(frame, top_values(frame, dims[i], top_n, dims[:i]), dims[: i + 1])
        return frame
    kept = [top_values(frame, c, top_n) for c in dims]
    for c, k in zip(dims, kept):
        frame = _semi(frame, k, [c])
    return frame


#: Shown parents that may be broadcast to their children.
BROADCAST_PARENTS = 20_000


def tree_table(frame: DataFrame, dims: list[str], *, top_n=None, per_parent: bool = False, max_levels=100, max_nodes=10000, min_count: int = 1) -> tuple[DataFrame, DataFrame]:
    """(children, nodes): of every observed prefix what its children amount to, and the nodes that are shown.

    children has (up, levels, rows, least, allowed): the path of the prefix, how many children it has, their rows, the smallest count among
    them, and how many the limits allow. nodes has (depth, path, n, value, number).

    Counts of shorter prefixes are sums of the finest ones, so the rows are grouped once. A child is shown if it passes top_n, min_count
    and max_levels in that order and its parent is shown. All three cut its siblings' ranking short, so only that many ranks of a
    parent are ever sorted; and as nodes are numbered breadth first, each depth needs max_nodes of them at most. Without
    max_nodes the numbers come from sums over blocks of parents, so that no task numbers all nodes.
    """
    finest = frame.groupBy(*(quoted(c).alias(f"_g{i}") for i, c in enumerate(dims))).agg(rows_().alias("n"))
    dims = numbered(dims)  # by number, so that a column may have any name
    most = min((x for x in (top_n if per_parent else None, max_levels, max_nodes) if x is not None), default=None)
    limit = min((x for x in (top_n if per_parent else None, max_levels) if x is not None), default=None)
    overall = {}
    if top_n is not None and not per_parent:
        overall = {c: first_ranked(finest.groupBy(c).agg(F.sum("n").alias("n")), [], [F.col(c).asc_nulls_last()], top_n).select(c) for c in dims}
    shown, tables, sums = None, [], []
    for depth, own in enumerate(dims, 1):
        parents = dims[: depth - 1]
        level = finest.groupBy(*dims[:depth]).agg(F.sum("n").alias("n"))
        allowed = F.col("n") >= min_count
        if overall:
            mark = overall[own].select(F.col(own).alias("_v"), F.lit(True).alias("_top"))
            level = level.join(F.broadcast(mark), same([(own, "_v")]), "left").drop("_v")  # top_n rows
            allowed = allowed & F.coalesce("_top", F.lit(False))
        up = _path_of(parents)
        some = F.sum(allowed.cast("bigint"))
        sums.append(level.groupBy(*parents).agg(rows_().alias("levels"), F.sum("n").alias("rows"), F.min("n").alias("least"), some.alias("_some")).select(up.alias("up"), "levels", "rows", "least", (F.least("_some", F.lit(limit)) if limit is not None else F.col("_some")).alias("allowed")))
        level = level.where(allowed).select(*dims[:depth], "n")
        if shown is not None:
            above = shown.select(*(F.col(c).alias(f"_p{i}") for i, c in enumerate(parents)), F.col("_index").alias("_above"))
            if max_nodes is not None and max_nodes <= BROADCAST_PARENTS:
                above = F.broadcast(above)
            level = level.join(above, same(zip(parents, (f"_p{i}" for i in range(len(parents)))))).select(*dims[:depth], "n", "_above")
        ranks = first_ranked(level, ["_above"] if parents else [], [F.col(own).asc_nulls_last()], most)
        if not parents:
            shown = ranks.withColumn("_index", (F.col("rank") - 1).cast("bigint"))
        elif max_nodes is not None:  # every task keeps its first max_nodes, so that only so many meet in the window
            first = ranks.orderBy("_above", "rank").limit(max_nodes)
            shown = first.withColumn("_index", (F.row_number().over(Window.orderBy("_above", "rank")) - 1).cast("bigint"))
        else:
            before = earlier_sum(ranks.groupBy("_above").agg(rows_().alias("_children")), "_above", "_children").withColumnRenamed("_above", "_a")
            shown = ranks.join(before, F.col("_above") == F.col("_a")).withColumn("_index", F.col("before") + F.col("rank") - 1)
        tables.append(shown.select(F.lit(depth).alias("depth"), _path_of(dims[:depth]).alias("path"), "n", "_index", F.col(own).cast("string").alias("value")))
    nodes, children = tables[0], sums[0]
    for t, c in zip(tables[1:], sums[1:]):
        nodes, children = nodes.unionByName(t), children.unionByName(c)
    if max_nodes is not None:
        nodes = nodes.orderBy("depth", "_index").limit(max_nodes)
        nodes = nodes.withColumn("number", F.row_number().over(Window.orderBy("depth", "_index")) - 1)
    else:
        sizes = nodes.groupBy(F.col("depth").alias("_d")).agg(rows_().alias("_n"))
        offset = F.coalesce(F.sum("_n").over(Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        nodes = nodes.join(F.broadcast(sizes.select("_d", offset.alias("_first"))), F.col("depth") == F.col("_d"))  # a row per depth
        nodes = nodes.withColumn("number", F.col("_first") + F.col("_index"))
    return children, nodes.select("depth", "path", "n", "value", F.col("number").cast("int" if max_nodes is not None else "bigint").alias("number"))


def _path_of(dims: list[str]) -> Column:
    empty = F.array().cast("array<struct<absent:boolean,text:string>>")
    return F.array(*(F.struct(F.col(c).isNull().alias("absent"), F.col(c).cast("string").alias("text")) for c in dims)) if dims else empty


@operation("census")
def census(df: DataFrame, dimensions, *, top_n=None, top_n_mode: str = "post", top_n_per_parent: bool = False, min_retained_fraction: float = 0.01, max_depth=None, max_levels=100, max_nodes=10000, min_count: int = 1, dropna: bool = False, schema=None, scope=None, missing=None, table_id: str = "table") -> Result:
    """A tree of ordered column prefixes: nodes count rows, omitted children leave their mass with their parent."""
    dims = columns(df, dimensions)
    if not dims:
        raise ValueError("dimensions must contain at least one column")
    if top_n_mode not in ("pre", "post"):
        raise ValueError("top_n_mode must be 'pre' or 'post'")
    if not 0 <= min_retained_fraction <= 1:
        raise ValueError("min_retained_fraction must be between 0 and 1")
    if max_depth is not None:
        whole("max_depth", max_depth, 1)
    if max_nodes is not None:
        whole("max_nodes", max_nodes, 1)
    _limits(top_n, max_levels, min_count)
    active = dims[:max_depth]
    p: Prepared = prepare(df, dims, scope=scope, missing=missing, table_id=table_id)
    frame = complete(p.frame, active) if dropna else p.frame
    rows = frame.count() if dropna else p.rows
    warnings = check_roles(schema, columns(df), p.kinds)
    before = rows
    pre = top_n is not None and top_n_mode == "pre"
    kept_levels: list[dict] = []
    if pre:
        frame = preselect(frame, active, top_n, top_n_per_parent)
        rows = frame.count()
        if before and not rows:
            raise ValueError("DEGENERATE_TOP_N: pre-selection removes every row")
        if before and rows / before < min_retained_fraction:
            warnings.append({"code": "LOW_RETAINED_FRACTION", "retained_rows": rows, "rows": before})
        for i, c in enumerate(active):
            values = frame.groupBy(quoted(c).alias("v")).agg(rows_().alias("n"))
            # without parents there are at most top_n; with them what is not listed is counted
            most = max(top_n, KEPT_VALUES) if top_n_per_parent else top_n
            first = values.orderBy(F.desc("n"), F.col("v").asc_nulls_last()).limit(most).collect()
            omitted = values.count() - len(first) if len(first) == most else 0
            kept_levels.append({"depth": i + 1, "column": c, "values": [json_value(r["v"]) for r in first], "omitted_values": omitted})
    with phase("census tree"):
        sums, kept = tree_table(frame, active, top_n=None if pre else top_n, per_parent=top_n_per_parent, max_levels=max_levels, max_nodes=max_nodes, min_count=min_count)
        shown = kept.orderBy("number").collect()
        # Totals of children are only wanted for the nodes that are shown.
        parents = kept.select(F.col("path").alias("up")).where(F.size("up") < len(active))
        totals = {_path(r["up"]): r for r in sums.join(parents.distinct(), "up", "left_semi").collect()}
        top = sums.where(F.size("up") == 0).first()
        if top:
            totals[()] = top
    root = _node("root", None, None, None, 0, rows, rows, rows, len(active))
    nodes, by_path, kids = [], {(): root}, {}
    values = _plain_values(shown, active, p)
    for r, v in zip(shown, values):
        path = _path(r["path"])
        parent = by_path[path[:-1]]
        node = _node(f"n{r['number']}", parent["node_id"], active[r["depth"] - 1], v, r["depth"], r["n"], parent["count"], rows, len(active))
        by_path[path] = node
        kids.setdefault(path[:-1], []).append(r["n"])
        nodes.append(node)
    for path, node in by_path.items():
        if len(path) == len(active):
            continue
        t, got = totals.get(path), kids.get(path, [])
        node["expansion_state"] = "expanded"
        if t is None or len(got) == t["levels"]:
            continue
        node["omitted_child_rows"], node["omitted_child_levels"] = t["rows"] - sum(got), t["levels"] - len(got)
        reasons = {"top_n"} if top_n is not None else set()
        if max_levels is not None and t["levels"] > max_levels:
            reasons.add("max_levels")
        if t["allowed"] > len(got) or (max_nodes is not None and len(nodes) >= max_nodes and not got):
            reasons.add("max_nodes")
        if t["least"] < min_count:
            reasons.add("min_count")
        node["stop_reasons"] = sorted(reasons)
    partial = any(n["omitted_child_rows"] for n in by_path.values())
    p.base["tree"] = {
        "status": "empty" if not rows else "partial" if partial else "computed",
        "dimensions": active,
        "requested_depth": len(active),
        "evaluated_rows": rows,
        "missing_excluded_rows": p.rows - before,
        "restriction_excluded_rows": before - rows,
        "root": root,
        "nodes": nodes,
        "preselection": kept_levels,
    }
    if rows and partial:
        p.base["status"] = "partial"
    p.base["warnings"] = warnings
    p.base["parameters"] = {"dimensions": dims, "top_n": top_n, "top_n_mode": top_n_mode, "top_n_per_parent": top_n_per_parent, "min_retained_fraction": min_retained_fraction, "max_depth": max_depth, "max_levels": max_levels, "max_nodes": max_nodes, "min_count": min_count, "dropna": dropna, "schema": schema}
    return Result("census", p.base, {"nodes": kept})


def _path(path) -> tuple:
    return tuple((s["absent"], s["text"]) for s in path)


def _plain_values(shown, active, p: Prepared) -> list:
    """Node values in JSON's types; paths carry them as text."""
    import json

    out = []
    for r in shown:
        v, kind = r["value"], p.kinds[active[r["depth"] - 1]]
        if v is None or kind in ("string", "timedelta"):
            out.append(v)
        elif kind == "boolean":
            out.append(v == "true")
        elif kind == "integer":
            out.append(int(v))
        elif kind == "float":
            out.append({"Infinity": "inf", "-Infinity": "-inf"}.get(v) or json.loads(str(float(v))))
        else:
            out.append(v.replace(" ", "T"))
    return out


def _node(number, parent, column, value, depth, count, above, total, deepest) -> dict:
    return {
        "node_id": number,
        "parent_id": parent,
        "column": column,
        "value": value,
        "depth": depth,
        "count": count,
        "share_of_parent": count / above if parent and above else None,
        "share_of_total": count / total if total else None,
        "expansion_state": "complete" if depth == deepest else "unexpanded",
        "omitted_child_rows": 0,
        "omitted_child_levels": 0,
        "stop_reasons": [],
    }
