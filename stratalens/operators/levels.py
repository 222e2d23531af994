"""levels, joint_counts and infer_schema: counts of single values and of pairs, and column roles."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.context import Prepared, analysable, columns, prepare, whole
from stratalens.functions.counts import complete, ranked, rows_, value_counts
from stratalens.functions.values import json_value, quoted
from stratalens.result import Result
from stratalens.runtime import operation, phase

ROLES = ("id", "categorical", "continuous", "unknown")


def check_roles(schema, names, kinds=None) -> list[dict]:
    """Warnings about an advisory role map; it never changes values."""
    warnings = []
    for c, role in (schema or {}).items():
        if c not in names:
            raise KeyError(c)
        if role not in ROLES:
            raise ValueError(f"role must be one of {ROLES}")
        if role == "continuous" and (kinds or {}).get(c) not in (None, "integer", "float"):
            warnings.append({"code": "ROLE_TYPE", "column": c, "role": role})
    return warnings


def level_table(frame: DataFrame, kinds: dict, features: list[str], *, top_n=None, max_levels=100, min_count: int = 1, dropna: bool = False) -> DataFrame:
    """(feature, rank, value, n): each feature's levels under the limits, which apply in the order top_n, min_count, max_levels."""
    keep = [x for x in (top_n, max_levels) if x is not None]
    table = ranked(value_counts(frame, kinds, features, dropna), ["feature"], [F.col("value").asc()])
    if keep:
        table = table.where(F.col("rank") <= min(keep))  # beside the ranking, so that Spark stops early in each partition
    return table.where(F.col("n") >= min_count)


@operation("levels")
def levels(df: DataFrame, features=None, *, top_n=None, max_levels=100, min_count: int = 1, dropna: bool = False, schema=None, scope=None, missing=None, table_id: str = "table") -> Result:
    """Independent value counts of every column, in one pass over the data."""
    _limits(top_n, max_levels, min_count)
    names = columns(df, features)
    p = prepare(df, names, optional=names if features is None else (), scope=scope, missing=missing, table_id=table_id)
    names = analysable(names, p)
    with phase("levels"):
        totals = {r["feature"]: r for r in value_counts(p.frame, p.kinds, names).groupBy("feature").agg(rows_().alias("levels"), F.sum(F.when(F.col("value.absent"), F.col("n")).otherwise(0)).alias("absent")).collect()}
        table = level_table(p.frame, p.kinds, names, top_n=top_n, max_levels=max_levels, min_count=min_count, dropna=dropna)
        shown: dict[str, list] = {c: [] for c in names}
        for r in table.orderBy("feature", "rank").collect():
            shown[r["feature"]].append(r)
    features_ = []
    for c in names:
        absent = totals[c]["absent"] if c in totals else 0
        total = (totals[c]["levels"] if c in totals else 0) - (1 if dropna and absent else 0)
        rows = p.rows - (absent if dropna else 0)
        reported = sum(r["n"] for r in shown[c])
        features_.append(
            {
                "column": c,
                "role": (schema or {}).get(c, "unknown"),
                "status": "computed" if rows else "empty",
                "evaluated_rows": rows,
                "missing_excluded_rows": p.rows - rows,
                "levels_total": total,
                "levels_reported": len(shown[c]),
                "omitted_levels": total - len(shown[c]),
                "reported_rows": reported,
                "unreported_rows": rows - reported,
                "levels": [{"rank": r["rank"], "value": json_value(r["value"]), "count": r["n"], "share_of_feature": r["n"] / rows} for r in shown[c]],
            }
        )
    p.base |= {"per_feature": features_, "warnings": check_roles(schema, columns(df), p.kinds), "parameters": {"features": names, "top_n": top_n, "max_levels": max_levels, "min_count": min_count, "dropna": dropna, "schema": schema}}
    return Result("levels", p.base, {"levels": table})


def _limits(top_n, max_levels, min_count) -> None:
    for name, x in (("top_n", top_n), ("max_levels", max_levels)):
        if x is not None:
            whole(name, x, 1)
    whole("min_count", min_count, 1)


def pair_table(frame: DataFrame, a: str, b: str, *, context: dict | None = None, dropna: bool = False) -> DataFrame:
    """(a, b, n) of the observed pairs of two columns, in a context of exact values where missing equals missing."""
    for c, v in (context or {}).items():
        frame = frame.where(quoted(c).eqNullSafe(F.lit(v)))
    if dropna:
        frame = complete(frame, [a, b, *(context or {})])
    return frame.groupBy(quoted(a).alias("a"), quoted(b).alias("b")).agg(rows_().alias("n"))


@operation("joint_counts")
def joint_counts(df: DataFrame, dimensions, *, context=None, dropna: bool = False, max_cells: int = 2500, min_count: int = 1, schema=None, scope=None, missing=None, table_id: str = "table") -> Result:
    """The contingency table of two columns; its axes are the values that reported cells support."""
    names = columns(df, dimensions)
    if len(names) != 2:
        raise ValueError("joint_counts takes exactly two dimensions")
    context = dict(context or {})
    if set(context) & set(names):
        raise ValueError("a context column cannot be a dimension")
    columns(df, context)
    whole("max_cells", max_cells, 1)
    whole("min_count", min_count, 1)
    p = prepare(df, [*names, *context], scope=scope, missing=missing, table_id=table_id)
    table = pair_table(p.frame, *names, context=context, dropna=dropna)
    inside = p.frame
    for c, v in context.items():
        inside = inside.where(quoted(c).eqNullSafe(F.lit(v)))
    with phase("joint counts"):
        rows = inside.count()
        sums = table.agg(rows_().alias("cells"), F.sum("n").alias("rows")).first()
        kept = table.where(F.col("n") >= min_count)
        size = kept.agg(F.count_distinct(F.struct("a")).alias("a"), F.count_distinct(F.struct("b")).alias("b")).first()
        if size["a"] * size["b"] > max_cells:
            raise ValueError(f"the grid of {size['a']} x {size['b']} cells exceeds max_cells={max_cells}")
        cells = [(json_value(r["a"]), json_value(r["b"]), r["n"]) for r in kept.orderBy(F.col("a").asc_nulls_last(), F.col("b").asc_nulls_last()).collect()]
        axis_b = [json_value(r["b"]) for r in kept.select("b").distinct().orderBy(F.col("b").asc_nulls_last()).collect()]
    evaluated = sums["rows"] or 0
    p.base["joint_counts"] = {
        "columns": names,
        "context": {c: json_value(v) for c, v in context.items()},
        "a": list(dict.fromkeys(c[0] for c in cells)),
        "b": axis_b,
        "cells": [{"a": a, "b": b, "count": n} for a, b, n in cells],
        "omitted_cells": sums["cells"] - len(cells),
        "omitted_rows": evaluated - sum(c[2] for c in cells),
        "evaluated_rows": evaluated,
        "missing_excluded_rows": rows - evaluated,
        "restriction_excluded_rows": p.rows - rows,
    }
    p.base["warnings"] = check_roles(schema, columns(df), p.kinds)
    p.base["parameters"] = {"dimensions": names, "context": p.base["joint_counts"]["context"], "dropna": dropna, "max_cells": max_cells, "min_count": min_count, "schema": schema}
    return Result("joint_counts", p.base, {"cells": table})


def role_table(frame: DataFrame, kinds: dict, names: list[str]) -> DataFrame:
    """(feature, rows, distinct, role, named_id): the proposed role of each column.

    id when every row has its own value (missing counts as one); then continuous for numbers of many values, categorical
    for few, else unknown.
    """
    counts = value_counts(frame, kinds, names).groupBy("feature").agg(F.sum("n").alias("rows"), rows_().alias("distinct"))
    number = F.col("feature").isin([c for c in names if kinds[c] in ("integer", "float", "boolean")])
    rows, distinct = F.col("rows"), F.col("distinct")
    role = F.when(distinct == rows, "id").when(number & (distinct > F.least(F.lit(20.0), rows / 2)), "continuous").when(distinct <= F.greatest(F.lit(20), F.floor(rows * 0.1)), "categorical").otherwise("unknown")
    return counts.select("feature", "rows", "distinct", role.alias("role"), F.lower("feature").endswith("id").alias("named_id"))


@dataclass(frozen=True)
class SchemaProposal:
    """Proposed roles with their reasons; `schema` is what schema= arguments take."""

    result: Result

    @property
    def schema(self) -> dict[str, str]:
        return {r["column"]: r["proposed_role"] for r in self.result["proposals"]}

    def to_dict(self) -> dict[str, Any]:
        return self.result.to_dict()

    def __getitem__(self, key):
        return self.result[key]

    def __repr__(self) -> str:
        return repr(self.result)


@operation("infer_schema")
def infer_schema(df: DataFrame, candidate_keys=None, *, features=None, dropna: bool = False, scope=None, missing=None, table_id: str = "table") -> SchemaProposal:
    """Propose a role for each column from its distinct count, type and name, with dependency evidence if keys are given."""
    names = columns(df, features)
    p: Prepared = prepare(df, names, optional=names if features is None else (), scope=scope, missing=missing, table_id=table_id)
    names = analysable(names, p)
    evidence: dict[str, list] = {}
    if candidate_keys is not None:
        from stratalens.operators.grain import grain

        for t in grain(df, candidate_keys, dropna=dropna, scope=scope, missing=missing, table_id=table_id)["dependencies"]:
            evidence.setdefault(t["target"], []).append({"key": t["key_name"], "holds": t["holds"], "evaluated_rows": t["evaluated_rows"]})
    table = role_table(p.frame, p.kinds, names)
    with phase("roles"):
        found = {r["feature"]: r for r in table.collect()}
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    p.base["proposals"] = []
    for c in names:
        r = found.get(c)
        role = r["role"] if r else "id"
        reasons = [f"{r['distinct'] if r else 0} distinct of {r['rows'] if r else 0} rows", f"type {types[c]}"]
        if c.lower().endswith("id"):
            reasons.append("name ends with id")
        p.base["proposals"].append({"column": c, "proposed_role": role, "reasons": reasons, "fd_evidence": evidence.get(c, [])})
    keys = None if candidate_keys is None else [list(k) if not isinstance(k, str) else k for k in candidate_keys] if not isinstance(candidate_keys, dict) else {k: list(v) for k, v in candidate_keys.items()}
    p.base["parameters"] = {"candidate_keys": keys, "features": names, "dropna": dropna}
    return SchemaProposal(Result("schema_proposal", p.base, {"roles": table}))
