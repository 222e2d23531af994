"""What of a result may be shown: every renderer draws from this projection and from nothing else.

`full` keeps counts, values and positions. `topology` keeps structure alone: names, relations and qualitative states in
canonical order, without any count, share, value of a cell, or position.
"""

from __future__ import annotations

from bisect import bisect_right
from math import ceil, floor, log10

from stratalens.result import Result

DETAILS = ("full", "topology")
COUNTED = {"examples", "exceptions", "measurements", "exception_groups", "selection_positions"}


def visualization_data(result, *, detail: str = "full", shading=None) -> dict:
    """The projection of a result as plain data."""
    if detail not in DETAILS:
        raise ValueError(f"detail must be one of {DETAILS}")
    if hasattr(result, "result"):
        result = result.result
    if not isinstance(result, Result):
        raise TypeError("visualization_data takes a Result")
    full = detail == "full"
    out = {"kind": result.kind, "detail": detail, "status": result.payload.get("status", "computed")}
    if full:
        out["source"] = {k: v for k, v in result.payload.get("source", {}).items() if k in ("table_id", "rows", "columns")}
        out["scope"] = {k: v for k, v in result.payload.get("scope", {}).items() if k in ("name", "input_rows", "evaluated_rows")}
    make = {"levels": _levels, "census": _census, "grain": _grain, "pairs": _pairs, "joint_counts": _joint, "schema_proposal": _roles, "overview": _overview, "comparison": _comparison, "relation": _relation}
    if result.kind == "profile":
        parts = result.payload["sections"]
        out["sections"] = {n: visualization_data(result.section(n), detail=detail, shading=shading) for n, p in parts.items() if p.get("status") != "not_requested"}
        return out
    if result.kind in make:
        out |= make[result.kind](result, full)
    if result.kind == "paths":
        out["paths"] = [{"dimensions": p["dimensions"]} | ({"prefix_groups": p["measurements"]["prefix_counts"], "score": p["measurements"]["score"]} if full else {}) for p in result["paths"]]
    if result.kind == "dependencies":
        out["grain_views"] = [{"id": v["id"], **_grain(Result.from_dict(v["grain"]), full)} for v in result.payload.get("grain_views", [])]
    if result.kind not in ("levels", "census", "grain", "pairs", "joint_counts", "schema_proposal", "overview"):
        out["findings"] = [_finding(f, full) for f in result.findings]
        if not full:
            out["findings"].sort(key=lambda f: (f["pattern"], f["features"], str(f["structure"])))
    if result.kind in ("pairs", "joint_counts") and full:
        values = [p["cramers_v"] for p in result["pairs"] if p["cramers_v"] is not None] if result.kind == "pairs" else [c["count"] for c in result["joint_counts"]["cells"]]
        rule = (shading or {}).get("association" if result.kind == "pairs" else "counts", "equal" if result.kind == "pairs" else "log")
        out["shading"] = {"rule": rule if isinstance(rule, str) else "fixed", "cutoffs": cutoffs(values, rule, counts=result.kind == "joint_counts")}
    return out


# The leading figures that cut-offs of counts on a log scale are rounded to.
NICE = (1, 1.5, 2, 2.5, 3, 4, 5, 6, 8, 10)


def cutoffs(values, rule, counts: bool = False) -> list[float]:
    """Three increasing values that cut the four shades; nothing without values.

    A log scale runs from 1 for counts, else from a thousandth of the largest value. Cut-offs of counts are whole numbers
    that still increase, others have two places.
    """
    if not isinstance(rule, str):
        given = [float(x) for x in rule]
        if len(given) != 3 or not given[0] < given[1] < given[2]:
            raise ValueError("fixed shading takes three increasing numbers")
        return given
    if rule not in ("equal", "log", "quantile"):
        raise ValueError("shading rules are 'equal', 'log', 'quantile' or three numbers")
    found = sorted(v for v in values if v is not None)
    if not found:
        return []
    low, high = found[0], found[-1]
    top = max(high, 1e-12)
    start = 1.0 if counts else top / 1000
    scales = {
        "equal": lambda part: low + (high - low) * part,
        "log": lambda part: start * (max(top, start) / start) ** part,
        "quantile": lambda part: found[min(len(found) - 1, ceil(len(found) * part))],
    }
    marks = [scales[rule](part) for part in (0.25, 0.5, 0.75)]
    if not counts:
        return [round(m, 2) for m in marks]
    out: list[float] = []
    for m in marks:
        if rule == "log":
            power = 10 ** floor(log10(m))
            m = round(power * min(NICE, key=lambda x: abs(x * power - m)))
        out.append(float(max(ceil(m), 1, out[-1] + 1 if out else 1)))
    return out


def shade(value, marks) -> int:
    return bisect_right(marks, value) if marks else 0


def _finding(f: dict, full: bool) -> dict:
    out = {"pattern": f["pattern"], "features": [x["column"] for x in f["features"]], "structure": f["structure"]}
    if not full:
        out["structure"] = {k: v for k, v in f["structure"].items() if k not in ("context", "formats")}
        return out
    return out | {"id": f["id"], "statement": f["statement"], "measurements": f["measurements"], "unit": f["counting_unit"], "examples": f["examples"], "exceptions": f["exceptions"]}


def _levels(r, full):
    out = []
    for p in r["per_feature"]:
        one = {"column": p["column"], "role": p["role"]}
        if full:
            one |= {k: p[k] for k in ("evaluated_rows", "levels_total", "omitted_levels", "unreported_rows", "levels")}
        out.append(one)
    return {"features": out if full else sorted(out, key=lambda x: x["column"])}


def _census(r, full):
    t = r["tree"]
    if not full:
        return {"dimensions": t["dimensions"]}
    return {"dimensions": t["dimensions"], "root": t["root"], "nodes": t["nodes"]}


def _grain(r, full):
    g = r["graph"]
    keep = ("id", "keys", "columns", "groups", "unique") if full else ("id", "keys", "columns")
    out = {"nodes": [{k: n[k] for k in keep} for n in g["nodes"]], "edges": g["edges"], "assignments": g["assignments"], "unplaced": g["unplaced"]}
    if full:
        out["tests"] = r["dependencies"]
    out["candidates"] = candidate_roles(r)
    return out


def candidate_roles(r) -> list[dict]:
    """Each key's role: keys of repeated groups first, then unique ones, constants, and those without support."""
    order = ("repeated_grouping", "unique_identifier", "constant", "unsupported")
    out = []
    for n in r["graph"]["nodes"]:
        role = "unsupported" if not n["groups"] else "constant" if n["groups"] == 1 else "unique_identifier" if n["unique"] else "repeated_grouping"
        out += [{"key": k, "role": role, "equivalent_to": [x for x in n["keys"] if x != k]} for k in n["keys"]]
    return sorted(out, key=lambda x: (order.index(x["role"]), x["key"]))


def _pairs(r, full):
    keep = ("columns", "context", "relation", "cramers_v", "evaluated_rows", "observed_cells", "marginals", "absence") if full else ("columns", "relation")
    return {"pairs": [{k: p[k] for k in keep if k in p} for p in r["pairs"] if full or not p["context"]]}


def _joint(r, full):
    j = r["joint_counts"]
    return {"columns": j["columns"]} | ({k: j[k] for k in ("context", "a", "b", "cells", "omitted_cells", "omitted_rows")} if full else {})


def _roles(r, full):
    return {"proposals": [{"column": p["column"], "role": p["proposed_role"]} | ({"reasons": p["reasons"]} if full else {}) for p in r["proposals"]]}


def _overview(r, full):
    net = r["feature_network"]
    links = [{"kind": x["kind"], "features": [f["column"] for f in x["features"]]} for x in net["relationships"]]
    out = {"components": net["components"], "relationships": links if full else sorted(links, key=lambda x: (x["kind"], x["features"]))}
    if full:
        out["leads"] = [{"id": f["id"], "section": f["section"], "score": f["lead"]["score"], "reason": f["lead"]["reason"], "statement": f["statement"]} for f in r.findings]
    return out


def _comparison(r, full):
    word = lambda d: "unknown" if d is None else "same" if not d else "more" if d > 0 else "less"
    return {"changes": [{"feature": c["feature"], "change": word(c["populated_fraction_delta"])} | ({"before": c["before"], "after": c["after"], "delta": c["populated_fraction_delta"]} if full else {}) for c in r["changes"]]}


def _relation(r, full):
    out = {"sides": {n: {"key": s["key"], "compare": s["compare"]} | ({"rows": s["rows"], "keys": s["keys"]} if full else {}) for n, s in r["sides"].items()}}
    out["relation"] = r["relation"] if full else {"type": r["relation"]["type"]}
    out["coverage"] = {d: (c if full else {"state": c["state"]}) for d, c in r["key_coverage"].items()}
    out["agreement"] = [a if full else {k: a[k] for k in ("left", "right", "state", "ambiguity")} for a in r["agreement"]]
    if r["reciprocity"]:
        out["reciprocity"] = r["reciprocity"] if full else {k: r["reciprocity"][k] for k in ("state", "self_references")}
    return out
