"""Bounded plain text of a result."""

from __future__ import annotations

import textwrap
from unicodedata import combining, east_asian_width

from stratalens.present.project import visualization_data

BIDI = {0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2066, 0x206A)}


def clean(value, missing: str = "(missing)") -> str:
    """Text safe to print: control and direction characters are written as escapes, ambiguous strings quoted."""
    if value is None:
        return missing
    text = str(value)
    text = "".join(f"\\u{ord(c):04x}" if ord(c) < 32 or ord(c) == 127 or ord(c) in BIDI else c for c in text)
    if isinstance(value, str) and (text.strip() != text or text.lower() in ("", "true", "false", "none", "nan", "null", missing) or _number(text)):
        return f"'{text}'"
    return text


def _number(text: str) -> bool:
    try:
        float(text)
        return True
    except ValueError:
        return False


def cells(text: str) -> int:
    """Columns of a terminal that the text takes: wide characters two, marks that join the one before none."""
    return sum(0 if combining(c) else 2 if east_asian_width(c) in "WF" else 1 for c in text)


def clip(text: str, width: int) -> str:
    """text cut to `width` columns, the last of them telling that something was cut; marks stay with their character."""
    if cells(text) <= width:
        return text
    used = end = 0
    for c in text:
        used += cells(c)
        if used > max(1, width - 1):
            break
        end += 1
    return text[:end] + "…"


def render_plaintext(result, *, detail: str = "full", width: int = 100, max_lines: int | None = 200, max_nodes: int | None = None, missing_label: str = "(missing)", unicode_mode: bool = True) -> str:
    """Lines of at most `width`, at most `max_lines` of them; what is left out is counted."""
    if width < 20:
        raise ValueError("width must be at least 20")
    data = visualization_data(result, detail=detail)
    lines = list(_lines(data, missing_label, max_nodes))
    if not unicode_mode:
        lines = [x.replace("→", "->").replace("…", "...").replace("≡", "=") for x in lines]
    lines = [clip(x, width) for x in lines]
    if max_lines is not None and len(lines) > max_lines:
        lines = [*lines[: max_lines - 1], f"... {len(lines) - max_lines + 1} more lines"]
    return "\n".join(lines)


def _lines(d: dict, missing: str, most):
    kind, full = d["kind"], d["detail"] == "full"
    head = kind.replace("_", " ")
    if full and "source" in d and d["source"]:
        head += f": {d['source'].get('table_id')}, {d['scope'].get('evaluated_rows')} of {d['scope'].get('input_rows')} rows"
    yield head + (f" [{d['status']}]" if d["status"] != "computed" else "")
    show = lambda v: clean(v, missing)
    if kind == "profile":
        for name, part in d["sections"].items():
            yield f"-- {name}"
            yield from _lines(part, missing, most)
        return
    for p in d.get("features", []):
        if not isinstance(p, dict):
            continue
        yield f"{show(p['column'])}" + (f": {p['levels_total']} levels, {p['evaluated_rows']} rows" if full else "")
        for x in p.get("levels", []):
            yield f"  {x['rank']:>4}. {show(x['value'])}  {x['count']} ({x['share_of_feature']:.1%})"
        if full and p["omitted_levels"]:
            yield f"        {p['omitted_levels']} more levels, {p['unreported_rows']} rows"
    if kind == "census":
        yield "order: " + " → ".join(d["dimensions"])
        if full:
            yield from _tree(d, show, most)
    for n in d.get("nodes", []) if kind == "grain" else []:
        yield "grain " + " ≡ ".join(n["keys"]) + (f": {n['groups']} groups{', unique' if n['unique'] else ''}" if full else "")
    names = {n["id"]: " ≡ ".join(n["keys"]) for n in d.get("nodes", []) if kind == "grain"}
    for e in d.get("edges", []):
        yield f"  {names[e['source']]} → {names[e['target']]}"
    for a in d.get("assignments", []):
        yield f"  {a['target']} at {', '.join(names[n] for n in a['nodes'])}"
    for u in d.get("unplaced", []):
        yield f"  {u['target']} unplaced: {u['reason'].replace('_', ' ')}"
    for p in d.get("pairs", []):
        where = "".join(f" | {c}={show(v)}" for c, v in p.get("context", {}).items())
        strength = f", V {p['cramers_v']:.3f}" if p.get("cramers_v") is not None else ""
        yield f"{p['columns'][0]} to {p['columns'][1]}: {p['relation']}{strength}{where}"
        if "absence" in p:
            yield f"  {p['absence']['absent_cells']} combinations never occur"
    if kind == "joint_counts":
        yield " by ".join(d["columns"])
        for c in d.get("cells", []):
            yield f"  {show(c['a'])} | {show(c['b'])}  {c['count']}"
    for p in d.get("proposals", []):
        yield f"{p['column']}: {p['role']}" + (f" ({'; '.join(p['reasons'])})" if full else "")
    for p in d.get("paths", []):
        yield " → ".join(p["dimensions"]) + (f"  groups {p['prefix_groups']}" if full else "")
    for c in d.get("changes", []):
        yield f"{c['feature']}: {c['change']}" + (f" ({c['delta']:+.3f})" if c.get("delta") is not None else "")
    if kind == "relation":
        yield f"{'+'.join(d['sides']['left']['key'])} to {'+'.join(d['sides']['right']['key'])}: {d['relation']['type']}"
    if kind == "overview":
        shown = [x for x in d.get("leads", []) if x["score"] >= 0.3][:8]
        for x in shown:
            yield f"{x['id']} {x['score']:.2f} {x['reason']}: {x['statement']}"
        for c in d["components"][:5]:
            yield "linked: " + ", ".join(c)
        return
    for f in d.get("findings", []):
        if full:
            yield from textwrap.wrap(f"{f['id']} {f['pattern'].replace('_', ' ')}: {clean(f['statement'])}", 200, subsequent_indent="    ") or [f["id"]]
        else:
            yield f"{f['pattern'].replace('_', ' ')}: {', '.join(f['features'])}"


def _tree(d, show, most):
    below: dict = {}
    for n in d["nodes"] if most is None else d["nodes"][:most]:
        below.setdefault(n["parent_id"], []).append(n)
    stack = [d["root"]]
    while stack:
        n = stack.pop()
        name = "all rows" if n["depth"] == 0 else f"{n['column']}={show(n['value'])}"
        rest = f", {n['omitted_child_levels']} more below" if n["omitted_child_levels"] else ""
        yield f"{'  ' * n['depth']}{name}  {n['count']}{rest}"
        stack.extend(reversed(below.get(n["node_id"], [])))
