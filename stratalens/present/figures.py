"""Figures as SVG and standalone HTML pages, drawn from the projection."""

from __future__ import annotations

from html import escape

from stratalens.present.project import shade, visualization_data
from stratalens.present.text import clean, clip, render_plaintext

VIEWS = {"grain": ("map", "matrix"), "pairs": ("association", "mapping"), "joint_counts": ("heatmap",), "levels": ("bars",), "census": ("tree",)}
#: Four shades from light to dark, and the colours of text and lines.
SHADES, INK, LINE = ("#e8f0f7", "#b5cfe3", "#6f9fc4", "#2b6391"), "#222222", "#8a8a8a"
ROW, CHAR = 22, 7


def _text(x, y, s, size=12, anchor="start", fill=INK) -> str:
    return f'<text x="{x:.0f}" y="{y:.0f}" font-size="{size}" text-anchor="{anchor}" fill="{fill}" font-family="sans-serif">{escape(clean(s))}</text>'


def _svg(width, height, parts, title) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:.0f}" height="{height:.0f}" viewBox="0 0 {width:.0f} {height:.0f}" role="img"><title>{escape(title)}</title>{"".join(parts)}</svg>'


def render_svg(result, *, view: str | None = None, detail: str = "full", shading=None, width: int = 720) -> str:
    """One figure: map, matrix, association, mapping, heatmap, bars, tree, or findings for every other kind."""
    d = visualization_data(result, detail=detail, shading=shading)
    known = (*VIEWS.get(d["kind"], ()), "findings")
    view = view or known[0]
    if view not in known:
        raise ValueError(f"views of {d['kind']} are {known}")
    if view in ("matrix", "bars", "heatmap", "tree") and detail == "topology":
        view = "map" if d["kind"] == "grain" else "findings"
    draw = {"map": _map, "matrix": _matrix, "association": _association, "mapping": _mapping, "heatmap": _heatmap, "bars": _bars, "tree": _lines, "findings": _lines}[view]
    return draw(d, width) if draw is not _lines else _lines(result, detail, width, d["kind"])


def _ranks(nodes, edges) -> dict[str, int]:
    rank = {n["id"]: 0 for n in nodes}
    for _ in nodes:
        for e in edges:
            rank[e["target"]] = max(rank[e["target"]], rank[e["source"]] + 1)
    return rank


def _map(d, width) -> str:
    rank = _ranks(d["nodes"], d["edges"])
    rows: dict[int, list] = {}
    for n in d["nodes"]:
        rows.setdefault(rank[n["id"]], []).append(n)
    at, parts = {}, []
    for r, nodes in rows.items():
        for i, n in enumerate(nodes):
            at[n["id"]] = ((i + 0.5) * width / len(nodes), 40 + r * 90)
    for e in d["edges"]:
        (x1, y1), (x2, y2) = at[e["source"]], at[e["target"]]
        parts.append(f'<line x1="{x1:.0f}" y1="{y1 + 14:.0f}" x2="{x2:.0f}" y2="{y2 - 16:.0f}" stroke="{LINE}"/>')
    for n in d["nodes"]:
        x, y = at[n["id"]]
        label = clip(" = ".join(n["keys"]), 28)
        w = len(label) * CHAR + 16
        parts.append(f'<rect x="{x - w / 2:.0f}" y="{y - 16:.0f}" width="{w}" height="30" rx="4" fill="{SHADES[0]}" stroke="{LINE}"/>')
        parts.append(_text(x, y + 3, label, anchor="middle"))
        placed = [a["target"] for a in d["assignments"] if n["id"] in a["nodes"]]
        if placed:
            parts.append(_text(x, y + 30, clip(", ".join(placed), 40), 10, "middle"))
    return _svg(width, 90 * (max(rows, default=0) + 1) + 30, parts, "grain map")


def _matrix(d, width) -> str:
    keys, targets = list(dict.fromkeys(t["key_name"] for t in d["tests"])), list(dict.fromkeys(t["target"] for t in d["tests"]))
    found = {(t["key_name"], t["target"]): t["holds"] for t in d["tests"]}
    left, parts = 160, []
    step = max(ROW, (width - left) / max(1, len(keys)))
    for j, k in enumerate(keys):
        parts.append(_text(left + j * step + step / 2, 16, clip(k, 14), 10, "middle"))
    for i, t in enumerate(targets):
        parts.append(_text(4, 40 + i * ROW, clip(t, 22)))
        for j, k in enumerate(keys):
            fill = {True: SHADES[3], False: SHADES[0], None: "#ffffff"}[found.get((k, t))]
            parts.append(f'<rect x="{left + j * step:.0f}" y="{26 + i * ROW}" width="{step - 2:.0f}" height="{ROW - 4}" fill="{fill}" stroke="{LINE}"/>')
    return _svg(width, 50 + len(targets) * ROW, parts, "which key fixes which column")


def _association(d, width) -> str:
    marks, parts = d.get("shading", {}).get("cutoffs", []), []
    for i, p in enumerate(d["pairs"]):
        v = p.get("cramers_v")
        fill = "#ffffff" if v is None else SHADES[shade(v, marks)]
        parts.append(f'<rect x="4" y="{6 + i * ROW}" width="40" height="{ROW - 4}" fill="{fill}" stroke="{LINE}"/>')
        context = "".join(f" | {c}={v_}" for c, v_ in p.get("context", {}).items())
        parts.append(_text(52, 20 + i * ROW, clip(f"{p['columns'][0]} / {p['columns'][1]}{context}" + (f"  {v:.3f}" if v is not None else ""), 90)))
    return _svg(width, 20 + len(d["pairs"]) * ROW, parts, "association")


def _mapping(d, width) -> str:
    parts = []
    for i, p in enumerate(d["pairs"]):
        y = 20 + i * ROW
        parts += [_text(4, y, clip(p["columns"][0], 30)), _text(width / 2, y, p["relation"] or "-", anchor="middle"), _text(width - 4, y, clip(p["columns"][1], 30), anchor="end")]
    return _svg(width, 20 + len(d["pairs"]) * ROW, parts, "relations")


def _heatmap(d, width) -> str:
    marks, left, parts = d["shading"]["cutoffs"], 140, []
    found = {(str(c["a"]), str(c["b"])): c["count"] for c in d["cells"]}
    step = max(30, (width - left) / max(1, len(d["b"])))
    for j, b in enumerate(d["b"]):
        parts.append(_text(left + j * step + step / 2, 16, clip(clean(b), 10), 10, "middle"))
    for i, a in enumerate(d["a"]):
        parts.append(_text(4, 40 + i * ROW, clip(clean(a), 20)))
        for j, b in enumerate(d["b"]):
            n = found.get((str(a), str(b)))
            fill = "#ffffff" if n is None else SHADES[shade(n, marks)]
            parts.append(f'<rect x="{left + j * step:.0f}" y="{26 + i * ROW}" width="{step - 2:.0f}" height="{ROW - 4}" fill="{fill}" stroke="{LINE}"><title>{n or 0}</title></rect>')
    return _svg(max(width, left + step * len(d["b"])), 50 + len(d["a"]) * ROW, parts, "joint counts")


def _bars(d, width) -> str:
    parts, y = [], 20
    for f in d["features"]:
        parts.append(_text(4, y, f["column"], 13))
        y += ROW
        for x in f["levels"]:
            parts.append(_text(20, y, clip(clean(x["value"]), 24), 11))
            parts.append(f'<rect x="200" y="{y - 11}" width="{max(1, (width - 300) * x["share_of_feature"]):.0f}" height="14" fill="{SHADES[2]}"/>')
            parts.append(_text(width - 4, y, x["count"], 11, "end"))
            y += ROW
    return _svg(width, y, parts, "levels")


def _lines(result, detail, width, kind) -> str:
    lines = render_plaintext(result, detail=detail, width=max(20, width // CHAR), max_lines=200).split("\n")
    return _svg(width, 20 + len(lines) * 18, [f'<g xml:space="preserve">{"".join(_text(4 + CHAR * (len(x) - len(x.lstrip())), 18 + i * 18, x.strip(), 12) for i, x in enumerate(lines))}</g>'], kind)


def render_html(result, *, title: str | None = None, detail: str = "full", shading=None) -> str:
    """A standalone page: the figures of the result and its findings in a list that can be filtered; it loads nothing."""
    d = visualization_data(result, detail=detail, shading=shading)
    title = title or d["kind"].replace("_", " ")
    figures = [render_svg(result, view=v, detail=detail, shading=shading) for v in VIEWS.get(d["kind"], ())]
    items = d.get("findings") or d.get("leads") or []
    rows = []
    for f in items:
        name = f.get("statement") or ", ".join(f.get("features", []))
        rows.append(f"<li><b>{escape(str(f.get('pattern') or f.get('reason')))}</b> {escape(clean(name))}</li>")
    listing = f'<input id="q" placeholder="filter" oninput="for(const x of document.querySelectorAll(\'li\'))x.hidden=!x.textContent.toLowerCase().includes(this.value.toLowerCase())"><ul>{"".join(rows)}</ul>' if rows else ""
    text = f"<pre>{escape(render_plaintext(result, detail=detail, max_lines=400))}</pre>"
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{escape(title)}</title><style>body{{font-family:sans-serif;max-width:60em;margin:2em auto;color:{INK}}}pre{{overflow-x:auto}}</style></head><body><h1>{escape(title)}</h1>{"".join(figures)}{listing}{text}</body></html>'
