"""grain: what each row stands for. Exact dependency tests of candidate keys, and the graph of their groupings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.context import Prepared, analysable, columns, prepare
from stratalens.functions.counts import GroupCounts, complete, numbered, rows_
from stratalens.functions.cube import union_of
from stratalens.functions.values import quoted
from stratalens.result import Result
from stratalens.runtime import operation, phase


@dataclass(frozen=True)
class KeySpec:
    """A named determinant of one or more columns."""

    name: str
    columns: tuple[str, ...]

    def __post_init__(self):
        object.__setattr__(self, "columns", tuple(self.columns))
        if not self.name or not self.columns or len(set(self.columns)) != len(self.columns):
            raise ValueError("a key needs a name and distinct columns")


def key_specs(df: DataFrame, keys) -> list[KeySpec]:
    """Keys from a mapping, or from column names, tuples of them, and KeySpecs."""
    if isinstance(keys, dict):
        specs = [KeySpec(n, tuple([c] if isinstance(c, str) else c)) for n, c in keys.items()]
    else:
        specs = [k if isinstance(k, KeySpec) else KeySpec(k, (k,)) if isinstance(k, str) else KeySpec("+".join(k), tuple(k)) for k in keys]
    if not specs:
        raise ValueError("candidate_keys must not be empty")
    if len({s.name for s in specs}) != len(specs):
        raise ValueError("key names must be unique")
    for s in specs:
        columns(df, s.columns)
    return specs


TEST_MEASURES = ("evaluated_groups", "violating_groups", "affected_rows", "evaluated_rows", "singleton_groups", "repeated_groups")
#: Targets of a key that one aggregation compares at once.
TARGETS_AT_ONCE = 24


def ends(column: Column, kind: str) -> list[Column]:
    """Numbers of fixed width that are all equal for two values exactly if the values are; of text, two hashes of 64 bits each."""
    if kind == "string":
        return [F.xxhash64(column), F.xxhash64(F.lit("again"), column)]
    return [column]


def grain_tests(frame: DataFrame, kinds: dict, specs: list[KeySpec], targets: list[str], dropna: bool = False) -> DataFrame:
    """(key_name, feature, measures..): every key against every other column, one plan for all.

    With dropna each test uses the rows that have all of its columns; else missing is a value.

    Whether a group holds more than one value is told from the target's least and greatest value and how many rows have one,
    so each key is one aggregation with a row per group and task in its shuffle, however many rows or targets there are.
    Text is compared by two hashes of 64 bits, as the buffers of such an aggregation have a fixed width.
    """
    parts = []
    for s in specs:
        others = [t for t in targets if t not in s.columns]
        for at in range(0, len(others), TARGETS_AT_ONCE):
            parts.append(_tests_of(frame, kinds, s, others[at : at + TARGETS_AT_ONCE], dropna))
    if not parts:
        return frame.sparkSession.createDataFrame([], "key_name string, feature string, " + ", ".join(f"{m} bigint" for m in TEST_MEASURES))
    return union_of(parts)


def _tests_of(frame: DataFrame, kinds: dict, spec: KeySpec, targets: list[str], dropna: bool) -> DataFrame:
    rows = complete(frame, spec.columns) if dropna else frame
    keys = [quoted(c).alias(f"_g{i}") for i, c in enumerate(spec.columns)]
    marks = {t: [F.when(quoted(t).isNotNull(), x) for x in ends(quoted(t), kinds[t])] for t in targets}
    named = rows.select(*keys, *(m.alias(f"_t{i}_{j}") for i, t in enumerate(targets) for j, m in enumerate(marks[t])))
    sums = [rows_().alias("_n")]
    for i, t in enumerate(targets):
        sums.append(F.count(f"_t{i}_0").alias(f"_h{i}"))
        sums += [f(f"_t{i}_{j}").alias(f"_{n}{i}_{j}") for j in range(len(marks[t])) for f, n in ((F.min, "a"), (F.max, "z"))]
    groups = named.groupBy(*numbered(spec.columns)).agg(*sums)
    some = lambda c, x=1: F.coalesce(F.sum(F.when(c, x)), F.lit(0)).cast("bigint")
    cells = []
    for i, t in enumerate(targets):
        several, held = F.lit(False), F.col(f"_h{i}")
        for j in range(len(marks[t])):
            several = several | (F.col(f"_a{i}_{j}") != F.col(f"_z{i}_{j}"))
        several = F.coalesce(several, F.lit(False))
        size = held if dropna else F.col("_n")
        if not dropna:
            several = several | ((held > 0) & (held < size))
        found = (some(size > 0), some(several), some(several, size), F.coalesce(F.sum(size), F.lit(0)), some(size == 1), some(size > 1))
        cells.append(F.struct(F.lit(t).alias("feature"), *(f.alias(m) for f, m in zip(found, TEST_MEASURES))))
    every = groups.agg(F.array(*cells).alias("_tests")).select(F.explode("_tests").alias("_test"))
    return every.select(F.lit(spec.name).alias("key_name"), "_test.*")


def evaluate(p_frame: DataFrame, kinds: dict, names: list[str], specs: list[KeySpec], dropna: bool, rows: int, counts: GroupCounts | None = None, known: dict | None = None) -> dict:
    """Tests, target summaries and the graph over one frame; known tests and counts are not asked again."""
    counts = counts or GroupCounts(p_frame, rows, kinds)
    table = None
    if known is None:
        with phase("key tests"):
            table = grain_tests(p_frame, kinds, specs, names, dropna)
            known = {(r["key_name"], r["feature"]): r for r in table.collect()}
    found = known
    tests = []
    for s in specs:
        for t in names:
            if t in s.columns:
                continue
            r = found.get((s.name, t))
            groups = r["evaluated_groups"] if r else 0
            used = r["evaluated_rows"] if r else 0
            tests.append(
                {
                    "key_name": s.name,
                    "key_columns": list(s.columns),
                    "target": t,
                    "holds": (r["violating_groups"] == 0) if groups else None,
                    "undefined_reason": None if groups else "empty_population",
                    "evaluated_groups": groups,
                    "violating_groups": r["violating_groups"] if r else 0,
                    "affected_rows": r["affected_rows"] if r else 0,
                    "evaluated_rows": used,
                    "missing_excluded_rows": rows - used,
                    "singleton_groups": r["singleton_groups"] if r else 0,
                    "repeated_groups": r["repeated_groups"] if r else 0,
                }
            )
    return {"dependencies": tests, "targets": target_summaries(counts, names, specs, tests, dropna), "graph": grain_graph(counts, names, specs, tests, dropna), "_table": table}


def finer(counts: dict, a: tuple, b: tuple) -> bool:
    """Whether key a determines key b: adding b's columns makes no more groups."""
    return counts[frozenset(a)] == counts[frozenset({*a, *b})]


def _with_pairs(specs) -> list[set]:
    return [set(s.columns) for s in specs] + [{*a.columns, *b.columns} for a in specs for b in specs]


def target_summaries(counts: GroupCounts, names, specs, tests, dropna: bool) -> list[dict]:
    """For each tested column the keys that determine it, and which of those are the coarsest, equal or not comparable.

    Keys are compared on the target's own rows. With dropna that needs the tests of all its keys to have used the same
    rows, which they did iff each used as many as have every column of all these keys.
    """
    spec, out = {s.name: s for s in specs}, []
    for target in names:
        own = [t for t in tests if t["target"] == target]
        if not own:
            continue
        holding = [t["key_name"] for t in own if t["holds"]]
        rows_of = {target, *(c for t in own for c in spec[t["key_name"]].columns)} if dropna else set()
        comparable = not dropna or len({counts.size(rows_of), *(t["evaluated_rows"] for t in own)}) == 1
        record = {"target": target, "determining_keys": holding, "cross_key_comparison": "comparable" if comparable else "not_comparable", "coarsest_candidates": [], "equivalent_determinants": [], "incomparable_candidates": []}
        out.append(record)
        if not comparable or not holding:
            continue
        used = [spec[n] for n in holding]
        groups = counts.ask(_with_pairs(used), rows_of)
        fixes = {(a.name, b.name): finer(groups, a.columns, b.columns) for a in used for b in used}
        # A key is coarsest if every determining key that it determines also determines it.
        record["coarsest_candidates"] = [a for a in holding if all(fixes[b, a] for b in holding if fixes[a, b])]
        for kind, both in (("equivalent_determinants", True), ("incomparable_candidates", False)):
            record[kind] = [[a, b] for i, a in enumerate(holding) for b in holding[i + 1 :] if fixes[a, b] == fixes[b, a] == both]
    return out


def grain_graph(counts: GroupCounts, names, specs, tests, dropna: bool) -> dict:
    """Keys merged where they determine each other, coarse-to-fine edges without shortcuts, and each column's place."""
    every = {c for s in specs for c in s.columns} if dropna else set()
    rows, size = counts.rows, counts.size(every)
    with phase("key comparison"):
        groups = counts.ask(_with_pairs(specs), every)
    det = {(a.name, b.name): finer(groups, a.columns, b.columns) if size else False for a in specs for b in specs}
    nodes: list[list[str]] = []
    for s in specs:
        home = next((n for n in nodes if det[s.name, n[0]] and det[n[0], s.name]), None)
        home.append(s.name) if home else nodes.append([s.name])
    ids = {name: f"k{i}" for i, n in enumerate(nodes) for name in n}
    heads = [n[0] for n in nodes]
    below = {(a, b) for a in heads for b in heads if a != b and det[b, a]}  # b's groups lie inside a's
    edges = sorted((a, b) for a, b in below if not any((a, c) in below and (c, b) in below for c in heads if c not in (a, b)))
    tested = []
    fits: dict[tuple[str, str], bool] = {}
    for t in tests:
        compatible = t["evaluated_rows"] == size
        tested.append({"key_name": t["key_name"], "target": t["target"], "holds": t["holds"], "compatible": compatible, "evaluated_rows": t["evaluated_rows"]})
        fits[t["key_name"], t["target"]] = bool(compatible and t["holds"])
    assignments, unplaced = [], []
    for c in names:
        if any(c in s.columns for s in specs):
            continue
        homes = [n[0] for n in nodes if any(fits.get((k, c)) for k in n)]
        coarsest = [a for a in homes if not any((b, a) in below for b in homes)]
        if coarsest:
            assignments.append({"target": c, "nodes": [ids[a] for a in coarsest]})
        else:
            own = [t for t in tested if t["target"] == c]
            apart = bool(own) and any(not t["compatible"] for t in own)
            unplaced.append({"target": c, "reason": "different_target_population" if apart else "no_supported_key"})
    size_of = {s.name: groups[frozenset(s.columns)] for s in specs}
    return {
        "status": "computed" if size else "empty",
        "evaluated_rows": size,
        "missing_excluded_rows": rows - size,
        "missingness": "complete_candidate_keys" if dropna else "missing_as_level",
        "nodes": [{"id": ids[n[0]], "keys": n, "columns": [list(s.columns) for s in specs if s.name in n], "groups": size_of[n[0]], "unique": size > 0 and size_of[n[0]] == size} for n in nodes],
        "edges": [{"source": ids[a], "target": ids[b], "relation": "finer_grouping"} for a, b in edges],
        "key_relationships": [{"determinant": a.name, "dependent": b.name, "holds": det[a.name, b.name]} for a in specs for b in specs if a is not b],
        "tests": tested,
        "assignments": assignments,
        "unplaced": unplaced,
    }


@operation("grain")
def grain(df: DataFrame, candidate_keys, *, features=None, dropna: bool = False, schema=None, scope=None, missing=None, table_id: str = "table") -> Result:
    """Test candidate keys against every other column and arrange them and the columns from coarse to fine."""
    specs = key_specs(df, candidate_keys)
    named = list(dict.fromkeys(c for s in specs for c in s.columns))
    wanted = columns(df, features)
    p: Prepared = prepare(df, list(dict.fromkeys([*wanted, *named])), optional=[c for c in wanted if c not in named] if features is None else (), scope=scope, missing=missing, table_id=table_id)
    names = analysable(wanted, p)
    found = evaluate(p.frame, p.kinds, names, specs, dropna, p.rows)
    table = found.pop("_table")
    p.base |= found
    p.base["parameters"] = {"candidate_keys": {s.name: list(s.columns) for s in specs}, "features": names, "dropna": dropna}
    return Result("grain", p.base, {"tests": table})


