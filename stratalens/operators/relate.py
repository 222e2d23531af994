"""relate: key coverage, cardinality and agreement of two tables, and references of a table to itself.

Each side is aggregated per key and the two aggregates are joined once; rows are never joined with rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.context import POSITION, Prepared, bounded, budgets, columns, prepare, sample
from stratalens.functions.counts import rows_
from stratalens.functions.values import quoted
from stratalens.result import Result
from stratalens.runtime import operation, phase, session

SIDES = ("left", "right")
LIMITS = {"example_limit": 5}
BIG = float(1 << 63)


def match_key(column: Column, kind: str, mode: str = "typed") -> Column:
    """A value's identity across tables as text; null for missing.

    Numbers match by value, whole doubles as integers; in text mode whole numbers also match their decimal text.
    Values of different kinds never match otherwise.
    """
    if kind in ("integer", "float"):
        whole = "s:" if mode == "text" else "n:"
        if kind == "integer":
            return F.concat(F.lit(whole), column.cast("string"))
        x = column.cast("double") + F.lit(0.0)
        fits = (F.abs(x) < BIG) & (F.floor(x).cast("double") == x)
        return F.when(fits, F.concat(F.lit(whole), F.when(fits, x).cast("bigint").cast("string"))).otherwise(F.concat(F.lit("f:"), x.cast("string")))
    return F.concat(F.lit({"string": "s:"}.get(kind, kind + ":")), column.cast("string"))


def side_table(frame: DataFrame, keys: list[Column], values: list[Column], dropna: bool = True) -> DataFrame:
    """(key, n, d<j>, v<j>) per complete key: its rows, and for each compared column the distinct values and one of them.

    What is asked of the values is whether a key has none, one or more, so d stops at 2: the least and the greatest value tell, and one
    aggregation with a row per key and task in its shuffle does for all columns, also for a key that a third of all rows have.
    """
    cells = [F.coalesce(v, F.lit("missing")) if not dropna else v for v in values]
    aggs = [x for j, v in enumerate(cells) for x in (F.min(v).alias(f"v{j}"), F.max(v).alias(f"_x{j}"))]
    rows = frame.select("*", F.array(*keys).alias("_key")).where(~F.exists("_key", lambda k: k.isNull()))
    found = rows.groupBy(F.col("_key").alias("key")).agg(rows_().alias("n"), *aggs)
    number = lambda j: F.when(F.col(f"v{j}").isNull(), 0).when(F.col(f"v{j}") == F.col(f"_x{j}"), 1).otherwise(2)
    return found.select("key", "n", *(x for j in range(len(cells)) for x in (number(j).alias(f"d{j}"), F.col(f"v{j}"))))


def joined_table(left: DataFrame, right: DataFrame, compared: int) -> DataFrame:
    """(key, ln, rn, state<j>): rows of each key on both sides, 0 where it is absent, and each compared pair's state on matched keys."""
    r = right.select(F.col("key").alias("rkey"), F.col("n").alias("rn"), *(F.col(f"{x}{j}").alias(f"r{x}{j}") for j in range(compared) for x in "dv"))
    both = left.withColumnRenamed("n", "ln").join(r, F.col("key") == F.col("rkey"), "full_outer")
    matched = F.col("ln").isNotNull() & F.col("rn").isNotNull()
    states = []
    for j in range(compared):
        single = (F.col(f"d{j}") == 1) & (F.col(f"rd{j}") == 1)
        state = F.when((F.col(f"d{j}") == 0) | (F.col(f"rd{j}") == 0), "unavailable").when(single & (F.col(f"v{j}") == F.col(f"rv{j}")), "agree").when(single, "disagree").otherwise("ambiguous")
        states.append(F.when(matched, state).alias(f"state{j}"))
    return both.select(F.coalesce("key", "rkey").alias("key"), F.coalesce("ln", F.lit(0)).alias("ln"), F.coalesce("rn", F.lit(0)).alias("rn"), *states)


def relation_sums(joined: DataFrame, compared: int) -> DataFrame:
    """All counts of a relation in one row."""
    l, r = F.col("ln"), F.col("rn")
    matched = (l > 0) & (r > 0)
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    total = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0))
    sums = {
        "left_keys": count(l > 0), "right_keys": count(r > 0), "matched_keys": count(matched),
        "left_matched_rows": total(matched, l), "right_matched_rows": total(matched, r),
        "left_complete_rows": total(l > 0, l), "right_complete_rows": total(r > 0, r),
        "left_repeated": count(l > 1), "right_repeated": count(r > 1),
        "joined_rows": total(matched, l * r),
        "max_left": F.coalesce(F.max(F.when(matched, l)), F.lit(0)), "max_right": F.coalesce(F.max(F.when(matched, r)), F.lit(0)),
        "left_repeated_matched": count(matched & (l > 1)), "right_repeated_matched": count(matched & (r > 1)),
    }
    for j in range(compared):
        for s in ("agree", "disagree", "ambiguous", "unavailable"):
            sums[f"{s}{j}"] = count(F.coalesce(F.col(f"state{j}") == s, F.lit(False)))
    return joined.agg(*(v.alias(k) for k, v in sums.items()))


def reference_table(frame: DataFrame, own: Column, ref: Column) -> DataFrame:
    """(own, ref, reciprocated) per distinct resolved reference between different keys, and loops as own == ref."""
    edges = frame.select(own.alias("own"), ref.alias("ref"))
    there = edges.where("own is not null").select(F.col("own").alias("k")).distinct()
    resolved = edges.where("own is not null and ref is not null").join(there, F.col("ref") == F.col("k"), "left_semi").distinct()
    back = resolved.select(F.col("own").alias("bo"), F.col("ref").alias("br"), F.lit(True).alias("_back"))
    return resolved.join(back, (F.col("own") == F.col("br")) & (F.col("ref") == F.col("bo")), "left").select("own", "ref", F.coalesce("_back", F.lit(False)).alias("reciprocated"))


def state(hits: int, total: int) -> str:
    return "empty" if not total else "all" if hits == total else "none" if not hits else "some"


class Relation:
    """Two prepared sides and their joined keys; built from the same parameters for payloads and for selections."""

    def __init__(self, left, right, on, compare, match, dropna, scopes, missing, table_ids):
        self.self_reference = right is None
        frames = (left, left if right is None else right)
        scopes, missing = scopes or {}, missing or {}
        if right is None and "left" in (missing or {}) and "right" not in missing:
            missing = {**missing, "right": missing["left"]}
        self.on, self.compare, self.dropna = list(on.items()), list((compare or {}).items()), dropna
        self.prepared: list[Prepared] = []
        for i, (name, frame) in enumerate(zip(SIDES, frames)):
            need = [p[i] for p in (*self.on, *self.compare)] + ([p[1 - i] for p in self.on] if self.self_reference else [])
            columns(frame, list(dict.fromkeys(need)))
            self.prepared.append(prepare(frame, list(dict.fromkeys(need)), scope=scopes.get(name), missing=missing.get(name), table_id=table_ids[i]))
        self.warnings = []
        self.tables = []
        key = lambda i, c: match_key(quoted(c), self.prepared[i].kinds[c], match)
        self.keys = [F.array(*(key(i, p[i]) for p in self.on)) for i in range(2)]
        self.keys = [F.when(~F.exists(k, lambda x: x.isNull()), k) for k in self.keys]
        # the same rows' other key: of a left row its own key, of a right row its reference
        self.other = [F.array(*(key(i, p[1 - i]) for p in self.on)) for i in range(2)] if self.self_reference else None
        if self.other:
            self.other = [F.when(~F.exists(k, lambda x: x.isNull()), k) for k in self.other]
        for (l, r), what in [(p, "key") for p in self.on] + [(p, "compare") for p in self.compare]:
            kinds = [self.prepared[0].kinds[l], self.prepared[1].kinds[r]]
            same = [("number" if k in ("integer", "float") else k) for k in kinds]
            if same[0] != same[1] and not (match == "text" and set(same) == {"number", "string"}):
                self.warnings.append({"code": "KIND_MISMATCH", "use": what, "left": l, "right": r, "left_kind": kinds[0], "right_kind": kinds[1]})
        for i in range(2):
            cells = [key(i, p[i]) for p in self.compare]
            self.tables.append(side_table(self.prepared[i].frame, [key(i, p[i]) for p in self.on], cells, dropna))
        self.joined = joined_table(*self.tables, len(self.compare))

    def rows(self, side: int) -> DataFrame:
        """The side's rows with their key's counts and states, and in a self-reference what becomes of the reference."""
        p = self.prepared[side]
        own = [self.other[0].alias("_own")] if self.self_reference and side == 0 else []
        rows = p.frame.select(POSITION, self.keys[side].alias("_k"), *own)
        out = rows.join(self.joined.withColumnRenamed("key", "_jk"), F.col("_k") == F.col("_jk"), "left")
        if self.self_reference and side == 0:
            edges = self.references().select(F.col("own").alias("_eo"), F.col("ref").alias("_er"), "reciprocated")
            out = out.join(edges, (F.col("_own") == F.col("_eo")) & (F.col("_k") == F.col("_er")), "left")
        return out

    def references(self) -> DataFrame:
        return reference_table(self.prepared[0].frame, self.other[0], self.keys[0])

    def predicates(self, part: dict, side: int) -> tuple[Column, Column]:
        """(examples, exceptions) of a finding's part over rows(side)."""
        mine, yours = (F.col("ln"), F.col("rn")) if side == 0 else (F.col("rn"), F.col("ln"))
        matched = F.coalesce((mine > 0) & (yours > 0), F.lit(False))
        if part["part"] == "coverage":
            return matched, F.col("_k").isNotNull() & ~matched
        if part["part"] == "relation":
            return matched & (mine > 1), matched & (mine <= 1)
        if part["part"] == "agreement":
            s = F.col(f"state{self.compare.index(tuple(part['compare']))}")
            return matched & (s == "agree"), matched & (s == "disagree")
        edge = F.col("reciprocated").isNotNull() & (F.col("_own") != F.col("_k"))
        return edge & F.col("reciprocated"), edge & ~F.col("reciprocated")


@operation("relate")
def relate(left: DataFrame, right: DataFrame | None = None, *, on, compare=None, match: str = "typed", dropna: bool = True, scopes=None, missing=None, table_ids=("left", "right"), limits=None) -> Result:
    """How the keys of two tables relate, or of one table's references to itself when right is left out."""
    limit = budgets(limits, LIMITS)
    if match not in ("typed", "text"):
        raise ValueError("match must be 'typed' or 'text'")
    if not on:
        raise ValueError("on must name at least one pair of key columns")
    for given in (scopes, missing):
        if set(given or {}) - set(SIDES):
            raise ValueError("sides are 'left' and 'right'")
    on, compare, take = dict(on), dict(compare or {}), limit["example_limit"]
    rel = Relation(left, right, on, compare, match, dropna, scopes, missing, table_ids)
    with phase("key counts"):
        s = relation_sums(session().keep(rel.joined), len(rel.compare)).first()
    base = dict(rel.prepared[0].base)
    used = [p.rows for p in rel.prepared]
    base |= {"status": "computed" if any(used) else "empty", "self_reference": rel.self_reference, "sides": {}, "warnings": rel.warnings, "findings": []}
    for i, name in enumerate(SIDES):
        b, keys, done = rel.prepared[i].base, s[f"{name}_keys"], s[f"{name}_matched_rows"]
        base["sides"][name] = {
            "source": b["source"],
            "scope": b["scope"],
            "missing_convention": b["missing_convention"],
            "key": [p[i] for p in rel.on],
            "compare": [p[i] for p in rel.compare],
            "rows": {"evaluated": used[i], "incomplete_key": used[i] - s[f"{name}_complete_rows"], "matched": done, "unmatched": s[f"{name}_complete_rows"] - done},
            "keys": {"distinct": keys, "matched": s["matched_keys"], "unmatched": keys - s["matched_keys"], "repeated": s[f"{name}_repeated"]},
        }
    waiting: list = []
    names = [f"{table_ids[i]}.{'+'.join(p[i] for p in rel.on)}" for i in range(2)]
    features = [(i, p[i]) for i in range(2) for p in rel.on]

    def emit(part, statement, cols, structure, m, sides, **more):
        number = f"f{len(base['findings'])}"
        record = {
            "id": number,
            "pattern": {"coverage": "key_coverage", "relation": "key_relation", "agreement": "value_agreement", "reciprocity": "reference_reciprocity"}[part],
            "statement": statement,
            "features": [{"table": table_ids[i], "column": c} for i, c in cols],
            "counting_unit": "keys",
            "structure": structure,
            "measurements": m,
            "examples": {SIDES[i]: bounded(None, take) for i in sides},
            "exceptions": {SIDES[i]: bounded(None, take) for i in sides},
            "selector": {"finding_id": number, "part": part, **more},
        }
        base["findings"].append(record)
        waiting.extend((record, i) for i in sides)

    base["key_coverage"] = {}
    for direction, i in (("left_to_right", 0), ("right_to_left", 1)):
        name = SIDES[i]
        keys, hit = s[f"{name}_keys"], s["matched_keys"]
        record = {"state": state(hit, keys), "keys": keys, "found": hit, "not_found": keys - hit, "found_rows": s[f"{name}_matched_rows"], "not_found_rows": s[f"{name}_complete_rows"] - s[f"{name}_matched_rows"]}
        base["key_coverage"][direction] = record
        emit("coverage", f"{names[i]} found in {names[1 - i]}: {record['state']}", features, {"direction": direction, "coverage": record["state"]}, record, [i], direction=direction)
    many = (s["max_left"] > 1, s["max_right"] > 1)
    kind = {(False, False): "1:1", (False, True): "1:n", (True, False): "n:1", (True, True): "n:m"}[many] if s["matched_keys"] else None
    base["relation"] = {"type": kind, "matched_keys": s["matched_keys"], "joined_rows": s["joined_rows"], "max_left_rows_per_key": s["max_left"], "max_right_rows_per_key": s["max_right"], "left_repeated_keys": s["left_repeated_matched"], "right_repeated_keys": s["right_repeated_matched"]}
    if kind:
        emit("relation", f"{names[0]} to {names[1]} is {kind} on matched keys", features, {"relation": kind}, base["relation"], [0, 1])
    base["agreement"] = []
    for j, (l, r) in enumerate(rel.compare):
        n = {k: s[f"{k}{j}"] for k in ("agree", "disagree", "ambiguous", "unavailable")}
        record = {"left": l, "right": r, "state": state(n["agree"], n["agree"] + n["disagree"]), "ambiguity": "some" if n["ambiguous"] else "none", "matched_keys": s["matched_keys"], "agreeing_keys": n["agree"], "disagreeing_keys": n["disagree"], "ambiguous_keys": n["ambiguous"], "unavailable_keys": n["unavailable"]}
        base["agreement"].append(record)
        if s["matched_keys"]:
            emit("agreement", f"{table_ids[0]}.{l} and {table_ids[1]}.{r} agree on comparable keys: {record['state']}", [(0, l), (1, r)], {"agreement": record["state"], "ambiguity": record["ambiguity"]}, record, [0, 1], compare=[l, r])
    base["reciprocity"] = None
    if rel.self_reference:
        with phase("references"):
            edge = F.col("own") != F.col("ref")
            e = rel.references().agg(F.coalesce(F.sum(edge.cast("bigint")), F.lit(0)).alias("edges"), F.coalesce(F.sum((edge & F.col("reciprocated")).cast("bigint")), F.lit(0)).alias("back"), F.coalesce(F.sum((~edge).cast("bigint")), F.lit(0)).alias("loops")).first()
            alone = rel.prepared[0].frame.where(rel.keys[0].isNotNull() & rel.other[0].isNull()).count()
        record = {"state": state(e["back"], e["edges"]), "self_references": "some" if e["loops"] else "none", "resolved_references": e["edges"], "reciprocated": e["back"], "not_reciprocated": e["edges"] - e["back"], "self_referencing_keys": e["loops"], "incomplete_own_key_rows": alone}
        base["reciprocity"] = record
        if e["edges"] or e["loops"]:
            emit("reciprocity", f"references of {names[0]} answered: {record['state']}", features, {"reciprocity": record["state"], "self_references": record["self_references"]}, record, [0])
    with phase("evidence rows"):
        for i in range(2):
            asked = {}
            for record, side in waiting:
                if side == i:
                    good, bad = rel.predicates(record["selector"], i)
                    asked[record["id"], "examples"], asked[record["id"], "exceptions"] = good, bad
            found = sample(rel.rows(i), asked, take)
            for record, side in waiting:
                for part in ("examples", "exceptions") if side == i else ():
                    record[part][SIDES[i]] = bounded(found[record["id"], part], take)
    base["parameters"] = {"on": on, "compare": compare, "match": match, "dropna": dropna, "table_ids": list(table_ids), "limits": limit}
    return Result("relation", base, {"keys": rel.joined})


def matching_rows(result: Result, record: dict, left: DataFrame, right: DataFrame | None, side: str, exceptions: bool) -> DataFrame:
    """All positions of a saved finding on one side."""
    from stratalens.operators.selection import saved_scope

    d = result.payload
    scopes = {n: saved_scope(left if n == "left" or right is None else right, d["sides"][n]) for n in SIDES}
    missing = {n: d["sides"][n]["missing_convention"]["sentinels"] for n in SIDES}
    q = d["parameters"]
    rel = Relation(left, None if d["self_reference"] else right, q["on"], q["compare"], q["match"], q["dropna"], scopes, missing, q["table_ids"])
    good, bad = rel.predicates(record["selector"], SIDES.index(side))
    return rel.rows(SIDES.index(side)).where(bad if exceptions else good).select(POSITION)
