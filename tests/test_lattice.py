"""Discovery with and without what smaller keys imply, and against brute force."""

import json
import random
from collections import Counter

import pytest

import stratalens as st
from stratalens.operators import dependencies


@pytest.fixture(scope="module")
def df(spark):
    rng = random.Random(6)
    rows = []
    for i in range(120):
        site = rng.randint(0, 5)
        rows.append((i if i % 10 else None, site, "north" if site < 3 else "south", rng.choice([None, "p", "q"]), i // 2))
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "id int, site int, area string, kind string, pair int, _n int").coalesce(1).drop("_n")


@pytest.mark.parametrize("dropna", [True, False])
def test_same_evidence_from_fewer_scans(df, monkeypatch, dropna):
    asked = []
    whole = dependencies.test_table
    monkeypatch.setattr(dependencies, "test_table", lambda frame, kinds, key, targets, *rest: asked.append((key, tuple(targets))) or whole(frame, kinds, key, targets, *rest))
    seen = []
    for closure in (True, False):
        monkeypatch.setattr(dependencies.Lattice, "closure", closure)
        asked.clear()
        r = st.discover_dependencies(df, max_key_size=2, dropna=dropna, min_accuracy=0.9, include_grain=False)
        seen.append((json.dumps(r.to_dict(), sort_keys=True), sum(len(t) for _, t in asked), len(asked)))
    (pruned, tests, scans), (full, all_tests, all_scans) = seen
    assert pruned == full
    assert all_tests == 5 * 4 + 10 * 3 and all_scans == 15
    assert tests < all_tests and (scans < all_scans or not dropna)


@pytest.mark.parametrize("dropna", [True, False])
def test_measures_against_brute_force(df, dropna):
    rows = [r.asDict() for r in df.collect()]
    r = st.discover_dependencies(df, max_key_size=2, dropna=dropna, include_grain=False)
    assert len(r["dependencies"]) == 5 * 4 + 10 * 3
    for d in r["dependencies"]:
        key, t = d["determinant"], d["target"]
        inside = [x for x in rows if not dropna or all(x[c] is not None for c in key)]
        used = [x for x in inside if not dropna or x[t] is not None]
        groups = {}
        for x in used:
            groups.setdefault(tuple(x[c] for c in key), Counter())[x[t]] += 1
        sizes = [sum(g.values()) for g in groups.values()]
        want = {
            "determinant_evaluated_rows": len(inside), "evaluated_rows": len(used), "evaluated_groups": len(groups), "target_observed_rows": sum(x[t] is not None for x in inside),
            "violating_groups": sum(len(g) > 1 for g in groups.values()), "affected_rows": sum(sum(g.values()) for g in groups.values() if len(g) > 1),
            "repair_rows": sum(sum(g.values()) - max(g.values()) for g in groups.values()), "repeated_groups": sum(n > 1 for n in sizes), "repeated_rows": sum(n for n in sizes if n > 1),
        }
        assert {k: d[k] for k in want} == want, (key, t)
    for c in r["candidates"]:
        sizes = Counter(tuple(x[k] for k in c["columns"]) for x in rows if not dropna or all(x[k] is not None for k in c["columns"]))
        assert (c["groups"], c["evaluated_rows"], c["repeated_groups"], c["repeated_rows"]) == (len(sizes), sum(sizes.values()), sum(n > 1 for n in sizes.values()), sum(n for n in sizes.values() if n > 1))
