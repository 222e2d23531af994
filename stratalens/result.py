"""Saved evidence: a JSON payload, and the DataFrames that it was taken from while the session lives."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame

SCHEMA_VERSION = "2.0"


class Result(Mapping):
    """Evidence from one analysis. Indexing reads the payload; `tables` holds unbounded, lazy DataFrames."""

    schema_version = SCHEMA_VERSION

    def __init__(self, kind: str, payload: dict[str, Any] | None = None, tables: dict[str, DataFrame] | None = None):
        self.kind, self.payload, self.tables = kind, payload or {}, tables or {}

    def to_dict(self) -> dict[str, Any]:
        return {"schema_version": SCHEMA_VERSION, "kind": self.kind, **self.payload}

    @classmethod
    def from_dict(cls, data: Mapping) -> Result:
        if data.get("schema_version") != SCHEMA_VERSION:
            raise ValueError(f"Unsupported result schema {data.get('schema_version')!r}")
        return cls(data["kind"], {k: v for k, v in data.items() if k not in ("kind", "schema_version")})

    def section(self, name: str) -> Result:
        """One part of an overview or a profile."""
        part = self.payload.get("sections", {}).get(name)
        if part is None:
            raise KeyError(name)
        if part.get("status") == "not_requested":
            raise ValueError(f"section {name!r} was not requested")
        return Result.from_dict(part)

    @property
    def findings(self) -> list[dict[str, Any]]:
        """The findings; of an overview those of its sections in the order of their leads."""
        if self.kind != "overview":
            return list(self.payload.get("findings", []))
        out = []
        for lead in self.payload["leads"]:
            found = self.payload["sections"][lead["section"]]["findings"]
            record = next(f for f in found if f["id"] == lead["finding_id"])
            out.append({**record, "id": lead["id"], "lead": lead["lead"], "section": lead["section"], "section_finding_id": lead["finding_id"]})
        return out

    def to_frame(self, spark, section: str = "findings") -> DataFrame:
        """A list of the payload as a DataFrame; nested parts are JSON text."""
        import json

        rows = self.findings if section == "findings" else self.payload[section]
        if not isinstance(rows, list):
            raise TypeError(f"{section!r} is not a list")
        names = list(dict.fromkeys(k for r in rows for k in r))
        text = [tuple(None if r.get(k) is None else r[k] if isinstance(r[k], str) else json.dumps(r[k], sort_keys=True) for k in names) for r in rows]
        return spark.createDataFrame(text, ", ".join(f"`{n}` string" for n in names) or "empty string")

    def relationships(self, feature: str | None = None, kinds=None) -> list[dict]:
        """The links of an overview's feature network, by feature and kind."""
        links = self.payload["feature_network"]["relationships"]
        named = lambda r: feature is None or any(f["column"] == feature for f in r["features"])
        return [r for r in links if named(r) and (kinds is None or r["kind"] in kinds)]

    @property
    def best(self):
        """The first recommended path of a paths result."""
        return self.path(0)

    def path(self, i: int):
        from stratalens.operators.paths import Path

        if self.kind == "overview":
            return self.section("paths").path(i)
        record = self.payload["paths"][i]
        return Path(tuple(record["dimensions"]), record, self)

    def find(self, finding: str | int) -> dict[str, Any]:
        found = self.findings
        if isinstance(finding, int):
            return found[finding]
        for record in found:
            if record["id"] == finding:
                return record
        raise KeyError(finding)

    def inspect(self, df: DataFrame, finding: str | int, *, exceptions: bool = False, all_matches: bool = False, side: str = "left", right: DataFrame | None = None, **runtime) -> DataFrame:
        """A finding's source rows: its saved examples, or all of them, as a DataFrame in source order."""
        from stratalens.operators.selection import inspect_rows

        return inspect_rows(self, df, finding, exceptions=exceptions, all_matches=all_matches, side=side, right=right, **runtime)

    def select(self, df: DataFrame, finding: str | int, *, exceptions: bool = False, name: str = "finding selection", side: str = "left", right: DataFrame | None = None, **runtime):
        """All rows of a finding as a Scope; nothing is collected."""
        from stratalens.operators.selection import select_scope

        return select_scope(self, df, finding, exceptions=exceptions, name=name, side=side, right=right, **runtime)

    def recompute(self, df: DataFrame, **overrides) -> Result:
        """Run the analysis again on the same source with some options changed; limits merge with the saved ones."""
        from stratalens.operators.workflow import recompute

        return recompute(self, df, **overrides)

    def __getitem__(self, key):
        return self.to_dict()[key]

    def __iter__(self):
        return iter(self.to_dict())

    def __len__(self):
        return len(self.to_dict())

    def __repr__(self):
        from stratalens.present.text import render_plaintext

        return render_plaintext(self, max_lines=40)
