"""Structural profiling of Spark DataFrames: exact counts, dependencies, grain, missingness, patterns and relations."""

from stratalens.context import Scope, fingerprint
from stratalens.operators.availability import missingness
from stratalens.operators.census import census
from stratalens.operators.dependencies import discover_dependencies
from stratalens.operators.grain import KeySpec, grain
from stratalens.operators.levels import SchemaProposal, infer_schema, joint_counts, levels
from stratalens.operators.overview import explore, profile
from stratalens.operators.pairs import pairs
from stratalens.operators.paths import Path, suggest_paths
from stratalens.operators.patterns import value_patterns
from stratalens.operators.relate import relate
from stratalens.operators.workflow import Recipe, compare
from stratalens.present.figures import render_html, render_svg
from stratalens.present.project import visualization_data
from stratalens.present.text import render_plaintext
from stratalens.result import Result
from stratalens.runtime import AnalysisCancelled, AnalysisError, CancellationToken, ProgressDisplay, ProgressEvent

__all__ = [
    "AnalysisCancelled", "AnalysisError", "CancellationToken", "KeySpec", "Path", "ProgressDisplay", "ProgressEvent", "Recipe", "Result",
    "SchemaProposal", "Scope", "census", "compare", "discover_dependencies", "explore", "fingerprint", "grain", "infer_schema", "joint_counts", "levels",
    "missingness", "pairs", "profile", "relate", "render_html", "render_plaintext", "render_svg", "suggest_paths",
    "value_patterns", "visualization_data",
]
