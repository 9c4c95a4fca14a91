"""The taxonomy of behaviours: 40 categories in 11 dimensions, and readers for other versions of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

VERSION = "3.0.0"


def _category(name: str, dimension: str, polarity: str, severity: str, derived: bool = False, needs: tuple[str, ...] = ()) -> dict:
    """derived: the reward alone gives it; needs: signals it depends on."""
    return {"name": name, "dimension": dimension, "polarity": polarity, "severity": severity, "derived_from_signal": derived, "signal_dependencies": list(needs)}


# The categories.
CATEGORIES: list[dict] = [
    _category("retrieval_failure", "Retrieval", "failure", "blocker"),
    _category("query_churn", "Retrieval", "failure", "major"),
    _category("missing_code_navigation", "Retrieval", "failure", "major"),
    _category("wrong_tool_choice", "ToolUse", "failure", "major"),
    _category("tool_misuse", "ToolUse", "failure", "major"),
    _category("tool_argument_error", "ToolUse", "failure", "major", False, ("error_count",)),
    _category("tool_underutilization", "ToolUse", "failure", "minor"),
    _category("decomposition_failure", "Reasoning", "failure", "blocker"),
    _category("stale_context", "Reasoning", "failure", "major"),
    _category("multi_repo_scope_failure", "Reasoning", "failure", "blocker"),
    _category("edit_verify_loop_failure", "Execution", "failure", "blocker"),
    _category("incomplete_solution", "Execution", "failure", "major", True, ("reward",)),
    _category("near_miss", "Execution", "failure", "minor", True, ("reward",)),
    _category("minimal_progress", "Execution", "failure", "major", True, ("reward",)),
    _category("premature_commit", "Execution", "failure", "major"),
    _category("local_remote_mismatch", "Environment", "failure", "blocker"),
    _category("verifier_mismatch", "Environment", "failure", "blocker"),
    _category("exception_crash", "Environment", "failure", "blocker"),
    _category("rate_limited_run", "Environment", "neutral", "major"),
    _category("hallucinated_api", "Faithfulness", "failure", "blocker"),
    _category("fabricated_context", "Faithfulness", "failure", "blocker"),
    _category("planning_absence", "Metacognition", "failure", "major"),
    _category("verification_skip", "Metacognition", "failure", "major"),
    _category("premature_termination", "Metacognition", "failure", "blocker", False, ("total_turns", "trajectory_length",)),
    _category("verification_skipped", "Metacognition", "failure", "major"),
    _category("error_misdiagnosis", "Metacognition", "failure", "major"),
    _category("reward_hacking", "Integrity", "failure", "blocker"),
    _category("fabricated_success", "Integrity", "failure", "blocker"),
    _category("destructive_operation", "Safety", "failure", "blocker"),
    _category("credential_exposure", "Safety", "failure", "blocker"),
    _category("scope_violation", "Safety", "failure", "blocker"),
    _category("success_via_code_nav", "Strategy", "success", "minor"),
    _category("success_via_semantic_search", "Strategy", "success", "minor"),
    _category("success_via_local_exec", "Strategy", "success", "minor"),
    _category("success_via_commit_context", "Strategy", "success", "minor"),
    _category("success_via_decomposition", "Strategy", "success", "minor"),
    _category("clean_success", "Strategy", "success", "minor"),
    _category("insufficient_provenance", "Observability", "neutral", "minor"),
    _category("task_ambiguity", "Observability", "neutral", "minor"),
    _category("over_exploration", "Observability", "failure", "major"),
]
NAMES = tuple(c["name"] for c in CATEGORIES)
DERIVED = frozenset(c["name"] for c in CATEGORIES if c["derived_from_signal"])
POLARITY = {c["name"]: c["polarity"] for c in CATEGORIES}
DIMENSION = {c["name"]: c["dimension"] for c in CATEGORIES}

SCHEMA = T.StructType([
    *(T.StructField(k, T.StringType()) for k in ("name", "dimension", "polarity", "severity")), T.StructField("derived_from_signal", T.BooleanType()),
    T.StructField("signal_dependencies", T.ArrayType(T.StringType())),
])


def flatten(document: dict) -> list[dict]:
    """The categories of a taxonomy document: flat (version 1) or grouped by dimension (2 and 3)."""
    if "dimensions" in document:
        return [{"dimension": d.get("name")} | c for d in document["dimensions"] for c in d.get("categories", [])]
    return list(document.get("categories", []))


def load(path: str | None = None) -> list[dict]:
    """The built-in taxonomy, or one of a YAML or JSON file."""
    if path is None:
        return [dict(c) for c in CATEGORIES]
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        import json

        document = json.loads(text)
    else:
        import yaml

        document = yaml.safe_load(text)
    if not isinstance(document, dict):
        raise ValueError(f"{path}: not a taxonomy")
    return flatten(document)


def table(spark: SparkSession, categories: list[dict] | None = None) -> DataFrame:
    """One row for each category: a dimension of fixed size."""
    rows = [tuple(c.get(f.name) for f in SCHEMA.fields) for c in categories or CATEGORIES]
    return spark.createDataFrame(rows, SCHEMA)


def prompt_text(categories: list[dict] | None = None) -> str:
    """The taxonomy as a prompt states it: a line for each category."""
    return "\n".join(f"- {c['name']} ({c['dimension']}, {c['polarity']}, {c['severity']})" for c in categories or CATEGORIES)


def validate_names(names, known=NAMES) -> None:
    wrong = sorted(set(names) - set(known))
    if wrong:
        raise ValueError(f"unknown categories: {', '.join(wrong)}")
