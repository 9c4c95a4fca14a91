"""Declared schemas, versions and keys of the tables. Readers never infer."""

from __future__ import annotations

from pyspark.sql import types as T

SIGNALS_VERSION = "observatory-signals-v1"
ANNOTATION_VERSION = "observatory-annotation-v2"
MODEL_VERSION = "observatory-classifier-v1"
AGREEMENT_VERSION = "observatory-agreement-v1"

_S, _D, _B, _L, _A = T.StringType(), T.DoubleType(), T.BooleanType(), T.LongType(), T.ArrayType(T.StringType(), True)

#: The 31 signal columns, in order.
SIGNAL_TYPES: dict[str, T.DataType] = {
    "trial_id": _S, "trial_id_full": _S, "task_id": _S, "model": _S, "agent_name": _S, "config_name": _S, "benchmark": _S, "benchmark_source": _S,
    "reward": _D, "passed": _B, "has_verifier_result": _B, "total_turns": _L, "tool_calls_total": _L, "search_tool_calls": _L, "edit_tool_calls": _L,
    "code_nav_tool_calls": _L, "semantic_search_tool_calls": _L, "unique_files_read": _L, "unique_files_edited": _L, "files_read_list": _A,
    "files_edited_list": _A, "error_count": _L, "retry_count": _L, "trajectory_length": _L, "has_result_json": _B, "has_trajectory": _B,
    "duration_seconds": _D, "rate_limited": _B, "exception_crashed": _B, "patch_size_lines": _L, "tool_call_sequence": _A,
}
SIGNALS = T.StructType([T.StructField(k, t) for k, t in SIGNAL_TYPES.items()])
SIGNALS_WITH_PATH = T.StructType([*SIGNALS.fields, T.StructField("trial_path", _S)])

ANNOTATION_KEY = ("trial_id", "category_name", "annotator_type", "annotator_identity", "taxonomy_version")
ANNOTATIONS = T.StructType([
    *(T.StructField(k, _S) for k in ("trial_id", "category_name")), T.StructField("confidence", _D),
    *(T.StructField(k, _S) for k in ("evidence", "annotator_type", "annotator_identity", "taxonomy_version", "annotated_at")),
])
ANNOTATOR_TYPES = ("manual", "heuristic", "llm", "classifier", "ensemble", "blended")
MANIFESTS = T.StructType([T.StructField("manifest_id", _S), T.StructField("benchmark", _S), T.StructField("task_count", _L), T.StructField("created_at", _S)])

#: One assigned category inside a nested annotation.
ASSIGNMENT = T.StructType([T.StructField("name", _S), T.StructField("confidence", _D), T.StructField("evidence", _S), T.StructField("source", _S)])
ANNOTATION_DOCUMENT = T.StructType([
    *(T.StructField(k, _S) for k in ("trial_id", "trial_path", "task_id", "model", "agent_name", "config_name", "benchmark", "annotation_result_status")),
    T.StructField("reward", _D), T.StructField("passed", _B), T.StructField("has_trajectory", _B),
    T.StructField("trajectory_length", _L), T.StructField("total_turns", _L), T.StructField("categories", T.ArrayType(ASSIGNMENT)),
])

LIST_COLUMNS = ("files_read_list", "files_edited_list", "tool_call_sequence")
#: Signals that would give the outcome away to a judge.
REDACTED = ("reward", "passed", "exception_info", "exception_crashed")

TABLES: dict[str, T.StructType] = {"signals": SIGNALS, "annotations": ANNOTATIONS, "manifests": MANIFESTS}
EXPORT_ORDER = {"signals": ("trial_id", "task_id"), "annotations": ANNOTATION_KEY, "manifests": ("manifest_id", "benchmark")}


def render_doc(table: str) -> str:
    """Markdown documentation of a declared table."""
    lines = [f"# {table}", "", "| column | type |", "|---|---|"]
    return "\n".join([*lines, *(f"| `{f.name}` | `{f.dataType.simpleString()}` |" for f in TABLES[table].fields)]) + "\n"


def check(df, table: str) -> list[str]:
    """What keeps a DataFrame from being the declared table: missing columns and other types; empty if nothing does."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f"{f.name}: missing" for f in TABLES[table].fields if f.name not in have]
    kind = lambda t: t.simpleString()
    return wrong + [f"{f.name}: {kind(have[f.name])} instead of {kind(f.dataType)}" for f in TABLES[table].fields if f.name in have and kind(have[f.name]) != kind(f.dataType)]


def write_docs(directory: str) -> list[str]:
    """A Markdown file for each declared table."""
    import os

    os.makedirs(directory, exist_ok=True)
    paths = []
    for table in TABLES:
        paths.append(f"{directory}/{table}.md")
        with open(paths[-1], "w", encoding="utf-8") as f:
            f.write(render_doc(table))
    return paths
