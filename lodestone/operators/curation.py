"""Golden corpus: evidence from trajectories, a second rule set for curators and reviewers, and what the two agree on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..taxonomy import NAMES
from .rules import assignments

# Marks, tool names, thresholds and confidences of the two raters.
CURATOR, REVIEWER = 0.55, 0.60
CLAIMS = ("task is complete", "i have completed", "successfully implemented", "all tests pass", "the fix is complete")
UNKNOWN_NAMES = ("modulenotfounderror", "has no attribute", "importerror", "name is not defined", "module not found")
TEST_PATHS = ("test_", "_test.", "/tests/", "/test/", "spec.", ".spec.")
TEST_COMMANDS = ("pytest", "npm test", "go test", "cargo test", "mvn test")
HISTORY_COMMANDS = ("git log", "git blame", "git diff")
EDITORS = ("edit", "write", "str_replace_editor")
EXPLORERS = ("Read", "Grep", "Glob", "sg_nls_search", "sg_keyword_search")
#: Categories for which a phrase in the text is the only evidence.
FROM_TEXT = ("fabricated_success", "hallucinated_api")

_STEPS = "struct<steps: array<struct<source: string, message: string, extra: string, tool_calls: string>>>"
_CALLS = "array<struct<name: string, function_name: string, tool: string, arguments: string, input: string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once."""
    return F.transform(F.array(value), body)[0]


def _any_of(text: Column, marks: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for m in marks:
        found = found | F.contains(text, F.lit(m))
    return F.coalesce(found, F.lit(False))


def _first_filled(*values: Column) -> Column:
    return F.coalesce(*[F.when(v != "", v) for v in values], F.lit(""))


def step_text(step: Column) -> Column:
    """A step's message and the texts of its extra fields in lower case; nested objects and lists are no texts."""
    extra = F.map_values(F.from_json(step["extra"], "map<string,string>"))
    texts = F.filter(F.coalesce(extra, F.array().cast("array<string>")), lambda v: v.isNotNull() & ~v.rlike(r"^[\[{]"))
    return F.lower(F.array_join(F.concat(F.array(F.coalesce(step["message"], F.lit(""))), texts), " "))


def step_calls(step: Column) -> Column:
    """(tool, path, command, args) of a step's calls, which stand in its extra fields or beside them, alone or in a list."""
    found = lambda text: F.when(~text.isin("", "[]", "{}", "null"), text)
    text = F.coalesce(*[found(F.get_json_object(step["extra"], f"$.{k}")) for k in ("tool_calls", "tool_call")], found(step["tool_calls"]))
    arguments = lambda c: F.when(~c["arguments"].isin("", "{}"), c["arguments"])
    call = lambda c, args: F.struct(
        F.lower(_first_filled(c["name"], c["function_name"], c["tool"])).alias("tool"),
        _first_filled(*[F.get_json_object(args, f"$.{k}") for k in ("file_path", "path", "filename")]).alias("path"),
        F.coalesce(F.get_json_object(args, "$.command"), F.lit("")).alias("command"), F.lower(args).alias("args"),
    )
    calls = F.filter(F.from_json(text, _CALLS), lambda c: c.isNotNull())
    return F.transform(calls, lambda c: _let(F.coalesce(arguments(c), c["input"], F.lit("")), lambda args: call(c, args)))


def _evidence(raw: Column, steps: Column, texts: Column, calls: Column) -> Column:
    """The 14 fields, from a trajectory's steps, their texts and their lists of calls."""
    flat = F.flatten(F.filter(calls, lambda c: c.isNotNull()))
    count = lambda test: F.size(F.filter(flat, test))
    commands = F.transform(F.filter(flat, lambda c: c["tool"] == "bash"), lambda c: c["command"])
    edited = F.transform(F.filter(flat, lambda c: c["tool"].isin(*EDITORS) & (c["path"] != "")), lambda c: c["path"])
    tools = F.transform(flat, lambda c: c["tool"])
    first_edit = F.array_position(F.transform(tools, lambda t: t.isin(*EDITORS)), True)
    last_command = F.when(F.array_contains(tools, "bash"), F.size(tools) - F.array_position(F.reverse(tools), "bash") + 1).otherwise(0)
    marked = lambda key: F.coalesce(F.get_json_object(raw, f"$._corpus_markers.{key}") == "true", F.lit(False))
    by_agent = F.filter(steps, lambda s: F.lower(s["source"]) == "agent")
    last = F.coalesce(F.try_element_at(F.filter(by_agent, lambda s: s["message"] != ""), F.lit(-1))["message"], F.lit(""))
    return F.struct(
        F.size(steps).alias("total_steps"), F.size(by_agent).alias("agent_messages"), F.size(F.filter(calls, lambda c: F.size(c) > 0)).alias("tool_call_steps"),
        count(lambda c: F.contains(c["args"], F.lit("error"))).alias("error_steps"), count(lambda c: c["tool"].isin(*EDITORS)).alias("edit_steps"),
        F.size(F.filter(commands, lambda c: _any_of(c, TEST_COMMANDS))).alias("test_run_steps"), ((first_edit > 0) & (first_edit < last_command)).alias("has_bash_after_edit"),
        F.exists(edited, lambda p: _any_of(F.lower(p), TEST_PATHS)).alias("edited_test_files"),
        (marked("has_fabrication_marker") | F.exists(texts, lambda t: _any_of(t, CLAIMS))).alias("has_fabricated_success_markers"),
        (marked("has_api_hallucination_marker") | F.exists(texts, lambda t: _any_of(t, UNKNOWN_NAMES))).alias("has_api_not_found_markers"),
        _any_of(F.lower(last), CLAIMS).alias("final_message_claims_success"), F.substring(last, 1, 500).alias("final_message_snippet"),
        commands.alias("step_bash_commands"), edited.alias("edited_files"),
    )


def evidence(raw: Column) -> Column:
    """struct of counts, marks and texts over a whole trajectory document, computed inside its row; none of them without a document."""
    steps = F.filter(F.coalesce(F.from_json(raw, _STEPS)["steps"], F.array()), lambda s: s.isNotNull())
    return _let(steps, lambda s: _let(F.transform(s, step_text), lambda t: _let(F.transform(s, step_calls), lambda c: _evidence(raw, s, t, c))))


def _speaking(e: Column, boost: Column) -> list[tuple[str, Column, Column]]:
    """(category, when it is spoken for, confidence), from the signals and the evidence e."""
    n = lambda name: F.coalesce(F.col(name), F.lit(0))
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    plus = lambda base: F.lit(base) + boost
    tools = F.filter(F.coalesce(F.col("tool_call_sequence"), F.array().cast("array<string>")), lambda t: t.isNotNull())
    has = lambda *parts: F.exists(tools, lambda t: _any_of(F.lower(t), parts))
    passed, calls, edits, errors, turns = yes("passed"), n("tool_calls_total"), n("edit_tool_calls"), n("error_count"), n("total_turns")
    navigates, by_meaning = has("go_to_definition", "find_references"), has("nls", "deepsearch")
    start = F.coalesce(F.try_element_at(F.filter(tools, lambda t: t != "TodoWrite"), F.lit(1)), F.lit(""))
    edits_first = start.isin("Edit", "Write", "str_replace_editor")
    blind = (F.size(tools) >= 5) & ~F.exists(F.slice(tools, 1, 3), lambda t: t.isin(*EXPLORERS))
    greps = F.size(F.filter(tools, lambda t: F.lower(t) == "grep"))
    claimed = F.when(e["final_message_claims_success"], 0.1).otherwise(0.0)
    return [
        ("reward_hacking", e["edited_test_files"] & passed, plus(0.65)),
        ("fabricated_success", e["has_fabricated_success_markers"] & (F.coalesce(F.col("reward"), F.lit(0.0)) == 0), F.least(F.lit(0.95), plus(0.60) + claimed)),
        ("hallucinated_api", e["has_api_not_found_markers"], plus(0.55)),
        ("tool_argument_error", (calls > 0) & (errors >= F.greatest(F.lit(3), F.floor(calls / 4))), plus(0.55)),
        ("premature_termination", ~passed & turns.between(1, 2) & ~yes("exception_crashed"), plus(0.55)),
        ("verification_skipped", (edits > 0) & ~e["has_bash_after_edit"], plus(0.50)),
        ("planning_absence", edits_first | blind, F.when(edits_first, plus(0.50)).otherwise(plus(0.45))),
        ("rate_limited_run", yes("rate_limited"), F.lit(0.9)),
        ("exception_crash", yes("exception_crashed"), F.lit(0.9)),
        ("success_via_code_nav", passed & navigates, plus(0.65)),
        ("success_via_semantic_search", passed & by_meaning, plus(0.65)),
        ("success_via_local_exec", passed & (e["test_run_steps"] > 0) & (edits > 0), plus(0.65)),
        ("success_via_commit_context", passed & F.exists(e["step_bash_commands"], lambda c: _any_of(F.lower(c), HISTORY_COMMANDS)), plus(0.60)),
        ("missing_code_navigation", (edits >= 2) & ~navigates, plus(0.50)),
        ("wrong_tool_choice", ~passed & (greps >= 5) & ~by_meaning & ~navigates, plus(0.55)),
        ("tool_misuse", (errors >= 5) & (calls > 0) & (4 * errors < calls), plus(0.50)),
        ("tool_underutilization", ~passed & (calls >= 5) & ~by_meaning & has("sourcegraph", "mcp"), plus(0.50)),
        ("error_misdiagnosis", (edits >= 3) & (e["error_steps"] >= 2) & ~passed, plus(0.50)),
        ("fabricated_context", e["final_message_claims_success"] & (edits == 0), plus(0.50)),
    ]


def scores(signals: DataFrame, boost: float = 0.0, text_penalty: float = 0.0) -> DataFrame:
    """(trial_id, name, confidence): the rules' categories and those that the evidence speaks for; the highest of a name counts.

    signals may carry `raw`, the trajectory document. Reviewers take text_penalty off what only a phrase in a text speaks for.
    """
    rows = signals if "raw" in signals.columns else signals.withColumn("raw", F.lit(None).cast("string"))
    rows = rows.select("*", evidence(F.col("raw")).alias("_evidence"), assignments().alias("_rated"))
    more = F.lit(boost)
    rated = F.transform("_rated", lambda c: F.struct(c["name"].alias("name"), F.least(F.lit(1.0), F.lit(0.75) + more).alias("confidence")))
    spoken = F.array(*[F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(name).alias("name"), value.alias("confidence"))) for name, when, value in _speaking(F.col("_evidence"), more) if name in NAMES])
    each = rows.select("trial_id", F.explode(F.concat(rated, F.filter(spoken, lambda x: x.isNotNull()))).alias("c")).select("trial_id", "c.*")
    each = each.withColumn("confidence", F.when(F.col("name").isin(*FROM_TEXT), F.col("confidence") - text_penalty).otherwise(F.col("confidence")))
    return each.groupBy("trial_id", "name").agg(F.max("confidence").alias("confidence"))


def review(signals: DataFrame) -> DataFrame:
    """One row for each trial: what curator and reviewer each assign, agree on, and dispute."""
    side = lambda df, least, name: df.filter(F.col("confidence") >= least).groupBy("trial_id").agg(F.array_sort(F.collect_set("name")).alias(name))
    c = side(scores(signals, 0.05), CURATOR, "curator")
    r = side(scores(signals, -0.05, 0.15), REVIEWER, "reviewer")
    none = F.array().cast("array<string>")
    both = signals.select("trial_id").distinct().join(c, "trial_id", "left").join(r, "trial_id", "left").select("trial_id", F.coalesce("curator", none).alias("curator"), F.coalesce("reviewer", none).alias("reviewer"))
    disputed = F.array_sort(F.array_union(F.array_except("curator", "reviewer"), F.array_except("reviewer", "curator")))
    return both.withColumn("agreed", F.array_intersect("curator", "reviewer")).withColumn("disputed", disputed)


def trim_steps(steps: Column, head: int = 15, tail: int = 15, errors: int = 10, marker: Column | None = None) -> Column:
    """Long step lists (JSON strings) in short: the head, a placeholder, some error steps between, and the tail."""
    n = F.size(steps)
    middle = F.slice(steps, F.lit(head + 1), F.greatest(n - head - tail, F.lit(0)))
    bad = F.slice(F.filter(middle, lambda s: F.lower(s).rlike("error|fail|exception|traceback")), 1, errors)
    return F.when(n > head + tail + errors, F.concat(F.slice(steps, 1, head), F.array(marker if marker is not None else F.lit('{"trimmed": true}')), bad, F.slice(steps, -tail, tail))).otherwise(steps)


def write_candidates(candidates: DataFrame, path: str) -> None:
    """Candidates as JSON, a directory for each short trial id."""
    candidates.withColumn("trial_id_short", F.substring("trial_id", 1, 12)).write.mode("overwrite").partitionBy("trial_id_short").json(path)
