"""The rule engine: 32 rules as one projection over the signals, without a shuffle or a Python function.

A rule is a predicate, a confidence and evidence, all Columns. R is a known reward below 1, Q a reward below 1 or missing, S a success.
Missing signals count as 0, false or empty, but a missing reward stays missing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import registry as REG
from ..functions.columns import count_in
from ..taxonomy import NAMES

# Tool names that verify, edit or explore, and marks of test files.
VERIFY = ("Bash", "bash", "RunTests", "run_tests", "test")
EDIT = ("Edit", "edit", "Write", "write", "NotebookEdit")
EXPLORE = ("Read", "read", "Grep", "grep", "Glob", "glob", "Bash", "bash")
TEST_PATH = r"test_|_test\.|tests/|test/|spec/|_spec\."
COMMIT_MARKS = ("commit", "diff", "compare", "blame")
#: Rules that need no trajectory.
WITHOUT_TRAJECTORY = frozenset({"rate_limited_run", "exception_crash", "incomplete_solution", "near_miss", "minimal_progress"})

ASSIGNMENTS = "array<struct<name: string, confidence: double, evidence: string>>"


@dataclass(frozen=True)
class Rule:
    category: str
    when: Column
    confidence: Column
    evidence: Column


def _number(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def rules(tools: REG.ToolNames | None = None) -> list[Rule]:
    """All rules in their order, which decides between equal confidences; given tools take the place of those of the agent's family."""
    n = {k: _number(v) for k, v in {"tot": "tool_calls_total", "srch": "search_tool_calls", "nav": "code_nav_tool_calls", "sem": "semantic_search_tool_calls", "ed": "edit_tool_calls", "fr": "unique_files_read", "fe": "unique_files_edited", "err": "error_count", "rty": "retry_count", "length": "trajectory_length", "patch": "patch_size_lines", "duration": "duration_seconds"}.items()}
    tot, srch, nav, sem, ed, fr, fe, err, rty, length, patch, duration = n.values()
    reward, passed = F.col("reward"), F.coalesce(F.col("passed"), F.lit(False))
    crashed, limited = F.coalesce(F.col("exception_crashed"), F.lit(False)), F.coalesce(F.col("rate_limited"), F.lit(False))
    seq, edited = (F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("tool_call_sequence", "files_edited_list"))
    agent = F.col("agent_name")
    known_low, low, lost = reward < 1, reward.isNull() | (reward < 1), reward <= 0
    success = F.coalesce(reward >= 1, F.lit(False)) | passed
    at = lambda tools: F.transform(seq, lambda t: t.isin(*tools))
    verifications = count_in(seq, VERIFY)
    last_edit = F.size(seq) - F.array_position(F.reverse(at(EDIT)), True) + 1  # 1-based; meaningless without an edit
    edits_at_all = F.array_contains(at(EDIT), True)
    after_edit = F.slice(seq, (last_edit + 1).cast("int"), F.greatest(F.size(seq) - last_edit, F.lit(0)).cast("int"))
    head = F.slice(seq, 1, 3)
    first_edit = F.array_position(F.transform(head, lambda t: t.isin(*EDIT)), True)
    explores = REG.by_agent(agent, lambda r: F.transform(head, lambda t: t.isin(*EXPLORE, *r.search, *r.navigate)), tools)
    first_explore = F.array_position(explores, True)
    used = lambda kind: REG.by_agent(agent, lambda r: count_in(seq, getattr(r, kind)), tools)
    commit_tools = REG.by_agent(agent, lambda r: count_in(seq, tuple(t for t in r.all if any(m in t for m in COMMIT_MARKS))), tools)
    tests = F.size(F.filter(edited, lambda f: F.lower(f).rlike(TEST_PATH)))
    nav_used, sem_used = F.greatest(nav, used("navigate")), F.greatest(sem, used("semantic"))
    turns = F.coalesce(F.col("total_turns"), length)
    error_share = err.cast("double") / F.greatest(tot, F.lit(1))
    say = lambda fmt, *cols: F.format_string(fmt, *cols)
    x = lambda v: F.lit(float(v))
    least = lambda a, b: F.least(x(a), b)
    none = reward == 0
    loop_retry, loop_error = rty > 3, err > 3
    return [
        Rule("rate_limited_run", limited, x(0.9), F.lit("the run hit a rate limit")),
        Rule("exception_crash", crashed, x(0.9), F.lit("the run ended in an exception")),
        Rule("task_ambiguity", none & ~crashed & ~limited & (tot < 5) & (duration < 60) & (ed == 0), x(0.4), say("no reward after %d calls without an edit", tot)),
        Rule("retrieval_failure", lost & ~passed & (srch <= 1) & (fr <= 1), F.when((srch == 0) & (fr == 0), 0.9).otherwise(0.7), say("%d searches, %d files read", srch, fr)),
        Rule("query_churn", known_low & (srch > 5) & (fr < F.floor(srch / 2)), least(0.9, 0.5 + 0.05 * (srch - 5)), say("%d searches for %d files read", srch, fr)),
        Rule("wrong_tool_choice", known_low & (srch > 5) & (nav == 0) & (fr > 3), x(0.6), say("%d searches and no navigation", srch)),
        Rule("missing_code_navigation", known_low & (nav == 0) & (fr >= 5) & (fe >= 2), x(0.6), say("%d files read without navigation", fr)),
        Rule("decomposition_failure", none & (fe >= 2) & (tot > 10), x(0.5), say("%d files edited in %d calls", fe, tot)),
        Rule("edit_verify_loop_failure", known_low & (ed > 3) & (loop_retry | loop_error), F.when(loop_retry, least(0.9, 0.5 + 0.05 * rty)).otherwise(least(0.8, 0.4 + 0.05 * err)), say("%d edits, %d retries, %d errors", ed, rty, err)),
        Rule("stale_context", known_low & (length > 50) & (fe > 0) & (fr > 5) & (tot > 40), x(0.4), say("%d calls over %d files read", tot, fr)),
        Rule("multi_repo_scope_failure", lost & (fe <= 1) & (fr <= 3) & (tot > 10), x(0.4), say("%d calls reached %d files", tot, fr)),
        Rule("local_remote_mismatch", lost & (err > 5) & (ed <= 1) & (tot > 5), x(0.5), say("%d errors with %d edits", err, ed)),
        Rule("verifier_mismatch", lost & (ed > 0) & (patch > 0), x(0.3), say("%d lines written without reward", patch)),
        Rule("over_exploration", lost & (tot > 80) & (ed <= 3), least(0.9, 0.5 + 0.005 * (tot - 80)), say("%d calls, %d edits", tot, ed)),
        Rule("tool_argument_error", low & (tot > 0) & (err >= 3) & (error_share >= 0.3), least(0.9, 0.4 + error_share), say("%d errors in %d calls", err, tot)),
        Rule("premature_termination", low & (turns < 3), F.when(turns <= 1, 0.8).otherwise(0.6), say("ended after %d turns", turns)),
        Rule("verification_skipped", low & (ed > 0) & (verifications == 0), x(0.7), say("%d edits and no check", ed)),
        Rule("verification_skip", low & (ed >= 2) & (verifications == 1), x(0.5), say("%d edits and one check", ed)),
        Rule("premature_commit", low & (ed > 0) & edits_at_all & (count_in(after_edit, VERIFY) == 0), x(0.6), F.lit("no check after the last edit")),
        Rule("planning_absence", low & (F.size(seq) >= 3) & (first_edit > 0) & ((first_explore == 0) | (first_edit < first_explore)), x(0.6), F.lit("the first edit comes before any look around")),
        Rule("tool_underutilization", low & (fr >= 8) & (nav == 0) & (sem == 0) & (srch <= 2), x(0.5), say("%d files read by hand", fr)),
        Rule("reward_hacking", (reward > 0) & (F.size(edited) > 0) & (tests >= 3) & (tests > F.floor(F.size(edited) * 2 / 3)), x(0.4), say("%d test files edited", tests)),
        Rule("incomplete_solution", (reward > 0) & (reward < 1), x(0.8), F.lit("a part of the reward")),
        Rule("near_miss", (reward >= 0.5) & (reward < 1), 0.7 + 0.4 * (reward - 0.5), F.lit("most of the reward")),
        Rule("minimal_progress", (reward > 0) & (reward < 0.5), x(0.7), F.lit("little of the reward")),
        Rule("success_via_code_nav", success & (nav_used > 0), least(0.9, 0.5 + 0.05 * nav_used), say("%d navigation calls", nav_used)),
        Rule("success_via_semantic_search", success & (sem_used > 0), least(0.9, 0.6 + 0.1 * sem_used), say("%d semantic searches", sem_used)),
        Rule("success_via_local_exec", success & F.array_contains(seq, "Bash") & (ed > 0), x(0.7), F.lit("edits and local runs")),
        Rule("success_via_commit_context", success & (commit_tools > 0), least(0.8, 0.5 + 0.1 * commit_tools), say("%d looks into history", commit_tools)),
        Rule("success_via_decomposition", success & (fe >= 3), least(0.8, 0.4 + 0.1 * fe), say("%d files edited", fe)),
        Rule("clean_success", success & (tot <= 20) & (err <= 1) & (rty <= 1), least(0.9, 0.7 + 0.01 * (20 - tot)), say("solved in %d calls", tot)),
        Rule("insufficient_provenance", (reward > 0) & (tot <= 5) & (srch == 0) & (nav == 0), x(0.6), say("reward after %d calls without a search", tot)),
    ]


def assignments(known: tuple[str, ...] = NAMES, tools: REG.ToolNames | None = None) -> Column:
    """The categories of a trial, the most confident first and rules' order between equals: one Column over the signals."""
    fired = F.array(*[
        F.when(F.coalesce(r.when, F.lit(False)), F.struct(F.lit(r.category).alias("name"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), r.confidence.cast("double"))).alias("confidence"), r.evidence.alias("evidence"), F.lit(i).alias("ordinal")))
        for i, r in enumerate(rules(tools)) if r.category in known
    ])
    keyed = F.transform(F.filter(fired, lambda a: a.isNotNull()), lambda a: F.struct((-a["confidence"]).alias("k"), a["ordinal"], a["name"], a["confidence"], a["evidence"]))
    return F.transform(F.array_sort(keyed), lambda a: F.struct(a["name"], a["confidence"], a["evidence"]))


def annotate(signals: DataFrame, tools: REG.ToolNames | None = None) -> DataFrame:
    """signals with categories and the status of their annotation."""
    out = signals.withColumn("categories", assignments(tools=tools))
    return out.withColumn("annotation_result_status", F.when(F.size("categories") > 0, "ok").otherwise("no_categories"))


def narrow(annotated: DataFrame, annotator_type: str = "heuristic", identity: str = "heuristic:rule-engine", version: str | None = None, at: str = "") -> DataFrame:
    """One row for each assigned category, in the columns of the annotation store."""
    from ..taxonomy import VERSION

    c = annotated.select("trial_id", F.explode("categories").alias("c"))
    return c.select("trial_id", F.col("c.name").alias("category_name"), F.col("c.confidence").alias("confidence"), F.col("c.evidence").alias("evidence"), F.lit(annotator_type).alias("annotator_type"), F.lit(identity).alias("annotator_identity"), F.lit(version or VERSION).alias("taxonomy_version"), F.lit(at).alias("annotated_at"))
