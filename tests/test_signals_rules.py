"""Extraction from documents and the rule engine, on small hand-checked trials."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone import registry, taxonomy
from lodestone.functions import columns as C
from lodestone.operators import rules, signals
from lodestone.schemas import SIGNALS, SIGNALS_WITH_PATH
from lodestone.sources import suites


def call(tool, **args):
    return {"function_name": tool, "arguments": args}


def step(*calls, text=None, results=None):
    return {"tool_calls": list(calls), "observation": {"results": [{"content": r} for r in results]} if results is not None else text}


RESULT = {"task_name": "task-1-x", "config_name": "mcp", "started_at": "2026-01-01T00:00:00Z", "finished_at": "2026-01-01T00:02:30Z", "agent_info": {"name": "claude-code", "model_info": {"name": "m"}}, "verifier_result": {"rewards": {"reward": 0.5}}}
STEPS = [
    step(call("Read", file_path="a.py"), results=["fine", "Fatal ERR", "OR here"]),
    step(call("Grep", pattern="x"), call("Grep", pattern="x"), text="Traceback: boom"),
    step(call("Edit", file_path="b.py", new_string="1\n2\n3"), call("Edit", new_string="1\n2\n3", file_path="b.py"), text="ok"),
    step(call("mcp__sourcegraph__nls_search", query="q"), text=""),
    {"observation": "nothing"},
]


def extract(spark, results, trajectories, **kw):
    r = spark.createDataFrame([(p, json.dumps(x) if not isinstance(x, str) else x) for p, x in results], "trial_path string, raw string")
    t = spark.createDataFrame([(p, json.dumps(x)) for p, x in trajectories], "trial_path string, raw string")
    return signals.extract(r, t, **kw)


def test_signals_of_one_trial(spark):
    df = extract(spark, [("/runs/csb_fix_haiku_20260101/t1", RESULT)], [("/runs/csb_fix_haiku_20260101/t1", {"steps": STEPS})])
    assert df.schema.names == SIGNALS_WITH_PATH.names and len(SIGNALS.fields) == 31
    r = df.first()
    assert (r.total_turns, r.tool_calls_total, r.search_tool_calls, r.edit_tool_calls, r.code_nav_tool_calls, r.semantic_search_tool_calls) == (5, 6, 2, 2, 1, 1)
    assert r.tool_call_sequence == ["Read", "Grep", "Grep", "Edit", "Edit", "mcp__sourcegraph__nls_search"]
    assert (r.files_read_list, r.files_edited_list, r.patch_size_lines, r.retry_count, r.error_count) == (["a.py"], ["b.py"], 6, 2, 2)
    assert (r.reward, r.passed, r.duration_seconds, r.benchmark, r.benchmark_source, r.model) == (0.5, True, 150.0, "fix", "directory", "m")
    assert r.has_trajectory and len(r.trial_id) == 32 and r.trial_id_full.startswith(r.trial_id)


def test_retries_by_nested_arguments(spark):
    """(arguments, whether a call with them repeats the one before)."""
    calls = [
        ('{"a": {"b": {"c": 1, "d": [{"x": 1, "y": 2}]}, "e": 2}}', False), ('{"a": {"e": 2, "b": {"d": [{"y": 2, "x": 1}], "c": 1}}}', True),
        ('{"a": {"e": 2, "b": {"d": [{"y": 2, "x": 3}], "c": 1}}}', False), ('{"k": 1}', False), ('{"k": "1"}', False), ('{"k": null}', False), ("{}", False), ("[2, 1]", False), ("[1, 2]", False),
        ('"text {"', False), ('"text {"', True), ('{"k": 1, "k": 2}', False), ('{"k": 1, "k": 2}', True), ('{"é": "\\u00e9"}', False), ('{"\\u00e9": "é"}', True), ("null", False), ("null", True),
    ]
    raw = '{"steps": [' + ", ".join(f'{{"tool_calls": [{{"function_name": "t", "arguments": {a}}}]}}' for a, _ in calls) + "]}"
    df = signals.extract(spark.createDataFrame([("/r/x", json.dumps(RESULT))], "trial_path string, raw string"), spark.createDataFrame([("/r/x", raw)], "trial_path string, raw string"))
    assert df.first().retry_count == sum(again for _, again in calls)
    for i in range(1, len(calls)):  # each pair by itself
        assert spark.range(1).select((signals.canonical_arguments(F.lit(calls[i - 1][0])) == signals.canonical_arguments(F.lit(calls[i][0])))).first()[0] == calls[i][1]


def test_what_is_no_trial(spark):
    rows = [("/r/ok", RESULT), ("/r/none", {"x": 1}), ("/r/bad", "{not json"), ("/r/__incomplete/t", RESULT), ("/r/null", {"agent_info": None})]
    assert {r.trial_path for r in extract(spark, rows, []).collect()} == {"/r/ok", "/r/null"}


def test_missing_parts_and_errors(spark):
    rows = [
        ("/r/a_opus_x/t", {"agent_info": {}, "exception_info": {"type": "Rate limit hit"}}),
        ("/r/b", {"agent_info": {}, "exception_info": "  ", "verifier_result": {"rewards": {"score": "1.0"}}, "started_at": "nonsense"}),
    ]
    a, b = sorted(extract(spark, rows, []).collect(), key=lambda r: r.trial_path)
    assert (a.exception_crashed, a.rate_limited, a.reward, a.passed, a.model) == (True, True, None, False, "anthropic/claude-opus-4-5")
    assert (b.exception_crashed, b.reward, b.passed, b.duration_seconds, b.tool_call_sequence, b.has_trajectory) == (False, 1.0, True, 0.0, [], False)


def test_agents_have_their_own_tools(spark):
    result = RESULT | {"agent_info": {"name": "OpenHands-v1"}}
    t = {"steps": [step(call("execute_bash", command="ls"), call("str_replace_editor", path="z.py"))]}
    r = extract(spark, [("/r/t", result)], [("/r/t", t)]).first()
    assert (r.search_tool_calls, r.edit_tool_calls, r.files_edited_list) == (1, 1, ["z.py"])
    assert registry.for_agent("my-openhands") is registry.OPENHANDS and registry.for_agent(None) is registry.DEFAULT


def test_suite_prefixes(spark):
    m = suites.table(spark, {"task-1": "one", "task-10": "ten", "t-": "any", "run": "dir"})
    t = spark.createDataFrame([("task-1", "/x/a"), ("task-1-b", "/x/a"), ("task-10", "/x/a"), ("task-11", "/x/a"), ("t-9", "/x/a"), ("zzz", "/x/run7"), (None, "/x/none")], "task_id string, trial_path string")
    assert [r.suite for r in suites.resolve(t, m).orderBy("task_id").collect()] == [None, "any", "one", "one", "ten", None, "dir"]
    assert suites.parse_mapping({"run_history": {"csb_fix/base": {"t1": {}}, "other/x": {"t1": {}, "t2": {}}}}) == {"t1": "fix", "t2": "other"}
    assert suites.parse_mapping({"a": "b", "c": 1}) == {"a": "b"} and suites.parse_mapping([]) == {}


@pytest.mark.parametrize(
    ("name", "want"),
    [("csb_sdlc_fix_haiku_20260228_123456", "sdlc_fix"), ("openhands_haiku45_20260301", "openhands"), ("_browse_cc_sonnet46", "browse"), ("bigcode_mcp_20260204", "bigcode_mcp"), ("projects", None), ("home_dir", None), ("a_b_opus__x", "a_b")],
)
def test_run_names(spark, name, want):
    assert spark.range(1).select(C.parse_run_name(F.lit(name)).alias("x")).first().x == want


def test_core_task_names(spark):
    names = ["a/baseline_Task-1__x", "mcp_t__a__b", "sgonly_q/", "plain"]
    got = spark.createDataFrame([(n,) for n in names], "p string").select(C.core_task_name(F.col("p")).alias("x")).collect()
    assert [r.x for r in got] == ["task-1", "t__a", "q", "plain"]


BASE = {"reward": 0.0, "passed": False, "rate_limited": False, "exception_crashed": False, "tool_calls_total": 12, "search_tool_calls": 3, "edit_tool_calls": 0, "code_nav_tool_calls": 2, "semantic_search_tool_calls": 0, "unique_files_read": 4, "unique_files_edited": 0, "error_count": 0, "retry_count": 0, "trajectory_length": 12, "total_turns": 12, "patch_size_lines": 0, "duration_seconds": 100.0, "tool_call_sequence": ["Read", "Bash"], "files_edited_list": [], "agent_name": "claude"}


def fired(spark, **change):
    row = BASE | change
    row = {f.name: row.get(f.name) for f in SIGNALS.fields}
    return {c.name: round(c.confidence, 6) for c in rules.annotate(spark.createDataFrame([tuple(row.values())], SIGNALS)).first().categories}


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({"rate_limited": True}, {"rate_limited_run": 0.9}),
        ({"exception_crashed": True}, {"exception_crash": 0.9}),
        ({"tool_calls_total": 4, "duration_seconds": 10.0}, {"task_ambiguity": 0.4}),
        ({"search_tool_calls": 0, "unique_files_read": 0}, {"retrieval_failure": 0.9}),
        ({"search_tool_calls": 1, "unique_files_read": 1}, {"retrieval_failure": 0.7}),
        ({"search_tool_calls": 9}, {}),
        ({"search_tool_calls": 10}, {"query_churn": 0.75}),
        ({"search_tool_calls": 6, "code_nav_tool_calls": 0}, {"wrong_tool_choice": 0.6}),
        ({"code_nav_tool_calls": 0, "unique_files_read": 5, "unique_files_edited": 2}, {"missing_code_navigation": 0.6, "decomposition_failure": 0.5}),
        ({"edit_tool_calls": 4, "retry_count": 4}, {"edit_verify_loop_failure": 0.7, "premature_commit": None}),
        ({"edit_tool_calls": 4, "error_count": 4}, {"edit_verify_loop_failure": 0.6, "tool_argument_error": 0.733333}),
        ({"trajectory_length": 51, "tool_calls_total": 41, "unique_files_edited": 1, "unique_files_read": 6}, {"stale_context": 0.4}),
        ({"unique_files_read": 3}, {"multi_repo_scope_failure": 0.4}),
        ({"error_count": 6}, {"local_remote_mismatch": 0.5, "tool_argument_error": 0.9}),
        ({"edit_tool_calls": 1, "patch_size_lines": 3}, {"verifier_mismatch": 0.3}),
        ({"tool_calls_total": 100}, {"over_exploration": 0.6}),
        ({"total_turns": 1}, {"premature_termination": 0.8}),
        ({"total_turns": 2}, {"premature_termination": 0.6}),
        ({"total_turns": None, "trajectory_length": 2}, {"premature_termination": 0.6}),
        ({"edit_tool_calls": 1, "tool_call_sequence": ["Read", "Edit"]}, {"verification_skipped": 0.7, "premature_commit": 0.6}),
        ({"edit_tool_calls": 2, "tool_call_sequence": ["Read", "Edit", "Bash"]}, {"verification_skip": 0.5, "premature_commit": None}),
        ({"edit_tool_calls": 1, "tool_call_sequence": ["Edit", "Read", "Bash"]}, {"planning_absence": 0.6}),
        ({"edit_tool_calls": 1, "tool_call_sequence": ["Read", "Edit", "Bash"]}, {"planning_absence": None}),
        ({"unique_files_read": 8, "code_nav_tool_calls": 0, "search_tool_calls": 2}, {"tool_underutilization": 0.5}),
        ({"reward": 0.6, "passed": True, "files_edited_list": ["tests/a", "x_test.py", "b/spec/c"]}, {"reward_hacking": 0.4, "near_miss": 0.74, "incomplete_solution": 0.8, "minimal_progress": None}),
        ({"reward": 0.3, "passed": True}, {"incomplete_solution": 0.8, "minimal_progress": 0.7, "near_miss": None, "success_via_code_nav": 0.6}),
        ({"reward": 1.0, "passed": True, "semantic_search_tool_calls": 2}, {"clean_success": 0.78, "success_via_semantic_search": 0.8, "query_churn": None}),
        ({"reward": 1.0, "passed": True, "edit_tool_calls": 1, "unique_files_edited": 5}, {"success_via_local_exec": 0.7, "success_via_decomposition": 0.8}),
        ({"reward": 1.0, "tool_call_sequence": ["mcp__sourcegraph__commit_search"] * 2}, {"success_via_commit_context": 0.7}),
        ({"reward": 1.0, "tool_calls_total": 5, "search_tool_calls": 0, "code_nav_tool_calls": 0}, {"insufficient_provenance": 0.6}),
        ({"reward": None, "search_tool_calls": 10}, {"query_churn": None, "retrieval_failure": None}),
        ({"reward": None, "edit_tool_calls": 1, "tool_call_sequence": ["Read", "Edit"]}, {"verification_skipped": 0.7}),
    ],
)
def test_rules(spark, change, want):
    got = fired(spark, **change)
    for name, confidence in want.items():
        assert got.get(name) == confidence, got


def test_rules_cover_the_taxonomy_and_order(spark):
    names = [r.category for r in rules.rules()]
    assert len(names) == len(set(names)) == 32 and set(names) <= set(taxonomy.NAMES) and len(taxonomy.NAMES) == 40 and len(set(taxonomy.DIMENSION.values())) == 11
    c = fired(spark, reward=1.0, passed=True, edit_tool_calls=1, unique_files_edited=5)
    assert list(c.values()) == sorted(c.values(), reverse=True)
    with pytest.raises(ValueError, match="bogus"):
        taxonomy.validate_names(["bogus"])
    assert [x["dimension"] for x in taxonomy.flatten({"dimensions": [{"name": "D", "categories": [{"name": "n"}]}]})] == ["D"]


def test_given_tools_take_the_place_of_the_family(spark):
    own = registry.ToolNames(search=("find",), edit=("patch",), navigate=("open",), semantic=("ask",))
    calls = [{"function_name": t, "arguments": {"path": t}} for t in ("find", "open", "patch", "ask", "Read", "Grep")]
    result = {"task_name": "t", "agent_info": {"name": "openhands"}, "verifier_result": {"rewards": {"reward": 1.0}}}
    one = lambda x: spark.createDataFrame([("/r/t__1", json.dumps(x))], "trial_path string, raw string")
    got = [signals.extract(one(result), one({"steps": [{"tool_calls": calls}]}), tools=t) for t in (None, own)]
    count = ("search_tool_calls", "edit_tool_calls", "code_nav_tool_calls", "semantic_search_tool_calls")
    assert [tuple(df.select(*count).first()) for df in got] == [(0, 0, 0, 0), (1, 1, 1, 1)]
    assert got[1].first().files_edited_list == ["patch"] and "open" in got[1].first().files_read_list
    names = [{c.name for c in rules.annotate(df, t).first().categories} for df, t in zip(got, (None, own), strict=True)]
    assert "success_via_semantic_search" in names[1] - names[0]
