"""Trials from the `events` table: documents of trials, as files would hold them, and the tables that the operators make of them.

An event is a step with one call. A user's events fall into trials by user and time; tools, paths, rewards and the dimensions are
integer functions of the event. One shuffle by trial gathers the steps of a trial (at most a few hundred) into its two documents, a
result and a trajectory, both JSON text; the signals are what extract() reads out of these documents, and the categories what the rules
say of the signals. Documents, signals and categories are tables that are written once for each session and state of the input.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import sealed
from ..operators.rules import annotate, narrow
from ..operators.signals import extract
from ..schemas import SIGNAL_TYPES
from ..session import written

MODELS = ("model-a", "model-b", "model-c", "model-d")
AGENTS = ("alpha", "beta", "gamma")
CONFIGS = ("baseline", "mcp", "sgonly")

_STEPS = """
SELECT event_id, ts, user_id AS u, event_type, {k} AS k,
       CASE WHEN user_id % 3 = 0 THEN 0 WHEN user_id % 3 = 1 THEN 100 + {div_day} ELSE 200 + day(ts) END AS seg,
       ({u3}) % 5 AS p
FROM {events}
"""
_CALLS = """
SELECT event_id, ts, u, seg, k, p, event_type = 'error' AS is_error,
       CASE WHEN event_type = 'view' THEN CASE WHEN p = 1 THEN 'read_file' ELSE 'Read' END
            WHEN event_type = 'click' THEN
              CASE WHEN p = 1 THEN CASE WHEN u % 2 = 0 THEN 'Grep' ELSE 'TodoWrite' END
                   WHEN k % 10 = 1 THEN 'mcp__sourcegraph__nls_search' WHEN k % 10 = 3 THEN 'mcp__sourcegraph__find_references'
                   WHEN k % 10 = 5 THEN 'mcp__sourcegraph__commit_search' ELSE 'Grep' END
            WHEN event_type = 'purchase' THEN CASE WHEN p = 2 THEN 'TodoWrite' WHEN k % 2 = 0 THEN 'Edit' ELSE 'Write' END
            ELSE 'Bash' END AS tool,
       CASE WHEN event_type NOT IN ('view', 'purchase') THEN NULL
            WHEN p = 3 AND event_type = 'purchase' THEN concat('tests/test_', k, '.py')
            ELSE concat('src/f', k % 20, '.py') END AS path
FROM steps
"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each call: trial key (u, seg), order (ts, event_id), tool, path, is_error."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "props")
    steps = spark.sql(_STEPS.format(k="cast(get_json_object(props, '$.k') AS int)", div_day="(day(ts) - 1) div 7", u3="user_id div 3", events="{events}"), events=events)
    return spark.sql(_CALLS.replace("FROM steps", "FROM {steps}"), steps=steps)


EDITING = ("Edit", "Write", "NotebookEdit")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trial_path, result, trajectory): the two documents of every trial as JSON text."""
    c = calls(spark, sf_dir)
    # an edit carries as many lines as the event's number says
    content = F.when(F.col("tool").isin(*EDITING) & (F.col("k") > 0), F.concat(F.repeat(F.lit("x\n"), F.col("k").cast("int") - 1), F.lit("x")))
    lines = F.struct(F.lit(1).alias("first"), F.lit(2).alias("last"))
    arguments = F.struct(F.col("path").alias("file_path"), content.alias("content"), F.struct(lines.alias("lines")).alias("view"))
    said = F.when(~F.col("is_error"), "done").when(F.col("k") % 2 == 0, "Traceback: it did not work").otherwise('{"results": [{"content": "an "}, {"content": "Error"}]}')
    step = F.struct("ts", "event_id", F.array(F.struct(F.col("tool").alias("function_name"), arguments.alias("arguments"))).alias("tool_calls"), said.alias("observation"))
    t = c.groupBy("u", "seg").agg(F.array_sort(F.collect_list(step)).alias("steps"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    pick = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), (i % len(names) + 1).cast("int"))
    stamp = lambda x: F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss")
    u, seg = F.col("u"), F.col("seg")
    r = (F.floor(u / 3) + seg * 5) % 6
    reward = F.when(r == 0, F.lit(None)).when(r <= 2, 0.0).when(r == 3, 0.3).when(r == 4, 0.7).otherwise(1.0).cast("double")
    given = F.when(u % 2 == 0, F.struct(reward.alias("reward"), F.lit(None).cast("double").alias("score"))).otherwise(F.struct(F.lit(None).cast("double").alias("reward"), reward.alias("score")))
    task = F.concat(F.lit("task-"), u % 40)
    result = F.struct(
        task.alias("task_name"), pick(CONFIGS, seg).alias("config_name"), stamp("first_ts").alias("started_at"), stamp("last_ts").alias("finished_at"),
        F.struct(pick(AGENTS, u).alias("name"), F.struct(pick(MODELS, u).alias("name")).alias("model_info")).alias("agent_info"),
        F.when(reward.isNotNull(), F.struct(given.alias("rewards"))).alias("verifier_result"),
        F.when((u + seg) % 58 == 0, "RateLimitError: rate limit reached").when((u + seg) % 29 == 0, "ValueError: crashed").alias("exception_info"),
    )
    path = F.concat(F.lit("runs/"), pick(CONFIGS, seg), F.lit("/"), pick(CONFIGS, seg), F.lit("_"), task, F.lit("__"), u, F.lit("-"), seg)
    steps = F.transform("steps", lambda x: F.struct(x["tool_calls"], x["event_id"].alias("step_id"), x["observation"]))
    # every other event names the keys of its nested argument the other way round: the same call to whoever reads it
    turned = F.regexp_replace(F.to_json(F.struct(steps.alias("steps"))), r'\{"first":1,"last":2\}(\}\}\}\],"step_id":\d*[13579],)', r'{"last":2,"first":1}$1')
    return t.select(path.alias("trial_path"), F.to_json(result).alias("result"), turned.alias("trajectory"))


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", documents)
    key = lambda p, i: F.regexp_extract(p, r"__(\d+)-(\d+)$", i).cast("long")
    out = extract(
        docs.select("trial_path", F.col("result").alias("raw")), docs.select("trial_path", F.col("trajectory").alias("raw")),
        resolve_benchmark=lambda p: F.concat(F.lit("bench-"), key(p, 1) % 7),
    )
    started = F.get_json_object("result", "$.started_at").alias("started_at")
    out = out.join(docs.select(F.col("trial_path").alias("p"), started), F.col("trial_path") == F.col("p")) if "started_at" not in SIGNAL_TYPES else out
    return out.select(key(F.col("trial_path"), 1).alias("u"), key(F.col("trial_path"), 2).alias("seg"), "started_at", "trial_path", *[c for c in SIGNAL_TYPES if c != "started_at"])


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate(sealed(signals(spark, sf_dir))).select("u", "seg", "trial_id", *DIMENSIONS, "categories", "annotation_result_status")


DIMENSIONS = ("agent_name", "model", "benchmark", "config_name", "trial_path", "passed", "reward", "has_trajectory")
_tables: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str, make: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """The table as make() gives it, written once for each session and, where the file system tells it, state of the events."""
    place = f"{sf_dir}/events.parquet"
    state = os.stat(place) if os.path.exists(place) else None
    key = (spark.sparkContext.applicationId, sf_dir, name, state and (state.st_mtime_ns, state.st_size))
    if key not in _tables:
        _tables[key] = written(make(spark, sf_dir), f"trials-{name}")
    return _tables[key]


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signals table of all trials, with the trial key (u, seg), started_at and trial_path."""
    return table(spark, sf_dir, "signals", _extracted)


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule engine's row for each trial: its key and dimensions, categories and status."""
    return table(spark, sf_dir, "annotated", _annotated)


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule engine's rows for all trials, with the trial key and the place among a trial's categories."""
    rows = annotated(spark, sf_dir).select("u", "seg", "trial_id", F.posexplode("categories").alias("ordinal", "c"))
    return rows.select("u", "seg", "trial_id", "ordinal", F.col("c.name").alias("category_name"), F.col("c.confidence").alias("confidence"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories with the dimensions of their trial."""
    rows = annotated(spark, sf_dir).select("u", "seg", "trial_id", *DIMENSIONS, F.explode("categories").alias("c"))
    return rows.withColumn("category_name", F.col("c.name")).withColumn("confidence", F.col("c.confidence")).drop("c")


def second_opinion(a: DataFrame) -> DataFrame:
    """A second annotator: the rules' rows but for every fifth by (u + seg + length of the name)."""
    return a.filter((F.col("u") + F.col("seg") + F.length("category_name")) % 5 != 0).withColumn("confidence", F.greatest(F.lit(0.0), F.col("confidence") - F.lit(0.125)))


_SQL_ARRAY = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"

#: The same tables in DuckDB SQL, as common table expressions.
SQL_SIGNALS = f"""
steps AS ({_STEPS.format(k="CAST(json_extract_string(props, '$.k') AS INTEGER)", div_day="(day(ts) - 1) // 7", u3="user_id // 3", events="events")}),
calls AS ({_CALLS}),
lagged AS (
  SELECT *, lag(tool) OVER w AS tool_before, lag(args) OVER w AS args_before
  FROM (SELECT *, concat(coalesce(path, ''), '|', CASE WHEN tool IN ('Edit', 'Write', 'NotebookEdit') THEN k ELSE 0 END) AS args FROM calls) WINDOW w AS (PARTITION BY u, seg ORDER BY ts, event_id)
), grouped AS (
  SELECT u, seg, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, count(*) FILTER (WHERE is_error) AS errors,
         count(*) FILTER (WHERE tool IN ('Grep', 'Glob', 'mcp__sourcegraph__keyword_search', 'mcp__sourcegraph__diff_search', 'mcp__sourcegraph__commit_search')) AS srch,
         count(*) FILTER (WHERE tool IN ('Edit', 'Write', 'NotebookEdit')) AS ed,
         count(*) FILTER (WHERE tool IN ('Read', 'mcp__sourcegraph__read_file', 'mcp__sourcegraph__go_to_definition', 'mcp__sourcegraph__find_references', 'mcp__sourcegraph__list_files', 'mcp__sourcegraph__compare_revisions')) AS nav,
         count(*) FILTER (WHERE tool IN ('mcp__sourcegraph__nls_search', 'mcp__sourcegraph__deepsearch', 'mcp__sourcegraph__deepsearch_read')) AS sem,
         coalesce(list_sort(list(DISTINCT path) FILTER (WHERE path IS NOT NULL AND tool IN ('Read', 'read_file', 'mcp__sourcegraph__read_file', 'mcp__sourcegraph__go_to_definition', 'mcp__sourcegraph__find_references', 'mcp__sourcegraph__list_files', 'mcp__sourcegraph__compare_revisions'))), []) AS files_read,
         coalesce(list_sort(list(DISTINCT path) FILTER (WHERE path IS NOT NULL AND tool IN ('Edit', 'Write', 'NotebookEdit', 'file_write'))), []) AS files_edited,
         count(*) FILTER (WHERE tool = tool_before AND args = args_before) AS retries,
         coalesce(sum(k) FILTER (WHERE tool IN ('Edit', 'Write', 'NotebookEdit')), 0) AS patch, list(tool ORDER BY ts, event_id) AS seq
  FROM lagged GROUP BY u, seg
), named AS (
  SELECT *, concat('task-', u % 40) AS task_id, {_SQL_ARRAY(MODELS)}[u % 4 + 1] AS model, {_SQL_ARRAY(AGENTS)}[u % 3 + 1] AS agent_name,
         {_SQL_ARRAY(CONFIGS)}[seg % 3 + 1] AS config_name, concat('bench-', u % 7) AS benchmark, strftime(first_ts, '%Y-%m-%dT%H:%M:%S') AS started_at,
         CASE (u // 3 + seg * 5) % 6 WHEN 0 THEN NULL WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN 0.0::DOUBLE WHEN 3 THEN 0.3::DOUBLE WHEN 4 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS reward
  FROM grouped
), signals AS (
  SELECT u, seg, started_at, concat('runs/', config_name, '/', config_name, '_', task_id, '__', u, '-', seg) AS trial_path,
         substr(sha256(concat_ws('||', task_id, config_name, started_at, model)), 1, 32) AS trial_id, sha256(concat_ws('||', task_id, config_name, started_at, model)) AS trial_id_full,
         task_id, model, agent_name, config_name, benchmark, reward, coalesce(reward > 0, false) AS passed, n AS total_turns, n AS tool_calls_total, n AS trajectory_length,
         srch AS search_tool_calls, ed AS edit_tool_calls, nav AS code_nav_tool_calls, sem AS semantic_search_tool_calls, len(files_read) AS unique_files_read,
         len(files_edited) AS unique_files_edited, files_read AS files_read_list, files_edited AS files_edited_list, errors AS error_count, retries AS retry_count,
         CAST(epoch(date_trunc('second', last_ts)) - epoch(date_trunc('second', first_ts)) AS DOUBLE) AS duration_seconds, (u + seg) % 58 = 0 AS rate_limited, (u + seg) % 29 = 0 AS exception_crashed,
         CAST(patch AS BIGINT) AS patch_size_lines, seq AS tool_call_sequence, true AS has_trajectory
  FROM named
)"""

# Short names for the rules in SQL.
_SHORT = """
short AS (
  SELECT u, seg, trial_id, reward AS r, passed, rate_limited AS lim, exception_crashed AS crash, tool_calls_total AS tot, search_tool_calls AS srch, code_nav_tool_calls AS nav,
         semantic_search_tool_calls AS sem, edit_tool_calls AS ed, unique_files_read AS fr, unique_files_edited AS fe, error_count AS err, retry_count AS rty, trajectory_length AS tl,
         total_turns AS turns, patch_size_lines AS patch, duration_seconds AS dur, tool_call_sequence AS seq, coalesce(reward >= 1, false) OR passed AS s, coalesce(reward < 1, false) AS lo, reward IS NULL OR reward < 1 AS lq,
         len(list_filter(tool_call_sequence, lambda t: t IN ('Bash', 'bash', 'RunTests', 'run_tests', 'test'))) AS v,
         len(list_filter(files_edited_list, lambda f: regexp_matches(lower(f), 'test_|_test\\.|tests/|test/|spec/|_spec\\.'))) AS tests, len(files_edited_list) AS edited,
         coalesce(list_max(list_transform(range(1, len(tool_call_sequence) + 1), lambda i: CASE WHEN tool_call_sequence[i] IN ('Edit', 'edit', 'Write', 'write', 'NotebookEdit') THEN i ELSE 0 END)), 0) AS last_edit,
         coalesce(list_max(list_transform(range(1, len(tool_call_sequence) + 1), lambda i: CASE WHEN tool_call_sequence[i] IN ('Bash', 'bash', 'RunTests', 'run_tests', 'test') THEN i ELSE 0 END)), 0) AS last_check,
         coalesce(list_min(list_transform(range(1, 4), lambda i: CASE WHEN tool_call_sequence[i] IN ('Edit', 'edit', 'Write', 'write', 'NotebookEdit') THEN i ELSE 9 END)), 9) AS first_edit,
         coalesce(list_min(list_transform(range(1, 4), lambda i: CASE WHEN tool_call_sequence[i] IN ('Read', 'read', 'Grep', 'grep', 'Glob', 'glob', 'Bash', 'bash', 'mcp__sourcegraph__keyword_search', 'mcp__sourcegraph__diff_search', 'mcp__sourcegraph__commit_search', 'mcp__sourcegraph__read_file', 'mcp__sourcegraph__go_to_definition', 'mcp__sourcegraph__find_references', 'mcp__sourcegraph__list_files', 'mcp__sourcegraph__compare_revisions') THEN i ELSE 9 END)), 9) AS first_look,
         len(list_filter(tool_call_sequence, lambda t: t IN ('mcp__sourcegraph__diff_search', 'mcp__sourcegraph__commit_search', 'mcp__sourcegraph__compare_revisions'))) AS hist, len(list_filter(tool_call_sequence, lambda t: t = 'Bash')) AS bash
  FROM signals
)"""
_SQL_RULES = [
    ("rate_limited_run", "lim", "0.9"), ("exception_crash", "crash", "0.9"),
    ("task_ambiguity", "r = 0 AND NOT crash AND NOT lim AND tot < 5 AND dur < 60 AND ed = 0", "0.4"),
    ("retrieval_failure", "r <= 0 AND NOT passed AND srch <= 1 AND fr <= 1", "CASE WHEN srch = 0 AND fr = 0 THEN 0.9 ELSE 0.7 END"),
    ("query_churn", "lo AND srch > 5 AND fr < srch // 2", "least(0.9, 0.5 + 0.05 * (srch - 5))"),
    ("wrong_tool_choice", "lo AND srch > 5 AND nav = 0 AND fr > 3", "0.6"), ("missing_code_navigation", "lo AND nav = 0 AND fr >= 5 AND fe >= 2", "0.6"),
    ("decomposition_failure", "r = 0 AND fe >= 2 AND tot > 10", "0.5"),
    ("edit_verify_loop_failure", "lo AND ed > 3 AND (rty > 3 OR err > 3)", "CASE WHEN rty > 3 THEN least(0.9, 0.5 + 0.05 * rty) ELSE least(0.8, 0.4 + 0.05 * err) END"),
    ("stale_context", "lo AND tl > 50 AND fe > 0 AND fr > 5 AND tot > 40", "0.4"), ("multi_repo_scope_failure", "r <= 0 AND fe <= 1 AND fr <= 3 AND tot > 10", "0.4"),
    ("local_remote_mismatch", "r <= 0 AND err > 5 AND ed <= 1 AND tot > 5", "0.5"), ("verifier_mismatch", "r <= 0 AND ed > 0 AND patch > 0", "0.3"),
    ("over_exploration", "r <= 0 AND tot > 80 AND ed <= 3", "least(0.9, 0.5 + 0.005 * (tot - 80))"),
    ("tool_argument_error", "lq AND tot > 0 AND err >= 3 AND err / tot >= 0.3", "least(0.9, 0.4 + err / tot)"), ("premature_termination", "lq AND turns < 3", "CASE WHEN turns <= 1 THEN 0.8 ELSE 0.6 END"),
    ("verification_skipped", "lq AND ed > 0 AND v = 0", "0.7"), ("verification_skip", "lq AND ed >= 2 AND v = 1", "0.5"),
    ("premature_commit", "lq AND ed > 0 AND last_edit > 0 AND last_check < last_edit", "0.6"), ("planning_absence", "lq AND len(seq) >= 3 AND first_edit < 9 AND first_edit < first_look", "0.6"),
    ("tool_underutilization", "lq AND fr >= 8 AND nav = 0 AND sem = 0 AND srch <= 2", "0.5"), ("reward_hacking", "r > 0 AND tests >= 3 AND tests > edited * 2 // 3", "0.4"),
    ("incomplete_solution", "r > 0 AND r < 1", "0.8"), ("near_miss", "r >= 0.5 AND r < 1", "0.7 + 0.4 * (r - 0.5)"), ("minimal_progress", "r > 0 AND r < 0.5", "0.7"),
    ("success_via_code_nav", "s AND nav > 0", "least(0.9, 0.5 + 0.05 * nav)"), ("success_via_semantic_search", "s AND sem > 0", "least(0.9, 0.6 + 0.1 * sem)"),
    ("success_via_local_exec", "s AND bash > 0 AND ed > 0", "0.7"), ("success_via_commit_context", "s AND hist > 0", "least(0.8, 0.5 + 0.1 * hist)"),
    ("success_via_decomposition", "s AND fe >= 3", "least(0.8, 0.4 + 0.1 * fe)"), ("clean_success", "s AND tot <= 20 AND err <= 1 AND rty <= 1", "least(0.9, 0.7 + 0.01 * (20 - tot))"),
    ("insufficient_provenance", "r > 0 AND tot <= 5 AND srch = 0 AND nav = 0", "0.6"),
]
SQL_ANNOTATIONS = (
    SQL_SIGNALS + "," + _SHORT + ", annotations AS MATERIALIZED (\n  "
    + "\n  UNION ALL ".join(f"SELECT u, seg, trial_id, '{c}' AS category_name, CAST({conf} AS DOUBLE) AS confidence FROM short WHERE {when}" for c, when, conf in _SQL_RULES)
    + "\n), second AS MATERIALIZED (SELECT u, seg, trial_id, category_name, greatest(0.0, confidence - 0.125::DOUBLE) AS confidence FROM annotations WHERE (u + seg + length(category_name)) % 5 <> 0)"
)
__all__ = ["SQL_ANNOTATIONS", "SQL_SIGNALS", "annotated", "annotations", "calls", "documents", "labels", "narrow", "second_opinion", "signals"]
