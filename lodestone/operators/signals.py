"""Signals: one typed row for each trial, from its result and trajectory documents.

A trajectory is one row, so everything about it is computed by array functions inside that row: no call is exploded and nothing
is shuffled but the join of results with trajectories.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import registry as R
from ..functions import columns as C
from ..schemas import REDACTED, SIGNAL_TYPES

STEPS = "struct<steps: array<struct<tool_calls: array<struct<function_name: string, arguments: string>>, observation: string>>>"
#: What makes a step an error, in the lower-cased text of its observation.
ERROR_WORDS = "error|fail|exception|traceback"


def canonical_arguments(arguments: Column) -> Column:
    """Arguments with the keys of objects in order at every depth, as a variant keeps them; text that is no object, or names a key twice, stays as it is."""
    is_object = F.trim(arguments).startswith("{") & F.trim(arguments).endswith("}")
    return F.coalesce(F.when(is_object, F.to_json(F.try_parse_json(arguments))), arguments, F.lit(""))


def argument_path(arguments: Column) -> Column:
    pick = lambda key: F.nullif(F.get_json_object(arguments, f"$.{key}"), F.lit(""))
    return F.coalesce(pick("file_path"), pick("path"))


def written_lines(arguments: Column) -> Column:
    """Lines of the texts that an editing call carries."""
    total = F.lit(0)
    for key in ("new_string", "content", "new_content"):
        v = F.get_json_object(arguments, f"$.{key}")
        total = total + F.when(F.length(v) > 0, F.length(v) - F.length(F.replace(v, F.lit("\n"), F.lit(""))) + 1).otherwise(0)
    return total


def step_text(observation: Column) -> Column:
    """The contents of all results, joined; or the observation itself where it is text."""
    results = F.from_json(observation, "struct<results: array<struct<content: string>>>")
    joined = F.array_join(F.transform(results["results"], lambda r: F.coalesce(r["content"], F.lit(""))), "")
    return F.coalesce(F.when(F.trim(observation).startswith("{"), F.coalesce(joined, F.lit(""))), observation, F.lit(""))


def parse_trajectory(raw: Column) -> Column:
    """struct(turns, errors, calls): calls are (tool, path, args, lines) in order of step and call."""
    steps = F.coalesce(F.from_json(raw, STEPS)["steps"], F.array())
    call = lambda c: F.struct(F.coalesce(c["function_name"], F.lit("")).alias("tool"), argument_path(c["arguments"]).alias("path"), canonical_arguments(c["arguments"]).alias("args"), written_lines(c["arguments"]).alias("lines"))
    calls = F.transform(F.flatten(F.transform(steps, lambda s: F.coalesce(s["tool_calls"], F.array()))), call)
    errors = F.size(F.filter(steps, lambda s: F.lower(step_text(s["observation"])).rlike(ERROR_WORDS)))
    return F.struct(F.size(steps).alias("turns"), errors.alias("errors"), calls.alias("calls"))


def call_signals(calls: Column, agent: Column, tools: R.ToolNames | None = None) -> dict[str, Column]:
    """The signals that calls give, with the given tools, else those of the agent's family."""
    none = F.array().cast("array<string>")
    seq = F.transform(calls, lambda c: c["tool"])
    paths = lambda use: F.array_sort(F.array_distinct(F.transform(F.filter(calls, lambda c: c["tool"].isin(*use) & c["path"].isNotNull()), lambda c: c["path"])))
    read, edited = R.by_agent(agent, lambda r: paths(r.reading), tools), R.by_agent(agent, lambda r: paths(r.editing), tools)
    n = F.size(calls)
    same = lambda i: (F.get(calls, i)["tool"] == F.get(calls, i - 1)["tool"]) & (F.get(calls, i)["args"] == F.get(calls, i - 1)["args"])
    retries = F.when(n > 1, F.size(F.filter(F.sequence(F.lit(1), n - 1), same))).otherwise(0)
    lines = R.by_agent(agent, lambda r: F.aggregate(F.filter(calls, lambda c: c["tool"].isin(*r.edit)), F.lit(0).cast("long"), lambda s, c: s + c["lines"]), tools)
    count = lambda kind: R.by_agent(agent, lambda r: C.count_in(seq, getattr(r, kind)), tools)
    return {
        "tool_calls_total": n, "trajectory_length": n, "tool_call_sequence": F.coalesce(seq, none), "search_tool_calls": count("search"), "edit_tool_calls": count("edit"),
        "code_nav_tool_calls": count("navigate"), "semantic_search_tool_calls": count("semantic"), "files_read_list": F.coalesce(read, none), "files_edited_list": F.coalesce(edited, none),
        "unique_files_read": F.size(F.coalesce(read, none)), "unique_files_edited": F.size(F.coalesce(edited, none)), "retry_count": retries, "patch_size_lines": lines,
    }


def result_signals(raw: Column, path: Column, *, normalize_task: Callable[[Column], Column] | None = None, keywords: dict[str, str] | None = None) -> dict[str, Column]:
    """The signals that a result document and its place give."""
    get = lambda p: F.get_json_object(raw, f"$.{p}")
    reward = F.coalesce(get("verifier_result.rewards.reward").try_cast("double"), get("verifier_result.rewards.score").try_cast("double"))
    task = F.coalesce(F.nullif(get("task_name"), F.lit("")), get("task_id"))
    error = get("exception_info")
    crashed = F.coalesce((F.trim(error) != "") & (F.trim(error) != "{}") & (F.trim(error) != "null"), F.lit(False))
    model = F.coalesce(F.nullif(get("agent_info.model_info.name"), F.lit("")), F.nullif(get("agent_result.model"), F.lit("")), C.keyword_model(path, keywords) if keywords else F.lit(None).cast("string"))
    return {
        "task_id": C.text(normalize_task(task) if normalize_task else task), "model": C.text(model), "agent_name": C.text(get("agent_info.name")),
        "config_name": C.text(F.coalesce(F.nullif(get("config_name"), F.lit("")), get("config.name"))), "started_at": C.text(get("started_at")),
        "reward": reward, "passed": F.coalesce(reward > 0, F.lit(False)), "has_verifier_result": get("verifier_result").isNotNull(),
        "duration_seconds": F.coalesce(C.duration_seconds(get("started_at"), get("finished_at")), F.lit(0.0)),
        "exception_crashed": crashed, "rate_limited": crashed & F.lower(error).rlike("rate[_ ]limit"),
    }


def is_trial(raw: Column) -> Column:
    """A result document of a trial has the key agent_info, whatever its value."""
    return F.coalesce(F.array_contains(F.json_object_keys(raw), "agent_info"), F.lit(False))


def extract(
    results: DataFrame,
    trajectories: DataFrame,
    *,
    suites: DataFrame | None = None,
    resolve_benchmark: Callable[[Column], Column] | None = None,
    normalize_task: Callable[[Column], Column] | None = None,
    keywords: dict[str, str] | None = C.MODEL_KEYWORDS,
    tools: R.ToolNames | None = None,
) -> DataFrame:
    """results (trial_path, raw) and trajectories (trial_path, raw) to the signals table with trial_path.

    resolve_benchmark is asked first, then the suite mapping (key, benchmark) by task id and directory, then the directory's name.
    Given tools take the place of those of each agent's family.
    """
    from ..sources.suites import resolve

    valid = results.filter(is_trial(F.col("raw")) & ~C.is_excluded(F.col("trial_path")))
    named = valid.select("trial_path", *[v.alias(k) for k, v in result_signals(F.col("raw"), F.col("trial_path"), normalize_task=normalize_task, keywords=keywords).items()])
    t = trajectories.select(F.col("trial_path").alias("t_path"), parse_trajectory(F.col("raw")).alias("t"), F.lit(True).alias("there"))
    joined = named.join(t, F.col("trial_path") == F.col("t_path"), "left").drop("t_path")
    if suites is not None:
        joined = resolve(joined, suites)
    else:
        joined = joined.withColumn("suite", F.lit(None).cast("string"))
    given = resolve_benchmark(F.col("trial_path")) if resolve_benchmark else F.lit(None).cast("string")
    by_suite, by_dir = F.coalesce(F.nullif(given, F.lit("")), F.col("suite")), C.directory_benchmark(F.col("trial_path"))
    full = C.trial_id_full(F.col("task_id"), F.col("config_name"), F.col("started_at"), F.col("model"))
    calls = F.coalesce(F.col("t.calls"), F.array())
    more = {
        "trial_id": F.substring(full, 1, 32), "trial_id_full": full, "benchmark": C.text(F.coalesce(by_suite, by_dir)),
        "benchmark_source": F.when(by_suite.isNotNull(), "manifest").when(by_dir.isNotNull(), "directory").otherwise(""),
        "total_turns": F.coalesce(F.col("t.turns"), F.lit(0)), "error_count": F.coalesce(F.col("t.errors"), F.lit(0)), "has_result_json": F.lit(True),
        "has_trajectory": F.coalesce("there", F.lit(False)), **call_signals(calls, F.col("agent_name"), tools),
    }
    return C.sealed(joined.select(*[more.get(k, F.col(k)).cast(t).alias(k) for k, t in SIGNAL_TYPES.items()], "trial_path"))


def judge_safe(signals: DataFrame) -> DataFrame:
    """Without what would give the outcome away."""
    return signals.drop(*REDACTED)


def latest_attempts(signals: DataFrame, by: str = "started_at") -> DataFrame:
    """The last attempt of each task under each configuration."""
    from pyspark.sql import Window as W

    w = W.partitionBy("task_id", "config_name").orderBy(F.col(by).desc_nulls_last(), F.col("trial_id"))
    return signals.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def normalize_lists(df: DataFrame, columns=("files_read_list", "files_edited_list", "tool_call_sequence")) -> DataFrame:
    """List columns as lists: a missing one as empty, JSON text parsed, text that does not parse as empty."""
    types = dict(df.dtypes)
    for c in columns:
        if c in types:
            parsed = F.from_json(c, "array<string>") if types[c] == "string" else F.col(c)
            df = df.withColumn(c, F.coalesce(parsed, F.array().cast("array<string>")))
    return df
