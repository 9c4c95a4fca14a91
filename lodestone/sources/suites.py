"""Suite mappings: which benchmark a task belongs to, by exact id or by the longest token-bounded prefix."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_mapping(document: object) -> dict[str, str]:
    """key -> benchmark of a mapping file: nested run histories (the first benchmark of a task wins), else a flat mapping."""
    top = document if isinstance(document, dict) else {}
    nested = top.get("run_history") or {}
    pairs = [(task, short_name(bench)) for bench, tasks in (nested.items() if isinstance(nested, dict) else []) for task in (tasks if isinstance(tasks, dict) else [])]
    flat = [(k, v) for k, v in top.items() if isinstance(v, str)]
    return dict(reversed(pairs or flat))  # of a key given twice the first stays


def short_name(bench: str) -> str:
    """A benchmark's name without its run and without the prefix of its family."""
    return re.sub(r"(?i)^c[cs]b_", "", bench.partition("/")[0])


def load_mapping(path: str) -> dict[str, str]:
    try:
        with open(path, encoding="utf-8") as f:
            return parse_mapping(json.load(f))
    except (OSError, ValueError):
        return {}


def table(spark: SparkSession, mapping: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(mapping.items()), "key string, suite string")


def resolve(trials: DataFrame, suites: DataFrame, task: str = "task_id", path: str = "trial_path") -> DataFrame:
    """trials with the column suite: exact task id, else the longest prefix of it that ends at a token, else of the directory's name.

    A task has at most as many prefixes as characters, so prefixes are generated and equi-joined: no pair of a task and a mapping
    entry is looked at that cannot match, and neither side need fit in memory.
    """
    name = F.element_at(F.split(F.coalesce(F.col(path), F.lit("")), "/"), -1)
    t = F.coalesce(F.col(task), F.lit(""))
    prefixes = lambda s, kind: F.transform(F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.substring(s, 1, i).alias("key"), F.lit(kind).alias("kind"), (i == F.length(s)).alias("whole"), F.substring(s, i + 1, F.lit(1)).alias("next")))
    trials = trials.withColumn("_task", t).withColumn("_name", name)
    both = F.concat(prefixes(F.col("_task"), 1), prefixes(F.col("_name"), 0))
    keys = trials.select("_task", "_name").distinct().select("_task", "_name", F.explode(both).alias("x")).select("_task", "_name", "x.*")
    ends = F.col("whole") | F.col("next").isin("_", "-") | F.col("key").rlike("[_-]$")
    best = keys.filter((F.col("kind") == 0) | ends).join(suites, "key").groupBy("_task", "_name").agg(F.max_by("suite", F.struct("kind", F.length("key"))).alias("suite"))
    return trials.join(best, ["_task", "_name"], "left").drop("_task", "_name")
