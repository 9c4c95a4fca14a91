"""Scalar functions as Column expressions, all on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Directories that are never read, tokens of run names, and what their parts stand for.
EXCLUDED_DIRS = ("__archived_invalid", "__incomplete", "__pre_sgenv_fix", "__verifier_path_bug", "__doubled_prefix")
MODEL_TOKENS = ("haiku", "haiku4", "haiku45", "haiku46", "sonnet", "sonnet4", "sonnet45", "sonnet46", "opus", "opus4", "opus45", "opus46", "cc", "oh", "claude", "claude46", "gpt", "gpt4", "gpt5", "cursor")
FAMILY_PREFIXES = ("csb", "ccb")
DIRECTORY_BENCHMARKS = {"crossrepo": "crossrepo", "openhands": "openhands", "swe-bench": "swe-bench", "swe_bench": "swe-bench"}
MODEL_KEYWORDS = {"opus": "anthropic/claude-opus-4-5", "sonnet": "anthropic/claude-sonnet-4-6", "haiku": "anthropic/claude-haiku-4-5"}
CONFIG_PREFIXES = ("baseline_", "bl_", "mcp_", "sgonly_")


def sealed(df):
    """The same rows behind a generator, which the optimizer does not merge projections across.

    Large expressions that many later ones use are then computed once, instead of being copied into each use.
    """
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("row")).select("row.*")


def text(c) -> Column:
    """A missing string as the empty string."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def trial_id_full(task: Column, config: Column, started: Column, model: Column) -> Column:
    return F.sha2(F.concat_ws("||", text(task), text(config), text(started), text(model)), 256)


def trial_id(task: Column, config: Column, started: Column, model: Column) -> Column:
    return F.substring(trial_id_full(task, config, started, model), 1, 32)


def duration_seconds(started: Column, finished: Column) -> Column:
    """Seconds between two ISO-8601 stamps; NULL if either cannot be read."""
    at = lambda c: F.unix_micros(F.try_to_timestamp(c))
    return (at(finished) - at(started)) / F.lit(1e6)


def is_excluded(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in EXCLUDED_DIRS]))


def parse_run_name(name: Column) -> Column:
    """The benchmark in a run directory's name: what stands before the first model or date token; NULL without one."""
    base = F.split(F.regexp_replace(name, "^_+", ""), "__")[0]
    parts = F.split(base, "_")
    parts = F.when(F.lower(parts[0]).isin(*FAMILY_PREFIXES), F.slice(parts, 2, F.size(parts))).otherwise(parts)
    low = F.transform(parts, F.lower)
    marks = F.transform(low, lambda p: p.isin(*MODEL_TOKENS) | p.rlike(r"^[0-9]{4,}$"))
    first = F.array_position(marks, True)
    return F.when(base.contains("_") & (first > 1), F.array_join(F.slice(low, F.lit(1), (first - 1).cast("int")), "_"))


def directory_benchmark(path: Column) -> Column:
    """The first path component, from the outside in, that parses as a run name; else a known part of the last four."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    parsed = F.filter(F.transform(parts, parse_run_name), lambda p: p.isNotNull())
    last = F.transform(F.slice(parts, F.greatest(F.size(parts) - 3, F.lit(1)), F.lit(4)), F.lower)
    known = F.filter(F.transform(last, _known_part), lambda p: p.isNotNull())
    return F.coalesce(F.get(parsed, F.lit(0)), F.get(known, F.lit(0)))


def _known_part(p: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in reversed(DIRECTORY_BENCHMARKS.items()):
        out = F.when(p.contains(k), F.lit(v)).otherwise(out)
    return out


def keyword_model(path: Column, keywords: dict[str, str] = MODEL_KEYWORDS) -> Column:
    """A model by a keyword among the _-separated pieces of the directory's name or of the last four path parts."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    looked_at = F.concat(F.slice(parts, F.lit(-1), F.lit(1)), F.slice(parts, F.greatest(F.size(parts) - 3, F.lit(1)), F.lit(4)))

    def one(p: Column) -> Column:
        out = F.lit(None).cast("string")
        for k, v in reversed(keywords.items()):
            out = F.when(F.array_contains(F.split(F.lower(p), "_"), k), F.lit(v)).otherwise(out)
        return out

    return F.get(F.filter(F.transform(looked_at, one), lambda p: p.isNotNull()), F.lit(0))


def core_task_name(path: Column) -> Column:
    """The task under a trial's path, whatever its configuration: base name without the last __ part and without a prefix."""
    base = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    return F.lower(F.regexp_replace(F.regexp_replace(base, "^(.*)__.*$", "$1"), f"^({'|'.join(CONFIG_PREFIXES)})", ""))


def kappa(n11: Column, n10: Column, n01: Column, n00: Column, undefined_as: float | None = None) -> Column:
    """Cohen's kappa of a 2 x 2 table; undefined_as where chance agreement is complete or the table is empty."""
    n = (n11 + n10 + n01 + n00).cast("double")
    po = (n11 + n00) / n
    pe = ((n11 + n10) * (n11 + n01) + (n01 + n00) * (n10 + n00)) / (n * n)
    return F.when((n > 0) & (pe < 1), (po - pe) / (1 - pe)).otherwise(F.lit(undefined_as).cast("double"))


def phi(n: Column, n1: Column, n2: Column, n11: Column) -> Column:
    """The phi coefficient of two events by their counts; 0 where undefined."""
    d = n1.cast("double") * n2 * (n - n1) * (n - n2)
    return F.when(d > 0, (n11.cast("double") * n - n1.cast("double") * n2) / F.sqrt(d)).otherwise(F.lit(0.0))


def calibration_bin(confidence: Column, bins: int) -> Column:
    """Equal-width bin, 0-based; confidence 1 falls in the last."""
    return F.least(F.floor(confidence * bins).cast("int"), F.lit(bins - 1))


def sigmoid(z: Column) -> Column:
    """One form for either sign, as in training: exp(z) / (1 + exp(z)) lies just below 0.5 for a z that only rounding puts below 0. An exp that overflows gives 0."""
    return 1 / (1 + F.exp(-z))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0."""
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def count_in(sequence: Column, tools) -> Column:
    return F.size(F.filter(sequence, lambda t: t.isin(*tools))) if tools else F.lit(0)


SQL_FUNCTIONS = {
    "trial_id(task STRING, config STRING, started STRING, model STRING) RETURNS STRING": "substring(sha2(concat_ws('||', coalesce(task, ''), coalesce(config, ''), coalesce(started, ''), coalesce(model, '')), 256), 1, 32)",
    "kappa(n11 BIGINT, n10 BIGINT, n01 BIGINT, n00 BIGINT) RETURNS DOUBLE": "try_divide((n11 + n00) * (n11 + n10 + n01 + n00) - ((n11 + n10) * (n11 + n01) + (n01 + n00) * (n10 + n00)), double((n11 + n10 + n01 + n00) * (n11 + n10 + n01 + n00) - ((n11 + n10) * (n11 + n01) + (n01 + n00) * (n10 + n00))))",
    "phi(n BIGINT, n1 BIGINT, n2 BIGINT, n11 BIGINT) RETURNS DOUBLE": "coalesce(try_divide(double(n11) * n - double(n1) * n2, sqrt(double(n1) * n2 * (n - n1) * (n - n2))), 0D)",
    "ece_bin(conf DOUBLE, n INT) RETURNS INT": "least(int(floor(conf * n)), n - 1)",
    "core_task_name(path STRING) RETURNS STRING": f"lower(regexp_replace(regexp_replace(element_at(split(regexp_replace(path, '/+$', ''), '/'), -1), '^(.*)__.*$', '$1'), '^({'|'.join(CONFIG_PREFIXES)})', ''))",
}


def register_sql_functions(spark: SparkSession) -> None:
    """The engine's functions for SQL, as temporary SQL functions that the optimizer inlines."""
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
