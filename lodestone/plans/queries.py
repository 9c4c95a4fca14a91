"""Registered queries, each with the SQL that checks it, over the trials that the adapter makes and over the other tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import report, sampling, stats, textops
from ..operators.signals import latest_attempts
from . import adapter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
S, A = "WITH " + adapter.SQL_SIGNALS, "WITH " + adapter.SQL_ANNOTATIONS


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_DIMENSIONS = adapter.DIMENSIONS


_LABELS = A + f", labels AS (SELECT s.u, s.seg, s.trial_id, {', '.join('s.' + c for c in _DIMENSIONS)}, a.category_name, a.confidence FROM annotations a JOIN signals s ON a.u = s.u AND a.seg = s.seg)"


def _pass_rate():
    """Percent, with one place."""
    return F.round(F.avg(F.when(F.col("passed"), 1.0).otherwise(0.0)) * 100, 1).alias("pass_rate")


# Outcome queries ------------------------------------------------------------------------------------------------------------------


@query(S + " SELECT model, count(*) AS trials, CAST(count(*) FILTER (WHERE passed) AS BIGINT) AS passed, round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END) * 100, 1) AS pass_rate FROM signals GROUP BY model")
def per_model_outcomes(spark, d):
    return adapter.signals(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("trials"), F.count_if("passed").alias("passed"), _pass_rate())


@query(S + " SELECT benchmark, model, count(*) AS trials, round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END) * 100, 1) AS pass_rate FROM signals GROUP BY ALL")
def benchmark_model_matrix(spark, d):
    return adapter.signals(spark, d).groupBy("benchmark", "model").agg(F.count(F.lit(1)).alias("trials"), _pass_rate())


@query(A + " SELECT a.category_name AS cat_a, b.category_name AS cat_b, count(*) AS co_occurrences FROM annotations a JOIN annotations b ON a.u = b.u AND a.seg = b.seg AND a.category_name < b.category_name GROUP BY ALL")
def annotation_cooccurrence(spark, d):
    return report.cooccurrence_of(_kinds(spark, d))


def _kinds(spark, d) -> DataFrame:
    """The rules' rows hold a trial's categories together: no label is shuffled."""
    return report.kinds(adapter.annotated(spark, d).select(F.transform("categories", lambda c: c["name"]).alias("c")))


@query(S + " SELECT tool_name, count(*) AS usage_count FROM (SELECT unnest(tool_call_sequence) AS tool_name FROM signals) GROUP BY tool_name ORDER BY usage_count DESC, tool_name LIMIT 20")
def tool_sequence_patterns(spark, d):
    tools = adapter.signals(spark, d).select(F.explode("tool_call_sequence").alias("tool_name"))
    return tools.groupBy("tool_name").agg(F.count(F.lit(1)).alias("usage_count")).orderBy(F.desc("usage_count"), "tool_name").limit(20)


@query(S + " SELECT trial_id, task_id, model, reward, passed, total_turns, tool_calls_total, duration_seconds FROM signals WHERE NOT passed ORDER BY task_id")
def eval_subset_export(spark, d):
    s = adapter.signals(spark, d).filter("not passed")
    return s.select("trial_id", "task_id", "model", "reward", "passed", "total_turns", "tool_calls_total", "duration_seconds").orderBy("task_id", "trial_id")


# Extraction -----------------------------------------------------------------------------------------------------------------------

_COUNTS = ("total_turns", "tool_calls_total", "search_tool_calls", "edit_tool_calls", "code_nav_tool_calls", "semantic_search_tool_calls", "unique_files_read", "unique_files_edited", "trajectory_length", "patch_size_lines")


@query(S + f" SELECT u, seg, {', '.join(_COUNTS)} FROM signals")
def signals_core_counts(spark, d):
    return adapter.signals(spark, d).select("u", "seg", *_COUNTS)


@query(S + " SELECT u, seg, array_to_string(files_read_list, '|') AS files_read, array_to_string(files_edited_list, '|') AS files_edited FROM signals")
def signals_file_lists(spark, d):
    return adapter.signals(spark, d).select("u", "seg", F.array_join("files_read_list", "|").alias("files_read"), F.array_join("files_edited_list", "|").alias("files_edited"))


@query(S + " SELECT u, seg, retry_count FROM signals")
def signals_retry_count(spark, d):
    return adapter.signals(spark, d).select("u", "seg", "retry_count")


@query(S + " SELECT u, seg, error_count FROM signals")
def signals_error_count(spark, d):
    return adapter.signals(spark, d).select("u", "seg", "error_count")


@query(S + " SELECT u, seg, array_to_string(tool_call_sequence, '>') AS tools FROM signals")
def signals_tool_sequence(spark, d):
    return adapter.signals(spark, d).select("u", "seg", F.array_join("tool_call_sequence", ">").alias("tools"))


@query(S + " SELECT u, seg, trial_id, trial_id_full FROM signals")
def trial_identity(spark, d):
    return adapter.signals(spark, d).select("u", "seg", "trial_id", "trial_id_full")


@query(S + " SELECT u, seg, reward, passed, rate_limited, exception_crashed FROM signals")
def reward_projection(spark, d):
    return adapter.signals(spark, d).select("u", "seg", "reward", "passed", "rate_limited", "exception_crashed")


@query(S + " SELECT u, seg, started_at, duration_seconds FROM signals")
def duration_projection(spark, d):
    return adapter.signals(spark, d).select("u", "seg", "started_at", "duration_seconds")


@query(S + " SELECT model, count(*) AS trials, count(DISTINCT trial_id) AS ids, count(DISTINCT task_id) AS tasks FROM signals GROUP BY model")
def identity_collisions(spark, d):
    return adapter.signals(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("trials"), F.countDistinct("trial_id").alias("ids"), F.countDistinct("task_id").alias("tasks"))


# Resolution -----------------------------------------------------------------------------------------------------------------------

_SUITES = {"task-1": "suite-one", "task-12": "suite-twelve", "task": "suite-any", "task-3-": "suite-three", "task-2": "suite-two"}
_SUITES_SQL = ", ".join(f"('{k}', '{v}')" for k, v in _SUITES.items())


@query(S + f""", m(key, suite) AS (VALUES {_SUITES_SQL}), t AS (SELECT DISTINCT task_id FROM signals)
SELECT t.task_id, max_by(m.suite, length(m.key)) AS suite FROM t LEFT JOIN m
ON t.task_id = m.key OR (starts_with(t.task_id, m.key) AND (substr(t.task_id, length(m.key) + 1, 1) IN ('_', '-') OR right(m.key, 1) IN ('_', '-'))) GROUP BY t.task_id""")
def benchmark_prefix_join(spark, d):
    from ..sources.suites import resolve, table

    t = adapter.signals(spark, d).select("task_id").distinct().withColumn("trial_path", F.lit(None).cast("string"))
    return resolve(t, table(spark, _SUITES)).select("task_id", "suite")


_RUN = "concat(CASE WHEN u % 2 = 0 THEN 'csb_' ELSE '' END, benchmark, '_fix_', CASE WHEN u % 3 = 0 THEN 'haiku45' WHEN u % 3 = 1 THEN 'plain' ELSE '20260301' END, '_x')"


@query(S + f""", r AS (SELECT u, seg, {_RUN} AS run FROM signals)
SELECT u, seg, CASE WHEN u % 3 = 1 THEN NULL ELSE regexp_extract(run, '^(?:csb_)?(.*)_(?:haiku45|20260301)_x$', 1) END AS parsed FROM r""")
def run_name_parse(spark, d):
    return adapter.signals(spark, d).select("u", "seg", C.parse_run_name(F.expr(_RUN)).alias("parsed"))


@query(S + " SELECT u, seg, lower(regexp_replace(regexp_replace(regexp_extract(trial_path, '[^/]*$'), '^(.*)__.*$', '\\1'), '^(baseline_|bl_|mcp_|sgonly_)', '')) AS task FROM signals")
def core_task_name(spark, d):
    return adapter.signals(spark, d).select("u", "seg", C.core_task_name(F.col("trial_path")).alias("task"))


@query(S + " SELECT agent_name, count(*) AS trials, CAST(sum(search_tool_calls) AS BIGINT) AS default_searches, CAST(sum(len(list_filter(tool_call_sequence, lambda t: t = CASE WHEN agent_name = 'beta' THEN 'Bash' ELSE 'Grep' END))) AS BIGINT) AS family_searches FROM signals GROUP BY agent_name")
def registry_selection(spark, d):
    s = adapter.signals(spark, d)
    family = F.when(F.col("agent_name") == "beta", C.count_in(F.col("tool_call_sequence"), ("Bash",))).otherwise(C.count_in(F.col("tool_call_sequence"), ("Grep",)))
    return s.groupBy("agent_name").agg(F.count(F.lit(1)).alias("trials"), F.sum("search_tool_calls").alias("default_searches"), F.sum(family).cast("long").alias("family_searches"))


# Rules ----------------------------------------------------------------------------------------------------------------------------


@query(A + " SELECT u, seg, category_name, round(confidence, 9) AS confidence FROM annotations")
def rules_all(spark, d):
    return adapter.annotations(spark, d).select("u", "seg", "category_name", F.round("confidence", 9).alias("confidence"))


@query(A + " SELECT s.u, s.seg, CASE WHEN count(a.category_name) > 0 THEN 'ok' ELSE 'no_categories' END AS status, count(a.category_name) AS n FROM signals s LEFT JOIN annotations a ON s.u = a.u AND s.seg = a.seg GROUP BY s.u, s.seg")
def rule_status(spark, d):
    return adapter.annotated(spark, d).select("u", "seg", F.col("annotation_result_status").alias("status"), F.size("categories").cast("long").alias("n"))


@query(A + ", t AS (SELECT CASE WHEN count(a.category_name) > 0 THEN 'ok' ELSE 'no_categories' END AS s FROM signals x LEFT JOIN annotations a ON x.u = a.u AND x.seg = a.seg GROUP BY x.u, x.seg) SELECT count(*) FILTER (WHERE s = 'ok') AS ok, count(*) FILTER (WHERE s = 'no_categories') AS no_categories, 0::BIGINT AS error, count(*) AS total FROM t")
def status_counts(spark, d):
    return stats.status_counts(adapter.annotated(spark, d))


# Report aggregates ----------------------------------------------------------------------------------------------------------------

_MEASURES = "count(*) AS n, count(*) FILTER (WHERE passed) AS passed, round(count(*) FILTER (WHERE passed)::DOUBLE / count(*), 4) AS pass_rate, round(avg(reward), 4) AS mean_reward, round(avg(trajectory_length), 2) AS mean_trajectory_length, round(avg(total_turns), 2) AS mean_turns"


@query(S + f" SELECT benchmark, {_MEASURES} FROM signals GROUP BY benchmark")
def slice_by_benchmark(spark, d):
    return report.slices(report.trials_frame(adapter.signals(spark, d)), "benchmark")


@query(S + f" SELECT agent_name, model, {_MEASURES}, concat(agent_name, ' / ', model) AS label FROM signals GROUP BY agent_name, model")
def slice_by_agent_model(spark, d):
    return report.agent_models(report.trials_frame(adapter.signals(spark, d)))


@query(S + f" SELECT agent_name, benchmark, {_MEASURES}, count(*) < 3 AS low_confidence FROM signals GROUP BY agent_name, benchmark")
def agent_benchmark_matrix(spark, d):
    return report.agent_benchmarks(report.trials_frame(adapter.signals(spark, d)))


@query(S + """, m AS (SELECT agent_name, benchmark, round(count(*) FILTER (WHERE passed)::DOUBLE / count(*), 4) AS r FROM signals GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY benchmark ORDER BY r DESC, agent_name) AS hi, row_number() OVER (PARTITION BY benchmark ORDER BY r, agent_name DESC) AS lo, count(*) OVER (PARTITION BY benchmark) AS k FROM m)
SELECT h.benchmark, h.agent_name AS high_agent, h.r AS high_rate, l.agent_name AS low_agent, l.r AS low_rate, round(h.r - l.r, 4) AS max_delta
FROM o h JOIN o l ON h.benchmark = l.benchmark AND h.hi = 1 AND l.lo = 1 AND h.k > 1 ORDER BY max_delta DESC, h.benchmark LIMIT 10""")
def top_divergences(spark, d):
    return report.divergences(report.agent_benchmarks(adapter.signals(spark, d)))


@query(S + " SELECT count(*) AS total, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed, round(count(*) FILTER (WHERE passed)::DOUBLE / count(*), 4) AS pass_rate, round(coalesce(avg(reward), 0.0), 4) AS avg_reward, string_agg(DISTINCT config_name, ',' ORDER BY config_name) AS configs, string_agg(DISTINCT benchmark, ',' ORDER BY benchmark) AS benchmarks, count(*) FILTER (WHERE has_trajectory) AS with_trajectory FROM signals")
def corpus_stats(spark, d):
    out = report.corpus_stats(adapter.signals(spark, d))
    return out.withColumns({c: F.array_join(c, ",") for c in ("configs", "benchmarks")})


@query(A + """, n AS (SELECT count(*) AS t FROM signals) SELECT category_name, count(*) AS n, category_name NOT IN ('rate_limited_run', 'exception_crash', 'incomplete_solution', 'near_miss', 'minimal_progress') AS requires_trajectory,
any_value(t) AS denominator, round(count(*)::DOUBLE / any_value(t), 4) AS rate FROM annotations, n GROUP BY category_name""")
def category_rates(spark, d):
    s = adapter.signals(spark, d)
    return report.category_rates(adapter.labels(spark, d), s)


@query(_LABELS + " SELECT config_name, category_name, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY config_name) AS BIGINT) AS slice_total FROM labels GROUP BY config_name, category_name")
def category_by_config(spark, d):
    return report.category_by(adapter.labels(spark, d), "config_name")


@query(_LABELS + " SELECT benchmark, category_name, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY benchmark) AS BIGINT) AS slice_total FROM labels GROUP BY benchmark, category_name")
def category_by_suite(spark, d):
    return report.category_by(adapter.labels(spark, d), "benchmark")


@query(_LABELS + """, k AS (SELECT DISTINCT s.task_id AS task, l.config_name AS cfg, l.category_name FROM labels l JOIN signals s ON l.u = s.u AND l.seg = s.seg), c AS (SELECT DISTINCT task, cfg FROM k),
p AS (SELECT a.task, a.cfg AS cfg_a, b.cfg AS cfg_b FROM c a JOIN c b ON a.task = b.task AND a.cfg < b.cfg), e AS (SELECT cfg_a, cfg_b, count(*) AS shared FROM p GROUP BY ALL HAVING count(*) >= 20),
g AS (SELECT cfg_a, cfg_b, category_name, sum(x) AS delta FROM (SELECT p.cfg_a, p.cfg_b, k.category_name, -1 AS x FROM p JOIN k ON p.task = k.task AND p.cfg_a = k.cfg UNION ALL SELECT p.cfg_a, p.cfg_b, k.category_name, 1 FROM p JOIN k ON p.task = k.task AND p.cfg_b = k.cfg) GROUP BY ALL HAVING sum(x) <> 0),
o AS (SELECT g.cfg_a, g.cfg_b, shared, category_name, CAST(delta AS BIGINT) AS delta, row_number() OVER (PARTITION BY g.cfg_a, g.cfg_b, delta > 0 ORDER BY abs(delta) DESC, category_name) AS place FROM g JOIN e ON g.cfg_a = e.cfg_a AND g.cfg_b = e.cfg_b)
SELECT * FROM o WHERE place <= 5""")
def paired_config_deltas(spark, d):
    return report.paired_deltas(adapter.labels(spark, d)).withColumn("place", F.col("place").cast("long"))


_TAX = "tax(category_name, dimension, polarity) AS (VALUES " + ", ".join(f"('{c['name']}', '{c['dimension']}', '{c['polarity']}')" for c in report.taxonomy.CATEGORIES) + ")"


@query(_LABELS + f", {_TAX}, x AS (SELECT DISTINCT l.u, l.seg, dimension, passed FROM labels l JOIN tax USING (category_name)) SELECT dimension, count(*) AS trials, count(*) FILTER (WHERE NOT passed) AS failed, round(count(*) FILTER (WHERE NOT passed)::DOUBLE / count(*), 4) AS failure_rate FROM x GROUP BY dimension")
def dimension_rollup(spark, d):
    return report.dimension_rollup(adapter.labels(spark, d).withColumn("trial_id", F.concat_ws("/", "u", "seg")))


@query(_LABELS + f", {_TAX}, own AS (SELECT * FROM labels JOIN tax USING (category_name) WHERE polarity = 'failure'), top AS (SELECT category_name, count(*) AS n FROM own GROUP BY ALL ORDER BY n DESC, category_name LIMIT 3), r AS (SELECT category_name, n, row_number() OVER (PARTITION BY category_name ORDER BY concat(own.u, '/', own.seg)) AS place, concat(own.u, '/', own.seg) AS trial_id FROM own JOIN top USING (category_name)) SELECT * FROM r WHERE place <= 2")
def top_categories_examples(spark, d):
    out = report.top_categories(adapter.labels(spark, d).withColumn("trial_id", F.concat_ws("/", "u", "seg")), "failure")
    return out.select("category_name", "n", F.col("place").cast("long").alias("place"), "trial_id")


@query(_LABELS + ", c AS (SELECT benchmark, category_name, count(*) AS n FROM labels WHERE NOT passed GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY benchmark ORDER BY n DESC, category_name) AS place FROM c) SELECT * FROM r WHERE place <= 3")
def top_failures_per_benchmark(spark, d):
    return report.top_failures(adapter.labels(spark, d), "benchmark").withColumn("place", F.col("place").cast("long"))


# Statistics -----------------------------------------------------------------------------------------------------------------------


@query(A + """, l AS (SELECT concat(u, '/', seg) AS t, category_name AS c FROM annotations), n AS (SELECT count(*) AS n FROM signals), k AS (SELECT c, count(*) AS k FROM l GROUP BY c),
b AS (SELECT x.c AS a, y.c AS b, count(*) AS k FROM l x JOIN l y ON x.t = y.t AND x.c <> y.c GROUP BY ALL),
g AS (SELECT x.c AS a, y.c AS b, x.k AS ka, y.k AS kb, n.n, coalesce(b.k, 0) AS k FROM k x CROSS JOIN k y CROSS JOIN n LEFT JOIN b ON b.a = x.c AND b.b = y.c)
SELECT a, b, round(CASE WHEN a = b THEN ka::DOUBLE WHEN ka::DOUBLE * kb * (n - ka) * (n - kb) > 0 THEN (k::DOUBLE * n - ka::DOUBLE * kb) / sqrt(ka::DOUBLE * kb * (n - ka) * (n - kb)) ELSE 0.0 END, 6) + 0.0 AS value FROM g""")
def phi_matrix(spark, d):
    return report.phi_of(_kinds(spark, d), adapter.signals(spark, d))


def _two(spark, d) -> DataFrame:
    a = adapter.annotations(spark, d)
    one = lambda df, name: df.select(F.lit(name).alias("annotator"), F.concat_ws("/", "u", "seg").alias("trial_id"), "category_name", "confidence")
    return one(a, "first").unionByName(one(adapter.second_opinion(a), "second"))


_PAIR = A + """, one AS (SELECT concat(u, '/', seg) AS t, category_name AS c, confidence FROM annotations), two AS (SELECT concat(u, '/', seg) AS t, category_name AS c, confidence FROM second),
sh AS (SELECT DISTINCT t FROM one INTERSECT SELECT DISTINCT t FROM two), n AS (SELECT count(*) AS n FROM sh),
f AS (SELECT coalesce(x.t, y.t) AS t, coalesce(x.c, y.c) AS c, x.confidence AS ca, y.confidence AS cb FROM (SELECT * FROM one WHERE t IN (SELECT t FROM sh)) x FULL JOIN (SELECT * FROM two WHERE t IN (SELECT t FROM sh)) y ON x.t = y.t AND x.c = y.c),
m AS (SELECT c, count(*) FILTER (WHERE ca IS NOT NULL AND cb IS NOT NULL) AS n11, count(*) FILTER (WHERE cb IS NULL) AS n10, count(*) FILTER (WHERE ca IS NULL) AS n01, any_value(n.n) AS n FROM f, n GROUP BY c),
q AS (SELECT *, n - n11 - n10 - n01 AS n00 FROM m),
z AS (SELECT *, (n11 + n00) / n::DOUBLE AS po, ((n11 + n10)::DOUBLE * (n11 + n01) + (n01 + n00)::DOUBLE * (n10 + n00)) / (n::DOUBLE * n) AS pe FROM q)"""


@query(_PAIR + " SELECT 'first' AS annotator_a, 'second' AS annotator_b, c AS category_name, n11, n10, n01, n00, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 9) AS kappa FROM z")
def kappa_pairwise(spark, d):
    return stats.agreement(_two(spark, d)).withColumn("kappa", F.round("kappa", 9))


@query(_PAIR + " SELECT 'first' AS annotator_a, 'second' AS annotator_b, c AS category_name, round(coalesce(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 0), 9) AS kappa, round(po, 9) AS agreement, n11 + n10 AS count_a, n11 + n01 AS count_b, coalesce(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 0) >= 0.4 AS calibrated FROM z")
def kappa_cross_model(spark, d):
    out = stats.cross_model(stats.agreement(_two(spark, d)))
    return out.withColumn("kappa", F.round("kappa", 9)).withColumn("agreement", F.round("agreement", 9))


def _predicted_golden(spark, d) -> tuple[DataFrame, DataFrame]:
    both = _two(spark, d)
    return both.filter("annotator = 'second'").drop("annotator"), both.filter("annotator = 'first'").drop("annotator")


@query(_PAIR + " SELECT c AS category_name, n11 AS tp, n01 AS fp, n10 AS fn, CASE WHEN n11 + n01 > 0 THEN n11::DOUBLE / (n11 + n01) ELSE 0.0 END AS precision, CASE WHEN n11 + n10 > 0 THEN n11::DOUBLE / (n11 + n10) ELSE 0.0 END AS recall, CASE WHEN 2 * n11 + n01 + n10 > 0 THEN (2 * n11)::DOUBLE / (2 * n11 + n01 + n10) ELSE 0.0 END AS f1, n11 + n10 AS support FROM q")
def calibration_prf(spark, d):
    return stats.confusion(*_predicted_golden(spark, d))


_CAL = _PAIR + """, cp AS (SELECT c, coalesce(cb, 0.0) AS conf, CASE WHEN ca IS NULL THEN 0 ELSE 1 END AS obs, 1 AS w FROM f UNION ALL SELECT c, 0.0, 0, any_value(n.n) - count(*) FROM f, n GROUP BY c),
bi AS (SELECT c, CAST(least(floor(conf * 10), 9) AS INTEGER) AS bin, CAST(sum(w) AS BIGINT) AS n, sum(w * conf) AS sc, CAST(sum(w * obs) AS BIGINT) AS so FROM cp GROUP BY ALL)"""


@query(_CAL + " SELECT c AS category_name, round(sum(abs(sc - so)) / sum(n), 9) AS ece, CAST(sum(n) AS BIGINT) AS n FROM bi GROUP BY c")
def calibration_ece(spark, d):
    pairs = stats.calibration_pairs(*_predicted_golden(spark, d))
    binned = stats.reliability(pairs, ("category_name",), weight=F.col("weight"))
    return stats.ece(binned, ("category_name",)).withColumn("ece", F.round("ece", 9))


@query(_CAL + " SELECT c AS category_name, round(sum(w * (conf - obs) * (conf - obs)) / sum(w), 9) AS brier, CAST(sum(w) AS BIGINT) AS n FROM cp GROUP BY c")
def brier_score(spark, d):
    pairs = stats.calibration_pairs(*_predicted_golden(spark, d))
    return stats.brier(pairs, ("category_name",), F.col("weight")).withColumn("brier", F.round("brier", 9))


@query("WITH p AS (SELECT least(n_chars, 2000) / 2000.0::DOUBLE AS conf, quality AS obs FROM documents JOIN labels USING (doc_id)), b AS (SELECT CAST(least(floor(conf * 10), 9) AS INTEGER) AS bin, count(*) AS n, sum(conf) AS sc, sum(obs) AS so FROM p GROUP BY ALL) SELECT CAST(r.i AS INTEGER) AS bin, coalesce(n, 0) AS n, round(coalesce(sc / n, 0.0), 9) AS mean_confidence, round(coalesce(so / n, 0.0), 9) AS observed_rate FROM range(10) r(i) LEFT JOIN b ON r.i = b.bin")
def reliability_bins(spark, d):
    docs, labels = _table(spark, d, "documents").select("doc_id", "n_chars"), _table(spark, d, "labels")
    pairs = docs.join(labels, "doc_id").select((F.least("n_chars", F.lit(2000)) / F.lit(2000.0)).alias("confidence"), F.col("quality").alias("observed"))
    out = stats.fill_bins(stats.reliability(pairs))
    return out.select("bin", "n", F.round("mean_confidence", 9).alias("mean_confidence"), F.round("observed_rate", 9).alias("observed_rate"))


# Windows, samples, texts ----------------------------------------------------------------------------------------------------------


@query(S + ", x AS (SELECT *, row_number() OVER (PARTITION BY task_id, config_name ORDER BY started_at DESC, trial_id) AS n FROM signals) SELECT task_id, config_name, trial_id, started_at FROM x WHERE n = 1")
def latest_attempt(spark, d):
    return latest_attempts(adapter.signals(spark, d)).select("task_id", "config_name", "trial_id", "started_at")


@query(S + ", x AS (SELECT u, seg, agent_name, passed, benchmark, row_number() OVER (PARTITION BY agent_name, passed ORDER BY benchmark, u, seg) AS place FROM signals) SELECT u, seg, agent_name, passed, place FROM x WHERE place <= 3")
def stratified_round_robin(spark, d):
    return sampling.stratified(adapter.signals(spark, d), ("agent_name", "passed"), ("benchmark", "u", "seg"), 3).select("u", "seg", "agent_name", "passed", F.col("place").cast("long").alias("place"))


@query(S + " SELECT u, seg, (row_number() OVER (PARTITION BY passed ORDER BY u, seg) - 1) % 5 AS fold FROM signals")
def kfold_assign(spark, d):
    return sampling.kfold(adapter.signals(spark, d), "passed", ("u", "seg"), 5).select("u", "seg", F.col("fold").cast("long").alias("fold"))


@query("SELECT doc_id, regexp_matches(lower(text), 'error|fail|exception|traceback') AS has_error, regexp_matches(lower(text), 'password|secret|token') AS has_secret, contains(lower(text), 'licensed under') AS has_license FROM documents")
def marker_scan(spark, d):
    marks = {"has_error": ("error", "fail", "exception", "traceback"), "has_secret": ("password", "secret", "token"), "has_license": ("licensed under",)}
    return textops.markers(_table(spark, d, "documents").select("doc_id", "text"), "text", marks).drop("text")


@query("WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS t FROM conversations GROUP BY conv_id) SELECT conv_id, array_to_string(CASE WHEN len(t) > 3 THEN list_concat(t[1:2], ['...'], t[len(t):len(t)]) ELSE t END, '\n') AS kept FROM c")
def step_truncate(spark, d):
    c = _table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t"))
    return c.select("conv_id", F.array_join(textops.truncate_steps(F.col("t"), 2, 1, F.lit("...")), "\n").alias("kept"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 40 THEN concat(substr(text, 1, 40), '...') ELSE text END AS summary FROM conversations")
def step_summarise(spark, d):
    return _table(spark, d, "conversations").select("conv_id", "turn", textops.shorten(F.col("text"), 40).alias("summary"))


@query("SELECT conv_id, turn, sha256(concat(role, ': ', text, chr(0), 'model-a')) AS cache_key FROM conversations")
def prompt_hash(spark, d):
    c = _table(spark, d, "conversations")
    return c.select("conv_id", "turn", textops.cache_key(F.concat("role", F.lit(": "), "text"), F.lit("model-a")).alias("cache_key"))


@query(S + " SELECT u, seg, task_id, tool_calls_total FROM signals")
def judge_safe_projection(spark, d):
    from ..operators.signals import judge_safe

    return judge_safe(adapter.signals(spark, d)).select("u", "seg", "task_id", "tool_calls_total")


from . import relational  # noqa: E402, F401  registers the rest
