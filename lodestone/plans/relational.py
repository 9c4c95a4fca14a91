"""General relational queries: joins, windows, set operations, grouping sets, models and stores, streaming aggregates as batches."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import model, report, segments, store
from ..operators.signals import normalize_lists
from ..session import shared_dir
from ..streaming import trials as streaming
from . import adapter
from .queries import _LABELS, A, S, _table, query

# Joins ----------------------------------------------------------------------------------------------------------------------------


@query(_LABELS + " SELECT model, category_name, count(*) AS n, round(avg(confidence), 9) AS mean_confidence FROM labels WHERE passed GROUP BY ALL")
def signals_annotations_join(spark, d):
    s = adapter.signals(spark, d)
    a = adapter.annotations(spark, d).withColumn("trial_id", F.concat_ws("/", "u", "seg")).select("u", "seg", "category_name", "confidence")
    j = s.filter("passed").select("u", "seg", "model").join(a, ["u", "seg"])
    return j.groupBy("model", "category_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 9).alias("mean_confidence"))


@query(S + ", m AS (SELECT benchmark, count(DISTINCT task_id) AS task_count FROM signals WHERE benchmark <> 'bench-0' GROUP BY benchmark) SELECT s.u, s.seg, m.task_count FROM signals s LEFT JOIN m USING (benchmark)")
def signals_manifests_left_join(spark, d):
    s = adapter.signals(spark, d)
    m = store.manifests(s.filter("benchmark <> 'bench-0'"))
    return s.join(m, "benchmark", "left").select("u", "seg", "task_count")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def semi_join(spark, d):
    o = _table(spark, d, "orders").filter("o_totalprice > 200000").select("o_custkey")
    return _table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark, d):
    return _table(spark, d, "customer").join(_table(spark, d, "orders").select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query(A + " SELECT u, seg, category_name, bool_or(a) AS in_a, NOT bool_and(a) AS in_b FROM (SELECT u, seg, category_name, true AS a FROM annotations UNION ALL SELECT u, seg, category_name, false FROM second) GROUP BY u, seg, category_name")
def full_outer_labels(spark, d):
    a = adapter.annotations(spark, d)
    x = a.select("u", "seg", "category_name", F.lit(True).alias("in_a"))
    y = adapter.second_opinion(a).select("u", "seg", "category_name", F.lit(True).alias("in_b"))
    return x.join(y, ["u", "seg", "category_name"], "full").select("u", "seg", "category_name", F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))


@query("WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, event_id AS view_id FROM events WHERE event_type = 'view') SELECT e.event_id, max_by(v.view_id, (v.ts, v.view_id)) AS last_view FROM e LEFT JOIN v ON v.user_id = e.user_id AND v.ts <= e.ts GROUP BY e.event_id")
def as_of_join(spark, d):
    """The last view before each purchase: a scan by user and time carries it forward, so no pair of events is ever built; a hot user is scanned in stretches."""
    e = _table(spark, d, "events").select("event_id", "user_id", "ts", "event_type").filter(F.col("event_type").isin("view", "purchase"))
    view = F.when(F.col("event_type") == "view", F.col("event_id"))
    seen = segments.last_value(e, ["user_id"], ["ts", F.desc("event_type"), "event_id"], view, "last_view")
    return seen.filter("event_type = 'purchase'").select("event_id", "last_view")


@query("WITH q AS (SELECT n_nationkey, n_nationkey * 1000.0 AS lo, n_nationkey * 1000.0 + 1500 AS hi FROM nation) SELECT n_nationkey, count(*) AS n FROM q JOIN customer ON c_acctbal >= lo AND c_acctbal < hi GROUP BY n_nationkey")
def range_join(spark, d):
    """Balances in overlapping ranges: both sides fall in bins of the step's width, so that the join is an equi-join on bins."""
    step = 500
    q = _table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 1000).alias("lo"), (F.col("n_nationkey") * 1000 + 1500).alias("hi"))
    q = q.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / step), F.floor((F.col("hi") - 1) / step))))
    c = _table(spark, d, "customer").select("c_acctbal", F.floor(F.col("c_acctbal") / step).alias("bin"))
    return q.join(c, "bin").filter("c_acctbal >= lo AND c_acctbal < hi").groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("n"))


# Windows, sets, groupings ---------------------------------------------------------------------------------------------------------


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS rolling, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events")
def window_frames(spark, d):
    frames = lambda w: {"rolling": F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 6), "before": F.lag("event_type").over(w), "after": F.lead("event_type").over(w)}
    e = _table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return segments.over_rows(e, ["user_id"], ["ts", "event_id"], 2, 1, frames).select("event_id", "rolling", "before", "after")


@query("SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS quarter, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS place, percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS share FROM customer")
def window_ranks(spark, d):
    n = W.partitionBy("c_nationkey")
    one = n.orderBy("c_acctbal", "c_custkey")
    return _table(spark, d, "customer").select("c_custkey", F.ntile(4).over(one).cast("long").alias("quarter"), F.rank().over(n.orderBy(F.desc("c_acctbal"))).cast("long").alias("place"), F.percent_rank().over(one).alias("share"))


@query("WITH r AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) SELECT * FROM r WHERE place <= 2")
def topk_per_group(spark, d):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = _table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return o.withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 2")


@query("SELECT event_type, user_id % 5 AS g, count(*) AS n, grouping(event_type) AS all_types, grouping(user_id % 5) AS all_groups FROM events GROUP BY CUBE (event_type, user_id % 5)")
def cube_counts(spark, d):
    e = _table(spark, d, "events").select("event_type", (F.col("user_id") % 5).alias("g"))
    return e.cube("event_type", "g").agg(F.count(F.lit(1)).alias("n"), F.grouping("event_type").cast("long").alias("all_types"), F.grouping("g").cast("long").alias("all_groups"))


@query("SELECT event_type, user_id % 5 AS g, count(*) AS n FROM events GROUP BY ROLLUP (event_type, user_id % 5)")
def rollup_counts(spark, d):
    return _table(spark, d, "events").select("event_type", (F.col("user_id") % 5).alias("g")).rollup("event_type", "g").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, user_id % 5 AS g, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 5), ())")
def grouping_sets(spark, d):
    e = _table(spark, d, "events").select("event_type", (F.col("user_id") % 5).alias("g"))
    return e.groupingSets([[F.col("event_type")], [F.col("g")], []], "event_type", "g").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id % 5 AS g, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error FROM events GROUP BY ALL")
def pivot_counts(spark, d):
    e = _table(spark, d, "events").select("event_type", (F.col("user_id") % 5).alias("g"))
    return e.groupBy("g").pivot("event_type", ["view", "click", "error"]).agg(F.count(F.lit(1))).na.fill(0)


@query("(SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) UNION ALL (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer)")
def set_operations(spark, d):
    c, s = _table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), _table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    n = _table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    return c.exceptAll(s).unionByName(c.intersect(s)).unionByName(n.subtract(c))


@query(A + ", x AS (SELECT u, seg, category_name FROM annotations), y AS (SELECT u, seg, category_name FROM second), a AS (SELECT u, seg, count(*) AS n FROM ((SELECT * FROM x EXCEPT SELECT * FROM y) UNION ALL (SELECT * FROM y EXCEPT SELECT * FROM x)) GROUP BY ALL) SELECT * FROM a")
def disputed_categories(spark, d):
    a = adapter.annotations(spark, d)
    x, y = (df.select("u", "seg", "category_name") for df in (a, adapter.second_opinion(a)))
    return x.subtract(y).unionByName(y.subtract(x)).groupBy("u", "seg").agg(F.count(F.lit(1)).alias("n"))


# Store and export -----------------------------------------------------------------------------------------------------------------


@query(A + ", w AS (SELECT u, seg, category_name, confidence, 1 AS o FROM annotations UNION ALL SELECT u, seg, category_name, confidence, 2 FROM second), r AS (SELECT *, row_number() OVER (PARTITION BY u, seg, category_name ORDER BY o DESC) AS n FROM w) SELECT u, seg, category_name, round(confidence, 9) AS confidence FROM r WHERE n = 1")
def upsert_last_writer_wins(spark, d):
    a = adapter.annotations(spark, d)
    row = lambda df, day: df.select(F.concat_ws("/", "u", "seg").alias("trial_id"), "category_name", "confidence", F.lit("heuristic").alias("annotator_type"), F.lit("rules").alias("annotator_identity"), F.lit("3.0.0").alias("taxonomy_version"), F.lit(day).alias("annotated_at"))
    kept = store.AnnotationStore(spark, urlsplit(shared_dir(spark, "annotations")).path)  # a store of its own, in the shared folder
    for batch in (row(a, "2026-01-01T00:00:00Z"), row(adapter.second_opinion(a), "2026-01-02T00:00:00Z")):
        kept.upsert(batch, "3.0.0")
    part = lambda i: F.split("trial_id", "/")[i].cast("long")
    return kept.read().select(part(0).alias("u"), part(1).alias("seg"), "category_name", F.round("confidence", 9).alias("confidence"))


@query(A + " SELECT u, seg, category_name, count(*) AS n FROM (SELECT u, seg, category_name FROM annotations UNION ALL SELECT u, seg, category_name FROM second) GROUP BY ALL HAVING count(*) > 1")
def pk_violations(spark, d):
    a = adapter.annotations(spark, d)
    rows = a.unionByName(adapter.second_opinion(a)).select(F.concat_ws("/", "u", "seg").alias("trial_id"), "category_name", F.lit("heuristic").alias("annotator_type"), F.lit("rules").alias("annotator_identity"), F.lit("3.0.0").alias("taxonomy_version"))
    part = lambda i: F.split("trial_id", "/")[i].cast("long")
    return store.duplicate_keys(rows).select(part(0).alias("u"), part(1).alias("seg"), "category_name", "n")


@query(A + " SELECT CASE WHEN u % 2 = 0 THEN '3.0.0' ELSE '2.0.0' END AS taxonomy_version, count(*) AS n FROM annotations GROUP BY ALL")
def mixed_versions(spark, d):
    a = adapter.annotations(spark, d)
    return a.groupBy(F.when(F.col("u") % 2 == 0, "3.0.0").otherwise("2.0.0").alias("taxonomy_version")).agg(F.count(F.lit(1)).alias("n"))


@query(S + ", p AS (SELECT benchmark, count(DISTINCT task_id) AS task_count FROM signals GROUP BY benchmark) SELECT printf('manifest-%03d', row_number() OVER (ORDER BY benchmark)) AS manifest_id, benchmark, task_count, '' AS created_at FROM p")
def manifests_refresh(spark, d):
    return store.manifests(adapter.signals(spark, d))


@query(S + " SELECT u, seg, len(files_read_list) AS n_read FROM signals")
def list_normalisation(spark, d):
    s = adapter.signals(spark, d).withColumn("files_read_list", F.when(F.size("files_read_list") > 0, F.to_json("files_read_list")))
    return normalize_lists(s, ("files_read_list",)).select("u", "seg", F.size("files_read_list").cast("long").alias("n_read"))


# Models ---------------------------------------------------------------------------------------------------------------------------


@query(S + " SELECT round(avg(coalesce(reward, 0)), 9) AS mean_reward, round(greatest(stddev_pop(coalesce(reward, 0)), 1e-8), 9) AS std_reward, avg(tool_calls_total) AS mean_calls, round(stddev_pop(tool_calls_total), 9) AS std_calls, 1e-8::DOUBLE AS std_missing FROM signals")
def feature_scaling(spark, d):
    s = adapter.signals(spark, d)
    at = {n: i for i, n in enumerate(model.FEATURES)}
    out = model.scaling(s.select(model.features(s).alias("x")))
    pick = lambda c, n: F.round(F.col(c)[at[n]], 9)
    return out.select(pick("means", "reward").alias("mean_reward"), pick("stds", "reward").alias("std_reward"), F.col("means")[at["tool_calls_total"]].alias("mean_calls"), pick("stds", "tool_calls_total").alias("std_calls"), F.col("stds")[at["cost_usd"]].alias("std_missing"))


_WEIGHTS = {"near_miss": (1.5, -0.25, -0.5), "clean_success": (2.0, -1.0, 0.125)}


def _fixed_model(spark):
    at = {n: i for i, n in enumerate(model.FEATURES)}
    rows = []
    for name, (reward, calls, bias) in _WEIGHTS.items():
        w = [0.0] * len(at)
        w[at["reward"]], w[at["tool_calls_total"]] = reward, calls
        rows.append((name, w, bias, [0.0] * len(at), [1.0 if n != "tool_calls_total" else 10.0 for n in at]))
    return spark.createDataFrame(rows, "category string, weights array<double>, bias double, means array<double>, stds array<double>")


_PROBABILITY = S + ", m(category, wr, wc, b) AS (VALUES " + ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for k, (a, b, c) in _WEIGHTS.items()) + "), p AS (SELECT u, seg, category, 1 / (1 + exp(-(coalesce(reward, 0.0) * wr + tool_calls_total / 10.0::DOUBLE * wc + b))) AS probability FROM signals CROSS JOIN m)"


@query(_PROBABILITY + " SELECT u, seg, category, round(probability, 9) AS probability FROM p")
def lr_predict(spark, d):
    s = adapter.signals(spark, d).withColumn("trial_id", F.concat_ws("/", "u", "seg"))
    p = model.probabilities(s, _fixed_model(spark))
    part = lambda i: F.split("trial_id", "/")[i].cast("long")
    return p.select(part(0).alias("u"), part(1).alias("seg"), "category", F.round("probability", 9).alias("probability"))


@query(A + ", " + _PROBABILITY.removeprefix(S + ", ") + ", h AS (SELECT u, seg, category AS c FROM p WHERE probability >= 0.5), g AS (SELECT u, seg, category_name AS c FROM annotations WHERE category_name IN ('near_miss', 'clean_success')), f AS (SELECT coalesce(h.c, g.c) AS c, h.c IS NOT NULL AS p, g.c IS NOT NULL AS g FROM h FULL JOIN g ON h.u = g.u AND h.seg = g.seg AND h.c = g.c) SELECT c AS category_name, count(*) FILTER (WHERE p AND g) AS tp, count(*) FILTER (WHERE p AND NOT g) AS fp, count(*) FILTER (WHERE g AND NOT p) AS fn FROM f GROUP BY c")
def classifier_confusion(spark, d):
    s = adapter.signals(spark, d).withColumn("trial_id", F.concat_ws("/", "u", "seg"))
    labels = adapter.annotations(spark, d).withColumn("trial_id", F.concat_ws("/", "u", "seg")).filter(F.col("category_name").isin(*_WEIGHTS))
    return model.evaluate(model.predict(s, _fixed_model(spark)), labels).select("category_name", "tp", "fp", "fn")


@query(A + ", " + _PROBABILITY.removeprefix(S + ", ") + " SELECT u, seg, category_name, 'heuristic' AS tier FROM annotations WHERE category_name IN ('exception_crash', 'rate_limited_run', 'edit_verify_loop_failure') UNION ALL SELECT u, seg, category, 'classifier' FROM p WHERE probability >= 0.5")
def ensemble_labels(spark, d):
    s = adapter.signals(spark, d).withColumn("trial_id", F.concat_ws("/", "u", "seg"))
    out = model.ensemble(adapter.annotations(spark, d).withColumn("trial_id", F.concat_ws("/", "u", "seg")), model.predict(s, _fixed_model(spark)))
    part = lambda i: F.split("trial_id", "/")[i].cast("long")
    return out.select(part(0).alias("u"), part(1).alias("seg"), "category_name", "tier")


@query("SELECT 'b' AS category UNION ALL SELECT 'a'")
def trust_gate(spark, d):
    rows = [("a", "ok", 0.9, 0.05), ("b", "ok", 0.7, 0.1), ("c", "ok", 0.69, 0.0), ("d", "insufficient_data", 1.0, 0.0), ("e", "ok", 0.95, 0.2), ("exception_crash", "ok", 1.0, 0.0), ("f", None, None, None)]
    m = spark.createDataFrame(rows, "category string, cv_status string, eval_f1 double, cv_ece double")
    return model.trusted(m, 0.7, 0.1).select("category")


@query(_LABELS + ", j AS (SELECT DISTINCT trial_path, category_name FROM labels WHERE u % 2 = 0 AND category_name <> 'near_miss'), h AS (SELECT DISTINCT trial_path, category_name FROM labels WHERE category_name IN ('tool_argument_error', 'incomplete_solution', 'near_miss', 'minimal_progress', 'premature_termination')) SELECT trial_path, category_name, 'llm' AS source FROM j UNION ALL SELECT trial_path, category_name, 'heuristic' FROM h WHERE (trial_path, category_name) NOT IN (SELECT (trial_path, category_name) FROM j)")
def blend_labels(spark, d):
    labels = adapter.labels(spark, d).select("u", "trial_path", "category_name", "confidence")
    judged = labels.filter("u % 2 = 0 AND category_name <> 'near_miss'")
    return model.blend(labels, judged).select("trial_path", "category_name", "source")


@query()
def lr_train(spark, d):
    s = adapter.signals(spark, d)
    labels = adapter.labels(spark, d).select("trial_id", "category_name")
    return model.train(labels, s).select("category", "n_positive", "n_negative", "train_f1", "eval_f1", "cv_ece", "cv_status")


# Windows over events as a stream would compute them ---------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_events(spark, d):
    return streaming.tumbling(_table(spark, d, "events").select("ts", "event_type")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("WITH x AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 minute OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS opens FROM events), y AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM x) SELECT min(ts) AS session_start, user_id, count(*) AS n FROM y GROUP BY user_id, s")
def session_events(spark, d):
    return streaming.sessions(_table(spark, d, "events").select("ts", "user_id")).withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


@query(A + " SELECT category_name, count(*) AS n FROM annotations GROUP BY category_name")
def category_counts(spark, d):
    return report.category_counts(adapter.annotations(spark, d))
