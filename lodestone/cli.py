"""The command line: each command is a thin wrapper around an operator."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import taxonomy
from .functions.columns import core_task_name  # noqa: F401  part of the SQL functions
from .operators import annotators, batches, incremental, model, render, rules, sampling, signals, stats, textops
from .operators.store import AnnotationStore, resolve_alias
from .schemas import ANNOTATION_VERSION, REDACTED, TABLES, render_doc
from .session import session, written
from .sources import readers, sinks, suites
from .sql import MissingTableError, Session

log = logging.getLogger("lodestone")


def _now() -> str:
    return datetime.now(UTC).isoformat()


def _suites(spark: SparkSession, a) -> DataFrame | None:
    mapping = suites.load_mapping(a.manifest) if getattr(a, "manifest", None) else {}
    return suites.table(spark, mapping) if mapping else None


def extract(spark: SparkSession, a) -> int:
    """With a cache, only documents whose content it does not know are parsed."""
    results, trajectories = readers.trial_documents(readers.listing(spark, a.runs_dir))
    if not a.cache_dir:
        return sinks.write_single(signals.extract(results, trajectories, suites=_suites(spark, a)), a.output)
    both = results.join(trajectories.withColumnRenamed("raw", "t"), "trial_path", "left")
    docs = written(both.withColumn("content_hash", incremental.content_hash(F.col("raw"), F.col("t"))), "documents")
    rows, todo = None, docs
    if os.path.isdir(a.cache_dir):
        hits, todo = incremental.split_by_cache(docs, spark.read.parquet(a.cache_dir), "content_hash")
        rows = hits.drop("trial_path").join(docs.select("trial_path", "content_hash"), "content_hash")
    fresh = signals.extract(todo.select("trial_path", "raw"), todo.filter("t is not null").select("trial_path", F.col("t").alias("raw")), suites=_suites(spark, a))
    fresh = written(fresh.join(docs.select("trial_path", "content_hash"), "trial_path"), "extracted")
    rows = fresh if rows is None else rows.unionByName(fresh, allowMissingColumns=True)
    n = sinks.write_single(rows.drop("content_hash"), a.output)
    incremental.put(a.cache_dir, fresh, "content_hash")
    return n


def ingest(spark: SparkSession, a) -> int:
    """Changed trials are found by the metadata of their files, and only theirs are opened; the output has all trials, or in delta mode
    the changed ones."""
    found = written(readers.listing(spark, a.runs_dir), "listing")
    state = spark.read.schema("trial_path string, path string, modified long, size long").json(a.state) if a.state and os.path.exists(a.state) else None
    old = readers.signals(spark, a.output) if a.mode == "merge" and os.path.exists(a.output) and state is not None else None
    if a.mode == "merge" and old is None:
        state = None  # without the earlier output there is nothing to merge into
    todo = written(incremental.changed_trials(found, state), "changed")
    results, trajectories = readers.trial_documents(found.join(todo, "trial_path", "left_semi"))
    delta = written(signals.extract(results, trajectories, suites=_suites(spark, a)), "delta")
    # of changed trials that are none any more nothing stays
    kept = old.join(todo, "trial_path", "left_anti") if old is not None else None
    n = sinks.write_single(delta if kept is None else kept.unionByName(delta, allowMissingColumns=True), a.output)
    if a.state:
        sinks.write_single(found.select("trial_path", "path", "modified", "size"), a.state)
    return n


def annotate(spark: SparkSession, a) -> int:
    docs = rules.annotate(readers.signals(spark, a.signals))
    n = sinks.write_single(docs, a.output, ANNOTATION_VERSION)
    if a.annotations_out:
        AnnotationStore(spark, a.annotations_out).upsert(rules.narrow(docs, at=_now()).dropDuplicates(["trial_id", "category_name"]), taxonomy.VERSION)
    return n


def prompts(s: DataFrame, files: DataFrame) -> DataFrame:
    """(trial_id, prompt, keyed_text) of signals with a trial_path, from the listed files of their trials."""
    texts = readers.contents(files.join(s.select("trial_path").distinct(), "trial_path", "left_semi"))
    _, steps = readers.trial_documents(files.join(s.select("trial_path").distinct(), "trial_path", "left_semi"))
    told = texts.filter((F.col("name") == "instruction.txt") & F.col("nested")).select("trial_path", F.col("raw").alias("_told"))
    rows = s.withColumn("_signals", textops.redacted_json(s, (*REDACTED, "trial_path"))).join(steps.select("trial_path", F.col("raw").alias("_raw")), "trial_path", "left").join(told, "trial_path", "left")
    rows = rows.withColumn("_nonce", F.expr("uuid()"))  # a column of its own, so that both tags have the same
    make = lambda nonce: textops.prompt(taxonomy.prompt_text(), F.col("_told"), textops.trajectory_text(F.col("_raw")), F.col("_signals"), nonce)
    return rows.select("trial_id", make(F.col("_nonce")).alias("prompt"), make(None).alias("keyed_text"))


def llm_annotate(spark: SparkSession, a) -> int:
    s = readers.signals(spark, a.signals).filter("has_trajectory")
    s = sampling.simple(s, "trial_id", a.sample_size, a.seed) if a.sample_size else s
    first, last = s.agg(F.min("trial_path"), F.max("trial_path")).first()
    root = a.runs_dir or (os.path.commonpath([first, last]) if first and last else ".")  # of sorted paths the outer two share what all do
    asked = written(annotators.keyed(prompts(s, readers.listing(spark, root)), a.model), "prompts")  # their nonces stay what they are
    cache = annotators.ReplyCache(spark, a.cache) if a.cache else None
    limits = annotators.Limits(a.workers, a.in_flight, a.per_second, a.attempts, seconds=a.seconds)
    if a.ledger and a.cache:
        raise ValueError("a ledger keeps its replies itself: give it or a cache")
    if a.ledger:  # the backend is one of a server's batches
        out = batches.annotate(asked, a.model, annotators.backend(a.backend), batches.Ledger(spark, a.ledger), seconds=a.seconds).withColumn("cached", F.lit(False))
    else:
        out = annotators.annotate(asked, a.model, annotators.backend(a.backend), cache and cache.of(asked), limits=limits)
    out = written(out, "annotated")  # a reply is asked for once
    if cache:
        hits, misses = out.agg(F.count_if("cached"), F.count_if(~F.col("cached"))).first()
        cache.add(out.filter("error is null and not cached"))
        print(f"reply cache: {hits} hits, {misses} misses")
    out = out.drop("cached")
    n = sinks.write_single(out, a.output, ANNOTATION_VERSION)
    if a.annotations_out:
        rows = rules.narrow(out, "llm", resolve_alias(a.model), at=_now())
        AnnotationStore(spark, a.annotations_out).upsert(rows.dropDuplicates(["trial_id", "category_name"]), taxonomy.VERSION)
    return n


def _assigned(spark: SparkSession, path: str) -> DataFrame:
    return readers.assignments(readers.annotation_documents(spark, path)).filter("category_name is not null")


def blend(spark: SparkSession, a) -> int:
    trust = model.TRUSTED_RULES
    if a.calibration:
        with open(a.calibration, encoding="utf-8") as f:
            scored = json.load(f).get("categories", {})
        trust = tuple(k for k, v in scored.items() if (v.get("f1") or 0) >= a.trust_threshold)
    out = model.blend(_assigned(spark, a.heuristic), _assigned(spark, a.llm), trust, a.cap)
    return sinks.write_single(out, a.output, ANNOTATION_VERSION)


def _labels(spark: SparkSession, path: str, s: DataFrame) -> DataFrame:
    return _assigned(spark, path).join(s.select("trial_path", "trial_id"), "trial_path").select("trial_id", "category_name")


def train(spark: SparkSession, a) -> int:
    s = readers.signals(spark, a.signals)
    labels = _labels(spark, a.labels, s)
    model.save(model.train(labels, s, min_positive=a.min_positive, rate=a.lr, epochs=a.epochs, folds=a.cv_folds), a.output)
    if a.eval:
        judged = s.join(labels.select("trial_id").distinct(), "trial_id", "left_semi")
        print(render.evaluation_markdown(model.evaluate(model.predict(judged, model.load(spark, a.output)), labels)))
    return len(json.load(open(a.output))["categories"])  # noqa: SIM115


def predict(spark: SparkSession, a) -> int:
    out = model.predict(readers.signals(spark, a.signals), model.load(spark, a.model), a.threshold)
    if a.annotations_out:
        rows = out.select("trial_id", "category_name", "confidence", F.lit("classifier").alias("annotator_type"), F.lit("classifier:trained-model").alias("annotator_identity"), F.lit(taxonomy.VERSION).alias("taxonomy_version"), F.lit(_now()).alias("annotated_at"))
        AnnotationStore(spark, a.annotations_out).upsert(rows.dropDuplicates(["trial_id", "category_name"]), taxonomy.VERSION)
    return sinks.write_single(out, a.output, ANNOTATION_VERSION)


def ensemble(spark: SparkSession, a) -> int:
    s, m = readers.signals(spark, a.signals), model.load(spark, a.model)
    ruled = rules.narrow(rules.annotate(s))
    out = model.ensemble(ruled, model.predict(s, model.trusted(m, a.min_f1, a.max_ece), a.threshold))
    for r in model.tier_counts(out).collect():
        log.info("%s: %d", r["tier"], r["n"])
    if a.annotations_out:
        rows = out.select("trial_id", "category_name", "confidence", F.col("tier").alias("evidence"), F.lit("ensemble").alias("annotator_type"), F.lit("ensemble:rules+classifier").alias("annotator_identity"), F.lit(taxonomy.VERSION).alias("taxonomy_version"), F.lit(_now()).alias("annotated_at"))
        AnnotationStore(spark, a.annotations_out).upsert(rows.dropDuplicates(["trial_id", "category_name"]), taxonomy.VERSION)
    return sinks.write_single(out, a.output, ANNOTATION_VERSION)


def report(spark: SparkSession, a) -> int:
    return len(render.write(readers.annotation_documents(spark, a.annotations), a.output))


def calibrate(spark: SparkSession, a) -> int:
    if bool(a.reference) == bool(a.golden_dir):
        raise ValueError("calibrate needs either a reference or a golden directory")
    p = _assigned(spark, a.predictor).withColumnRenamed("trial_path", "trial_id")
    if a.golden_dir:
        g = readers.golden_corpus(spark, a.golden_dir).select("trial_id", F.explode_outer("categories").alias("c")).select("trial_id", F.col("c.name").alias("category_name")).filter("category_name is not null")
    else:
        g = _assigned(spark, a.reference).withColumnRenamed("trial_path", "trial_id")
    pairs = written(stats.calibration_pairs(p, g), "pairs")
    stats.validate_pairs(pairs)
    by = ("category_name",)
    binned, scores = stats.reliability(pairs, by, weight=F.col("weight")), stats.confusion(p, g)
    text = render.calibration_markdown(scores, stats.ece(binned, by), stats.brier(pairs, by, F.col("weight")), binned)
    if not a.output_dir:
        print(text)
        return 0
    os.makedirs(a.output_dir, exist_ok=True)
    with open(f"{a.output_dir}/calibration.md", "w", encoding="utf-8") as f:
        f.write(text)
    rows = scores.join(stats.ece(binned, by).select("category_name", "ece"), "category_name", "left").join(stats.brier(pairs, by, F.col("weight")).select("category_name", "brier"), "category_name", "left")
    with open(f"{a.output_dir}/calibration.json", "w", encoding="utf-8") as f:  # a row for each category
        json.dump({"categories": {r["category_name"]: {k: v for k, v in r.asDict().items() if k != "category_name"} for r in rows.orderBy("category_name").collect()}}, f, indent=2)
    return 0


def agreement(spark: SparkSession, a) -> int:
    rows = AnnotationStore(spark, a.annotations).read().withColumnRenamed("annotator_identity", "annotator")
    per = stats.agreement(rows)
    print(render.agreement_markdown(per, stats.mean_kappa(per)))
    return 0


def validate(spark: SparkSession, a) -> int:
    rows = _assigned(spark, a.annotations)
    taxonomy.validate_names([r[0] for r in rows.select("category_name").distinct().limit(1000).collect()])
    return 0


def query(spark: SparkSession, a) -> int:
    print(sinks.format_rows(Session(spark, a.data_dir).query(a.sql), a.format))
    return 0


def export(spark: SparkSession, a) -> int:
    print(json.dumps(sinks.export(spark, a.data_dir, a.output)["tables"], indent=2))
    return 0


def manifest_refresh(spark: SparkSession, a) -> int:
    return sinks.refresh_manifests(spark, a.data_dir)


def db_schema(spark: SparkSession, a) -> int:
    found = Session(spark, a.data_dir).schema() if a.data_dir else {}
    print("\n".join(render_doc(t) for t in TABLES) if not found else json.dumps(found, indent=2))
    return 0


def pipeline_run(spark: SparkSession | None, a) -> int:
    p = incremental.Pipeline.load(a.file)
    failed = any(r.status == "failed" for r in p.run(force=a.force))
    print(p.summary())
    return int(failed)


#: command -> (function, needs Spark, options); an option is (flags, settings).
_O = lambda *flags, **kw: (flags, kw)
_NEED = {"required": True}
COMMANDS: dict[str, tuple] = {
    "extract": (extract, True, [_O("--runs-dir", **_NEED), _O("--output", **_NEED), _O("--cache-dir"), _O("--manifest")]),
    "ingest": (ingest, True, [_O("--runs-dir", **_NEED), _O("--output", **_NEED), _O("--manifest"), _O("--state"), _O("--mode", choices=("merge", "delta"), default="merge")]),
    "annotate": (annotate, True, [_O("--signals", **_NEED), _O("--output", **_NEED), _O("--annotations-out")]),
    "llm-annotate": (llm_annotate, True, [_O("--signals", **_NEED), _O("--output", **_NEED), _O("--annotations-out"), _O("--runs-dir"), _O("--sample-size", type=int), _O("--seed", type=int, default=0), _O("--model", default="haiku"), _O("--backend", default="offline"), _O("--cache"), _O("--ledger"), _O("--workers", type=int, default=8), _O("--in-flight", type=int, default=4), _O("--per-second", type=float), _O("--attempts", type=int, default=3), _O("--seconds", type=float, default=600.0)]),
    "blend": (blend, True, [_O("--heuristic", **_NEED), _O("--llm", **_NEED), _O("--output", **_NEED), _O("--cap", "--max-heuristic-samples", type=int, default=2000), _O("--calibration"), _O("--trust-threshold", type=float, default=0.7)]),
    "train": (train, True, [_O("--labels", **_NEED), _O("--signals", **_NEED), _O("--output", **_NEED), _O("--min-positive", type=int, default=3), _O("--lr", type=float, default=0.1), _O("--epochs", type=int, default=300), _O("--cv-folds", type=int, default=5), _O("--eval", action="store_true")]),
    "predict": (predict, True, [_O("--model", **_NEED), _O("--signals", **_NEED), _O("--output", **_NEED), _O("--threshold", type=float, default=0.5), _O("--annotations-out")]),
    "ensemble": (ensemble, True, [_O("--model", **_NEED), _O("--signals", **_NEED), _O("--output", **_NEED), _O("--threshold", type=float, default=0.5), _O("--min-f1", type=float, default=0.7), _O("--max-ece", type=float), _O("--annotations-out")]),
    "report": (report, True, [_O("--annotations", **_NEED), _O("--output", **_NEED)]),
    "calibrate": (calibrate, True, [_O("--predictor", **_NEED), _O("--reference", "--golden"), _O("--golden-dir"), _O("--output-dir")]),
    "agreement": (agreement, True, [_O("--annotations", **_NEED)]),
    "validate": (validate, True, [_O("--annotations", **_NEED)]),
    "query": (query, True, [_O("sql"), _O("--data-dir", default="data"), _O("--format", choices=("table", "json", "jsonl", "csv"), default="table")]),
    "export": (export, True, [_O("--data-dir", default="data"), _O("--output", default="data/export")]),
    "manifest-refresh": (manifest_refresh, True, [_O("--data-dir", default="data")]),
    "db-schema": (db_schema, True, [_O("--data-dir")]),
    "pipeline-run": (pipeline_run, False, [_O("--file", default="pipeline.toml"), _O("--force", action="store_true")]),
}


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if len(argv) > 1 and "-".join(argv[:2]) in COMMANDS:  # "manifest refresh", "db schema", "pipeline run"
        argv[:2] = ["-".join(argv[:2])]
    parser = argparse.ArgumentParser(prog="lodestone")
    parser.add_argument("--log-level", default=os.environ.get("LOG_LEVEL", "INFO"))
    sub = parser.add_subparsers(dest="command", required=True)
    for name, (_, _, options) in COMMANDS.items():
        p = sub.add_parser(name)
        for flags, kw in options:
            p.add_argument(*flags, **kw)
    a = parser.parse_args(argv)
    logging.basicConfig(level=a.log_level.upper(), format="%(levelname)s %(message)s")
    f, needs_spark, _ = COMMANDS[a.command]
    try:
        n = f(session() if needs_spark else None, a)
    except (MissingTableError, incremental.PipelineError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if a.command not in ("pipeline-run", "query", "calibrate", "agreement", "validate", "db-schema", "export"):
        log.info("%s: %d", a.command, n)
        return 0
    return n


if __name__ == "__main__":
    sys.exit(main())
