"""Reports as Markdown and JSON, from small aggregated results."""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import taxonomy
from . import report, stats
from .stats import CALIBRATED_KAPPA, direction


def cell(v: object) -> str:
    if v is None:
        return "n/a"
    text = f"{v:.4f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)
    return text.replace("|", "\\|").replace("\n", " ")


def md_table(rows: list[dict], columns: list[str] | None = None) -> str:
    names = columns or (list(rows[0]) if rows else [])
    if not names:
        return ""
    return "\n".join(["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(cell(r[n]) for n in names) + " |" for r in rows)])


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def labelled(docs: DataFrame) -> DataFrame:
    """Nested annotations as rows of category and the trial's dimensions."""
    have = [c for c in docs.columns if c not in ("categories", "evidence")]
    out = docs.select(*have, F.explode("categories").alias("c")).filter("c.name <> ''")
    return out.select(*have, F.col("c.name").alias("category_name"), F.col("c.confidence").alias("confidence"), F.col("c.evidence").alias("evidence"))


def collect(docs: DataFrame) -> dict[str, list[dict]]:
    """The rows of all sections of the report; docs is read once and kept for its dozen small aggregates."""
    trials = report.trials_frame(docs).persist()
    labels = labelled(trials).persist()
    try:
        matrix = report.agent_benchmarks(trials)
        frames = {
            "corpus": report.corpus_stats(trials), "status": stats.status_counts(trials), "category_rates": report.category_rates(labels, trials).orderBy(F.desc("n"), "category_name"),
            "by_config": report.category_by(labels, "config_name").orderBy("config_name", F.desc("n"), "category_name"),
            "by_benchmark": report.category_by(labels, "benchmark").orderBy(F.desc("slice_total"), "benchmark", F.desc("n"), "category_name"),
            "benchmarks": report.slices(trials, "benchmark").orderBy(F.desc("n"), "benchmark"), "benchmark_failures": report.top_failures(labels, "benchmark").orderBy("place"),
            "agents": report.agent_models(trials).orderBy(F.desc("n"), "label"), "agent_failures": report.top_failures(labels, "agent_name", "model").orderBy("place"),
            "agent_benchmark": matrix.orderBy("agent_name", "benchmark"), "divergences": report.divergences(matrix),
            "top_failures": report.top_categories(labels, "failure").orderBy(F.desc("n"), "category_name", "place"), "top_successes": report.top_categories(labels, "success").orderBy(F.desc("n"), "category_name", "place"),
            "dimensions": report.dimension_rollup(labels).orderBy("dimension"), "phi": report.phi_matrix(labels, trials).orderBy("a", "b"),
            "paired": report.paired_deltas(labels).orderBy(F.desc("shared"), "cfg_a", "cfg_b", "place"),
        }
        return {name: _rows(df) for name, df in frames.items()}
    finally:
        labels.unpersist()
        trials.unpersist()


def _nested(rows: list[dict], outer: str, inner: str, value: Callable[[dict], object]) -> dict:
    out: dict = {}
    for r in rows:
        out.setdefault(r[outer], {})[r[inner]] = value(r)
    return out


def _slice(r: dict, failures: list[dict], *by: str) -> dict:
    top = [{"name": f["category_name"], "count": f["n"]} for f in failures if all(f[k] == r[k] for k in by)]
    return {"n_trials": r["n"], "passed": r["passed"], "pass_rate": r["pass_rate"], "mean_reward": r["mean_reward"], "mean_trajectory_length": r["mean_trajectory_length"], "mean_total_turns": r["mean_turns"], "top_failures": top}


def payload(data: dict[str, list[dict]], generated_at: str) -> dict:
    """The report's JSON document: 12 keys, and a summary of the annotations' statuses where they have any."""
    corpus, status = data["corpus"][0], data["status"][0]
    cell = lambda r: {"pass_rate": r["pass_rate"], "n_trials": r["n"], "low_confidence": r["low_confidence"]}
    agents = lambda bench: sorted(({"agent": r["agent_name"]} | cell(r) for r in data["agent_benchmark"] if r["benchmark"] == bench), key=lambda c: (-c["pass_rate"], c["agent"]))
    pairs: dict = {}
    for r in data["paired"]:  # a delta counts for the second configuration
        p = pairs.setdefault((r["cfg_a"], r["cfg_b"]), {"config_a": r["cfg_a"], "config_b": r["cfg_b"], "shared_tasks": r["shared"], "introduced_by_a": [], "introduced_by_b": []})
        p["introduced_by_b" if r["delta"] > 0 else "introduced_by_a"].append({"category": r["category_name"], "delta": abs(r["delta"])})
    out = {
        "generated_at": generated_at,
        "corpus_stats": {"total_trials": corpus["total"]} | {k: corpus[k] for k in ("passed", "failed", "pass_rate", "avg_reward", "configs", "benchmarks")},
        "category_counts": {r["category_name"]: {"count": r["n"], "denominator": r["denominator"], "rate": r["rate"]} for r in data["category_rates"]},
        "category_by_config": _nested(data["by_config"], "config_name", "category_name", lambda r: r["n"]),
        "category_by_suite": _nested(data["by_benchmark"], "benchmark", "category_name", lambda r: r["n"]),
        "paired_comparisons": list(pairs.values()),
        "co_occurrence": _nested(data["phi"], "a", "b", lambda r: r["value"]),
        "dimension_summary": {r["dimension"]: {"failure_rate": r["failure_rate"], "trial_count": r["trials"]} for r in data["dimensions"]},
        "per_benchmark_summary": [{"benchmark": r["benchmark"]} | _slice(r, data["benchmark_failures"], "benchmark") for r in data["benchmarks"]],
        "per_agent_summary": [{"agent": r["agent_name"], "model": r["model"], "label": r["label"]} | _slice(r, data["agent_failures"], "agent_name", "model") for r in data["agents"]],
        "agent_benchmark_matrix": _nested(data["agent_benchmark"], "agent_name", "benchmark", cell),
        "top_divergences": [
            {"benchmark": r["benchmark"], "max_delta": r["max_delta"], "pair_a": r["high_agent"], "pair_b": r["low_agent"], "pair_a_rate": r["high_rate"], "pair_b_rate": r["low_rate"], "all_agents": agents(r["benchmark"])}
            for r in data["divergences"]
        ],
    }
    counted = {k: status[k] for k in ("ok", "no_categories", "error")}
    return out | ({"annotation_summary": counted | {"total": status["total"]}} if any(counted.values()) else {})


_percent = "{:.1%}".format
_count = "{:,}".format


def _outcomes(title: str, key: str, rows: list[dict]) -> list[str]:
    mean = lambda v, places: "—" if v is None else f"{v:.{places}f}"
    table = [
        {key.capitalize(): r["label" if key == "agent" else key], "Trials": _count(r["n_trials"]), "Passed": _count(r["passed"]), "Pass Rate": _percent(r["pass_rate"]), "Mean Reward": mean(r["mean_reward"], 4),
         "Mean Trajectory Length": mean(r["mean_trajectory_length"], 2), "Top Failures": ", ".join(f"{f['name']} ({f['count']})" for f in r["top_failures"]) or "—"}
        for r in rows
    ]
    return [f"## {title}", md_table(table) if table else "No trials."]


def _frequencies(title: str, denominator: str, rows: list[dict]) -> list[str]:
    polarity = {c["name"]: c["polarity"] for c in taxonomy.CATEGORIES}
    table = [{"#": i, "Category": r["category_name"], "Polarity": polarity.get(r["category_name"], "unknown"), "Count": _count(r["n"]), "Rate": _percent(r["rate"])} for i, r in enumerate(rows, 1)]
    return [f"## {title}", *([f"Denominator: {_count(rows[0]['denominator'])} {denominator}", md_table(table)] if rows else [f"No {title.lower()} found."])]


def _counted(categories: dict[str, int]) -> str:
    return md_table([{"Category": k, "Count": _count(n)} for k, n in categories.items()])


def _examples(title: str, rows: list[dict]) -> list[str]:
    out = [f"## {title}"]
    for name, of in itertools.groupby(rows, key=lambda r: r["category_name"]):
        some = list(of)
        tell = lambda r: f"- **{r.get('task_id') or 'unknown'}** (config: {r.get('config_name') or 'unknown'}, reward: {r.get('reward') or 0:.2f}): {cell(r.get('evidence') or '')}"
        out += [f"### {name} ({_count(some[0]['n'])} trials)", "\n".join(map(tell, some))]
    return out if rows else [*out, "None in this corpus."]


def markdown(data: dict[str, list[dict]], told: dict) -> str:
    """The report for readers, from its rows and its JSON document: headline slices first, then categories, then examples."""
    c = told["corpus_stats"]
    figures = {"Total annotated trials": _count(c["total_trials"]), "Passed": _count(c["passed"]), "Failed": _count(c["failed"]), "Pass rate": _percent(c["pass_rate"]), "Average reward": f"{c['avg_reward']:.4f}", "Configs": len(c["configs"]), "Benchmarks": len(c["benchmarks"])}
    parts = ["# Reliability report", f"Generated: {told['generated_at']}", "## Corpus Statistics", md_table([{"Metric": k, "Value": v} for k, v in figures.items()])]
    if status := told.get("annotation_summary"):
        parts += ["## Annotation Quality", md_table([{"Status": k, "Count": _count(n), "Rate": _percent(n / max(1, status["total"]))} for k, n in status.items()])]
    parts += _outcomes("Per-Benchmark Summary", "benchmark", told["per_benchmark_summary"]) + _outcomes("Per-Agent Summary", "agent", told["per_agent_summary"])
    matrix, thin = told["agent_benchmark_matrix"], f"`†` marks cells of fewer than {report.LOW_CONFIDENCE} trials."
    shown = lambda x: "—" if x is None else _percent(x["pass_rate"]) + (" †" if x["low_confidence"] else "")
    parts += ["## Agent x Benchmark Matrix", f"Values are pass rates; {thin}", md_table([{"Agent": a} | {b: shown(row.get(b)) for b in c["benchmarks"] + (["unknown"] if any("unknown" in r for r in matrix.values()) else [])} for a, row in matrix.items()])]
    parts += ["## Top Divergences", md_table([{"Benchmark": r["benchmark"], "Delta": _percent(r["max_delta"]), "Higher": r["pair_a"], "Lower": r["pair_b"], "Higher Rate": _percent(r["pair_a_rate"]), "Lower Rate": _percent(r["pair_b_rate"])} for r in told["top_divergences"]]) or "No benchmarks with several agents."]
    parts += _frequencies("Trajectory-Dependent Categories", "trials with trajectory data", [r for r in data["category_rates"] if r["requires_trajectory"]])
    parts += _frequencies("Reward-Dependent Categories", "total trials", [r for r in data["category_rates"] if not r["requires_trajectory"]])
    parts += ["## Category Breakdown by Config", *(x for name, of in told["category_by_config"].items() for x in (f"### {name}", _counted(of)))]
    if told["paired_comparisons"]:
        parts.append("## Configuration Comparison (Paired)")
        for p in told["paired_comparisons"]:
            parts.append(f"### {p['config_a']} vs {p['config_b']} ({p['shared_tasks']} shared tasks)")
            for side in "ab":
                if more := p[f"introduced_by_{side}"]:
                    parts += [f"**More frequent in {p['config_' + side]}:**", md_table([{"Category": x["category"], "Delta": f"+{x['delta']}"} for x in more])]
    parts.append("## Category Breakdown by Benchmark Suite (Top 10)")
    for name, of in itertools.islice(told["category_by_suite"].items(), 10):
        parts += [f"### {name} ({_count(sum(of.values()))} annotations)", _counted(dict(itertools.islice(of.items(), 8)))]
    dimensions = sorted(data["dimensions"], key=lambda r: -r["trials"])
    parts += ["## Dimension Summary", md_table([{"Dimension": r["dimension"], "Trial Count": _count(r["trials"]), "Failure Rate": _percent(r["failure_rate"])} for r in dimensions])] if dimensions else []
    parts += _examples("Top Failure Categories", data["top_failures"]) + _examples("Success Mode Summary", data["top_successes"])
    return "\n\n".join(x for x in parts if x) + "\n"


def write(docs: DataFrame, out_dir: str) -> tuple[str, str]:
    """report.md and report.json."""
    data = collect(docs)
    told = payload(data, datetime.now(UTC).isoformat())
    os.makedirs(out_dir, exist_ok=True)
    paths = f"{out_dir}/report.md", f"{out_dir}/report.json"
    for path, text in zip(paths, (markdown(data, told), json.dumps(told, indent=2, ensure_ascii=False, default=str)), strict=True):
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return paths


def agreement_markdown(per: DataFrame, means: DataFrame) -> str:
    return "\n\n".join(["# Agreement", md_table(_rows(means.orderBy("annotator_a", "annotator_b"))), md_table(_rows(per.orderBy("annotator_a", "annotator_b", "category_name")))]) + "\n"


def calibration_markdown(scores: DataFrame, ece: DataFrame, brier: DataFrame, binned: DataFrame) -> str:
    gap = binned.groupBy("category_name").agg((F.sum("confidence_sum") / F.sum("n")).alias("c"), (F.sum("observed_sum") / F.sum("n")).alias("o"))
    rows = scores.join(ece.select("category_name", "ece"), "category_name", "left").join(brier.select("category_name", "brier"), "category_name", "left").join(gap, "category_name", "left")
    rows = rows.withColumn("direction", direction(F.col("c"), F.col("o"))).drop("c", "o")
    return "# Calibration\n\n" + md_table(_rows(rows.orderBy("category_name"))) + "\n"


def cross_model_markdown(per: DataFrame) -> str:
    return f"# Two annotators\n\nCalibrated from a kappa of {CALIBRATED_KAPPA}.\n\n" + md_table(_rows(per.orderBy("category_name"))) + "\n"


def evaluation_markdown(scores: DataFrame) -> str:
    return "# Classifier\n\n" + md_table(_rows(scores.orderBy("category_name"))) + "\n"
