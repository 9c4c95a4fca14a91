"""Classifiers for categories: features, training, cross-validation, prediction, ensembles and blended labels."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import taxonomy
from ..functions.columns import dot, safe_ratio, sigmoid
from ..schemas import MODEL_VERSION
from ..session import written
from .stats import with_scores

# The features in order; those that signals lack count as 0.
FEATURES = (
    "reward", "passed", "exception_crashed", "tool_calls_total", "trajectory_length", "input_tokens", "output_tokens", "cost_usd", "duration_seconds", "search_calls_keyword",
    "search_calls_nls", "search_calls_deepsearch", "mcp_ratio", "ttfr", "query_churn_count", "edit_verify_cycles", "repeated_tool_failures", "has_code_nav_tools",
    "has_semantic_search", "has_git_tools", "has_trajectory",
)
#: Categories that stay with the rules in an ensemble.
RULES_ONLY = ("exception_crash", "rate_limited_run", "edit_verify_loop_failure")
LEAST_STD = 1e-8
#: Partial sums that the driver adds up; those of more tasks are brought together by tasks first.
TOGETHER = 64

MODEL = "category string, weights array<double>, bias double, means array<double>, stds array<double>, n_positive long, n_negative long, train_f1 double, eval_f1 double, eval_precision double, eval_recall double, cv_ece double, cv_status string"


def features(signals: DataFrame, names: tuple[str, ...] = FEATURES) -> Column:
    """The feature vector of a trial."""
    have = set(signals.columns)
    return F.array(*[F.coalesce(F.col(n).try_cast("double") if dict(signals.dtypes).get(n) != "boolean" else F.col(n).cast("double"), F.lit(0.0)) if n in have else F.lit(0.0) for n in names])


def scaling(df: DataFrame, vector: str = "x", n: int = len(FEATURES)) -> DataFrame:
    """Means and population deviations of all features, in one pass."""
    at = lambda f: F.array(*[f(F.col(vector)[i]) for i in range(n)])
    return df.agg(at(F.avg).alias("means"), at(lambda c: F.greatest(F.stddev_pop(c), F.lit(LEAST_STD))).alias("stds"))


class _Models:
    """Every model that is fitted at once: of each category one on all trials, and one for each fold on the others' trials."""

    def __init__(self, folds: list[int]) -> None:
        of = [(c, f) for c, k in enumerate(folds) for f in range(-1, k)]
        self.category, self.fold = (np.array(x, t) for x, t in zip(zip(*of, strict=True), (int, np.int8), strict=True))
        self.whole = self.fold < 0

    def fitted(self, fold: np.ndarray) -> np.ndarray:
        """Which rows belong to which model's training, by their folds in each category."""
        return fold[:, self.category] != self.fold


def _block(x: np.ndarray, y: np.ndarray, fold: np.ndarray, times: np.ndarray) -> bytes:
    """Rows as bytes: features, how many trials each stands for, whether a category's label is there, and the fold in each category."""
    return np.array([*x.shape, y.shape[1]], np.int64).tobytes() + b"".join(v.astype(t).tobytes() for v, t in ((x, np.float64), (times, np.float64), (y, bool), (fold, np.int8)))


def _pieces(raw: bytes, models: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A block's rows in pieces, of which an array with a number for each row and model fits into a core's cache."""
    n, d, c = np.frombuffer(raw, np.int64, 3)
    x = np.frombuffer(raw, np.float64, n * d, 24).reshape(n, d)
    times = np.frombuffer(raw, np.float64, n, at := 24 + 8 * n * d)
    y = np.frombuffer(raw, bool, n * c, at := at + 8 * n).reshape(n, c)
    fold = np.frombuffer(raw, np.int8, n * c, at + n * c).reshape(n, c)
    rows = max(64, 30_000 // models)
    for i in range(0, n, rows):
        yield x[i : i + rows], y[i : i + rows], fold[i : i + rows], times[i : i + rows]


@lru_cache(maxsize=4)
def _room(rows: int, models: int) -> np.ndarray:
    """Two arrays that every piece uses again: to get new ones from the system takes as long as half of the arithmetic."""
    return np.empty((2, rows, models))


def _sizes(x, y, fold, times, m: _Models, _) -> np.ndarray:
    """Rows and positive rows of each model, and the sums of its features."""
    t = m.fitted(fold) * times[:, None]
    return np.column_stack([t.sum(0), (t * y[:, m.category]).sum(0), t.T @ x])


def _squares(x, y, fold, times, m: _Models, means) -> np.ndarray:
    """Squared distances from each model's means."""
    v, t = _room(len(x), len(m.fold))
    np.multiply(m.fitted(fold), times[:, None], out=t)
    out = np.empty_like(means)
    for j in range(x.shape[1]):
        np.subtract(x[:, j, None], means[:, j], out=v)
        v *= v
        v *= t
        v.sum(0, out=out[:, j])
    return out


def _gradient(x, y, fold, times, m: _Models, state) -> np.ndarray:
    """Sums of the class-weighted logistic loss's gradient by the features as they are, and by the constant."""
    w, b, positive, negative = state
    of = y[:, m.category]
    g, v = _room(len(x), len(m.fold))
    np.matmul(x, w.T, out=g)
    g += b
    _sigmoid(g)
    g -= of
    v[:] = negative
    np.copyto(v, positive, where=of)
    g *= v
    g *= m.fitted(fold)
    return np.column_stack([times @ g, g.T @ (x * times[:, None])])


def _outcome(x, y, fold, times, m: _Models, state) -> np.ndarray:
    """Of each model's own rows (all of the whole one, the held-back ones of a fold): hits, predicted, positive, and sums of score and label by bin."""
    w, b, bins = state
    p, of = _sigmoid(x @ w.T + b), y[:, m.category]
    own = (m.whole | ~m.fitted(fold)) * times[:, None]
    hit = (p >= 0.5) * own
    place = np.minimum((p * bins).astype(int), bins - 1) + bins * np.arange(len(m.fold))
    by_bin = lambda v: np.bincount(place.ravel(), v.ravel(), bins * len(m.fold)).reshape(-1, bins)
    each = np.stack([by_bin(p * own), by_bin(of * own)], axis=2).reshape(len(m.fold), -1)
    return np.column_stack([(hit * of).sum(0), hit.sum(0), (of * own).sum(0), own.sum(0), each])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    """In the place of its argument."""
    np.negative(z, out=z)
    np.exp(np.clip(z, -500, 500, out=z), out=z)
    z += 1
    return np.reciprocal(z, out=z)


def _fit(sums: Callable, m: _Models, d: int, rate: float, epochs: int, l2: float, bins: int = 10) -> dict[str, np.ndarray]:
    """Full-batch gradient descent of all models from zero; sums(f, state) adds f up over all rows, wherever they are.

    Features are scaled by each model's own rows. The rows stay as they are: the weights are turned to the rows' scale before an epoch
    and the gradient back after it. A feature that does not vary in a model's rows has no weight in it.
    """
    n, positive, total = np.split(sums(_sizes, None), [1, 2], axis=1)
    means = total / n
    stds = np.sqrt(sums(_squares, means) / n)
    varies = stds > LEAST_STD
    stds = np.maximum(stds, LEAST_STD)
    w, b, n, positive = np.zeros((len(n), d)), np.zeros(len(n)), n[:, 0], positive[:, 0]
    weights = n / (2 * np.maximum(positive, 1)), n / (2 * np.maximum(n - positive, 1))
    plain = lambda: (np.where(varies, w / stds, 0.0), b - np.where(varies, means * w / stds, 0.0).sum(1))
    for _ in range(epochs):
        g0, g = np.split(sums(_gradient, (*plain(), *weights)), [1], axis=1)
        g = np.where(varies, (g - means * g0) / stds, 0.0)
        w -= rate * (g / n[:, None] + l2 * w)
        b -= rate * g0[:, 0] / n
    return {"weights": w, "bias": b, "means": means, "stds": stds, "n": n, "positive": positive, "outcome": sums(_outcome, (*plain(), bins))}


def _prf(tp: float, predicted: float, positive: float) -> tuple[float, float, float]:
    precision, recall = float(tp / max(predicted, 1)), float(tp / max(positive, 1))
    return precision, recall, 2 * precision * recall / (precision + recall) if tp else 0.0


def _rows(names: list[str], m: _Models, fit: dict[str, np.ndarray], shift: np.ndarray) -> list[tuple]:
    """A row of MODEL for each category."""
    out = []
    for c, name in enumerate(names):
        whole, of = (np.flatnonzero((m.category == c) & (m.whole == x)) for x in (True, False))
        i, (tp, predicted, positive, n) = whole[0], fit["outcome"][whole[0], :4]
        cv: tuple = (None, None, None, None, "insufficient_data")
        if len(of):
            held = fit["outcome"][of].sum(0)
            precision, recall, f1 = _prf(*held[:3])
            cv = (f1, precision, recall, float(np.abs(held[4::2] - held[5::2]).sum() / held[3]), "ok")
        numbers = [fit[k][i].tolist() for k in ("weights", "bias")] + [(fit["means"][i] + shift).tolist(), fit["stds"][i].tolist()]
        out.append((name, *numbers, int(positive), int(n - positive), _prf(tp, predicted, positive)[2], *cv))
    return out


def train(labels: DataFrame, signals: DataFrame, *, min_positive: int = 3, rate: float = 0.1, epochs: int = 500, l2: float = 0.01, folds: int = 5, categories: tuple[str, ...] | None = None, block_rows: int = 65_536) -> DataFrame:
    """A model row for each category that has enough positive trials and is not derived from the reward.

    labels: trial_id, category_name; every labelled trial counts as judged and is trained on, in every category. Trials of the same id
    that are equal in all features are one row with their number. Rows are kept as blocks of numbers in the shared folder; each epoch is
    one pass over them that sums up the gradients of all categories and folds at once, in the tasks, then over the tasks: the driver gets
    TOGETHER partial sums or, of more tasks, about as many as their root. Rows that fit into one block are descended on in its task by the same code. Folds are stretches of the
    order of a hash, of equal length for either label.
    """
    spark = signals.sparkSession
    wanted = labels.filter(~F.col("category_name").isin(*sorted(taxonomy.DERIVED)))
    if categories:
        wanted = wanted.filter(F.col("category_name").isin(*categories))
    wanted = wanted.select("trial_id", "category_name").distinct()
    # the taxonomy bounds the number of categories
    names = sorted(r[0] for r in wanted.groupBy("category_name").count().filter(F.col("count") >= min_positive).collect())
    if not names:
        return spark.createDataFrame([], MODEL)
    judged = labels.select("trial_id").distinct()
    has = wanted.filter(F.col("category_name").isin(*names)).groupBy("trial_id").agg(F.collect_set("category_name").alias("has"))  # at most all categories
    x = signals.select("trial_id", features(signals).alias("x")).join(judged, "trial_id").join(has, "trial_id", "left")
    # percentiles are computed as doubles: 52 bits of the hash
    x = written(x.select(F.shiftright(F.xxhash64("trial_id"), 12).alias("h"), "x", *[F.coalesce(F.array_contains("has", n), F.lit(False)).alias(f"y{i}") for i, n in enumerate(names)]), "train-rows")
    y = [F.col(f"y{i}") for i in range(len(names))]
    merged = written(x.groupBy(*x.columns).agg(F.count(F.lit(1)).alias("times")), "train-merged")
    of_all = [F.count(F.lit(1)), F.sum("times"), F.array(*[F.min(F.col("x")[i]) for i in range(len(FEATURES))]), F.array(*[F.sum(F.when(c, F.col("times")).otherwise(0)) for c in y])]
    different, rows, shift, positives = merged.agg(*of_all).first()
    shift = np.array(shift, float)
    if not rows:
        return spark.createDataFrame([], MODEL)
    k = [max(2, min(folds, p, rows - p)) if min(p, rows - p) >= 2 else 0 for p in positives]
    # where folds end in the order of hashes, for each category and label
    ends = lambda c, n: F.percentile_approx(F.when(c, F.col("h")), [i / n for i in range(1, n)], 10_000)
    cuts = x.agg(F.array(*[F.struct(ends(~c, max(2, n)), ends(c, max(2, n))) for c, n in zip(y, k, strict=True)])).first()[0]
    cuts = [[np.array(e or [], np.int64) if n else np.empty(0, np.int64) for e in pair] for pair, n in zip(cuts, k, strict=True)]
    m, d = _Models(k), len(FEATURES)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        packed = lambda: pa.RecordBatch.from_pydict({"block": [_block(*map(np.concatenate, zip(*held, strict=True)))]})
        for b in batches:
            h, numbers = b.column(0).to_numpy(), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), d)
            has = np.column_stack([b.column(2 + i).to_numpy(zero_copy_only=False).astype(np.uint8) for i in range(len(names))])
            fold = np.column_stack([np.where(has[:, i], np.searchsorted(c[1], h), np.searchsorted(c[0], h)) for i, c in enumerate(cuts)])
            held.append((numbers - shift, has, fold, b.column("times").to_numpy()))
            if sum(len(x[0]) for x in held) >= block_rows:
                yield packed()
                held = []
        if held:
            yield packed()

    if different <= block_rows:
        fit = _fit_in_task(written(merged.repartition(1).mapInArrow(pack, "block binary"), "train-blocks"), m, d, rate, epochs, l2)
    else:
        cores = spark.sparkContext.defaultParallelism
        tasks = -(-different // (block_rows * cores)) * cores  # as many for each core
        blocks = written(merged.repartition(tasks, "h").mapInArrow(pack, "block binary"), "train-blocks").rdd.map(lambda r: bytes(r[0])).persist(StorageLevel.MEMORY_AND_DISK)
        fit = _fit(_summing(blocks, m), m, d, rate, epochs, l2)
        blocks.unpersist()
    return spark.createDataFrame(_rows(names, m, fit, shift), MODEL)


def _add_up(blocks: Iterable[bytes], f: Callable, m: _Models, state) -> np.ndarray | None:
    total = None
    for raw in blocks:
        for piece in _pieces(raw, len(m.fold)):
            part = f(*piece, m, state)
            total = part if total is None else total + part
    return total


def _summing(blocks: RDD, m: _Models) -> Callable:
    """Sums over all blocks: in the tasks, then over them. A job of an RDD starts in a tenth of the time of a grouped query, and each epoch is one."""
    depth = 1 if blocks.getNumPartitions() <= TOGETHER else 2

    def sums(f: Callable, state) -> np.ndarray:
        shared = blocks.context.broadcast(state)

        def run(held: Iterator[bytes]) -> list[np.ndarray]:
            total = _add_up(held, f, m, shared.value)
            return [] if total is None else [total]

        found = blocks.mapPartitions(run).treeReduce(add, depth)
        shared.destroy()
        return found

    return sums


def _fit_in_task(blocks: DataFrame, m: _Models, d: int, rate: float, epochs: int, l2: float) -> dict[str, np.ndarray]:
    """The same descent where there is one block: nothing has to be brought together between epochs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [raw.as_py() for b in batches for raw in b.column(0)]
        if held:
            fit = _fit(lambda f, state: _add_up(held, f, m, state), m, d, rate, epochs, l2)
            yield pa.RecordBatch.from_pydict({"name": list(fit), "shape": [list(v.shape) for v in fit.values()], "values": [v.ravel().astype(float) for v in fit.values()]})

    found = blocks.coalesce(1).mapInArrow(run, "name string, shape array<long>, values array<double>").collect()
    return {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in found}


def save(model: DataFrame, path: str) -> None:
    rows = [r.asDict() for r in model.orderBy("category").collect()]  # a row for each category
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"schema_version": MODEL_VERSION, "feature_names": list(FEATURES), "categories": rows}, f, indent=2)


def load(spark: SparkSession, path: str) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        rows = json.load(f)["categories"]
    names = [c.split(" ")[0] for c in MODEL.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], MODEL)


def probabilities(signals: DataFrame, model: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """(trial_id, category, probability) for every trial and category; the model has at most a row for each category."""
    x = signals.select("trial_id", features(signals, names).alias("x"))
    z = F.zip_with(F.zip_with("x", "means", lambda a, m: a - m), "stds", lambda a, s: a / s)
    return x.crossJoin(F.broadcast(model)).select("trial_id", "category", sigmoid(dot(z, F.col("weights")) + F.col("bias")).alias("probability"))


def predict(signals: DataFrame, model: DataFrame, threshold: float = 0.5) -> DataFrame:
    p = probabilities(signals, model).filter(F.col("probability") >= threshold)
    return p.select("trial_id", F.col("category").alias("category_name"), F.bround("probability", 4).alias("confidence"))


def evaluate(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    """Confusion counts and scores of each category over all judged trials."""
    p = predicted.select("trial_id", "category_name").distinct().withColumn("p", F.lit(1))
    g = labels.select("trial_id", "category_name").distinct().withColumn("g", F.lit(1))
    both = p.join(g, ["trial_id", "category_name"], "full")
    x, y = F.coalesce("p", F.lit(0)), F.coalesce("g", F.lit(0))
    return with_scores(both.groupBy("category_name").agg(F.sum(x * y).alias("tp"), F.sum(x * (1 - y)).alias("fp"), F.sum((1 - x) * y).alias("fn")))


def trusted(model: DataFrame, min_f1: float = 0.7, max_ece: float | None = None) -> DataFrame:
    """Categories whose cross-validated scores are good enough; without such scores none is."""
    ok = (F.col("cv_status") == "ok") & (F.col("eval_f1") >= min_f1) & ~F.col("category").isin(*RULES_ONLY)
    if max_ece is not None:
        ok = ok & (F.col("cv_ece") <= max_ece)
    return model.filter(F.coalesce(ok, F.lit(False)))


def ensemble(ruled: DataFrame, predicted: DataFrame) -> DataFrame:
    """Rules for their own categories, the classifier's trusted ones for the rest; each row says which tier it is from.

    ruled, predicted: trial_id, category_name, confidence.
    """
    own = ruled.filter(F.col("category_name").isin(*RULES_ONLY)).select("trial_id", "category_name", "confidence", F.lit("heuristic").alias("tier"))
    rest = predicted.filter(~F.col("category_name").isin(*RULES_ONLY)).select("trial_id", "category_name", "confidence", F.lit("classifier").alias("tier"))
    return own.unionByName(rest)


def tier_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


#: Categories whose rules depend on named signals only: what blending trusts the rules with by default.
TRUSTED_RULES = tuple(c["name"] for c in taxonomy.CATEGORIES if c["signal_dependencies"])


def blend(ruled: DataFrame, judged: DataFrame, trust: tuple[str, ...] = TRUSTED_RULES, cap: int | None = None) -> DataFrame:
    """Labels of a model and of the rules in one: all of the model's, and the rules' trusted ones besides.

    ruled, judged: trial_path, category_name, confidence; judged may carry status, whose errors drop the trial's rows. Trials that
    only the rules know come in order of path, up to a cap if one is given (a parameter of the labelling budget).
    """
    if "status" in judged.columns:
        judged = judged.filter(F.coalesce("status", F.lit("ok")) != "error").drop("status")
    judged = judged.filter(F.coalesce("trial_path", F.lit("")) != "")
    ruled = ruled.filter((F.coalesce("trial_path", F.lit("")) != "") & F.col("category_name").isin(*trust))
    seen = judged.select("trial_path").distinct().withColumn("known", F.lit(True))
    more = ruled.join(seen, "trial_path", "left")
    if cap is not None:
        only = more.filter("known is null").select("trial_path").distinct().orderBy("trial_path").limit(cap).withColumn("allowed", F.lit(True))
        more = more.join(only, "trial_path", "left").filter("known or allowed").drop("allowed")
    both = judged.select("trial_path", "category_name", "confidence", F.lit("llm").alias("source")).unionByName(more.select("trial_path", "category_name", "confidence", F.lit("heuristic").alias("source")))
    w = W.partitionBy("trial_path", "category_name").orderBy(F.desc("source"), F.desc("confidence"))
    return both.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def macro(scores: DataFrame) -> DataFrame:
    return scores.agg(*[F.avg(F.bround(c, 4)).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], safe_ratio(2 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn")).alias("micro_f1"))
