"""Classifiers trained on all rows, against a plain descent over one matrix."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import model


def fixture(spark, n=300):
    """Trials with varied, constant, nearly constant and large features, and categories of many sizes."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        reward = float(rng.random())
        rows.append((f"t{i}", reward, reward > 0.5, int(rng.integers(0, 40)), int(rng.integers(1, 40)), float(rng.lognormal(10, 2)), 7.25, i == 3, i != 5))
    rows = [tuple(x.item() if hasattr(x, 'item') else x for x in r) for r in rows]
    s = spark.createDataFrame(rows, "trial_id string, reward double, passed boolean, tool_calls_total long, trajectory_length long, input_tokens double, cost_usd double, has_git_tools boolean, has_trajectory boolean")
    labels = [(f"t{i}", "retrieval_failure") for i, r in enumerate(rows) if r[1] + rng.normal(0, 0.2) > 0.6]
    labels += [(f"t{i}", "query_churn_failure") for i in range(n) if i % 100 == 3] + [(f"t{i}", "edit_verify_loop_failure") for i in range(n) if rows[i][3] > 20]
    labels += [(f"t{i}", "over_exploration") for i in range(n)] + [("t1", "rate_limited_run"), ("t1", "retrieval_failure"), ("nobody", "retrieval_failure")] + [(f"t{i}", "clean_success") for i in range(n)]
    return s, spark.createDataFrame(labels, "trial_id string, category_name string")


def descend(x, y, rate=0.1, epochs=500, l2=0.01):
    mean, std = x.mean(0), np.maximum(x.std(0), model.LEAST_STD)
    z, w, b = (x - mean) / std, np.zeros(x.shape[1]), 0.0
    z[:, x.std(0) <= model.LEAST_STD] = 0
    weight = np.where(y == 1, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max(len(y) - y.sum(), 1)))
    for _ in range(epochs):
        g = weight * (1 / (1 + np.exp(-(z @ w + b))) - y)
        w -= rate * (z.T @ g / len(y) + l2 * w)
        b -= rate * g.mean()
    return w, b, mean, std


def plain(spark, s, labels, epochs, folds=5):
    rows = s.select("trial_id", F.shiftright(F.xxhash64("trial_id"), 12).alias("h"), model.features(s).alias("x")).join(labels.select("trial_id").distinct(), "trial_id").collect()
    has = {(r[0], r[1]) for r in labels.collect()}
    x, h = np.array([r["x"] for r in rows]), np.array([r["h"] for r in rows])
    out = {}
    for name in {c for _, c in has} - model.taxonomy.DERIVED:
        y = np.array([(r["trial_id"], name) in has for r in rows], float)
        if y.sum() < 3:
            continue
        w, b, mean, std = descend(x, y, epochs=epochs)
        k = max(2, min(folds, int(y.sum()), int(len(y) - y.sum())))
        cv = None
        if min(y.sum(), len(y) - y.sum()) >= 2:
            fold, p = np.zeros(len(y), int), np.zeros(len(y))
            for label in (0, 1):
                at = np.flatnonzero(y == label)[np.argsort(h[y == label])]
                ends = [math.ceil(i / k * len(at)) for i in range(1, k)]
                fold[at] = [sum(e < r for e in ends) for r in range(1, len(at) + 1)]
            for i in range(k):
                wi, bi, m, d = descend(x[fold != i], y[fold != i], epochs=epochs)
                keep = x[fold != i].std(0) > model.LEAST_STD
                p[fold == i] = 1 / (1 + np.exp(-(((x[fold == i] - m) / d)[:, keep] @ wi[keep] + bi)))
            tp = ((p >= 0.5) & (y == 1)).sum()
            at = np.minimum((p * 10).astype(int), 9)
            cv = (2 * tp / ((p >= 0.5).sum() + y.sum()), sum(abs(p[at == i].sum() - y[at == i].sum()) for i in range(10)) / len(p))
        out[name] = (w, b, mean, std, int(y.sum()), int(len(y) - y.sum()), cv)
    return out


@pytest.mark.parametrize(("block_rows", "epochs"), [(65_536, 500), (70, 25)])
def test_training_on_all_rows_equals_plain_descent(spark, block_rows, epochs):
    """In one block's task, and with partial sums of five blocks brought together in each epoch."""
    s, labels = fixture(spark)
    got = {r["category"]: r for r in model.train(labels, s, epochs=epochs, block_rows=block_rows).collect()}
    want = plain(spark, s, labels, epochs)
    assert set(got) == set(want) == {"retrieval_failure", "query_churn_failure", "edit_verify_loop_failure", "over_exploration", "clean_success"}
    for name, (w, b, mean, std, pos, neg, cv) in want.items():
        r = got[name]
        assert np.abs(np.array(r["weights"]) - w).max() < 1e-9 and abs(r["bias"] - b) < 1e-9, name
        assert np.allclose(r["means"], mean, rtol=1e-12) and np.allclose(r["stds"], std, rtol=1e-9, atol=1e-8)
        assert (r["n_positive"], r["n_negative"], r["cv_status"]) == (pos, neg, "ok" if cv else "insufficient_data")
        assert (r["eval_f1"], r["cv_ece"]) == (None, None) if cv is None else (r["eval_f1"], r["cv_ece"]) == pytest.approx(cv, abs=1e-9)
    assert got["over_exploration"]["cv_status"] == "insufficient_data" and 0.5 < got["retrieval_failure"]["eval_f1"] < 1


def test_equal_rows_of_a_trial_are_descended_on_once(spark, monkeypatch):
    """Three copies of 300 trials fit into a block of 300 rows, and count three times."""
    monkeypatch.setattr(model, "_summing", None)
    s, labels = fixture(spark)
    s = s.union(s).union(s.withColumn("reward", F.when(F.col("trial_id") == "t9", 0.125).otherwise(F.col("reward")))).cache()
    got = {r["category"]: r for r in model.train(labels, s, epochs=40, block_rows=301).collect()}
    want = plain(spark, s, labels, 40)
    assert set(got) == set(want) - {"rate_limited_run"}  # of one trial
    for name, r in got.items():
        w, b, _, _, pos, neg, _ = want[name]
        assert np.abs(np.array(r["weights"]) - w).max() < 1e-9 and abs(r["bias"] - b) < 1e-9, name
        assert (r["n_positive"], r["n_negative"], pos + neg) == (pos, neg, 900)


@pytest.mark.parametrize("together", [64, 2])
def test_an_epoch_is_one_job(spark, monkeypatch, together):
    """Whether the driver adds up the tasks' sums or tasks do so first."""
    monkeypatch.setattr(model, "TOGETHER", together, raising=False)
    s, labels = fixture(spark, 200)
    sc, count, found = spark.sparkContext, [], []
    for epochs in (2, 7):
        sc.setJobGroup(f"train-{together}-{epochs}", "")
        found.append({r["category"]: r["weights"] for r in model.train(labels, s, epochs=epochs, block_rows=50).collect()})
        count.append(len(sc.statusTracker().getJobIdsForGroup(f"train-{together}-{epochs}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert count[1] - count[0] == 5
    for name, (w, *_) in plain(spark, s, labels, 7).items():
        assert np.abs(np.array(found[1][name]) - w).max() < 1e-9


def test_training_takes_every_row(spark):
    """Nothing is sampled, and no row of features meets a row for each category."""
    s, labels = fixture(spark, 500)
    r = model.train(labels, s, epochs=1, block_rows=64).filter("category = 'retrieval_failure'").first()
    assert r["n_positive"] + r["n_negative"] == 500
    none = model.train(labels.limit(0), s)
    assert none.count() == 0 and "weights" in none.columns
    assert model.train(labels, s.limit(0)).count() == 0
