"""The batch runner's limits, retries and times, and the cache of replies."""

import os
import time

from lodestone.operators.annotators import Limits, ReplyCache, annotate, keyed


class Recorder:
    """Writes when each call began and ended; fails a prompt's first calls as the prompt says."""

    def __init__(self, root):
        self.root, self.calls = root, {}

    def __call__(self, prompt, model):
        n = self.calls[prompt] = self.calls.get(prompt, 0) + 1
        began = time.time()
        time.sleep(0.05)
        with open(f"{self.root}/{os.getpid()}-{began!r}-{prompt}", "w") as f:
            f.write(repr(time.time()))
        if n <= int(prompt.split()[-1]):
            raise ConnectionError("busy")
        return '{"categories": [{"name": "near_miss"}]}'


def calls(root):
    return sorted((float(f.split("-")[1]), float(open(f"{root}/{f}").read()), f.split("-")[0], f.split("-")[2]) for f in os.listdir(root))


def prompts(spark, fails):
    return spark.createDataFrame([(f"t{i}", f"p{i} {n}") for i, n in enumerate(fails)], "trial_id string, prompt string")


def test_limits_are_never_exceeded(spark, tmp_path):
    root = str(tmp_path)
    limits = Limits(workers=2, in_flight=3, per_second=20, attempts=3, pause=0.01)
    out = {r["trial_id"]: r for r in annotate(prompts(spark, [0] * 20 + [2, 2, 5, 0]), "m", lambda: Recorder(root), limits=limits).collect()}
    assert [out[f"t{i}"]["status"] for i in (0, 20, 21, 23)] == ["ok"] * 4 and out["t22"]["status"] == "error" and "busy" in out["t22"]["error"]
    made = calls(root)
    assert len(made) == 21 + 3 * 3
    for worker in {w for _, _, w, _ in made}:
        own = [(a, b) for a, b, w, _ in made if w == worker]
        assert max(sum(a <= t < b for a, b in own) for t, _ in own) <= 3  # in flight
        starts = sorted(a for a, _ in own)
        assert all(b - a >= (i + 1) * 0.1 - 0.03 for i in range(3) for a, b in zip(starts, starts[i + 1 :], strict=False))  # ten a second each


def test_a_prompt_has_its_time(spark, tmp_path):
    root = str(tmp_path)
    r = annotate(prompts(spark, [9]), "m", lambda: Recorder(root), limits=Limits(workers=1, attempts=50, pause=0.2, seconds=0.9)).first()
    assert r["status"] == "error" and 1 < len(calls(root)) < 5


def test_replies_are_asked_for_once(spark, tmp_path):
    asked, root = str(tmp_path / "asked"), str(tmp_path / "cache")
    os.makedirs(asked)
    cache, limits = ReplyCache(spark, root), Limits(workers=2, attempts=1)
    first = keyed(prompts(spark, [0, 0, 1]), "m")
    out = annotate(first, "m", lambda: Recorder(asked), cache.of(first), limits=limits).collect()
    assert sorted(r["status"] for r in out) == ["error", "ok", "ok"] and not any(r["cached"] for r in out)
    done = spark.createDataFrame([(r["cache_key"], r["reply"]) for r in out if r["error"] is None], "cache_key string, reply string")
    cache.add(done)
    cache.add(done)  # adding twice adds once
    assert cache.read().count() == 2
    again = keyed(prompts(spark, [0, 0, 1, 0]), "m")
    out = {r["trial_id"]: r for r in annotate(again, "m", lambda: Recorder(asked), cache.of(again), limits=limits).collect()}
    assert [out[f"t{i}"]["cached"] for i in range(4)] == [True, True, False, False] and len(calls(asked)) == 3 + 2  # the error and the new one
    assert out["t0"]["categories"] == out["t3"]["categories"] and cache.of(keyed(prompts(spark, [0]), "other model")).join(again, "cache_key").count() == 0
    one = again.filter("trial_id = 't0'")
    plan = spark._jvm.PythonSQLUtils.explainString(cache.of(one)._jdf.queryExecution(), "formatted")
    filters = next(line for line in plan.splitlines() if line.startswith("PartitionFilters"))
    assert f"= {one.first()['cache_key'][:2]})" in filters  # files of other parts are not opened
