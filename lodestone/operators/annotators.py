"""Annotation by language models: the interface, a batch runner over partitions, and an offline stand-in. No network is used here."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..taxonomy import NAMES
from .textops import cache_key, parse_response, shorten


class Annotator(Protocol):
    """Answers prompts with a model's raw replies, from several threads at once; raising is an error of that prompt alone."""

    def __call__(self, prompt: str, model: str) -> str: ...


BACKENDS: dict[str, Callable[[], Annotator]] = {}


def register_backend(name: str, make: Callable[[], Annotator]) -> None:
    BACKENDS[name] = make


def backend(name: str) -> Callable[[], Annotator]:
    if name not in BACKENDS:
        raise ValueError(f"unknown backend {name}; known: {', '.join(sorted(BACKENDS)) or 'none'}")
    return BACKENDS[name]


class OfflineAnnotator:
    """Finds category names in the prompt's trajectory: deterministic, for tests and dry runs."""

    def __call__(self, prompt: str, model: str) -> str:
        body = prompt.rpartition("## Trajectory")[2].lower()
        found = [n for n in NAMES if n in body]
        return '{"categories": [' + ", ".join(f'{{"name": "{n}", "confidence": 0.6, "evidence": "named"}}' for n in found) + "]}"


register_backend("offline", OfflineAnnotator)


class Pace:
    """A token bucket: calls of all threads of a worker start no closer together than the rate allows."""

    def __init__(self, per_second: float) -> None:
        self.step, self.next, self.lock = 1 / per_second, 0.0, threading.Lock()

    def wait(self) -> None:
        with self.lock:
            at = max(self.next, time.monotonic())
            self.next = at + self.step
        time.sleep(max(0.0, at - time.monotonic()))


@dataclass(frozen=True)
class Limits:
    """Of a run: workers, calls in flight in each, calls a second of all together, attempts with a doubling pause between, seconds for a prompt."""

    workers: int = 8
    in_flight: int = 4
    per_second: float | None = None
    attempts: int = 3
    pause: float = 1.0
    seconds: float = 600.0


def _patiently(annotator: Annotator, prompt: str, model: str, limits: Limits, pace: Pace | None) -> tuple[str | None, str | None]:
    """Reply and error of a prompt: asked again after a failure until it has had its attempts or its time."""
    until, error = time.monotonic() + limits.seconds, "TimeoutError: no time was left to ask"
    for attempt in range(limits.attempts):
        if attempt:
            pause = limits.pause * 2 ** (attempt - 1)
            if time.monotonic() + pause > until:
                break
            time.sleep(pause)
        if pace:
            pace.wait()
        try:
            return annotator(prompt, model), None
        except Exception as e:  # noqa: BLE001  one prompt's failure is that trial's status
            error = f"{type(e).__name__}: {e}"
    return None, error


class ReplyCache:
    """Replies by cache key, in a Parquet table cut by the first two characters of the key: a look-up opens the parts of its keys only."""

    SCHEMA = "cache_key string, reply string, part string"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def read(self, parts: list[str] | None = None) -> DataFrame:
        try:
            rows = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], self.SCHEMA)
        return (rows if parts is None else rows.filter(F.col("part").isin(*parts))).select("cache_key", "reply")

    def of(self, keys: DataFrame) -> DataFrame:
        parts = [r[0] for r in keys.select(F.substring("cache_key", 1, 2)).distinct().collect()]  # at most 256
        return self.read(parts)

    def add(self, rows: DataFrame) -> None:
        """Replies that are not there yet. Two runs that add the same key at once leave it twice; readers take one."""
        new = rows.select("cache_key", "reply").dropDuplicates(["cache_key"]).join(self.of(rows), "cache_key", "left_anti").withColumn("part", F.substring("cache_key", 1, 2))
        new.repartition("part").write.mode("append").partitionBy("part").parquet(self.path)


def keyed(prompts: DataFrame, model: str) -> DataFrame:
    """prompts with cache_key: made of the prompt without its nonce, if the caller gives it as keyed_text, and the model."""
    asked_for = F.col("keyed_text") if "keyed_text" in prompts.columns else F.col("prompt")
    return prompts.withColumn("cache_key", cache_key(asked_for, F.lit(model))).drop("keyed_text")


def annotate(prompts: DataFrame, model: str, make: Callable[[], Annotator], cache: DataFrame | None = None, concurrency: int = 8, limits: Limits | None = None) -> DataFrame:
    """trial_id, cache_key, reply, cached, categories, status and error of every prompt (trial_id, prompt).

    A partition is a worker with one backend, whose calls run in so many threads as the limits allow. Replies in the cache
    (cache_key, reply) are not asked for again; errors are never cached.
    """
    limits = limits or Limits(workers=concurrency)
    rows = prompts if "cache_key" in prompts.columns else keyed(prompts, model)
    known = None
    if cache is not None:
        known = rows.join(cache.select("cache_key", "reply").dropDuplicates(["cache_key"]), "cache_key").withColumns({"error": F.lit(None).cast("string"), "cached": F.lit(True)})
        rows = rows.join(cache.select("cache_key").distinct(), "cache_key", "left_anti")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        annotator = make()
        pace = Pace(limits.per_second / limits.workers) if limits.per_second else None
        with ThreadPoolExecutor(limits.in_flight) as pool:
            for pdf in batches:
                for i in range(0, len(pdf), 16 * limits.in_flight):  # no more prompts wait than a worker is soon to ask
                    part = pdf.iloc[i : i + 16 * limits.in_flight]
                    both = list(pool.map(lambda p: _patiently(annotator, p, model, limits, pace), part["prompt"]))
                    yield part.assign(reply=[r for r, _ in both], error=[e for _, e in both])[["trial_id", "prompt", "cache_key", "reply", "error"]]

    asked = rows.select("trial_id", "prompt", "cache_key").repartition(limits.workers).mapInPandas(ask, "trial_id string, prompt string, cache_key string, reply string, error string").withColumn("cached", F.lit(False))
    return with_status(asked if known is None else asked.unionByName(known.select(*asked.columns)))


def with_status(rows: DataFrame) -> DataFrame:
    """Valid categories of the replies, a missing confidence as 0.6, and ok, no_categories or error."""
    valid = F.filter(parse_response(F.col("reply")), lambda c: c["name"].isin(*NAMES))
    valid = F.transform(valid, lambda c: F.struct(c["name"].alias("name"), F.coalesce(c["confidence"], F.lit(0.6)).alias("confidence"), c["evidence"].alias("evidence")))
    status = F.when(F.col("error").isNotNull(), "error").when(F.size("categories") > 0, "ok").otherwise("no_categories")
    return rows.withColumn("categories", valid).withColumn("status", status).withColumn("error", shorten(F.col("error"), 500)).drop("prompt")
