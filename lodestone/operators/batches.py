"""Batches that a model's server works off by itself: submitted, polled and collected by executors, with a ledger that a killed run resumes from.

The ledger is a folder. Requests, cut into batches, are written before any is submitted; a batch's entry (its server's id) is written by
the task that submitted it; replies are tables of one poll each. A batch is planned, submitted or collected by what the folder holds, so
that a run that stops anywhere is continued by the next one. A batch that was submitted, but whose entry was not written any more, is
found by its token. No prompt is in two batches unless the first one answered it with an error.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .annotators import keyed, with_status

#: Prompts of a batch, on average.
SIZE = 5_000


class BatchBackend(Protocol):
    """A server's batches. A token stands for one batch: submitting it again gives the same one."""

    def submit(self, token: str, model: str, requests: list[tuple[str, str]]) -> str:
        """The id of a new batch of (key, prompt)."""

    def find(self, token: str) -> str | None:
        """The id of the batch that was submitted under a token."""

    def ended(self, batch_id: str) -> bool: ...

    def results(self, batch_id: str) -> Iterator[tuple[str, str | None, str | None]]:
        """(key, reply, error); keys may be missing."""


class Ledger:
    REQUESTS = "cache_key string, prompt string, model string, batch string"
    REPLIES = "batch string, cache_key string, reply string, error string"

    def __init__(self, spark: SparkSession, path: str, size: int = SIZE) -> None:
        self.spark, self.path, self.size = spark, os.path.abspath(path), size
        for part in ("requests", "entries", "replies"):
            os.makedirs(f"{self.path}/{part}", exist_ok=True)

    def _rounds(self, part: str, schema: str) -> DataFrame:
        """The tables of a part that were written to their end."""
        root = f"{self.path}/{part}"
        whole = [f"file://{root}/{r}" for r in sorted(os.listdir(root)) if os.path.exists(f"{root}/{r}/_SUCCESS")]
        return self.spark.read.schema(schema).parquet(*whole) if whole else self.spark.createDataFrame([], schema)

    def _add(self, part: str, rows: DataFrame, name: str) -> None:
        rows.write.parquet(f"file://{self.path}/{part}/{name}")

    def requests(self) -> DataFrame:
        return self._rounds("requests", self.REQUESTS)

    def replies(self) -> DataFrame:
        """One row for each key: a reply if there is one, else an error."""
        rows = self._rounds("replies", self.REPLIES).filter("cache_key is not null")
        rank = F.struct(F.col("reply").isNotNull().alias("ok"), "reply", "error")
        return rows.groupBy("cache_key").agg(F.max(rank).alias("r")).select("cache_key", "r.reply", "r.error")

    def entries(self) -> DataFrame:
        return self.spark.read.schema("batch string, id string").json(f"file://{self.path}/entries")

    def collected(self) -> DataFrame:
        return self._rounds("replies", self.REPLIES).select("batch").distinct()

    def plan(self, prompts: DataFrame, model: str) -> int:
        """Cuts prompts (cache_key, prompt) that are neither answered nor on their way into batches; their number."""
        waiting = self.requests().join(self.collected(), "batch", "left_anti").select("cache_key")
        known = waiting.unionByName(self.replies().filter("reply is not null").select("cache_key"))
        new = prompts.select("cache_key", "prompt").dropDuplicates(["cache_key"]).join(known, "cache_key", "left_anti")
        n, name = new.count(), uuid.uuid4().hex
        if n:
            batch = F.concat(F.lit(f"{name}-"), F.pmod(F.xxhash64("cache_key"), F.lit(-(-n // self.size))))
            self._add("requests", new.select("cache_key", "prompt", F.lit(model).alias("model"), batch.alias("batch")), name)
        return n

    def submit(self, make: Callable[[], BatchBackend]) -> None:
        """Submits the batches that have no entry; a batch is one task's."""
        root = f"{self.path}/entries"

        def send(pdf: pd.DataFrame) -> pd.DataFrame:
            token, server = pdf["batch"].iloc[0], make()
            got = server.find(token) or server.submit(token, pdf["model"].iloc[0], list(zip(pdf["cache_key"], pdf["prompt"], strict=True)))
            part = f"{root}/.{token}.{uuid.uuid4().hex}"
            with open(part, "w", encoding="utf-8") as f:
                json.dump({"batch": token, "id": got}, f)
            os.replace(part, f"{root}/{token}.json")
            return pd.DataFrame({"batch": [token]})

        left = self.requests().join(self.entries().select("batch"), "batch", "left_anti")
        left.groupBy("batch").applyInPandas(send, "batch string").write.format("noop").mode("overwrite").save()

    def collect(self, make: Callable[[], BatchBackend]) -> int:
        """Writes the replies of batches that have ended since; how many are still open."""

        def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            server = make()
            for pdf in batches:
                for token, got in zip(pdf["batch"], pdf["id"], strict=True):
                    if server.ended(got):
                        yield pd.DataFrame([(token, None, None, None)], columns=names)  # collected, whatever it answers
                        held: list[tuple] = []
                        for r in server.results(got):
                            held.append((token, *r))
                            if len(held) == 1000:
                                yield pd.DataFrame(held, columns=names)
                                held = []
                        yield pd.DataFrame(held, columns=names)

        names = ["batch", "cache_key", "reply", "error"]
        still = self.entries().join(self.collected(), "batch", "left_anti")
        self._add("replies", still.repartition(8, "batch").mapInPandas(fetch, self.REPLIES), uuid.uuid4().hex)
        return self.requests().select("batch").distinct().join(self.collected(), "batch", "left_anti").count()


def annotate(prompts: DataFrame, model: str, make: Callable[[], BatchBackend], ledger: Ledger, poll: float = 10.0, seconds: float = 86_400.0) -> DataFrame:
    """trial_id, cache_key, reply, categories, status and error of every prompt (trial_id, prompt), through a server's batches.

    Prompts that the ledger has a reply to are not asked again, errors are. After the given seconds what is still open is an error; a later run finds it.
    """
    rows = prompts if "cache_key" in prompts.columns else keyed(prompts, model)
    ledger.plan(rows, model)
    ledger.submit(make)
    until = time.monotonic() + seconds
    while ledger.collect(make) and time.monotonic() < until:
        time.sleep(poll)
    waiting = ledger.requests().join(ledger.collected(), "batch", "left_anti").select("cache_key", F.lit(True).alias("open")).distinct()
    out = rows.select("trial_id", "prompt", "cache_key").join(ledger.replies(), "cache_key", "left").join(waiting, "cache_key", "left")
    why = F.when(F.col("open"), "TimeoutError: the batch has not ended").otherwise(F.coalesce("error", F.lit("the batch ended without this prompt")))
    return with_status(out.withColumn("error", F.when(F.col("reply").isNull(), why)).drop("open"))
