"""Incremental work: content-hash caches, changed files, and stages that run only when their inputs have changed."""

from __future__ import annotations

import hashlib
import json
import os
import shlex
import subprocess
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(result: Column, trajectory: Column) -> Column:
    """The identity of a trial's documents: a separator keeps the two apart."""
    return F.sha2(F.concat(F.encode(result, "utf-8"), F.unhex(F.lit("00")), F.encode(F.coalesce(trajectory, F.lit("")), "utf-8")), 256)


def split_by_cache(work: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(what the cache answers, what has to be done)."""
    keys = cache.select(key).distinct()
    return cache.join(work.select(key).distinct(), key, "left_semi"), work.join(keys, key, "left_anti")


def put(cache_path: str, rows: DataFrame, key: str) -> None:
    """Appends rows whose key the cache does not have; a key is never written twice by repeated calls."""
    if os.path.isdir(cache_path):
        rows = rows.join(rows.sparkSession.read.parquet(cache_path).select(key).distinct(), key, "left_anti")
    rows.dropDuplicates([key]).write.mode("append").parquet(cache_path)


def changed(files: DataFrame, state: DataFrame | None) -> DataFrame:
    """Files (path, modified, size, ...) that are new or differ from the recorded state."""
    if state is None:
        return files
    return files.join(state.select("path", "modified", "size"), ["path", "modified", "size"], "left_anti")


def changed_trials(files: DataFrame, state: DataFrame | None) -> DataFrame:
    """(trial_path) with a new, changed or vanished file; by metadata alone."""
    touched = changed(files, state).select("trial_path")
    if state is not None:
        touched = touched.unionByName(state.join(files.select("path"), "path", "left_anti").select("trial_path"))
    return touched.distinct()


def merge_signals(old: DataFrame | None, delta: DataFrame) -> DataFrame:
    """The old table with the changed trials replaced."""
    if old is None:
        return delta
    return old.join(delta.select("trial_path").distinct(), "trial_path", "left_anti").unionByName(delta, allowMissingColumns=True)


class PipelineError(ValueError):
    """A pipeline file that cannot be run."""


@dataclass(frozen=True)
class Stage:
    name: str
    command: tuple[str, ...]
    inputs: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()


@dataclass
class StageResult:
    name: str
    status: str
    reason: str = ""


@dataclass
class Pipeline:
    """Stages in order; a stage is fresh if its outputs exist and its inputs have the recorded content."""

    root: Path
    stages: list[Stage]
    state_path: Path
    results: list[StageResult] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Pipeline:
        p = Path(path)
        try:
            spec = tomllib.loads(p.read_text())
        except (OSError, tomllib.TOMLDecodeError) as e:
            raise PipelineError(f"{path}: {e}") from e
        rows = spec.get("stage")
        if not isinstance(rows, list):
            raise PipelineError(f"{path}: no [[stage]] tables")
        stages, seen = [], set()
        for r in rows:
            if not isinstance(r, dict) or not {"name", "command", "inputs", "outputs"} <= set(r) or r["name"] in seen or not r["command"]:
                raise PipelineError(f"{path}: a stage needs a name of its own, a command, inputs and outputs")
            seen.add(r["name"])
            command = r["command"]
            stages.append(Stage(r["name"], tuple(shlex.split(command) if isinstance(command, str) else command), tuple(r["inputs"]), tuple(r["outputs"])))
        return cls(p.parent, stages, p.parent / ".pipeline_state.json")

    def fingerprint(self, stage: Stage) -> str | None:
        """A digest of the names and contents of all input files; None if there is none."""
        found = {}
        for pattern in stage.inputs:
            base = self.root / pattern
            for f in [base] if base.is_file() else base.rglob("*"):
                if f.is_file():
                    found[os.path.relpath(f, self.root)] = hashlib.sha256(f.read_bytes()).hexdigest()
        return hashlib.sha256(json.dumps(sorted(found.items())).encode()).hexdigest() if found else None

    def state(self) -> dict:
        try:
            return json.loads(self.state_path.read_text())
        except (OSError, ValueError):
            return {}

    def why_stale(self, stage: Stage, state: dict) -> str:
        if any(not (self.root / o).exists() for o in stage.outputs):
            return "an output is missing"
        if (now := self.fingerprint(stage)) is None:
            return ""  # nothing to work on: running it again and again would change nothing
        if stage.name not in state:
            return "it has not run yet"
        return "" if state[stage.name] == now else "its inputs have changed"

    def run(self, runner: Callable[[tuple[str, ...], Path], int] | None = None, force: bool = False) -> list[StageResult]:
        """Runs what is stale, in order; stops at the first failure; records each success at once."""
        runner = runner or (lambda command, cwd: subprocess.run(command, cwd=cwd).returncode)
        state, self.results = self.state(), []
        for s in self.stages:
            why = "forced" if force else self.why_stale(s, state)
            if not why:
                self.results.append(StageResult(s.name, "fresh"))
                continue
            if runner(s.command, self.root) != 0:
                self.results.append(StageResult(s.name, "failed", why))
                break
            if (now := self.fingerprint(s)) is not None:
                state[s.name] = now
            tmp = self.state_path.with_suffix(".tmp")
            tmp.write_text(json.dumps(state, indent=2))
            os.replace(tmp, self.state_path)
            self.results.append(StageResult(s.name, "ran", why))
        return self.results

    def summary(self) -> str:
        return "\n".join(f"{r.name}: {r.status}" + (f" ({r.reason})" if r.reason else "") for r in self.results)
