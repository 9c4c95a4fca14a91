"""The annotation store: rows keyed by trial, category and annotator, merged with last-writer-wins."""

from __future__ import annotations

import contextlib
import fcntl
import json
import math
import os
import shutil
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ANNOTATION_KEY, ANNOTATION_VERSION, ANNOTATIONS

# Logical annotators and the model snapshots that stand for them, the current one first.
MODELS = {
    "llm:haiku-4": ("claude-haiku-4-5-20251001",),
    "llm:sonnet-4": ("claude-sonnet-4-6-20260514", "claude-sonnet-4-5-20250514"),
    "llm:opus-4": ("claude-opus-4-6-20260514", "claude-opus-4-5-20250514"),
}
IDENTITY_OF = {s: k for k, snapshots in MODELS.items() for s in snapshots}


class MixedVersionError(ValueError):
    """Rows of another taxonomy version than the store's."""


class DuplicateKeyError(ValueError):
    """A batch that has a key twice."""


def resolve_identity(snapshot: str) -> str:
    if snapshot not in IDENTITY_OF:
        raise LookupError(f"no annotator for model {snapshot}")
    return IDENTITY_OF[snapshot]


def resolve_snapshot(identity: str) -> str:
    if identity not in MODELS:
        raise LookupError(f"no annotator {identity}")
    return MODELS[identity][0]


def resolve_alias(name: str) -> str:
    """An annotator by its identity, its short name (haiku, sonnet, opus) or a snapshot; unknown names stay."""
    if name in MODELS:
        return name
    short = next((k for k in MODELS if k.removeprefix("llm:").split("-")[0] == name), None)
    return short or IDENTITY_OF.get(name, name)


def identity(raw: Column) -> Column:
    """Snapshots as their logical annotator; anything else as it is."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in IDENTITY_OF.items() for x in kv]), raw), raw)


def _key() -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ANNOTATION_KEY]


def _when() -> Column:
    return F.coalesce(F.try_to_timestamp(F.col("annotated_at")), F.lit("0001-01-01").cast("timestamp"))


def last_writes(rows: DataFrame, order: str, *within: str) -> DataFrame:
    """One row for each key: the latest by annotated_at, then the later by order. within: columns that depend on the key and that rows are dealt by."""
    w = W.partitionBy(*within, *_key()).orderBy(_when().desc(), F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def duplicate_keys(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*[k.alias(c) for k, c in zip(_key(), ANNOTATION_KEY, strict=True)]).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def versions(rows: DataFrame) -> list[str]:
    return sorted(r[0] or "" for r in rows.select("taxonomy_version").distinct().limit(100).collect())


class AnnotationStore:
    """Annotation rows in a directory, by buckets of trials that split as they grow: a batch rewrites the buckets that it touches and no others.

    Extendible hashing: a bucket holds the trials whose hash ends in its bits; one that would outgrow max_bytes becomes two, four or more
    with one, two or more bits of their own, before the batch is written, so that a task never gets much more than that. All buckets
    together cover all hashes; the directory from the last bits of a hash to its bucket is derived from them.

    The pointer file names the place of each bucket. A new generation is written beside the old one and becomes valid by replacing
    the pointer, which is one atomic step; until then, and after a failure, readers see the old generation. Directories of the generation
    before stay until the next batch, for readers that have begun. One writer at a time, by a lock file; the directory is local or mounted.

    Small batches, as of a stream, go to a log instead (append): readers settle its rows with those of the buckets, compact() merges them
    into the buckets, and a batch that was appended before is known by its stream and number and not taken again.
    """

    BUCKETS, MAX_BYTES, ROW_BYTES, DEEPEST, POINTER = 1, 64 << 20, 128, 20, "_current.json"

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, max_bytes: int = MAX_BYTES) -> None:
        self.spark, self.path, self.max_bytes = spark, path.rstrip("/"), max_bytes
        self.new_depth = (buckets - 1).bit_length()

    # The pointer: what is valid ------------------------------------------------------------------------------------------------------

    def _pointer(self) -> dict:
        try:
            with open(f"{self.path}/{self.POINTER}", encoding="utf-8") as f:
                found = json.load(f)
        except FileNotFoundError:
            found = {"places": {}, "rows": {}, "before": []}
        depth = self.new_depth
        if old := found.pop("buckets", None):  # a store with a fixed power of two of buckets
            depth = old.bit_length() - 1
            for part in ("places", "rows"):
                found[part] = {f"{depth}-{k}": v for k, v in found[part].items()}
        return {"leaves": [f"{depth}-{v}" for v in range(1 << depth)], "bytes": {}, "log": [], "streams": {}} | found

    def _switch(self, pointer: dict) -> None:
        tmp = f"{self.path}/_{uuid.uuid4().hex}.tmp"
        with open(tmp, "w", encoding="utf-8") as f:
            json.dump(pointer, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, f"{self.path}/{self.POINTER}")

    def _replace(self, pointer: dict, replaced: list[str]) -> None:
        """Makes a generation valid; deletes what the last switch replaced and keeps what this one does."""
        gone, pointer["before"] = pointer["before"], replaced
        self._switch(pointer)
        for place in gone:
            shutil.rmtree(f"{self.path}/{place}", ignore_errors=True)

    def meta(self) -> dict:
        try:
            with open(self.path + ".meta.json", encoding="utf-8") as f:
                return json.load(f)
        except (OSError, ValueError):
            return {}

    @contextlib.contextmanager
    def _locked(self) -> Iterator[None]:
        os.makedirs(self.path, exist_ok=True)
        with open(self.path + ".lock", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            yield

    # Readers -------------------------------------------------------------------------------------------------------------------------

    def _rows(self, places: list[str]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], ANNOTATIONS)
        return self.spark.read.schema(ANNOTATIONS).parquet(*[f"{self.path}/{p}" for p in places])

    def _ordered(self, pointer: dict, places: list[str]) -> DataFrame:
        """Rows of buckets and of the log, with the order in which they were written."""
        rows = self._rows(places).withColumn("_o", F.lit(0))
        for n, entry in enumerate(pointer["log"], 1):
            rows = rows.unionByName(self._rows([entry["place"]]).withColumn("_o", F.lit(n)))
        return rows

    def read(self) -> DataFrame:
        pointer = self._pointer()
        places = sorted(pointer["places"].values())
        return last_writes(self._ordered(pointer, places), "_o").drop("_o") if pointer["log"] else self._rows(places)

    def lookup(self, trials: DataFrame) -> DataFrame:
        """The rows of some trials (trial_id); opens their buckets and the log only."""
        pointer = self._pointer()
        trials = trials.select("trial_id").distinct()
        leaves = [r[0] for r in self._placed(trials, pointer["leaves"]).select("_bucket").distinct().collect()]
        rows = self._ordered(pointer, [pointer["places"][x] for x in leaves if x in pointer["places"]]).join(trials, "trial_id", "left_semi")
        return last_writes(rows, "_o").drop("_o").select(*ANNOTATIONS.fieldNames())

    # Writers -------------------------------------------------------------------------------------------------------------------------

    def _placed(self, rows: DataFrame, leaves: list[str]) -> DataFrame:
        """rows with the bucket of each, by the last bits of the trial's hash."""
        deepest = max(_bits(x)[0] for x in leaves)
        directory = [(v + (high << depth), x) for x in leaves for depth, v in [_bits(x)] for high in range(1 << (deepest - depth))]  # at most 2^DEEPEST slots
        slots = F.broadcast(self.spark.createDataFrame(directory, "_slot long, _bucket string"))
        slot = F.xxhash64(F.coalesce("trial_id", F.lit(""))).bitwiseAND(F.lit((1 << deepest) - 1))
        return rows.withColumn("_slot", slot).join(slots, "_slot").drop("_slot")

    def _split(self, pointer: dict, incoming: dict[str, int]) -> tuple[list[str], int]:
        """Splits the buckets that the incoming rows would make too big; the buckets to write, and how many tasks their bytes need."""
        known = sum(pointer["rows"].get(x, 0) for x in pointer["bytes"])
        each = max(1.0, sum(pointer["bytes"].values()) / known) if known else self.ROW_BYTES
        touched, whole = [], 0.0
        for leaf, n in incoming.items():
            size = (pointer["rows"].get(leaf, 0) + n) * each
            depth, v = _bits(leaf)
            more = min(self.DEEPEST - depth, max(0, math.ceil(math.log2(size / self.max_bytes)))) if size > self.max_bytes else 0
            children = [f"{depth + more}-{v + (high << depth)}" for high in range(1 << more)]
            if more:
                at = pointer["leaves"].index(leaf)
                pointer["leaves"][at : at + 1] = children
            touched += children
            whole += size
        return touched, min(len(touched), math.ceil(whole / self.max_bytes))

    def _merge(self, pointer: dict, rows: DataFrame) -> None:
        """Rewrites the buckets that rows (with _o) belong to, with rows merged into them, and takes all of the log's rows for merged."""
        incoming = {r["_bucket"]: r["count"] for r in self._placed(rows, pointer["leaves"]).groupBy("_bucket").count().collect()}  # a row for each bucket
        log = [x["place"] for x in pointer["log"]]
        if not incoming:
            return
        replaced = {x: pointer["places"][x] for x in incoming if x in pointer["places"]}
        touched, tasks = self._split(pointer, incoming)
        old = self._rows(list(replaced.values())).withColumn("_o", F.lit(0))
        # a bucket's rows are together: the latest of each key is found without another shuffle
        merged = last_writes(self._placed(old.unionByName(rows), pointer["leaves"]).repartition(max(1, tasks), "_bucket"), "_o", "_bucket").drop("_o")
        new = f"w-{uuid.uuid4().hex}"
        merged.sortWithinPartitions("_bucket", *ANNOTATION_KEY).write.option("compression", "zstd").partitionBy("_bucket").parquet(f"{self.path}/{new}")
        files = self.spark.read.schema(T.StructType([*ANNOTATIONS.fields, T.StructField("_bucket", T.StringType())])).parquet(f"{self.path}/{new}")
        sizes = files.groupBy("_bucket", F.col("_metadata.file_path").alias("f")).agg(F.count(F.lit(1)).alias("n"), F.max("_metadata.file_size").alias("b"))
        for leaf in incoming:
            for part in ("places", "rows", "bytes"):
                pointer[part].pop(leaf, None)
        for r in sizes.groupBy("_bucket").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).collect():
            pointer["places"][r["_bucket"]] = f"{new}/_bucket={r['_bucket']}"
            pointer["rows"][r["_bucket"]], pointer["bytes"][r["_bucket"]] = r["n"], r["b"]
        pointer["log"] = []
        self._replace(pointer, [*replaced.values(), *log])

    @staticmethod
    def _shaped(rows: DataFrame) -> DataFrame:
        rows = rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in ANNOTATIONS.fields])
        return rows.withColumn("annotator_identity", identity(F.col("annotator_identity")))

    def _same_versions(self, rows: DataFrame, taxonomy_version: str, schema_version: str) -> None:
        wrong = [v for v in versions(rows) if v != taxonomy_version]
        if wrong:
            raise MixedVersionError(f"the batch has taxonomy versions {wrong}, not {taxonomy_version}")
        have = {"taxonomy_version": taxonomy_version, "schema_version": schema_version} | self.meta()
        for name, wanted in (("taxonomy_version", taxonomy_version), ("schema_version", schema_version)):
            if have[name] != wanted:
                raise MixedVersionError(f"the store has {name} {have[name]}, not {wanted}")

    def upsert(self, rows: DataFrame, taxonomy_version: str, schema_version: str = ANNOTATION_VERSION) -> int:
        """Merges rows, and the log if there is one, into the buckets; returns how many rows the store then has."""
        rows = self._shaped(rows)
        if twice := duplicate_keys(rows).limit(1).collect():
            raise DuplicateKeyError(f"the batch has a key twice: {twice[0].asDict()}")
        with self._locked():
            self._same_versions(rows, taxonomy_version, schema_version)
            pointer = self._pointer()
            late = self._ordered(pointer, [])
            self._merge(pointer, late.unionByName(rows.withColumn("_o", F.lit(len(pointer["log"]) + 1))))
            if pointer["places"]:
                write_sidecar(self.path, schema_version, taxonomy_version)
        return sum(pointer["rows"].values())

    def append(self, rows: DataFrame, taxonomy_version: str, stream: str, batch: int, schema_version: str = ANNOTATION_VERSION) -> bool:
        """Adds a stream's batch to the log, the latest row of each key; False if the stream's batch is there already."""
        with self._locked():
            pointer = self._pointer()
            if pointer["streams"].get(stream, -1) >= batch:
                return False
            place = f"log-{uuid.uuid4().hex}"
            # a stream's batch is computed once: what is checked is what was written
            last_writes(self._shaped(rows).withColumn("_o", F.monotonically_increasing_id()), "_o").drop("_o").write.option("compression", "zstd").parquet(f"{self.path}/{place}")
            try:
                self._same_versions(self._rows([place]), taxonomy_version, schema_version)
            except MixedVersionError:
                shutil.rmtree(f"{self.path}/{place}", ignore_errors=True)
                raise
            n = self._rows([place]).count()
            pointer["streams"][stream] = batch
            if n:
                pointer["log"].append({"place": place, "rows": n})
                write_sidecar(self.path, schema_version, taxonomy_version)
            self._switch(pointer)
        return True

    def compact(self, least_share: float = 0.0) -> bool:
        """Merges the log into the buckets once it has so many rows for each of theirs."""
        with self._locked():
            pointer = self._pointer()
            late = sum(x["rows"] for x in pointer["log"])
            if not late or late < least_share * sum(pointer["rows"].values()):
                return False
            self._merge(pointer, self._ordered(pointer, []))
        return True


def _bits(leaf: str) -> tuple[int, int]:
    depth, value = leaf.split("-")
    return int(depth), int(value)


def write_sidecar(path: str, schema_version: str, taxonomy_version: str) -> None:
    with open(path.rstrip("/") + ".meta.json", "w", encoding="utf-8") as f:
        json.dump({"schema_version": schema_version, "taxonomy_version": taxonomy_version, "generated_at": datetime.now(UTC).isoformat()}, f, indent=2)


def manifests(signals: DataFrame, created_at: str = "") -> DataFrame:
    """One row for each benchmark with a name: its number of tasks, and an id by its place in order of names.

    The numbering is over benchmarks, a handful of aggregated rows, not over trials.
    """
    per = signals.filter(F.coalesce("benchmark", F.lit("")) != "").groupBy("benchmark").agg(F.countDistinct("task_id").alias("task_count"))
    place = F.row_number().over(W.orderBy("benchmark"))
    return per.select(F.format_string("manifest-%03d", place).alias("manifest_id"), "benchmark", "task_count", F.lit(created_at).alias("created_at"))
