"""Readers: trial directories, signals, annotation documents, golden corpora, registered views."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_excluded
from ..operators.signals import is_trial, normalize_lists
from ..operators.store import AnnotationStore
from ..schemas import ANNOTATION_DOCUMENT, SIGNALS_WITH_PATH, TABLES


def parent(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), "/[^/]*$", "")


def whole_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(trial_path, raw, modified, size) of all files of a name under a directory."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root, wholetext=True)
    return df.select(parent(F.col("_metadata.file_path")).alias("trial_path"), F.col("value").alias("raw"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("size"))


#: Files that make up a trial.
TRIAL_FILES = ("result.json", "trajectory.json", "instruction.txt")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(trial_path, name, nested, path, modified, size) of all files of trials outside excluded directories; no content is read.

    nested: the file lies in the trial's agent directory.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{json,txt}").load(root)
    folder, name = parent(F.col("path")), F.element_at(F.split("path", "/"), -1)
    nested = folder.endswith("/agent") & (name != "result.json")
    trial = F.when(nested, F.regexp_replace(folder, "/agent$", "")).otherwise(folder)
    out = df.select(trial.alias("trial_path"), name.alias("name"), nested.alias("nested"), "path", F.unix_micros("modificationTime").alias("modified"), F.col("length").alias("size"))
    return out.filter(F.col("name").isin(*TRIAL_FILES) & ~is_excluded(F.col("trial_path")))


def contents(listed: DataFrame) -> DataFrame:
    """The listed files with their texts (raw): only these are opened, by the tasks that they are dealt out to."""
    names = [*listed.columns, "raw"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 64):
                part = batch.slice(i, 64)
                texts = []
                for path in part.column("path").to_pylist():
                    fs, place = pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
                    with fs.open_input_stream(place) as f:
                        texts.append(f.read().decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=names)

    schema = T.StructType([*listed.schema.fields, T.StructField("raw", T.StringType())])
    return listed.repartition("path").mapInArrow(read, schema)


def trial_documents(listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Result and trajectory documents (trial_path, raw) of the listed files: valid trials; an empty object is no trajectory."""
    texts = contents(listed.filter(F.col("name") != "instruction.txt"))
    results = texts.filter((F.col("name") == "result.json") & is_trial(F.col("raw"))).select("trial_path", "raw")
    there = F.get_json_object("raw", "$")
    found = texts.filter((F.col("name") == "trajectory.json") & there.isNotNull() & (there != "{}"))
    return results, found.groupBy("trial_path").agg(F.min_by("raw", "nested").alias("raw"))


def trial_results(spark: SparkSession, root: str) -> DataFrame:
    """Result documents of valid trials outside excluded directories; what does not parse is no trial."""
    return whole_files(spark, root, "result.json").filter(is_trial(F.col("raw")) & ~is_excluded(F.col("trial_path")))


def trajectories(spark: SparkSession, root: str) -> DataFrame:
    """Each trial's trajectory: its own file, or the one in its agent directory; an empty object is none."""
    found = whole_files(spark, root, "trajectory.json").filter(F.get_json_object("raw", "$").isNotNull() & (F.get_json_object("raw", "$") != "{}"))
    nested = F.col("trial_path").endswith("/agent")
    placed = found.select(F.regexp_replace("trial_path", "/agent$", "").alias("trial_path"), "raw", nested.cast("int").alias("rank"))
    return placed.groupBy("trial_path").agg(F.min_by("raw", "rank").alias("raw"))


def trajectory_lines(spark: SparkSession, root: str, name: str = "*.jsonl") -> DataFrame:
    """Line-stream trajectories as one document of steps; a malformed line becomes a placeholder step."""
    lines = F.filter(F.split("raw", "\n"), lambda x: F.trim(x) != "")
    step = lambda x: F.when(F.get_json_object(x, "$").isNotNull(), x).otherwise(F.lit('{"malformed": true}'))
    return whole_files(spark, root, name).select("trial_path", F.concat(F.lit('{"steps":['), F.array_join(F.transform(lines, step), ","), F.lit("]}")).alias("raw"))


def any_trajectory(spark: SparkSession, root: str) -> DataFrame:
    """A trial's trajectory document, or else the one made of its line stream; empty files are none."""
    docs = trajectories(spark, root).withColumn("rank", F.lit(0))
    lines = trajectory_lines(spark, root).filter(F.length("raw") > len('{"steps":[]}')).withColumn("rank", F.lit(1))
    lines = lines.withColumn("trial_path", F.regexp_replace("trial_path", "/agent$", ""))
    return docs.unionByName(lines).groupBy("trial_path").agg(F.min_by("raw", "rank").alias("raw"))


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Lines of JSON of a declared schema; blank lines are skipped, a bad one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def signals(spark: SparkSession, path: str) -> DataFrame:
    """A signals file by its extension: Parquet, JSON lines, or a JSON array."""
    if path.endswith(".jsonl"):
        df = json_lines(spark, path, SIGNALS_WITH_PATH)
    elif path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            if not f.read(4096).lstrip().startswith("["):
                raise ValueError(f"{path}: not a JSON array")
        df = spark.read.schema(SIGNALS_WITH_PATH).option("multiLine", True).option("mode", "FAILFAST").json(path)
    else:
        df = spark.read.parquet(path)
    return normalize_lists(df)


def annotation_documents(spark: SparkSession, path: str) -> DataFrame:
    """Nested annotations: a row for each trial. A document with an envelope, a bare list or JSON lines."""
    if path.endswith(".jsonl"):
        return json_lines(spark, path, ANNOTATION_DOCUMENT)
    whole = T.StructType([T.StructField("annotations", T.ArrayType(ANNOTATION_DOCUMENT))])
    raw = spark.read.text(path, wholetext=True)
    enveloped = F.from_json("value", whole)["annotations"]
    bare = F.from_json("value", T.ArrayType(ANNOTATION_DOCUMENT))
    return raw.select(F.explode(F.when(F.ltrim("value").startswith("["), bare).otherwise(enveloped)).alias("a")).select("a.*")


def assignments(docs: DataFrame) -> DataFrame:
    """(trial_path, status, category_name, confidence): later duplicates of a trial win; a missing confidence is 1."""
    from pyspark.sql import Window as W

    last = F.row_number().over(W.partitionBy("trial_path").orderBy(F.desc("_o")))
    docs = docs.filter(F.coalesce("trial_path", F.lit("")) != "").withColumn("_o", F.monotonically_increasing_id()).withColumn("_n", last).filter("_n = 1")
    status = F.coalesce("annotation_result_status", F.when(F.size(F.coalesce("categories", F.array())) > 0, "ok").otherwise("no_categories"))
    return docs.select("trial_path", status.alias("status"), F.explode_outer("categories").alias("c")).select("trial_path", "status", F.col("c.name").alias("category_name"), F.when(F.col("c.name").isNotNull(), F.coalesce("c.confidence", F.lit(1.0))).alias("confidence"))


def golden_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Curated categories: a row for each directory with expected_annotations.json; symbolic links are refused."""
    for d, dirs, files in os.walk(root):
        for name in dirs + files:
            if os.path.islink(os.path.join(d, name)):
                raise ValueError(f"symbolic link in the corpus: {os.path.join(d, name)}")
    docs = whole_files(spark, root, "expected_annotations.json")
    categories = F.from_json(F.get_json_object("raw", "$.categories"), "array<struct<name: string, confidence: double, evidence: string>>")
    return docs.select(F.element_at(F.split("trial_path", "/"), -1).alias("trial_id"), "trial_path", categories.alias("categories"))


def register_views(spark: SparkSession, data_dir: str) -> list[str]:
    """Registers signals, annotations and manifests as views: Parquet if it is there and can be read, else JSON lines, else not at all."""
    found = []
    for name, schema in TABLES.items():
        df = None
        for place in (f"{data_dir}/{name}.parquet", f"{data_dir}/export/{name}.parquet"):
            if os.path.exists(place):
                try:
                    store = AnnotationStore(spark, place)
                    df = store.read() if os.path.exists(f"{place}/{store.POINTER}") else spark.read.parquet(place)
                    break
                except Exception:  # noqa: BLE001  an unreadable export falls back to the lines it was made from
                    df = None
        if df is None and os.path.exists(f"{data_dir}/{name}.jsonl"):
            path = f"{data_dir}/{name}.jsonl"
            have = spark.read.json(path, samplingRatio=1.0).columns
            known = {f.name: f for f in schema.fields}
            df = spark.read.json(path) if not set(have) <= set(known) else spark.read.schema(T.StructType([known[c] for c in known if c in have])).json(path)
        if df is not None:
            df.createOrReplaceTempView(name)
            found.append(name)
        else:
            spark.catalog.dropTempView(name)
    return found
