"""The Spark session: settings that hold at any scale, and local defaults."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def session(app: str = "lodestone", cores: int | None = None, **more: str) -> SparkSession:
    """The running session, or a new one: on the cluster that spark-submit names, else on local cores."""
    b = SparkSession.builder.appName(app)
    if "SPARK_MASTER" not in os.environ and not SparkSession.getActiveSession():
        cores = cores or os.cpu_count() or 2
        b = b.master(os.environ.get("MASTER", f"local[{cores}]")).config("spark.sql.shuffle.partitions", str(cores)).config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without it."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
        local = getattr(spark.sparkContext, "_lodestone_tables", None)
        if local is None:
            local = spark.sparkContext._lodestone_tables = tempfile.mkdtemp(prefix="lodestone-tables-")
            atexit.register(shutil.rmtree, local, True)
        root = f"file://{local}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder: computed once, however often and by whatever columns it is read."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
