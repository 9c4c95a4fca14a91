"""Deterministic samples: by hash, by stratum, and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written


def simple(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of a seeded hash of their key; a bounded top-n, combined in every task before it is gathered."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def stratified(df: DataFrame, strata: tuple[str, ...], order: tuple, per_stratum: int, target: int | None = None) -> DataFrame:
    """Up to so many rows of each stratum; with a target, round by round over the strata until it is reached."""
    out = df.withColumn("place", F.row_number().over(W.partitionBy(*strata).orderBy(*order))).filter(F.col("place") <= per_stratum)
    return out if target is None else out.orderBy("place", *strata, *order).limit(target)


def candidates(df: DataFrame, per_stratum: int = 3, target: int = 45) -> DataFrame:
    """Trials worth a curator's time: by agent, benchmark and outcome; those with a trajectory of middling length first."""
    order = (F.col("has_trajectory").desc(), F.col("tool_calls_total").between(5, 200).desc(), F.col("trial_id").asc())
    return stratified(df, ("agent_name", "benchmark", "passed"), order, per_stratum, target)


def kfold(df: DataFrame, label: str, order: tuple[str, ...], k: int) -> DataFrame:
    """Folds in which every label has its share: rows of a label are dealt out in turn.

    Rows are cut into ranges of the order; a row's number is its place within the label and range, plus the rows of the label in the
    ranges before, so that no task has to hold a label, however few labels there are.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "folds")
    sizes = ranged.groupBy("_range", label).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(label).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_range", F.col(label).alias("_label"), before.alias("_start"))  # a row for each range and label
    nth = F.row_number().over(W.partitionBy("_range", label).orderBy(*order)) - 1
    placed = ranged.withColumn("_nth", nth).withColumnRenamed("_range", "_r")
    placed = placed.join(starts, (F.col("_r") == F.col("_range")) & F.col(label).eqNullSafe(F.col("_label")))
    return placed.withColumn("fold", (F.col("_nth") + F.col("_start")) % k).drop("_nth", "_start", "_range", "_label", "_r")
