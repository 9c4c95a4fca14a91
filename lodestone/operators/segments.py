"""Windows over keys of any size: a key with too many rows for one task is cut into segments of its order.

Rows of hot keys are ranged by (key, order), so that neighbouring tasks hold neighbouring stretches of a key; each stretch is scanned by
itself, and what a scan needs from before its stretch comes from one small row for each key and stretch. All other keys take the ordinary
window. Orders have to be total, as for any window whose result is defined. Null keys are one key, as in a window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written

#: Rows of a key that one task may hold.
ROWS = 1 << 20


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[n])
    return out


def split_hot(df: DataFrame, key: list[str], rows: int = ROWS) -> tuple[DataFrame, DataFrame | None, int]:
    """(rows of other keys, rows of hot keys or None, number of stretches). A hot key has more than so many rows and a 1,024th of all: fewer than 1,024 keys are."""
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    if not total or most <= rows:
        return df, None, 0
    hot = counts.filter(F.col("_n") > max(rows, total // 1024))
    held = hot.agg(F.sum("_n")).first()[0]
    if not held:
        return df, None, 0
    keys = F.broadcast(hot.select(*[F.col(k).alias(f"_hot_{k}") for k in key]))
    is_hot = F.lit(True)
    for k in key:
        is_hot = is_hot & df[k].eqNullSafe(keys[f"_hot_{k}"])
    return df.join(keys, is_hot, "left_anti"), df.join(keys, is_hot, "left_semi"), max(2, -(-held // rows))


def _ranged(hot: DataFrame, key: list[str], order: list, stretches: int) -> DataFrame:
    """Rows with the number of their stretch; the stretches of a key are numbered in its order."""
    return written(hot.repartitionByRange(stretches, *key, *order).withColumn("_stretch", F.spark_partition_id()), "stretches")


def _from_before(rows: DataFrame, small: DataFrame, key: list[str], name: str) -> DataFrame:
    """rows with the column of small (key, _stretch, name) that belongs to their key and stretch."""
    some = small.select(*[F.col(k).alias(f"_of_{k}") for k in key], F.col("_stretch").alias("_of_stretch"), name)
    on = rows["_stretch"] == some["_of_stretch"]
    for k in key:
        on = on & rows[k].eqNullSafe(some[f"_of_{k}"])
    return rows.join(some, on).drop(*[f"_of_{k}" for k in key], "_of_stretch")


def last_value(df: DataFrame, key: list[str], order: list, value: Column, name: str, rows: int = ROWS) -> DataFrame:
    """df with the last value that is not null among a key's rows up to each row."""
    cold, hot, stretches = split_hot(df, key, rows)
    so_far = lambda *more: W.partitionBy(*key, *more).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = cold.withColumn(name, F.last(value, ignorenulls=True).over(so_far()))
    if hot is None:
        return out
    whole = W.partitionBy(*key, "_stretch").orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    scanned = _ranged(hot, key, order, stretches).withColumns({name: F.last(value, ignorenulls=True).over(so_far("_stretch")), "_end": F.last(value, ignorenulls=True).over(whole)})
    scanned = written(scanned, "scans")
    ends = scanned.groupBy(*key, "_stretch").agg(F.first("_end").alias("_end"))  # the same in all rows of a stretch
    carried = F.last("_end", ignorenulls=True).over(W.partitionBy(*key).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1))
    joined = _from_before(scanned, ends.withColumn("_carried", carried), key, "_carried")
    return out.unionByName(joined.withColumn(name, F.coalesce(name, "_carried")).select(*out.columns))


def numbered(hot: DataFrame, key: list[str], order: list, stretches: int) -> DataFrame:
    """Rows with _row, their number in their key from 0."""
    own = F.row_number().over(W.partitionBy(*key, "_stretch").orderBy(*order))
    local = written(_ranged(hot, key, order, stretches).withColumn("_row", own.cast("long") - 1), "numbers")
    sizes = local.groupBy(*key, "_stretch").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.partitionBy(*key).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return _from_before(local, sizes.withColumn("_before", before), key, "_before").withColumn("_row", F.col("_row") + F.col("_before")).drop("_before", "_stretch")


def over_rows(df: DataFrame, key: list[str], order: list, before: int, after: int, make: Callable[[WindowSpec], dict[str, Column]], rows: int = ROWS) -> DataFrame:
    """df with the columns that make() gives for a window, of functions that look at most so many rows back and ahead.

    A hot key's rows are numbered and cut into blocks of equal length; rows near the edge of a block are copied to the block beside it.
    """
    cold, hot, stretches = split_hot(df, key, rows)
    out = cold.withColumns(make(W.partitionBy(*key).orderBy(*order)))
    if hot is None:
        return out
    n, block = numbered(hot, key, order, stretches), lambda r: F.floor(r / rows)
    copies = F.sequence(block(F.greatest(F.col("_row") - after, F.lit(0))), block(F.col("_row") + before))
    n = n.withColumn("_block", F.explode(copies))
    seen = n.withColumns(make(W.partitionBy(*key, "_block").orderBy(*order)))
    return out.unionByName(seen.filter(F.col("_block") == block(F.col("_row"))).select(*out.columns))
