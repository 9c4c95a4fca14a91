"""Windows over hot keys against plain windows, and that no task holds a hot key."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators import segments


@pytest.fixture(scope="module")
def events(spark):
    """One key with half of all rows, a null key with a quarter, small ones; long stretches without a value; ties in time."""
    key = F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 4 == 1, F.lit(None)).otherwise(F.col("id") % 50)
    at = F.floor((F.col("id") * 7919 % 6000) / 3)
    value = F.when((F.col("id") * 31 % 997 < 4) | (F.col("id") == 0), F.col("id"))
    return spark.range(6000).select(key.cast("long").alias("k"), at.alias("at"), "id", value.alias("v")).repartition(5).cache()


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def order():
    return ["at", F.desc("id")]



@pytest.mark.parametrize("rows", [100, 1000, 1 << 20])
def test_last_value(events, rows):
    w = W.partitionBy("k").orderBy(*order()).rowsBetween(W.unboundedPreceding, 0)
    got = segments.last_value(events, ["k"], order(), F.col("v"), "last", rows)
    assert plain(got.select("id", "last")) == plain(events.select("id", F.last("v", ignorenulls=True).over(w).alias("last"))) and got.columns == [*events.columns, "last"]


@pytest.mark.parametrize(("rows", "before"), [(100, 2), (3000, 2), (1 << 20, 2), (100, 250)])
def test_frames(events, rows, before):
    make = lambda w: {"sum": F.sum("id").over(w.rowsBetween(-before, 0)), "lag": F.lag("id", 2).over(w), "lead": F.lead("id").over(w)}
    got = segments.over_rows(events, ["k"], order(), before, 1, make, rows)
    assert plain(got) == plain(events.withColumns(make(W.partitionBy("k").orderBy(*order()))))


def test_no_task_holds_a_hot_key(events):
    cold, hot, stretches = segments.split_hot(events, ["k"], 200)
    assert {r[0] for r in hot.select("k").distinct().collect()} == {7, None} and cold.count() + hot.count() == 6000 and stretches == -(-hot.count() // 200)
    sizes = segments._ranged(hot, ["k"], order(), stretches).groupBy("k", "_stretch").count()
    assert sizes.agg(F.max("count")).first()[0] < 3 * 200  # of 3,000
    rows = segments.numbered(hot, ["k"], order(), stretches)
    assert rows.groupBy("k").agg(F.count_distinct("_row").alias("n"), F.max("_row").alias("m")).filter("n <> m + 1").count() == 0


def test_empty(spark, events):
    none = events.limit(0)
    assert segments.last_value(none, ["k"], order(), F.col("v"), "last").count() == 0
    assert segments.over_rows(none, ["k"], order(), 1, 1, lambda w: {"n": F.lag("id").over(w)}).count() == 0
