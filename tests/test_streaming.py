"""Streams: late rows, restarts and repeated batches into the store; windows with rows inside and beyond the watermark."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lodestone.operators.store import AnnotationStore, last_writes
from lodestone.schemas import ANNOTATIONS
from lodestone.streaming import trials as streaming


def change(trial, category, x, day):
    return (trial, category, float(x), "", "heuristic", "rules", "3.0.0", f"2026-01-{day:02d}T00:00:00Z")


def seen(df):
    return sorted((r["trial_id"], r["category_name"], r["confidence"]) for r in df.collect())


def deliver(spark, path, n, rows, schema=ANNOTATIONS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/batch={n}")


def test_rows_late_by_batches_give_the_same_store(spark, tmp_path):
    """Each trigger sees one delivery; rows of a key come in any order, two batches late and after a restart from the checkpoint."""
    rng = random.Random(5)
    changes = [change(f"t{rng.randrange(12)}", rng.choice("xy"), i / 100, rng.randint(1, 28)) for i in range(90)]
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    batches = [changes[:30], changes[30:60], changes[60:]]
    for i, b in enumerate(batches):
        deliver(spark, src, i, b)
        stream = spark.readStream.schema(ANNOTATIONS).parquet(f"{src}/batch=*")
        streaming.into_store(stream, store, str(tmp_path / "cp"), compact_share=[9.0, 0.0, 9.0][i]).awaitTermination()
        so_far = spark.createDataFrame([x for y in batches[: i + 1] for x in y], ANNOTATIONS).coalesce(1).withColumn("o", F.monotonically_increasing_id())
        assert seen(AnnotationStore(spark, store).read()) == seen(last_writes(so_far, "o"))
    pointer = AnnotationStore(spark, store)._pointer()
    assert len(pointer["log"]) == 1 and pointer["log"][0]["rows"] < 30  # the second was compacted; rows that lose did not come through


def test_batch_lost_after_the_log_was_written_counts_once(spark, tmp_path, monkeypatch):
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    deliver(spark, src, 0, [change("a", "x", 0.1, 1), change("b", "x", 0.2, 1)])
    go = lambda: streaming.into_store(spark.readStream.schema(ANNOTATIONS).parquet(f"{src}/batch=*"), store, str(tmp_path / "cp")).awaitTermination()

    def stop(self, *a):
        raise OSError("executor lost")

    with monkeypatch.context() as m:
        m.setattr(AnnotationStore, "compact", stop)
        with pytest.raises(StreamingQueryException):
            go()
    assert len(AnnotationStore(spark, store)._pointer()["log"]) == 1
    go()
    assert seen(AnnotationStore(spark, store).read()) == [("a", "x", 0.1), ("b", "x", 0.2)]


EVENTS = "ts timestamp, event_type string, user_id long"


def events(*minutes, user=1):
    return [(datetime(2026, 1, 1) + timedelta(minutes=m), "view", user) for m in minutes]


def run(spark, tmp_path, deliveries, make):
    """What an append-mode stream has given when all deliveries came one trigger each."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, rows in enumerate(deliveries):
        deliver(spark, src, i, rows, EVENTS)
        stream = make(spark.readStream.schema(EVENTS).parquet(f"{src}/batch=*"))
        stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


END = 10_000  # an event so late that all windows before are closed


@pytest.mark.parametrize("kind", ["tumbling", "sliding", "sessions"])
def test_windows_take_rows_within_the_watermark_and_no_others(spark, tmp_path, kind):
    make = {"tumbling": lambda e: streaming.tumbling(e, "60 minutes", "10 minutes"), "sliding": lambda e: streaming.sliding(e, "60 minutes", "15 minutes", "10 minutes"), "sessions": lambda e: streaming.sessions(e, "30 minutes", "10 minutes")}[kind]
    # 62 lets 55 still come (within 10 minutes), 300 closes all before 290, so that 56 comes too late
    deliveries = [events(5, 20, 62), events(55), events(300), events(56), events(END)]
    got = run(spark, tmp_path, deliveries, make)
    taken = spark.createDataFrame([r for i in (0, 1, 2) for r in deliveries[i]], EVENTS)
    name = "session_start" if kind == "sessions" else "window_start"
    rows = lambda df: sorted((r[name], r["n"]) for r in df.collect())
    assert rows(got) == rows(make(taken))


def test_sliding_windows_add_up_panes(spark):
    rng = random.Random(1)
    e = spark.createDataFrame(events(*[rng.randrange(600) for _ in range(300)]), EVENTS)
    plain = e.groupBy(F.window("ts", "1 hour", "15 minutes"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "event_type", "n")
    assert sorted(map(tuple, streaming.sliding(e).collect())) == sorted(map(tuple, plain.collect()))
