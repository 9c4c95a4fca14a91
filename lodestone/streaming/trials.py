"""Streaming: trials as they arrive, annotations merged into the store, and windows over events."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.rules import annotate, narrow
from ..operators.store import AnnotationStore
from ..schemas import ANNOTATION_KEY, ANNOTATIONS, SIGNALS_WITH_PATH
from ..taxonomy import VERSION


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """New signals files as a stream; the checkpoint of the query keeps what has been read."""
    return spark.readStream.schema(SIGNALS_WITH_PATH).json(path)


class _Settled(StatefulProcessor):
    """The latest row of each annotation key: rows that an earlier one beats by annotated_at go no further. A key without rows is forgotten."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.latest = handle, handle.getValueState("latest", "at long, forget_ms long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  names of the interface
        held = self.latest.get() if self.latest.exists() else None
        best, forget = None, 0
        for r in rows:  # of equal times the later arrival wins
            forget = max(forget, r["arrived_ms"] + self.keep_ms)
            if best is None or r["at"] >= best["at"]:
                best = r
        wins = held is None or best["at"] >= held[0]
        self.latest.update((best["at"] if wins else held[0], forget))
        self.handle.registerTimer(forget)
        if wins:
            yield Row(**{f: best[f] for f in ANNOTATIONS.fieldNames()})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        if self.latest.exists() and self.latest.get()[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.latest.clear()
        return iter(())

    def close(self) -> None:
        pass


def settled(annotations: DataFrame, keep: timedelta = timedelta(days=2)) -> DataFrame:
    """A stream of annotations without the rows that lose against one before: state is a time for each key, forgotten after a while without rows.

    Time that passes is that of arrival, so that no row is ever too late. One that comes after its key is forgotten passes; the store settles
    it by the same rule.
    """
    annotations.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = annotations.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in ANNOTATION_KEY else F.col(c) for c in ANNOTATIONS.fieldNames()])
    at = F.coalesce(F.unix_micros(F.try_to_timestamp("annotated_at")), F.lit(-(1 << 63)))
    now = F.current_timestamp()
    rows = rows.withColumns({"at": at, "arrived_ms": F.unix_millis(now), "arrived": now}).withWatermark("arrived", "1 second")
    return rows.groupBy(*ANNOTATION_KEY).transformWithState(_Settled(int(keep.total_seconds() * 1000)), ANNOTATIONS, "Append", "EventTime")


def into_store(annotations: DataFrame, store_path: str, checkpoint: str, compact_share: float = 0.1, **options) -> StreamingQuery:
    """A stream of annotations into the store: what changes goes to its log, which is compacted once it holds so large a share of the store.

    A micro-batch costs what it brings, not the buckets that it touches. After a failure the query takes up its last batch again; the
    store knows the batches of a checkpoint that it has, so that none counts twice.
    """

    def append(batch: DataFrame, number: int) -> None:
        store = AnnotationStore(batch.sparkSession, store_path)
        if not store.append(batch, VERSION, checkpoint, number):
            batch.write.format("noop").mode("overwrite").save()  # the state of a repeated batch is to be made again
        store.compact(compact_share)

    out = settled(annotations, **options)
    return out.writeStream.foreachBatch(append).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def annotate_into_store(signals: DataFrame, store_path: str, checkpoint: str, at: str = "", **options) -> StreamingQuery:
    """Labels trials as they come and keeps their labels in the store."""
    return into_store(narrow(annotate(signals), at=at), store_path, checkpoint, **options)


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by type in windows of one size; events later than the watermark are dropped in a stream, none in a batch."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    return w.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "event_type", "n")


def sliding(events: DataFrame, size: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by type in overlapping windows: an event is counted once in its pane, and windows add up panes, so that state does not grow with their overlap."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    panes = w.groupBy(F.window("ts", slide), "event_type").agg(F.count(F.lit(1)).alias("n"))
    windows = panes.groupBy(F.window(F.window_time("window"), size, slide), "event_type").agg(F.sum("n").alias("n"))
    return windows.select(F.col("window.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """A user's events closer together than the gap."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    return w.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("session_start"), "user_id", "n")


def first_seen(annotations: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream of annotations without the repeats of a key within the watermark."""
    at = annotations.withColumn("at", F.coalesce(F.try_to_timestamp("annotated_at"), F.lit("1970-01-01").cast("timestamp")))
    if not annotations.isStreaming:
        return at.dropDuplicates(list(ANNOTATION_KEY)).drop("at")
    return at.withWatermark("at", late).dropDuplicatesWithinWatermark(list(ANNOTATION_KEY)).drop("at")
