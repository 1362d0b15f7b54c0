"""Incremental modes over file sources; extensions, for the reference has bounded input only."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from quern.sources.shipping import ship


def arrivals(spark: SparkSession, path: str, schema: T.StructType, files: int = 100) -> DataFrame:
    """New Parquet files below path as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def maintained(stream: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch under a batch operator, appended to a table in a folder of its own, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def late_dropped(query: StreamingQuery) -> int:
    """How many rows (of windows: groups of them) a query's run found to be later than its watermark, and dropped."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def deduplicated(events: DataFrame, time: str, *keys: str, late: str = "1 day") -> DataFrame:
    """Of rows with the same keys the first to come; state is kept for as long as a copy may be late. Of a table any one of them."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else events.dropDuplicates(list(keys))


def windowed_counts(events: DataFrame, time: str, by: str, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts in tumbling event-time windows; works on streams and tables alike."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(F.window(time, size).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sessions(events: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of each key: runs of events with no larger gap."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


class _Streaks(StatefulProcessor):
    """Runs of failures of each key, in the order of event time: rows wait in state until the watermark has passed them."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at array<bigint>, place array<bigint>, bad array<boolean>")  # an entry for each arrival
        self.run = handle.getValueState("run", "length int, stopped boolean")

    def _so_far(self) -> tuple[int, bool]:
        found = self.run.get()
        return (0, False) if found is None else tuple(found)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if not self._so_far()[1]:
            last = 0
            for b in rows:
                at = b["at_"].astype("int64").tolist()
                self.waiting.appendValue((at, b["place_"].astype("int64").tolist(), b["bad_"].astype(bool).tolist()))
                last = max([last, *at])
            self.handle.registerTimer(last + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed, (length, stopped) = timerValues.getCurrentWatermarkInMs(), self._so_far()
        held = sorted(x for parts in self.waiting.get() for x in zip(*parts, strict=True))
        stop_at = None
        for at, place, bad in held:
            if at >= passed or stopped:
                break
            length = length + 1 if bad else 0
            if length >= self.most:
                stopped, stop_at = True, place
        rest = [] if stopped else [x for x in held if x[0] >= passed]
        if rest:
            self.waiting.put([tuple(map(list, zip(*rest, strict=True)))])
        else:
            self.waiting.clear()
        self.run.update((length, stopped))
        if stop_at is not None:
            yield pd.DataFrame({"key": [key[0]], "stop_at": [stop_at]})

    def close(self) -> None:
        pass


def streaks(events: DataFrame, time: str, by: str, order: str, failed: Column, most: int, late: str = "1 day") -> DataFrame:
    """(key, stop_at) of a stream: as soon as the watermark has passed it, the row (by order) where a key's run of failures first reaches most, in the order of event time and then of order.

    The stream's twin of curate.fail_streak_stop(). A key holds the rows that the watermark hasn't passed, a run's length, and
    nothing but a mark once it has stopped. Rows later than the watermark are dropped (late_dropped()). Keys are bigint; null is a key.
    State is in RocksDB, which is set for the session's queries.
    """
    spark = events.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.withWatermark(time, late).select(F.col(by).cast("long").alias("key_"), F.col(time), F.unix_millis(time).alias("at_"), F.col(order).cast("long").alias("place_"), F.coalesce(failed, F.lit(False)).alias("bad_"))
    return rows.groupBy("key_").transformWithStateInPandas(_Streaks(most), "key long, stop_at long", outputMode="Append", timeMode="EventTime")
