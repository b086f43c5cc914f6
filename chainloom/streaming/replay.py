"""Structured Streaming: window scores and change events as micro-batches arrive."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chainloom.operators import resolve, windows
from chainloom.operators.gate import gate
from chainloom.operators.monitor import Monitor
from chainloom.sources.writers import StateTable
from chainloom.storage import shared_dir


def volume_stream(stream: DataFrame, width: str = "3 hours", late: str = "1 day") -> DataFrame:
    """``(start, transactions, value)`` per tumbling window; rows later than the watermark are dropped by the engine."""
    return stream.withWatermark("timestamp", late).groupBy(F.window("timestamp", width).alias("w")).agg(F.count("*").alias("transactions"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "transactions", "value")


def run_available(stream: DataFrame, tag: str, mode: str = "append") -> DataFrame:
    """Runs a stream to the end of what is there, through files in the shared folder, and reads the result."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/stream-{tag}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/marks").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def fold_batches(stream: DataFrame, keys: list[str], sums: list[str], tag: str) -> DataFrame:
    """Keyed totals kept in a :class:`StateTable`: each micro-batch is added to the last snapshot.

    A batch that is replayed after a failure is recognised by its number and added once.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/state-{tag}-{uuid.uuid4().hex}"
    state = StateTable(spark, f"{base}/state")

    def add(batch: DataFrame, number: int) -> None:
        if number < len(state.versions()):
            return
        fresh = batch.groupBy(*keys).agg(*(F.sum(s).alias(s) for s in sums))
        held = state.read()
        state.write(fresh if held is None else held.unionByName(fresh).groupBy(*keys).agg(*(F.sum(s).alias(s) for s in sums)))

    stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{base}/marks").trigger(availableNow=True).start().awaitTermination()
    return state.read()


def gated_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of CSV files as a stream of clean observations."""
    return gate(spark.readStream.schema(schema).option("header", True).csv(path)).clean


def monitor_stream(stream: DataFrame, monitor: Monitor, delay_days: int = 0, finish: bool = True, **how) -> DataFrame:
    """Clean observations with ``window_id`` as a stream through :meth:`Monitor.process_window`; returns the rows of ``windows``.

    Batches may split and mix windows.  Their rows wait in an inbox under the batch's number, so a batch that is delivered
    again writes the same folder.  A window is taken, whole and in order, once rows of a window ``delay_days`` days or more after its last
    row have come (with 0: rows of a later window in a later batch), all that are left at the end of the stream if ``finish``.  Rows of a window that was taken, or of one before the
    last taken, come too late: they change nothing and are read by :func:`late_rows`.
    """
    spark, inbox = stream.sparkSession, f"{monitor.path}/inbox"

    def take(batch: DataFrame, number: int | None) -> None:
        if number is not None:
            last = monitor._at()
            on_time = F.lit(True) if last is None else F.col("window_id") > last.window
            own = f"{inbox}/batch={number}"
            try:  # rows were on time or late when they first came
                spark.read.parquet(own)
            except AnalysisException:
                batch.withColumn("late", ~on_time).write.mode("overwrite").parquet(own)
        held = spark.read.option("basePath", inbox).parquet(f"{inbox}/batch=*").where("not late").drop("late", "batch")
        done = monitor._at()
        ahead = held if done is None else held.where(F.col("window_id") > done.window)
        spans = ahead.groupBy("window_id").agg(F.max("timestamp").alias("last"), F.min("timestamp").alias("first")).orderBy("window_id").collect()  # a row per open window
        for span, *after in (spans[i:] for i in range(len(spans))):
            passed = any((later.first - span.last).days >= delay_days for later in after)
            if not (number is None or passed):
                break
            obs = resolve.coinjoin_like(held.where(F.col("window_id") == span.window_id))
            monitor.process_window(obs.drop("window_id"), span.window_id, **how)

    stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{monitor.path}/marks").trigger(availableNow=True).start().awaitTermination()
    if finish:
        take(spark.createDataFrame([], stream.schema), None)
    return monitor.windows.read()


def late_rows(monitor: Monitor) -> DataFrame:
    """What came after its window had been taken."""
    inbox = f"{monitor.path}/inbox"
    return monitor.spark.read.option("basePath", inbox).parquet(f"{inbox}/batch=*").where("late").drop("late", "batch")


class PresenceTimer(StatefulProcessor):
    """Per entity the risk of its last window; a timer at the end of the next window tells if it stayed away."""

    def __init__(self, floor: int, days: int) -> None:
        self.floor, self.span = floor, days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "window_id int, risk int, ends long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        told = []
        seen = pd.concat(list(rows)).sort_values("window_id")
        for r in seen.itertuples():
            ends = int(r.ends.timestamp() * 1000)
            held = self.last.get() if self.last.exists() else None
            if held and held[0] >= r.window_id:
                continue  # a row that came again, or out of order beyond the watermark
            if held is None or r.window_id > held[0] + 1:
                if held and held[1] >= self.floor and held[3]:  # its timer had no chance yet
                    told.append((held[0] + 1, key[0], "DORMANT", held[1], None))
                if r.risk >= self.floor:
                    told.append((r.window_id, key[0], "RESURGENT" if held else "NEW_ENTITY", None, r.risk))
            if held and held[3]:
                self.handle.deleteTimer(held[3])
            timer = ends + self.span if r.risk >= self.floor else 0
            if timer:
                self.handle.registerTimer(timer)
            self.last.update((int(r.window_id), int(r.risk), ends, timer))
        yield _presence(told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        window_id, risk, ends, _ = self.last.get()
        self.last.update((window_id, risk, ends, 0))
        yield _presence([(window_id + 1, key[0], "DORMANT", risk, None)])

    def close(self) -> None:
        pass


PRESENCE = "window_id int, entity_key string, type string, risk_from int, risk_to int"


def _presence(told: list[tuple]) -> pd.DataFrame:
    rows = pd.DataFrame(told, columns=[p.split()[0] for p in PRESENCE.split(", ")])
    return rows.astype({"window_id": "int32", "entity_key": "object", "type": "object", "risk_from": "Int32", "risk_to": "Int32"})


def presence_stream(scores: DataFrame, days: int = 1, floor: int = windows.FLOOR, late: str = "0 seconds") -> DataFrame:
    """``(window_id, entity_key, type, risk_from, risk_to)``: NEW_ENTITY, RESURGENT and DORMANT as scores arrive.

    ``scores`` is a stream of ``(window_id, entity_key, risk, ends)`` with windows of so many days, numbered without gaps, that end at
    ``ends``.  State is a row per entity, spread by its key.  Silence is told when the watermark passes the end of the window
    in which an entity did not appear, whether or not anything of that entity ever comes again.  Needs the RocksDB state store.
    """
    keyed = scores.withWatermark("ends", late).groupBy("entity_key")
    return keyed.transformWithStateInPandas(PresenceTimer(floor, days), PRESENCE, "Append", "EventTime")
