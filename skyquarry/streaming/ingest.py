"""The live stream: one query whose batches are routed to each table's log.

A batch's events are written to ``<base>/<table>/log/batch=<id>``, replacing what a failed attempt
left, so every event counts once whatever is retried. A table is its snapshot with its log folded
in by that table's own merge; ``compact`` folds a log into the next snapshot. Tables take their
events independently: where one fails, its events are kept as they came in ``<base>/<table>/dead``, to
be run again by ``replay``, and the others go on; if they can't be kept either, the batch fails and is
retried whole. Lines that can't be read are kept in ``<base>/_unreadable``.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


@dataclass(frozen=True)
class Handler:
    """Which events a table takes, what of them, and how they are folded in."""

    table: str
    takes: Column
    rows: Callable[[DataFrame], DataFrame]
    fold: Callable[[DataFrame | None, DataFrame], DataFrame]


class Ingest:
    def __init__(self, spark: SparkSession, base: str, handlers: list[Handler], reader: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None):
        """``reader``: makes events and unreadable rows of what the stream brings, where that is lines."""
        self.spark, self.base, self.handlers, self.reader = spark, base, handlers, reader

    def batch(self, came: DataFrame, batch_id: int) -> None:
        if self.reader:
            came, bad = self.reader(came)
            bad.write.mode("overwrite").parquet(f"{self.base}/_unreadable/batch={batch_id}")
        order = {"arrival": F.lit(batch_id).cast("long"), "event_id": F.monotonically_increasing_id()}  # of batches, and in them of rows
        came = came.withColumns({k: v for k, v in order.items() if k not in came.columns})
        came = came.persist()
        try:
            for h in self.handlers:
                self._hand(h, came.filter(h.takes), f"batch={batch_id}")
        finally:
            came.unpersist()

    def _hand(self, h: Handler, events: DataFrame, part: str) -> None:
        try:
            h.rows(events).write.mode("overwrite").parquet(f"{self.base}/{h.table}/log/{part}")
            self._delete(f"{self.base}/{h.table}/dead/{part}")
        except Exception as e:  # one table's failure is kept, and the rest go on
            events.withColumn("error", F.lit(str(e)[:500])).write.mode("overwrite").parquet(f"{self.base}/{h.table}/dead/{part}")
            self._delete(f"{self.base}/{h.table}/log/{part}")

    def _path(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> None:
        where, system = self._path(path)
        system.delete(where, True)

    def dead(self, name: str) -> DataFrame | None:
        """Events of a table that failed, with ``error`` and ``batch``."""
        where, system = self._path(f"{self.base}/{name}/dead")
        return self.spark.read.parquet(str(where)) if system.exists(where) and system.listStatus(where) else None

    def replay(self, name: str) -> None:
        """Run the dead batches of a table again; the order of its log is that of arrival, whenever a row came in."""
        h = next(h for h in self.handlers if h.table == name)
        where, system = self._path(f"{self.base}/{name}/dead")
        for part in [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []:
            self._hand(h, self.spark.read.parquet(f"{self.base}/{name}/dead/{part}").drop("error"), part)

    def start(self, events: DataFrame, *, once: bool = False) -> StreamingQuery:
        writer = events.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.base}/_checkpoint")
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()

    def watch(self, connect: Callable[[], DataFrame], stall: float = 120.0, *, poll: float = 1.0, until: Callable[[], bool] = lambda: False) -> int:
        """Keep a stream running: where no row has come for ``stall`` seconds (0: never asked), connect anew.
        Returns how often it did, once ``until`` holds."""
        again, query, heard = 0, self.start(connect()), time.monotonic()
        seen = -1
        try:
            while not until():
                time.sleep(poll)
                last = query.lastProgress
                if last and last["batchId"] != seen and last["numInputRows"]:
                    seen, heard = last["batchId"], time.monotonic()
                if query.exception() or (stall and time.monotonic() - heard > stall):
                    query.stop()
                    again, query, heard = again + 1, self.start(connect()), time.monotonic()
        finally:
            query.stop()
        return again

    def _read(self, path: str) -> DataFrame | None:
        where, system = self._path(path)
        there = system.exists(where) and system.listStatus(where)
        return self.spark.read.parquet(path).drop("batch") if there else None

    def table(self, name: str) -> DataFrame | None:
        h = next(h for h in self.handlers if h.table == name)
        log, snapshot = self._read(f"{self.base}/{name}/log"), self._snapshot(name)
        return snapshot if log is None else h.fold(snapshot, log)

    def _snapshot(self, name: str) -> DataFrame | None:
        found = self._read(f"{self.base}/{name}/snapshots")
        return None if found is None else found.filter(F.col("snapshot") == found.agg(F.max("snapshot")).first()[0]).drop("snapshot")

    def compact(self, name: str, number: int) -> None:
        """Fold the log into snapshot ``number``, then drop the log; only while the stream stands still.

        A guard that reads old rows needs only the table, so nothing is lost with the log.
        """
        made = self.table(name)
        if made is None:
            return
        made.write.mode("overwrite").parquet(f"{self.base}/{name}/snapshots/snapshot={number}")
        self._delete(f"{self.base}/{name}/log")


def waypoints(events: DataFrame) -> DataFrame:
    """The systems of plotted routes, one row each, with their star class."""
    stop = events.filter(F.col("event") == "NavRoute").select("timestamp", F.explode("Route").alias("r"))
    at = lambda i: F.get(F.col("r.StarPos"), F.lit(i))
    return stop.select(F.col("r.SystemAddress").alias("address"), F.upper("r.StarSystem").alias("name"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), F.col("r.StarClass").alias("primary_star_class"), F.col("timestamp").alias("updated_at"))


def windowed(events: DataFrame, late: str, width: str) -> DataFrame:
    """Events counted in windows of time, with state bounded by how late they may be."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"))
