"""Counts of periods that follow a stream, with corrections for late rows and a side output for rows that come too late."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from parlance.streaming.ledger import Ledger, settings

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COUNTS = "actor string, start timestamp, n long, revision int, kind string"
_OUT = "actor string, start_us long, n long, revision int, kind string"
_PARTIAL = "actor string, start_us long, end_us long, n long, newest_us long"


class OpenPeriods(StatefulProcessor):
    """Of one actor: the open periods with their counts, and the newest time seen.

    A period closes when the actor's newest time is ``late_us`` past its end. What a batch holds is judged by the newest time before it.
    """

    def __init__(self, late_us: int):
        self.late_us = late_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "start_us long", "end_us long, n long, revision int")
        self.newest = handle.getValueState("newest", "newest_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.newest.get()
        closed = known[0] - self.late_us if known is not None else None
        newest, sums = known[0] if known is not None else None, {}
        for part in rows:
            for start, end, n, seen in zip(part["start_us"].tolist(), part["end_us"].tolist(), part["n"].tolist(), part["newest_us"].tolist(), strict=True):
                sums[start] = (end, sums.get(start, (end, 0))[1] + n)
                newest = seen if newest is None else max(newest, seen)
        out = []
        for start, (end, n) in sorted(sums.items()):
            if closed is not None and end <= closed:
                out.append((key[0], start, n, 0, "late"))
                continue
            held = self.open.getValue((start,)) if self.open.containsKey((start,)) else None
            total, revision = (n, 0) if held is None else (held[1] + n, held[2] + 1)
            self.open.updateValue((start,), (end, total, revision))
            out.append((key[0], start, total, revision, "correction" if revision else "count"))
        if newest is not None:
            self.newest.update((newest,))
            for start in [k[0] for k, v in self.open.iterator() if v[0] <= newest - self.late_us]:
                self.open.removeKey((start,))
        yield pd.DataFrame(out, columns=["actor", "start_us", "n", "revision", "kind"])

    def close(self) -> None:
        pass


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each actor and period of a batch, so that a busy actor doesn't shuffle its rows."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).group_by(["actor", "start_us", "end_us"]).aggregate([("time_us", "count"), ("time_us", "max")])
        yield from table.select(["actor", "start_us", "end_us", "time_us_count", "time_us_max"]).rename_columns(["actor", "start_us", "end_us", "n", "newest_us"]).to_batches()


def changes(rows: DataFrame, time: str, actor: str, unit: str = "DAY", late_days: int = 7) -> DataFrame:
    """``actor, start, n, revision, kind`` for every period that a batch touches.

    ``count`` is a period's first number, ``correction`` a later one in its place, ``late`` the number of rows whose period was closed
    before their batch, counted apart. Rows without a time are not counted; those without an actor are an actor's of their own.
    """
    start = F.date_trunc(unit, F.col(time))
    dated = rows.filter(F.col(time).isNotNull()).select(
        F.col(actor).cast("string").alias("actor"), F.unix_micros(start).alias("start_us"), F.unix_micros(start + F.expr(f"interval 1 {unit}")).alias("end_us"), F.unix_micros(F.col(time).cast("timestamp")).alias("time_us")
    )
    counted = dated.mapInArrow(_partial, _PARTIAL).groupBy("actor")
    found = counted.transformWithStateInPandas(OpenPeriods(late_days * 86_400_000_000), _OUT, "Update", "none")
    return found.select("actor", F.timestamp_micros("start_us").alias("start"), "n", "revision", "kind")


def follow(rows: DataFrame, time: str, actor: str, target: str, checkpoint: str, unit: str = "DAY", late_days: int = 7, parts: int | None = None) -> StreamingQuery:
    """Count what has landed and end; started again, go on from there. Changes are written once each. ``parts`` of state are fixed by the first start (null: as the session shuffles)."""
    spark = rows.sparkSession
    ledger = Ledger(spark, target)
    with settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKS, spark__sql__shuffle__partitions=parts):  # map state needs that store
        writer = changes(rows, time, actor, unit, late_days).writeStream.outputMode("update").foreachBatch(lambda batch, k: ledger.write(batch, k))
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(spark: SparkSession, target: str) -> DataFrame:
    """``actor, start, n, revisions, late``: the last number of each period, how often it was corrected, and rows that came too late for it."""
    rows = Ledger(spark, target).read(COUNTS)
    number = F.when(F.col("kind") != "late", F.col("revision"))
    return rows.groupBy("actor", "start").agg(
        F.coalesce(F.max_by("n", number), F.lit(0)).alias("n"), F.coalesce(F.max(number), F.lit(0)).alias("revisions"), F.coalesce(F.sum(F.when(F.col("kind") == "late", F.col("n"))), F.lit(0)).alias("late")
    )
