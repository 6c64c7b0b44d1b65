"""Batches of a stream as tables that can be written again.

A batch is written into a folder of its own for each attempt; one line of the ledger, put in place by an atomic rename, names the
attempt that counts. Readers follow the ledger, so they see whole batches only, and a batch that runs again after a failure
replaces what its first attempt left.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


@contextmanager
def settings(spark: SparkSession, **values: str | int | None) -> Iterator[None]:
    """Settings (``.`` as ``__``, null: as they are) while a stream starts: it keeps those with which it does."""
    names = {k.replace("__", "."): v for k, v in values.items() if v is not None}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


class Ledger:
    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.target = spark, target.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._path("").getFileSystem(self._conf)
        for part in ("data", "ledger", "open"):
            self._fs.mkdirs(self._path(part))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.target}/{name}" if name else self.target)

    def write(self, batch: DataFrame, batch_id: int, by: list[str] = ()) -> None:
        """Write a batch, or write it again."""
        attempt = f"{batch_id:012d}-{uuid.uuid4().hex}"
        writer = batch.write.partitionBy(*by) if by else batch.write
        writer.parquet(f"{self.target}/data/attempt={attempt}")
        self._record(batch_id, attempt)
        for status in self._fs.listStatus(self._path("data")):
            name = status.getPath().getName()
            if name.startswith(f"attempt={batch_id:012d}-") and name != f"attempt={attempt}":
                self._fs.delete(status.getPath(), True)

    def _record(self, batch_id: int, attempt: str) -> None:
        fresh, place = self._path(f"open/{attempt}.json"), self._path(f"ledger/{batch_id:012d}.json")
        out = self._fs.create(fresh, True)
        out.write(bytearray((json.dumps({"batch_id": batch_id, "attempt": attempt}) + "\n").encode()))
        out.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self._conf).rename(fresh, place, options)

    def batches(self) -> DataFrame:
        """``batch_id, attempt`` of every batch that is done."""
        return self.spark.read.schema("batch_id long, attempt string").json(f"{self.target}/ledger")

    def read(self, schema: str) -> DataFrame:
        """The rows of all batches that are done, with ``batch_id``."""
        data = self.spark.read.schema(f"{schema}, attempt string").parquet(f"{self.target}/data")
        return data.join(self.batches(), "attempt").drop("attempt")
