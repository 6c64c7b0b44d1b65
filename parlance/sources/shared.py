"""Tables between rounds, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; local sessions (tests) may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="parlance-"))


def written(df: DataFrame, name: str = "round") -> DataFrame:
    """``df`` written as Parquet and read back: a lost executor costs one round, and ``dropped`` gives the disk back."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def counted(df: DataFrame, which: Column, name: str = "round") -> tuple[DataFrame, int]:
    """``written``, and how many of its rows fulfil a condition, counted while they are written."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.when(which, 1)).alias("n")), name)
    return out, seen.get["n"]


def dropped(*tables: DataFrame) -> None:
    """Delete tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
