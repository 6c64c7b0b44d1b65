"""Row keys, sorted scans and bitmaps that several operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.scratch import discard, stash, text_rows
from parlance.llm.textnum import mix


def keyed(documents: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """``key, id, text`` with one key per row, in the order of the ids (null last), and whether the key is the id.

    Where ids are unique and not null the key is the id. Else rows are numbered in the order of id and text, so
    that repeated rows are rows of their own.
    """
    rows = text_rows(documents, id_col, text_col)
    repeated = rows.groupBy("id").count().filter("count > 1 or id is null").limit(1).count()
    if not repeated:
        return rows.select(F.col("id").alias("key"), "id", "text"), True
    order = [F.col("id").asc_nulls_last(), F.col("text")]
    numbered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("key", F.monotonically_increasing_id())
    return stash(numbered.select("key", "id", "text"), "keyed"), False


#: A key is hot if it has more rows than this and than a thousandth of all; so a thousand are hot at most.
HOT_ROWS, HOT_KEYS = 10_000, 1000


def attached(rows: DataFrame, named: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``named``, which has one row for each key; rows of hot keys stay where they are, the others are shuffled.

    Both should be tables: they are read twice.
    """
    counts = rows.groupBy(*on).agg(F.count("*").alias("__n"))
    least = max(HOT_ROWS, rows.count() // HOT_KEYS)
    hot = stash(counts.filter(F.col("__n") > least).select(*on), "hot")  # HOT_KEYS rows at most
    rest = rows.join(F.broadcast(hot), on, "left_anti").join(named.hint("merge"), on, how)
    if not hot.limit(1).count():
        return rest
    return rows.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(named.join(F.broadcast(hot), on, "left_semi")), on, how).unionByName(rest)


#: Bits of a bitmap of keys: between 2**20 and 2**27 (16 MB), eight for each key where that suffices.
LEAST_BITS, MOST_BITS, BLOCK = 1 << 20, 1 << 27, 1 << 19


def slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def bitmap(keys: DataFrame, count: int) -> np.ndarray:
    """A bitmap of hashed keys whose size is bounded: it only spares rows a shuffle, an exact join follows."""
    bits = LEAST_BITS
    while bits < min(8 * count, MOST_BITS):
        bits *= 2

    def slots(batches):
        for b in batches:
            at = np.unique(slot(b.column(0).to_numpy(), bits))
            yield pa.record_batch([pa.array(at // BLOCK), pa.array(at % BLOCK)], names=["block", "at"])

    def fill(batches):
        got: dict[int, np.ndarray] = {}
        for b in batches:
            block, at = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k in np.unique(block):
                got.setdefault(int(k), np.zeros(BLOCK, bool))[at[block == k]] = True
        for k, flags in got.items():
            yield pa.record_batch([pa.array([k], pa.int64()), pa.array([np.packbits(flags).tobytes()], pa.binary())], names=["block", "flags"])

    parts = keys.mapInArrow(slots, "block long, at long").repartition(bits // BLOCK, "block").mapInArrow(fill, "block long, flags binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in parts:
        out[r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] |= np.frombuffer(bytes(r["flags"]), np.uint8)
    return out


def in_bitmap(packed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = slot(keys, len(packed) * 8)
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def components(links: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable, of every node in ``links (a, b)``.

    Alternating large and small stars; each round is a table in the shared folder, and the rounds end when
    the edges no longer change.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges, before = stash(edges, "edges"), None
    while True:
        both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = F.least(F.col("u"), F.min("v").over(Window.partitionBy("u")))
        large = both.withColumn("m", least).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = F.min("b").over(Window.partitionBy("a"))
        starred = large.withColumn("m", low)
        small = starred.select(F.col("b").alias("a"), F.col("m").alias("b")).union(starred.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        used, edges = edges, stash(small, "edges")
        discard(used)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())
        before = tuple(now)
