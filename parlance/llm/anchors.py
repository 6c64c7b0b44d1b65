"""Anchored windows: finding repeated windows of fixed length without shuffling the text once per place.

A window is so many units (bytes, words) of one text. Each window names one anchor inside it by its own content, so equal
windows name equal anchors, at the same place. All windows of a text that name the same anchor follow one another; the
stretch that they cover is the anchor's context. An operator emits one row per anchor:

``h`` print of the anchor, ``s`` print of the context, ``key`` row of the text, ``first`` place of the first window,
``shape`` = windows << 8 | place of the anchor inside the context.

A row that repeats another of its batch is told where it is found (``told``): it only passes through the sort, in whatever part, so an anchor that occurs
everywhere has few rows to sort. Rows are sorted by ``(h, s, key, first)``. Of rows with equal ``h`` and ``s`` all but the first repeat whole contexts. Where
an anchor has several contexts, the first row of each is a request: its text is fetched and compared unit by unit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.rows import bitmap, in_bitmap
from parlance.llm.scratch import stash
from parlance.llm.textnum import U64, mix

ANCHORS = "h long, s long, key long, first long, shape long"
NAMES = ["h", "s", "key", "first", "shape"]
COVERED = "key long, lo long, hi long"


def told(h: np.ndarray, s: np.ndarray, key: np.ndarray, first: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rows of a batch; of those with equal h and s all but the first in order of key and place have a negative shape and some h of their own."""
    order = np.lexsort((first, key, s, h))
    again = np.zeros(len(h), bool)
    again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (s[order[1:]] == s[order[:-1]])
    spread = mix((key.astype(U64) << U64(24)) + first.astype(U64)).view(np.int64)
    return np.where(again, spread, h), s, key, first, np.where(again, -shape, shape)


def scanned(anchors: DataFrame, window: int) -> DataFrame:
    """``kind, h, key, first, shape``: kind 0 repeats its whole context, kind 1 is a request.

    One pass over sorted rows that remembers one row and one flag between batches, however often an anchor occurs.
    """
    ordered = anchors.repartition("h").sortWithinPartitions("h", "s", "key", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the last first row of a context: h, s, key, first, shape, and whether it has been asked for
        for batch in batches:
            h, s, key, first, shape = (batch.column(i).to_numpy() for i in range(5))
            known = shape < 0
            if known.any():
                yield pa.record_batch([pa.array(np.zeros(int(known.sum()), np.int32)), pa.array(h[known]), pa.array(key[known]), pa.array(first[known]), pa.array(-shape[known])], names=["kind", "h", "key", "first", "shape"])
                h, s, key, first, shape = (x[~known] for x in (h, s, key, first, shape))
            if not len(h):
                continue
            asked = np.zeros(len(h), bool)
            if last is not None:
                h, s, key, first, shape, asked = (np.concatenate((a, b)) for a, b in zip(last, (h, s, key, first, shape, asked), strict=True))
            same_h = np.zeros(len(h), bool)
            same_h[1:] = h[1:] == h[:-1]
            repeat = np.zeros(len(h), bool)
            repeat[1:] = same_h[1:] & (s[1:] == s[:-1])
            lead = np.flatnonzero(~repeat)  # first rows of contexts
            several = np.zeros(len(lead), bool)
            several[1:] = h[lead[1:]] == h[lead[:-1]]
            several[:-1] |= several[1:].copy()
            request = lead[several & ~asked[lead]]
            at = np.flatnonzero(repeat)
            rows = np.concatenate((at, request))
            kind = np.concatenate((np.zeros(len(at), np.int32), np.ones(len(request), np.int32)))
            end = lead[-1:]
            last = tuple(x[end] for x in (h, s, key, first, shape)) + (several[-1:] | asked[end],)
            if len(rows):
                yield pa.record_batch([pa.array(kind), *(pa.array(x[rows]) for x in (h, key, first, shape))], names=["kind", "h", "key", "first", "shape"])

    return ordered.mapInArrow(run, "kind int, h long, key long, first long, shape long")


def covered_whole(found: DataFrame, window: int) -> DataFrame:
    """The stretches of rows that repeat their whole context."""
    return found.filter("kind = 0").select("key", F.col("first").alias("lo"), F.expr(f"first + shiftright(shape, 8) - 1 + {window}").alias("hi"))


def contexts(docs: DataFrame, found: DataFrame, cut: Callable[[bytes, np.ndarray, np.ndarray], list[bytes]], window: int) -> DataFrame:
    """``h, key, first, shape, context`` of every request; ``cut`` takes the contexts out of one text.

    A bitmap of the rows asked for spares other texts the shuffle; the join that follows is exact.
    """
    asked = found.filter("kind = 1").select("h", "key", "first", "shape")
    keys = asked.select("key").distinct()
    count = keys.count()
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(keys, count))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(sent.value, batch.column("key").to_numpy())))

    texts = docs.select("key", "text").mapInArrow(needed, "key long, text string")
    lists = asked.groupBy("key").agg(F.collect_list(F.struct("h", "first", "shape")).alias("asked"))
    met = texts.join(lists.hint("shuffle_hash"), "key")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column("asked")
            edge = want.offsets.to_numpy() - want.offsets[0].as_py()
            h, first, shape = (want.flatten().field(k).to_numpy() for k in range(3))
            parts: list[bytes] = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                at = slice(edge[i], edge[i + 1])
                parts += cut((text or "").encode("utf-8", "surrogatepass"), first[at], (shape[at] >> 8) - 1 + window)
            key = np.repeat(batch.column("key").to_numpy(), np.diff(edge))
            yield pa.record_batch([pa.array(h), pa.array(key), pa.array(first), pa.array(shape), pa.array(parts, pa.binary())], names=["h", "key", "first", "shape", "context"])

    return met.mapInArrow(take, "h long, key long, first long, shape long, context binary")


def gathered(covered: DataFrame) -> DataFrame:
    """``key, lows, highs``: the stretches of each text, in order of their place."""
    parts = covered.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("parts"))
    return parts.select("key", "parts.lo", "parts.hi").toDF("key", "lows", "highs")


def with_covered(docs: DataFrame, covered: DataFrame) -> DataFrame:
    """``id, text, lows, highs`` of every row (null without stretches)."""
    return docs.join(gathered(stash(covered, "covered")).hint("shuffle_hash"), "key", "left").select("id", "text", "lows", "highs")


def joined_runs(lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of stretches sorted by their start; touching ones are one run."""
    reach = np.maximum.accumulate(highs)
    new = np.ones(len(lows), bool)
    new[1:] = lows[1:] > reach[:-1]
    starts = np.flatnonzero(new)
    return lows[starts], reach[np.append(starts[1:], len(lows)) - 1]
