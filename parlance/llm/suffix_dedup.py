"""Suffix-array dedup of bytes by deep-shallow sorting.

A byte goes if some window of ``window`` bytes over it also starts earlier in the corpus. Sorting the suffixes of all
bytes would move every text a hundredfold; here only suffixes at anchors are sorted. A window's anchor is the place of
the smallest print of ``GRAM`` bytes in it (leftmost of equals), so equal windows have it at the same place. Contexts that
are equal as a whole need no sorting. Where one anchor has several contexts, the suffixes from the anchor on and the
reversed prefixes before it are sorted by ``suffixes.deep_shallow``; two windows are equal just if the common prefixes on
both sides are long enough, so classes of equal windows can be read off both orders.

Anchors with more than ``MOST`` contexts (a frequent line in different surroundings) are not gathered: their windows are
spread over the cluster by content instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import anchors as A
from parlance.llm.rows import keyed
from parlance.llm.scratch import stash
from parlance.llm.suffixes import deep_shallow
from parlance.llm.textnum import BYTES, BYTES2, U64, mix, slabs, strings

WINDOW, GRAM = 100, 32
MOST = 50_000
#: Contexts that are sorted together in one go.
TOGETHER = 20_000
#: Longest piece of a text handled at once; pieces overlap by a window less one byte.
PIECE, PLACE_BITS = 1 << 20, 23


def _piece_anchors(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """h, s, text number, first window, shape of a slab's anchors."""
    n = len(data) - window + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty, empty, empty
    whole = BYTES.prefix(data)
    grams = mix(BYTES.grams(whole, GRAM))
    bits = U64(PLACE_BITS)
    low = (grams >> bits << bits) | np.arange(len(grams), dtype=U64)  # leftmost of equals, and its place
    span, reach = window - GRAM + 1, 1
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < span:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    at = (low[:n] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    doc = np.searchsorted(offsets[1:], np.arange(n), "right")
    inside = np.arange(n) + window <= offsets[1:][doc]
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, n))
    kept = inside[start]
    start, count = start[kept], count[kept]
    at = at[start]
    end = start + count - 1 + window
    place = (at - start).astype(U64)
    s = mix(BYTES2.spans(BYTES2.prefix(data), start, end) + (count.astype(U64) << U64(8)) + place)
    # grams are cut to their high bits above only to choose; the print of the anchor has all of them
    return grams[at].view(np.int64), s.view(np.int64), doc[start], start - offsets[doc[start]], (count << 8) | (at - start)


def anchors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy()
            for lo, hi, data, offsets in slabs(strings(batch.column("text"))):
                step = PIECE - window + 1
                for from_ in range(0, max(1, len(data) - window + 1), step) if hi - lo == 1 else (0,):
                    part = data[from_ : from_ + PIECE] if hi - lo == 1 else data
                    h, s, doc, first, shape = _piece_anchors(part, offsets if len(part) == len(data) else np.array([0, len(part)]), window)
                    yield pa.record_batch(list(map(pa.array, A.told(h, s, key[lo + doc], first + from_, shape))), names=A.NAMES)

    return docs.select("key", "text").mapInArrow(run, A.ANCHORS)


def _cut(data: bytes, first: np.ndarray, size: np.ndarray) -> list[bytes]:
    return [data[a : a + n] for a, n in zip(first.tolist(), size.tolist(), strict=True)]


def _classes(order: np.ndarray, lcp: np.ndarray, depth: int) -> np.ndarray:
    """Number of each suffix's class of equal prefixes of ``depth``; suffixes of other groups never share one."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(lcp < depth)
    return out


def repeated_windows(h: np.ndarray, key: np.ndarray, first: np.ndarray, shape: np.ndarray, context: list[bytes], window: int) -> np.ndarray:
    """One row per context, one column per distance before the anchor: whether that window starts earlier too."""
    count, place = shape >> 8, shape & 255
    right = deep_shallow(h, [c[p:] for c, p in zip(context, place.tolist(), strict=True)])
    left = deep_shallow(h, [c[:p][::-1] for c, p in zip(context, place.tolist(), strict=True)])
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((first, key))] = np.arange(len(h))
    most = int(place.max(initial=0))
    out = np.zeros((len(h), most + 1), bool)
    for back in range(most + 1):
        at = np.flatnonzero((back <= place) & (back > place - count))  # those whose own windows include this one
        if len(at) < 2:
            continue
        one, two = _classes(*right, window - back)[at], _classes(*left, back)[at]
        both = np.lexsort((rank[at], two, one))
        same = (one[both[1:]] == one[both[:-1]]) & (two[both[1:]] == two[both[:-1]])
        out[at[both[1:][same]], back] = True
    return out


def _stretches(flags: np.ndarray, key: np.ndarray, first: np.ndarray, shape: np.ndarray, window: int) -> pa.RecordBatch:
    """Flags by distance before the anchor -> stretches of bytes."""
    row, back = np.nonzero(flags)
    start = first[row] + (shape[row] & 255) - back
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > start[:-1] + 1)
    at = np.flatnonzero(new)
    last = start[np.append(at[1:], len(row)) - 1] if len(at) else start
    return pa.record_batch([pa.array(key[row[at]]), pa.array(start[at]), pa.array(last + window)], names=["key", "lo", "hi"])


def compared(requests: DataFrame, window: int = WINDOW) -> DataFrame:
    """Stretches of windows that another context of the same anchor has earlier."""
    sizes = requests.groupBy("h").count()
    few = requests.join(sizes.filter(f"count <= {MOST}").select("h"), "h").repartition("h").sortWithinPartitions("h")
    columns = ["h", "key", "first", "shape", "context"]

    def sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table):
            h, key, first, shape = (rows.column(c).to_numpy() for c in columns[:4])
            flags = repeated_windows(h, key, first, shape, rows.column("context").to_pylist(), window)
            return _stretches(flags, key, first, shape, window)

        for batch in batches:
            for lo in range(0, batch.num_rows, TOGETHER):
                held.append(batch.select(columns).slice(lo, TOGETHER))
                if sum(b.num_rows for b in held) >= TOGETHER:  # whole groups only: the last stays
                    table = pa.Table.from_batches(held).combine_chunks()
                    h = table.column("h").to_numpy()
                    cut = int(np.searchsorted(h, h[-1]))
                    if cut:
                        yield done(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
        if held:
            yield done(pa.Table.from_batches(held).combine_chunks())

    small = few.mapInArrow(sort_groups, A.COVERED)
    many = requests.join(sizes.filter(f"count > {MOST}").select("h"), "h")
    each = many.select("key", F.posexplode(F.expr(f"transform(sequence(1, cast(shiftright(shape, 8) as int)), i -> substring(context, i, {window}))")).alias("i", "w"), "first")
    each = each.select("key", (F.col("first") + F.col("i")).alias("at"), F.sha2("w", 256).alias("w"))
    earliest = each.groupBy("w").agg(F.min(F.struct("key", "at")).alias("e"))
    large = each.join(earliest, "w").filter("e.key <> key or e.at <> at").select("key", F.col("at").alias("lo"), (F.col("at") + window).alias("hi"))
    return small.union(large)


def dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """``n_bytes, n_removed, n_spans, kept_sha256`` of every row, with ``keep_text`` also ``kept`` (binary).

    Null texts count as empty; texts shorter than the window lose nothing. Rows stand in the order of their ids (null
    last); rows of equal id are rows of their own, in the order of their texts, so the second of two equal rows loses
    all of its bytes if it has a window.
    """
    docs, _ = keyed(documents, id_col, text_col)
    found = stash(A.scanned(anchors(docs, window), window), "anchors")
    requests = stash(A.contexts(docs, found, _cut, window), "contexts")
    covered = A.covered_whole(found, window).union(compared(requests, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            size, gone, spans, digest, kept = [], [], [], [], []
            lows, highs = batch.column("lows"), batch.column("highs")
            for i, text in enumerate(batch.column("text")):
                data = memoryview(text.as_buffer()) if text.is_valid and text.as_buffer() else b""
                parts = [data]
                n = removed = 0
                if lows[i].is_valid:
                    a, b = A.joined_runs(lows[i].values.to_numpy(), highs[i].values.to_numpy())
                    n, removed = len(a), int((b - a).sum())
                    parts = [data[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(data)], strict=True)]
                sha = hashlib.sha256()
                for p in parts:
                    sha.update(p)
                size.append(len(data))
                gone.append(removed)
                spans.append(n)
                digest.append(sha.hexdigest())
                if keep_text:
                    kept.append(b"".join(parts))
            columns = [batch.column("id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())]
            names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.record_batch(columns + ([pa.array(kept, pa.binary())] if keep_text else []), names=names + (["kept"] if keep_text else []))

    schema = f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")
    return A.with_covered(docs, covered).mapInArrow(run, schema)
