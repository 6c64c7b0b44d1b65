"""Substring dedup of words by recompression.

Each round names every maximal run of one symbol, then the pairs of a left and a right symbol (sides follow from the
symbol's own name and the round). A name is a print of what it stands for, the same in every task, so names are global
without a dictionary passing through the cluster, and equal word sequences get equal symbols but for those near
their ends. Beside its words a symbol carries its surroundings: the words that must be seen to know that
it was formed. The words themselves are the symbols of level 0.

A window of ``window`` words names as its anchor a symbol of the highest level that starts in its first half and whose
surroundings lie inside it (of these the one with the smallest print), so equal windows name equal symbols. Together
with the half window of words from its start, which lies inside too, a symbol is rarely met by chance. A Spark round then brings together all
occurrences of the symbols so named (``anchors``); contexts that are equal around one symbol repeat as a whole, and where a
symbol stands in several contexts, their windows are compared word by word, by digest of the very words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parlance.llm import anchors as A
from parlance.llm.rows import keyed
from parlance.llm.scratch import stash
from parlance.llm.textnum import BYTES2, U64, mix, slabs, strings, word_prints, words

WINDOW, ROUNDS = 20, 3
PLACE_BITS = 26


class Symbols:
    """Parallel arrays of one level: print, words [lo, hi), surroundings [cs, ce), text, and whether the surroundings stay inside the text."""

    def __init__(self, name, lo, hi, cs, ce, doc, sure):
        self.name, self.lo, self.hi, self.cs, self.ce, self.doc, self.sure = name, lo, hi, cs, ce, doc, sure

    def __len__(self) -> int:
        return len(self.name)


def name_runs(x: Symbols, level: int) -> Symbols:
    """Maximal runs become one symbol; to know that a run (of one, too) ends, its neighbours must be seen."""
    n = len(x)
    new = np.ones(n, bool)
    new[1:] = (x.name[1:] != x.name[:-1]) | (x.doc[1:] != x.doc[:-1])
    start = np.flatnonzero(new)
    last = np.append(start[1:], n) - 1
    count = last - start + 1
    name = np.where(count > 1, mix(x.name[start] + U64(0xA24BAED4963EE407) * count.astype(U64) + U64(2 * level)), x.name[start])
    doc, sure = x.doc[start], x.sure[start] & x.sure[last]
    cs, ce = x.cs[start].copy(), x.ce[last].copy()
    joined = doc[1:] == doc[:-1] if len(start) else np.zeros(0, bool)
    # neighbours: their surroundings count as well
    left, right = np.zeros(len(start), bool), np.zeros(len(start), bool)
    left[1:] = right[:-1] = joined
    at = np.flatnonzero(left)
    cs[at] = np.minimum(cs[at], x.cs[last[at - 1]])
    sure_left = np.zeros(len(start), bool)
    sure_left[at] = x.sure[last[at - 1]]
    at = np.flatnonzero(right)
    ce[at] = np.maximum(ce[at], x.ce[start[at + 1]])
    sure_right = np.zeros(len(start), bool)
    sure_right[at] = x.sure[start[at + 1]]
    return Symbols(name, x.lo[start], x.hi[last], cs, ce, doc, sure & sure_left & sure_right)


def name_pairs(x: Symbols, level: int) -> Symbols:
    """Each left symbol before a right symbol joins it. A left one that stays must see its right neighbour, a right one its left."""
    n = len(x)
    if n < 2:
        return x
    is_left = (mix(x.name + U64(0x9FB21C651E98DF25 * (level + 1) % 2**64)) & U64(1)).astype(bool)
    next_to = x.doc[1:] == x.doc[:-1]
    head = np.zeros(n, bool)
    head[:-1] = is_left[:-1] & ~is_left[1:] & next_to
    tail = np.zeros(n, bool)
    tail[1:] = head[:-1]
    first = np.flatnonzero(~tail)
    last = first + head[first]
    name = np.where(head[first], mix(mix(x.name[first]) + x.name[last] + U64(2 * level + 1)), x.name[first])
    cs, ce, sure = x.cs[first].copy(), x.ce[last].copy(), x.sure[first] & x.sure[last]
    alone = ~head[first]
    stays_left, stays_right = alone & is_left[first], alone & ~is_left[first]
    has_next = np.append(next_to, False)[first]
    has_prev = np.append(False, next_to)[first]
    sure &= ~(stays_left & ~has_next) & ~(stays_right & ~has_prev)
    at = np.flatnonzero(stays_left & has_next)
    ce[at] = np.maximum(ce[at], x.ce[first[at] + 1])
    sure[at] &= x.sure[first[at] + 1]
    at = np.flatnonzero(stays_right & has_prev)
    cs[at] = np.minimum(cs[at], x.cs[first[at] - 1])
    sure[at] &= x.sure[first[at] - 1]
    return Symbols(name, x.lo[first], x.hi[last], cs, ce, x.doc[first], sure)


def levels(prints: np.ndarray, doc: np.ndarray, rounds: int) -> list[Symbols]:
    n = len(prints)
    place = np.arange(n)
    out = [Symbols(prints, place, place + 1, place, place + 1, doc, np.ones(n, bool))]
    for k in range(rounds):
        out.append(name_pairs(name_runs(out[-1], k), k))
    return out


def named_anchors(prints: np.ndarray, doc: np.ndarray, window: int, rounds: int) -> tuple[np.ndarray, ...]:
    """h, s, text number, first window (word number in the slab), shape of the anchors of a slab's windows."""
    n = len(prints) - window + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty, empty, empty
    open_ = np.flatnonzero(doc[:n] == doc[window - 1 :])
    every = open_
    told = window // 2  # words from the symbol on that its print as an anchor also covers
    after = BYTES2.grams(BYTES2.prefix(prints), told)
    symbol = np.zeros(n, np.int64)  # level << 40 | number of the symbol
    h, place = np.zeros(n, U64), np.zeros(n, np.int64)
    stack = levels(prints, doc, rounds)
    for level in range(rounds, -1, -1):
        x = stack[level]
        known = np.flatnonzero(x.sure & (x.ce - x.cs <= window))
        if not len(known) or not len(open_):
            continue
        cs, ce = np.maximum.accumulate(x.cs[known]), x.ce[known]
        key = (mix(x.name[known] + U64(level)) >> U64(PLACE_BITS) << U64(PLACE_BITS)) | np.arange(len(known), dtype=U64)
        a = np.searchsorted(cs, open_, "left")
        b = np.minimum(np.searchsorted(np.maximum.accumulate(ce), open_ + window, "right"), np.searchsorted(x.lo[known], open_ + window - told, "right"))
        best = np.full(len(open_), ~U64(0), U64)
        todo = np.flatnonzero(a < b)
        step = 0
        while len(todo):
            best[todo] = np.minimum(best[todo], key[a[todo] + step])
            step += 1
            todo = todo[a[todo] + step < b[todo]]
        got = np.flatnonzero(a < b)
        chosen = known[(best[got] & U64((1 << PLACE_BITS) - 1)).astype(np.int64)]
        at = open_[got]
        symbol[at] = (level << 40) | chosen
        h[at] = mix(mix(x.name[chosen] + U64(1 + level)) + after[x.lo[chosen]])
        place[at] = x.lo[chosen]
        open_ = open_[a >= b]
    new = np.ones(len(every), bool)
    new[1:] = (symbol[every[1:]] != symbol[every[:-1]]) | (every[1:] != every[:-1] + 1)
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(every)))
    first = every[at]
    s = mix(BYTES2.spans(BYTES2.prefix(prints), first, first + count - 1 + window) + (count.astype(U64) << U64(8)) + (place[first] - first).astype(U64))
    return h[first].view(np.int64), s.view(np.int64), doc[first], first, (count << 8) | (place[first] - first)


def anchors(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy()
            for lo, hi, data, offsets in slabs(strings(batch.column("text"))):
                start, end, doc = words(data, offsets)
                before = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=hi - lo))))
                h, s, of, first, shape = named_anchors(word_prints(data, start, end), doc, window, rounds)
                yield pa.record_batch(list(map(pa.array, A.told(h, s, key[lo + of], first - before[of], shape))), names=A.NAMES)

    return docs.select("key", "text").mapInArrow(run, A.ANCHORS)


def _cut(data: bytes, first: np.ndarray, size: np.ndarray) -> list[bytes]:
    parts = data.split()  # bytes split at just the six characters that end a word
    return [b" ".join(parts[a : a + n]) for a, n in zip(first.tolist(), size.tolist(), strict=True)]


def compared(requests: DataFrame, window: int = WINDOW) -> DataFrame:
    """Stretches of windows that start earlier in another context, met by a 128-bit digest of their very words.

    Windows are sorted by digest, row and place in one shuffle; the pass over them remembers one row.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, row, place = [], [], []
            first = batch.column("first").to_numpy()
            for i, context in enumerate(batch.column("context").to_pylist()):
                parts = context.split(b" ")
                n = len(parts) - window + 1
                raw += [hashlib.blake2b(b" ".join(parts[k : k + window]), digest_size=16).digest() for k in range(n)]
                row.append(np.full(n, i))
                place.append(first[i] + np.arange(n))
            if raw:
                two = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
                yield pa.record_batch([pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy()), pa.array(batch.column("key").to_numpy()[np.concatenate(row)]), pa.array(np.concatenate(place))], names=["w1", "w2", "key", "at"])

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            one, two, key, at = (batch.column(k).to_numpy() for k in range(4))
            if not len(one):
                continue
            same = np.zeros(len(one), bool)
            same[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
            same[0] = last == (one[0], two[0])
            last = (one[-1], two[-1])
            hit = np.flatnonzero(same)
            yield pa.record_batch([pa.array(key[hit]), pa.array(at[hit]), pa.array(at[hit] + window)], names=["key", "lo", "hi"])

    each = requests.select("key", "first", "context").mapInArrow(digests, "w1 long, w2 long, key long, at long")
    return each.repartition("w1").sortWithinPartitions("w1", "w2", "key", "at").mapInArrow(later, A.COVERED)


def dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, rounds: int = ROUNDS, keep_text: bool = False) -> DataFrame:
    """``n_words, n_removed, kept_sha256`` of every row, with ``keep_text`` also ``kept`` (the words left, joined by a space).

    Null texts have no words; texts of fewer words than the window lose none. Rows stand in the order of their ids (null
    last); rows of equal id are rows of their own, in the order of their texts.
    """
    docs, _ = keyed(documents, id_col, text_col)
    found = stash(A.scanned(anchors(docs, window, rounds), window), "anchors")
    requests = A.contexts(docs, found, _cut, window)
    covered = A.covered_whole(found, window).union(compared(stash(requests, "contexts"), window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, digest, kept = [], [], [], []
            lows, highs = batch.column("lows"), batch.column("highs")
            for i, text in enumerate(batch.column("text")):
                parts = text.as_buffer().to_pybytes().split() if text.is_valid and text.as_buffer() else []
                total.append(len(parts))
                if lows[i].is_valid:
                    a, b = A.joined_runs(lows[i].values.to_numpy(), highs[i].values.to_numpy())
                    parts = [w for x, y in zip([0, *b.tolist()], [*a.tolist(), len(parts)], strict=True) for w in parts[x:y]]
                gone.append(total[-1] - len(parts))
                left = b" ".join(parts)
                digest.append(hashlib.sha256(left).hexdigest())
                if keep_text:
                    kept.append(left)
            columns = [batch.column("id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
            names = [id_col, "n_words", "n_removed", "kept_sha256"]
            yield pa.record_batch(columns + ([pa.array(kept, pa.binary()).cast(pa.string())] if keep_text else []), names=names + (["kept"] if keep_text else []))

    schema = f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if keep_text else "")
    return A.with_covered(docs, covered).mapInArrow(run, schema)
