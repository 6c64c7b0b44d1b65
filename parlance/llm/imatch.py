"""I-Match fingerprints: hashes of the sorted distinct terms that a text shares with randomised parts of a lexicon.

The lexicon holds the terms in a band of inverse document frequency: neither in more than one document of ``2**COMMON`` nor in less
than one of ``2**RARE``. Each of its documents counts at least ``N / 2**RARE`` times in the sum of all documents' distinct
terms, so it has at most ``2**RARE`` times as many terms as a document has on average, however large the corpus is; that is
what is broadcast.

A lexicon is thinned at random: in thinning k at level l a term stays with a chance of ``2**-l``, and what stays at a
level is part of what stays below it. A text with T terms of the lexicon is hashed at the three levels about log2(T), where two
to a half of its terms stay, so that an edit leaves some of the ``PARTS`` hashes as they were. Two texts are compared at the
sparsest level of both at which half of the thinned lexicons meet either; their likeness is the share of equal hashes there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.divergence import LOWER, TERM_BYTE, term_places
from parlance.llm.scratch import arrow_rows, stash, text_rows
from parlance.llm.textnum import mix, slabs, strings, word_prints

#: Bounds of the band as powers of two, thinned lexicons, levels of a fingerprint.
COMMON, RARE, PARTS, LEVELS = 4, 12, 24, 3
#: Terms that the lexicon may have, bytes worked on at a time, rows of a batch.
MOST_TERMS, SLAB, ROWS = 1 << 25, 4 << 20, 1000
#: First byte of a fingerprint of a text without terms of the lexicon: a hash of the text follows.
WHOLE = 255

SEEDS = mix(np.arange(1, PARTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
STEP = np.uint64(0xD1342543DE82EF95)


def _prints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[data]
    start, length, text = term_places(low, offsets)
    return text, word_prints(low, start, start + length)


def _distinct(text: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs sorted by text and print, each once."""
    order = np.lexsort((prints, text))
    text, prints = text[order], prints[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (prints[1:] != prints[:-1])
    return text[new], prints[new]


def distinct_terms(texts: pa.Array, lexicon: np.ndarray | None = None, size: int = SLAB) -> tuple[np.ndarray, np.ndarray]:
    """(text number, print) of the distinct terms of all texts, sorted; only those of the lexicon if there is one.

    A text of more than ``size`` bytes is cut between terms, so memory grows with its distinct terms only.
    """

    def known(text: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if lexicon is not None:
            at = np.searchsorted(lexicon, prints)
            at[at == len(lexicon)] = 0
            there = lexicon[at] == prints if len(lexicon) else np.zeros(len(prints), bool)
            text, prints = text[there], prints[there]
        return _distinct(text, prints)

    parts = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for first, last, data, offsets in slabs(texts, size):
        if last - first == 1 and len(data) > size:
            found = np.zeros(0, np.uint64)
            for lo, hi in cuts(data, size):
                found = np.union1d(found, known(*_prints(data[lo:hi], np.array([0, hi - lo])))[1])
            parts.append((np.full(len(found), first), found))
        else:
            text, prints = known(*_prints(data, offsets))
            parts.append((text + first, prints))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def cuts(data: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Pieces of about ``size`` bytes that end behind a term; a longer term makes its piece longer."""
    lo = 0
    while lo < len(data):
        hi = min(len(data), lo + size)
        while hi < len(data) and TERM_BYTE[data[hi]]:
            ends = np.flatnonzero(~TERM_BYTE[data[hi : hi + size]])
            hi = min(len(data), hi + (int(ends[0]) if len(ends) else size))
        yield lo, hi
        lo = hi


def document_frequencies(texts: DataFrame, size: int = SLAB) -> DataFrame:
    """``print, docs`` of every term of ``texts`` (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, docs = np.unique(distinct_terms(strings(batch.column(0)), size=size)[1], return_counts=True)
            yield pa.record_batch([pa.array(prints.view(np.int64)), pa.array(docs.astype(np.int64))], names=["print", "docs"])

    return texts.mapInArrow(count, "print long, docs long").groupBy("print").agg(F.sum("docs").alias("docs"))


def lexicon(texts: DataFrame, common: int = COMMON, rare: int = RARE) -> np.ndarray:
    """Sorted prints of the terms in the band. Below ``2**common`` texts, terms of a single text are in it too."""
    n = texts.count()
    band = document_frequencies(texts).filter((F.col("docs") * F.lit(2**rare) >= n) & (F.col("docs") * F.lit(2**common) <= max(n, 2**common))).select("print")
    band = stash(band, "lexicon")
    terms = band.count()
    if terms > MOST_TERMS:
        raise ValueError(f"the band holds {terms} terms, more than {MOST_TERMS}: texts are too long for it, choose a smaller `rare`")
    if not terms:
        return np.zeros(0, np.uint64)
    return np.sort(band.toArrow().column("print").to_numpy().astype(np.int64).view(np.uint64))


def fingerprints(texts: pa.Array, lexicon: np.ndarray) -> np.ndarray:
    """A row of ``1 + 2 * LEVELS * PARTS`` bytes for each text: the first level (or ``WHOLE``), then the hashes by level."""
    n = len(texts)
    text, prints = distinct_terms(texts, lexicon)
    count = np.bincount(text, minlength=n)
    base = np.maximum(np.frexp(np.maximum(count, 1))[1] - 2, 0).astype(np.uint64)  # frexp: 2**(e - 1) <= count < 2**e
    hashes = np.zeros((n, LEVELS, PARTS), np.uint16)
    least = (np.uint64(1) << base[text]) - np.uint64(1)
    for k, seed in enumerate(SEEDS):
        drawn = mix(prints ^ seed)
        at = np.flatnonzero((drawn & least) == 0)
        for level in range(LEVELS):
            if level:
                at = at[(drawn[at] >> (base[text[at]] + np.uint64(level - 1))) & np.uint64(1) == 0]
            if not len(at):
                break
            first = np.flatnonzero(np.append(True, text[at[1:]] != text[at[:-1]]))
            length = np.diff(np.append(first, len(at)))
            place = np.arange(len(at)) - np.repeat(first, length)
            power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(length.max()) - 1, STEP))), dtype=np.uint64)
            found = mix(np.add.reduceat(mix(prints[at]) * power[place], first)) >> np.uint64(48)
            hashes[text[at[first]], level, k] = np.maximum(found, np.uint64(1))
    out = np.zeros((n, 1 + 2 * LEVELS * PARTS), np.uint8)
    out[:, 0] = base
    out[:, 1:] = hashes.astype(">u2").view(np.uint8).reshape(n, -1)
    for i in np.flatnonzero(count == 0).tolist():
        out[i] = 0
        out[i, :33] = [WHOLE, *hashlib.sha256((texts[i].as_py()).encode()).digest()]
    return out


def likeness(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Of each pair of rows of two tables of fingerprints."""
    a, b = (x[:, 1:].copy().view(">u2").reshape(len(x), LEVELS, PARTS) for x in (one, two))
    low_a, low_b = one[:, 0].astype(np.int64), two[:, 0].astype(np.int64)
    out, open_ = np.zeros(len(one)), np.ones(len(one), bool)
    lowest = np.maximum(low_a, low_b)
    for down in range(LEVELS):
        level = np.minimum(low_a, low_b) + LEVELS - 1 - down
        at = np.flatnonzero(open_ & (level >= lowest))
        x, y = a[at, (level - low_a)[at]], b[at, (level - low_b)[at]]
        met = (x != 0) | (y != 0)
        n = met.sum(1)
        now = (2 * n >= PARTS) | (level == lowest)[at]
        out[at[now]] = ((x == y) & met).sum(1)[now] / np.maximum(n[now], 1)
        open_[at[now]] = False
    whole = (low_a == WHOLE) | (low_b == WHOLE)
    out[whole] = (one[whole] == two[whole]).all(1)
    return out


def edited(text: str, following: str) -> str:
    """The text with the last half of its code points replaced by as many of the following text's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


NAMES = ("id", "part", "place", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "text")
SCHEMA = pa.schema([("id", pa.int64()), ("part", pa.int64()), ("place", pa.string()), ("n_chars", pa.int64()), ("edited", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())])
ROWS_OUT = "id long, part long, place string, n_chars long, edited binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, text string"


def _bytes(rows: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in rows]


def _compared(ids: list, part: int, texts: list[str], following: list[str], one: np.ndarray, two: np.ndarray, terms: np.ndarray) -> pa.RecordBatch:
    new = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    made = fingerprints(pa.array(new, pa.string()), terms)
    digests = [hashlib.sha256(x.encode()).digest() for x in new]
    n = len(ids)
    return pa.record_batch([ids, [part] * n, ["inside"] * n, [len(x) for x in texts], digests, _bytes(one), _bytes(made), likeness(one, made), likeness(one, two), [None] * n], schema=SCHEMA)


def _border(place: str, id_: int | None, part: int, text: str, fingerprint: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([[id_], [part], [place], [len(text)], [None], [fingerprint.tobytes()], [None], [None], [None], [text]], schema=SCHEMA)


def compare(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON, rare: int = RARE) -> DataFrame:
    """``n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every document.

    Null texts are empty. Documents follow each other by id, null last, equal ids in the order of a hash of their texts;
    the first follows the last, a single one itself. A text without terms of the lexicon is like its equals alone. Each
    part of the sorted texts knows its inner neighbours; the texts on the borders of parts are joined afterwards.
    """
    spark = documents.sparkSession
    rows = text_rows(documents, id_col, text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    with arrow_rows(spark, ROWS):
        terms = spark.sparkContext.broadcast(lexicon(rows.select("text"), common, rare))

        def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                texts = strings(batch.column(1))
                found = fingerprints(texts, terms.value)
                ids, values, part = batch.column(0).to_pylist(), texts.to_pylist(), batch.column(2)[0].as_py()
                if held is None:
                    yield _border("first", ids[0], part, values[0], found[0])
                else:
                    ids, values, found = [held[0], *ids], [held[1], *values], np.concatenate((held[2][None], found))
                if len(ids) > 1:
                    yield _compared(ids[:-1], part, values[:-1], values[1:], found[:-1], found[1:], terms.value)
                held = ids[-1], values[-1], found[-1].copy(), part
            if held is not None:
                yield _border("last", held[0], held[3], held[1], held[2])

        order = [F.col("id").asc_nulls_last(), F.xxhash64("text").asc()]
        dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").withColumn("part", F.spark_partition_id().cast("long"))
        done = stash(dealt.mapInArrow(inside, ROWS_OUT), "compared")
    lasts, firsts = (done.filter(F.col("place") == p) for p in ("last", "first"))
    # one number for each part
    parts = Window.orderBy("part")
    follows = firsts.select("part", F.coalesce(F.lead("part").over(parts), F.first("part").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("following"))
    met = lasts.select("id", "part", "text", "fingerprint").join(follows, "part").join(firsts.select(F.col("part").alias("following"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint")), "following").select("id", "part", "text", "next_text", "fingerprint", "next_fingerprint")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(batch.num_rows):  # a border's texts may be long: one pair at a time
                ids, part, text, following, one, two = (c.to_pylist() for c in batch.slice(lo, 1).columns)
                yield _compared(ids, part[0], text, following, *(np.frombuffer(x[0], np.uint8)[None] for x in (one, two)), terms.value)

    whole = done.filter(F.col("place") == "inside").unionByName(met.mapInArrow(across, ROWS_OUT))
    named = lambda c: F.lower(F.hex(c))
    return whole.select(F.col("id").alias(id_col), "n_chars", named("edited").alias("edited_sha256"), named("fingerprint").alias("fingerprint"), named("edited_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next")
