"""How far the sources of a language differ in their terms, and which terms make a source differ from its language.

Terms are counted in numpy: a slab's terms are packed big-endian into one uint64 word (up to 8 bytes) or two (up to 16),
sorted by radix passes of 16 bits behind the documents' order, and counted as runs; longer terms go into buckets of their
own by doubling width and are sorted as bytes. Spark adds the counts of all batches up.

The table of pairs is a product over terms: sources of a language stand in blocks, its kept terms in blocks by hash, and a
task adds up one pair of source blocks over one block of terms. No term's sources are paired in rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.merkle import numbered
from parlance.llm.rows import attached
from parlance.llm.scratch import stash
from parlance.llm.textnum import slabs, strings

#: Documents of a language that must hold a term, terms reported for a group, scale of shares.
LEAST_DOCUMENTS, TOP, SCALE = 10, 10, 1_000_000_000
#: Bytes counted at a time, sources and terms of a block.
SLAB, SOURCES, TERMS = 8 << 20, 256, 512

TERM_BYTE = np.zeros(256, bool)
TERM_BYTE[0x80:] = TERM_BYTE[ord("A") : ord("Z") + 1] = TERM_BYTE[ord("a") : ord("z") + 1] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows by unsigned keys, the first counting most, in passes of 16 bits from the lowest."""
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        for shift in range(0, key.dtype.itemsize * 8, 16):
            digit = (key >> key.dtype.type(shift)).astype(np.uint16)
            if digit.size and (digit != digit[0]).any():  # a digit that all rows share sorts nothing
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def term_places(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text number of every term of a slab."""
    inside = TERM_BYTE[low]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(low))]
    opens[cut] = inside[cut]
    closes[cut - 1] = inside[cut - 1]
    start = np.flatnonzero(opens)
    return start, np.flatnonzero(closes) + 1 - start, np.searchsorted(offsets[1:], start, "right")


def _buckets(padded: np.ndarray, start: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, int, list[np.ndarray] | None, np.ndarray | None]]:
    """(terms of the bucket, bytes a term takes at most, words, byte strings) for lengths to 8, 16 and doubling."""
    least, width = 0, 8
    longest = int(length.max(initial=0))
    while least < longest:
        at = np.flatnonzero((length > least) & (length <= width))
        least, now, width = width, width, width * 2
        if not len(at):
            continue
        if now <= 16:
            first = np.lib.stride_tricks.sliding_window_view(padded, now)[start[at]]
            words = [np.ascontiguousarray(first[:, k : k + 8]).view(">u8").ravel().astype(np.uint64) for k in range(0, now, 8)]
            past = (np.uint64(now) - length[at].astype(np.uint64)) * np.uint64(8)  # bits behind the term in its last word
            words[-1] = words[-1] >> past << past
            yield at, now, words, None
        else:
            yield at, now, None, np.array([padded[s : s + n].tobytes() for s, n in zip(start[at].tolist(), length[at].tolist(), strict=True)], f"S{now}")


def _texts(width: int, words: list[np.ndarray] | None, strings_: np.ndarray | None) -> pa.Array:
    """Packed terms as strings; no term has a zero byte, so what follows it is padding."""
    if words is not None:
        flat = np.stack(words, 1).astype(">u8").view(np.uint8).reshape(-1, width)
        real = flat != 0
        ends = np.concatenate(([0], np.cumsum(real.sum(1)))).astype(np.int32)
        return pa.StringArray.from_buffers(len(flat), pa.py_buffer(ends), pa.py_buffer(flat[real]))
    return pa.array([x.decode("utf-8", "replace") for x in strings_.tolist()], pa.string())


COUNTS = pa.schema([("g", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def counted(data: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> pa.Table:
    """``g, term, n, docs``: occurrences and documents of each term in each group of a slab's texts."""
    padded = np.concatenate((LOWER[data], np.zeros(16, np.uint8)))
    start, length, text = term_places(padded[: len(data)], offsets)
    # texts in the order of their groups, so that a term's runs of documents make up runs of groups
    by_group = np.argsort(groups, kind="stable")
    rank = np.empty(len(groups), np.uint32)
    rank[by_group] = np.arange(len(groups), dtype=np.uint32)
    parts = []
    for at, width, words, long in _buckets(padded, start, length):
        place = rank[text[at]]
        if words is not None:
            order = radix_order([*words, place])
            keys = [w[order] for w in words]
        else:
            order = radix_order([place])
            order = order[np.argsort(long[order], kind="stable")]
            keys = [long[order]]
        place = place[order]
        group = groups[by_group[place]]
        new_term = np.ones(len(at), bool)
        new_term[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        new_doc, new_group = new_term.copy(), new_term.copy()
        new_doc[1:] |= place[1:] != place[:-1]
        new_group[1:] |= group[1:] != group[:-1]
        first = np.flatnonzero(new_group)
        texts = _texts(width, [k[first] for k in keys] if words is not None else None, keys[0][first] if words is None else None)
        parts.append(pa.table([pa.array(group[first]), texts, pa.array(np.diff(np.append(first, len(at)))), pa.array(np.add.reduceat(new_doc.astype(np.int64), first))], schema=COUNTS))
    return pa.concat_tables(parts) if parts else COUNTS.empty_table()


def _added(tables: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(tables).group_by(["g", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return whole.rename_columns(COUNTS.names) if whole.column_names[0] == "g" else whole.select(["g", "term", "n_sum", "docs_sum"]).rename_columns(COUNTS.names)


def long_text(data: np.ndarray, group: int, size: int = SLAB) -> pa.Table:
    """The counts of one text, cut between terms into pieces of about ``size`` bytes."""
    found, lo, groups = COUNTS.empty_table(), 0, np.array([group])
    while lo < len(data):
        hi = min(len(data), lo + size)
        while hi < len(data) and TERM_BYTE[data[hi]]:  # a term isn't cut
            step = np.flatnonzero(~TERM_BYTE[data[hi : hi + size]])
            hi = min(len(data), hi + (int(step[0]) if len(step) else size))
        found = _added([found, counted(data[lo:hi], np.array([0, hi - lo]), groups)])
        lo = hi
    return found.set_column(3, "docs", pa.array(np.ones(len(found), np.int64)))


def _of_batch(batch: pa.RecordBatch, size: int) -> pa.Table:
    lang, source = (batch.column(k).dictionary_encode() for k in (0, 1))
    wide = max(1, len(source.dictionary))
    code = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * wide + source.indices.to_numpy(zero_copy_only=False)
    parts = [COUNTS.empty_table()]
    for lo, hi, data, offsets in slabs(strings(batch.column(2)), size):
        parts.append(long_text(data, int(code[lo]), size) if len(data) > size else counted(data, offsets, code[lo:hi]))
    out = _added(parts)
    g = out["g"].to_numpy()
    return pa.table({"lang": lang.dictionary.take(pa.array(g // wide)), "source": source.dictionary.take(pa.array(g % wide)), "term": out["term"], "n": out["n"], "docs": out["docs"]})


def term_counts(texts: DataFrame, size: int = SLAB) -> DataFrame:
    """``lang, source, term, n, docs`` of ``texts`` (lang, source, text; no nulls)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _of_batch(batch, size).to_batches()

    found = texts.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column | str, of: str, kept: str) -> Column:
    """``1 + floor(SCALE * (n + 2) / (of + 2 * kept))`` in whole numbers."""
    n = F.col(n) if isinstance(n, str) else n
    top = F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    return F.call_function("div", top, (F.col(of) + 2 * F.col(kept)).cast("decimal(20,0)")) + 1


def apart(p: str, q: str) -> Column:
    """``floor((p - q)**2 / (p + q))``; shares are below 2**30, so squares fit."""
    return F.call_function("div", (F.col(p) - F.col(q)) * (F.col(p) - F.col(q)), F.col(p) + F.col(q))


def _summed(group: pa.Table, sources: int) -> pa.Table:
    """One pair of source blocks over one block of terms: ``i, j`` (i < j) and the sum of their terms' values."""
    index, p, held = (group[c].fill_null(0).to_numpy() for c in ("i", "p", "absent"))
    base = group["term"].is_null().to_numpy(zero_copy_only=False)
    names, row = np.unique(index[base], return_inverse=True)
    own = group.filter(pa.array(~base))
    term = own["term"].combine_chunks().dictionary_encode() if len(own) else None
    terms = len(term.dictionary) if len(own) else 0
    shares = np.zeros((len(names), terms), np.int64)
    if terms:
        shares[row] = p[base][:, None]
        shares[np.searchsorted(names, index[~base]), term.indices.to_numpy(zero_copy_only=False)] = p[~base]
    bi, bj = group["bi"][0].as_py(), group["bj"][0].as_py()
    absent = int(held[base].max(initial=0)) - terms  # the block's terms that none of these sources has
    alone = np.zeros(len(names), np.int64)
    alone[row] = p[base]
    left = np.flatnonzero(names // sources == bi)
    right = np.flatnonzero(names // sources == bj)
    out_i, out_j, out_v = [], [], []
    for a in left:
        others = right[names[right] > names[a]] if bi == bj else right
        if not len(others):
            continue
        d = shares[others] - shares[a]
        d *= d
        d //= np.maximum(shares[others] + shares[a], 1)
        out_i.append(np.full(len(others), names[a]))
        out_j.append(names[others])
        rest = alone[others] - alone[a]
        out_v.append(d.sum(1) + absent * (rest * rest // np.maximum(alone[others] + alone[a], 1)))
    whole = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_i, out_j, out_v)]
    return pa.table({"lang": pa.array([group["lang"][0].as_py()] * len(whole[0]), pa.string()), "i": whole[0], "j": whole[1], "v": whole[2]})


def pair_part(groups: DataFrame, hits: DataFrame, kept: DataFrame, sources: int = SOURCES, terms: int = TERMS) -> DataFrame:
    """``lang, source, item, value`` of each ordered pair of a language's sources.

    ``groups`` (lang, source, i, size, kept, p0) has the place of each source in its language, ``hits`` (lang, source, term, i, p) the
    shares of the terms that occur, ``kept`` (lang, term, kept) all of them; ``p0`` is the share of those that don't.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("kept") / terms)).cast("int")
    block = F.floor(F.col("i") / sources)
    last = F.floor((F.col("sources") - 1) / sources)
    of = F.pmod(F.xxhash64("term"), blocks).cast("int").alias("tb")
    held = kept.groupBy("lang", of).agg(F.count("*").alias("absent"))
    base = groups.select("lang", "i", "sources", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("tb")).join(held, ["lang", "tb"], "left").fillna(0, ["absent"])
    own = hits.select("lang", "i", "sources", "term", "p", of, F.lit(None).cast("long").alias("absent"))
    both = base.unionByName(own).withColumn("b", block).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    dealt = both.select("lang", "i", "term", "p", "tb", "absent", F.least("b", "other").alias("bi"), F.greatest("b", "other").alias("bj"))
    sums = dealt.groupBy("lang", "bi", "bj", "tb").applyInArrow(lambda g: _summed(g, sources), "lang string, i long, j long, v long").groupBy("lang", "i", "j").agg(F.sum("v").alias("value"))
    ways = sums.select("lang", "value", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("w")).select("lang", "value", "w.i", "w.j")
    named = groups.select("lang", "i", "source")
    return ways.join(named, ["lang", "i"]).join(named.select("lang", F.col("i").alias("j"), F.col("source").alias("item")), ["lang", "j"]).select("lang", "source", "item", "value")


def audit(documents: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST_DOCUMENTS, top: int = TOP, size: int = SLAB, block: tuple[int, int] = (SOURCES, TERMS)) -> DataFrame:
    """``lang, source, part, item, value, rank``: the pairs of each language's sources and the leading terms of each source.

    Null languages, sources and texts are empty ones. A group without terms has its pairs all the same; a language of one
    source has none, one without kept terms has pairs of value 0. Each repeated row counts. Other columns are ignored.
    """
    texts = documents.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang_col), ("source", source_col), ("text", text_col))])
    counts = stash(term_counts(texts, size), "term-counts")
    kept = stash(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("whole")).filter(F.col("docs") >= least).drop("docs"), "kept-terms")
    found = stash(counts.drop("docs").join(kept, ["lang", "term"]), "found-terms")
    langs = stash(kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("whole").alias("lang_size")), "langs")
    sizes = found.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    names = numbered(texts.select(F.col("lang").alias("tree"), "source").distinct(), ["source"]).select(F.col("tree").alias("lang"), "source", F.col("index").alias("i"), F.col("n").alias("sources"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    groups = names.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", "i", "sources", none("size"), none("kept"), none("lang_size"))
    groups = stash(groups.withColumn("p0", F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), "size", "kept"))), "groups")
    hits = stash(attached(found, groups, ["lang", "source"]).withColumn("p", share("n", "size", "kept")).withColumn("q", share("whole", "lang_size", "kept")), "hits")
    terms = hits.filter("p > q").select("lang", "source", F.col("term").alias("item"), apart("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    leading = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    pairs = pair_part(groups, hits, attached(kept, langs.select("lang", "kept"), ["lang"]), *block).withColumn("rank", F.row_number().over(order))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(leading.withColumn("part", F.lit("term")).select(*columns))
