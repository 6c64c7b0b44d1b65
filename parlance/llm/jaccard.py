"""N-gram Jaccard join by a blocked product of the document by n-gram incidence.

The columns of the incidence matrix (word n-grams) are ordered from rare to frequent by a counting sketch of fixed
size that is filled from all documents. The first block of columns of a row is its rarest quarter: two rows of Jaccard
similarity 0.75 or more have a column of that block in common. Multiplying the block by its transpose gives each pair's
overlap in the block; with the most that the other columns can add, a bound that follows from the two sizes alone,
it tells which pairs can still reach the overlap that their sizes ask for. Only for these are the other columns
multiplied.

Large groups never become all their pairs: in each column the first row of a class of sizes is multiplied with the
others, links found that way are joined into components, and the full product of the block is then formed only
between rows of different components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.rows import attached, bitmap, components, in_bitmap, keyed
from parlance.llm.scratch import discard, stash
from parlance.llm.textnum import U64, mix, slabs, strings, word_prints, words

N, PERCENT = 5, 75
#: Counters of the sketch of n-gram frequencies.
SKETCH = 1 << 19
SKETCH_BLOCKS = 16
#: Rows of a column up to which its pairs are formed directly; rows that the most frequent column has in a block beyond.
FEW, BLOCK_ROWS = 512, 256
#: Entries of a block's product that wait before they are added up.
PENDING = 1 << 20


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of the distinct word n-grams of a slab, sorted by both; fewer words than n are one n-gram."""
    upper = (data >= 65) & (data <= 90)
    data = data + (upper * np.uint8(32)).astype(np.uint8)
    start, end, doc = words(data, offsets)
    prints = word_prints(data, start, end)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    owner, keys = [], []
    if len(prints) >= n:
        h = prints[: len(prints) - n + 1]
        for k in range(1, n):
            h = mix(h) + prints[k : len(prints) - n + 1 + k]
        whole = doc[: len(h)] == doc[n - 1 :]
        owner.append(doc[: len(h)][whole])
        keys.append(mix(h)[whole])
    for short in range(1, n):
        at = np.flatnonzero(count == short)
        if len(at):
            h = prints[first[at]]
            for k in range(1, short):
                h = mix(h) + prints[first[at] + k]
            owner.append(at)
            keys.append(mix(mix(h) + U64(short)))
    if not owner:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    owner, keys = np.concatenate(owner), np.concatenate(keys)
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return owner[fresh], keys[fresh]


def _bucket(keys: np.ndarray) -> np.ndarray:
    return (keys >> U64(64 - int(math.log2(SKETCH)))).astype(np.int64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def describe(docs: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """``key, size, s1, s2`` of every row (a print of its set), and the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, np.int64)
        names = ["key", "size", "s1", "s2", "block", "counts"]
        for batch in batches:
            sizes, one, two = [], [], []
            for lo, hi, data, offsets in slabs(strings(batch.column("text"))):
                owner, keys = shingles(data, offsets, n)
                sketch += np.bincount(_bucket(keys), minlength=SKETCH)
                size = np.bincount(owner, minlength=hi - lo)
                edge = np.concatenate(([0], np.cumsum(size)))
                sums = [np.concatenate((np.zeros(1, U64), np.cumsum(mix(keys + c), dtype=U64))) for c in (U64(11), U64(0x5851F42D4C957F2D))]
                sizes.append(size)
                one.append(sums[0][edge[1:]] - sums[0][edge[:-1]])
                two.append(sums[1][edge[1:]] - sums[1][edge[:-1]])
            if sizes:
                k = batch.num_rows
                yield pa.record_batch([batch.column("key"), pa.array(np.concatenate(sizes)), _signed(np.concatenate(one)), _signed(np.concatenate(two)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        if sketch.any():
            parts = [p.astype(np.int32).tobytes() for p in np.split(sketch, SKETCH_BLOCKS)]
            nothing = pa.nulls(SKETCH_BLOCKS, pa.int64())
            yield pa.record_batch([nothing, nothing, nothing, nothing, pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array(parts, pa.binary())], names=names)

    both = stash(docs.select("key", "text").mapInArrow(run, "key long, size long, s1 long, s2 long, block int, counts binary"), "sets")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[block] = total.get(block, 0) + np.frombuffer(counts, np.int32).astype(np.int64)
        if total:
            yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([np.minimum(v, 2**31 - 1).astype(np.int32).tobytes() for v in total.values()], pa.binary())], names=["block", "counts"])

    summed = both.filter("block is not null").select("block", "counts").repartition(SKETCH_BLOCKS, "block").mapInArrow(add, "block int, counts binary")
    sketch = np.zeros(SKETCH, np.int32)
    width = SKETCH // SKETCH_BLOCKS
    for r in summed.collect():  # SKETCH counters, whatever the input
        sketch[r["block"] * width : (r["block"] + 1) * width] = np.frombuffer(bytes(r["counts"]), np.int32)
    return both.filter("block is null").select("key", "size", "s1", "s2"), sketch


def prefix_size(size: np.ndarray, percent: int) -> np.ndarray:
    return size - (size * percent + 99) // 100 + 1


def prefixes(docs: DataFrame, sketch: np.ndarray, n: int, percent: int) -> DataFrame:
    """``g, key, v``: the first block of columns of every row; of equal sets of a batch only the first row.

    ``v`` packs the class of sizes (12 bits), the size (26) and the place of the column in the row (26).
    """
    sent = docs.sparkSession.sparkContext.broadcast(sketch)
    ratio = math.log(100 / percent) if percent < 100 else 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        for batch in batches:
            key = batch.column("key").to_numpy()
            for lo, hi, data, offsets in slabs(strings(batch.column("text"))):
                owner, keys = shingles(data, offsets, n)
                size = np.bincount(owner, minlength=hi - lo)
                edge = np.concatenate(([0], np.cumsum(size)))
                sums = np.concatenate((np.zeros(1, U64), np.cumsum(mix(keys), dtype=U64)))
                _, first = np.unique(np.stack([(sums[edge[1:]] - sums[edge[:-1]]), size.astype(U64)]), axis=1, return_index=True)
                fresh = np.zeros(hi - lo, bool)
                fresh[first] = True
                kept = fresh[owner]
                owner, keys = owner[kept], keys[kept]
                if not len(owner):
                    continue
                order = np.lexsort((keys, counts[_bucket(keys)], owner))
                owner, keys = owner[order], keys[order]
                size = np.where(fresh, size, 0)
                edge = np.concatenate(([0], np.cumsum(size)))[:-1]
                place = np.arange(len(owner)) - edge[owner]
                kept = place < prefix_size(size, percent)[owner]
                owner, keys, place = owner[kept], keys[kept], place[kept]
                group = np.floor(np.log(size[owner]) / ratio).astype(np.int64)
                yield pa.record_batch([_signed(keys), pa.array(key[lo + owner]), pa.array((group << 52) | (size[owner].astype(np.int64) << 26) | place)], names=["g", "key", "v"])

    return docs.select("key", "text").mapInArrow(run, "g long, key long, v long")


def shared(postings: DataFrame) -> DataFrame:
    """Postings of columns that two or more rows have, each with the first row of its class of sizes in that column.

    One pass over rows sorted by column, class and key; what it remembers between batches is one row.
    """
    ordered = postings.repartition("g").sortWithinPartitions("g", F.shiftright("v", 52), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: tuple[np.ndarray, ...] | None = None  # the last row, not yet given out: g, key, v, hub, whether g came before
        for batch in batches:
            g, key, v = (batch.column(i).to_numpy() for i in range(3))
            if not len(g):
                continue
            hub, seen = np.full(len(g), -1, np.int64), np.zeros(len(g), bool)
            if carry is not None:
                g, key, v, hub, seen = (np.concatenate((c, x)) for c, x in zip(carry, (g, key, v, hub, seen), strict=True))
            same = g[1:] == g[:-1]
            seen[1:] |= same
            start = np.ones(len(g), bool)
            start[1:] = ~(same & ((v[1:] >> 52) == (v[:-1] >> 52)))
            at = np.maximum.accumulate(np.where(start, np.arange(len(g)), 0))
            lead = np.where(start, key, 0)
            if carry is not None:
                lead[0] = hub[0]
            hub = lead[at]
            both = seen.copy()
            both[:-1] |= same
            carry = tuple(x[-1:].copy() for x in (g, key, v, hub, seen))
            out = np.flatnonzero(both[:-1])
            if len(out):
                yield pa.record_batch([pa.array(g[out]), pa.array(key[out]), pa.array(v[out]), pa.array(hub[out])], names=["g", "key", "v", "hub"])
        if carry is not None and carry[4][0]:
            yield pa.record_batch([pa.array(x) for x in carry[:4]], names=["g", "key", "v", "hub"])

    return ordered.mapInArrow(run, "g long, key long, v long, hub long")


def verified(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose sets reach the similarity; the product of the whole two rows."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    count = need.count()
    if not count:
        return pairs
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(need, count))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(sent.value, batch.column("key").to_numpy())))
            if not batch.num_rows:
                continue
            rows = []
            for lo, hi, data, offsets in slabs(strings(batch.column("text"))):
                owner, keys = shingles(data, offsets, n)
                edge = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=hi - lo))))
                rows += [keys[edge[i] : edge[i + 1]].tobytes() for i in range(hi - lo)]
            yield pa.record_batch([batch.column("key"), pa.array(rows, pa.binary())], names=["key", "set"])

    rows = docs.select("key", "text").mapInArrow(sets, "key long, set binary")
    left = rows.select(F.col("key").alias("a"), F.col("set").alias("set_a"))
    right = rows.select(F.col("key").alias("b"), F.col("set").alias("set_b"))
    # rows of the matrix meet by pair; a row that is asked for by many pairs is dealt out over salts
    many = pairs.groupBy("a").agg((F.floor(F.count("*") / 500) + 1).cast("int").alias("salts"))
    left = left.join(many, "a").select("a", "set_a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    asked = pairs.join(many, "a").withColumn("salt", F.pmod(F.col("b"), F.col("salts")).cast("int")).select("a", "b", "salt")
    met = asked.join(right, "b").join(left, ["a", "salt"]).select("a", "b", "set_a", "set_b")

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                overlap = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * overlap >= percent * (len(both) - overlap))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.mapInArrow(product, "a long, b long")


def _size(v: str) -> str:
    return f"(shiftright({v}, 26) & 67108863)"


def _rest(n: str, percent: int) -> str:
    """Columns after the first block."""
    return f"(({n} * {percent} + 99) div 100 - 1)"


def _wanted(n: str, m: str, percent: int) -> str:
    """Overlap that two sizes ask for."""
    return f"((({n} + {m}) * {percent} + {99 + percent}) div {100 + percent})"


def stars(postings: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes: rows with the first row of a column, where they meet in a quarter or more of the columns that equal sizes ask for.

    Pairs that are left out here meet again in ``open_pairs`` unless other links join them.
    """
    met = postings.filter("key <> hub").groupBy("key", "hub").agg(F.count("*").alias("n"), F.max(F.expr(_size("v"))).alias("size"))
    met = met.filter(F.expr(f"4 * n >= {_wanted('size', 'size', percent)} - {_rest('size', percent)}")).select("key", "hub")
    named = met.join(members.withColumnRenamed("rep", "x"), "key").join(members.select(F.col("key").alias("hub"), F.col("rep").alias("y")), "hub")
    return named.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def open_pairs(postings: DataFrame, members: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of different components whose overlap in the first block can still grow to what their sizes ask for.

    Columns with few rows give their pairs directly; those with many are multiplied by blocks of rows, whose overlaps add
    up in one place before any pair is given out. Each part drops a pair that could not reach its bound even if the
    other part had all the columns that both rows have there.
    """
    posted = members.join(postings.select("key").distinct(), "key", "left_semi")  # of equal sets few have postings
    classes = posted.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.col("rep").alias("a"), F.coalesce("component", "rep").alias("c"))
    placed = postings.select("g", "key", F.expr(_size("v")).alias("n")).join(classes, "key").select("g", "a", "c", "n")
    column = Window.partitionBy("g")
    mixed = placed.repartition("g").withColumn("low", F.min("c").over(column)).withColumn("high", F.max("c").over(column)).withColumn("rows", F.count("*").over(column)).filter("low < high")
    mixed = stash(mixed.groupBy("g", "a", "c", "n").agg((F.max("rows") > FEW).alias("many")), "mixed")
    info = mixed.groupBy("a").agg(F.count_if("many").alias("in_many"), F.count_if(~F.col("many")).alias("in_few"))
    rows = stash(mixed.join(info, "a"), "open")
    # columns with few rows
    few = rows.filter("not many").drop("many")
    x, y = few.toDF("a", "g", "c_a", "n_a", "many_a", "few_a"), few.toDF("b", "g", "c_b", "n_b", "many_b", "few_b")
    fits = f"a < b and c_a <> c_b and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    bound = f"greatest({_rest('n_a', percent)}, {_rest('n_b', percent)})"
    light = x.join(y, "g").filter(F.expr(fits)).groupBy("a", "b").agg(F.count("*").alias("overlap"), *[F.max(c).alias(c) for c in ("n_a", "n_b", "many_a", "many_b")])
    light = light.filter(F.expr(f"overlap + least(many_a, many_b) + {bound} >= {_wanted('n_a', 'n_b', percent)}")).select("a", "b", "overlap", "n_a", "n_b")
    # columns with many rows
    heavy = rows.filter("many")
    most = heavy.groupBy("g").count().agg(F.max("count")).first()[0] or 0
    blocks = max(8, -(-most // BLOCK_ROWS))
    entry = F.struct("a", "c", F.col("n").cast("long").alias("n"), "in_few")
    lists = heavy.withColumn("block", F.pmod(F.xxhash64("a"), F.lit(blocks)).cast("int")).repartition("g").groupBy("g", "block").agg(F.collect_list(entry).alias("rows"))
    one, two = lists.toDF("g", "i", "rows_i"), lists.toDF("g", "j", "rows_j")
    met = one.join(two, "g").filter("i <= j").select("i", "j", "rows_i", "rows_j").repartition("i", "j").sortWithinPartitions("i", "j")

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, info = None, [], []  # place of the block, (a, b, overlap) so far, what is known of the rows

        def added() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            low, high, overlap = (np.concatenate([p[k] for p in parts]) for k in range(3))
            rows = np.unique(np.concatenate((low, high)))
            code, where = np.unique(np.searchsorted(rows, low) * len(rows) + np.searchsorted(rows, high), return_inverse=True)
            return rows[code // max(len(rows), 1)], rows[code % max(len(rows), 1)], np.bincount(where, overlap, len(code)).astype(np.int64)

        def done() -> pa.RecordBatch:
            low, high, overlap = added()
            known = np.concatenate(info)
            known = known[np.unique(known[:, 0], return_index=True)[1]]
            a, b = known[np.searchsorted(known[:, 0], low)], known[np.searchsorted(known[:, 0], high)]
            rest = np.maximum(a[:, 2] * percent + 99, b[:, 2] * percent + 99) // 100 - 1
            wanted = ((a[:, 2] + b[:, 2]) * percent + 99 + percent) // (100 + percent)
            keep = (overlap + np.minimum(a[:, 3], b[:, 3]) + rest >= wanted) & (100 * np.minimum(a[:, 2], b[:, 2]) >= percent * np.maximum(a[:, 2], b[:, 2]))
            a, b, overlap = a[keep], b[keep], overlap[keep]
            return pa.record_batch([pa.array(a[:, 0]), pa.array(b[:, 0]), pa.array(overlap), pa.array(a[:, 2]), pa.array(b[:, 2])], names=["a", "b", "overlap", "n_a", "n_b"])

        def matrix(lists: pa.Array) -> np.ndarray:
            values = lists.flatten()
            return np.stack([values.field(k).to_numpy() for k in ("a", "c", "n", "in_few")], 1)

        for batch in batches:
            for r in range(batch.num_rows):
                place = (batch.column("i")[r].as_py(), batch.column("j")[r].as_py())
                if place != at and parts:
                    yield done()
                    parts, info = [], []
                at = place
                u, v = matrix(batch.column("rows_i").slice(r, 1)), matrix(batch.column("rows_j").slice(r, 1))
                k, m = (u[:, None, 1] != v[None, :, 1]).nonzero()
                low, high = np.minimum(u[k, 0], v[m, 0]), np.maximum(u[k, 0], v[m, 0])
                if place[0] == place[1]:  # a block with itself has every pair twice
                    once = u[k, 0] < v[m, 0]
                    low, high = low[once], high[once]
                parts.append((low, high, np.ones(len(low), np.int64)))
                info += [u, v]
                if sum(len(p[0]) for p in parts) > PENDING:
                    parts, info = [added()], [np.unique(np.concatenate(info), axis=0)]
        if parts:
            yield done()

    heavy_pairs = met.mapInArrow(product, "a long, b long, overlap long, n_a long, n_b long")
    both = light.select(*[F.col(c).cast("long").alias(c) for c in ("a", "b", "overlap", "n_a", "n_b")]).union(heavy_pairs).groupBy("a", "b").agg(F.sum("overlap").alias("overlap"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
    return both.filter(F.expr(f"overlap + {bound} >= {_wanted('n_a', 'n_b', percent)}")).select("a", "b")


def join(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """``n_shingles`` and ``component_id`` of every row.

    Null texts and texts without words have an empty set and link with nothing: such a row is its own component.
    Repeated rows link with each other (unless empty). A component is named by its smallest id; a null id names one
    only if there is no other. ``row_key`` tells repeated ids apart.
    """
    docs, own = keyed(documents, id_col, text_col)
    ids = docs.select("key", "id")
    sets, sketch = describe(docs, n)
    reps = stash(sets.filter("size > 0").groupBy("s1", "s2", "size").agg(F.min("key").alias("rep")), "reps")
    members = stash(attached(sets.filter("size > 0"), reps, ["s1", "s2", "size"]).select("key", "rep"), "members")
    postings = stash(shared(prefixes(docs, sketch, n, percent)), "shared")
    met = stash(stars(postings, members, percent), "stars")
    links = stash(verified(docs, met, n, percent), "links")
    first = components(links)
    pairs = stash(open_pairs(postings, members, first, percent), "pairs")
    discard(postings)
    more = stash(verified(docs, pairs, n, percent), "links")
    discard(met)
    discard(pairs)
    found = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)) if more.limit(1).count() else first
    # keys follow the order of the ids, so a component's least key is that of its least id
    named = attached(members, stash(found.withColumnRenamed("node", "rep"), "components"), ["rep"], "left").select("key", F.coalesce("component", "rep").alias("component"))
    placed = ids.join(sets.select("key", "size"), "key").join(named, "key", "left").withColumn("component", F.coalesce("component", "key"))
    if own:
        placed = placed.withColumn("component_id", F.col("component"))
    else:
        placed = attached(stash(placed, "placed"), ids.select(F.col("key").alias("component"), F.col("id").alias("component_id")), ["component"])
    return placed.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id", F.col("key").alias("row_key"))


def deduplicated(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """``documents`` with one row of each component, that of the smallest id; rows with an empty set all stay.

    Where ids repeat or are null, rows are numbered by id and text first, so that one row stays even of repeated ones.
    """
    ids = documents.select(F.col(f"`{id_col}`").alias("id"))
    if not ids.groupBy("id").count().filter("count > 1 or id is null").limit(1).count():
        kept = join(documents, id_col, text_col, n, percent).filter(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("__kept"))
        return documents.join(kept, F.col(f"`{id_col}`") == F.col("__kept"), "left_semi")
    order = [F.col(f"`{id_col}`").asc_nulls_last(), F.col(f"`{text_col}`")]
    numbered = stash(documents.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id()), "numbered")
    kept = join(numbered, "__row", text_col, n, percent).filter("__row = component_id").select(F.col("__row").alias("__kept"))
    return numbered.join(kept, F.col("__row") == F.col("__kept"), "left_semi").drop("__row")
