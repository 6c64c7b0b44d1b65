"""Quality rules: hashed n-gram logistic regression beside fixed base rules.

Words, pairs of neighbouring words and character trigrams are hashed into a fixed number of weights; a document's
features are the relative frequencies of its words and pairs and of its trigrams. The weights are trained on labelled rows (at most
``max_rows`` of them with ``max_bytes`` of text, documented bounds) in four fifths of which the regression is fitted and in one fifth
of which Platt's method turns its margins into probabilities. Every document is then scored in Arrow
batches against one fixed probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.scratch import stash, text_rows
from parlance.llm.textnum import BYTES, U64, char_offsets, code_points, mix, slabs, strings, word_prints, words

#: Most labelled rows that the classifier is fitted on (chosen by hash of the id, so evenly).
MAX_ROWS = 4000
#: Most bytes of text among them; rows beyond, in the same order, are left out.
MAX_BYTES = 128 << 20
#: Documents below this calibrated probability of good quality are rejected.
KEEP_AT = 0.5
#: Hashed weights: the first half for words and pairs of words, the second for character trigrams.
WEIGHTS = 1 << 18
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

BASE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Marks the keys that occur twice or more."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    if len(keys) > 1:
        equal = keys[order[1:]] == keys[order[:-1]]
        same[order[1:]] |= equal
        same[order[:-1]] |= equal
    return same


def base_counts(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, prints: np.ndarray) -> list[np.ndarray]:
    """The five base counts of each text of a slab."""
    n = len(offsets) - 1
    total = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start] += 1
    np.subtract.at(inside, end, 1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    chars = total(inside & ((data & 0xC0) != 0x80))
    symbols = total(SYMBOL[data])
    n_words = np.bincount(doc, minlength=n)
    # lines: cut at \n and between texts
    cuts = np.unique(np.concatenate((np.flatnonzero(data == 10) + 1, offsets[:-1])))
    cuts = cuts[cuts < len(data)] if len(data) else cuts[:0]
    ends = np.append(cuts[1:], len(data))
    line_doc = np.searchsorted(offsets[1:], cuts, "right")
    stop = ends - ((ends > cuts) & (data[np.maximum(ends, 1) - 1] == 10) if len(data) else 0)
    counted = np.searchsorted(start, ends) > np.searchsorted(start, cuts)
    cuts, stop, line_doc = cuts[counted], stop[counted], line_doc[counted]
    line = mix(BYTES.spans(BYTES.prefix(data), cuts, stop) + (stop - cuts).astype(U64)) + mix(line_doc.astype(U64) + U64(1))
    _, first = np.unique(line, return_index=True)
    dup_lines = np.bincount(line_doc, minlength=n) - np.bincount(line_doc[first], minlength=n)
    # words in a window of three that is found twice or more in the text
    covered = np.zeros(len(prints), bool)
    if len(prints) > 2:
        whole = doc[2:] == doc[:-2]
        key = mix(mix(prints[:-2] + U64(1)) + prints[1:-1]) * U64(0x9E3779B97F4A7C15) + prints[2:]
        key = mix(key) + mix(doc[:-2].astype(U64) + U64(7))
        at = np.flatnonzero(whole)
        at = at[_repeated(key[at])]
        for k in range(3):
            covered[at + k] = True
    return [n_words, chars, symbols, dup_lines, np.bincount(doc[covered], minlength=n)]


def features(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number and weight number of each word and pair of words, then of each character trigram inside a text."""
    half = U64(WEIGHTS // 2 - 1)
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    both = mix(mix(prints[pair]) + prints[pair + 1])
    doc, prints = np.concatenate((doc, doc[pair])), np.concatenate((prints, both))
    points = code_points(data).astype(np.uint32)
    at = char_offsets(data, offsets)
    if len(points) < 3:
        empty = np.zeros(0, np.int64)
        return doc, (prints & half).astype(np.int64), empty, empty
    gram = points[:-2] * np.uint32(0x9E3779B1) + points[1:-1] * np.uint32(0x85EBCA77) + points[2:] * np.uint32(0xC2B2AE3D)
    gram ^= gram >> np.uint32(15)
    gram *= np.uint32(0x2C1B3C6D)
    gram ^= gram >> np.uint32(13)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = np.flatnonzero(owner[:-2] == owner[2:])
    return doc, (prints & half).astype(np.int64), owner[inside], (gram[inside] & np.uint32(half)).astype(np.int64) + WEIGHTS // 2


def margins(weights: np.ndarray, n: int, parts: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Mean weight of the words and pairs plus mean weight of the trigrams."""
    out = np.zeros(n)
    for owner, at in ((parts[0], parts[1]), (parts[2], parts[3])):
        count = np.bincount(owner, minlength=n)
        out += np.bincount(owner, weights=weights[at], minlength=n) / np.maximum(count, 1)
    return out


def _logistic(owner: np.ndarray, at: np.ndarray, value: np.ndarray, y: np.ndarray, steps: int = 150, rate: float = 2.0, decay: float = 1e-6) -> tuple[np.ndarray, float]:
    """Full-batch logistic regression with balanced classes, by Adam."""
    n, used = len(y), np.flatnonzero(np.bincount(at, minlength=WEIGHTS))
    place = np.zeros(WEIGHTS, np.int32)
    place[used] = np.arange(len(used))
    at = place[at]
    w, b = np.zeros(len(used)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for t in range(1, steps + 1):
        z = np.clip(np.bincount(owner, weights=w[at] * value, minlength=n) + b, -30, 30)
        g = (1 / (1 + np.exp(-z)) - y) * share
        gw = np.bincount(at, weights=g[owner] * value, minlength=len(used)) + decay * w
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw, 0.9 * mb + 0.1 * g.sum(), 0.99 * vb + 0.01 * g.sum() ** 2
        fix, fix2 = 1 - 0.9**t, 1 - 0.99**t
        w -= rate * (m / fix) / (np.sqrt(v / fix2) + 1e-9)
        b -= 0.1 * (mb / fix) / (np.sqrt(vb / fix2) + 1e-9)
    out = np.zeros(WEIGHTS)
    out[used] = w
    return out, b


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over the margins, by Newton steps with Platt's smoothed targets."""
    good, bad = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    spread = max(float(np.std(z)), 1e-9)
    x = np.stack([z / spread, np.ones_like(z)], 1)
    a = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        a = a - np.linalg.solve(hess, x.T @ (p - t) + 1e-3 * a)
    return float(a[0] / spread), float(a[1])


def fit_rows(texts: pa.Array, y: np.ndarray) -> np.ndarray | None:
    """Weights with the slope, shift and intercept appended; None where a class is missing. Rows 0, 5, 10, ... calibrate."""
    owner, at, value, first = [], [], [], 0
    for lo, hi, data, offsets in slabs(texts):
        start, end, doc = words(data, offsets)
        parts = features(data, offsets, doc, word_prints(data, start, end))
        for o, a in ((parts[0], parts[1]), (parts[2], parts[3])):
            key, count = np.unique(o * WEIGHTS + a, return_counts=True)
            o2 = key // WEIGHTS
            owner.append((o2 + lo).astype(np.int32))
            at.append((key % WEIGHTS).astype(np.int32))
            value.append(count / np.maximum(np.bincount(o, minlength=hi - lo), 1)[o2])
    if not owner:
        return None
    owner, at, value = np.concatenate(owner), np.concatenate(at), np.concatenate(value)
    held = np.arange(len(y)) % 5 == 0
    if min(((y == c) & h).sum() for c in (0, 1) for h in (held, ~held)) == 0:
        held = np.zeros(len(y), bool)
    if min((y == c).sum() for c in (0, 1)) == 0:
        return None
    number = (np.cumsum(~held) - 1).astype(np.int32)
    fitted = ~held[owner]
    w, b = _logistic(number[owner[fitted]], at[fitted], value[fitted], y[~held])
    z = np.bincount(owner, weights=w[at] * value, minlength=len(y)) + b
    use = held if held.any() else ~held
    slope, shift = _platt(z[use], y[use])
    return np.concatenate((w, [slope, shift, b]))


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> np.ndarray | None:
    """Fit on at most ``max_rows`` labelled rows of ``max_bytes`` together, chosen and ordered by hash of the id.

    Null labels and labels other than 0 and 1 are left out, null texts count as empty. An id with several labels has the least, one with several
    texts the first of them in order. None without both classes.
    """
    marked = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    marked = marked.filter("id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    chosen = marked.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(max_rows)  # bounded before any text is read
    rows = text_rows(documents, id_col, text_col).join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    rows = stash(rows, "labelled")
    order = [F.xxhash64("id", F.lit(1)), F.col("id")]
    sized = rows.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))  # max_rows of them
    within = sized.withColumn("n", F.sum("n").over(Window.orderBy(*order))).filter(F.col("n") <= max_bytes).select("id")
    one = rows.join(F.broadcast(within), "id").repartition(1).sortWithinPartitions(*order)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            table = pa.Table.from_batches(got)
            y = table.column("y").to_numpy().astype(int)
            model = fit_rows(strings(table.column("text")), y)
            if model is not None:
                yield pa.record_batch([pa.array([model.astype(np.float32).tobytes()], pa.binary())], names=["model"])

    found = one.mapInArrow(fit, "model binary").collect()  # one row of fixed size
    return np.frombuffer(bytes(found[0]["model"]), np.float32) if found else None


def score(documents: DataFrame, model: np.ndarray | None, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT, carry: list[str] | None = None) -> DataFrame:
    """Base counts, ``base_failed``, ``p_good`` (null without a model) and ``kept`` of every document.

    Null or empty texts have no words and fail the base rules. Repeated rows are judged each for itself, whatever
    their ids. ``carry`` names columns of ``documents`` to return as well; other columns are not read.
    """
    own = [c == text_col and dict(documents.dtypes)[c] == "string" for c in carry or []]  # the text is sent once
    inner = [F.col(f"`{c}`").alias(f"carry_{i}") for i, c in enumerate(carry or []) if not own[i]]
    rows = documents.select(F.col(f"`{id_col}`").cast("long").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("__text"), *inner)
    sent = documents.sparkSession.sparkContext.broadcast(model) if model is not None else None
    kept_fields = ", ".join(f"carry_{i} {'string' if own[i] else rows.schema[f'carry_{i}'].dataType.simpleString()}" for i in range(len(own)))
    schema = f"`{id_col}` long, {BASE_SCHEMA}, base_failed boolean, kept boolean, p_good double" + (f", {kept_fields}" if own else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value.astype(np.float64) if sent is not None else None
        for batch in batches:
            counts, p = [], []
            for lo, hi, data, offsets in slabs(strings(batch.column("__text"))):
                start, end, doc = words(data, offsets)
                prints = word_prints(data, start, end)
                counts.append(base_counts(data, offsets, start, end, doc, prints))
                if weights is not None:
                    z = margins(weights, hi - lo, features(data, offsets, doc, prints)) + weights[-1]
                    p.append(1 / (1 + np.exp(-np.clip(weights[-3] * z + weights[-2], -30, 30))))
            if not counts:
                continue
            five = [np.concatenate(c).astype(np.int64) for c in zip(*counts, strict=True)]
            failed = (five[0] < MIN_WORDS) | (100 * five[4] > MAX_REPEAT_PERCENT * five[0])
            good = np.concatenate(p) if p else None
            kept = ~failed if good is None else ~failed & (good >= keep_at)
            columns = [batch.column(id_col), *map(pa.array, five), pa.array(failed), pa.array(kept), pa.array(good) if good is not None else pa.nulls(batch.num_rows, pa.float64())]
            names = [id_col, *(f.split()[0] for f in BASE_SCHEMA.split(", ")), "base_failed", "kept", "p_good"]
            for i, same in enumerate(own):
                columns.append(batch.column("__text" if same else f"carry_{i}"))
                names.append(f"carry_{i}")
            yield pa.record_batch(columns, names=names)

    out = rows.mapInArrow(run, schema)
    for i, c in enumerate(carry or []):
        out = out.withColumnRenamed(f"carry_{i}", c)
    return out


def rules(documents: DataFrame, labels: DataFrame, **names) -> DataFrame:
    """Train on the labelled rows, then score all documents."""
    return score(documents, train(documents, labels, **names), **{k: v for k, v in names.items() if k in ("id_col", "text_col")})
