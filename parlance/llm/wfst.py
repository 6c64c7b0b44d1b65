"""SentencePiece encoding and decoding with a weighted transducer in the tropical semiring.

Three machines are compiled from a model file: the normaliser (by the file's own rules: space to ``▁``, one ``▁`` in front), the pieces (a
lexicon of strings with one arc per piece) and byte fallback (a character outside the lexicon to its UTF-8 bytes).
Composed with a text they give a lattice whose states are a place and the piece that ends there. An arc weighs the
negated score of its piece; one whose piece can't stand after the piece before it weighs infinity. For a byte-pair
model that is so when merging the two pieces' characters by rank does not give back those two pieces: a sequence is
the model's own encoding just if all its neighbours can stand together, so the path of finite weight is that
encoding, and each place has one such piece (tests compare with the library on random texts).

The lattice is cut where no piece can cross; shortest paths of the cut-out stretches are remembered by string, in memory of
a fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise
from math import inf

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.textnum import strings

#: Memory (bytes, about) that a Python worker gives to remembered stretches, and half as much to pairs of pieces; longer strings aren't remembered.
REMEMBERED, LONGEST = 96 << 20, 48
#: Between two pieces in a key: no text has it, as it is half a character.
BORDER = "\ud800"
#: What an entry takes beside its strings: its place in the dictionary and the heads of both objects.
ENTRY = 200
BYTE = re.compile(r"<0x([0-9A-F]{2})>")
# Numbers of the fields of a model file that say how texts are normalised.
TRAINER, NORMALISER, KIND, BPE, SUFFIX, CHARSMAP, PREFIX, EXTRA, ESCAPE = 2, 3, 3, 2, 24, 2, 3, 4, 5


def fields(data: bytes) -> dict[int, int | bytes]:
    """Number and last value of each field of a protocol buffer message."""
    found: dict[int, int | bytes] = {}
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            found[tag >> 3] = varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            found[tag >> 3] = data[at : at + size]
            at += size
    return found


class Normaliser:
    """The first machine: a space to ``▁`` and one ``▁`` in front, as far as the model file asks for it.

    Models that need another one (a map of characters, white space drawn together) or that aren't byte-pair models are refused.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = fields(f.read())
        trainer, rules = fields(model.get(TRAINER, b"")), fields(model.get(NORMALISER, b""))
        if trainer.get(KIND, 1) != BPE:
            raise ValueError("only byte-pair models have one path of finite weight")
        if rules.get(CHARSMAP) or rules.get(EXTRA, 1) or not rules.get(ESCAPE, 1) or trainer.get(SUFFIX, 0):
            raise ValueError("the model's normaliser maps more than spaces")
        self.front = "▁" if rules.get(PREFIX, 1) else ""

    def __call__(self, text: str) -> str:
        return self.front + text.replace(" ", "▁") if text else ""


class Remembered(dict):
    """A dictionary of ``make(key)`` that holds about ``most`` bytes; full, it starts afresh."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.held = make, most, 0

    def __missing__(self, key):
        found = self.make(key)
        if len(key) <= LONGEST:
            if self.held >= self.most:
                self.clear()
                self.held = 0
            self.held += ENTRY + 2 * len(key) + len(found)
            self[key] = found
        return found


class Transducer:
    """The compiled machines; ``paths`` maps a stretch to the ids of its shortest path, as int32 bytes."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import sentencepiece

        self.normalise = Normaliser(path)
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.id, self.weight, self.bytes_of, raw = {}, {}, {}, []
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                value = int(BYTE.fullmatch(piece)[1], 16)
                self.bytes_of[value] = k
                raw.append(bytes([value]))
            elif model.is_control(k) or model.is_unknown(k):
                raw.append(b"")
            else:
                self.id[piece], self.weight[piece] = k, -model.get_score(k)
                raw.append(piece.replace("▁", " ").encode())
        self.raw = raw
        self.prefixes = {p[:i] for p in self.id for i in range(1, len(p))}  # states of the lexicon with arcs left
        self.inner = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        if any(p[1] == "▁" != p[0] for p in self.inner):
            raise ValueError("a piece holds a space inside: stretches can't be cut before spaces")
        self.stretch = re.compile("▁*[^▁]+|▁+")
        self.paths = Remembered(self.path, remembered)
        self.stands: dict[str, bool] = {}
        self.most_stands = remembered // (2 * ENTRY)

    def kept_apart(self, left: str, right: str) -> bool:
        """Whether merging the characters of both by rank gives back the two: no merge goes over the border, and each becomes one."""
        parts, border, weight = list(left + right), len(left), self.weight
        costs = [weight.get(a + b, inf) for a, b in pairwise(parts)]
        while costs:
            best = min(costs)
            if best == inf:
                break
            at = costs.index(best)
            if at == border - 1:
                return False
            border -= at < border
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del costs[at]
            if at:
                costs[at - 1] = weight.get(parts[at - 1] + parts[at], inf)
            if at < len(costs):
                costs[at] = weight.get(parts[at] + parts[at + 1], inf)
        return border == 1 and len(parts) == 2

    def can_stand(self, left: str, right: str) -> bool:
        """Whether the arc of ``right`` after ``left`` has finite weight."""
        if left[-1] + right[0] not in self.inner:
            return True
        both = left + BORDER + right
        known = self.stands.get(both)
        if known is None:
            if len(self.stands) >= self.most_stands:
                self.stands.clear()
            known = self.stands[both] = self.kept_apart(left, right)
        return known

    def shortest(self, text: str) -> list[str]:
        """Pieces of the shortest path over one stretch.

        Up to each place leads one path of finite weight at most, so the search follows arcs of finite weight, long ones first, and remembers
        places from which none goes on to the end: it looks at each arc once, and the path that it completes is the only one.
        """
        known, prefixes, can_stand, n = self.id, self.prefixes, self.can_stand, len(text)
        if text in known:
            return [text]
        path: list[str] = []
        dead: set[int] = set()
        at, size = 0, 0
        while at < n:
            if not size:  # a new place: the longest arc from it
                size = end = 1
                while text[at : at + end] in prefixes and at + end < n:
                    end += 1
                    if text[at : at + end] in known:
                        size = end
            while size:
                if at + size not in dead:
                    piece = text[at : at + size]
                    if not path or can_stand(path[-1], piece):
                        break
                size -= 1
                while size > 1 and text[at : at + size] not in known:
                    size -= 1
            if size:
                path.append(piece)
                at, size = at + size, 0
            else:
                dead.add(at)
                size = len(path.pop())
                at -= size  # its end is dead now, so a shorter arc comes next
        return path

    def path(self, text: str) -> bytes:
        """Ids of a stretch between spaces."""
        ids: list[int] = []
        for piece in self.shortest(text):
            if piece in self.id:
                ids.append(self.id[piece])
            else:
                ids += [self.bytes_of[b] for b in piece.encode("utf-8", "replace")]
        return np.array(ids, np.int32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.paths.__getitem__, self.stretch.findall(self.normalise(text)))), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.normalise.front and text.startswith(" ") else text


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode(documents: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``ids``, ``n_tokens`` and ``round_trip`` (decoding gives the text again) of every whole text.

    A null or empty text has no ids and round-trips as empty. A literal ``▁`` decodes as a space, as in the library,
    so such a text doesn't round-trip. Repeated rows are encoded each; ``carry`` names other columns to return.
    """
    inner = [F.col(f"`{c}`").alias(f"carry_{i}") for i, c in enumerate(carry or [])]
    rows = documents.select(F.col(f"`{id_col}`").cast("long").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("__text"), *inner)
    fields = "".join(f", carry_{i} {rows.schema[f'carry_{i}'].dataType.simpleString()}" for i in range(len(inner)))

    more = len(inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                texts = strings(batch.column("__text")).to_pylist()
                ids = [machine.encode(t) for t in texts]
                same = [machine.decode(x) == t for x, t in zip(ids, texts, strict=True)]
                sizes = np.array([len(x) for x in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
                yield pa.record_batch([batch.column(id_col), lists, pa.array(sizes), pa.array(same), *[batch.column(f"carry_{i}") for i in range(more)]], names=[id_col, "ids", "n_tokens", "round_trip", *[f"carry_{i}" for i in range(more)]])

    out = rows.mapInArrow(run, f"`{id_col}` long, ids array<int>, n_tokens long, round_trip boolean{fields}")
    for i, c in enumerate(carry or []):
        out = out.withColumnRenamed(f"carry_{i}", c)
    return out


def decode(encoded: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded`` of the texts of its ids (null ids: null)."""

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        machine = transducer(model)
        return column.map(lambda ids: None if ids is None else machine.decode(np.asarray(ids, np.int32)))

    return encoded.withColumn("decoded", text_of(F.col(f"`{ids_col}`")))
