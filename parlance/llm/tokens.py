"""Token counts by overlap resynchronisation.

Texts up to ``chunk`` bytes are encoded whole. A longer one is encoded in overlapping chunks with offsets;
neighbouring chunks are spliced where both have a token boundary that is proven stable: no piece of the
vocabulary holds the two characters that meet there next to each other, so no merge, in whatever context, can
cross it. Where an overlap has no such boundary it is widened, in the end to the whole rest of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (used as pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.textnum import strings

MODEL = "piece_bpe_32k.model"
CHUNK, OVERLAP, LIMIT = 1 << 15, 1 << 9, 4096


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCounter:
    """Counts the tokens of a sentencepiece model; made once per Python worker."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.inner = {p[i : i + 2] for k in range(self.model.get_piece_size()) if not (self.model.is_byte(k) or self.model.is_control(k)) for p in [self.model.id_to_piece(k)] for i in range(len(p) - 1)}

    def stable(self, data: bytes, at: int) -> bool:
        """No piece holds the two characters on either side of the byte offset."""
        pair = data[max(0, at - 4) : at].decode("utf-8", "ignore")[-1:] + data[at : at + 4].decode("utf-8", "ignore")[:1]
        return pair.replace(" ", "▁") not in self.inner

    def starts(self, data: bytes) -> list[int]:
        """Byte offset at which each token starts; the bytes of a character that falls back all start with it."""
        return [p.begin for p in self.model.encode(data.decode("utf-8", "replace"), return_type="proto").pieces]

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of one text, by chunks where it has more than ``chunk`` bytes."""
        data = text.encode("utf-8", "replace")
        n = len(data)
        if n <= chunk:
            return len(self.model.encode(text))

        def snap(at: int) -> int:  # to the start of a character
            while 0 < at < n and data[at] & 0xC0 == 0x80:
                at -= 1
            return min(at, n)

        total, since = 0, 0  # tokens before the last splice, and its place
        low, high = 0, snap(chunk)
        starts = [low + x for x in self.starts(data[low:high])]
        while high < n:
            wide, found = overlap, None
            while found is None and high < n:
                from_ = snap(high - wide)
                if from_ <= since:  # nothing stable since the last splice: double this chunk, so that all its encodings together stay linear
                    high, wide = snap(2 * high - low), overlap
                    starts = [low + x for x in self.starts(data[low:high])]
                    continue
                to = snap(from_ + wide + chunk)
                then = [from_ + x for x in self.starts(data[from_:to])]
                found = next((b for b in sorted(set(starts) & set(then)) if from_ < b < high and self.stable(data, b)), None)
                wide *= 2
            if found is None:
                break
            total += sum(since <= x < found for x in starts)
            since, low, high, starts = found, from_, to, then
        return total + sum(x >= since for x in starts)


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(documents: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``n_bytes``, ``n_tokens`` and ``over_limit`` of every whole text.

    A null text counts as empty (0 tokens); repeated rows are counted each; other columns are not read.
    ``model`` is the path of the model file, present on every executor.
    """
    rows = documents.select(F.col(f"`{id_col}`").cast("long").alias(id_col), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counter(model)
        for batch in batches:
            texts = strings(batch.column("__text"))
            n = np.zeros(len(texts), np.int64)
            lengths = pa.compute.binary_length(texts).cast(pa.int64())
            for lo in range(0, len(texts), 256):
                part = texts[lo : lo + 256].to_pylist()
                short = [i for i, t in enumerate(part) if 4 * len(t) <= chunk or len(t.encode("utf-8", "replace")) <= chunk]
                for i, ids in zip(short, pieces.model.encode([part[i] for i in short], num_threads=1), strict=True):
                    n[lo + i] = len(ids)
                for i in set(range(len(part))) - set(short):
                    n[lo + i] = pieces.count(part[i], chunk, overlap)
            yield pa.record_batch([batch.column(id_col), lengths, pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, f"`{id_col}` long, n_bytes long, n_tokens long, over_limit boolean")
