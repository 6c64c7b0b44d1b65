"""Chroma fingerprints of audio columns, and alignment of recordings.

A recording (WAV bytes, PCM of 8 or 16 bits, brought to one rate) is cut into overlapping frames; each frame's power spectrum
is folded into twelve pitch classes. On the integral image of these frames 16 rectangular filters compare sums of
neighbouring areas; each answer is quantised to two bits in Gray code, and 32 bits are packed into one integer per place.

Every recording has an integer at each frame; queries have them at every ``STRIDE``-th part of a frame's step (a hop) too, so
that a recording which starts between two frames of a query finds equal frames all the same. Recordings are aligned with a
stated set of queries in blocks of bounded size, each sent to all tasks in turn, and every recording is looked up where
it is read. Equal integers vote for the offset between the two, each run of one integer once. At each offset that has enough votes
the bits are compared: the two align if in a stretch as long as half of the shorter one, of ``LEAST_COMPARED`` integers at
least, no bit differs, or no more than ``MOST_ERROR`` of them do and a share of ``LEAST_CHANGED`` of the integers, in both, isn't that before it
(steady sound looks much alike at all pitches). Equal recordings align even if they are too short for that.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.scratch import arrow_rows, stash
from parlance.llm.textnum import slabs, strings, word_prints, words

#: Samples a second and in a frame (7.8 Hz are told apart); samples from one hop to the next, and hops from one frame to the next.
RATE, FRAME, HOP, STRIDE = 2000, 256, 32, 4
#: Pitch classes from G below middle C to B, two octaves of which every semitone has bins of its own.
LOWEST, HIGHEST = 195.0, 990.0
#: Samples of a word's note where texts are played.
NOTE = 32
#: Frames that one integer looks at.
SPAN = 8
#: Integers that must be compared at least, share of the shorter recording that a stretch must have, share of its bits that may differ.
LEAST_COMPARED, LEAST_SPAN, MOST_ERROR = 8, 0.5, 0.1
#: Share of the integers of a stretch with errors that must differ from the one before.
LEAST_CHANGED = 0.25
#: Recordings of fewer integers are held against every place where so few may align at all.
FEW = 4
#: Votes that an offset needs (all, where a recording has fewer integers), of which a run gives as many as it is long; what has fewer is missed.
LEAST_VOTES = 2
#: Integers in a block of queries (32 MB with their places).
BLOCK_ITEMS = 2 << 20
#: Integers of recordings, pairs of equal runs, and places of two recordings that are worked on together; places in a block.
ITEMS, HITS, PLACES, PART = 1 << 17, 1 << 18, 1 << 17, 4
#: Steps of a pitch class between nothing and all of a frame's sound, so that sums are exact whatever stands before.
STEPS = 1 << 14
#: Frames, and samples of recordings, that are worked on together; recordings in a batch.
TOGETHER, SAMPLES, ROWS = 1024, 1 << 20, 1000


def filters() -> list[tuple[int, int, int, int]]:
    """Kind, lowest pitch class, classes and frames of each filter."""
    out = []
    for k in range(16):
        height = (12, 4, 6, 4, 3, 6)[k % 6]
        out.append((k % 6, (5 * k) % (13 - height), height, 4 + (5 * k) % (SPAN - 3)))
    return out


FILTERS = filters()
#: Edges of the four answers, as ratios.
LEVELS = [math.exp(x) for x in (-0.12, 0.0, 0.12)]
GRAY = np.array([0, 1, 3, 2], np.uint32)
SHIFTS = np.arange(30, -2, -2, dtype=np.uint32)[:, None]


def wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    """8-bit PCM, one channel."""
    n = len(samples)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", n) + samples.tobytes()


def resampled(samples: np.ndarray, rate: int) -> np.ndarray:
    """Samples at ``RATE``: each is the mean of the sound that falls into its time."""
    if rate == RATE or not len(samples):
        return samples
    n = len(samples) * RATE // rate
    so_far = np.concatenate(([0.0], np.cumsum(samples, dtype=np.float64)))
    edges = np.minimum(np.arange(n + 1) * (rate / RATE), len(samples))
    return (np.diff(np.interp(edges, np.arange(len(so_far)), so_far)) * (RATE / rate)).astype(np.float32)


def pcm(data: bytes | None) -> np.ndarray:
    """Samples between -1 and 1 at ``RATE``, channels averaged; what is not PCM of 8 or 16 bits has none."""
    if not data or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return np.zeros(0, np.float32)
    at, channels, bits, rate = 12, 1, 8, RATE
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt " and size >= 16 and at + 24 <= len(data):
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if kind != 1 or bits not in (8, 16) or not channels or not rate:
                break
        elif name == b"data":
            raw = data[at + 8 : at + 8 + size]
            wide = bits // 8 * channels
            raw = raw[: len(raw) // wide * wide]
            x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128 if bits == 8 else np.frombuffer(raw, "<i2").astype(np.float32) / 32768
            return resampled(x.reshape(-1, channels).mean(1) if channels > 1 else x, rate)
        at += 8 + size + size % 2
    return np.zeros(0, np.float32)


def _bins() -> tuple[np.ndarray, np.ndarray]:
    """Bins of the spectrum in the order of their pitch class, and where each class begins."""
    freq = np.arange(1, FRAME // 2 + 1) * RATE / FRAME
    each = np.array([round(12 * math.log2(f / 440)) % 12 for f in freq])
    kept = np.flatnonzero((freq >= LOWEST) & (freq <= HIGHEST))
    order = kept[np.argsort(each[kept], kind="stable")]
    return order + 1, np.searchsorted(each[order], np.arange(12))


BINS, CLASSES = _bins()
HANN = np.hanning(FRAME).astype(np.float32)


def chroma(frames: np.ndarray) -> np.ndarray:
    """Frames of samples to frames of twelve classes in whole steps, each of length ``STEPS`` (silence: zero)."""
    spectrum = np.fft.rfft(frames * HANN)[:, BINS]
    folded = np.add.reduceat(spectrum.real**2 + spectrum.imag**2, CLASSES, axis=1)
    norm = np.sqrt((folded * folded).sum(1, keepdims=True))
    return np.rint(np.divide(folded, norm, out=np.zeros_like(folded), where=norm > 1e-6) * STEPS).astype(np.int64)


def packed(image: np.ndarray) -> np.ndarray:
    """One integer for each frame with ``SPAN`` frames from it on."""
    n = len(image) - SPAN + 1
    sums = np.zeros((13, len(image) + 1), np.int64)  # classes by frames
    np.cumsum(image.T, 1, out=sums[1:, 1:])
    np.cumsum(sums, 0, out=sums)
    bands: dict[tuple[int, int], np.ndarray] = {}

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        if (y0, y1) not in bands:
            bands[y0, y1] = sums[y1] - sums[y0]
        band = bands[y0, y1]
        return band[t1 : t1 + n] - band[t0 : t0 + n]

    part, whole = np.empty((16, n)), np.empty((16, n))
    for k, (kind, y, h, w) in enumerate(FILTERS):
        whole[k] = area(0, w, y, y + h)
        if kind in (0, 2):  # the first half of the frames, of all classes and of a band
            part[k] = area(0, w // 2, y, y + h)
        elif kind == 1:  # the lower half of the classes
            part[k] = area(0, w, y, y + h // 2)
        elif kind == 3:  # opposite corners
            part[k] = area(0, w // 2, y, y + h // 2) + area(w // 2, w, y + h // 2, y + h)
        elif kind == 4:  # the middle classes
            part[k] = area(0, w, y + h // 3, y + h - h // 3) * 1.5
        else:  # the middle frames
            part[k] = area(w // 4, w - w // 4, y, y + h)
    # log((1 + part) / (1 + rest)) against the edges
    rest = STEPS + whole - part
    part += STEPS
    passed = (part > rest * LEVELS[0]).view(np.uint8) + (part > rest * LEVELS[1]).view(np.uint8) + (part > rest * LEVELS[2]).view(np.uint8)
    return np.bitwise_or.reduce(GRAY[passed] << SHIFTS, axis=0)


def fingerprint_all(sounds: list[np.ndarray]) -> list[np.ndarray]:
    """The integers of each of some recordings; their frames are worked on together, ``TOGETHER`` at a time, however long each is."""
    frames = [max(0, (len(x) - FRAME) // (HOP * STRIDE) + 1) for x in sounds]
    none = np.zeros(0, np.uint32)
    if not sum(frames):
        return [none] * len(sounds)
    joined = np.concatenate(sounds)
    view = np.lib.stride_tricks.sliding_window_view(joined, FRAME)
    begin = np.cumsum([0, *map(len, sounds)])
    start = np.concatenate([b + HOP * STRIDE * np.arange(n) for b, n in zip(begin, frames)])
    parts = [packed(chroma(view[start[lo : lo + TOGETHER + SPAN - 1]])) for lo in range(0, len(start) - SPAN + 1, TOGETHER)]
    whole = np.concatenate([none, *parts])
    edge = np.cumsum([0, *frames])
    return [whole[a : a + n - SPAN + 1] if n >= SPAN else none for a, n in zip(edge, frames)]


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Packed integers, one for each frame with ``SPAN`` frames from it on."""
    return fingerprint_all([samples])[0]


def dense(samples: np.ndarray) -> list[np.ndarray]:
    """Integers from each hop of the first frame's step on: those of hop h are number ``h // STRIDE`` of list ``h % STRIDE``."""
    return [fingerprint(samples[HOP * r :]) for r in range(STRIDE)]


def recordings(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``audio``: each word of a text as a short note whose pitch follows from the word; null texts are silent."""
    rows = documents.select(F.col(f"`{id_col}`").cast("long").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("__text"))
    time = np.arange(NOTE) / RATE
    notes = np.stack([(128 + 100 * np.sin(2 * np.pi * 220 * 2 ** (k / 12) * time)).astype(np.uint8) for k in range(24)])

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(id_col)
            for lo, hi, data, offsets in slabs(strings(batch.column("__text"))):
                start, end, doc = words(data, offsets)
                pitch = (word_prints(data, start, end) % np.uint64(24)).astype(np.int64)
                edge = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=hi - lo))))
                yield pa.record_batch([key.slice(lo, hi - lo), pa.array([wav(notes[pitch[edge[i] : edge[i + 1]]].reshape(-1)) for i in range(hi - lo)], pa.binary())], names=[id_col, "audio"])

    return rows.mapInArrow(play, f"`{id_col}` long, audio binary")


def fingerprints(media: DataFrame, id_col: str, audio_col: str = "audio", is_query: str = "false") -> DataFrame:
    """``items`` (packed 32-bit integers, little-endian) of every recording; null and broken audio has none.

    ``same`` is what equal recordings share: the SHA-256 of their integers, or of the samples where those are too few for one. ``hops`` are, of those for which ``is_query`` (SQL over
    the columns of ``media``) holds, the integers of each hop.
    """
    rows = media.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{audio_col}`").alias("audio"), F.coalesce(F.expr(is_query), F.lit(False)).alias("asked"))

    def some(ids: pa.Array, sounds: list[np.ndarray], asked: list[bool]) -> pa.RecordBatch:
        items = fingerprint_all(sounds)
        same = [_whole(i, x) for x, i in zip(sounds, items, strict=True)]
        hops = [[h.astype("<u4").tobytes() for h in dense(x)] if a else None for x, a in zip(sounds, asked, strict=True)]
        return pa.record_batch([ids, pa.array([i.astype("<u4").tobytes() for i in items], pa.binary()), pa.array(same, pa.binary()), pa.array(hops, pa.list_(pa.binary()))], names=["id", "items", "same", "hops"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, sounds, lo = batch.column("asked").to_pylist(), [], 0
            for i, a in enumerate(batch.column("audio")):
                sounds.append(pcm(a.as_buffer().to_pybytes() if a.is_valid and a.as_buffer() else None))
                if sum(map(len, sounds)) > SAMPLES or len(sounds) == 256 or i + 1 == batch.num_rows:
                    yield some(batch.column("id").slice(lo, len(sounds)), sounds, asked[lo : i + 1])
                    sounds, lo = [], i + 1

    return rows.mapInArrow(run, "id long, items binary, same binary, hops array<binary>")


def edges(parts: list[np.ndarray]) -> np.ndarray:
    """Where each part begins among all, and where the last ends."""
    return np.concatenate(([0], np.cumsum([len(x) for x in parts], dtype=np.int64)))


def groups(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """First and end of consecutive entries whose sizes sum up to ``most`` at most, or of one."""
    so_far, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(so_far, (so_far[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def within(begin: np.ndarray, count: np.ndarray, step: int = 1) -> np.ndarray:
    """The ``count`` numbers from each of ``begin`` on, one after the other."""
    out = np.arange(0, step * int(count.sum()), step)
    out += np.repeat(begin - step * (np.cumsum(count) - count), count)
    return out


def sums(values: np.ndarray) -> np.ndarray:
    """The sum of all values before each place, and of all."""
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=out[1:])
    return out


def paired(x: np.ndarray) -> np.ndarray:
    """Each integer and the next one in one number."""
    return x[:-1].astype(np.uint64) | x[1:].astype(np.uint64) << np.uint64(32)


def runs(x: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Part, place in it and length of each run of one integer; ``x`` are all parts, which begin and end at ``edge``."""
    new = np.append(True, x[1:] != x[:-1])[: len(x)]
    new[edge[:-1][edge[:-1] < len(x)]] = True
    at = np.flatnonzero(new)
    part = np.repeat(np.arange(len(edge) - 1), np.diff(edge))[at]
    return part, at - edge[part], np.diff(np.append(at, len(x)))


def tally(votes: np.ndarray) -> np.ndarray:
    """One vote of each code (votes are ``code * LEAST_VOTES + weight - 1``), its weight the sum, ``LEAST_VOTES`` at most."""
    votes.sort()
    code = votes // LEAST_VOTES
    first = changed(code)
    weight = np.add.reduceat(votes - code * LEAST_VOTES + 1, first) if len(first) else first
    return code[first] * LEAST_VOTES + np.minimum(weight, LEAST_VOTES) - 1


def changed(x: np.ndarray) -> np.ndarray:
    """Places whose value differs from the one before."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])


class Block:
    """Queries of one block: the integers of all their hops sorted, with query number and hop.

    ``items`` has for each query the integers of its hops (``dense``), or one array, whose places are then the hops.
    """

    def __init__(self, ids: list[int], items: list, same: list[bytes | None], least: int = 1, most_error: float = MOST_ERROR):
        self.ids, self.least, self.most_error = np.array(ids, np.int64), least, most_error
        self.items = [x if isinstance(x, list) else [x] for x in items]
        self.stride = len(self.items[0]) if items else 1
        self.whole = {key: q for q, key in enumerate(same) if key is not None}
        phases = [x for own in self.items for x in own]
        self.edge, self.flat = edges(phases), np.concatenate([np.zeros(0, np.uint32), *phases])
        lengths = np.diff(self.edge).reshape(-1, self.stride)
        self.needed, self.paired = lengths.min(1, initial=LEAST_VOTES), paired(self.flat)
        part, place, long = runs(self.flat, self.edge)
        value = self.flat[self.edge[part] + place]
        order = np.lexsort((part // self.stride, value))
        self.query, self.hop, self.long = (c[order].astype(np.int32) for c in (part // self.stride, place * self.stride + part % self.stride, long))
        self.value, first = np.unique(value[order], return_index=True)
        self.first = np.append(first, len(order))
        self.known = np.zeros(1 << 24, bool)  # spares most integers the search
        self.known[self._slot(self.value)] = True

    @staticmethod
    def _slot(value: np.ndarray) -> np.ndarray:
        return (value * np.uint32(0x9E3779B1)) >> np.uint32(8)

    def _equal(self, x: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, ...]:
        """Recording, place and length of each run that queries have too; the first of theirs with this integer, and their number."""
        own, place, long = runs(x, edge)
        value = x[edge[own] + place]
        maybe = np.flatnonzero(self.known[self._slot(value)])
        slot = np.searchsorted(self.value, value[maybe])
        same = self.value[np.minimum(slot, len(self.value) - 1)] == value[maybe]
        kept, slot = maybe[same], slot[same]
        return own[kept], place[kept], long[kept], self.first[slot], self.first[slot + 1] - self.first[slot]

    def _some(self, own: np.ndarray, place: np.ndarray, long: np.ndarray, low: np.ndarray, count: np.ndarray, lo: int, hi: int) -> Iterator[tuple[np.ndarray, ...]]:
        """The same, of queries from ``lo`` up to ``hi``, in parts of ``HITS`` pairs of runs; more only for one recording with one query."""
        if int(count.sum()) <= HITS or hi - lo == 1:
            yield own, place, long, low, count
        elif own[0] != own[-1]:
            begin = changed(own)
            for a, b in groups(np.add.reduceat(count, begin), HITS):
                of = slice(begin[a], begin[b] if b < len(begin) else None)
                yield from self._some(own[of], place[of], long[of], low[of], count[of], lo, hi)
        else:  # one recording: the halves of the queries
            half = (lo + hi) // 2
            fewer = np.array([np.searchsorted(self.query[a : a + n], half) for a, n in zip(low.tolist(), count.tolist(), strict=True)], np.int64)
            for first, n, a, b in ((low, fewer, lo, half), (low + fewer, count - fewer, half, hi)):
                kept = n > 0
                if kept.any():
                    yield from self._some(own[kept], place[kept], long[kept], first[kept], n[kept], a, b)

    def _offsets(self, x: np.ndarray, edge: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Recordings, queries and offsets (hops) that have votes enough."""
        size = np.diff(edge)
        before = self.stride * int(size.max(initial=0))
        width = before + int(self.hop.max(initial=0)) + 1
        spot = (self.query.astype(np.int64) * width + self.hop) * LEAST_VOTES
        for own, place, long, low, count in self._some(*self._equal(x, edge), 0, len(self.ids)):
            tallies = []
            base = ((own - own[:1]) * (len(self.ids) * width) + before - self.stride * place) * LEAST_VOTES
            for a, b in groups(count, HITS):
                n = count[a:b]
                hit = within(low[a:b], n)
                vote = np.repeat(base[a:b], n) + spot[hit]
                # two runs of one integer vote for the offset at which they begin together and for that at which they end together
                here, there = np.repeat(long[a:b], n), self.long[hit]
                more = np.flatnonzero((here > 1) | (there > 1))
                vote[more] += np.minimum(np.minimum(here[more], there[more]), LEAST_VOTES) - 1
                other = more[here[more] != there[more]]
                tallies.append(tally(np.concatenate((vote, vote[other] + (there[other] - here[other]) * (self.stride * LEAST_VOTES)))))
            if not tallies:
                continue
            votes = tally(np.concatenate(tallies)) if len(tallies) > 1 else tallies[0]
            code = votes // LEAST_VOTES
            which = code // width
            of = which // len(self.ids)
            query, offset = which - of * len(self.ids), code - which * width - before
            enough = np.flatnonzero(votes - code * LEAST_VOTES + 1 >= np.minimum(self.needed[query], size[of + own[0]]))
            yield of[enough] + own[0], query[enough], offset[enough]

    def _few(self, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All offsets of recordings and queries of so few integers that none may be equal."""
        found = [(i, q, self.stride * k + r) for i, n in enumerate(np.diff(edge).tolist()) for q, p in enumerate(self.items) if min(n, len(p[0])) < FEW for r, y in enumerate(p) for k in range(-n, len(y))]
        return tuple(np.array(found, np.int64).reshape(-1, 3).T)

    def _aligned(self, x: np.ndarray, edge: np.ndarray, own: np.ndarray, query: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of these align, the places in common, and the share of bits that differ in the best stretch."""
        shift, phase = offset // self.stride, query * self.stride + offset % self.stride
        size, other = np.diff(edge)[own], np.diff(self.edge)[phase]
        first = np.maximum(0, -shift)
        n, least = np.minimum(size, other - shift) - first, np.maximum(self.least, np.ceil(LEAST_SPAN * np.minimum(size, other)).astype(np.int64))
        x_at, y_at = edge[own] + first, self.edge[phase] + first + shift

        def stretches(n: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Of entries of ``n`` places: where each stretch of ``span`` begins, how long it is, and which is the first of its entry."""
            many = n - span + 1
            return within(np.cumsum(n) - n, many), np.repeat(span, many), np.cumsum(many) - many

        # a stretch holds so many whole blocks, wherever it begins: no more bits differ in the best of them than in all of it
        rest = np.flatnonzero((n >= least) & (least > 0))
        whole = (least[rest] - PART + 1) // PART
        short, rest, whole = rest[whole < 1], rest[whole >= 1], whole[whole >= 1]
        x_paired, maybe = paired(x), [short]
        for a, b in groups(n[rest] // PART, PLACES):
            k, span = rest[a:b], whole[a:b]
            blocks = n[k] // PART
            here, there = within(x_at[k], blocks, PART), within(y_at[k], blocks, PART)
            so_far = sums(sum(np.bitwise_count(x_paired[here + i] ^ self.paired[there + i]) for i in range(0, PART, 2)))
            at, long, begin = stretches(blocks, span)
            maybe.append(k[np.minimum.reduceat(so_far[at + long] - so_far[at], begin) / (32 * least[k]) <= self.most_error])
        rest = np.sort(np.concatenate(maybe))
        found, errors = [rest[:0]], [np.zeros(0)]
        for a, b in groups(n[rest], PLACES):
            k = rest[a:b]
            at, long, begin = stretches(n[k], least[k])
            values = x[within(x_at[k], n[k])], self.flat[within(y_at[k], n[k])]
            so_far = sums(np.bitwise_count(values[0] ^ values[1]))
            wrong, told = so_far[at + long] - so_far[at], np.ones(len(at), bool)
            for v in values:
                new = np.append(True, v[1:] != v[:-1])
                new[np.cumsum(n[k]) - n[k]] = True
                so_far = sums(new)
                told &= so_far[at + long] - so_far[at] >= LEAST_CHANGED * long
            error = np.minimum.reduceat(np.where(told | (wrong == 0), wrong / (32 * long), np.inf), begin)
            close = np.flatnonzero(error <= self.most_error)
            found.append(k[close])
            errors.append(error[close])
        found = np.concatenate(found)
        return found, n[found], np.concatenate(errors)

    def all_matches(self, owns: list[int | None], items: list[np.ndarray], same: list[bytes | None]) -> list[list[tuple[int, int, int, float]]]:
        """For each recording: query id, offset (hop in the query less hop here), integers compared, share of bits that differ in the best stretch."""
        edge, x = edges(items), np.concatenate([np.zeros(0, np.uint32), *items])
        equal = [self.whole.get(key) for key in same]
        equal = [-1 if q is None or self.ids[q] == own else q for q, own in zip(equal, owns, strict=True)]
        best: list[dict[int, tuple[int, int, int, float]]] = [{} if q < 0 else {q: (int(self.ids[q]), 0, len(items[i]), 0.0)} for i, q in enumerate(equal)]
        done, named = np.array(equal, np.int64), np.array([own is not None for own in owns], bool)
        names = np.array([own or 0 for own in owns], np.int64)
        near: set[tuple[int, int, int, int, float]] = set()
        if len(self.flat):
            for own, query, offset in itertools.chain(self._offsets(x, edge), [self._few(edge)] if self.least < FEW else []):
                other = np.flatnonzero((query != done[own]) & ~(named[own] & (self.ids[query] == names[own])))
                own, query, offset = own[other], query[other], offset[other]
                found, n, error = self._aligned(x, edge, own, query, offset)
                near.update(zip(own[found].tolist(), query[found].tolist(), offset[found].tolist(), n.tolist(), error.tolist(), strict=True))
        for i, q, shift, n, error in sorted(near):
            if q not in best[i] or (best[i][q][3], -best[i][q][2]) > (round(error, 6), -n):
                best[i][q] = (int(self.ids[q]), shift, n, round(error, 6))
        return [list(found.values()) for found in best]

    def matches(self, own: int, x: np.ndarray, same: bytes | None = None) -> list[tuple[int, int, int, float]]:
        """The matches of one recording."""
        return self.all_matches([own], [x], [same])[0]


def _whole(items: np.ndarray, samples: np.ndarray) -> bytes | None:
    """What equal whole recordings share: all integers, or the samples where there are none; silence without samples is like nothing."""
    return hashlib.sha256((items if len(items) else samples).tobytes()).digest() if len(samples) else None


FOUND = "query_id long, offset long, n_compared long, bit_error double"


def align(prints: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``id, n_items, sha256`` of every row of ``prints`` with ``query_id, offset, n_compared, bit_error`` for each class of queries it aligns with.

    Queries are the rows that have ``hops``; equal ones are one class, named by its smallest id, whose members share their ``sha256``. ``row`` tells all rows apart. Recordings that align with none have one row with nulls; a
    recording isn't held against a query of its own id. The matches of each block are a table in the shared folder before the next is sent.
    """
    context = prints.sparkSession.sparkContext
    asked = prints.filter("hops is not null and id is not null and same is not null")
    queries = asked.groupBy("same").agg(F.min("id").alias("id"), F.min_by("hops", "id").alias("hops")).withColumn("n", F.expr("aggregate(hops, 0L, (n, x) -> n + length(x) div 4)"))
    queries = stash(queries, "queries")
    total = queries.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_items))
    found: DataFrame | None = None
    for k in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).collect()  # about block_items integers
        sent = context.broadcast(([r["id"] for r in part], [[bytes(x) for x in r["hops"]] for r in part], [bytes(r["same"]) for r in part]))

        def look(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, raw, same = sent.value
            block = Block(ids, [[np.frombuffer(x, "<u4") for x in phases] for phases in raw], same, LEAST_COMPARED)
            for batch in batches:
                owns, same_here = batch.column("id").to_pylist(), batch.column("same").to_pylist()
                items = [np.frombuffer(x.as_buffer() or b"", "<u4") for x in batch.column("items")]
                found = [here for a, b in groups(np.array([len(x) for x in items]), ITEMS) for here in block.all_matches(owns[a:b], items[a:b], same_here[a:b])]
                rows, got = [i for i, here in enumerate(found) for _ in here], [m for here in found for m in here]
                if got:
                    columns = [pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)]
                    yield pa.record_batch([batch.column("row").take(pa.array(rows)), *columns], names=["row", *[f.split()[0] for f in FOUND.split(", ")]])

        matched = stash(prints.select("row", "id", "items", "same").mapInArrow(look, f"row long, {FOUND}"), "matches")
        sent.destroy()
        found = matched if found is None else found.union(matched)
    each = prints.select("row", "id", (F.length("items") / 4).cast("long").alias("n_items"), F.coalesce(F.lower(F.hex("same")), F.sha2(F.lit(""), 256)).alias("sha256"))
    return each.join(found, "row", "left").drop("row")


def search(media: DataFrame, is_query: str, id_col: str = "doc_id", audio_col: str = "audio") -> DataFrame:
    """Fingerprints of all recordings, aligned with those for which ``is_query`` (SQL over the columns of ``media``) holds.

    Null, broken and silent recordings have no integers; equal ones among them that have samples still meet. Repeated rows are rows of their own.
    """
    prints = fingerprints(media, id_col, audio_col, is_query).withColumn("row", F.monotonically_increasing_id())
    with arrow_rows(media.sparkSession, ROWS):
        known = stash(prints, "fingerprints")
    return align(known).withColumnRenamed("id", id_col)
