"""Chroma audio fingerprints and their alignment.

A recording becomes overlapping frames, their spectra are summed by pitch class, smoothed over time and
normed; rectangle filters over an integral image of this picture, each quantized to two bits, give one
32-bit integer for each step. Recordings are aligned by the histogram of offsets at which they have equal
integers, and judged by the share of differing bits where an offset lays them over each other. Equal integers are found
by an inverted index of the codes of a block of recordings, which a block of queries is looked up in.
"""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.common import give_back, materialize, tidy

RATE, FRAME, HOP = 5512, 2048, 682
LOW_HZ, HIGH_HZ = 28.0, 2600.0
WIDE = 16
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
#: (shape, first pitch class, pitch classes, frames): the shapes compare halves, thirds and quarters of a rectangle.
FILTERS = tuple((k % 6, (5 * k) % 9, 3 + (k * 2) % 9, 4 + 4 * (k % 4)) for k in range(16))
CUTS = (-0.12, 0.0, 0.12)
GRAY = np.array([0, 1, 3, 2], np.uint32)
BIT_ERROR, LEAST_HITS = 0.15, 3
#: Codes (of 0.12 seconds each) that two recordings must overlap in.
LEAST_OVERLAP = 16
#: Blocks that all recordings are dealt to at least, and codes of a block of recordings, about.
BLOCKS, BLOCK = 8, 1 << 21
#: Equal codes that are looked at together.
MATCHES = 1 << 20


def pcm(data: bytes, rate: int = RATE) -> np.ndarray | None:
    """Mono samples at `rate`, -1 to 1, of a PCM WAV file of 8 to 32 bits (linear interpolation if its rate differs); None
    if it can't be read."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            own, width, channels, raw = w.getframerate(), w.getsampwidth(), w.getnchannels(), w.readframes(w.getnframes())
    except (EOFError, wave.Error, ValueError, struct.error, RuntimeError):
        return None
    if not 1 <= width <= 4 or own <= 0:
        return None
    raw = np.frombuffer(raw[: len(raw) // (width * channels) * width * channels], np.uint8).reshape(-1, channels, width)
    wide = np.zeros((*raw.shape[:2], 4), np.uint8)
    wide[:, :, 4 - width :] = raw ^ np.uint8(128) if width == 1 else raw  # 8-bit samples have no sign
    x = wide.view("<i4")[:, :, 0].mean(axis=1) / 2**31
    return x if own == rate or not len(x) else np.interp(np.arange(int(len(x) * rate / own)) * own / rate, np.arange(len(x)), x)


def wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def _classes() -> tuple[np.ndarray, np.ndarray]:
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    bins = np.flatnonzero((hz >= LOW_HZ) & (hz <= HIGH_HZ))
    return bins, np.round(12 * np.log2(hz[bins] / 440.0)).astype(np.int64) % 12


_BINS, _CLASS = _classes()
_TO_CLASS = (_CLASS[:, None] == np.arange(12)).astype(float)
_WINDOW = np.hamming(FRAME)


def chroma(samples: np.ndarray) -> np.ndarray:
    """(frames, 12): normed energy of the pitch classes, A first, smoothed over five frames."""
    n = (len(samples) - FRAME) // HOP + 1
    if n < len(SMOOTH):
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[:: HOP][:n] * _WINDOW
    power = np.abs(np.fft.rfft(frames, axis=1)[:, _BINS]) ** 2 @ _TO_CLASS
    smooth = sum(c * power[i : n - len(SMOOTH) + 1 + i] for i, c in enumerate(SMOOTH))
    size = np.linalg.norm(smooth, axis=1, keepdims=True)
    return np.where(size > 1e-6, smooth / np.maximum(size, 1e-12), 0.0)


def codes(samples: np.ndarray) -> np.ndarray:
    """One uint32 for each step of the picture; recordings of fewer than WIDE + 4 frames have none."""
    picture = chroma(samples)
    n = len(picture) - WIDE + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    integral = np.zeros((len(picture) + 1, 13))
    integral[1:, 1:] = picture.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(x: int, y: int, w: int, h: int) -> np.ndarray:
        """Over frames x to x + w of each step, pitch classes y to y + h."""
        return integral[at + x + w, y + h] - integral[at + x, y + h] - integral[at + x + w, y] + integral[at + x, y]

    out = np.zeros(n, np.uint32)
    for k, (shape, y, h, w) in enumerate(FILTERS):
        h = min(h, 12 - y)
        a, b = w // 2, h // 2
        if shape == 0:
            p, q = area(0, y, w, h), np.zeros(n)
        elif shape == 1:
            p, q = area(0, y, w, b), area(0, y + b, w, h - b)
        elif shape == 2:
            p, q = area(0, y, a, h), area(a, y, w - a, h)
        elif shape == 3:
            p, q = area(0, y, a, b) + area(a, y + b, w - a, h - b), area(a, y, w - a, b) + area(0, y + b, a, h - b)
        elif shape == 4:
            c = h // 3
            p, q = area(0, y + c, w, h - 2 * c), area(0, y, w, c) + area(0, y + h - c, w, c)
        else:
            c = w // 3
            p, q = area(c, y, w - 2 * c, h), area(0, y, c, h) + area(w - c, y, c, h)
        value = np.log((1 + p) / (1 + q))
        out |= GRAY[np.searchsorted(CUTS, value if shape else value - np.log1p(w * h / 12))] << np.uint32(2 * k)
    return out


def fingerprint(recordings: DataFrame, id_col: str, audio_col: str) -> DataFrame:
    """(id, codes array<bigint>) of PCM WAV files. Null audio, files that can't be read and recordings too short have no
    codes; long ones are read whole, each alone. Other columns are left out, whatever their names."""
    rows = recordings.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{audio_col}`").alias("audio"))
    return fingerprint_made(rows, lambda batch: (v.as_py() for v in batch.column("audio")))


def fingerprint_made(rows: DataFrame, files: Callable[[pa.RecordBatch], Iterable[bytes | None]]) -> DataFrame:
    """The same of the WAV files that `files` makes of a batch of rows, one for each row. rows: (id bigint, any others). A
    file is made in the worker that hears it, one at a time, and no sound passes through Spark."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 32) for b in batches for k in range(0, b.num_rows, 32)):
            sounds = (pcm(x) if x else None for x in files(batch))
            found = [np.zeros(0, np.int64) if x is None else codes(x).astype(np.int64) for x in sounds]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.int64()))], ["id", "codes"])

    return rows.mapInArrow(lambda batches: tidy(each(batches)), "id bigint, codes array<bigint>")


def _posted(recordings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes one after the other, and the recording and place of each."""
    sizes = np.array([len(x) for x in recordings], np.int64)
    which = np.repeat(np.arange(len(sizes)), sizes)
    return np.concatenate(recordings), which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _hits(queries: list[np.ndarray], others: list[np.ndarray], least_hits: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, other, offset), by their numbers: the offsets that lay `least_hits` equal codes or more over each other. All
    of a pair come together. An inverted index of the others' codes is looked up; about `most` equal codes are looked at at
    a time, and a pair that has more of them alone is counted by offset."""
    code, of, there = _posted(others)
    order = np.argsort(code, kind="stable")
    index = code[order]
    asked, who, at = _posted(queries)
    first = np.searchsorted(index, asked, "left")
    n = np.searchsorted(index, asked, "right") - first
    met = np.concatenate([[0], np.cumsum(n)])
    begins = np.searchsorted(who, np.arange(len(queries) + 1))
    sofar = met[begins]
    before = max(len(x) for x in queries)
    wide = before + max(len(x) for x in others)
    i = 0
    while i < len(queries):
        j = max(i + 1, int(np.searchsorted(sofar, sofar[i] + most, "right")) - 1)
        a, z = begins[i], begins[j]
        if sofar[j] - sofar[i] <= most:
            pick = np.repeat(np.arange(a, z), n[a:z])
            post = order[first[pick] + np.arange(len(pick)) - (met[pick] - met[a])]
            keys, counts = np.unique((who[pick] * len(others) + of[post]) * wide + there[post] - at[pick] + before, return_counts=True)
            keys = keys[counts >= least_hits]
            yield keys // wide // len(others), keys // wide % len(others), keys % wide - before
        elif len(others) > 1:
            half = len(others) // 2
            for low, some in ((0, others[:half]), (half, others[half:])):
                for q, o, offset in _hits(queries[i:j], some, least_hits, most):
                    yield q + i, o + low, offset
        else:
            hits = np.zeros(wide, np.int64)
            for k in range(a, z):
                hits[there[order[first[k] : first[k] + n[k]]] - at[k] + before] += 1  # the places differ
            offset = np.flatnonzero(hits >= least_hits) - before
            yield np.full(len(offset), i), np.zeros(len(offset), np.int64), offset
        i = j


def _errors(x: np.ndarray, y: np.ndarray, from_x: np.ndarray, from_y: np.ndarray, overlap: np.ndarray, most: int) -> np.ndarray:
    """The share of differing bits of x[from_x : from_x + overlap] and y[from_y : from_y + overlap], for each."""
    out = np.zeros(len(overlap))
    total, i = np.concatenate([[0], np.cumsum(overlap)]), 0
    while i < len(overlap):
        j = max(i + 1, int(np.searchsorted(total, total[i] + most, "right")) - 1)
        step = np.arange(total[j] - total[i]) - np.repeat(total[i:j] - total[i], overlap[i:j])
        bits = np.bitwise_count(x[np.repeat(from_x[i:j], overlap[i:j]) + step] ^ y[np.repeat(from_y[i:j], overlap[i:j]) + step])
        out[i:j] = np.add.reduceat(bits, total[i:j] - total[i], dtype=np.int64) / (32 * overlap[i:j])
        i = j
    return out


def aligned(queries: list[np.ndarray], others: list[np.ndarray], bit_error: float, least_hits: int, least_overlap: int, most: int = MATCHES) -> Iterator[tuple[np.ndarray, ...]]:
    """(query, other, offset, bit error) by their numbers, of those that align: once for a pair, by its smallest bit error, then offset.
    All must have codes."""
    x, _, _ = _posted(queries)
    y, _, _ = _posted(others)
    (n, x_at), (m, y_at) = ((size, np.cumsum(size) - size) for size in (np.array([len(r) for r in some], np.int64) for some in (queries, others)))
    for q, o, offset in _hits(queries, others, least_hits, most):
        mine, theirs = np.maximum(0, -offset), np.maximum(0, offset)
        overlap = np.minimum(n[q] - mine, m[o] - theirs)
        long = overlap >= least_overlap
        q, o, offset, mine, theirs, overlap = (v[long] for v in (q, o, offset, mine, theirs, overlap))
        error = _errors(x, y, x_at[q] + mine, y_at[o] + theirs, overlap, most)
        order = np.lexsort((offset, error, o, q))
        order = order[error[order] <= bit_error]
        q, o, offset, error = q[order], o[order], offset[order], error[order]
        best = np.concatenate([[True], (np.diff(q) != 0) | (np.diff(o) != 0)])[: len(q)]
        yield q[best], o[best], offset[best], error[best]


def links(classes: DataFrame, bit_error: float, least_hits: int, least_overlap: int) -> DataFrame:
    """classes: (class_id, codes, asked). (class_id, other, offset, bit_error): for each asked class the others that align with
    it. Queries and all classes are dealt to blocks, and a task compares two blocks, so equal codes are counted where
    they are found and make no rows."""
    sizes = classes.select(F.sum(F.size("codes")), F.sum(F.when(F.col("asked"), F.size("codes")))).first()  # two numbers
    rows, columns = max(1, -(-(sizes[1] or 0) // BLOCK)), max(BLOCKS, -(-(sizes[0] or 0) // BLOCK))
    part = lambda n: F.pmod(F.xxhash64(F.lit(7), "class_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    both = F.col("class_id").alias("name"), F.col("codes").alias("recording")  # new columns, or a cogroup of one table mixes its sides up
    queries = classes.where("asked").select(part(rows).alias("x"), every(columns).alias("y"), *both)
    others = classes.select(every(rows).alias("x"), part(columns).alias("y"), *both)

    def compare(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        found = [tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, float))]
        if mine.num_rows and theirs.num_rows:
            ids = [t.column("name").to_numpy() for t in (mine, theirs)]
            codes_of = ([c.values.to_numpy().astype(np.uint32) for c in t.column("recording")] for t in (mine, theirs))
            for q, o, offset, error in aligned(*codes_of, bit_error, least_hits, least_overlap):
                other = ids[0][q] != ids[1][o]
                found.append((ids[0][q][other], ids[1][o][other], offset[other], error[other]))
        give_back()
        mine_id, other_id, offset, error = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"class_id": mine_id, "other": other_id, "offset": pa.array(offset, pa.int32()), "bit_error": error})

    return queries.groupBy("x", "y").cogroup(others.groupBy("x", "y")).applyInArrow(compare, "class_id bigint, other bigint, offset int, bit_error double")


def search(prints: DataFrame, is_query: str, bit_error: float = BIT_ERROR, least_hits: int = LEAST_HITS, least_overlap: int = LEAST_OVERLAP) -> DataFrame:
    """prints: (id, codes). For each recording that is_query (an SQL condition on id) holds for: (id, class_id, n_links,
    best_match, offset, bit_error).

    Recordings with equal codes are one class, named by its smallest id; n_links counts the other classes that
    align with the query's: at some offset they overlap in `least_overlap` codes, `least_hits` of them equal, and at
    most `bit_error` of the overlapping bits differ. best_match is the one with the smallest bit error, then id, then
    offset; null without any. Nothing is capped; long recordings are only more codes. Recordings without codes align with
    none. Null ids are no queries; a class of null ids only isn't compared. Repeated rows count once for each row asked;
    an empty table gives an empty result."""
    prints = materialize(prints, "prints")
    classes = materialize(prints.where("size(codes) > 0 and id is not null").groupBy("codes").agg(F.min("id").alias("class_id"), F.max(F.coalesce(F.expr(is_query), F.lit(False))).alias("asked")), "classes")
    found = links(classes, bit_error, least_hits, least_overlap)
    best = found.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"), F.min(F.struct("bit_error", "other", "offset")).alias("m"))
    queries = prints.where(f"coalesce({is_query}, false)").join(classes.select("codes", "class_id"), "codes", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))
    return queries.join(best, "class_id", "left").select("id", "class_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.col("m.other").alias("best_match"), F.col("m.offset").alias("offset"), F.col("m.bit_error").alias("bit_error"))
