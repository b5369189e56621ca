"""A file of token ids in patched frame-of-reference blocks.

A block holds 256 ids. Its minimum is subtracted, the differences are packed at the width that a given
percentile of them needs, and those that need more are patched: their place and full value stand in
the block's exception list. Blocks come in chunks, so a file is written and read in bounded memory.

    chunk:  u32 blocks, u32 exceptions, u32 ids | u32 minimum[blocks] | u8 width[blocks]
            | u32 start[blocks], in 8-byte words | u32 exception start[blocks + 1]
            | u8 place[exceptions] | u32 difference[exceptions] | packed words
    footer: documents (i64 id, u8 is null, u64 ids) column by column, u64 offset of each chunk
            | u64 footer offset, u64 documents, u64 chunks, magic

Ids are packed by lanes: word k of a lane holds bits of ids k, k + lanes, ... so that numpy packs and
unpacks all blocks of one width together.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np

BLOCK, LANES = 256, 4
EACH = BLOCK // LANES
MAGIC = b"HWPFOR01"
CHUNK_IDS = 1 << 19


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, BLOCK) uint32 below 2^width to (blocks, width * LANES) uint64."""
    lanes = values.reshape(len(values), EACH, LANES)
    out = np.zeros((len(values), width, LANES), np.uint64)
    for k in range(EACH):
        word, bit = divmod(k * width, 64)
        v = lanes[:, k].astype(np.uint64)
        out[:, word] |= v << np.uint64(bit)
        if bit + width > 64:
            out[:, word + 1] |= v >> np.uint64(64 - bit)
    return out.reshape(len(values), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    lanes = words.reshape(len(words), width, LANES)
    out = np.empty((len(words), EACH, LANES), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for k in range(EACH):
        word, bit = divmod(k * width, 64)
        v = lanes[:, word] >> np.uint64(bit)
        if bit + width > 64:
            v = v | (lanes[:, word + 1] << np.uint64(64 - bit))
        out[:, k] = v & mask
    return out.reshape(len(words), BLOCK)


def encode_chunk(ids: np.ndarray, percentile: float = 90.0) -> bytes:
    n = len(ids)
    blocks = np.full((-(-n // BLOCK), BLOCK), ids[-1], np.uint32)
    blocks.reshape(-1)[:n] = ids
    low = blocks.min(axis=1)
    diff = blocks - low[:, None]
    at = min(BLOCK - 1, max(0, int(np.ceil(percentile / 100 * BLOCK)) - 1))
    chosen = np.partition(diff, at, axis=1)[:, at].astype(np.float64)
    width = np.ceil(np.log2(chosen + 1)).astype(np.uint8)
    over = diff > ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    place, value = np.nonzero(over)[1].astype(np.uint8), diff[over]
    exc = np.concatenate([[0], np.cumsum(over.sum(axis=1))]).astype("<u4")
    diff[over] = 0
    size = width.astype(np.int64) * LANES
    start = np.cumsum(size) - size
    packed = np.zeros(int(size.sum()), "<u8")
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        packed[start[rows][:, None] + np.arange(int(w) * LANES)] = _pack(diff[rows], int(w))
    head = struct.pack("<III", len(blocks), len(place), n)
    return b"".join([head, low.astype("<u4").tobytes(), width.tobytes(), start.astype("<u4").tobytes(), exc.tobytes(), place.tobytes(), value.astype("<u4").tobytes(), packed.tobytes()])


class _Chunk:
    def __init__(self, data: bytes):
        b, e, self.n = struct.unpack_from("<III", data)
        at = 12
        self.low = np.frombuffer(data, "<u4", b, at)
        self.width = np.frombuffer(data, np.uint8, b, at := at + 4 * b)
        self.start = np.frombuffer(data, "<u4", b, at := at + b)
        self.exc = np.frombuffer(data, "<u4", b + 1, at := at + 4 * b)
        self.place = np.frombuffer(data, np.uint8, e, at := at + 4 * b + 4)
        self.value = np.frombuffer(data, "<u4", e, at := at + e)
        self.words = np.frombuffer(data, "<u8", -1, at + 4 * e)

    def blocks(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of blocks first to last, by the block index; no other block is unpacked."""
        last = len(self.low) if last is None else last
        out = np.zeros((last - first, BLOCK), np.uint32)
        for w in np.unique(self.width[first:last]):
            if w:
                rows = np.flatnonzero(self.width[first:last] == w)
                out[rows] = _unpack(self.words[self.start[first + rows][:, None].astype(np.int64) + np.arange(int(w) * LANES)], int(w))
        a, z = int(self.exc[first]), int(self.exc[last])
        row = np.repeat(np.arange(last - first), np.diff(self.exc[first : last + 1].astype(np.int64)))
        out[row, self.place[a:z]] = self.value[a:z]
        return (out + self.low[first:last, None]).reshape(-1)[: max(0, self.n - first * BLOCK)]


class Writer:
    """Writes documents in the order of add()."""

    def __init__(self, out: BinaryIO, percentile: float = 90.0):
        self.out, self.percentile, self.at = out, percentile, 0
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.chunks: list[int] = []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _flush(self, all_of_it: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        cut = 0
        while len(ids) - cut >= CHUNK_IDS or (all_of_it and cut < len(ids)):
            self.chunks.append(self.at)
            self._put(encode_chunk(ids[cut : cut + CHUNK_IDS], self.percentile))
            cut += CHUNK_IDS
        self.held = [ids[cut:].copy()]
        self.n_held = len(self.held[0])

    def add(self, doc_ids: np.ndarray, is_null: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Documents with their number of ids, and all the ids one after the other."""
        self.docs.append((doc_ids.astype("<i8"), is_null.astype(np.uint8), sizes.astype("<u8")))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= CHUNK_IDS:
            self._flush(False)

    def close(self) -> tuple[int, int]:
        """Ends the file; the numbers of its documents and ids."""
        self._flush(True)
        foot = self.at
        columns = [np.concatenate(c) for c in zip(*self.docs, strict=True)] or [np.zeros(0, "<i8"), np.zeros(0, np.uint8), np.zeros(0, "<u8")]
        for c in columns:
            self._put(c.tobytes())
        self._put(np.array(self.chunks, "<u8").tobytes())
        self._put(struct.pack("<QQQ", foot, len(columns[0]), len(self.chunks)) + MAGIC)
        return len(columns[0]), int(columns[2].sum())


class Reader:
    def __init__(self, source: BinaryIO):
        self.source = source
        source.seek(-32, io.SEEK_END)
        tail = source.read(32)
        if tail[24:] != MAGIC:
            raise ValueError("not a token file, or cut off")
        self.foot, n, chunks = struct.unpack("<QQQ", tail[:24])
        source.seek(self.foot)
        self.doc_ids = np.frombuffer(source.read(8 * n), "<i8")
        self.is_null = np.frombuffer(source.read(n), np.uint8).astype(bool)
        self.sizes = np.frombuffer(source.read(8 * n), "<u8").astype(np.int64)
        self.chunks = [int(x) for x in np.frombuffer(source.read(8 * chunks), "<u8")]

    def _chunk(self, k: int) -> _Chunk:
        end = self.chunks[k + 1] if k + 1 < len(self.chunks) else self.foot
        self.source.seek(self.chunks[k])
        return _Chunk(self.source.read(end - self.chunks[k]))

    def ids(self) -> Iterator[np.ndarray]:
        for k in range(len(self.chunks)):
            yield self._chunk(k).blocks()

    def slice(self, start: int, n: int) -> np.ndarray:
        """Ids start to start + n of the file; reads the chunks, and unpacks the blocks, that hold them."""
        parts, end = [np.zeros(0, np.uint32)], min(start + n, int(self.sizes.sum()))
        while start < end:
            k, inside = divmod(start, CHUNK_IDS)
            here = min(end - start, CHUNK_IDS - inside)
            first = inside // BLOCK
            got = self._chunk(k).blocks(first, -(-(inside + here) // BLOCK))
            parts.append(got[inside - first * BLOCK :][:here])
            start += here
        return np.concatenate(parts)

    def crc32s(self) -> np.ndarray:
        """For each document, the crc32 of its ids as little-endian unsigned 32-bit integers."""
        out, ends = np.zeros(len(self.sizes), np.int64), np.cumsum(self.sizes)
        doc, at = 0, 0
        for ids in self.ids():
            data, used = memoryview(ids.astype("<u4").tobytes()), 0
            while used < len(ids):
                while ends[doc] <= at:
                    doc += 1
                n = int(min(ends[doc] - at, len(ids) - used))
                out[doc] = zlib.crc32(data[4 * used : 4 * (used + n)], int(out[doc]))
                used, at = used + n, at + n
        return out
