"""Suffix-array dedup: repeats of 50 bytes or more across documents, by common-prefix intervals.

Finding where to look. Each window of `least` bytes has an anchor, its smallest hashed gram of bytes. Equal
windows have equal anchors, so hashes of anchors, packed in numpy arrays, are dealt by hash and those
that two documents share are sent back to the documents' groups. Nothing else can hold a repeat.

Finding repeats. The run of windows with one anchor is a segment (at most 2 * least bytes). Segments of
shared anchors are dealt by the anchor's hash, so all occurrences of a window meet in one bucket. Equal
segments are merged first, in their group and then in their bucket, keeping the smallest document; the
rest of a merged segment's occurrences are repeats as a whole. Over the different segments a suffix array
with common-prefix lengths is built; a scan with a stack walks its interval tree, and an interval whose
occurrences have different bytes on the left is a maximal repeat. It comes out with all its occurrences,
not only neighbours in the array: an occurrence in a document beyond the smallest one is removed.
An interval without left diversity needs no work: the longer one to its left covers it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.llm.common import give_back, shuffle_partitions, text_slices, tidy

LEAST = 50
GRAM = 20
#: Bytes of text that are looked at together, and suffixes that are sorted together if their anchors allow.
SLICE, SUFFIXES = 1 << 20, 1 << 16
#: Bytes of text whose anchors a task holds before it sends them.
HELD_BYTES = 16 << 20
#: Bytes of text in a group of documents and for each bucket of anchors, about. A task takes groups one after the other,
#: so these bound its memory, whatever the number of partitions.
GROUP_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20
_LOW = np.uint64((1 << 27) - 1)
_TABLE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(29))


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k bytes in a row."""
    parts, h, n = [], _TABLE[data], 1
    total, done = None, 0
    while True:
        if k & n:  # the bits of k, smallest first
            parts.append((h, n))
        if 2 * n > k:
            break
        h = h[:-n] * np.uint64(0xD6E8FEB86659FD93 + 2 * n) + (h[n:] ^ (h[n:] >> np.uint64(32)))
        n *= 2
    size = len(data) - k + 1
    for h, n in reversed(parts):
        here = h[done : done + size]
        total = here.copy() if total is None else total * np.uint64(0xA0761D6478BD642F) + here
        done += n
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xE7037ED1A0B428DB)
    total ^= total >> np.uint64(29)
    return total


def anchors(data: np.ndarray, ends: np.ndarray, least: int, gram: int, step: int = SLICE) -> tuple[np.ndarray, ...]:
    """data: texts one after the other, text i ending at ends[i]. For each segment: its text, its first and
    last window start, and the hash of its anchor. Works on `step` window starts at a time; a segment over such
    a border comes as two."""
    parts = []
    for at in range(0, max(1, len(data) - least + 1), step):
        doc, first, last, h = _anchors(data[at : at + step + least - 1], ends - at, least, gram)
        parts.append((doc, first + at, last + at, h))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchors(data: np.ndarray, ends: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    w = least - gram + 1
    nothing = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    if len(data) < least:
        return nothing
    h = _grams(data, gram)
    low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    n = 1
    while 2 * n <= w:
        low = np.minimum(low[:-n], low[n:])
        n *= 2
    if n < w:
        low = np.minimum(low[: len(low) - (w - n)], low[w - n :])
    doc_of_start = np.searchsorted(ends, np.arange(len(low)), "right")
    at = np.flatnonzero(np.arange(len(low)) + least <= ends[doc_of_start])
    if not len(at):
        return nothing
    where = (low[at] & _LOW).astype(np.int64)
    cut = np.flatnonzero((np.diff(where) != 0) | (np.diff(at) != 1)) + 1
    first = at[np.concatenate([[0], cut])]
    last = at[np.concatenate([cut - 1, [len(at) - 1]])]
    return doc_of_start[first], first, last, h[where[np.concatenate([[0], cut])]]


def suffix_array(segments: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all suffixes of `least` bytes or more, in order: segment, place in it, common-prefix length with the
    one before (first: 0), and the byte on the left (below 0, all different, at a segment's start)."""
    sizes = np.fromiter((len(s) for s in segments), np.int64, len(segments))
    n = sizes - least + 1
    seg = np.repeat(np.arange(len(segments)), n)
    place = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
    wide = int(sizes.max())
    flat = np.concatenate([np.frombuffer(b"".join(segments), np.uint8), np.zeros(wide, np.uint8)])
    start = (np.cumsum(sizes) - sizes)[seg] + place
    length = sizes[seg] - place
    rows = np.lib.stride_tricks.sliding_window_view(flat, wide)[start]
    rows = np.where(np.arange(wide) < length[:, None], rows, np.uint8(0))
    order = np.lexsort((length, np.ascontiguousarray(rows).view(f"S{wide}").reshape(-1)))
    rows, seg, place, length, start = rows[order], seg[order], place[order], length[order], start[order]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
    lcp = np.concatenate([[0], np.minimum(common, np.minimum(length[1:], length[:-1]))])
    left = np.where(place > 0, flat[start - 1].astype(np.int64), -1 - np.arange(len(seg)))
    return seg, place, lcp, left


def repeats(seg: np.ndarray, place: np.ndarray, lcp: np.ndarray, left: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """The maximal repeats, as intervals (length, first, last) of the suffix array: stack scan of the common-prefix
    lengths, keeping the intervals of `least` bytes or more whose occurrences differ on the left."""
    inside = lcp >= least
    first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]])) - 1
    last = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]]))
    if not len(first):
        return
    bounds = np.stack([first, last + 1], axis=1).reshape(-1)
    padded = np.concatenate([left, left[-1:]])
    diverse = np.minimum.reduceat(padded, bounds)[::2] != np.maximum.reduceat(padded, bounds)[::2]
    for lo, hi in zip(first[diverse].tolist(), last[diverse].tolist(), strict=True):
        lefts, deep = left[lo : hi + 1].tolist(), lcp[lo + 1 : hi + 1].tolist()
        stack: list[list[int]] = []  # [length, first, a left byte, whether others were seen]
        for k in range(hi - lo + 1):
            now = deep[k] if k < hi - lo else 0
            at, byte, many = k, lefts[k], False
            while stack and stack[-1][0] > now:
                d, at, b, other = stack.pop()
                many = many or other or b != byte
                byte = b
                if many:
                    yield d, lo + at, lo + k
            if not stack or stack[-1][0] < now:
                stack.append([now, at, byte, many])
            else:
                top = stack[-1]
                top[3] = top[3] or many or top[2] != byte
            if not now:
                break


def maximal_repeats(segments: list[bytes], least: int = LEAST) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """(repeat, [(segment, place), ...]) for each maximal repeat of `least` bytes or more, with all its occurrences."""
    segments_of = [i for i, s in enumerate(segments) if len(s) >= least]
    if not segments_of:
        return []
    seg, place, lcp, left = suffix_array([segments[i] for i in segments_of], least)
    out = []
    for n, a, z in repeats(seg, place, lcp, left, least):
        where = sorted((segments_of[s], int(p)) for s, p in zip(seg[a : z + 1], place[a : z + 1], strict=True))
        s, p = where[0]
        out.append((segments[s][p : p + n], where))
    return sorted(out)


def _merge(held: dict[bytes, tuple[int, list]], content: bytes, doc: int, owner: tuple, done: list) -> None:
    """Keeps, for a segment's content, the smallest document and its occurrences; others go to done."""
    now = held.get(content)
    if now is None or doc < now[0]:
        if now is not None:
            done.extend((*o, len(content)) for o in now[1])
        held[content] = (doc, [owner])
    elif doc == now[0]:
        now[1].append(owner)
    else:
        done.append((*owner, len(content)))


def _by_anchor(segments: list[bytes], least: int, gram: int, most: int = SUFFIXES) -> Iterator[list[bytes]]:
    """The segments in lists of about `most` suffixes; those of one anchor stay together, single ones are left out."""
    if not segments:
        return
    ends = np.cumsum([len(s) for s in segments])
    doc, _, _, h = anchors(np.frombuffer(b"".join(segments), np.uint8), ends, least, gram)
    anchor = np.zeros(len(segments), np.uint64)
    anchor[doc] = h
    order = np.argsort(anchor, kind="stable")
    part, size = [], 0
    for _, a, z in _cuts(anchor[order]):
        if z - a == 1:
            continue
        own = [segments[i] for i in order[a:z].tolist()]
        n = sum(map(len, own)) - (least - 1) * len(own)
        if part and size + n > most:
            yield part
            part, size = [], 0
        part.extend(own)
        size += n
    if part:
        yield part


def _pack_spans(spans: list[tuple[int, int, int]]) -> bytes:
    """(row key, start, length), ..."""
    rows = np.array(spans, np.uint64).reshape(-1, 3) if spans else np.zeros((0, 3), np.uint64)
    return struct.pack("<I", len(rows)) + rows[:, 0].astype("<u8").tobytes() + rows[:, 1].astype("<u4").tobytes() + rows[:, 2].astype("<u4").tobytes()


def _unpack_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = struct.unpack_from("<I", data)[0]
    return np.frombuffer(data, "<u8", n, 4), np.frombuffer(data, "<u4", n, 4 + 8 * n).astype(np.int64), np.frombuffer(data, "<u4", n, 4 + 12 * n).astype(np.int64)


def _cuts(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, from, to) of the runs of a sorted array."""
    if not len(keys):
        return []
    at = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
    return [(int(keys[a]), int(a), int(z)) for a, z in zip(at[:-1], at[1:], strict=True)]


def _slices(table: pa.Table, column: str) -> Iterator[pa.RecordBatch]:
    return text_slices(iter(table.combine_chunks().to_batches()), column, SLICE)


def _short(h: np.ndarray) -> np.ndarray:
    """The low 48 bits, all that is sent of an anchor's hash: two anchors that share them by chance cost a look, no error."""
    return h & np.uint64((1 << 48) - 1)


def _to_six(h: np.ndarray) -> bytes:
    return h.astype("<u8").view("<u2").reshape(-1, 4)[:, :3].tobytes()


def _from_six(data: bytes, n: int) -> np.ndarray:
    wide = np.zeros((n, 4), "<u2")
    wide[:, :3] = np.frombuffer(data, "<u2", 3 * n).reshape(-1, 3)
    return wide.view("<u8").reshape(-1)


def _zip(data: bytes) -> bytes:
    return struct.pack("<Q", len(data)) + pa.compress(data, codec="zstd", asbytes=True)


def _unzip(data: bytes) -> bytes:
    return pa.decompress(data[8:], struct.unpack_from("<Q", data)[0], codec="zstd", asbytes=True)


def _joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = texts.cast(pa.large_binary()).to_pylist()
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts], dtype=np.int64)


def repeat_spans(rows: DataFrame, groups: int, buckets: int, least: int, gram: int) -> DataFrame:
    """rows: (__g int, __key bigint, __doc bigint, __text string not null). Spans to remove, packed: (__g, payload)."""
    narrow = rows.select("__g", "__text")
    kind_of_g = "<u2" if groups < 1 << 16 else "<u4"
    each = 6 + int(kind_of_g[-1])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            h, g = (np.concatenate(x) for x in zip(*held, strict=True))
            b = (h % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            h, g, b = h[order], g[order], b[order]
            cuts = _cuts(b)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in cuts], pa.int32()), pa.array([_to_six(h[a:z]) + g[a:z].tobytes() for _, a, z in cuts], pa.binary())], ["b", "payload"])

        for batch in text_slices(batches, "__text", SLICE):
            data, ends = _joined(batch.column("__text"))
            doc, _, _, h = anchors(data, ends, least, gram)
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            once = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(h) != 0)])[: len(h)]
            held.append((h[once], batch.column("__g").to_numpy()[doc[once]].astype(kind_of_g)))
            size += len(batch.column("__text")) and len(data)
            if size >= HELD_BYTES:
                yield out()
                size = 0
        if held:
            yield out()

    def shared(table: pa.Table) -> pa.Table:
        hs, gs = [], []
        for x in table.column("payload").to_pylist():
            n = len(x) // each
            hs.append(_from_six(x, n))
            gs.append(np.frombuffer(x, kind_of_g, n, 6 * n))
        h, g = np.concatenate(hs), np.concatenate(gs)
        order = np.argsort(h, kind="stable")
        h, g = h[order], g[order]
        same = np.concatenate([[False], h[1:] == h[:-1], [False]])
        more = same[1:] | same[:-1]
        h, g = h[more], g[more]
        order = np.lexsort((h, g))
        h, g = h[order], g[order]
        once = np.concatenate([[True], (np.diff(g) != 0) | (h[1:] != h[:-1])])[: len(h)]
        h, g = h[once], g[once]
        cuts = _cuts(g.astype(np.int64))
        give_back()
        return pa.table({"__g": pa.array([k for k, _, _ in cuts], pa.int32()), "payload": pa.array([_to_six(h[a:z]) for _, a, z in cuts], pa.binary())})

    flags = narrow.mapInArrow(lambda batches: tidy(send(batches)), "b int, payload binary").groupBy("b").applyInArrow(shared, "__g int, payload binary")

    def segments(texts: pa.Table, flagged: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, bytes]] = []
        if texts.num_rows and flagged.num_rows:
            g = texts.column("__g")[0].as_py()
            known = np.unique(np.concatenate([_from_six(x, len(x) // 6) for x in flagged.column("payload").to_pylist()]))
            held: dict[int, dict[bytes, tuple[int, list]]] = {}
            done: list[tuple[int, int, int]] = []
            for batch in _slices(texts, "__text"):
                data, ends = _joined(batch.column("__text"))
                doc, first, last, h = anchors(data, ends, least, gram)
                short = _short(h)
                hit = known[np.minimum(np.searchsorted(known, short), len(known) - 1)] == short
                doc, first, last, h = doc[hit], first[hit], last[hit], h[hit]
                begin = np.concatenate([[0], ends])[doc]
                keys, docs = (batch.column(c).to_numpy().astype(t)[doc].tolist() for c, t in (("__key", np.uint64), ("__doc", np.int64)))
                raw = data.tobytes()
                for k, d, s, e, b0, b in zip(keys, docs, first.tolist(), last.tolist(), begin.tolist(), (h % np.uint64(buckets)).tolist(), strict=True):
                    _merge(held.setdefault(b, {}), raw[s : e + least], d, (k, s - b0), done)
            if done:
                out.append((g % buckets, g, 1, _pack_spans(done)))
            for b, content in held.items():
                items = [(k, d, s, c) for c, (d, owners) in content.items() for k, s in owners]
                head = struct.pack("<I", len(items)) + np.array([x[0] for x in items], "<u8").tobytes() + np.array([x[1] for x in items], "<i8").tobytes() + np.array([x[2] for x in items], "<u4").tobytes() + np.array([len(x[3]) for x in items], "<u4").tobytes()
                out.append((b, g, 0, _zip(head + b"".join(x[3] for x in items))))
            del held, done
        give_back()
        return pa.table({"b": pa.array([x[0] for x in out], pa.int32()), "__g": pa.array([x[1] for x in out], pa.int32()), "kind": pa.array([x[2] for x in out], pa.int32()), "payload": pa.array([x[3] for x in out], pa.binary())})

    # with all columns, so that the texts' exchange is used again for cutting
    found = rows.groupBy("__g").cogroup(flags.groupBy("__g")).applyInArrow(segments, "b int, __g int, kind int, payload binary")

    def intervals(table: pa.Table) -> pa.Table:
        spans: dict[int, list[bytes]] = {}
        held: dict[bytes, tuple[int, list]] = {}
        done: list[tuple[int, int, int, int]] = []
        for g, kind, x in zip(table.column("__g").to_pylist(), table.column("kind").to_pylist(), table.column("payload").to_pylist(), strict=True):
            if kind:
                spans.setdefault(g, []).append(x)
                continue
            x = _unzip(x)
            n = struct.unpack_from("<I", x)[0]
            keys, docs = np.frombuffer(x, "<u8", n, 4).tolist(), np.frombuffer(x, "<i8", n, 4 + 8 * n).tolist()
            starts, lens = np.frombuffer(x, "<u4", n, 4 + 16 * n).tolist(), np.frombuffer(x, "<u4", n, 4 + 20 * n).tolist()
            at = 4 + 24 * n
            for k, d, s, m in zip(keys, docs, starts, lens, strict=True):
                _merge(held, x[at : at + m], d, (g, k, s), done)
                at += m
        own: dict[int, list[tuple[int, int, int]]] = {}
        for g, k, s, m in done:
            own.setdefault(g, []).append((k, s, m))
        for contents in _by_anchor(list(held), least, gram):
            docs = np.array([held[c][0] for c in contents], np.int64)
            seg, place, lcp, left = suffix_array(contents, least)
            of = docs[seg]
            for n, a, z in repeats(seg, place, lcp, left, least):
                group = of[a : z + 1]
                for i in np.flatnonzero(group > group.min()).tolist():
                    p = int(place[a + i])
                    for g, k, s in held[contents[seg[a + i]]][1]:
                        own.setdefault(g, []).append((k, s + p, n))
        for g, x in own.items():
            spans.setdefault(g, []).append(_pack_spans(x))
        rows_out = [(g, x) for g, xs in spans.items() for x in xs]
        del held, own, done, spans  # else nothing is free yet
        give_back()
        return pa.table({"__g": pa.array([g for g, _ in rows_out], pa.int32()), "payload": pa.array([x for _, x in rows_out], pa.binary())})

    return found.groupBy("b").applyInArrow(intervals, "__g int, payload binary")


def _with_keys(documents: DataFrame, doc: Column, text: Column, groups: int) -> DataFrame:
    rows = documents.withColumns({"__doc": F.coalesce(doc.cast("bigint"), F.lit((1 << 63) - 1)), "__text": F.coalesce(text.cast("string"), F.lit(""))})
    rows = rows.withColumn("__key", F.xxhash64("__doc", "__text"))
    return rows.withColumn("__g", F.pmod(F.xxhash64("__key"), F.lit(groups)).cast("int"))


def dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM, characters: bool = False) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept binary): row holds the given columns as a struct.
    With `characters`, kept has whole characters only: what a cut leaves of one goes too.

    A byte of a text is removed if a string of `least` bytes over it also starts in a document with a smaller id; all is
    judged on the input. Null texts are empty, long ones are read whole. A null id is larger than any other, and rows with equal ids (repeated rows, null ids) don't remove
    from each other. Columns of any name stay. An empty table gives an empty result."""
    text = F.col(f"`{text_col}`")
    size = documents.agg(F.sum(F.octet_length(text.cast("string")).cast("bigint"))).first()[0] or 0  # one number
    least_groups = shuffle_partitions(documents.sparkSession)
    groups, buckets = (max(least_groups, -(-size // each)) for each in (GROUP_BYTES, BUCKET_BYTES))
    columns = [F.col(f"`{c}`") for c in documents.columns if c != text_col]
    rows = _with_keys(documents.select(F.struct(*columns).alias("row"), F.col(f"`{id_col}`").alias("__id"), text.alias("__t")), F.col("__id"), F.col("__t"), groups).drop("__id", "__t")
    spans = repeat_spans(rows, groups, buckets, least, gram)
    schema = rows.select("row").withColumns({"n_bytes": F.lit(0).cast("bigint"), "n_removed": F.lit(0).cast("bigint"), "n_spans": F.lit(0).cast("bigint"), "kept": F.lit(b"")}).schema

    def cut(texts: pa.Table, found: pa.Table) -> pa.Table:
        spans_of = [np.concatenate(x) for x in zip(*(_unpack_spans(x) for x in found.column("payload").to_pylist()), strict=True)] if found.num_rows else [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        order = np.lexsort((spans_of[1], spans_of[0]))
        key, start, size = (x[order] for x in spans_of)
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        mine = texts.column("__key").to_numpy().astype(np.uint64)
        lows, highs = np.searchsorted(key, mine, "left").tolist(), np.searchsorted(key, mine, "right").tolist()
        for text, lo, hi in zip(texts.column("__text"), lows, highs, strict=True):
            data = text.as_py().encode()
            kept, removed, n, at = [], 0, 0, 0
            if hi > lo:
                s = start[lo:hi]
                e = np.maximum.accumulate(s + size[lo:hi])
                new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
                for a, z in zip(s[new].tolist(), e[np.concatenate([new[1:] - 1, [len(e) - 1]])].tolist(), strict=True):
                    kept.append(data[at:a])
                    removed, n, at = removed + z - a, n + 1, z
            kept.append(data[at:])
            if characters:
                kept = [x.decode("utf-8", "ignore").encode() for x in kept]
            for c, v in zip(out, (len(data), removed, n, b"".join(kept)), strict=True):
                out[c].append(v)
        return pa.table([texts.column("row"), *(pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept"], pa.binary())], names=["row", *out])

    return rows.groupBy("__g").cogroup(spans.groupBy("__g")).applyInArrow(cut, schema)


def dedup_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """documents without the repeated bytes; all rows and columns stay. Where a cut falls inside a character,
    what is left of the character goes too."""
    kept = dedup(documents, id_col, text_col, least, characters=True)
    return kept.select(*[(F.col("kept").cast("string").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c)) for c in documents.columns])


def digest(kept: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return kept.select(F.col(f"row.`{id_col}`").alias(id_col), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
