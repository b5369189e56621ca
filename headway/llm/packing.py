"""Packing documents into sequences by patterns and non-negative least squares.

Only the histogram of lengths, at most one count for each length up to the sequence's, reaches the driver. Patterns
of up to four documents that fill a sequence are enumerated over length bins, non-negative least squares
fits how often each is used, the fits are rounded down and laid out with real lengths, badly filled sequences are
dissolved, and what remains goes into the gaps by best fit, still by counts. The plan says, for ranks r of
length L, which sequences and places they get; pieces look themselves up by their rank.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway.llm.common import materialize, shuffle_partitions, text_slices, tidy
from headway.llm.tokens import encoder

LIMIT = 4096
END_ID = 1
BINS, MOST_DOCS = 64, 4
#: Bytes of text that are encoded together: fewer than the encoder's own, as packing runs beside a JVM that earlier stages filled.
SLICE = 2 << 20
#: Free tokens that a sequence laid out by a pattern may keep, tried in turn.
SLACKS = (0, 2, 8, 32, 128, LIMIT)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """x >= 0 that minimises |ax - b| (Lawson and Hanson's active set)."""
    x, on = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(b).max(initial=0.0)))
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[on] = -np.inf
        k = int(np.argmax(slope))
        if slope[k] <= tolerance:
            break
        on[k] = True
        while True:
            cols = np.flatnonzero(on)
            z = np.linalg.lstsq(a[:, cols], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[cols] = z
                break
            bad = z <= 0
            step = np.min(x[cols][bad] / np.maximum(x[cols][bad] - z[bad], 1e-300))
            x[cols] += step * (z - x[cols])
            on[cols[bad & (x[cols] <= tolerance * 1e-3)]] = False
            on[cols[np.argmin(np.where(bad, x[cols], np.inf))]] = False
            x[~on] = 0
    return x


def patterns(total: int, most: int, largest: int | None = None) -> list[tuple[int, ...]]:
    """The ways to write total as at most `most` parts, largest first."""
    largest = total if largest is None else largest
    if total == 0:
        return [()]
    if most == 0:
        return []
    return [(k, *rest) for k in range(min(total, largest), 0, -1) if k * most >= total for rest in patterns(total - k, most - 1, k)]


def plan(histogram: dict[int, int], limit: int = LIMIT, bins: int = BINS, most_docs: int = MOST_DOCS) -> np.ndarray:
    """Rows (length, first rank, ranks, copies in a sequence, first sequence, offset of the first copy).

    The pieces of a length have ranks 0, 1, ...; a row places `ranks` of them from its first rank on, `copies` in
    each sequence, one after the other. All pieces are placed and no sequence exceeds the limit. Bins round
    lengths up, so a pattern of d documents may still fit at up to d - 1 bins beyond the limit: the fit is made
    with 0, 1, ... such bins allowed. Of the sequences laid out by patterns, those with more than some free tokens are
    dissolved and packed again with the residuals, for several such bounds; the plan with the fewest sequences is taken."""
    bins = min(bins, limit)
    plans = []
    for over in range(most_docs):
        groups, left = _fit(histogram, limit, bins, most_docs, over)
        plans += [_finish(groups, left, limit, slack) for slack in SLACKS]
    return min(plans, key=lambda x: x[0])[1]


def _fit(histogram: dict[int, int], limit: int, bins: int, most_docs: int, over: int) -> tuple[list[tuple], dict[int, int]]:
    """Sequences by patterns of up to `over` bins beyond the limit, as (free tokens, ((length, copies), ...), sequences), and
    the histogram of what is left."""
    bin_of = lambda n: -(-n * bins // limit)
    left: dict[int, list[list[int]]] = defaultdict(list)  # of each bin: [length, count], longest last
    for n in sorted(k for k, c in histogram.items() if c > 0):
        left[bin_of(n)].append([n, histogram[n]])
    kinds = [kind for more in range(over + 1) for kind in patterns(bins + more, most_docs, bins) if len(kind) > more]
    a = np.zeros((bins, len(kinds)))
    for j, kind in enumerate(kinds):
        for k in kind:
            a[k - 1, j] += 1
    want = np.array([sum(c for _, c in left[k]) for k in range(1, bins + 1)], float)
    fits = np.floor(nnls(a, want) + 1e-6).astype(np.int64)
    groups: list[tuple[int, tuple[tuple[int, int], ...], int]] = []

    def take(kind: tuple[int, ...]) -> list[tuple[int, list[int], int]] | None:
        """(bin, [length, count], copies) for each bin of the pattern: the longest pieces that leave room for the rest; None if too few are left."""
        need: dict[int, int] = {}
        for k in kind:
            need[k] = need.get(k, 0) + 1
        if not all(left[k] and (left[k][-1][1] >= m or len(left[k]) > 1) for k, m in need.items()):
            return None
        rest, used, out = sum(left[k][0][0] * m for k, m in need.items()), 0, []
        for k, m in need.items():
            rest -= left[k][0][0] * m
            run = next((x for x in reversed(left[k]) if used + rest + x[0] * min(m, x[1]) <= limit), None)
            if run is None:
                return None
            out.append((k, run, min(m, run[1])))
            used += run[0] * min(m, run[1])
        return out

    for j in np.argsort(-fits, kind="stable"):
        todo = int(fits[j])
        while todo > 0 and (taken := take(kinds[j])):
            times = min([todo, *(run[1] // m for _, run, m in taken)])
            for k, run, m in taken:
                run[1] -= m * times
                if not run[1]:
                    left[k].remove(run)
            groups.append((limit - sum(run[0] * m for _, run, m in taken), tuple((run[0], m) for _, run, m in taken), times))
            todo -= times
    return groups, {n: c for runs in left.values() for n, c in runs}


def _finish(groups: list[tuple], left: dict[int, int], limit: int, most_slack: int) -> tuple[int, np.ndarray]:
    """The number of sequences and plan()'s rows: dissolves the groups with more than most_slack free tokens and packs
    their pieces and what is left by best fit, longest first."""
    free: dict[int, list] = defaultdict(list)
    left = dict(left)
    for slack, what, times in groups:
        if slack <= most_slack:
            free[slack].append((what, times))
        else:
            for n, m in what:
                left[n] = left.get(n, 0) + m * times
    slacks = sorted(free)

    def put(slack: int, what: tuple, times: int) -> None:
        if not free[slack] and (i := bisect.bisect_left(slacks, slack)) <= len(slacks) and (i == len(slacks) or slacks[i] != slack):
            slacks.insert(i, slack)
        free[slack].append((what, times))

    for n, c in sorted(left.items(), reverse=True):
        while c:
            i = bisect.bisect_left(slacks, n)
            if i == len(slacks):
                each = limit // n
                if c >= each:
                    put(limit - each * n, ((n, each),), c // each)
                    c %= each
                else:
                    put(limit - c * n, ((n, c),), 1)
                    c = 0
                continue
            slack = slacks[i]
            what, times = free[slack].pop()
            if not free[slack]:
                slacks.pop(i)
            each = min(slack // n, c)
            used = min(times, c // each)
            put(slack - each * n, (*what, (n, each)), used)
            if times > used:
                put(slack, what, times - used)
            c -= each * used
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for slack in sorted(free):
        for what, times in free[slack]:
            at = 0
            for n, each in what:
                rows.append((n, rank[n], each * times, each, sequence, at))
                rank[n] += each * times
                at += n * each
            sequence += times
    return sequence, np.array(sorted(rows), np.int64).reshape(-1, 6)


def cut(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and the end id, cut into pieces
    of `limit` if longer. Null texts are empty: one piece with the end id only."""
    rows = documents.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in text_slices(batches, "text", SLICE):
            ids, sizes = enc.encode(batch.column("text"))
            ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
            n = -(-sizes // limit)
            doc = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * limit
            length = np.minimum(sizes[doc] - start, limit)
            data, at = memoryview(ids.astype("<u4").tobytes()), (np.cumsum(sizes) - sizes)[doc] + start
            parts = [data[4 * a : 4 * z] for a, z in zip(at.tolist(), (at + length).tolist(), strict=True)]
            columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
            if with_ids:
                columns.append(pa.array([bytes(p) for p in parts], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return rows.mapInArrow(lambda batches: tidy(pieces(batches)), schema)


def ranked(pieces: DataFrame, by: str, salts: int) -> DataFrame:
    """pieces with rank: 0, 1, ... among those with equal `by`. A frequent value is ranked in salted parts, whose
    sizes are then summed; ties are broken by all columns."""
    order = [c for c in pieces.columns if c not in (by, "ids")]
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    local = salted.withColumn("__r", F.row_number().over(Window.partitionBy(by, "__salt").orderBy(*order)) - 1)
    counts = salted.groupBy(by, "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy(by).orderBy("__salt")) - F.col("__n")).drop("__n")
    return local.join(before, [by, "__salt"]).withColumn("rank", (F.col("__r") + F.col("__before")).cast("bigint")).drop("__salt", "__r", "__before")


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """pieces (with length, 1 to limit) and sequence_id, offset (bigint). Repeated rows are packed each by
    itself; an empty table stays empty. The plan has a few rows for each length and pattern."""
    pieces = materialize(pieces, "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `limit` rows
    rows = pieces.sparkSession.sparkContext.broadcast(plan(histogram, limit))
    placed = ranked(pieces, "length", shuffle_partitions(pieces.sparkSession))
    names = [c for c in placed.columns if c != "rank"]
    schema = pieces.withColumns({"sequence_id": F.lit(0).cast("bigint"), "offset": F.lit(0).cast("bigint")}).select(*names, "sequence_id", "offset").schema

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rows.value
        keys = table[:, 0] * (1 << 48) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = table[np.searchsorted(keys, length * (1 << 48) + rank, "right") - 1]
            k = rank - row[:, 1]
            found = {"sequence_id": row[:, 4] + k // row[:, 3], "offset": row[:, 5] + k % row[:, 3] * length}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(x, pa.int64()) for x in found.values())], [*names, *found])

    return placed.mapInArrow(look_up, schema)


def pack_documents(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for each piece of each document.

    A null text is empty: one piece with the end id. Long texts are cut into pieces of `limit`, no other is cut. Repeated
    rows and equal ids are documents of their own; ties between equal lengths are broken by all columns, so the same
    rows give the same places but for rows equal in all of them. Other columns of documents are left out, whatever their
    names. An empty table gives an empty result."""
    return pack(cut(documents, path, id_col, text_col, limit, end_id, with_ids), limit)
