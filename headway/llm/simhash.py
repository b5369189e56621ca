"""SimHash near-duplicates: fingerprints, and an exact tiled comparison of all of them.

Different fingerprints are dealt into tiles by population count. Two fingerprints that differ in at most r bits have
population counts at most r apart, in all and summed over any parts of the word; so tile pairs whose counts differ by more
are skipped, and large tile pairs are cut by the counts of the word's quarters; what is left is compared, with numpy
exclusive-or and bit counts. A pair of tiles answers with a spanning forest of its links, not with all of them,
so a group of thousands of near copies costs thousands of rows.

near_duplicates() groups by the fingerprint alone. keep_first() removes near copies by the similarity of their
shingle sets: the tiles then hold wide fingerprints of the sets, whose radius is wide enough to hold all similar pairs
but for a chance in the order of 1e-5, tiles of too different set sizes are skipped too, and what is near is checked
on the sets themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.llm.common import materialize, shuffle_partitions, text_slices, tidy
from headway.llm.components import components
from headway.llm.tokens import ragged

SHINGLE, RADIUS = 4, 4
#: Fingerprints in a tile, about: so many that there are TILES tiles, but no fewer than the first and no more than the second.
TILE, TILES = (1 << 16, 1 << 18), 96
#: keep_first(): words of a shingle; the least similarity as a fraction; bits that similar sets differ in at most, in
#: the first word of the wide fingerprint and in all WIDE of them: of small sets, up to SMALL shingles, and of others. At
#: a similarity of 0.8 a set differs in 39 of 256 bits, with a deviation of 6 (of four or five shingles: 48).
WORDS, LEAST, OF = 5, 4, 5
WIDE, SMALL, FIRST_BITS, ALL_BITS = 4, 32, (27, 22), (88, 68)
#: Of each text so many nearest ones in a tile pair are checked first; what they join need not be compared again.
NEAREST = 4
#: Shingles of a tile's sets at most, where tiles hold these.
TILE_SHINGLES = 1 << 21
#: Slots of the bitmap that picks the texts whose sets are needed.
SLOTS = 1 << 22


def bit_sums(h: np.ndarray) -> np.ndarray:
    """Of (n, w) uint64: how many rows have each of the 64 w bits. Up to 255 rows are added as bytes, eight at a time."""
    out = np.zeros(64 * h.shape[1], np.int64)
    for at in range(0, len(h), 255 * 64):
        bits = np.unpackbits(np.ascontiguousarray(h[at : at + 255 * 64], "<u8").view(np.uint8), axis=1, bitorder="little")
        lanes = bits.view("<u8")
        for k in range(0, len(lanes), 255):
            out += lanes[k : k + 255].sum(axis=0).view(np.uint8)
    return out


def majority(h: np.ndarray) -> np.ndarray:
    """The SimHash words of (n, w) uint64: a bit is 1 if more than half the rows have it."""
    return np.packbits(2 * bit_sums(h) > len(h), bitorder="little").view("<u8")


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """The SimHash of the k-word shingles (as bits of an unsigned 64-bit integer)."""
    flat = b" ".join(text.lower().split())
    if not flat:
        return 0
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(flat)]
    hash_of = xxhash.xxh64_intdigest
    if len(starts) <= k:
        return hash_of(flat, 42)
    h = np.array([hash_of(flat[a:b], 42) for a, b in zip(starts, ends[k - 1 :])], "<u8")  # noqa: B905
    return int(majority(h[:, None])[0])


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return pc.fill_null(batch.column("text"), "").cast(pa.large_binary()).to_pylist()


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp bigint). A null or blank text has the fingerprint 0."""
    rows = documents.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            fps = np.array([fingerprint(t, k) for t in _texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return rows.mapInArrow(lambda batches: tidy(each(batches)), "doc_id bigint, fp bigint")


def _quarters(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kinds of population counts of a word's quarters, the indices of the words kind by kind, and where each kind begins."""
    counts = np.bitwise_count(np.ascontiguousarray(v).view("<u2").reshape(-1, 4)).astype(np.int32)
    kinds, of = np.unique(counts @ np.array([4913, 289, 17, 1], np.int32), return_inverse=True)
    return (kinds[:, None] // np.array([4913, 289, 17, 1]) % 17).astype(np.int8), np.argsort(of, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(kinds)))])


def near(a: np.ndarray, b: np.ndarray, radius: int, most: int = 1 << 19, whole: int = 1 << 25) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (into a, into b) of all pairs that differ in `radius` bits or fewer, some at a time. Lists of more than `whole`
    pairs are cut by the population counts of the word's quarters; kinds whose counts differ by more than the radius in sum are skipped."""

    def compare(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rows = max(1, most // max(1, len(y)))
        there = b[y]
        for at in range(0, len(x), rows):
            i, j = np.nonzero(np.bitwise_count(a[x[at : at + rows], None] ^ there) <= radius)
            yield x[at + i], y[j]

    if len(a) * len(b) <= whole:
        yield from compare(np.arange(len(a)), np.arange(len(b)))
        return
    (kinds, order, starts), (others, other_order, other_starts) = _quarters(a), _quarters(b)
    sizes = np.diff(other_starts)
    for k, kind in enumerate(kinds):
        fits = np.flatnonzero(np.abs(others - kind).sum(axis=1, dtype=np.int16) <= radius)
        if len(fits):
            yield from compare(order[starts[k] : starts[k + 1]], ragged(other_order, other_starts[:-1], sizes, fits)[0])


class Forest:
    """Keeps, of pairs given some at a time, those that join what was apart."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            li, lj = self.label[i], self.label[j]
            i, j, li, lj = (x[li != lj] for x in (i, j, li, lj))
            if not len(i):
                break
            # each label takes one link to a smaller label; these make no cycle
            high, low = np.maximum(li, lj), np.minimum(li, lj)
            _, pick = np.unique(high, return_index=True)
            self.left.append(i[pick])
            self.right.append(j[pick])
            to = np.arange(len(self.label))
            to[high[pick]] = low[pick]
            while not (to == (to := to[to])).all():
                pass
            self.label = to[self.label]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.left, self.right))


def forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices (into a, into b) of links that join what all the links of the two tiles join."""
    n = 0 if same else len(a)
    held = Forest(n + len(b))
    for i, j in near(a, b, radius):
        if same:
            i, j = i[j > i], j[j > i]
        held.add(i, j + n)
    i, j = held.pairs()
    return i, j - n


def tile_pairs(rows: DataFrame, columns: list[str], next_band: bool, radius: int, tile: int | None = None, most: Callable[[int], int] | None = None) -> DataFrame:
    """rows: (band int, p int, *columns). Pairs (t1, a, t2, b) of tiles whose rows can be near: a and b are arrays of structs
    of `columns`. A tile has about `tile` rows of one band and neighbouring population counts p; bands are compared with
    themselves and, with next_band, the next one; counts more than `radius` apart aren't. most: of a band, the most rows that a tile of
    it may have."""
    spark = rows.sparkSession
    held = sorted((r["band"], r["p"], r["n"]) for r in rows.groupBy("band", "p").agg(F.count(F.lit(1)).alias("n")).collect())  # bands x 65 rows at most
    tile = tile or min(max(TILE[0], sum(n for _, _, n in held) // TILES), TILE[1])
    cells, tiles = [], []  # (band, p, first tile, tiles), (tile, band, lowest and highest count)
    for band, p, n in held:
        size = tile if most is None else max(1, min(tile, most(band)))
        last = tiles[-1] if tiles else None
        if last and last[1] == band and last[4] + n <= size:
            last[3], last[4] = p, last[4] + n
            cells.append((band, p, last[0], 1))
        else:
            many = -(-n // size)
            cells.append((band, p, len(tiles), many))
            tiles += [[len(tiles) + k, band, p, p, -(-n // many)] for k in range(many)]
    cell = spark.createDataFrame(cells, "band int, p int, first int, many int")
    number = (F.col("first") + F.pmod(F.xxhash64(*columns), F.col("many"))).cast("int")
    # about `tile` rows a group, as counted
    dealt = materialize(rows.join(F.broadcast(cell), ["band", "p"]).groupBy(number.alias("t")).agg(F.collect_list(F.struct(*columns)).alias("of")), "tiles")
    info = spark.createDataFrame([x[:4] for x in tiles], "t int, band int, lo int, hi int")
    left = info.select(F.col("t").alias("t1"), F.col("band").alias("own"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"), F.explode(F.array("band", F.col("band") + 1) if next_band else F.array("band")).alias("band"))
    met = left.join(info.withColumnRenamed("t", "t2"), "band").where(f"(own < band or t1 <= t2) and lo - hi1 <= {radius} and lo1 - hi <= {radius}").select("t1", "t2")
    both = met.join(dealt.select(F.col("t").alias("t1"), F.col("of").alias("a")), "t1").join(dealt.select(F.col("t").alias("t2"), F.col("of").alias("b")), "t2")
    return both.repartition(4 * shuffle_partitions(spark))


def _fields(cell: pa.ListScalar, names: list[str]) -> list[np.ndarray]:
    return [cell.values.field(n).to_numpy(zero_copy_only=False) for n in names]


def links(different: DataFrame, radius: int = RADIUS, tile: int | None = None) -> DataFrame:
    """different: (fp bigint), each once. Links (a, b) that connect what pairs at `radius` bits or fewer connect."""
    rows = different.select(F.lit(0).alias("band"), F.bit_count("fp").cast("int").alias("p"), "fp")
    pairs = tile_pairs(rows, ["fp"], False, radius, tile)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (_fields(batch.column(c)[k], ["fp"])[0].view(np.uint64) for c in ("a", "b"))
                i, j = forest(a, b, radius, batch.column("t1")[k].as_py() == batch.column("t2")[k].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(a[i].view(np.int64)), pa.array(b[j].view(np.int64))], ["a", "b"])

    return pairs.mapInArrow(lambda batches: tidy(compare(batches)), "a bigint, b bigint")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id), one row for each row of documents.

    component_id is the smallest doc_id that chains of fingerprints at most `radius` bits apart reach. Null
    and blank texts share the fingerprint 0 and link like any other. Long texts are hashed whole. Repeated rows share
    a component; null doc_ids take part but are never the smallest (null only if a whole component has no id). An empty
    table gives an empty result; other columns of documents are left out, whatever their names."""
    prints = materialize(fingerprints(documents, id_col, text_col, k), "prints")
    different = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "different")
    joined = components(links(different.select("fp"), radius)).withColumnRenamed("node", "fp")
    roots = different.join(joined, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # written, so that both sides of the join are plain exchanges, which Spark can split at a large component
    smallest = materialize(roots.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    classes = materialize(roots.join(smallest, "root").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(text: bytes, k: int = WORDS) -> np.ndarray:
    """The different hashes of the k-word shingles, sorted; a shorter text is one shingle, a blank one has none."""
    words = text.lower().split()
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [], np.uint64)
    hash_of = xxhash.xxh64_intdigest
    h = np.array([hash_of(w, 42) for w in words], np.uint64)
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashes in WIDE words; each word reads another mix of the hashes."""
    if not len(hashes):
        return np.zeros(WIDE, np.uint64)
    h = hashes[:, None] + np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return majority(h ^ (h >> np.uint64(31)))


_W = [f"w{k}" for k in range(WIDE)]


def _key(text_col: str) -> Column:
    """Tells different texts apart; null is as empty."""
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))


def wide_fingerprints(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, n shingles, the words of the wide fingerprint) of each row."""
    rows = documents.select(F.col(f"`{id_col}`").alias("id"), _key(text_col).alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = rows.select("id", "key", F.lit(0).alias("n"), *[F.lit(0).cast("bigint").alias(w) for w in _W]).schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            sizes, words = [], []
            for t in _texts(batch):
                h = shingles(t)
                sizes.append(len(h))
                words.append(wide_fingerprint(h))
            columns = np.array(words, np.uint64).view(np.int64).T
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(sizes, pa.int32()), *(pa.array(np.ascontiguousarray(c)) for c in columns)], ["id", "key", "n", *_W])

    return rows.mapInArrow(lambda batches: tidy(each(batches)), schema)


def close(a: list[np.ndarray], b: list[np.ndarray], same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """a, b: columns (n, root, words). (i, j, bits they differ in) of the pairs of different roots that may be similar
    enough, some at a time."""
    order = np.argsort(b[0], kind="stable")
    b = [x[order] for x in b]
    by_size = np.argsort(a[0], kind="stable")
    i_of = by_size
    n, sizes = a[0][by_size].astype(np.int64), b[0].astype(np.int64)
    rows = max(1, (1 << 19) // max(1, len(sizes)))
    for at in range(0, len(n), rows):
        x = i_of[at : at + rows]
        here = n[at : at + rows]
        lo, hi = np.searchsorted(sizes, -(-LEAST * here[0] // OF), "left"), np.searchsorted(sizes, here[-1] * OF // LEAST, "right")
        small = here[0] <= SMALL
        i, j = np.nonzero(np.bitwise_count(a[2][x, None] ^ b[2][None, lo:hi]) <= FIRST_BITS[0 if small else 1])
        i, j = x[i], j + lo
        fits = (a[1][i] != b[1][j]) & (OF * np.minimum(a[0][i], sizes[j]) >= LEAST * np.maximum(a[0][i], sizes[j]))
        if same:
            fits &= order[j] > i
        i, j = i[fits], j[fits]
        bits = sum((np.bitwise_count(a[2 + k][i] ^ b[2 + k][j]).astype(np.int64) for k in range(WIDE)), np.zeros(len(i), np.int64))
        fits = bits <= np.where(np.minimum(a[0][i], sizes[j]) <= SMALL, ALL_BITS[0], ALL_BITS[1])
        yield i[fits], order[j[fits]], bits[fits]


def _banded(different: DataFrame, *more: str) -> DataFrame:
    """different: (key, n, root, words). With band, so that sets of similar sizes are in one or in neighbours, and p."""
    band = F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / F.log(F.lit(OF / LEAST)) + F.lit(1e-9)).cast("int")
    return different.select(band.alias("band"), F.bit_count("w0").cast("int").alias("p"), "key", "n", "root", *_W, *more)


_NAMES = ["key", "n", "root", *_W]


def _tile(cell: pa.ListScalar) -> list[np.ndarray]:
    columns = _fields(cell, _NAMES)
    return columns[:3] + [w.view(np.uint64) for w in columns[3:]]


def candidates(different: DataFrame, nearest: int = NEAREST, tile: int | None = None) -> DataFrame:
    """different: (key, n, root, words). Of the pairs (a, b) that may be similar enough, for each text and tile pair `nearest` that differ in the fewest
    bits; also (a, null) for each key that is in any such pair."""
    pairs = tile_pairs(_banded(different), _NAMES, True, max(FIRST_BITS), tile)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (_tile(batch.column(c)[k]) for c in ("a", "b"))
                same = batch.column("t1")[k].as_py() == batch.column("t2")[k].as_py()
                seen = [np.zeros(len(x[0]), bool) for x in (a, b)]
                for i, j, bits in close(a[1:], b[1:], same):
                    seen[0][i], seen[1][j] = True, True
                    if len(i):  # all partners of a row come together
                        order = np.lexsort((b[0][j], bits, i))
                        i, j = i[order], j[order]
                        starts = np.flatnonzero(np.concatenate([[True], np.diff(i) != 0]))
                        place = np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i))))
                        i, j = i[place < nearest], j[place < nearest]
                        yield pa.RecordBatch.from_arrays([pa.array(a[0][i]), pa.array(b[0][j])], ["a", "b"])
                keys = np.unique(np.concatenate([a[0][seen[0]], b[0][seen[1]]]))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.nulls(len(keys), pa.int64())], ["a", "b"])

    return pairs.mapInArrow(lambda batches: tidy(compare(batches)), "a bigint, b bigint")


def links_between(different: DataFrame, tile: int | None = None) -> DataFrame:
    """different: (key, n, root, words, set). Links (a, b) that join all components (roots) that a similar pair joins. The sets are in the tiles and candidates
    are checked there, by an index of one tile's shingles that gives a set's common shingles with all others at once; a tile pair answers with
    a spanning forest. Tiles hold TILE_SHINGLES shingles at most, or one set."""
    rows = _banded(different, "set")
    most = lambda band: int(TILE_SHINGLES / (OF / LEAST) ** (band + 1))
    pairs = tile_pairs(rows, [*_NAMES, "set"], True, max(FIRST_BITS), tile, most)

    def sets(cell: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
        lists = cell.values.field("set")
        return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(k, 1) for x in batches for k in range(x.num_rows)):
            cells = [batch.column(c)[0] for c in ("a", "b")]
            a, b = map(_tile, cells)
            same = batch.column("t1")[0].as_py() == batch.column("t2")[0].as_py()
            shift, index = 0 if same else len(a[0]), None
            # components that meet in the tiles are one label each from the start
            label = np.unique(a[2] if same else np.concatenate([a[2], b[2]]), return_inverse=True)[1].reshape(-1)
            held = Forest(int(label.max(initial=-1)) + 1)
            out: list[tuple[int, int]] = []
            for i, j, _ in close(a[1:], b[1:], same):
                if not len(i):
                    continue
                cuts = np.flatnonzero(np.concatenate([[True], np.diff(i) != 0, [True]]))  # all partners of a row come together
                for at, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    row, others = int(i[at]), j[at:end]
                    others = others[held.label[label[row]] != held.label[label[others + shift]]]
                    if not len(others):
                        continue
                    if index is None:
                        (own, own_at), (flat, ends) = sets(cells[0]), sets(cells[1])
                        order = np.argsort(flat, kind="stable")
                        index = flat[order], np.repeat(np.arange(len(ends) - 1), np.diff(ends))[order]
                    mine = own[own_at[row] : own_at[row + 1]]
                    lo, hi = np.searchsorted(index[0], mine, "left"), np.searchsorted(index[0], mine, "right")
                    common = np.bincount(ragged(index[1], lo, hi - lo, np.arange(len(mine)))[0], minlength=len(b[0]))[others]
                    others = others[(LEAST + OF) * common >= LEAST * (a[1][row].astype(np.int64) + b[1][others])]
                    if len(others):
                        others = others[np.unique(held.label[label[others + shift]], return_index=True)[1]]
                        held.add(np.full(len(others), label[row]), label[others + shift])
                        out += [(row, other) for other in others.tolist()]
            i, j = (np.array([p[k] for p in out], np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a[0][i]), pa.array(b[0][j])], ["a", "b"])

    return pairs.mapInArrow(lambda batches: tidy(compare(batches)), "a bigint, b bigint")


def sets_of(documents: DataFrame, text_col: str, needed: DataFrame) -> DataFrame:
    """(key, set array<bigint>) of the texts whose key needed (key) has, and perhaps of some more, each once. The texts to
    read closely are picked by a bitmap of SLOTS bits, so texts aren't shuffled."""
    slot = F.pmod(F.col("key"), F.lit(SLOTS))
    maps = needed.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()  # SLOTS bits
    on = np.zeros(SLOTS // 8 + (1 << 12), np.uint8)
    for r in maps:  # buckets of 2 ** 15 bits, counted from 1 for slots above 0
        at = int(r["bucket"]) << 12
        on[at : at + len(r["bits"])] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = documents.sparkSession.sparkContext.broadcast(on)
    rows = documents.select(_key(text_col).alias("key"), slot_place(_key(text_col)).alias("at"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            at = batch.column("at").to_numpy()
            batch = batch.filter(pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            for part in text_slices(iter([batch]), "text"):
                keys, sets = [], []
                for key, t in zip(part.column("key").to_pylist(), _texts(part), strict=True):
                    if key not in seen:
                        if len(seen) < 1 << 16:  # only spares sending copies, which go by key below
                            seen.add(key)
                        keys.append(key)
                        sets.append(shingles(t))
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32)), pa.array(flat))], ["key", "set"])

    return rows.mapInArrow(lambda batches: tidy(each(batches)), "key bigint, set array<bigint>").groupBy("key").agg(F.first("set").alias("set"))


def slot_place(key: Column) -> Column:
    """The bit of a key in the bitmap: its bucket's first bit and its place in the bucket."""
    slot = F.pmod(key, F.lit(SLOTS))
    return F.bitmap_bucket_number(slot) * F.lit(1 << 15) + F.bitmap_bit_position(slot)


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets (key, set) are similar enough; two empty sets are."""
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    return materialize(both.where((LEAST + OF) * F.col("common") >= LEAST * (F.size("x") + F.size("y"))).select("a", "b"), "similar")


def merged(rest: DataFrame, pairs: DataFrame) -> DataFrame:
    """rest: (key, ..., root) with the roots that the pairs (a, b) of keys join made one, the smallest."""
    if pairs.isEmpty():
        return rest
    of = lambda c: rest.select(F.col("key").alias(c), F.col("root").alias(f"{c}_root"))
    joined = components(pairs.join(of("a"), "a").join(of("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
    renamed = rest.join(joined.select(F.col("node").alias("root"), F.col("root").alias("least")), "root", "left")
    return materialize(renamed.withColumn("root", F.coalesce("least", "root")).select(*rest.columns), "rest")


def roots(documents: DataFrame, text_col: str, different: DataFrame) -> DataFrame:
    """different: (key, n, words), each key once. (key, root) of the keys that have a near copy: root is the smallest key
    that chains of near copies reach.

    The nearest candidates of each text are checked first; then all candidates that are still in different components, inside
    their tiles. So a group of near copies costs a few links each, and no pair that could join two components is left out."""
    found = materialize(candidates(different.withColumn("root", F.col("key"))), "candidates")
    involved = materialize(found.where("b is null").select(F.col("a").alias("key")).distinct(), "involved")
    sets = materialize(sets_of(documents, text_col, involved), "sets")
    rest = materialize(different.join(involved, "key", "left_semi").withColumn("root", F.col("key")), "rest")
    rest = merged(rest, similar(found.where("b is not null"), sets))
    return merged(rest, materialize(links_between(rest.join(sets, "key")), "links")).select("key", "root")


def keep_first(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate group, with its own columns, whatever their names: that of the smallest id, then of
    the smallest hash of the text; rows without an id come last. Ids may repeat: rows that share one but aren't near copies all
    stay. Texts are near copies if the sets of their shingles of WORDS words have a similarity (common over all) of
    LEAST / OF or more, or their words are equal; a group is what chains of near copies reach. Null, empty and blank texts
    have no words and are one group; long texts are compared whole. Of repeated rows one stays; an empty table stays empty."""
    prints = materialize(wide_fingerprints(documents, id_col, text_col), "prints")
    best = F.struct(F.col("id").isNull().alias("no_id"), "id", "key")
    different = materialize(prints.groupBy("key").agg(F.first("n").alias("n"), *[F.first(w).alias(w) for w in _W], F.min(best).alias("best")), "different")
    found = materialize(roots(documents, text_col, different.select("key", "n", *_W)), "classes")
    rooted = materialize(different.select("key", "best").join(found, "key", "left").withColumn("root", F.coalesce("root", "key")), "rooted")
    keep = rooted.groupBy("root").agg(F.min("best").alias("best")).select("best.id", "best.key")
    here = prints.groupBy("id", "key").agg(F.count(F.lit(1)).alias("rows"))
    same = lambda x, y: x["id"].eqNullSafe(y["id"]) & (x["key"] == y["key"])
    kept = keep.withColumn("kept", F.lit(True))
    judged = here.join(kept, same(here, kept), "left").select(here["id"], here["key"], "rows", "kept")
    # most rows stay as they are, so those that go, or of which one stays, are the smaller table to join with
    odd = materialize(judged.where("kept is null or rows > 1").select(F.col("id").alias("id"), F.col("key").alias("key"), F.coalesce("kept", F.lit(False)).alias("kept")), "gone")
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), _key(text_col).alias("key"))
    out = rows.join(odd, same(rows, odd), "left_anti").select("row")
    if not odd.where("kept").isEmpty():
        once = odd.where("kept").select(F.col("id").alias("i"), F.col("key").alias("k"))
        again = rows.join(once, rows["id"].eqNullSafe(once["i"]) & (rows["key"] == once["k"])).select("id", "key", "row")
        out = out.union(again.groupBy("id", "key").agg(F.first("row").alias("row")).select("row"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in documents.columns])
