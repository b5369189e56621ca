import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from headway.llm import packing, pfor, token_count
from headway.llm.packing import LIMIT, pack_documents, patterns, plan
from headway.llm.token_count import count_tokens
from headway.llm.token_files import read_token_files, write_token_files
from headway.llm.tokens import PieceEncoder, tokenizer_path

NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\n a", "a  b", "x   y", "<|endoftext|>", "a<|endoftext|> b <|startoftext|>c", "it's we'LL 'sfoo", "ÀÉ é Σας ΟΔΟΣ İx", "日本語 テスト", "a\x1cb \x1c c", "12 345,6!?", "😀 😀😀", "\t\tx\r\ny", "word " * 300, "z" * 5000, "tab\t end \t", "a\x85b \x85 c", "ﬁ ǅ ß ẞ"]
ENCODERS = {n: PieceEncoder(tokenizer_path(n)) for n in NAMES}
WHOLE = {n: Tokenizer.from_file(tokenizer_path(n)) for n in NAMES}


@pytest.mark.parametrize("name", NAMES)
def test_pieces_give_what_the_library_gives(name):
    ids, sizes = ENCODERS[name].encode(pa.array([*ODD, None]))
    want = [WHOLE[name].encode(t, add_special_tokens=False).ids for t in [*ODD, ""]]
    assert sizes.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]
    assert PieceEncoder(tokenizer_path(name), frequent={"a": 1} if name[0] == "w" else None).counts(pa.array([*ODD, None])).tolist() == sizes.tolist()


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'.,aAbeéÉ1 ́<|>"), st.characters(codec="utf-8")), max_size=40), min_size=1, max_size=5))
def test_any_text(name, texts):
    ids, sizes = ENCODERS[name].encode(pa.array(texts))
    want = [WHOLE[name].encode(t, add_special_tokens=False).ids for t in texts]
    assert [len(w) for w in want] == sizes.tolist() and ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("percentile", [1, 50, 90, 100])
def test_blocks_round_trip(percentile):
    rng = np.random.default_rng(3)
    cases = [np.array([7], np.uint32), np.full(1000, 2**32 - 1, np.uint32), rng.integers(0, 2**32, 777, dtype=np.uint32), np.where(rng.random(5000) < 0.05, 2**31, rng.integers(0, 50, 5000)).astype(np.uint32)]
    for ids in cases:
        out = io.BytesIO()
        w = pfor.Writer(out, percentile)
        w.add(np.array([1, 2]), np.array([False, True]), np.array([len(ids), 0]), ids)
        assert w.close() == (2, len(ids))
        r = pfor.Reader(out)
        assert np.concatenate(list(r.ids())).tolist() == ids.tolist()
        assert r.crc32s().tolist() == [zlib.crc32(ids.astype("<u4").tobytes()), 0]
        for a, n in ((0, 1), (len(ids) // 3, 300), (len(ids) - 1, 9)):
            assert r.slice(a, n).tolist() == ids[a : a + n].tolist()


def test_documents_over_chunks():
    ids = np.arange(3 * pfor.CHUNK_IDS + 5, dtype=np.uint32) % 5000
    sizes = np.array([0, pfor.CHUNK_IDS - 1, 2, 0, len(ids) - pfor.CHUNK_IDS - 1])
    out = io.BytesIO()
    w = pfor.Writer(out)
    w.add(np.arange(5), np.zeros(5, bool), sizes, ids)
    w.close()
    ends = np.cumsum(sizes)
    assert pfor.Reader(out).crc32s().tolist() == [zlib.crc32(ids[e - s : e].astype("<u4").tobytes()) for s, e in zip(sizes, ends, strict=True)]


ROWS = [(5, "b c", "x"), (1, "a b", "y"), (None, "n", None), (5, None, "z"), (3, "", ""), (9, "long word " * 3000, "w"), (1, "a b", "y")]


def test_files(spark, tmp_path):
    t = WHOLE[NAMES[0]]
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, start string").repartition(3)
    got = read_token_files(write_token_files(df, tokenizer_path(NAMES[0]), str(tmp_path))).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for i, text, _ in order:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    empty = df.where("false")
    assert read_token_files(write_token_files(empty, tokenizer_path(NAMES[0]), str(tmp_path / "e"))).count() == 0


def test_counts(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, n_tokens string")
    got = count_tokens(df, tokenizer_path(NAMES[1])).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "", r["n_tokens"]) for r in got) == sorted((str(i), x or "", len(WHOLE[NAMES[1]].encode(x or "", add_special_tokens=False).ids)) for i, x, _ in ROWS)
    assert count_tokens(df.where("false"), tokenizer_path(NAMES[1])).count() == 0


def test_patterns():
    assert patterns(4, 3) == [(4,), (3, 1), (2, 2), (2, 1, 1)]


@settings(max_examples=30, deadline=None)
@given(h=st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_places_each_piece_once(h):
    rows = plan(h, 64, 16)
    ranks, room = {}, {}
    for n, first, count, each, sequence, offset in rows.tolist():
        assert count % each == 0
        for k in range(count):
            assert ranks.setdefault((n, first + k), True)
            room.setdefault(sequence + k // each, []).append((offset + k % each * n, n))
    assert set(ranks) == {(n, r) for n, c in h.items() for r in range(c)} and len(ranks) == sum(h.values())
    for places in room.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64
    free: list[int] = []  # first fit, longest first
    for n in sorted((n for n, c in h.items() for _ in range(c)), reverse=True):
        k = next((k for k, f in enumerate(free) if f >= n), None)
        if k is None:
            free.append(64 - n)
        else:
            free[k] -= n
    assert len(room) <= 1.1 * len(free) + 1


@pytest.mark.parametrize(("h", "most"), [({2050: 200, 2046: 200}, 200), ({1366: 300, 1365: 300, 1300: 300}, 300), ({4096: 7, 1: 5}, 8), ({}, 0)])
def test_plan_uses_room_that_bins_hide(h, most):
    rows = plan(h)
    assert max((r[4] + r[2] // r[3] for r in rows.tolist()), default=0) <= most


def best_fit_decreasing(h, limit):
    free: list[int] = []
    for n in sorted((n for n, c in h.items() for _ in range(c)), reverse=True):
        fits = [k for k, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda k: free[k])] -= n
        else:
            free.append(limit - n)
    return len(free)


def test_plan_is_as_good_as_best_fit():
    rng = np.random.default_rng(4)
    for spread in (0.4, 0.8, 1.2):
        h = dict(zip(*(x.tolist() for x in np.unique(np.clip(rng.lognormal(6, spread, 4000), 1, LIMIT).astype(int), return_counts=True)), strict=True))
        rows = plan(h)
        used = max(r[4] + r[2] // r[3] for r in rows.tolist())
        assert sum(r[2] for r in rows.tolist()) == sum(h.values()) and used <= best_fit_decreasing(h, LIMIT)


def test_packing(spark):
    df = spark.createDataFrame([*ROWS, *[(100 + i, "w " * (i % 40 * 30), None) for i in range(120)]], "doc_id bigint, text string, piece string")
    got = pack_documents(df, tokenizer_path(NAMES[1])).collect()
    want = []
    for i, text, _ in df.collect():
        ids = [*WHOLE[NAMES[1]].encode(text or "", add_special_tokens=False).ids, 1]
        want += [(str(i), k, k * LIMIT, len(ids[a : a + LIMIT]), zlib.crc32(np.array(ids[a : a + LIMIT], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), LIMIT))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    room = {}
    for r in got:
        room.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in room.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= LIMIT
    assert len(room) <= -(-sum(w[3] for w in want) // LIMIT) + 2
    assert pack_documents(df.where("false"), tokenizer_path(NAMES[1])).count() == 0


def test_packing_encodes_few_megabytes_at_a_time(spark, monkeypatch):
    seen, plain = [], packing.encoder

    class Watched:
        def encode(self, texts):
            seen.append(sum(map(len, texts.to_pylist())))
            return plain(tokenizer_path(NAMES[1])).encode(texts)

    monkeypatch.setattr(packing, "encoder", lambda path: Watched())
    rows = spark.createDataFrame([], "doc_id bigint, text string")
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, f, schema: f)
    pieces = packing.cut(rows, tokenizer_path(NAMES[1]))
    texts = ["word " * 200_000] * 8
    got = list(pieces(iter([pa.record_batch([pa.array(range(8), pa.int64()), pa.array(texts)], ["doc_id", "text"])])))
    assert sum(seen) == sum(map(len, texts)) and max(seen) <= 3 << 20
    assert sorted({i for b in got for i in b.column("doc_id").to_pylist()}) == list(range(8)) and sum(sum(b.column("length").to_pylist()) for b in got) == 8 * 200_001


def test_frequent_words_are_those_of_all_rows(spark):
    docs = spark.createDataFrame([("first words",)] * 1500 + [("later text " * 5,)] * 600, "text string").coalesce(1)
    assert set(token_count.frequent_lengths(docs, "text", tokenizer_path("word_bpe_49k.json"), table_size=2)) == {"later", "text"}
