"""Exact tokenization by pieces, with a bounded cache of pieces in each Python worker.

Both vocabularies split a text before BPE runs, and never join what stands on the two sides of certain
white space, nor Latin letters and the marks that end a word. So a text is cut there, each different piece
of a batch is encoded once by the tokenizers library, and the ids of the text are gathered from those of its
pieces. What the library would give for the whole text comes out; texts where a cut could matter go to the
library whole.
"""

from __future__ import annotations

import gc
import os
import unicodedata
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: How texts are cut for each known file: at white space that the tokenizer drops, or before single spaces.
SPLITS = {"word_bpe_49k.json": "word", "byte_bpe_50k.json": "space"}
#: Bytes of text that are encoded together.
SLICE = 12 << 20
#: Pieces that a cache holds at most, and bytes of a piece that it takes: together some 40 MB.
MOST_PIECES, PIECE_BYTES = 200_000, 48
_WHITE = r"[\t-\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SOLID = _WHITE.replace("[", "[^", 1)
#: A space inside a run of white space that isn't its first or last character, a special token's string, or the
#: character that cuts are marked with.
_WHOLE = rf"{_WHITE} (?:{_WHITE}|\z)|<\||\x01"
#: A Latin letter, the marks after it and the end of the word: both vocabularies split between the two.
_ENDED = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([.,;:!?*%#&$]+)"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ragged(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The concatenation of flat[starts[k] : starts[k] + lens[k]] for k in pick, and each part's length."""
    n = lens[pick]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.repeat((starts[pick] - (ends - n)).astype(kind), n)
    at += np.arange(total, dtype=kind)
    return flat[at], n


class PieceEncoder:
    """Encodes Arrow string arrays. The cache holds `most` pieces of PIECE_BYTES bytes at most; when it is full, those
    that the last batch had most often stay. `frequent` (piece to number of tokens) is looked at first by counts()."""

    def __init__(self, path: str, split: str | None = None, frequent: dict[str, int] | None = None, most: int = MOST_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.split = split or SPLITS.get(os.path.basename(path))
        self.frequent = frequent or {}
        self.most = most
        self.forget()
        # bytes that each id stands for: a vocabulary string has one character for each, and perhaps a word end
        vocab = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.n_bytes[i] = len(token.removesuffix("</w>") if self.split == "word" else token)
        # byte-level vocabularies write a space as U+0120 and a line feed as U+010A
        self.spaced = np.zeros(len(self.n_bytes), bool)
        self.spaced[[i for token, i in vocab.items() if token.startswith("\u0120")]] = True
        self.feed = vocab.get("\u010a", -1)

    def forget(self) -> None:
        """Empties the cache: place of each piece in lens, and the ids one after the other."""
        self.places: dict[str, int] = {}
        self.ids, self.lens = np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for t in texts for e in self.tokenizer.encode_batch_fast([t], add_special_tokens=False)]

    def _groups(self, pieces: pa.Array) -> dict[str, np.ndarray]:
        """The pieces that can stand in one text without touching, by what joins them: words by a space, pieces after
        a space by nothing more, others between line feeds."""
        if self.split == "word":
            plain = np.flatnonzero(pc.string_is_ascii(pieces).to_numpy(zero_copy_only=False) & (pc.binary_length(pieces).to_numpy() > 0))
            others = np.setdiff1d(np.arange(len(pieces)), plain)
            return {" ": np.concatenate([plain, others[[bool(p) and unicodedata.is_normalized("NFC", p) for p in pieces.take(pa.array(others)).to_pylist()]]])}
        match = lambda pattern: np.flatnonzero(pc.match_substring_regex(pieces, pattern).to_numpy(zero_copy_only=False))
        return {"": match(rf"(?s)\A {_SOLID}(?:.*{_SOLID})?\z"), "\n": match(rf"\A{_SOLID}(?:[^\n]*{_SOLID})?\z")}

    def _encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces one after the other, and the number of each piece's. Pieces that can stand in one
        text without touching are encoded as one text and told apart: those after a space by the tokens that begin with
        one, those between line feeds by these, words by the bytes their ids stand for. What doesn't come out even goes
        one by one."""
        lens, begins = np.full(len(pieces), -1, np.int64), np.zeros(len(pieces), np.int64)
        flat, size = [], 0
        strings = pieces.to_numpy(zero_copy_only=False)
        for joint, group in self._groups(pieces).items():
            for some in (group[k : k + 20_000] for k in range(0, len(group), 20_000)):
                together = strings[some].tolist()
                ids = np.array(self.tokenizer.encode_batch_fast([joint * (joint == "\n") + joint.join(together)], add_special_tokens=False)[0].ids, "<u4")
                if joint == " ":
                    sizes = np.cumsum([len(p.lower().encode()) for p in together])
                    reached = np.cumsum(self.n_bytes[ids])
                    ends = np.searchsorted(reached, sizes) + 1
                    even = len(reached) and reached[-1] == sizes[-1] and (reached[np.minimum(ends, len(reached)) - 1] == sizes).all()
                    first = np.append(0, ends[:-1])
                else:
                    starts = np.flatnonzero(ids == self.feed if joint else self.spaced[ids])
                    even = len(starts) == len(together)
                    first, ends = starts + (joint == "\n"), np.append(starts[1:], len(ids))
                if even:
                    begins[some], lens[some] = first + size, ends - first
                    flat.append(ids)
                    size += len(ids)
        rest = np.flatnonzero(lens < 0).tolist()
        for i, e in zip(rest, self.tokenizer.encode_batch_fast(strings[rest].tolist(), add_special_tokens=False), strict=True):
            flat.append(np.array(e.ids, "<u4"))
            begins[i], lens[i] = size, len(flat[-1])
            size += len(flat[-1])
        return ragged(np.concatenate(flat) if flat else np.zeros(0, "<u4"), begins, lens, np.arange(len(pieces)))

    def _lookup(self, pieces: pa.Array, often: np.ndarray, counts: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, lens): the ids of piece k are ids[begins[k] : begins[k] + lens[k]]; ids are left out for counts.
        often: how many times the batch has each piece. It makes no cycles, so the long lists aren't searched for them."""
        was_on = gc.isenabled()
        gc.disable()
        try:
            strings = pieces.to_numpy(zero_copy_only=False)
            place = np.fromiter(map(self.places.get, strings, repeat(-1)), np.int64, len(pieces))
            missing = np.flatnonzero(place < 0)
            ids, lens = self._encode_pieces(pieces.take(pa.array(missing)))
            place[missing] = len(self.lens) + np.arange(len(missing))
            all_lens = np.concatenate([self.lens, lens])
            ids = ids[:0] if counts else np.concatenate([self.ids, ids])
            begins = np.cumsum(all_lens) - all_lens
            keep = missing
            if len(self.places) + len(missing) > self.most:  # the most frequent ones of this batch
                keep = np.argpartition(-often, min(len(often), self.most // 2) - 1)[: self.most // 2]
                self.places, self.ids, self.lens = {}, ids[:0], all_lens[:0]
            keep = keep[pc.binary_length(pieces).to_numpy()[keep] <= PIECE_BYTES]
            self.places.update(zip(strings[keep].tolist(), range(len(self.lens), len(self.lens) + len(keep)), strict=True))
            if not counts:
                self.ids = np.concatenate([self.ids, ragged(ids, begins, all_lens, place[keep])[0]])
            self.lens = np.concatenate([self.lens, all_lens[place[keep]]])
            return ids, begins[place], all_lens[place]
        finally:
            if was_on:
                gc.enable()

    def pieces(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, dict[int, str]]:
        """Offsets of each text's pieces, the different pieces, the index of each piece in them, and the
        texts that have to be encoded whole, by row."""
        if self.split not in ("word", "space"):
            return np.zeros(len(texts) + 1, np.int64), pa.array([], pa.large_string()), np.zeros(0, np.int32), dict(enumerate(texts.to_pylist()))
        odd = np.flatnonzero((pc.match_substring_regex(texts, _WHOLE) if self.split == "space" else pc.match_substring(texts, "<|")).to_numpy(zero_copy_only=False))
        whole = {int(i): texts[int(i)].as_py() for i in odd}
        if whole:
            texts = pc.if_else(pa.array(~np.isin(np.arange(len(texts)), odd)), texts, "")
        if self.split == "word":
            # ascii_lower() comes second, as it reads slices of arrays wrongly
            texts = pc.ascii_lower(pc.replace_substring_regex(texts, _ENDED + r"(\s|\z)", r"\1 \2\3"))
            lists = pc.ascii_split_whitespace(texts)
        else:
            texts = pc.replace_substring(texts, " ", "\x01 ")
            texts = pc.replace_substring_regex(texts, rf"({_SOLID})\n({_SOLID})", "\\1\x01\n\x01\\2")
            lists = pc.split_pattern(pc.replace_substring_regex(texts, _ENDED + r"(\x01|\z)", "\\1\x01\\2\\3"), "\x01")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        return offsets - offsets[0], coded.dictionary, coded.indices.to_numpy(), whole

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty) one after the other, and the number of each text's ids."""
        offsets, different, index, whole = self.pieces(pc.fill_null(texts.cast(pa.large_string()), ""))
        flat, begins, lens = self._lookup(different, np.bincount(index, minlength=len(different)), False)
        ids, n = ragged(flat, begins, lens, index) if len(index) else (flat[:0], lens[:0])
        ends = np.concatenate([[0], np.cumsum(n)])[offsets]
        sizes = np.diff(ends)
        if whole:
            got = dict(zip(whole, self._whole(list(whole.values())), strict=True))
            ids = np.concatenate([got[i] if i in got else ids[ends[i] : ends[i + 1]] for i in range(len(sizes))])
            sizes[list(got)] = [len(x) for x in got.values()]
        return ids, sizes

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text (null: 0)."""
        offsets, different, index, whole = self.pieces(pc.fill_null(texts.cast(pa.large_string()), ""))
        known = np.fromiter(map(self.frequent.get, different.to_numpy(zero_copy_only=False), repeat(-1)), np.int64, len(different))
        rest = np.flatnonzero(known < 0)
        often = np.bincount(index, minlength=len(different))
        known[rest] = self._lookup(different.take(pa.array(rest)), often[rest], True)[2]
        n = known[index] if len(index) else np.zeros(0, np.int64)
        sizes = np.diff(np.concatenate([[0], np.cumsum(n)])[offsets])
        for i, ids in zip(whole, self._whole(list(whole.values())), strict=True):
            sizes[i] = len(ids)
        return sizes


_ENCODERS: dict[tuple, PieceEncoder] = {}


def encoder(path: str, kind: str = "ids", frequent: dict[str, int] | None = None) -> PieceEncoder:
    """This worker's encoder; one for each file and kind of cached value."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS.clear()  # a worker that another operator used before holds one at a time
        _ENCODERS[path, kind] = PieceEncoder(path)
    enc = _ENCODERS[path, kind]
    enc.frequent = frequent or {}
    return enc
