"""The corpus pipeline against a brute-force version of its stages, and the defined cases of passage removal."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from test_operators import removed_bytes, simhash_of
from tokenizers import Tokenizer

import corpus_pipeline
from headway.llm import suffix_dedup
from headway.llm.tokens import tokenizer_path

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdeghilmnorstué") for _ in range(RNG.randint(2, 9))) for _ in range(500)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


LONG, PASSAGE = prose(500), prose(60)
TEXTS = [LONG, LONG, LONG + " end", prose(9000), None, "", " \n", "few words", "again and again and again " * 40, PASSAGE + " " + prose(100), prose(70) + " " + PASSAGE + " " + prose(70), "@ # $ " * 60, "shout " + prose(60).upper(), "\n".join([prose(8)] * 30)]
TEXTS += [prose(RNG.randint(60, 400)) for _ in range(80)]
ROWS = [(i, t, "en", ("a", "b", None, "d")[0 if i % 3 else i % 4], len(t or "")) for i, t in enumerate(TEXTS)]
ROWS += [ROWS[20], (None, prose(90), "en", "b", 1)]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def good(text):
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text or ""), [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    again = {k + d for k in range(len(words) - 2) if triples[words[k], words[k + 1], words[k + 2]] > 1 for d in range(3)}
    n, chars, count = len(words), sum(map(len, words)), lambda kind: len(re.findall(kind, text or ""))
    return not (n < 50 or 2 * len(again) > n or 10 * count(r"[#*$%&|<>]") > n or not 3 * n <= chars <= 12 * n or 10 * (len(lines) - len(set(lines))) > 3 * len(lines) or 2 * count("[A-Z]") > chars or 5 * count("[!?]") > n)


def firsts(rows):
    fps, group = [simhash_of(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min((r[0] for r, x in zip(rows, group, strict=True) if x == g and r[0] is not None), default=None) for g in group}
    return list({r for r, g in zip(rows, group, strict=True) if r[0] is None or r[0] == least[g]})


def without_repeats(rows):
    return [(r[0], b"".join(part for part in parts).decode(), r[3]) for r, parts in zip(rows, removed_bytes(rows), strict=True)]


def targets(size):
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, free = {s: 1 + k % 3 for k, s in enumerate(order)}, set(order)
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in order if s not in free)
        out = {s: left * weight[s] / max(1, sum(weight[x] for x in free)) if s in free else 3 * size[s] for s in order}
        over = {s for s in free if out[s] > 3 * size[s] + 1e-9}
        if not over:
            return out
        free -= over


def test_pipeline(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = without_repeats(firsts([r for r in ROWS if good(r[1])]))
    assert 60 < len(docs) < len(ROWS)
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    size, largest, taken, pieces, of = Counter(), Counter(), Counter(), {}, {}
    for i, text, source in docs:
        n = len(text.split())
        size[source] += n
        largest[source] = max(largest[source], n)
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        pieces[i] = Counter((k, 4096 * k, len(x), zlib.crc32(x.tobytes())) for k, x in enumerate(np.split(ids, range(4096, len(ids), 4096))))
        of[i] = source, n
    target, found, places = targets(size), defaultdict(Counter), defaultdict(list)
    for r in got:
        found[r["doc_id"]][r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, (source, n) in of.items():
        copies = found[i][next(iter(pieces[i]))]
        wish = target[source] / size[source]
        assert int(wish + 1e-9) <= copies <= -int(-wish - 1e-9) + 1 and copies <= 3
        assert found[i] == Counter({k: copies for k in pieces[i] if copies})
        taken[source] += copies * n
    assert set(found) <= set(of) and any(len(p) > 1 for p in pieces.values())
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in size)
    for spans in places.values():
        ends = [0, *np.cumsum([n for _, n in sorted(spans)]).tolist()]
        assert [a for a, _ in sorted(spans)] == ends[:-1] and ends[-1] <= 4096


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_cut_characters_go_and_others_stay(spark):
    rows = [(1, "x" + "é" * 40), (2, "� keep �" + "ab" * 30), (3, "ê" + "é" * 25 + "ë")]
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.dedup_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] == rows[0][1] and got[2] == rows[1][1]
    shared = rows[0][1].encode()
    own = rows[2][1].encode()
    gone = {p + d for p in range(len(own) - 49) if own[p : p + 50] in shared for d in range(50)}
    assert got[3] == "".join(c for k, c in enumerate(rows[2][1]) if not {2 * k, 2 * k + 1} & gone) and gone


def word_shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def edited(text, n):
    words = text.split()
    for k in RNG.sample(range(len(words)), n):
        words[k] = RNG.choice(WORDS)
    return " ".join(words)


def test_near_dedup_is_jaccard_by_brute_force(spark, tmp_path):
    texts = [prose(RNG.randint(5, 300)) for _ in range(60)]
    texts += [edited(t, RNG.randint(1, max(1, len(t.split()) // 40))) for t in texts for _ in range(4)] + [prose(40) + " " + PASSAGE for _ in range(20)] + ["a b c", "A b  c", "a b d", ""]
    order = RNG.sample(range(len(texts)), len(texts))
    sets, group, near = [word_shingles(t) for t in texts], list(range(len(texts))), 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                near += a != b and (simhash_of(texts[i]) ^ simhash_of(texts[j])).bit_count() > 4
                group = [group[j] if g == group[i] else g for g in group]
    want = {min(order[i] for i, x in enumerate(group) if x == g) for g in group}
    docs = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in zip(order, texts, strict=True)], SCHEMA).repartition(5)
    assert near > 20 and {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()} == want


def test_near_dedup_chooses_rows_not_ids(spark, tmp_path):
    a, b, c = prose(80), prose(80), prose(80)
    rows = [(1, a), (2, b), (2, a + " end"), (3, b + " end"), (None, c), (None, c), (None, b), (9, prose(70)), (9, prose(90))]
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], SCHEMA).repartition(4)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([rows[0], rows[1], rows[4], rows[7], rows[8]], key=str)
