"""Each operator against a brute-force version on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import io
import random
import time
import wave
from collections import Counter
from itertools import combinations, pairwise

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from headway.llm import audio, html_main, mixing, quality, queries, simhash, suffix_dedup, token_count, url_filter
from headway.llm.components import components
from headway.llm.tokens import tokenizer_path

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdeé") for _ in range(RNG.randint(2, 7))) for _ in range(300)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


LONG, PASSAGE = prose(400), prose(60)
ROWS = [(1, LONG, "b"), (2, LONG, "a"), (3, LONG[:-9] + "zz", "a"), (4, None, None), (5, "", "a"), (6, " \t\n", "c"), (7, "one two", "c"), (8, prose(80) + " " + PASSAGE + " " + prose(50), "a"), (9, PASSAGE + prose(30), "b"), (9, PASSAGE + prose(30), "b"), (None, PASSAGE, "a"), (10, "x" * 400, "d"), (11, "y" + "x" * 300, "d"), (12, "line one here\n" * 40, "b"), (13, "w " * 9000, "a"), (14, "ONE TWO!! " * 60, "b"), *[(20 + i, prose(RNG.randint(1, 120)), "a" if i % 3 else "e") for i in range(60)]]
ROWS.append(ROWS[0])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", 7) for r in ROWS], "doc_id bigint, text string, source string, kept string, n_words int").repartition(3)


def least(ids):
    known = [i for i in ids if i is not None]
    return min(known) if known else None


def simhash_of(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs):
    fps = [simhash_of(t) for _, t, _ in ROWS]
    group = list(range(len(ROWS)))
    for i in range(len(ROWS)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    want = [(str(ROWS[i][0]), f"{fps[i]:016x}", str(least([ROWS[k][0] for k in range(len(ROWS)) if group[k] == group[i]]))) for i in range(len(ROWS))]
    assert sorted((str(r[0]), r[1], str(r[2])) for r in simhash.near_duplicates(docs).collect()) == sorted(want)
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_tiles_find_what_all_pairs_find(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    fps = sorted({int(b) ^ sum(1 << int(k) for k in rng.integers(0, 63, rng.integers(0, 4))) for b in base for _ in range(8)})
    pairs = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4]
    got = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint"), tile=16)
    want = spark.createDataFrame(pairs, "a bigint, b bigint")
    assert sorted(map(tuple, components(got).collect())) == sorted(map(tuple, components(want).collect()))


def gone_bytes(rows, n=50):
    """Of each row: its bytes, and for each whether it goes (and one False more)."""
    first = {}
    data = [(r[0] if r[0] is not None else 1 << 62, (r[1] or "").encode()) for r in rows]
    for i, b in data:
        for p in range(len(b) - n + 1):
            first[b[p : p + n]] = min(i, first.get(b[p : p + n], i))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < i:
                gone[p : p + n] = True
        out.append((b, gone))
    return out


def removed_bytes(rows, n=50):
    """Of each row: what is left between the removed runs, whole characters only."""
    out = []
    for b, gone in gone_bytes(rows, n):
        edges = np.flatnonzero(np.diff(np.concatenate([[1], gone.astype(int)[:-1], [1]]))).tolist()
        out.append([b[a:z].decode("utf-8", "ignore").encode() for a, z in zip(edges[::2], edges[1::2], strict=True)])
    return out


def removed(rows, n=50):
    out = []
    for b, gone in gone_bytes(rows, n):
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])).hexdigest()))
    return out


def test_suffix_dedup(docs):
    got = suffix_dedup.digest(suffix_dedup.dedup(docs.select("doc_id", "text", "source"))).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted((str(r[0]), *w) for r, w in zip(ROWS, removed(ROWS), strict=True))
    assert suffix_dedup.dedup(docs.where("false")).count() == 0
    assert suffix_dedup.dedup_documents(docs).columns == docs.columns


def test_maximal_repeats_have_all_occurrences():
    texts = [b"abcXYZQabc", b"1XYZQ2", b"3XYZ4abc", b"XYZQ"]
    got = suffix_dedup.maximal_repeats(texts, 3)
    where = lambda s: sorted((i, p) for i, t in enumerate(texts) for p in range(len(t)) if t.startswith(s, p))
    assert got == [(s, where(s)) for s in (b"XYZ", b"XYZQ", b"abc")]


def test_few_suffixes_are_sorted_together():
    rng = random.Random(6)
    segments = [bytes(rng.choices(b"abcdefgh", k=80)) for _ in range(4000)]
    segments += [s[:-1] + b"!" for s in segments]  # so that anchors have two segments each
    parts = list(suffix_dedup._by_anchor(segments, suffix_dedup.LEAST, suffix_dedup.GRAM))
    sizes = [sum(len(s) - suffix_dedup.LEAST + 1 for s in part) for part in parts]
    assert max(sizes) <= 1 << 16 and len({s for part in parts for s in part}) >= 6000
    assert all(len(part) > 1 for part in parts)


def test_ledger(docs):
    got = {(str(r["doc_id"]), r["text"]): r for r in quality.ledger(docs).collect()}
    for i, t, _ in ROWS:
        w, lines, r = (t or "").split(), [x for x in (t or "").split("\n") if x.strip(" \t\n\v\f\r")], got[str(i), t]
        n = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {k + d for k in range(len(w) - 2) if n[w[k], w[k + 1], w[k + 2]] > 1 for d in range(3)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(again))
        assert bool(r["fail_bits"] & 3) == (len(w) < 50 or 100 * len(again) > 50 * len(w))
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {1, 2, 3, 8, 9} and not {5, 6, 7, 13, 14} & {r["doc_id"] for r in kept.collect()}
    led = quality.ledger(docs)
    bits = [r["fail_bits"] for r in led.collect()]
    for r in quality.ablation(led).collect():
        m = quality.mask(quality.POLICIES[r["policy"]])
        assert (r["n_docs"], r["n_rejected"], r["n_only"]) == (len(bits), sum(b & m != 0 for b in bits), sum(b & m == quality.mask((r["rule"],)) for b in bits))


def test_mixing(docs):
    got = mixing.mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect())) and len(got) == len(ROWS)
    size = Counter()
    for _, t, s in ROWS:
        size[s] += len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, free = {}, set(order)
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in order if s not in free)
        target = {s: left * weight[s] / max(1, sum(weight[x] for x in free)) if s in free else 3 * size[s] for s in order}
        over = {s for s in free if target[s] > 3 * size[s] + 1e-9}
        if not over:
            break
        free -= over
    largest = Counter()
    for i, s in {(r[0], r[2]) for r in ROWS}:
        largest[s] = max(largest[s], sum(len((t or "").split()) for j, t, z in ROWS if (j, z) == (i, s)))
    taken = Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in order)
    assert mixing.mix(docs.where("false")).count() == 0
    copies = {(r["id"], r["source"]): r["copies"] for r in got}
    out = Counter((r["doc_id"], r["source"]) for r in mixing.mix_documents(docs).collect())
    assert out == +Counter({k: copies[k] * n for k, n in Counter((i, s) for i, t, s in ROWS if (t or "").split()).items()})


def test_urls(spark):
    rows = [(1, "http://a.Example.ORG/en/12?x"), (2, "https://example.org/es/1"), (3, "https://a.com/fr/x#t"), (4, "http://badexample.org/es/"), (5, "http://com/de/1"), (6, None), (7, "nothing"), (8, "http://q.net?a://b/c"), (9, "http://e.org"), (9, "http://e.org")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, host string")
    model = url_filter.train(spark.createDataFrame([(f"http://h{i % 9}.net/{'9' * (i % 7)}", i % 7 > 3) for i in range(400)], "url string, bad boolean"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, model).collect()}
    assert got[1] == ("a.example.org", "/en/12", "example.org/en/1", "block") and got[2][2:] == ("example.org/es/", "block")
    assert got[3] == ("a.com", "/fr/x", "com/fr/", "allow") and got[4][2:] == ("org/", "allow") and got[5][2:] == ("com/de/", "block")
    assert got[6][:3] == got[7][:3] == ("", "", None) and got[8][:3] == ("q.net", "", None) and got[9][:3] == ("e.org", "", None)
    held_out = [(f"http://h{i % 9}.net/{'9' * (i % 7)}", i % 7 > 3) for i in range(500, 700)]
    p = model.predict([u for u, _ in held_out], ["h.net"] * 200, [u.rpartition("/")[2] for u, _ in held_out])
    assert np.mean((p > 0.5) == [y for _, y in held_out]) > 0.95
    assert url_filter.train(spark.createDataFrame([], "url string, bad boolean")).predict(["http://a.b"], ["a.b"], [""]).tolist() == [0.5]


PAGE = '<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Menu {0}</a></li></ul></nav><div class="ad">Buy {0}</div><article><h1>Title {0} &amp; co</h1><p>First  {0}\n text.<br><p><b>Second</b> {0}<p>Read more here</p><div class="comments"><p>Nice {0}</p></div></article><aside>Side</aside><footer>&copy; {0}</footer></body></html>'


def test_main_text(spark):
    rows = [(i, f"https://Host.example/{i}", PAGE.format(f"w{i}")) for i in range(8)] + [(90, None, None), (91, "x", ""), (92, "http://one.example/", "<p>Loose &lt;text&gt;<p>More"), (93, "http://two.example/", PAGE.format("q")), (0, "https://Host.example/0", PAGE.format("w0"))]
    got = html_main.extract(spark.createDataFrame([(*r, "t") for r in rows], "page_id bigint, url string, html string, text string")).collect()
    want = {i: f"Title w{i} & co\n\nFirst w{i} text.\n\nSecond w{i}" for i in range(8)} | {90: "", 91: "", 92: "Loose <text>\n\nMore", 93: "Title q & co\n\nFirst q text.\n\nSecond q\n\nRead more here"}
    assert len(got) == len(rows) and all(r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"]) for r in got)


def test_training_rows_are_the_first_by_hash(spark):
    rows = [(f"http://h{i}.net/{i % 3}", i % 3 == 0) for i in range(400)] * 2 + [(None, True), ("http://x.y", None)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean").repartition(7)
    first = labelled.where("url is not null and bad is not null").orderBy(F.xxhash64("url"), "url", "bad").limit(150).collect()
    seen = [r["url"] for r in first]
    args = ([u for u, _ in rows[:50]], ["h.net"] * 50, ["/1"] * 50)
    want = url_filter.train(spark.createDataFrame(first, "url string, bad boolean"))
    assert len(seen) == 150 and url_filter.train(labelled, most_rows=150).predict(*args).tolist() == want.predict(*args).tolist()


def test_audio(spark):
    rng = np.random.default_rng(2)
    t = np.arange(int(0.4 * audio.RATE)) / audio.RATE
    song = lambda: np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (rng.integers(0, 24) / 12) * t) for _ in range(40)]) * 0.5
    songs = [song() for _ in range(4)]
    shift = 20 * audio.HOP
    rows = [(0, audio.wav(songs[0])), (1, audio.wav(songs[1])), (2, audio.wav(songs[0][shift:] + 0.002 * rng.standard_normal(len(songs[0]) - shift))), (3, audio.wav(songs[2])), (4, audio.wav(songs[0])), (5, None), (None, audio.wav(songs[3])), (6, audio.wav(songs[3][:900]))]
    got = {r["id"]: r for r in audio.search(audio.fingerprint(spark.createDataFrame(rows, "i bigint, a binary"), "i", "a"), "id % 2 = 0").collect()}
    assert set(got) == {0, 2, 4, 6} and got[4]["class_id"] == 0 and got[6]["n_links"] == 0
    assert got[0]["n_links"] == 1 and got[0]["best_match"] == 2 and got[2]["best_match"] == 0 and got[0]["offset"] == -got[2]["offset"] == -20


def test_names_around_the_article_do_not_drop_it():
    kept = lambda page: [b.text for b in html_main.parse(page)[1] if b.node in html_main.main_nodes(html_main.parse(page)[0])]
    page = '<div class="{}"><p>Before</p><article><p>Text</p><div class="related"><p>More</p></div></article></div><p>After</p>'
    assert kept(page.format("no-sidebar")) == kept(page.format("related")) == kept(page.format("x")) == ["Text"]
    assert kept('<article><p>Text</p></article><div class="comments"><article><p>Nice</p></article></div>') == ["Text"]


def test_deep_and_broken_pages_take_time_in_proportion():
    began = time.process_time()
    tree, found = html_main.parse("<div>" * 100_000 + "deep" + "</div>" * 100_000 + "<p>after")
    assert [b.text for b in found] == ["deep", "after"] and len(tree.keys) == 100_002
    assert len(html_main.match(tree, tree)) == len(tree.keys) and html_main.article_slots(tree, {100_000: (4, 0)}, html_main.main_nodes(tree))[0] == {99_999, 100_000}
    for part in ("<a ", '<a b="', '<a b=">" ', "<!", "<![CDATA[", "<p class='", "</", "< ", "<div><p>"):
        html_main.parse(part * 500_000)
        html_main.parse(part * 500_000 + ">")
    assert time.process_time() - began < 120


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8), st.integers(1, 5)), max_size=7, unique_by=(lambda t: t[0], lambda t: t[1])))
def test_chains_are_the_heaviest(pairs):
    rises = lambda part: all(a[0] < b[0] and a[1] < b[1] for a, b in pairwise(sorted(part)))
    best = max((sum(t[2] for t in part) for k in range(len(pairs) + 1) for part in combinations(pairs, k) if rises(part)), default=0)
    got = [pairs[k] for k in html_main.heaviest_order(pairs)]
    assert rises(got) and sum(t[2] for t in got) == best


def tree_of(spec):
    """Nested (key, [children]) to a Tree."""
    keys, parents = [], []

    def walk(node, parent):
        keys.append(node[0])
        parents.append(parent)
        me = len(keys) - 1
        for child in node[1]:
            walk(child, me)

    walk(spec, -1)
    return html_main.Tree(keys, parents)


def matched(a, b):
    """The textbook recursion: size of the largest match."""
    if a[0] != b[0]:
        return 0
    m = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1]):
        for j, y in enumerate(b[1]):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + matched(x, y))
    return m[-1][-1] + 1


@settings(max_examples=80, deadline=None)
@given(*[st.recursive(st.just([]), lambda kids: st.dictionaries(st.sampled_from("abcd"), kids, max_size=4).map(lambda d: list(d.items())), max_leaves=12)] * 2)
def test_matching_is_simple_tree_matching(x, y):
    a, b = ("", x), ("", y)
    to, s, t = html_main.match(tree_of(a), tree_of(b)), tree_of(a), tree_of(b)
    assert len(to) == matched(a, b) and all(s.keys[n] == t.keys[m] and (n == 0 or to[s.parents[n]] == t.parents[m]) for n, m in to.items())


LAYOUTS = {
    "named": "<header><h1>Site {0}</h1></header><div class='entry'><h1>Head {0}</h1><p>{1}</p><p>{2} link</p><div class=comments><p>I think {0}</p></div></div><aside><p>Also {0}</p></aside>",
    "plain": "<div><div><a href=/>Home {0}</a> <a href=/a>About {0}</a></div><div><h1>Head {0}</h1><p>{1}</p><p>{2} <a href=x>link</a></p><p>Constant words here</p></div><div>Seen by {0}</div></div>",
    "table": "<table><tr><td><ul><li><a href=/>Item {0}</a></li><li><a href=/b>Other {0}</a></li></ul></td><td><div><h1>Head {0}</h1><div>{1}</div><div>{2} link</div></div></td></tr></table><div>Constant words here</div>",
}


@pytest.mark.parametrize("hints", [True, False])
def test_layouts(spark, hints):
    rows, want = [], {}
    for k, (name, page) in enumerate(LAYOUTS.items()):
        for i in range(7):
            a, b = prose(30), prose(50)
            rows.append((100 * k + i, f"http://{name}.example/{i}", page.format(f"q{i}", a, b)))
            want[100 * k + i] = "\n\n".join([f"Head q{i}", a, b + " link"])
    got = {r["page_id"]: r["text"] for r in html_main.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string"), hints=hints).collect()}
    # without names, reader comments and site names are text like other
    assert {k: got[k] for k in want if hints or k >= 100} == {k: w for k, w in want.items() if hints or k >= 100}
    assert all(want[k] in got[k] for k in want)


def test_main_text_defined_cases(spark):
    schema = "page bigint, row string, url string, html string, blocks int, mains string"
    rows = [(1, "r", None, "<div>" * 3000 + "deep", 1, "m"), (1, "r", None, "<div>" * 3000 + "deep", 1, "m"), (2, None, "no url", "<p>" + "long words " * 40_000, None, None), (3, "x", "http://h/", "<p></p>", 2, "")]
    got = html_main.extract(spark.createDataFrame(rows, schema))
    assert got.columns == ["page", "row", "url", "blocks", "mains", "text", "n_chars"]
    assert sorted((r["page"], r["n_chars"]) for r in got.collect()) == [(1, 4), (1, 4), (2, 440_000 - 1), (3, 0)]
    assert html_main.extract(spark.createDataFrame([], schema)).count() == 0


def all_offsets(prints):
    """Brute force: (query, other) to the smallest (bit error, offset) over all offsets, of recordings with different codes."""
    out = {}
    for i, x in prints.items():
        for j, y in prints.items():
            if i % 20 == 0 and i != j and x.tolist() != y.tolist():
                for d in range(-len(x) + 1, len(y)):
                    a, b = x[max(0, -d) :], y[max(0, d) :]
                    m = min(len(a), len(b))
                    if m >= audio.LEAST_OVERLAP:
                        error = float(np.bitwise_count(a[:m] ^ b[:m]).sum()) / (32 * m)
                        if error <= audio.BIT_ERROR:
                            out[i, j] = min((error, d), out.get((i, j), (2.0, 0)))
    return out


def test_audio_finds_what_all_offsets_find(spark):
    rng = np.random.default_rng(8)
    vectors = spark.createDataFrame([(i, rng.standard_normal(64).tolist()) for i in range(160)], "vec_id bigint, embedding array<double>")
    recordings = queries.sonify(vectors, "vec_id", "embedding")
    want = all_offsets({r["id"]: audio.codes(audio.pcm(r["audio"])) for r in recordings.collect()})
    got = {r["id"]: r for r in audio.search(audio.fingerprint(recordings, "id", "audio"), "id % 20 = 0").collect()}
    assert len(got) == 8 and len(want) >= 8 and {i for i, _ in want} == set(got)
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * len(want)
    for i, r in got.items():
        error, offset, other = min((e, d, j) for (q, j), (e, d) in want.items() if q == i)
        assert (r["best_match"], r["offset"]) == (other, offset) == (i + 3, r["offset"]) and abs(r["bit_error"] - error) < 1e-9


@pytest.mark.parametrize("most", [1, 40, 1000, 1 << 20])
def test_blocks_of_codes_find_what_all_offsets_find(spark, most):
    rng = np.random.default_rng(most)
    prints = [rng.choice([0, 0, 1, 3, 2**31 + 1, 2**32 - 1], rng.integers(1, 60)).astype(np.uint32) for _ in range(24)]
    prints += [np.concatenate([rng.integers(0, 2**32, 5, dtype=np.uint32), p[3:]]) for p in prints[:8] if len(p) > 3] + [np.zeros(90, np.uint32), np.zeros(120, np.uint32)]
    want = {}
    for i, x in enumerate(prints[:12] + prints[-2:]):
        for j, y in enumerate(prints):
            for d in range(-len(x) + 1, len(y)):
                a, b = x[max(0, -d) :], y[max(0, d) :]
                m = min(len(a), len(b))
                if m >= 16 and (a[:m] == b[:m]).sum() >= 3 and (error := float(np.bitwise_count(a[:m] ^ b[:m]).sum()) / (32 * m)) <= 0.3:
                    want[i, j] = min((error, d), want.get((i, j), (2.0, 0)))
    parts = list(audio.aligned(prints[:12] + prints[-2:], prints, 0.3, 3, 16, most))
    got = [(q, o, error, d) for part in parts for q, o, d, error in zip(*(v.tolist() for v in part), strict=True)]
    assert len(want) > 30 and sorted(got) == sorted((i, j, *v) for (i, j), v in want.items())


def test_equal_codes_of_recordings_make_no_rows(spark):
    classes = spark.createDataFrame([(i, [7] * 3 + [i * 100 + k for k in range(8, 40)], i % 20 == 0) for i in range(200)], "class_id bigint, codes array<bigint>, asked boolean")
    found = audio.links(classes, 0.01, 3, 16)
    assert found.count() == 0 and "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_sound_is_made_where_it_is_heard(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(10)
    rows = [(i, rng.standard_normal(64).tolist()) for i in range(60)] + [(20, None), (None, rng.standard_normal(64).tolist()), (60, []), (61, [0.5, None]), (3, rng.standard_normal(200).tolist())]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    vectors.write.parquet(f"{tmp_path}/embeddings.parquet")
    keep, plans = audio.materialize, {}
    monkeypatch.setattr(audio, "materialize", lambda df, what: plans.setdefault(what, df) and keep(df, what))
    got = queries.op2_audio(spark, str(tmp_path)).collect()
    want = keep(audio.fingerprint(queries.sonify(vectors, "vec_id", "embedding"), "id", "audio"), "prints")
    assert sorted(map(str, plans["prints"].collect())) == sorted(map(str, want.collect())) and plans["prints"].count() == len(rows)
    assert sorted(str((r["vec_id"], r["class_id"], r["n_links"], r["best_match"], r["offset"])) for r in got) == sorted(str((r["id"], r["class_id"], r["n_links"], r["best_match"], r["offset"])) for r in audio.search(want, "id % 20 = 0").collect())
    plan = plans["prints"]._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "audio#" not in plan


def test_audio_defined_cases(spark):
    rng = np.random.default_rng(9)
    sound = rng.standard_normal(60_000) * 0.2

    def file(width, channels=1, rate=audio.RATE):
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(width)
            w.setframerate(rate)
            x = np.repeat((np.clip(sound, -1, 1) * (2 ** (8 * width - 1) - 1)).astype(np.int64), channels) + (128 if width == 1 else 0)
            w.writeframes(b"".join(int(v).to_bytes(width, "little", signed=width > 1) for v in x))
        return out.getvalue()

    for width in (1, 2, 3, 4):
        assert np.abs(audio.pcm(file(width, 2)) - np.clip(sound, -1, 1)).max() < 0.02
    assert abs(len(audio.pcm(file(2, 1, 2 * audio.RATE))) - 30_000) <= 1 and audio.pcm(b"no wave") is None and audio.pcm(b"") is None and audio.pcm(file(2)[:30]) is None
    rows = [(0, file(2)), (0, file(2)), (20, b"RIFF broken"), (40, None), (None, file(2)), (1, audio.wav(np.tile(sound, 20))), (2, file(4))]
    prints = audio.fingerprint(spark.createDataFrame([(*r, 1) for r in rows], "id bigint, audio binary, codes int"), "id", "audio")
    got = sorted(audio.search(prints, "id % 20 = 0").collect(), key=lambda r: r["id"])
    assert [(r["id"], r["class_id"]) for r in got] == [(0, 0), (0, 0), (20, 20), (40, 40)] and got[0]["best_match"] == got[1]["best_match"] and got[0]["n_links"] == 2 - (prints.where("id in (0, 2)").select("codes").distinct().count() == 1)
    assert got[2]["n_links"] == got[3]["n_links"] == 0 and audio.search(prints.where("false"), "id % 20 = 0").count() == 0


#: Names that the operators use inside.
OWN = "id row key n t w h d k text_ n_ b at a of p band source_ own_id own_source fp root best kept rows bits page shape tree blocks host_ url_ rule_ __text __id __n __t __w __h __d __g __key __doc __url __rule __verdict __row size copies unit stratum wish".split()


def test_names_inside_clash_with_none(spark, docs):
    """Every operator that hands columns on keeps those with its own inner names."""
    rows = [(7, prose(60), "a"), (7, prose(90), "a"), (8, None, None), (8, prose(60), None)]
    wide = spark.createDataFrame([(*r, *range(len(OWN))) for r in rows], ["doc_id", "text", "source", *OWN])
    ids = sorted(r[0] for r in rows)
    counted = token_count.count_tokens(wide, tokenizer_path("word_bpe_49k.json"), out_col="tokens")
    assert counted.columns == [*wide.columns, "tokens"] and sorted(r["doc_id"] for r in counted.collect()) == ids
    led = quality.ledger(wide)
    assert set(OWN) <= set(led.columns) and sorted(r["doc_id"] for r in led.collect()) == ids
    for out in (quality.filter_quality(wide), simhash.keep_first(wide), mixing.mix_documents(wide), suffix_dedup.dedup_documents(wide)):
        assert out.columns == wide.columns
        found = out.collect()
        assert {r["doc_id"] for r in found} == {7, 8} and all([r[c] for c in OWN] == list(range(len(OWN))) for r in found)
    assert len(simhash.keep_first(wide).collect()) == 4  # equal ids with different texts all stay
    assert simhash.near_duplicates(wide).count() == 4 and mixing.mix(wide).count() == 4
    judged = url_filter.judge(wide.withColumn("url", F.lit("http://a.org/b")), url_filter.train(spark.createDataFrame([], "url string, bad boolean")))
    assert set(wide.columns) <= set(judged.columns) and [tuple(r[c] for c in OWN) for r in judged.collect()] == [tuple(range(len(OWN)))] * 4
    pages = html_main.extract(wide.withColumn("url", F.lit("http://a.org/b")).withColumn("html", F.lit("<p>x</p>")))
    assert set(OWN) <= set(pages.columns) and pages.count() == 4


def judged_by_hand(url):
    """(host, path, rule, verdict or None), from the definition."""
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url[url.index("://") + 3 :]
        end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h + p), v == "block", h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[2:]) if fits else (host, path, None, None)


def test_rules_by_hand(spark):
    rng = random.Random(3)
    hosts, paths = ["org", "Example.ORG", "a.example.org", "xorg", "com", "b.C.com", "example.org.net", "", "ÉÀ.org", "com."], ["", "/", "/es/", "/es", "/en/1", "/en/12", "/fr/", "/de/x", "/de", "?a=/es/", "#/de/", "/es/?x#y", "//es/", "/ES/"]
    urls = ["".join(rng.choice(part) for part in (("http://", "https://", "://", "x", "http:/"), hosts, (":80", "", "@u", "://"), paths)) for _ in range(600)]
    urls += [None, "", "://", "http://" + "a" * 50_000 + ".com/fr/" + "9" * 50_000, *urls[:5]]
    model = url_filter.train(spark.createDataFrame([], "url string, bad boolean"))
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), model).orderBy("page_id").collect()
    for r, url in zip(got, urls, strict=True):
        host, path, rule, verdict = judged_by_hand(url)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow"), url
    assert url_filter.judge(spark.createDataFrame([], "page_id int, url string"), model).count() == 0


def test_training_features_hold_no_own_label():
    urls = [f"http://h{i}.net/x" for i in range(300)]
    hosts, y = [f"h{i}.net" for i in range(300)], np.arange(300) % 2 * 1.0
    x = url_filter.out_of_fold(urls, hosts, ["/x"] * 300, y)
    assert (x[:, url_filter.FEATURES.index("domain_count")] == 0).all()  # each host stands once, so the other folds don't know it
    assert len(np.unique(x[:, url_filter.FEATURES.index("domain_rate")])) <= url_filter.FOLDS
