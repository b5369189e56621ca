"""Main text of pages by wrapper induction.

Each page is parsed once to its blocks of text and its skeleton, the tree of block elements with equal siblings
merged. A host's most frequent skeleton is its reference; every other skeleton of the host is aligned to it by simple
tree matching, so the blocks of all its pages fall into the reference's slots. What is constant in a slot over
the host's pages is template. Of the slots that vary, the article's are found by what the host's pages hold in them:
the element that holds most of the varying text outside links, without the slots in it that are mostly links. Names of
elements and classes are a hint only: text under one that speaks of menus, adverts or comments weighs HINT of its length.

Counts go over all pages of a host but are made of rows (host, slot, text, page), so a hot host is many
groups, and wrappers are joined to pages as a small table.
"""

from __future__ import annotations

import bisect
import html
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.common import materialize, text_slices, tidy

BLOCK_TAGS = frozenset("address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template iframe svg math object audio video textarea noembed noframes xmp".split())
#: Elements whose text is hardly the article's.
DROP_TAGS = frozenset("head title nav footer aside form menu dialog select option button fieldset legend".split())
#: Words of class, id and role names of parts around an article.
DROP_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside complementary footer contentinfo masthead comment comments disqus reply replies respond share sharing social newsletter subscribe subscription signup login search related recommended widget toolbar pagination pager skip".split()
)
#: Which open element a start tag ends.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_NAME = re.compile(r"/?[A-Za-z][^\s/>]*")
#: Up to a tag's end. Quotes hold a > only behind an =; nothing is tried twice.
_ATTRIBUTES = re.compile(r"(?>[^>\"'=]+|=\s*(?:\"[^\"]*\"|'[^']*')|[\"'=])*+>")
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: A text is template if it is in the slot on n of the host's different pages and n / (pages + 1) is so much.
SHARE = 0.75
#: What text weighs that names place outside the article; a region goes on into an element with so much of its weight; a slot
#: with more of its text in links is no article's.
HINT, MOST, LINKS = 0.25, 0.5, 0.5


class Tree(NamedTuple):
    """Nodes 0 (the root), 1, ... in order of entry, so a parent comes before its children: each one's key, an
    element's tag and, after dots, its class names, and its parent (-1 of the root)."""

    keys: list[str]
    parents: list[int]

    def children(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self.keys]
        for n, p in enumerate(self.parents[1:], 1):
            out[p].append(n)
        return out


class Block(NamedTuple):
    node: int
    text: str
    linked: int


def parse(page: str) -> tuple[Tree, list[Block]]:
    """The tree of the block elements that hold text, equal siblings as one, and the blocks in page order: node, text (white
    space is one space, references are decoded), and how many characters of it stand in links. Takes time and memory in
    proportion to the page, however deep or broken."""
    keys, parents, index = [""], [-1], {}
    out: list[Block] = []
    stack: list[tuple[str, int]] = []  # (tag, node)
    places: dict[str, list[int]] = {}  # of each tag, where in the stack it is
    held: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked, in_link
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append(Block(stack[-1][1] if stack else 0, text, min(linked, len(text))))
        linked, in_link = 0, False

    def hold(text: str) -> None:
        nonlocal linked
        held.append(text)
        linked += len(text) * in_link

    def close_to(n: int) -> None:
        while len(stack) > n:
            places[stack.pop()[0]].pop()

    at, end, last = 0, len(page), page.rfind(">")
    quoted, cdata = True, True
    while (lt := page.find("<", at)) >= 0:
        if lt > at:
            hold(page[at:lt])
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            at = close + 3 if close >= 0 else end
            continue
        if cdata and page.startswith("<![CDATA[", lt):
            close = page.find("]]>", lt)
            cdata = close >= 0
            if cdata:
                hold(html.escape(page[lt + 9 : close], quote=False))
                at = close + 3
                continue
        name = _NAME.match(page, lt + 1)
        if lt > last or not name and page[lt + 1 : lt + 2] not in ("!", "?"):
            hold("<")
            at = lt + 1
            continue
        if not name:
            at = page.find(">", lt) + 1
            continue
        m = _ATTRIBUTES.match(page, name.end()) if quoted else None
        quoted = m is not None  # once quotes hold all the > that are left, they are characters like others
        at = m.end() if m else page.find(">", lt) + 1
        attributes = page[name.end() : at - 1]
        tag = name[0].lower()
        if tag[0] == "/":
            tag = tag[1:]
            if tag in BLOCK_TAGS:
                flush()
                if places.get(tag):
                    close_to(places[tag][-1])
            elif tag == "a":
                in_link = False
            continue
        if tag in RAW_TAGS and not attributes.rstrip().endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            hold(" ")
            continue
        if tag in ("br", "img"):
            hold(" ")
        if tag == "a":
            in_link = True
        if tag not in BLOCK_TAGS:
            continue
        flush()
        if tag in VOID_TAGS:
            continue
        if places.get("p"):  # a block ends a paragraph
            close_to(places["p"][-1])
        while tag in CLOSES and stack and stack[-1][0] in CLOSES[tag]:
            close_to(len(stack) - 1)
        names = sorted({w.lower() for x in _NAMES.findall(attributes) for w in re.split(r"[^A-Za-z]+", "".join(x)) if w}) if attributes else []
        parent, key = stack[-1][1] if stack else 0, ".".join([tag, *names])
        node = index.setdefault((parent, key), len(keys))
        if node == len(keys):
            keys.append(key)
            parents.append(parent)
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, node))
    hold(page[at:])
    flush()
    return _with_text(Tree(keys, parents), out)


def _with_text(tree: Tree, blocks: list[Block]) -> tuple[Tree, list[Block]]:
    """Only the nodes that have a block below them."""
    used = [False] * len(tree.keys)
    used[0] = True
    for b in blocks:
        n = b.node
        while not used[n]:
            used[n] = True
            n = tree.parents[n]
    kept = [n for n, u in enumerate(used) if u]
    new = dict(zip(kept, range(len(kept)), strict=True))
    return Tree([tree.keys[n] for n in kept], [new.get(tree.parents[n], -1) for n in kept]), [b._replace(node=new[b.node]) for b in blocks]


def heaviest_order(pairs: list[tuple[int, int, int]]) -> list[int]:
    """pairs: (place, other place, weight). Which of them to take, so that the places rise on both sides and the weights
    sum to the most. A list of the best sums by other place, each entry better than those before it."""
    order = sorted(range(len(pairs)), key=lambda k: pairs[k][0])
    places, sums, last = [], [], []  # rising both
    before = [-1] * len(pairs)
    for k in order:
        _, y, w = pairs[k]
        at = bisect.bisect_left(places, y)
        total = w + (sums[at - 1] if at else 0)
        before[k] = last[at - 1] if at else -1
        end = at
        while end < len(places) and sums[end] <= total:
            end += 1
        if end > at or at == len(places) or places[at] != y:
            places[at:end], sums[at:end], last[at:end] = [y], [total], [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def match(a: Tree, b: Tree) -> dict[int, int]:
    """Simple tree matching: the most pairs of equal elements that keep order and parenthood, as nodes of a to nodes of b.
    As equal siblings are one, a child has at most one equal among the other's children, so of these pairs the
    heaviest chain is taken; no recursion, and no more than n log n steps."""
    x, y = a.children(), b.children()
    pairs, under = [(0, 0)], [[]]
    for k, (p, q) in enumerate(pairs):  # grows as it goes
        own = {b.keys[c]: (i, c) for i, c in enumerate(y[q])}
        for i, c in enumerate(x[p]):
            if a.keys[c] in own:
                j, d = own[a.keys[c]]
                under[k].append((i, j, len(pairs)))
                pairs.append((c, d))
                under.append([])
    size, chosen = [1] * len(pairs), [[]] * len(pairs)
    for k in range(len(pairs) - 1, -1, -1):
        chain = heaviest_order([(i, j, size[c]) for i, j, c in under[k]])
        chosen[k] = [under[k][t][2] for t in chain]
        size[k] += sum(size[c] for c in chosen[k])
    out, todo = {}, [0]
    while todo:
        k = todo.pop()
        out[pairs[k][0]] = pairs[k][1]
        todo += chosen[k]
    return out


def main_nodes(tree: Tree) -> set[int]:
    """What names say: nodes whose blocks may be the article's, inside article or main, if the tree has one, and not
    under an element or name that says otherwise. If such names drop every article and main, those of the elements
    around them don't count."""
    tags = [k.split(".") for k in tree.keys]
    holds = [False] * len(tags)
    for n in range(len(tags) - 1, 0, -1):
        if holds[n] or tags[n][0] in ("article", "main"):
            holds[tree.parents[n]] = True
    for lenient in (False, True):
        dropped, article = [False] * len(tags), [False] * len(tags)
        for n, (tag, *names) in enumerate(tags):
            p = max(0, tree.parents[n])
            named = tag not in ("html", "body") and bool(DROP_NAMES.intersection(names)) and not (lenient and not article[p] and holds[n])
            dropped[n] = dropped[p] or tag in DROP_TAGS or (tag == "header" and not article[p]) or named
            article[n] = article[p] or tag in ("article", "main")
        inside = {n for n in range(len(tags)) if article[n] and not dropped[n]}
        if not lenient:
            anywhere = {n for n in range(len(tags)) if not dropped[n]}
        if inside or not holds[0]:
            break
    return inside or anywhere


def article_slots(tree: Tree, texts: dict[int, tuple[int, int]], hinted: set[int]) -> tuple[set[int], set[int]]:
    """texts: of each slot, the characters that vary over the host's pages and those of them in links. (slots of the
    article, nodes of its region). The region is the lowest element with elements in it that holds most of the text
    outside links, going down from the root; what names place outside weighs HINT, and is left out of a region
    unless it is most of it. A heading before a region without one belongs to it."""
    n = len(tree.keys)
    plain, weight = [0.0] * n, [0.0] * n
    for k in range(n):
        chars, linked = texts.get(k, (0, 0))
        plain[k] = float(chars - linked)
        weight[k] = plain[k] * (1.0 if k in hinted else HINT)
    for k in range(n - 1, 0, -1):
        plain[tree.parents[k]] += plain[k]
        weight[tree.parents[k]] += weight[k]
    below = tree.children()
    at = 0
    while best := max((c for c in below[at] if below[c]), key=lambda c: (weight[c], -c), default=0):
        if weight[best] < MOST * weight[at] or not weight[at]:
            break
        at = best
    region: set[int] = set()
    todo = [at]
    while todo:
        k = todo.pop()
        region.add(k)
        todo += [c for c in below[k] if c in hinted or at not in hinted or plain[c] > MOST * plain[at] > 0]
    mostly = lambda k: texts.get(k, (0, 0))[1] > LINKS * texts.get(k, (0, 0))[0]
    main = {k for k in region if not mostly(k)}
    heading = lambda k: tree.keys[k].split(".")[0] == "h1"
    if not any(map(heading, region)) and at:
        main |= {k for k in below[tree.parents[at]] if heading(k) and k < at and k in hinted}
    return main, region


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", share: float = SHARE, hints: bool = True) -> DataFrame:
    """pages without html_col, with text (empty if there is none) and n_chars (bigint, code points).

    Null html is an empty page. Pages of one host (null or odd URLs: an empty host) share a wrapper; equal
    pages count once. Of a host with few pages little is constant, and the statistics are those of its few pages. A page that
    has nothing of its host's article is judged by names alone. Long, deep and broken pages are parsed whole, in proportion to
    their length. Of equally frequent skeletons the larger string is the reference. Repeated rows give equal texts; an
    empty table stays empty. Columns named text or n_chars are replaced; others stay, whatever their names. hints:
    whether names of elements and classes count."""
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")), r"://([^/?#]*)", 1))
    fields = [F.col(f"`{c}`") for c in kept] or [F.lit(0).alias("none")]
    rows = pages.select(F.struct(*fields).alias("row"), host.alias("host"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    schema = rows.select("row", "host").withColumns({"page": F.lit(0).cast("bigint"), "shape": F.lit(0).cast("bigint"), "tree": F.lit(""), "blocks": F.expr("cast(array() as array<struct<node:int,text:string,linked:int>>)")}).schema
    kind = pa.list_(pa.struct([("node", pa.int32()), ("text", pa.string()), ("linked", pa.int32())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in text_slices(batches, "html"):
            page, trees, found = [], [], []
            for text in batch.column("html").to_pylist():
                tree, parts = parse(text)
                page.append(xxhash.xxh64_intdigest(text) - (1 << 63))
                trees.append(json.dumps(tree, separators=(",", ":")))
                found.append([p._asdict() for p in parts])
            shape = [xxhash.xxh64_intdigest(t) - (1 << 63) for t in trees]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("host"), pa.array(page, pa.int64()), pa.array(shape, pa.int64()), pa.array(trees, pa.string()), pa.array(found, kind)], ["row", "host", "page", "shape", "tree", "blocks"])

    parsed = materialize(rows.mapInArrow(lambda batches: tidy(each(batches)), schema), "blocks")
    shapes = parsed.groupBy("host", "shape").agg(F.first("tree").alias("tree"), F.count(F.lit(1)).alias("n"))
    reference = shapes.groupBy("host").agg(F.max_by("tree", F.struct("n", "tree")).alias("reference"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = []
            for tree, ref in zip(batch.column("tree").to_pylist(), batch.column("reference").to_pylist(), strict=True):
                tree = Tree(*json.loads(tree))
                to = match(tree, Tree(*json.loads(ref)))
                # a node that nothing in the reference matches is a slot of its own
                slots.append([to.get(n, -1 - n) for n in range(len(tree.keys))])
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("shape"), batch.column("tree"), pa.array(slots, pa.list_(pa.int32()))], ["host", "shape", "tree", "slots"])

    aligned = materialize(shapes.join(reference, "host").mapInArrow(lambda batches: tidy(align(batches)), "host string, shape bigint, tree string, slots array<int>"), "aligned")
    block = F.transform("blocks", lambda b: F.struct(F.get(F.col("slots"), b["node"]).alias("slot"), F.xxhash64(b["text"]).alias("text"), F.char_length(b["text"]).alias("chars"), b["linked"].alias("linked")))
    seen = parsed.select("host", "page", "shape", "blocks").join(aligned.select("host", "shape", "slots"), ["host", "shape"]).select("host", "page", F.explode(block).alias("b"))
    often = seen.select("host", "page", "b.*").distinct().groupBy("host", "slot", "text").agg(F.count(F.lit(1)).alias("n"), F.max("chars").alias("chars"), F.max("linked").alias("linked"))
    n_pages = parsed.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    judged = often.join(n_pages, "host").withColumn("constant", F.col("n") >= F.lit(share) * (F.col("pages") + 1))
    judged = materialize(judged.groupBy("host", "slot").agg(F.sum(F.when(F.col("constant"), 0).otherwise(F.col("n") * F.col("chars"))).alias("chars"), F.sum(F.when(F.col("constant"), 0).otherwise(F.col("n") * F.col("linked"))).alias("linked"), F.collect_list(F.when(F.col("constant"), F.col("text"))).alias("constant")), "slots")
    # a host's slots are at most its reference's nodes; texts constant in a slot at most 1 / share
    texts = judged.where("slot >= 0").groupBy("host").agg(F.collect_list(F.struct("slot", "chars", "linked")).alias("texts"))
    template = judged.where("size(constant) > 0").groupBy("host").agg(F.collect_list(F.struct("slot", "constant")).alias("constants"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            main, region = [], []
            for ref, held in zip(batch.column("reference").to_pylist(), batch.column("texts").to_pylist(), strict=True):
                tree = Tree(*json.loads(ref))
                hinted = main_nodes(tree) if hints else set(range(len(tree.keys)))
                a, b = article_slots(tree, {x["slot"]: (x["chars"], x["linked"]) for x in held or []}, hinted)
                main.append(sorted(a))
                region.append(sorted(b))
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(main, pa.list_(pa.int32())), pa.array(region, pa.list_(pa.int32()))], ["host", "main", "region"])

    chosen = reference.join(texts, "host", "left").mapInArrow(choose, "host string, main array<int>, region array<int>")

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tree, slots, main, region in zip(*(batch.column(c).to_pylist() for c in ("tree", "slots", "main", "region")), strict=True):
                tree, main, region = Tree(*json.loads(tree)), set(main), set(region)
                hinted = main_nodes(tree) if hints else set(range(len(tree.keys)))
                inside, takes = [False] * len(slots), [False] * len(slots)
                for n, slot in enumerate(slots):
                    p = tree.parents[n]
                    inside[n] = slot in region if slot >= 0 else p >= 0 and inside[p] and n in hinted
                    takes[n] = slot in main if slot >= 0 else inside[n]
                out.append(takes if any(takes) else [n in hinted for n in range(len(slots))])
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("shape"), batch.column("slots"), pa.array(out, pa.list_(pa.bool_()))], ["host", "shape", "slots", "mains"])

    wrapped = aligned.join(chosen, "host").mapInArrow(lambda batches: tidy(wrap(batches)), "host string, shape bigint, slots array<int>, mains array<boolean>")
    wrappers = materialize(wrapped.join(template, "host", "left").select("host", "shape", "slots", "mains", F.map_from_entries(F.coalesce("constants", F.expr("cast(array() as array<struct<slot:int,constant:array<bigint>>>)"))).alias("template")), "wrappers")
    constant = lambda b: F.coalesce(F.array_contains(F.col("template")[F.get(F.col("slots"), b["node"])], F.xxhash64(b["text"])), F.lit(False))
    text = F.array_join(F.transform(F.filter("blocks", lambda b: F.get(F.col("mains"), b["node"]) & ~constant(b)), lambda b: b["text"]), "\n\n")
    out = parsed.select("row", "host", "shape", "blocks").join(wrappers, ["host", "shape"]).select("row", text.alias("text"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "text", F.char_length("text").cast("bigint").alias("n_chars"))
