"""URL filter: host and path rules, then gradient-boosted trees on lexical features.

The trees are trained from labelled URLs, on `most_rows` of them at most, chosen by a hash of the
URL. Suffix statistics are fitted out of fold for training. Splits are found on quantile histograms. The model is a few arrays, so scoring is a map over the
table; rules are expressions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
MOST_ROWS = 20_000
RANGE_BITS = 14
#: Parts of the training rows, whose suffix statistics come from the others.
FOLDS = 5
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "hyphens", "entropy", "host_entropy", "parameters", "query_length", "suffix_rate", "suffix_count", "domain_rate", "domain_count")


def _rest(url: Column) -> Column:
    """What follows the first ://; null without it."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; of equally long ones the blocking, then the first in order; else null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2]))
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in ordered]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    n = np.bincount(np.frombuffer(text.encode(), np.uint8))
    p = n[n > 0] / n.sum()
    return float(-(p * np.log2(p)).sum())


def suffixes(host: str) -> tuple[str, str]:
    """The last label, and the last three (or what there is)."""
    parts = host.split(".")
    return parts[-1], ".".join(parts[-3:])


@dataclass
class SuffixStats:
    """How many labelled URLs end in a suffix and how many of them are bad, drawn to the overall rate."""

    rate: float = 0.0
    counts: dict[str, tuple[int, int]] = field(default_factory=dict)
    weight: float = 20.0

    @classmethod
    def fit(cls, hosts: Sequence[str], bad: np.ndarray) -> SuffixStats:
        counts: dict[str, list[int]] = {}
        for h, y in zip(hosts, bad.tolist(), strict=True):
            for s in suffixes(h):
                c = counts.setdefault(s, [0, 0])
                c[0] += 1
                c[1] += int(y)
        return cls(float(bad.mean()) if len(bad) else 0.0, {k: tuple(v) for k, v in counts.items()})

    def of(self, suffix: str) -> tuple[float, float]:
        n, y = self.counts.get(suffix, (0, 0))
        return (y + self.weight * self.rate) / (n + self.weight), float(np.log1p(n))


def out_of_fold(urls: Sequence[str], hosts: Sequence[str], paths: Sequence[str], bad: np.ndarray, folds: int = FOLDS) -> np.ndarray:
    """features() of training URLs, with the suffix statistics of the other folds, so that no row's own label is in its
    features. Equal URLs are in one fold."""
    fold = np.array([zlib.crc32(u.encode()) % folds for u in urls], np.int64)
    out = np.zeros((len(urls), len(FEATURES)))
    for k in range(folds):
        mine, others = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        if len(mine):
            stats = SuffixStats.fit([hosts[i] for i in others], bad[others])
            out[mine] = features([urls[i] for i in mine], [hosts[i] for i in mine], [paths[i] for i in mine], stats)
    return out


def features(urls: Sequence[str | None], hosts: Sequence[str], paths: Sequence[str], stats: SuffixStats) -> np.ndarray:
    """One row of FEATURES for each URL; a null URL is empty."""
    out = np.zeros((len(urls), len(FEATURES)))
    for i, (url, host, path) in enumerate(zip(urls, hosts, paths, strict=True)):
        url = url or ""
        query = url.partition("#")[0].partition("?")[2]
        last, domain = suffixes(host)
        out[i] = (len(url), len(host), len(path), path.count("/"), host.count(".") + 1, sum(c.isdigit() for c in url) / max(1, len(url)), host.count("-"), _entropy(url), _entropy(host), len([p for p in query.split("&") if p]), len(query), *stats.of(last), *stats.of(domain))
    return out


@dataclass
class BoostedTrees:
    """Logistic gradient boosting; a tree of depth d is 2^d - 1 (feature, threshold) nodes and 2^d leaves."""

    trees: int = 60
    depth: int = 3
    rate: float = 0.1
    bins: int = 64
    ridge: float = 5.0
    base: float = 0.0
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        rate = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        self.base, self.nodes = float(np.log(rate / (1 - rate))), []
        if not len(y) or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            feature, threshold = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                width = 2**level
                best = np.zeros(width)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    cell = node * (len(e) + 1) + binned[:, f]
                    g, h = (np.bincount(cell, v, width * (len(e) + 1)).reshape(width, -1).cumsum(axis=1) for v in (grad, hess))
                    gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                    gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                    k = gain.argmax(axis=1)
                    gain = gain[np.arange(width), k]
                    better = gain > best + 1e-9
                    best[better] = gain[better]
                    at = width - 1 + np.flatnonzero(better)
                    feature[at], threshold[at] = f, e[k[better]]
                node = 2 * node + (x[np.arange(len(y)), feature[width - 1 + node]] > threshold[width - 1 + node])
            g, h = (np.bincount(node, v, 2**self.depth) for v in (grad, hess))
            leaf = self.rate * g / (h + self.ridge)
            self.nodes.append((feature, threshold, leaf))
            score += leaf[node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for feature, threshold, leaf in self.nodes:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (x[np.arange(len(x)), feature[at]] > threshold[at])
            score += leaf[node]
        return 1 / (1 + np.exp(-score))


@dataclass
class UrlModel:
    stats: SuffixStats
    trees: BoostedTrees

    def predict(self, urls: Sequence[str | None], hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        return self.trees.predict(features(urls, hosts, paths, self.stats))


def train(labelled: DataFrame, url_col: str = "url", bad_col: str = "bad", most_rows: int = MOST_ROWS) -> UrlModel:
    """From URLs with a boolean bad; rows with a null in either are left out. Without rows, or with one
    class only, the model gives the rate of bad ones (0.5 without rows)."""
    rows = labelled.select(F.col(url_col).alias("__url"), F.col(bad_col).cast("boolean").alias("bad")).where("__url is not null and bad is not null")
    rows = rows.select("__url", host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"), "bad")
    # the first rows by hash; counts of hash ranges bound what the tasks send for that
    rows = rows.withColumns({"__h": F.xxhash64("__url"), "__range": F.shiftright(F.xxhash64("__url"), 64 - RANGE_BITS)})
    counts = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("__range")  # at most 2 ** RANGE_BITS rows
    enough = counts["__range"][counts["n"].cumsum() >= most_rows]
    if len(enough):
        rows = rows.where(F.col("__range") <= F.lit(int(enough.iloc[0])))
    data = rows.orderBy("__h", "__url", "bad").limit(most_rows).drop("__h", "__range").toPandas()
    y = data["bad"].to_numpy(dtype=float)
    urls, hosts, paths = (data[c].tolist() for c in ("__url", "host", "path"))
    return UrlModel(SuffixStats.fit(hosts, y), BoostedTrees().fit(out_of_fold(urls, hosts, paths, y), y))


def judge(pages: DataFrame, model: UrlModel, rules: Sequence[tuple[str, str, str]] = RULES, url_col: str = "url", cut: float = 0.5) -> DataFrame:
    """pages with host, path, rule, score (of being bad) and verdict: that of the longest rule that fits, else block
    where the score is above `cut`. Null URLs and those without :// have empty host and path and are judged by the
    model; long ones are read whole. Columns of these names are replaced, others stay, whatever their names; rows are
    independent, so repeated ones are judged alike, and an empty table stays empty."""
    own = ("host", "path", "rule", "score", "verdict")
    kept = [c for c in pages.columns if c not in own]
    fields = [F.col(f"`{c}`") for c in kept] or [F.lit(0).alias("none")]
    rows = pages.select(F.struct(*fields).alias("row"), F.col(f"`{url_col}`").cast("string").alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumn("fits", matched_rule(F.col("host"), F.col("path"), rules))
    schema = rows.select("row", "host", "path", "fits", F.lit(0.0).alias("score")).schema
    shared = pages.sparkSession.sparkContext.broadcast(model)  # bounded by most_rows

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.predict(*(batch.column(c).to_pylist() for c in ("url", "host", "path")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "host", "path", "fits")), pa.array(p)], ["row", "host", "path", "fits", "score"])

    verdict = F.coalesce("fits.verdict", F.when(F.col("score") > cut, "block").otherwise("allow"))
    return rows.mapInArrow(score, schema).select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "host", "path", F.col("fits.rule").alias("rule"), "score", verdict.alias("verdict"))
