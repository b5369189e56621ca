"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm import audio, html_main, mixing, packing, quality, simhash, suffix_dedup, token_count, token_files, url_filter
from headway.llm.common import tidy
from headway.llm.tokens import tokenizer_path

TOKEN_LIMIT = 2048
NOTES, NOTE_S = 16, 0.5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def scores(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector, before): what `wavs` plays. before is the vector whose id is smaller by 3, for those with id % 4 = 3."""
    own = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    before = own.where("id % 4 = 0").groupBy((F.col("id") + 3).alias("id")).agg(F.max("vector").alias("before"))
    return own.join(before, "id", "left")


@lru_cache(maxsize=2)  # a vector and the one before it may differ in length
def _tones(per: int) -> np.ndarray:
    """(NOTES, per, samples): the partials of each note."""
    k = np.arange(NOTES * per).reshape(NOTES, per)
    return np.sin(2 * np.pi * (110 * 2 ** ((k * 7 % 12) / 12 + k % 3))[:, :, None] * (np.arange(int(NOTE_S * audio.RATE)) / audio.RATE))


def wavs(batch: pa.RecordBatch) -> Iterator[bytes | None]:
    """Each row of scores as a WAV file of 16 notes, made when it is asked for. A number of the vector is the loudness of one
    partial of a note; null or empty vectors have none. So that recordings overlap, one with a vector before plays its own
    first 4 notes and then, with some noise, all but the first 2 notes of that vector."""

    def play(x: np.ndarray) -> np.ndarray:
        per = -(-len(x) // NOTES)
        loud = np.pad(x, (0, NOTES * per - len(x))).reshape(NOTES, per)
        return np.einsum("np,npt->nt", loud / max(1e-9, np.abs(loud).sum(axis=1).max()), _tones(per))

    for i, *both in zip(*(batch.column(c).to_pylist() for c in ("id", "vector", "before")), strict=True):
        own, before = (np.array([0.0 if y is None else y for y in v or []], float) for v in both)
        if not len(own):
            yield None
            continue
        sound = play(own)
        if len(before):
            sound = np.concatenate([sound[:4], play(before)[2:]])
            sound += 0.002 * np.random.default_rng(i % 2**32).standard_normal(sound.shape)
        yield audio.wav(sound.reshape(-1))


def sonify(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, audio): the WAV files themselves, as `wavs` makes them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 32) for b in batches for k in range(0, b.num_rows, 32)):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(wavs(batch)), pa.binary())], ["id", "audio"])

    return scores(vectors, id_col, vector_col).mapInArrow(lambda batches: tidy(each(batches)), "id bigint, audio binary")


def op2_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no sound, so every row of embeddings is played: its vector becomes a recording."""
    prints = audio.fingerprint_made(scores(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), wavs)
    found = audio.search(prints, "id % 20 = 0")
    return found.withColumnRenamed("id", "vec_id").withColumn("bit_error", F.round("bit_error", 6))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return token_files.read_token_files(manifest)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "copies", "taken")


def labelled_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, bad) of the pages whose document, named by the first number of the path, is labelled: bad if toxic or of low quality."""
    pages = _table(spark, sf_dir, "pages").select("url", F.expr("try_cast(regexp_extract(url, '://[^/]*/[^/]*/([0-9]+)', 1) as bigint)").alias("doc_id"))
    return pages.join(_table(spark, sf_dir, "labels"), "doc_id").select("url", ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.train(labelled_urls(spark, sf_dir))
    return url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), model).select("page_id", "host", "path", "rule", "verdict")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(_table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~quality.verdict(quality.BASE)).alias("base_failed"), quality.verdict(quality.POLICIES[quality.CURRENT]).alias("kept"), "fail_bits")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_count.count_tokens(documents.withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")), tokenizer_path("word_bpe_49k.json"), keep=("doc_id", "n_bytes"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash, op2_audio, op3_token_files, op4_suffix_dedup, op5_mixing, op6_url_filter, op7_packing, op8_main_text, op9_quality, op10_token_counts, pipeline)}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op9_quality": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, struct_pack(a := w[i], b := w[i + 1], c := w[i + 2]) AS k
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
      CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
      length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
      length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_ends FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
b AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT + 8 * (word_chars < 3 * n_words)::INT
      + 16 * (word_chars > 12 * n_words)::INT + 32 * (10 * n_dup_lines > 3 * n_lines)::INT + 64 * (10 * n_upper > 5 * word_chars)::INT + 128 * (5 * n_ends > n_words)::INT AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b""",
    "op4_suffix_dedup": r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
t AS (SELECT doc_id, o, substr(h, 2 * o + 1, 2098) AS h FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 49, 1000)) AS o FROM d)),
s AS (SELECT doc_id, o + i AS p, substr(h, 2 * i + 1, 100) AS k FROM (SELECT doc_id, o, h, unnest(range(0, least(1000, CAST(length(h) / 2 AS BIGINT) - 49))) AS i FROM t)),
f AS (SELECT k, min(doc_id) AS first FROM s GROUP BY k HAVING count(*) > 1),
x AS (SELECT s.doc_id, s.p FROM s JOIN f ON s.k = f.k AND s.doc_id > f.first),
r AS (SELECT doc_id, p, coalesce(p > lag(p) OVER o + 50, true) AS fresh FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
n AS (SELECT doc_id, p, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM r),
z AS (SELECT doc_id, span, min(p) AS a, max(p) + 50 AS e FROM n GROUP BY doc_id, span),
k AS (SELECT doc_id, count(*) AS n_spans, sum(e - a) AS n_removed, list({'a': a, 'e': e} ORDER BY a) AS spans FROM z GROUP BY doc_id),
q AS (SELECT d.doc_id, octet_length(b) AS n, h, coalesce(n_spans, 0) AS n_spans, coalesce(n_removed, 0) AS n_removed,
      list_concat([0], list_transform(spans, lambda v: v.e)) AS froms, list_concat(list_transform(spans, lambda v: v.a), [octet_length(b)]) AS tos FROM d LEFT JOIN k ON k.doc_id = d.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans,
  sha256(unhex(array_to_string(list_transform(range(1, len(froms) + 1), lambda i: substr(h, CAST(2 * froms[i] + 1 AS BIGINT), CAST(2 * (tos[i] - froms[i]) AS BIGINT))), ''))) AS kept_sha256 FROM q""",
}
