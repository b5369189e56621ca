"""Token counts by a two-tier lookup on the map side; no pre-token is ever shuffled.

Tier one is a table of the lengths of frequent pre-tokens, counted over all texts, made once on the driver
and broadcast: `table_size` entries at most, whatever the input. Each task sends its `table_size` most frequent
ones. Tier two is the cache of each Python worker. Both only save work: a pre-token in neither is encoded by the library.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.common import text_slices, tidy
from headway.llm.tokens import PIECE_BYTES, SLICE, PieceEncoder, encoder

TABLE_SIZE = 20_000
#: A task's counts are cut back to half of this when they grow beyond, so rare words of many may be counted short.
MOST_HELD = 200_000


def frequent_lengths(documents: DataFrame, text_col: str, path: str, table_size: int = TABLE_SIZE) -> dict[str, int]:
    """Pre-token to number of tokens, for the most frequent pre-tokens of all texts."""
    enc = PieceEncoder(path)
    if not enc.split:
        return {}

    def most(held: pa.Table, n: int) -> pa.Table:
        return held.sort_by([("n", "descending"), ("word", "ascending")]).slice(0, n)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = encoder(path, "counts"), pa.table({"word": pa.array([], pa.large_string()), "n": pa.array([], pa.int64())})
        for batch in text_slices(batches, "text", SLICE):
            _, different, index, _ = own.pieces(pc.fill_null(batch.column("text").cast(pa.large_string()), ""))
            found = pa.table({"word": different, "n": pa.array(np.bincount(index, minlength=len(different)), pa.int64())})
            held = pa.concat_tables([held, found.filter(pc.less_equal(pc.binary_length(different), PIECE_BYTES))]).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
            if len(held) > MOST_HELD:
                held = most(held, MOST_HELD // 2)
        for batch in most(held, table_size).combine_chunks().to_batches():
            yield pa.RecordBatch.from_arrays([batch.column("word").cast(pa.string()), batch.column("n")], ["word", "n"])

    texts = documents.select(F.col(text_col).cast("string").alias("text"))
    counted = texts.mapInArrow(lambda batches: tidy(words(batches)), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    pieces = [r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(table_size).collect() if r["word"]]
    return dict(zip(pieces, (len(e) for e in enc.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)), strict=True))


def count_tokens(documents: DataFrame, path: str, text_col: str = "text", out_col: str = "n_tokens", keep: Sequence[str] | None = None, **table: int) -> DataFrame:
    """The columns `keep` of documents (all by default) and out_col (bigint): the library's number of tokens of the
    whole text, without added special tokens. Null texts count as empty (0); a long text is counted whole, alone. Rows
    are independent: repeated rows get equal counts, an empty table gives an empty result. A column that has
    out_col's name is replaced; other columns stay, whatever their names."""
    table_of = documents.sparkSession.sparkContext.broadcast(frequent_lengths(documents, text_col, path, **table))
    kept = [c for c in (documents.columns if keep is None else keep) if c != out_col]
    # one struct, so that no name clashes; the text stands in it once
    fields = [F.col(f"`{c}`") if c != text_col else F.col(f"`{c}`").cast("string").alias(c) for c in dict.fromkeys([*kept, text_col])]
    rows = documents.select(F.struct(*fields).alias("row"))
    columns = [F.col(f"row.`{c}`").alias(c) for c in kept]
    schema = rows.select(F.struct(*(columns or [F.lit(0).alias("none")])).alias("row"), F.lit(0).cast("bigint").alias("n")).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, "counts", table_of.value)
        flat = (pa.RecordBatch.from_struct_array(b.column("row")) for b in batches)
        for batch in text_slices(flat, text_col, SLICE):
            row = pa.RecordBatch.to_struct_array(batch.select(kept)) if kept else pa.array([{"none": 0}] * batch.num_rows, pa.struct([("none", pa.int32())]))
            yield pa.RecordBatch.from_arrays([row, pa.array(enc.counts(batch.column(text_col)), pa.int64())], ["row", "n"])

    counted = rows.mapInArrow(lambda batches: tidy(count(batches)), schema)
    return counted.select(*columns, F.col("n").alias(out_col))
