"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word definition: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\u000b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a new one where that is unset and all runs on this machine (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="headway-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/headway/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_list(text: Column) -> Column:
    """Array of the maximal runs of characters outside WHITE; null gives an empty array."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(t == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(t, r"[\x20\x09-\x0D]+"))


def word_count(text: Column) -> Column:
    """Number of words, as bigint; null counts as empty."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"[\x20\x09-\x0D]+"))).cast("bigint")


def give_back() -> None:
    """Returns memory that this Python worker has freed to the system. Workers live on between tasks, stages and
    operators, and without this keep the most that any of these needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task yields; then its memory is given back."""
    try:
        yield from batches
    finally:
        give_back()


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that one slice holds about `most` bytes of text; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at, held = 0, 0
        for i, n in enumerate(sizes):
            if i > at and held + n > most:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += int(n)
        yield batch.slice(at)
