"""Token files: documents in id order, encoded and written as patched frame-of-reference blocks.

One range shuffle orders the documents; each task encodes its range and writes one file, under a name of
its own that is moved to the final one, so a task that runs again replaces the file by an equal one. Only
one line for each file (path, documents, ids) goes to the driver, to number the ids across files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm import pfor
from headway.llm.common import new_path, shuffle_partitions, text_slices, tidy
from headway.llm.tokens import SLICE, encoder

END_ID = 2
MANIFEST = "part int, path string, n_docs bigint, n_ids bigint"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_token_files(documents: DataFrame, path: str, out_dir: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, percentile: float = 90.0) -> DataFrame:
    """Writes the files and returns the manifest (part, path, n_docs, n_ids, start), start being the number
    of ids in earlier files.

    Ascending id order, null ids first; rows with equal ids come in the order of their texts, null
    before empty. Ids that many rows share are dealt by the beginning of the text, so they are no single task's. A
    null text is empty and has the end id only; a long one is encoded whole and alone. Other columns are left out. An
    empty table gives an empty manifest. out_dir: a folder all executors reach, the shared folder by default."""
    spark = documents.sparkSession
    out_dir = (out_dir or new_path(spark, "tokens")).rstrip("/")
    n = shuffle_partitions(spark)
    rows = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange(n, F.col("id"), F.substring("text", 1, 32)).sortWithinPartitions("id", "text").withColumn("part", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, part = encoder(path), None, 0
        for batch in text_slices(batches, "text", SLICE):
            if out is None:
                part = batch.column("part")[0].as_py()
                files, where = _filesystem(f"{out_dir}/part-{part:06d}.pfor")
                files.create_dir(where.rpartition("/")[0], recursive=True)
                own = f"{where}.{uuid.uuid4().hex}"
                out = files.open_output_stream(own)
                to = pfor.Writer(out, percentile)
            ids, sizes = enc.encode(batch.column("text"))
            ends = np.cumsum(sizes)
            ids, sizes = np.insert(ids, ends, end_id), sizes + 1
            doc = batch.column("id")
            to.add(pc.fill_null(doc, 0).to_numpy(zero_copy_only=False), doc.is_null().to_numpy(zero_copy_only=False), sizes, ids)
        if out is not None:
            n_docs, n_ids = to.close()
            out.close()
            files.move(own, where)
            yield pa.RecordBatch.from_pylist([{"part": part, "path": f"{out_dir}/part-{part:06d}.pfor", "n_docs": n_docs, "n_ids": n_ids}], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    lines = sorted(ordered.mapInArrow(lambda batches: tidy(write(batches)), MANIFEST).collect())  # one for each file
    starts = np.cumsum([0, *(x["n_ids"] for x in lines)])
    return spark.createDataFrame([(*x, int(s)) for x, s in zip(lines, starts[:-1], strict=True)], f"{MANIFEST}, start bigint")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), from the files alone: where each document's ids begin among
    all ids, how many they are, and the crc32 of them as little-endian unsigned 32-bit integers."""
    spark: SparkSession = manifest.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line in batch.to_pylist():
                files, where = _filesystem(line["path"])
                with files.open_input_file(where) as source:
                    file = pfor.Reader(source)
                    crcs = file.crc32s()
                start = line["start"] + np.cumsum(file.sizes) - file.sizes
                yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids, pa.int64(), mask=file.is_null), *(pa.array(x, pa.int64()) for x in (start, file.sizes, crcs))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.repartition(max(1, shuffle_partitions(spark)), "part")
    return spread.mapInArrow(lambda batches: tidy(read(batches)), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
