"""Building a stored timetable from a folder of feeds, in steps that can be run apart and taken up again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.constants import SERVICE_DAYS
from headway.operators import spatial
from headway.sources import gtfs, timetable
from headway.sources.timetable import Timetable

MODES = ("full", "prepare", "concat")


def feeds_key(spark: SparkSession, folder: str, start: str, days: int) -> str:
    """Names a build: a hash of the archives' contents and the service window, so that changed feeds or another window are built anew."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder)
    each = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("hash"))  # a row a feed
    row = each.agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(F.concat_ws(":", "name", "hash"))), F.lit(start), F.lit(str(days))), 256).alias("key")).first()
    return row["key"]


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a step's folder was written to its end."""
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(file)


def prepare(spark: SparkSession, folder: str, out: str, start: str, days: int = SERVICE_DAYS) -> str:
    """Reads the feeds and stores their tables under the build's own folder, unless they are there; that folder."""
    path = f"{out.rstrip('/')}/{feeds_key(spark, folder, start, days)}"
    if not complete(spark, f"{path}/feeds"):
        gtfs.read_feeds(spark, folder).write.mode("overwrite").partitionBy("member").parquet(f"{path}/feeds")
    return path


def concat(spark: SparkSession, path: str, start: str, days: int = SERVICE_DAYS) -> None:
    """The timetable of all prepared feeds and its transfers; steps that are complete aren't done again."""
    if not complete(spark, f"{path}/lines"):  # written last
        timetable.write(gtfs.build(gtfs.stored_feeds(spark, f"{path}/feeds"), start, days), path)
    if not complete(spark, f"{path}/transfers"):
        spatial.transfers(timetable.read(spark, path).stops).write.mode("overwrite").parquet(f"{path}/transfers")


def build(spark: SparkSession, folder: str, out: str, start: str, days: int = SERVICE_DAYS, mode: str = "full") -> str:
    """Prepares the feeds, puts them together, or both; the build's folder."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    path = f"{out.rstrip('/')}/{feeds_key(spark, folder, start, days)}" if mode == "concat" else prepare(spark, folder, out, start, days)
    if mode != "prepare":
        if not complete(spark, f"{path}/feeds"):
            raise FileNotFoundError("these feeds aren't prepared for this window")
        concat(spark, path, start, days)
    return path


def opened(spark: SparkSession, path: str) -> tuple[Timetable, DataFrame]:
    """A build's timetable and transfers."""
    return timetable.read(spark, path), spark.read.parquet(f"{path}/transfers")
