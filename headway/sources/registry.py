"""Feed registry files: JSON with feeds and operators, read strictly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the registry format.
FEED_KEYS = ("id", "spec", "name", "description", "languages", "license", "authorization", "supersedes_ids", "tags", "operators", "urls")
OPERATOR_KEYS = ("onestop_id", "name", "short_name", "website", "supersedes_ids", "tags", "associated_feeds")
LICENSE_FLAGS = ("use_without_attribution", "create_derived_product", "redistribution_allowed", "commercial_use_allowed", "share_alike_optional")
FLAG_VALUES = ("yes", "no", "unknown")
SPECS = ("gtfs", "gtfs-rt", "gbfs", "mds")
AUTHORIZATIONS = ("header", "basic_auth", "query_param", "path_segment", "replace_url")
URL_PATTERN = "^(http|https|ftp)://.+"
SCHEMA = "feeds ARRAY<STRUCT<id STRING, spec STRING, name STRING, license STRUCT<spdx_identifier STRING, use_without_attribution STRING, create_derived_product STRING, redistribution_allowed STRING, commercial_use_allowed STRING, share_alike_optional STRING>, authorization STRUCT<type STRING, param_name STRING, info_url STRING>, tags MAP<STRING,STRING>, urls STRUCT<static_current STRING, static_historic ARRAY<STRING>, realtime_trip_updates STRING>>>, operators ARRAY<STRUCT<onestop_id STRING, name STRING, associated_feeds ARRAY<STRUCT<feed_onestop_id STRING, gtfs_agency_id STRING>>>>, license_spdx_identifier STRING"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(file, body) of the JSON files of a folder."""
    return spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("file"), F.col("value").alias("body"))


def parse(files: DataFrame) -> DataFrame:
    """(file, r, valid): a file with an unknown key or value in one of its feeds or operators is invalid as a whole."""
    raw = F.from_json("body", "feeds ARRAY<STRING>, operators ARRAY<STRING>")
    r = F.from_json("body", SCHEMA)
    only = lambda objects, keys: F.forall(F.coalesce(objects, F.array()), lambda o: F.coalesce(F.size(F.array_except(F.json_object_keys(o), F.array(*map(F.lit, keys)))) == 0, F.lit(False)))
    known = only(raw["feeds"], FEED_KEYS) & only(raw["operators"], OPERATOR_KEYS)
    flags = F.forall(F.coalesce(r["feeds"], F.array()), lambda f: F.forall(F.array(*[F.coalesce(f["license"][k], F.lit("unknown")) for k in LICENSE_FLAGS]), lambda v: v.isin(*FLAG_VALUES)))
    operators_ok = F.forall(F.coalesce(r["operators"], F.array()), lambda o: o["onestop_id"].isNotNull() & o["name"].isNotNull())
    feeds_ok = F.forall(F.coalesce(r["feeds"], F.array()), lambda f: f["id"].isNotNull() & f["spec"].isin(*SPECS) & (f["authorization"].isNull() | f["authorization"]["type"].isin(*AUTHORIZATIONS)) & (f["urls"]["static_current"].isNull() | f["urls"]["static_current"].rlike(URL_PATTERN)))
    return files.select("file", r.alias("r"), F.coalesce(F.try_parse_json("body").isNotNull() & known & feeds_ok & flags & operators_ok, F.lit(False)).alias("valid"))


def static_urls(parsed: DataFrame) -> DataFrame:
    """(file, feed_index, feed_id, url, target) of the valid files' feeds with a current static feed."""
    feeds = parsed.where("valid").select("file", F.posexplode("r.feeds").alias("feed_index", "f"))
    return feeds.where("f.urls.static_current is not null").select("file", "feed_index", F.col("f.id").alias("feed_id"), F.col("f.urls.static_current").alias("url"), F.concat_ws(".", "file", F.col("feed_index").cast("string"), F.lit("zip")).alias("target"))
