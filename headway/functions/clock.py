"""Service times: seconds that saturate, roll over days, and start at noon minus twelve hours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from headway.constants import DAY_S, LAST_SECOND


def plus_seconds(t: Column, s: Column) -> Column:
    """t + s, or t where that doesn't fit 32 bits."""
    return F.when(t + s > F.lit(LAST_SECOND), t).otherwise(t + s)


def minus_seconds(t: Column, s: Column) -> Column:
    return F.greatest(t - s, F.lit(0).cast("bigint"))


def clock_seconds(text: Column) -> Column:
    """Seconds of h:mm:ss; hours may pass 24. Null for anything else."""
    part = lambda k: F.regexp_extract(text, r"^\s*(\d+):(\d\d):(\d\d)\s*$", k)
    return F.when(part(1) != "", part(1).try_cast("bigint") * 3600 + part(2).try_cast("bigint") * 60 + part(3).try_cast("bigint"))


def service_day_start(day: Column, zone: Column) -> Column:
    """Epoch seconds of local noon minus twelve hours: the zero of a service day, right on days when clocks change."""
    noon = F.to_timestamp(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 12:00:00")))
    return F.unix_timestamp(F.to_utc_timestamp(noon, zone)) - 43_200


def rolled_date(day: Column, seconds: Column) -> Column:
    return F.date_add(day, F.floor(seconds / DAY_S).cast("int"))
