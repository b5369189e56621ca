"""The encoded polyline format (five decimals)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F


def encode_points(points: list[tuple[float, float]]) -> str:
    out, last = [], (0, 0)
    for p in points:
        now = tuple(round(v * 1e5) for v in p)
        for a, b in zip(now, last, strict=True):
            v = (a - b) << 1
            v = ~v if v < 0 else v
            while v >= 0x20:
                out.append(chr((0x20 | (v & 0x1F)) + 63))
                v >>= 5
            out.append(chr(v + 63))
        last = now
    return "".join(out)


def decode_points(text: str) -> list[tuple[float, float]]:
    values, at = [], 0
    while at < len(text):
        v = shift = 0
        while True:
            b = ord(text[at]) - 63
            at += 1
            v |= (b & 0x1F) << shift
            shift += 5
            if b < 0x20:
                break
        values.append(~(v >> 1) if v & 1 else v >> 1)
    lat = lon = 0
    out = []
    for a, b in zip(values[::2], values[1::2], strict=True):
        lat, lon = lat + a, lon + b
        out.append((lat / 1e5, lon / 1e5))
    return out


def encode_polyline():
    """UDF of array<struct<lat, lon>>; null stays null."""

    def encode(points: pd.Series) -> pd.Series:
        return points.map(lambda ps: None if ps is None else encode_points([(p["lat"], p["lon"]) for p in ps]))

    return F.pandas_udf(encode, "string")


def decode_polyline():
    """UDF giving array<struct<lat, lon>>; null stays null."""

    def decode(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else [{"lat": a, "lon": b} for a, b in decode_points(t)])

    return F.pandas_udf(decode, "array<struct<lat:double,lon:double>>")
