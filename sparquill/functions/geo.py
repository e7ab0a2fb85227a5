"""Points, ranges, dates, addresses and places as column expressions.

Everything here is a predicate or a value of plain columns, so filters reach the
Parquet scan and statistics skip row groups. Distances are tested behind a box.
"""

from __future__ import annotations

import ipaddress
import json
import math
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .values import EARTH_KM, haversin

# --- points and ranges


def point_range(columns: Sequence[Column], low: Sequence, high: Sequence) -> Column:
    """Whether a point lies in a box, ends included, dimension by dimension."""
    out = F.lit(True)
    for c, a, b in zip(columns, low, high):
        out = out & c.between(a, b)
    return out


def intersects(low: Column, high: Column, a, b) -> Column:
    """Whether the range low..high meets a..b; ends belong to ranges."""
    return (low <= b) & (high >= a)


def within(low: Column, high: Column, a, b) -> Column:
    return (low >= a) & (high <= b)


def contains(low: Column, high: Column, a, b) -> Column:
    return (low <= a) & (high >= b)


def crosses(low: Column, high: Column, a, b) -> Column:
    """Whether the range meets a..b without lying inside it."""
    return intersects(low, high, a, b) & ~within(low, high, a, b)


RELATIONS = {"intersects": intersects, "within": within, "contains": contains, "crosses": crosses}


def range_relation(ranges: Sequence[tuple[Column, Column]], query: Sequence[tuple], relation: str) -> Column:
    """A relation of ranges in several dimensions; crossing means to meet in all and stick out in one."""
    each = lambda f: _all([f(lo, hi, a, b) for (lo, hi), (a, b) in zip(ranges, query)])
    return each(intersects) & ~each(within) if relation == "crosses" else each(RELATIONS[relation])


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def half_float(x: Column) -> Column:
    """The number rounded to 11 significant bits, as 16-bit floats keep it."""
    e = F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14))
    unit = F.pow(F.lit(2.0), e - 10)
    return F.when(x == 0, x).otherwise(F.bround(x / unit) * unit)


# --- dates

#: Formats of sortable date strings by resolution.
RESOLUTIONS = {"year": "yyyy", "month": "yyyyMM", "day": "yyyyMMdd", "hour": "yyyyMMddHH", "minute": "yyyyMMddHHmm", "second": "yyyyMMddHHmmss", "millisecond": "yyyyMMddHHmmssSSS"}


def date_string(ts: Column, resolution: str) -> Column:
    """A date as a string that sorts like it."""
    return F.date_format(ts, RESOLUTIONS[resolution])


def parse_date_string(text: Column) -> Column:
    """The first instant that a string of any resolution stands for."""
    whole = F.concat(text, F.substring(F.lit("00000101000000000"), F.length(text) + 1, F.lit(17)))
    return F.regexp_replace(whole, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)(\d{3})$", "$1-$2-$3 $4:$5:$6.$7").cast("timestamp")


def date_round(ts: Column, resolution: str) -> Column:
    return F.date_trunc(resolution, ts)


def date_range(text: str) -> tuple[str | None, str | None]:
    """(first instant, first instant after) of ``2024-05``, ``[2024 TO 2024-06-15]`` or with ``*`` for an open end."""
    hit = re.fullmatch(r"\[\s*(\S+)\s+TO\s+(\S+)\s*\]", text)
    a, b = hit.groups() if hit else (text, text)
    return (None if a == "*" else _instant(a, False)), (None if b == "*" else _instant(b, True))


def _instant(text: str, after: bool) -> str:
    parts = [int(x) for x in re.split(r"[-T:.]", text.rstrip("Z"))]
    whole = [*parts, *[1, 1, 1, 0, 0, 0, 0][len(parts) :]] if len(parts) < 7 else parts
    t = pd.Timestamp(whole[0], whole[1], whole[2], whole[3], whole[4], whole[5], whole[6] * 1000)
    if after:
        units = ["years", "months", "days", "hours", "minutes", "seconds", "microseconds"]
        t += pd.DateOffset(**{units[len(parts) - 1]: 1000 if len(parts) == 7 else 1})
    return str(t)


def date_relation(start: Column, stop: Column, text: str, relation: str = "intersects") -> Column:
    """A relation of the half-open range start..stop to a range string."""
    a, b = date_range(text)
    a = F.to_timestamp(F.lit(a or "0001-01-01 00:00:00"))
    b = F.to_timestamp(F.lit(b or "9999-12-31 23:59:59"))
    return {"intersects": (start < b) & (stop > a), "within": (start >= a) & (stop <= b), "contains": (start <= a) & (stop >= b)}[relation]


# --- addresses


@F.pandas_udf(BinaryType())
def inet(text: pd.Series) -> pd.Series:
    """An IP address as 16 bytes, those of version 4 mapped into version 6; null if it is none. Bytes compare like addresses."""

    def one(x: str | None) -> bytes | None:
        try:
            a = ipaddress.ip_address(x)
        except ValueError:
            return None
        return b"\0" * 10 + b"\xff\xff" + a.packed if a.version == 4 else a.packed

    return text.map(one)


def inet_bytes(text: str) -> bytes:
    a = ipaddress.ip_address(text)
    return b"\0" * 10 + b"\xff\xff" + a.packed if a.version == 4 else a.packed


def inet_in(address: Column, network: str) -> Column:
    """Whether 16-byte addresses are in a network such as 10.0.0.0/8."""
    n = ipaddress.ip_network(network, strict=False)
    return address.between(F.lit(bytearray(inet_bytes(str(n[0])))), F.lit(bytearray(inet_bytes(str(n[-1])))))


# --- places


def box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    """Whether a place is in a box, which may cross the date line (west > east)."""
    inside = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return lat.between(south, north) & inside


def near(lat: Column, lon: Column, at_lat: float, at_lon: float, metres: float) -> Column:
    """Whether a place is within a distance; a box around the circle goes first."""
    d = math.degrees(metres / 1000 / EARTH_KM)
    south, north = at_lat - d, at_lat + d
    if south <= -90 or north >= 90:
        west, east = -180.0, 180.0
    else:
        w = math.degrees(math.asin(min(1.0, math.sin(math.radians(d)) / math.cos(math.radians(at_lat)))))
        west, east = at_lon - w, at_lon + w
        west, east = west + 360 if west < -180 else west, east - 360 if east > 180 else east
    slack = 1e-6
    return box(lat, lon, south - slack, north + slack, west - slack, east + slack) & (haversin(lat, lon, F.lit(at_lat), F.lit(at_lon)) * 1000 <= metres)


def in_polygon(lat: Column, lon: Column, lats: Sequence[float], lons: Sequence[float], holes: Sequence[tuple[Sequence[float], Sequence[float]]] = ()) -> Column:
    """Whether a place is in a polygon, by counting the edges a ray crosses; in none of its holes. Behind the polygon's box."""
    edges = list(zip(lats, lons, lats[1:], lons[1:]))
    odd = F.lit(0)
    for a, x, b, y in edges:
        if a != b:
            crossed = ((lat < a) != (lat < b)) & (lon < (lat - a) / (b - a) * (y - x) + x)
            odd = odd + F.when(crossed, 1).otherwise(0)
    inside = box(lat, lon, min(lats), max(lats), min(lons), max(lons)) & (odd % 2 == 1)
    for h_lats, h_lons in holes:
        inside = inside & ~in_polygon(lat, lon, h_lats, h_lons)
    return inside


def polygons(geojson: str) -> list[tuple[list[float], list[float], list[tuple[list[float], list[float]]]]]:
    """(lats, lons, holes) of each polygon in a GeoJSON Polygon, MultiPolygon, Feature or collection of one."""
    x = json.loads(geojson)
    while x.get("type") in ("Feature", "FeatureCollection"):
        x = x["geometry"] if x["type"] == "Feature" else x["features"][0]
    shapes = {"Polygon": lambda: [x["coordinates"]], "MultiPolygon": lambda: x["coordinates"]}.get(x.get("type"))
    if shapes is None:
        raise ValueError("not a polygon")
    ring = lambda r: ([p[1] for p in r], [p[0] for p in r])
    return [(*ring(s[0]), [ring(h) for h in s[1:]]) for s in shapes()]


def nearest(rows: DataFrame, lat: str, lon: str, at_lat: float, at_lon: float, k: int, key: str) -> DataFrame:
    """The ``k`` nearest rows with their distance in kilometres; ties by key."""
    return rows.withColumn("km", haversin(F.col(lat), F.col(lon), F.lit(at_lat), F.lit(at_lon))).orderBy("km", key).limit(k)


def path_near(lat: Column, lon: Column, places: Sequence[tuple[float, float]], metres: float) -> Column:
    """Whether a place is within a distance of the corners of a path or, on the plane about it, of its legs."""
    out = F.lit(False)
    for a, o in places:
        out = out | near(lat, lon, a, o, metres)
    for (a, o), (b, p) in zip(places, places[1:]):
        flat = math.cos(math.radians((a + b) / 2))
        dx, dy = (p - o) * flat, b - a
        n = dx * dx + dy * dy
        if n:
            x, y = (lon - o) * flat, lat - a
            t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x * dx + y * dy) / n))
            out = out | (F.sqrt(F.pow(x - t * dx, 2) + F.pow(y - t * dy, 2)) <= math.degrees(metres / 1000 / EARTH_KM))
    return out


def _cell(x: Column, low: float, high: float, bits: int) -> Column:
    return F.least(F.floor((x - low) / (high - low) * (1 << bits)), F.lit((1 << bits) - 1)).cast("long")


def morton(lat: Column, lon: Column, bits: int = 31) -> Column:
    """Bits of longitude (even places) and latitude (odd places) interleaved."""
    x, y = _cell(lon, -180, 180, bits), _cell(lat, -90, 90, bits)
    out = F.lit(0).cast("long")
    for i in range(bits):
        for v, at in ((x, 2 * i), (y, 2 * i + 1)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(v, i).bitwiseAND(F.lit(1).cast("long")), at))
    return out


def quad_key(lat: Column, lon: Column, levels: int) -> Column:
    """The quad cell of a place: a letter A to D a level, from the north-west by rows."""
    x, y = _cell(lon, -180, 180, levels), _cell(lat, -90, 90, levels)
    bit = lambda v, i: F.shiftright(v, i).bitwiseAND(F.lit(1).cast("long"))
    return F.concat(*[F.substring(F.lit("ABCD"), ((1 - bit(y, i)) * 2 + bit(x, i) + 1).cast("int"), F.lit(1)) for i in range(levels - 1, -1, -1)])


def geohash(lat: Column, lon: Column, length: int) -> Column:
    """The geohash of a place: five bits a letter, longitude first."""
    bits = 5 * length
    x, y = _cell(lon, -180, 180, (bits + 1) // 2), _cell(lat, -90, 90, bits // 2)
    letters = []
    for k in range(length):
        code = F.lit(0).cast("long")
        for i in range(5 * k, 5 * k + 5):
            v, n = (x, (bits + 1) // 2) if i % 2 == 0 else (y, bits // 2)
            code = code * 2 + F.shiftright(v, n - 1 - i // 2).bitwiseAND(F.lit(1).cast("long"))
        letters.append(F.substring(F.lit("0123456789bcdefghjkmnpqrstuvwxyz"), (code + 1).cast("int"), F.lit(1)))
    return F.concat(*letters)


def heatmap(rows: DataFrame, lat: str, lon: str, levels: int) -> DataFrame:
    """(row, col, n): counts of places in the cells of a grid of 2^levels by 2^levels, rows from the north."""
    top = (1 << levels) - 1
    return rows.groupBy((top - _cell(F.col(lat), -90, 90, levels)).cast("int").alias("row"), _cell(F.col(lon), -180, 180, levels).cast("int").alias("col")).agg(F.count("*").alias("n"))


def overlap_ratio(south: Column, north: Column, west: Column, east: Column, query: tuple[float, float, float, float], target_share: float = 0.0) -> Column:
    """Likeness of boxes by the area they share, as a share of the query's area and, weighted, of their own."""
    s, n, w, e = query
    area = lambda h, v: F.greatest(h, F.lit(0.0)) * F.greatest(v, F.lit(0.0))
    both = area(F.least(north, F.lit(n)) - F.greatest(south, F.lit(s)), F.least(east, F.lit(e)) - F.greatest(west, F.lit(w)))
    own = area(north - south, east - west)
    return (1 - target_share) * both / ((n - s) * (e - w)) + target_share * F.when(own > 0, both / F.nullif(own, F.lit(0.0))).otherwise(0.0)
