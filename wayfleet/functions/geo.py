"""Geometry and unit expressions.

Arguments are SQL expression texts (a column name is one), so the same formula serves top-level
columns and the elements of an array inside a higher-order function. ``*_sql`` returns text, the
others a Column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The results depend on these constants.
EARTH_KM = 6371.0
EARTH_M = 6371000.0
ZERO_LENGTH_SQ = 1e-12
MPH_PER_KMH = 0.621371
MPS_PER_MPH = 0.44704
ON_ROUTE_KM = 0.050


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str, radius: float = EARTH_KM) -> str:
    # Rounding can push the root of opposite points past 1; least() would do, but it skips NULLs.
    return (f"{2 * radius}D * nanvl(asin(sqrt(power(sin((radians({lat2}) - radians({lat1})) / 2), 2) + "
            f"cos(radians({lat1})) * cos(radians({lat2})) * power(sin((radians({lon2}) - radians({lon1})) / 2), 2))), pi() / 2)")


def haversine_km(lat1: str, lon1: str, lat2: str, lon2: str) -> Column:
    return F.expr(haversine_sql(lat1, lon1, lat2, lon2, EARTH_KM))


def haversine_m(lat1: str, lon1: str, lat2: str, lon2: str) -> Column:
    return F.expr(haversine_sql(lat1, lon1, lat2, lon2, EARTH_M))


def segment_position_sql(lat: str, lon: str, lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Where the planar projection of a point falls on a segment, as a share of it in [0, 1]."""
    dlat, dlon = f"({lat2} - {lat1})", f"({lon2} - {lon1})"
    length = f"({dlat} * {dlat} + {dlon} * {dlon})"
    return (f"CASE WHEN {length} > {ZERO_LENGTH_SQ:.15f}D THEN greatest(0D, least(1D, "
            f"(({lat} - {lat1}) * {dlat} + ({lon} - {lon1}) * {dlon}) / {length})) ELSE 0D END")


def segment_position(lat: str, lon: str, lat1: str, lon1: str, lat2: str, lon2: str) -> Column:
    return F.expr(segment_position_sql(lat, lon, lat1, lon1, lat2, lon2))


def along_sql(start: str, end: str, share: str) -> str:
    return f"({start} + {share} * ({end} - {start}))"


def clamp(value: str, low: float, high: float) -> Column:
    return F.expr(f"CASE WHEN {value} IS NOT NULL THEN greatest({low}, least({high}, {value})) END")


def non_negative(value: str) -> Column:
    return F.expr(f"CASE WHEN {value} IS NOT NULL THEN greatest(0D, {value}) END")


def kmh(km: str, seconds: str) -> Column:
    return F.expr(f"CASE WHEN {seconds} > 0 THEN {km} / ({seconds}) * 3600D END")


def kmh_to_mph(speed: str) -> Column:
    return F.expr(f"{speed} * {MPH_PER_KMH}D")


def mph_to_mps(speed: str) -> Column:
    return F.expr(f"{speed} * {MPS_PER_MPH}D")


def route_if_close(route: str, dist_km: str, limit_km: float = ON_ROUTE_KM) -> Column:
    return F.expr(f"CASE WHEN {dist_km} < {limit_km}D THEN {route} END")


def progress_percent(from_start: str, length: str) -> Column:
    return F.expr(f"{from_start} / nullif({length}, 0D) * 100D")
