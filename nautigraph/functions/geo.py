"""Column expressions of the navigation engine: all of them stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import semantics as S


def _col(c: Column | str | float) -> Column:
    return c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(float(c))


def haversine_km(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance; longitudes a turn apart are the same."""
    lon1, lat1, lon2, lat2 = map(_col, (lon1, lat1, lon2, lat2))
    turn = F.abs(lon2 - lon1) % 360.0
    dlon = F.radians(F.when(turn > 180.0, 360.0 - turn).otherwise(turn))
    dlat = F.radians(lat2 - lat1)
    half = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), F.lit(2.0))
    return F.lit(2 * S.EARTH_KM) * F.asin(F.sqrt(half))


def planar_km(dlon: Column, dlat: Column) -> Column:
    """Length in degrees times 111, whatever the latitude."""
    return F.sqrt(dlon * dlon + dlat * dlat) * S.KM_PER_DEGREE


def depth_ratio(depth_a, depth_b, deepest) -> Column:
    """The deeper end's share of the deepest level, as float; null for a graph of depth 0."""
    deepest = _col(deepest)
    return F.when(deepest != 0, F.greatest(_col(depth_a), _col(depth_b)).cast("double") / deepest).cast("float")


def edge_weight(base: Column | str, ratio: Column | str, penalty: Column | str | float = S.PENALTY) -> Column:
    """Base weight with the coastal penalty, in single precision throughout."""
    base, ratio = _col(base).cast("float"), _col(ratio).cast("float")
    one, start = F.lit(1.0).cast("float"), F.lit(S.PENALTY_FROM).cast("float")
    t = ((ratio - start).cast("float") / (one - start).cast("float")).cast("float")
    extra = ((_col(penalty).cast("float") - one) * t * t).cast("float")
    return F.when(ratio <= start, base).otherwise((base * (one + extra)).cast("float"))


def normalised_lon(lon: Column) -> Column:
    """Longitude within [-180, 180), for any that is less than two turns off."""
    lon = F.when(lon >= 180.0, lon - 360.0).when(lon < -180.0, lon + 360.0).otherwise(lon)
    return F.when(lon >= 180.0, lon - 360.0).when(lon < -180.0, lon + 360.0).otherwise(lon)


def raster_row(lat: Column, cell: float = S.RASTER_CELL) -> Column:
    return F.greatest(((lat + 90.0) / cell).cast("int"), F.lit(0))


def raster_col(lon: Column, cell: float = S.RASTER_CELL) -> Column:
    return F.greatest(((normalised_lon(lon) + 180.0) / cell).cast("int"), F.lit(0))


def packed_coordinate(x: Column) -> Column:
    """Five decimals, halves away from zero."""
    return F.round(x * 100000.0) / 100000.0


def packed_weight(km: Column) -> Column:
    """Tenths of a km, as a graph file holds them."""
    return F.round(km * 10.0)


_NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def parse_coords(text: Column | str) -> Column:
    """"lon,lat" as an array of two numbers, or null: tokens that are no numbers are passed over, blanks aren't trimmed."""
    tokens = F.filter(F.split(_col(text), ","), lambda t: t.rlike(_NUMBER))
    numbers = F.transform(tokens, lambda t: t.try_cast("double"))
    return F.when(F.size(numbers) == 2, numbers)


def truncated(x: Column) -> Column:
    """As an integer, fractions cut off, negatives and NaN 0."""
    return F.when(F.isnan(x) | (x < 0), F.lit(0)).otherwise(x.cast("bigint"))


def edge_samples(km: Column) -> Column:
    """Intervals in which an edge is tested: 50 m for less than 3 km, else 500 m, three at least."""
    return F.greatest(F.lit(S.EDGE_SAMPLES), F.ceil(km / F.when(km < S.EDGE_SHORT_KM, S.EDGE_STEP_SHORT_KM).otherwise(S.EDGE_STEP_KM)).cast("int"))


def line_samples(km: Column, step: float) -> Column:
    """Intervals of about `step` km, two at least."""
    return F.greatest(F.lit(2), F.ceil(km / step).cast("int"))


def distance_from_segment(lon, lat, lon1, lat1, lon2, lat2, literal: bool = True) -> Column:
    """Planar distance of a point from a segment; literal: see Semantics.literal_projection."""
    x, y, x1, y1, x2, y2 = map(_col, (lon, lat, lon1, lat1, lon2, lat2))
    dx, dy = x2 - x1, y2 - y1
    squared = dx * dx + dy * dy
    along, across = (x - x1) * dx, (y - y1) * dy
    t = F.when(squared == 0, 0.0).otherwise(along + F.try_divide(across, squared) if literal else F.try_divide(along + across, squared))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.sqrt(F.pow(x - (x1 + t * dx), F.lit(2.0)) + F.pow(y - (y1 + t * dy), F.lit(2.0)))

