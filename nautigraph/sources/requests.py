"""Route requests from query strings and JSON bodies, as rows; problems become an error column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import semantics as S
from ..functions.geo import parse_coords

_POINTS = "array<struct<lon:double,lat:double>>"


def _checked(df: DataFrame, bad: str) -> DataFrame:
    """req_id, ports, penalty, error: coordinates that aren't finite are refused too."""
    finite = F.forall("ports", lambda p: p["lon"].isNotNull() & p["lat"].isNotNull() & (F.abs(p["lon"]) <= 1e6) & (F.abs(p["lat"]) <= 1e6) & ~F.isnan(p["lon"]) & ~F.isnan(p["lat"]))
    error = F.when(F.col("ports").isNull() | (F.size("ports") < 2), bad).when(~finite, "Invalid coords")
    return df.withColumn("error", error).withColumn("penalty", F.coalesce(F.col("penalty").cast("float"), F.lit(S.PENALTY).cast("float"))).select("req_id", "ports", "penalty", "error")


def single(requests: DataFrame) -> DataFrame:
    """From req_id, from, to ("lon,lat") and penalty."""
    a, b = parse_coords(F.col("from")), parse_coords(F.col("to"))
    point = lambda c: F.struct(c[0].alias("lon"), c[1].alias("lat"))
    ports = F.when(a.isNotNull() & b.isNotNull(), F.array(point(a), point(b)))
    return _checked(requests.select("req_id", ports.alias("ports"), "penalty"), "Invalid coords")


def multi(bodies: DataFrame) -> DataFrame:
    """From req_id and body, a JSON object of ports and perhaps penalty."""
    parsed = bodies.select("req_id", F.from_json("body", "ports array<array<double>>, penalty float").alias("b"))
    ports = F.transform("b.ports", lambda p: F.struct(F.get(p, 0).alias("lon"), F.get(p, 1).alias("lat")))
    return _checked(parsed.select("req_id", ports.alias("ports"), "b.penalty"), "Need ≥2 ports")
