"""Land polygons from GeoJSON, and routes to it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import semantics as S
from ..functions.cut import cut
from .graphs import exists

_FEATURES = "struct<features:array<struct<geometry:struct<type:string,coordinates:string>>>>"
_POLYGON = "array<array<array<double>>>"


def land_rings(spark: SparkSession, path: str) -> DataFrame:
    """ring_id, pts, is_hole, bounding box and is_island of every ring of three points or more.

    Polygon and MultiPolygon features in degrees; ids count rings in the order of the file, by feature, polygon and ring.
    Files are read whole: a FeatureCollection is one document.
    """
    text = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.from_json("value", _FEATURES).alias("c"))
    feature = text.select("file", F.posexplode("c.features").alias("feature", "f")).select("file", "feature", "f.geometry.*")
    polygon = F.when(F.col("type") == "Polygon", F.array(F.from_json("coordinates", _POLYGON))).when(F.col("type") == "MultiPolygon", F.from_json("coordinates", f"array<{_POLYGON}>"))
    rings = feature.select("file", "feature", F.posexplode(polygon).alias("poly", "p")).select("file", "feature", "poly", F.posexplode("p").alias("ring", "pts"))
    rings = rings.where(F.size("pts") >= 3)
    # one ordered number per ring: a struct's order, not a row number over everything in one task
    order = F.struct("file", "feature", "poly", "ring")
    ranked = rings.withColumn("o", order).repartitionByRange("o").sortWithinPartitions("o")
    ranked = ranked.withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id()).transform(cut)
    before, at = {}, 0
    for part, n in sorted(tuple(r) for r in ranked.groupBy("part").count().collect()):
        before[part], at = at, at + n
    offsets = spark.createDataFrame(list(before.items()) or [(0, 0)], "part int, before long")
    within = F.col("nth") - (F.col("part").cast("long") * F.lit(1 << 33))
    numbered = ranked.join(F.broadcast(offsets), "part").select((F.col("before") + within).alias("ring_id"), F.transform("pts", lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))).alias("pts"), (F.col("ring") > 0).alias("is_hole"))
    return with_boxes(numbered)


def with_boxes(rings: DataFrame) -> DataFrame:
    """ring_id, pts with min_lon, min_lat, max_lon, max_lat and is_island (no longer than 3 degrees either way)."""
    lons, lats = F.transform("pts", lambda p: p["lon"]), F.transform("pts", lambda p: p["lat"])
    box = {"min_lon": F.array_min(lons), "min_lat": F.array_min(lats), "max_lon": F.array_max(lons), "max_lat": F.array_max(lats)}
    span = F.greatest(F.col("max_lon") - F.col("min_lon"), F.col("max_lat") - F.col("min_lat"))
    return rings.withColumns(box).withColumn("is_island", span <= S.ISLAND_SPAN)


def land_file(spark: SparkSession, candidates: str | Sequence[str]) -> str:
    """The first path that is there: detailed land before coarse."""
    candidates = [candidates] if isinstance(candidates, str) else list(candidates)
    for c in candidates:
        if exists(spark, c):
            return c
    raise FileNotFoundError(", ".join(candidates))


def feature(name: Column | str, points: Column, props: dict[str, Column] | None = None, line: str | None = None) -> Column:
    """A LineString feature as a struct: points are structs of lon and lat."""
    line = line or name
    colour = F.lit(S.COLOURS.get(line, "#000000"))
    coordinates = F.transform(points, lambda p: F.array(p["lon"], p["lat"]))
    inner = [c.alias(k) for k, c in (props or {}).items()]
    properties = F.struct(*inner, F.lit(line).alias("name"), colour.alias("color"), F.size(points).alias("pointCount"))
    return F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates")).alias("geometry"), properties.alias("properties"))
