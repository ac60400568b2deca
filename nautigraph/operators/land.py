"""Land as rings, edges and raster runs, and relational tests of points and boxes against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import semantics as S
from ..functions.geo import raster_col, raster_row
from ..functions.tiles import box_tiles, point_tiles, sized

#: Columns of the raster that share a join key.
RUN_TILE = 256
TILE = 2.0


def ring_edges(rings: DataFrame) -> DataFrame:
    """ring_id, i, x0, y0, x1, y1: each ring's sides, the last back to the first point."""
    n = F.size("pts")
    sides = F.transform("pts", lambda p, i: F.struct(i.alias("i"), p["lon"].alias("x0"), p["lat"].alias("y0"), F.element_at("pts", F.when(i + 1 < n, i + 2).otherwise(1))["lon"].alias("x1"), F.element_at("pts", F.when(i + 1 < n, i + 2).otherwise(1))["lat"].alias("y1")))
    return rings.select("ring_id", F.inline(sides))


def raster_runs(edges: DataFrame, cell: float = S.RASTER_CELL) -> DataFrame:
    """row, col_start, col_end: runs of land cells, ends exclusive.

    A ring fills its cells between pairs of crossings of a row's centre line; cells that an even number of
    fills cover cancel to water.  Only ends of fills are ever rows here, never cells.
    """
    rows, cols = S.raster_shape(cell)
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    first = F.greatest(F.floor((low + 90.0) / cell).cast("int") - 1, F.lit(0))
    last = F.least(F.floor((high + 90.0) / cell).cast("int") + 1, F.lit(rows - 1))
    lines = edges.where(low < high).withColumn("row", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    centre = F.lit(-90.0) + (F.col("row") + 0.5) * F.lit(cell)
    lines = lines.where((low <= centre) & (high > centre))
    x = F.col("x0") + (centre - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))
    crossing = lines.select("ring_id", "row", x.alias("x"))
    along = Window.partitionBy("ring_id", "row").orderBy("x")
    pairs = crossing.withColumn("nth", F.row_number().over(along)).withColumn("to", F.lead("x").over(along)).where("nth % 2 = 1 and to is not null")
    column = lambda c: F.greatest(((F.col(c) + 180.0) / cell).cast("int"), F.lit(0))
    fills = pairs.select("row", F.least(column("x"), F.lit(cols)).alias("a"), F.least(column("to") + 1, F.lit(cols)).alias("b"))
    ends = fills.select("row", F.explode(F.array("a", "b")).alias("col")).groupBy("row", "col").count().where("count % 2 = 1")
    across = Window.partitionBy("row").orderBy("col")
    runs = ends.withColumn("nth", F.row_number().over(across)).withColumn("col_end", F.lead("col").over(across))
    return runs.where("nth % 2 = 1").select("row", F.col("col").alias("col_start"), "col_end")


def raster_cells(runs: DataFrame) -> DataFrame:
    """row, col of every land cell."""
    return runs.select("row", F.explode(F.sequence(F.col("col_start"), F.col("col_end") - 1)).alias("col"))


def point_is_land(points: DataFrame, runs: DataFrame, cell: float = S.RASTER_CELL) -> DataFrame:
    """points with on_land, by the raster; a point outside it is water."""
    keyed = points.withColumn("row_", raster_row(F.col("lat"), cell)).withColumn("col_", raster_col(F.col("lon"), cell)).withColumn("part_", F.floor(F.col("col_") / RUN_TILE).cast("int"))
    pieces = runs.select(F.col("row").alias("row_"), "col_start", "col_end", F.explode(F.sequence(F.floor(F.col("col_start") / RUN_TILE).cast("int"), F.floor((F.col("col_end") - 1) / RUN_TILE).cast("int"))).alias("part_"))
    pieces = sized(pieces)
    # runs of a row are disjoint, so a point meets one at most
    on = [keyed["row_"] == pieces["row_"], keyed["part_"] == pieces["part_"], keyed["col_"] >= pieces["col_start"], keyed["col_"] < pieces["col_end"]]
    return keyed.join(pieces, on, "left").select(*[keyed[c] for c in points.columns], pieces["col_start"].isNotNull().alias("on_land"))


def _crossings(lon, lat, pts):
    """How many sides of a closed ring a ray to the east crosses."""
    n = F.size(pts)
    sides = F.transform(pts, lambda p, i: F.struct(p.alias("a"), F.element_at(pts, F.when(i > 0, i).otherwise(n)).alias("b")))
    up = lambda s: (s["a"]["lat"] > lat) != (s["b"]["lat"] > lat)
    x = lambda s: (s["b"]["lon"] - s["a"]["lon"]) * F.try_divide(lat - s["a"]["lat"], s["b"]["lat"] - s["a"]["lat"]) + s["a"]["lon"]
    return F.size(F.filter(sides, lambda s: up(s) & (lon < x(s))))


def _by_rings(points: DataFrame, rings: DataFrame, key: str | list[str], *more: Column) -> DataFrame:
    """key, tested, inside and more aggregates of points, a row for each key.

    Points meet the tiles of rings and are then gathered by key, never joined with points again: both sides of such a
    join would be large, and one of them may seem small enough to pass through the driver.
    """
    tiled = box_tiles(rings.select("pts", "min_lon", "min_lat", "max_lon", "max_lat"), TILE)
    tiled = sized(tiled.select(*[F.col(c).alias(f"r_{c}") for c in tiled.columns]), F.size("r_pts"))
    near = point_tiles(points, TILE).join(tiled, F.expr("tx = r_tx and ty = r_ty and lon between r_min_lon and r_max_lon and lat between r_min_lat and r_max_lat"), "left")
    near = near.withColumn("crossed_", F.when(F.col("r_tx").isNotNull(), _crossings(F.col("lon"), F.col("lat"), F.col("r_pts"))))
    return near.groupBy(key).agg((F.count("crossed_") > 0).alias("tested"), F.coalesce(F.sum("crossed_") % 2 == 1, F.lit(False)).alias("inside"), *more)


def point_in_rings(points: DataFrame, rings: DataFrame, key: str) -> DataFrame:
    """key, tested, inside: whether any ring's box holds the point, and whether an odd number of rings of those does."""
    return _by_rings(points.select(key, "lon", "lat"), rings, key)


def point_is_land_precise(points: DataFrame, rings: DataFrame, runs: DataFrame, key: str | list[str], cell: float = S.RASTER_CELL) -> DataFrame:
    """key, on_land: exact where an island ring's box holds the point, by the raster elsewhere; a key may have several columns."""
    keys = [key] if isinstance(key, str) else key
    coarse = point_is_land(points.select(*keys, "lon", "lat").dropna(subset=keys), runs, cell)
    found = _by_rings(coarse, rings.where("is_island"), keys, F.max("on_land").alias("on_land"))
    return found.select(*keys, F.when(F.col("tested"), F.col("inside")).otherwise(F.col("on_land")).alias("on_land"))


def box_overlaps(boxes: DataFrame, rings: DataFrame, key: str, widest: float | None = None) -> DataFrame:
    """key of the boxes that touch a ring's box; with widest, of rings no longer than that either way."""
    r = rings.select(*[F.col(c).alias(f"r_{c}") for c in ("min_lon", "min_lat", "max_lon", "max_lat")])
    if widest is not None:
        r = r.where(F.greatest(F.col("r_max_lon") - F.col("r_min_lon"), F.col("r_max_lat") - F.col("r_min_lat")) <= widest)
    tiled = box_tiles(r, 8.0, ("r_min_lon", "r_min_lat", "r_max_lon", "r_max_lat"))
    hits = box_tiles(boxes.select(key, "min_lon", "min_lat", "max_lon", "max_lat"), 8.0).join(tiled, ["tx", "ty"])
    return hits.where("min_lon <= r_max_lon and max_lon >= r_min_lon and min_lat <= r_max_lat and max_lat >= r_min_lat").select(key).distinct()
