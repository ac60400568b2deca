"""Range joins and nearest neighbours by tile keys: every join has equality keys, none is a nested loop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cut import cut
from .nearest import Nearest


def tile(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("int")


def cover(low: Column, high: Column, size: float) -> Column:
    """The tiles from that of low to that of high."""
    return F.sequence(tile(low, size), tile(high, size))


def box_tiles(boxes: DataFrame, size: float, names: tuple[str, str, str, str] = ("min_lon", "min_lat", "max_lon", "max_lat")) -> DataFrame:
    """boxes with tx, ty: a row for each tile that a box touches."""
    x0, y0, x1, y1 = names
    wide = boxes.withColumn("tx", F.explode(cover(F.col(x0), F.col(x1), size)))
    return wide.withColumn("ty", F.explode(cover(F.col(y0), F.col(y1), size)))


def point_tiles(points: DataFrame, size: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    return points.withColumn("tx", tile(F.col(lon), size)).withColumn("ty", tile(F.col(lat), size))


#: Rows, or points of their rings, that a side of a join is sent to all tasks with at most, at some tens of bytes each.
SENT = 1_000_000


def sized(side: DataFrame, weight: Column | None = None, most: int = SENT) -> DataFrame:
    """side of a join, counted: sent to every task up to `most`, shuffled beyond, whatever its compressed bytes seem to be."""
    n = side.agg(F.coalesce(F.sum(F.lit(1) if weight is None else F.greatest(weight, F.lit(1))), F.lit(0))).first()[0]
    return F.broadcast(side) if n <= most else side.hint("merge")


#: Nodes that are held in memory at most to find the nearest, at 24 bytes each; with more, joins by tiles find them.
MEMORY_NODES = 2_000_000
#: Points in a task, and nodes around a point that a first look should meet.
POINTS, FIRST_LOOK = 2_000, 4_096


def nearest_k(points: DataFrame, nodes: DataFrame, k: int, key: str, most: int = MEMORY_NODES) -> DataFrame:
    """key, lon, lat (of points), node_id, node_lon, node_lat, d2, rk: the k nearest nodes in planar degrees.

    Ties go to the smaller node_id.  points: key, lon, lat with unique keys; nodes: node_id, lon, lat.  Nodes are
    counted first: up to `most` of them go to the tasks as a grid, more are met by joins on tiles.
    """
    points = points.select(key, "lon", "lat").where("lon is not null and lat is not null")
    return _by_grid(points, nodes, k, key) if nodes.count() <= most else _by_tiles(points, nodes, k, key)


def _by_grid(points: DataFrame, nodes: DataFrame, k: int, key: str) -> DataFrame:
    held = nodes.select("node_id", "lon", "lat").toPandas()
    grid = Nearest(held["node_id"].to_numpy(np.int64), held["lon"].to_numpy(float), held["lat"].to_numpy(float))
    shared = points.sparkSession.sparkContext.broadcast(grid)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        for whole in batches:
            for at in range(0, len(whole), 1000):
                b = whole.iloc[at : at + 1000]
                found = [g.find(x, y, k) for x, y in zip(b["lon"].tolist(), b["lat"].tolist())]
                sizes = [len(f[0]) for f in found]
                ids, d2, place = (np.concatenate(c) for c in zip(*found))
                out = b.loc[b.index.repeat(sizes)].reset_index(drop=True)
                yield out.assign(node_id=ids, node_lon=g.lon[place], node_lat=g.lat[place], d2=d2, rk=np.concatenate([np.arange(1, n + 1, dtype=np.int32) for n in sizes]))

    kind = points.schema[key].dataType.simpleString()
    dealt = points.repartition(max(1, min(-(-points.count() // POINTS), 20_000)))
    return dealt.mapInPandas(run, f"`{key}` {kind}, lon double, lat double, node_id long, node_lon double, node_lat double, d2 double, rk int")


def _by_tiles(points: DataFrame, nodes: DataFrame, k: int, key: str) -> DataFrame:
    """Points look at the tiles around them; those whose kth neighbour is not yet certain look at tiles of four times the area.

    The first tiles are so small that a point in the densest square degree meets about FIRST_LOOK nodes.
    """
    nodes = nodes.select("node_id", F.col("lon").alias("node_lon"), F.col("lat").alias("node_lat"))
    dense = point_tiles(nodes, 1.0, "node_lon", "node_lat").groupBy("tx", "ty").count().agg(F.max("count")).first()[0] or 1
    size = max(0.01, min(4.0, (FIRST_LOOK / (9 * dense)) ** 0.5))
    open_ = points
    done: list[DataFrame] = []
    while True:
        # one ring of tiles reaches at least `size` degrees in every direction
        tiles = point_tiles(nodes, size, "node_lon", "node_lat")
        around = F.array(F.lit(-1), F.lit(0), F.lit(1))
        near = point_tiles(open_, size).withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
        near = near.withColumn("tx", F.col("tx") + F.col("dx")).withColumn("ty", F.col("ty") + F.col("dy")).drop("dx", "dy")
        dx, dy = F.col("node_lon") - F.col("lon"), F.col("node_lat") - F.col("lat")
        hits = near.join(tiles, ["tx", "ty"]).drop("tx", "ty").withColumn("d2", dx * dx + dy * dy)
        w = Window.partitionBy(key).orderBy("d2", "node_id")
        best = hits.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)
        if size >= 720.0:
            done.append(best)
            break
        kth = best.groupBy(key).agg(F.max("d2").alias("far"), F.count("*").alias("n"))
        sure = kth.where((F.col("n") == k) & (F.col("far") < size * size)).select(key)
        best = best.transform(cut)
        sure = sure.transform(cut)
        done.append(best.join(sure, key, "left_semi"))
        open_ = open_.join(sure, key, "left_anti").transform(cut)
        if not open_.limit(1).count():
            break
        size = size * 2 if size * 2 < 32.0 else 720.0
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumn("rk", F.col("rk").cast("int"))
