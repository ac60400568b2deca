"""The adaptive water grid: a linear quadtree over the world, cells as (depth, ix, iy)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import semantics as S
from ..functions.cut import cut
from ..plans.landindex import LandIndex, land_shared

_CELL = "depth int, ix int, iy int"


def bounds(df: DataFrame) -> DataFrame:
    """df with min_lon, min_lat, max_lon, max_lat of its cells: exact, as they're halves of halves."""
    n = F.pow(F.lit(2.0), F.col("depth"))
    at = lambda c, k, low, span: low + (F.col(c) + k) * span / n
    return df.withColumns({"min_lon": at("ix", 0, -180.0, 360.0), "min_lat": at("iy", 0, -90.0, 180.0), "max_lon": at("ix", 1, -180.0, 360.0), "max_lat": at("iy", 1, -90.0, 180.0)})


def children(cells: DataFrame) -> DataFrame:
    two = F.array(F.lit(0), F.lit(1))
    kids = cells.select("depth", "ix", "iy").withColumn("dx", F.explode(two)).withColumn("dy", F.explode(two))
    return kids.select((F.col("depth") + 1).alias("depth"), (F.col("ix") * 2 + F.col("dx")).alias("ix"), (F.col("iy") * 2 + F.col("dy")).alias("iy"))


def _typed(cells: pd.DataFrame, land: LandIndex, deepest: int) -> pd.DataFrame:
    d, x, y = (cells[c].to_numpy(np.int64) for c in ("depth", "ix", "iy"))
    kinds = land.cell_kinds(d, x, y)
    last = np.flatnonzero((kinds == "mixed") & (d >= deepest))
    w, h = 360.0 / 2.0 ** d[last], 180.0 / 2.0 ** d[last]
    kinds[last] = np.where(land.is_land(-180.0 + (x[last] + 0.5) * w, -90.0 + (y[last] + 0.5) * h), "land", "water")
    return cells.assign(type=kinds)


def classify(cells: DataFrame, land: LandIndex, deepest: int) -> DataFrame:
    """depth, ix, iy, type: water, land or mixed; at the deepest level a mixed cell is what its centre is."""
    shared = land_shared(cells.sparkSession, land)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _typed(b, shared.value, deepest)

    return cells.select("depth", "ix", "iy").mapInPandas(run, f"{_CELL}, type string")


#: Cells of a level that the driver looks at itself; levels grow from a single cell.
FEW = 20_000
#: Cells of a level in a task.
CELLS = 2_000


def build(spark: SparkSession, land: LandIndex, deepest: int = S.DEFAULT_DEPTH, start: int = 0) -> DataFrame:
    """All leaves (depth, ix, iy, type) from the cells of depth `start` down: in one round a level, mixed cells give way to their four parts.

    The driver, which holds the land anyhow, goes down to the level of FEW cells; the rest are jobs.
    """
    side = np.arange(2**start)
    level = pd.DataFrame({"depth": start, "ix": np.repeat(side, len(side)), "iy": np.tile(side, len(side))})
    few = [level.head(0).assign(type="")]
    while len(level) and len(level) <= FEW:
        typed = _typed(level, land, deepest)
        few.append(typed[typed["type"] != "mixed"])
        mixed = typed[typed["type"] == "mixed"]
        level = pd.concat([mixed[["depth"]].assign(ix=2 * mixed["ix"] + a, iy=2 * mixed["iy"] + b) for a in (0, 1) for b in (0, 1)])
        level["depth"] += 1
    leaves = [spark.createDataFrame(pd.concat(few), f"{_CELL}, type string")]
    if len(level):
        cells = spark.createDataFrame(level, _CELL)
        n = len(level)
        for _ in range(int(level["depth"].iloc[0]), deepest + 1):
            typed = classify(cells.repartition(max(1, min(-(-n // CELLS), 20_000))), land, deepest).transform(cut)
            leaves.append(typed.where("type <> 'mixed'"))
            mixed = typed.where("type = 'mixed'")
            n = 4 * mixed.count()
            if not n:
                break
            cells = children(mixed)
    out = leaves[0]
    for x in leaves[1:]:
        out = out.unionByName(x)
    return out


def neighbours(df: DataFrame, dys: tuple[int, ...] = (-1, 0, 1)) -> DataFrame:
    """df with nx, ny: the cells of the same depth around each, within the world, dateline not crossed."""
    side = F.pow(F.lit(2.0), F.col("depth")).cast("int")
    out = df.withColumn("dx", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)]))).withColumn("dy", F.explode(F.array(*[F.lit(k) for k in dys])))
    out = out.where("dx <> 0 or dy <> 0").withColumn("nx", F.col("ix") + F.col("dx")).withColumn("ny", F.col("iy") + F.col("dy"))
    return out.where((F.col("nx") >= 0) & (F.col("ny") >= 0) & (F.col("nx") < side) & (F.col("ny") < side)).drop("dx", "dy")


def up(x: Column | str, levels: Column) -> Column:
    """A cell number so many levels up."""
    return F.floor(F.col(x) / F.pow(F.lit(2.0), levels)).cast("int") if isinstance(x, str) else F.floor(x / F.pow(F.lit(2.0), levels)).cast("int")


def coarsen_level(leaves: DataFrame, depth: int) -> DataFrame:
    """Leaves after merging, at one depth, four water siblings of which none has land within a tenth of its width."""
    water = leaves.where((F.col("type") == "water") & (F.col("depth") == depth))
    parent = [F.floor(F.col(c) / 2).cast("int").alias(f"p{c[1]}") for c in ("ix", "iy")]
    kids = water.select("depth", "ix", "iy", *parent)
    full = _water_quads(leaves, depth)
    kids = kids.join(full, ["px", "py"])
    land = leaves.where("type = 'land'").select("depth", "ix", "iy")
    # land of the same depth or deeper, by its ancestor of this depth; the tenth is tested on its own box
    fine = bounds(land.where(F.col("depth") >= depth)).withColumn("nx", up("ix", F.col("depth") - depth)).withColumn("ny", up("iy", F.col("depth") - depth))
    fine = fine.select("nx", "ny", *[F.col(c).alias(f"l_{c}") for c in ("min_lon", "min_lat", "max_lon", "max_lat")])
    around = neighbours(bounds(kids))
    eps = (F.col("max_lon") - F.col("min_lon")) * S.COARSEN_EPS
    hit = around.join(fine, ["nx", "ny"]).where(
        (F.col("l_min_lon") <= F.col("max_lon") + eps) & (F.col("l_max_lon") >= F.col("min_lon") - eps) & (F.col("l_min_lat") <= F.col("max_lat") + eps) & (F.col("l_max_lat") >= F.col("min_lat") - eps)
    ).select("px", "py")
    # coarser land that holds a neighbouring cell touches
    coarse = land.where(F.col("depth") < depth).select(F.col("depth").alias("d"), F.col("ix").alias("lx"), F.col("iy").alias("ly"))
    ups = around.select("px", "py", "nx", "ny", F.explode(F.sequence(F.lit(0), F.lit(max(depth - 1, 0)))).alias("d")) if depth else around.withColumn("d", F.lit(0)).limit(0)
    ups = ups.withColumn("lx", up("nx", F.lit(depth) - F.col("d"))).withColumn("ly", up("ny", F.lit(depth) - F.col("d")))
    touch = ups.join(coarse, ["d", "lx", "ly"]).select("px", "py")
    merged = full.join(hit.unionByName(touch).distinct(), ["px", "py"], "left_anti")
    gone = kids.join(merged, ["px", "py"]).select("depth", "ix", "iy")
    kept = leaves.join(gone, ["depth", "ix", "iy"], "left_anti")
    return kept.unionByName(merged.select(F.lit(depth - 1).alias("depth"), F.col("px").alias("ix"), F.col("py").alias("iy"), F.lit("water").alias("type")))


def coarsen(leaves: DataFrame, deepest: int = S.DEFAULT_DEPTH) -> DataFrame:
    """One sweep from the deepest level up: land never changes, so a second one would find nothing."""
    leaves = leaves.transform(cut)
    water = leaves.where("type = 'water' and depth > 0").groupBy("depth", F.floor(F.col("ix") / 2), F.floor(F.col("iy") / 2)).count()
    full = {r[0] for r in water.where("count = 4").select("depth").distinct().collect()}
    for depth in range(deepest, 0, -1):
        if depth not in full:
            continue
        before = leaves
        leaves = coarsen_level(before, depth).transform(cut)
        above = (F.col("type") == "water") & (F.col("depth") == depth - 1)
        if depth > 1 and _water_quads(leaves.where(above), depth - 1).limit(1).count():
            full.add(depth - 1)
    return leaves


def _water_quads(leaves: DataFrame, depth: int) -> DataFrame:
    """px, py: parents of four water leaves of a depth."""
    water = leaves.where((F.col("type") == "water") & (F.col("depth") == depth))
    px, py = (F.floor(F.col(c) / 2).cast("int").alias(n) for c, n in (("ix", "px"), ("iy", "py")))
    return water.groupBy(px, py).count().where("count = 4").select("px", "py")


def leaf_counts(leaves: DataFrame) -> DataFrame:
    return leaves.groupBy("type").agg(F.count("*").alias("n"))


def water_leaves(leaves: DataFrame, deepest: int = S.DEFAULT_DEPTH) -> DataFrame:
    """node_id, depth, ix, iy and bounds of water leaves, ids by place: north-east first at every level.

    Ids come from ranges of the place and not from one window over everything.
    """
    digits = F.concat(*[F.when(F.col("depth") > k, _digit(k)).otherwise(F.lit("0")) for k in range(deepest)]) if deepest else F.lit("0")
    water = leaves.where("type = 'water'").withColumn("place", digits).repartitionByRange(F.desc("place"))
    w = water.sortWithinPartitions(F.desc("place")).withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id()).transform(cut)
    before, at = [], 0
    for part, n in sorted(tuple(r) for r in w.groupBy("part").count().collect()):
        before.append((part, at))
        at += n
    offsets = leaves.sparkSession.createDataFrame(before or [(0, 0)], "part int, before long")
    ids = w.join(F.broadcast(offsets), "part").withColumn("node_id", F.col("before") + F.col("nth") - F.col("part").cast("long") * F.lit(1 << 33))
    return bounds(ids.select("node_id", "depth", "ix", "iy"))


def _digit(level: int) -> Column:
    """The quarter that a cell lies in at a level: 0 south-west, 1 south-east, 2 north-west, 3 north-east."""
    bit = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("depth") - 1 - level)).cast("int") % 2
    return (bit("iy") * 2 + bit("ix")).cast("string")


def nodes(leaves: DataFrame) -> DataFrame:
    return leaves.select("node_id", ((F.col("min_lon") + F.col("max_lon")) / 2).alias("lon"), ((F.col("min_lat") + F.col("max_lat")) / 2).alias("lat"), "depth")
