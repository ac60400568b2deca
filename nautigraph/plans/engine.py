"""The engine: build a graph from land, answer batches of requests, write GeoJSON."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import semantics as S
from ..functions.cut import cut
from ..functions.geo import truncated
from ..operators import graph as G
from ..operators import land as L
from ..operators import quadtree as Q
from ..sources import canals as C
from ..sources import geojson, graphs, requests
from . import routing
from .landindex import LandIndex, build_index

_LINE = "array<struct<lon:double,lat:double>>"
_ROUTE = f"req_id long, raw {_LINE}, los {_LINE}, final {_LINE}, cost_km double, nodes_explored long, legs int, time_ms double, error string"


#: The smoke request.
HEALTH = "0,51", "1,51"
#: Legs of requests in a task, and requests that are answered together: each one's time is its share.
LEGS, TOGETHER = 256, 128


@dataclass
class Engine:
    """A graph with its land, ready for requests."""

    spark: SparkSession
    nodes: DataFrame
    edges: DataFrame
    land: LandIndex
    semantics: S.Semantics = S.DEFAULT
    counts: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._shared = None

    @classmethod
    def generate(cls, rings: DataFrame, depth: int = S.DEFAULT_DEPTH, cell: float = S.RASTER_CELL, canals: bool = True, coarsen: bool = True, semantics: S.Semantics = S.DEFAULT, raster: str | None = None) -> Engine:
        """Rings (ring_id, pts, boxes) to a graph: raster, quadtree, coarsening, edges.

        raster: a file that keeps the raster of this very land for the next time; failure to write it is a warning.
        `counts` of the engine has leaves by type, edges tested and dropped, and the like.
        """
        spark = rings.sparkSession
        if semantics.holes_are_islands or "is_hole" not in rings.columns:
            islands = rings
        else:
            islands = rings.withColumn("is_island", F.col("is_island") & ~F.col("is_hole"))
        land = build_index(islands, kept_raster(rings, cell, raster), cell)
        counts: dict[str, int] = {}
        leaves = Q.build(spark, land, depth)
        counts |= {f"{r['type']} leaves": r["n"] for r in Q.leaf_counts(leaves).collect()}
        if coarsen:
            leaves = Q.coarsen(leaves, depth)
            after = {r["type"]: r["n"] for r in Q.leaf_counts(leaves).collect()}
            counts["merges"] = (counts.get("water leaves", 0) - after.get("water", 0)) // 3  # four become one
        nodes, edges = G.build(Q.water_leaves(leaves, depth), land, C.canals(spark) if canals else None, semantics, counts)
        engine = cls(spark, nodes.transform(cut), edges.transform(cut), land, semantics)
        engine.counts = counts | {"nodes": engine.nodes.count(), "edges": engine.edges.count()}
        return engine

    @classmethod
    def from_geojson(cls, spark: SparkSession, path: str | Sequence[str], **options) -> Engine:
        """From the first of some GeoJSON files that is there: the detailed one before the coarse."""
        return cls.generate(geojson.land_rings(spark, geojson.land_file(spark, path)), **options)

    def save(self, path: str) -> None:
        graphs.write_graph(self.nodes, self.edges, path)

    def healthy(self) -> bool:
        """Whether the smoke request, due east along 51 degrees north, is answered, by a route or by stating that there is none."""
        asked = self.spark.createDataFrame([(0, HEALTH[0], HEALTH[1], None)], "req_id long, from string, to string, penalty double")
        answer = json.loads(to_geojson(self.routes(requests.single(asked))).first()["value"])
        return answer.get("type") == "FeatureCollection" or answer == {"error": "No route found"}

    def routes(self, asked: DataFrame) -> DataFrame:
        """Requests (req_id, ports, penalty, error) to lines, cost, nodes explored, legs and error; a row each.

        Requests with an error pass it on.  Requests are few bytes and much work, so they are counted and dealt out
        by number, LEGS legs to a task; within a task those of one penalty follow each other.  Those of a stream are
        answered where they are.
        """
        if self._shared is None:
            self._shared = self.spark.sparkContext.broadcast((routing.load(*graphs_rounded(self.nodes, self.edges)), self.land))
        shared, semantics = self._shared, self.semantics

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            g, land = shared.value
            for whole in batches:
                for at in range(0, len(whole), TOGETHER):
                    yield answered(whole.iloc[at : at + TOGETHER], g, land)

        def answered(b: pd.DataFrame, g: routing.Graph, land: LandIndex) -> pd.DataFrame:
            began = time.perf_counter()
            calls = [([(p["lon"], p["lat"]) for p in ports], float(penalty)) for ports, penalty, error in zip(b["ports"], b["penalty"], b["error"]) if error is None]
            found = iter(routing.itineraries(g, land, calls, semantics))
            rows = []
            for req, error in zip(b["req_id"], b["error"]):
                r = next(found) if error is None else {"raw": [], "los": [], "final": [], "cost_km": 0.0, "explored": 0, "legs": 0, "error": error}
                lines = [[{"lon": float(x), "lat": float(y)} for x, y in r[k]] for k in ("raw", "los", "final")]
                rows.append((req, *lines, r["cost_km"], r["explored"], r["legs"], r["error"]))
            out = pd.DataFrame(rows, columns=["req_id", "raw", "los", "final", "cost_km", "nodes_explored", "legs", "error"])
            return out.assign(time_ms=(time.perf_counter() - began) * 1000 / len(b))[[c.split()[0] for c in _ROUTE.split(", ")]]

        rows = asked.select("req_id", "ports", "penalty", "error")
        if not rows.isStreaming:
            legs = rows.agg(F.sum(F.greatest(F.size("ports") - 1, F.lit(1)))).first()[0] or 0
            rows = rows.repartition(max(1, min(-(-legs // LEGS), 20_000))).sortWithinPartitions("penalty")
        return rows.mapInPandas(run, _ROUTE)


def kept_raster(rings: DataFrame, cell: float, path: str | None) -> DataFrame:
    """Runs of the raster of rings: read from the file at path if there is one of this kind, else made and written there."""
    spark = rings.sparkSession
    if path and (held := graphs.read_raster(spark, path, cell)) is not None:
        return spark.createDataFrame(pd.DataFrame(held, columns=["row", "col_start", "col_end"]).astype("int32"))
    runs = L.raster_runs(L.ring_edges(rings), cell).transform(cut)
    if path:
        try:
            graphs.write_raster(spark, runs.select("row", "col_start", "col_end").toPandas().to_numpy(), path, cell)
        except Exception as e:  # noqa: BLE001  py4j raises plain exceptions; the raster itself is there
            logging.getLogger(__name__).warning("the raster was not written to %s: %s", path, e)
    return runs


def graphs_rounded(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as a graph file gives them back."""
    n, e = graphs.pack(nodes, edges)
    return n, e.select("src", "dst", (F.col("weight10") / 10.0).alias("weight_km"))


def to_geojson(routes: DataFrame) -> DataFrame:
    """req_id, value: a FeatureCollection of the lines as JSON, or {"error": ...}."""
    props = {"distanceKm": truncated(F.col("cost_km")), "nodesExplored": F.col("nodes_explored"), "timeMs": truncated(F.col("time_ms")), "legs": F.when(F.col("legs") > 1, F.col("legs"))}
    parts = [geojson.feature(F.lit(k), F.col(k), props if k == "raw" else None, line=k) for k in ("raw", "los", "final")]
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",", *[F.to_json(p) for p in parts]), F.lit("]}"))
    error = F.to_json(F.struct("error"))
    return routes.select("req_id", F.when(F.col("error").isNull(), text).otherwise(error).alias("value"))
