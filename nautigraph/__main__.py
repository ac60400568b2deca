"""python -m nautigraph generate LAND OUT [DEPTH] | routes OUT LAND REQUESTS ANSWERS | route OUT LAND FROM TO [PENALTY] | health OUT LAND

LAND is a GeoJSON file of land, or several with commas between: the first that is there counts.  generate builds a
graph from it and writes its tables and raster.  routes answers a JSON-lines file of {"req_id": ..., "body": "{...}"}
or {"req_id": ..., "from": "lon,lat", "to": "lon,lat", "penalty": ...} with that graph and writes GeoJSON rows; route
answers one request and prints it; health says whether the smoke request is answered.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from . import semantics as S
from .plans.engine import Engine, kept_raster, to_geojson
from .plans.landindex import build_index
from .sources import geojson, graphs, requests


def _engine(spark: SparkSession, out: str, land: str) -> Engine:
    rings = geojson.land_rings(spark, geojson.land_file(spark, land.split(",")))
    return Engine(spark, *graphs.read_graph(spark, out), build_index(rings, kept_raster(rings, S.RASTER_CELL, f"{out}/raster.bin")))


def main(args: list[str]) -> int:
    command, rest = (args[0], args[1:]) if args else ("", [])
    wanted = {"generate": (2, 3), "routes": (4,), "route": (4, 5), "health": (2,)}
    if len(rest) not in wanted.get(command, ()):
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("nautigraph").getOrCreate()
    if command == "generate":
        engine = Engine.from_geojson(spark, rest[0].split(","), depth=int(rest[2]) if len(rest) == 3 else S.DEFAULT_DEPTH, raster=f"{rest[1]}/raster.bin")
        engine.save(rest[1])
        print(", ".join(f"{n} {k}" for k, n in engine.counts.items()), file=sys.stderr)
        return 0
    engine = _engine(spark, rest[0], rest[1])
    if command == "health":
        return 0 if engine.healthy() else 1
    if command == "route":
        asked = spark.createDataFrame([(0, rest[2], rest[3], float(rest[4]) if len(rest) == 5 else None)], "req_id long, from string, to string, penalty double")
        print(to_geojson(engine.routes(requests.single(asked))).first()["value"])
        return 0
    rows = spark.read.schema("req_id long, body string, from string, to string, penalty double").json(rest[2])
    asked = requests.multi(rows.where("body is not null")).unionByName(requests.single(rows.where("body is null")))
    to_geojson(engine.routes(asked)).write.parquet(rest[3])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
