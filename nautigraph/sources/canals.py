"""Waypoints of canals that land polygons close."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Canal centre lines, longitude and latitude from one end to the other.
CANALS = {
    "suez": [
        (32.3263, 31.2757), (32.3067, 31.2505), (32.3047, 31.2402), (32.3043, 31.2200), (32.3177, 30.8114), (32.3353, 30.7482), (32.3437, 30.7128),
        (32.3440, 30.7050), (32.3243, 30.6200), (32.3048, 30.5809), (32.3039, 30.5656), (32.3088, 30.5496), (32.3342, 30.5181), (32.3390, 30.5061),
        (32.3500, 30.4522), (32.3578, 30.4352), (32.3729, 30.3606), (32.4428, 30.2827), (32.5292, 30.2532), (32.5387, 30.2429), (32.5654, 30.2010),
        (32.5685, 30.1865), (32.5731, 30.0537), (32.5868, 29.9728), (32.5841, 29.9576), (32.5805, 29.9506), (32.5759, 29.9436), (32.5607, 29.9303),
    ],
    "panama": [
        (-79.917, 9.383), (-79.913, 9.360), (-79.907, 9.280), (-79.870, 9.210), (-79.820, 9.190), (-79.760, 9.160), (-79.710, 9.130),
        (-79.680, 9.090), (-79.640, 9.050), (-79.600, 9.020), (-79.580, 8.990), (-79.560, 8.960), (-79.540, 8.940), (-79.530, 8.900),
    ],
    "corinth": [
        (22.953, 37.941), (22.966, 37.938), (22.984, 37.935), (23.003, 37.918),
    ],
}


def rows() -> list[tuple[str, int, float, float]]:
    return [(name, k, lon, lat) for name, points in CANALS.items() for k, (lon, lat) in enumerate(points)]


def canals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "canal string, seq int, lon double, lat double")
