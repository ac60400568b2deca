"""Graphs as Parquet tables, and to and from the flat JSON form; rasters in the binary form."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import semantics as S
from ..functions.geo import packed_coordinate, packed_weight

# Fixed values of the raster file: its mark and version.
RASTER_MARK, RASTER_VERSION = 0x5345415F52415354, 3


def pack(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes to five decimals, edge weights to tenths of a km."""
    n = nodes.select("node_id", packed_coordinate(F.col("lon")).alias("lon"), packed_coordinate(F.col("lat")).alias("lat"), "depth")
    return n, edges.select("src", "dst", packed_weight(F.col("weight_km")).alias("weight10"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    n, e = pack(nodes, edges)
    n.write.mode("overwrite").parquet(f"{path}/nodes")
    e.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    e = spark.read.parquet(f"{path}/edges")
    return spark.read.parquet(f"{path}/nodes"), e.select("src", "dst", (F.col("weight10") / 10.0).alias("weight_km"))


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, column value: the graph as {nodeCount, edgeCount, nodes, edges} with flat arrays of three numbers each.

    The form is one document by its nature, so this is for exchange; Parquet is what scales.
    """
    n, e = pack(nodes, edges)
    flat = lambda df, key, cols, name: df.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(*key, F.array(*[F.col(c).cast("double") for c in cols]).alias("v")))), lambda x: x["v"])).alias(name), F.count("*").alias(f"{name[:-1]}Count"))
    a = flat(n, ["node_id"], ["lon", "lat", "depth"], "nodes")
    b = flat(e, ["src", "dst", "weight10"], ["src", "dst", "weight10"], "edges")
    return a.crossJoin(b).select(F.to_json(F.struct("nodeCount", "edgeCount", "nodes", "edges")).alias("value"))


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a flat JSON graph."""
    doc = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "nodes array<double>, edges array<double>").alias("g"))
    at = lambda name, k: F.element_at(f"g.{name}", 3 * F.col("i").cast("int") + k)
    index = lambda name: doc.where(F.size(f"g.{name}") >= 3).select("g", F.explode(F.sequence(F.lit(0), F.floor(F.size(f"g.{name}") / 3).cast("int") - 1)).alias("i"))
    nodes = index("nodes").select(F.col("i").cast("long").alias("node_id"), at("nodes", 1).alias("lon"), at("nodes", 2).alias("lat"), at("nodes", 3).cast("int").alias("depth"))
    edges = index("edges").select(at("edges", 1).cast("long").alias("src"), at("edges", 2).cast("long").alias("dst"), (at("edges", 3) / 10.0).alias("weight_km"))
    return nodes, edges


def raster_bytes(runs: np.ndarray, cell: float = S.RASTER_CELL) -> bytes:
    """Runs (row, start, end) as the binary raster: a header, then one bit a cell, row by row, in 64-bit words."""
    rows, cols = S.raster_shape(cell)
    bits = np.zeros(-(-rows * cols // 64) * 64, np.int8)
    start, end = (runs[:, 0] * cols + runs[:, k] for k in (1, 2))
    step = np.zeros(len(bits) + 1, np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    bits[:] = np.cumsum(step)[:-1] > 0
    words = np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()
    return struct.pack("<QII", RASTER_MARK, RASTER_VERSION, len(words) // 8) + words


def raster_runs_of(data: bytes, cell: float = S.RASTER_CELL) -> np.ndarray:
    """Runs (row, start, end) of a binary raster; a wrong mark, version or length is an error."""
    rows, cols = S.raster_shape(cell)
    mark, version, words = struct.unpack_from("<QII", data)
    if mark != RASTER_MARK or version != RASTER_VERSION or len(data) != 16 + 8 * words or words != -(-rows * cols // 64):
        raise ValueError("not a raster of this version")
    bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=16), bitorder="little")[: rows * cols].reshape(rows, cols)
    edge = np.diff(bits.astype(np.int8), axis=1, prepend=0, append=0)
    row, start = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return np.stack([row, start, end], axis=1)


def write_raster(spark: SparkSession, runs: np.ndarray, path: str, cell: float = S.RASTER_CELL) -> None:
    """The binary raster as a file at path, on any file system that Spark knows."""
    out = _file(spark, path)[0].create(_file(spark, path)[1], True)
    try:
        out.write(bytearray(raster_bytes(runs, cell)))
    finally:
        out.close()


def read_raster(spark: SparkSession, path: str, cell: float = S.RASTER_CELL) -> np.ndarray | None:
    """Runs of the raster file at path; None if there is none or it is of another kind, as it can be made anew."""
    if not exists(spark, path):
        return None
    data = spark.read.format("binaryFile").load(path).select("content").first()[0]
    try:
        return raster_runs_of(bytes(data), cell)
    except (ValueError, struct.error):
        return None


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file(spark, path)
    return bool(fs.exists(where))


def _file(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where
