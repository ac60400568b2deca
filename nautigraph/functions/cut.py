"""Cutting lineage, so that plans stay short and lost executors cost little."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LOCAL = "file:///tmp/checkpoints/nautigraph"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of checkpoints: the cluster's spark.checkpoint.dir, or a local one under a local master; set if it isn't yet."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = LOCAL
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
