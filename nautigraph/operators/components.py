"""Connected components by alternating large and small stars, each round kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cut import cut


def _toward_least(links: DataFrame) -> DataFrame:
    """Every link's larger end goes to the least neighbour of its smaller end."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _flat(links: DataFrame) -> DataFrame:
    """Every node's smaller neighbours and itself go to the least of them; links must point downwards."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def stars(links: DataFrame, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """a, b: for every node of links(a, b) that isn't the least of its component that least node.

    Self-links and null ends are passed over.  The number of rounds grows with the logarithm of the longest path;
    each is kept, so neither plans nor lost executors reach further back.
    """
    links = links.where("a is not null and b is not null and a <> b")
    links = keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if not state[0] or state == seen:
            return links
        seen = state
        links = keep(_flat(_toward_least(links)))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, comp: comp is the least node_id of the component; a node without edges is one of its own."""
    root = stars(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).select(F.col("a").alias("node_id"), F.col("b").alias("comp"))
    return nodes.select("node_id").join(root, "node_id", "left").select("node_id", F.coalesce("comp", "node_id").alias("comp"))


def component_sizes(comps: DataFrame) -> DataFrame:
    return comps.groupBy("comp").agg(F.count("*").alias("n"))


def main_component(comps: DataFrame) -> int | None:
    """The largest component; of equally large ones that of the larger least node."""
    r = component_sizes(comps).agg(F.max_by("comp", F.struct("n", "comp"))).first()
    return r[0] if r else None
