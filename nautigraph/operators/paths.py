"""Shortest costs by rounds over blocks of nodes: the form that needs no whole graph in memory."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cut import cut

#: Arcs, times sources, of a block; a task holds one block, at about 100 bytes each.
BLOCK = 2_000_000


def shortest_costs(sources: DataFrame, arcs: DataFrame, block: int = BLOCK) -> DataFrame:
    """source, node, cost: least cost from each source to every node that it reaches.

    sources: source, node (its start); arcs: src, dst, w >= 0, ids being numbers.  Nodes of neighbouring ids form blocks
    of about as many arcs.  A round settles, for all sources together, the blocks with a node whose cost fell in the round
    before: all their nodes, by Dijkstra's algorithm.  What costs to nodes of other blocks come to is told to those.
    Rounds end when nothing falls, so there are as many as a cheapest way passes from block to block, not as it has steps.
    """
    arcs = arcs.where("src is not null and dst is not null and w is not null").select("src", "dst", F.col("w").cast("double").alias("w"))
    blocks = -(-arcs.count() * sources.select("source").distinct().count() // block)
    bounds = _bounds(arcs, blocks)
    arcs = _in_block(_in_block(arcs, bounds, "src", "block"), bounds, "dst", "to")
    arcs = arcs.select("block", "src", "dst", "w", (F.col("to") == F.col("block")).alias("inside")).transform(cut)
    best = _in_block(sources.select("source", "node", F.lit(0.0).alias("cost"), F.lit(True).alias("fell")).distinct(), bounds, "node", "block").transform(cut)
    schema = f"source {sources.schema['source'].dataType.simpleString()}, node {sources.schema['node'].dataType.simpleString()}, cost double, own boolean"
    while open_ := [r[0] for r in best.where("fell").select("block").distinct().collect()]:
        here = F.col("block").isin(open_)
        told = best.where(here).groupBy("block").cogroup(arcs.where(here).groupBy("block")).applyInArrow(_settle, schema)
        every = best.select("source", "node", "cost", F.lit(True).alias("own")).unionByName(told)
        # what a block made of its own nodes is settled there; only what others tell it makes it look again
        own, new = (F.min(F.when(F.col("own") == mine, F.col("cost"))) for mine in (True, False))
        merged = every.groupBy("source", "node").agg(own.alias("mine"), new.alias("new"))
        fell = F.col("new").isNotNull() & (F.col("mine").isNull() | (F.col("new") < F.col("mine")))
        best = _in_block(merged.select("source", "node", F.least("mine", "new").alias("cost"), fell.alias("fell")), bounds, "node", "block").transform(cut)
    return best.select("source", "node", "cost")


def _bounds(arcs: DataFrame, blocks: int) -> list[float]:
    """Ids between which about as many arcs begin; any would do, so an approximation does."""
    if blocks < 2:
        return []
    found = arcs.agg(F.percentile_approx("src", [k / blocks for k in range(1, blocks)], max(10_000, 10 * blocks))).first()[0]
    return sorted({float(b) for b in found or []})


def _in_block(df: DataFrame, bounds: list[float], node: str, name: str) -> DataFrame:
    """df with the block of a node; nodes that are null have one of their own."""
    if not bounds:
        return df.withColumn(name, F.col(node).isNull().cast("double"))
    from pyspark.ml.feature import Bucketizer

    return Bucketizer(splits=[-np.inf, *bounds, np.inf], inputCol=node, outputCol=name, handleInvalid="keep").transform(df)


def _settle(state: pa.Table, arcs: pa.Table) -> pa.Table:
    """Costs of a block's nodes that fell (own), and of nodes of other blocks by way of those."""
    target = pa.schema([state.schema.field("source"), state.schema.field("node"), pa.field("cost", pa.float64()), pa.field("own", pa.bool_())])
    if not arcs.num_rows:
        return target.empty_table()
    src, dst, w, inside = (arcs[c].to_numpy() for c in ("src", "dst", "w", "inside"))
    node, cost, fell = (state[c].to_numpy() for c in ("node", "cost", "fell"))
    ids = np.unique(np.concatenate([src, dst[inside], node]))
    order = np.argsort(src[inside], kind="stable")
    first = np.searchsorted(src[inside][order], ids).tolist() + [len(order)]
    to, length = np.searchsorted(ids, dst[inside][order]).tolist(), w[inside][order].tolist()
    out_src, out_dst, out_w = np.searchsorted(ids, src[~inside]), dst[~inside], w[~inside]
    source = state["source"].combine_chunks()
    names = source.dictionary_encode(null_encoding="encode")
    which = names.indices.to_numpy()
    parts = []
    for s in np.unique(which):
        mine = which == s
        at = np.searchsorted(ids, node[mine])
        before = np.full(len(ids), np.inf)
        before[at] = cost[mine]
        costs = before.tolist()
        heap = [(costs[k], k) for k in at[fell[mine]].tolist()]
        heapq.heapify(heap)
        moved = np.zeros(len(ids), bool)
        moved[at[fell[mine]]] = True
        while heap:
            here, k = heapq.heappop(heap)
            if here > costs[k]:
                continue
            for i in range(first[k], first[k + 1]):
                if (new := here + length[i]) < costs[to[i]]:
                    costs[to[i]] = new
                    heapq.heappush(heap, (new, to[i]))
        after = np.array(costs)
        own = np.flatnonzero(after < before)
        moved[own] = True
        going = np.flatnonzero(moved[out_src])
        far, place = np.unique(out_dst[going], return_inverse=True)
        least = np.full(len(far), np.inf)
        np.minimum.at(least, place, after[out_src[going]] + out_w[going])
        n = len(own) + len(far)
        name = names.dictionary.take(pa.array(np.full(n, s)))
        columns = [name, np.concatenate([ids[own], far]), np.concatenate([after[own], least]), np.arange(n) < len(own)]
        parts.append(pa.table([pa.array(c).cast(f.type) if isinstance(c, np.ndarray) else c.cast(f.type) for c, f in zip(columns, target)], target))
    return pa.concat_tables(parts)
