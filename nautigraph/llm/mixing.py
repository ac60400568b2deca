"""Mixing sources to target weights by cube-method balanced sampling.

A source's target over its size says how often each of its documents is wanted on average: every document
is taken floor(m) times, and once more with probability m - floor(m).  The cube method decides on the extra
copies so that each source's token and document totals stay balanced: in the flight, the probabilities of
three undecided documents move along the null space of the two constraints until one of them is 0 or 1; at
most two stay undecided.  Flights run over buckets of a source; those left over and a few small documents,
held back to fit, meet in fewer buckets, level by level.  In the last bucket of a source the landing gives up
the document total, and at the very end the token total.

No step depends on how rows are partitioned: buckets and their order follow hashes of the rows.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, written

#: Source weights by rank, repeating; most times that a source may be repeated; documents in a bucket.
WEIGHTS = (5.0, 2.0, 1.0)
REPEAT = 3.0
BUCKET = 4096
#: Smallest documents of a bucket that stay out of its flight: they go up with those left over and fit the landing's total.
SPARE = 32
#: Sources whose targets the driver works out; those of more are worked out in jobs, to the same rule.
FEW_SOURCES = 100_000
SIZE = r"[^\x20\x09-\x0D]+"
_EPS = 1e-9


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, repeat: float = REPEAT) -> dict[str | None, float]:
    """Shares of the total by weight, none above `repeat` times its source; what is cut off is shared again."""
    ranked = sorted(sizes, key=lambda s: (s is None, s or ""))  # Python orders strings by code point
    weight = {s: weights[k % len(weights)] for k, s in enumerate(ranked)}
    out: dict[str | None, float] = {}
    rest, open_ = float(sum(sizes.values())), list(ranked)
    while open_:
        total = math.fsum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / total > repeat * sizes[s]]
        if not over:
            out |= {s: rest * weight[s] / total for s in open_}
            break
        out |= {s: repeat * sizes[s] for s in over}
        rest -= math.fsum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def _targets_in_jobs(sizes: DataFrame, weights: tuple[float, ...], repeat: float) -> DataFrame:
    """source, size, n, rank, target of sizes (source, size, n), by targets()'s rule, for any number of sources.

    Ranks come from ranges of the sorted sources.  A source is cut off once the share of a unit of weight passes its
    limit; the share only rises, so each round needs just the sums of those that are over and of those that aren't.
    """
    order = [F.col("source").isNull(), "source"]
    ranged = sizes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id())
    ranged = written(ranged, "mix-sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = ranged.groupBy("part").agg(F.count("*").alias("c"), F.min("nth").alias("low")).withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
    ranked = ranged.join(F.broadcast(starts.select("part", "low", "before")), "part").withColumn("rank", F.col("before") + F.col("nth") - F.col("low"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = written(ranked.select("source", "size", "n", "rank", weight.alias("weight")), "mix-ranks")
    total = float(ranked.agg(F.sum("size")).first()[0] or 0)
    limit, share, count = F.lit(repeat) * F.col("size"), 0.0, -1
    while True:
        over = F.lit(False) if count < 0 else F.lit(share) * F.col("weight") > limit
        cut, kept, n = ranked.agg(F.sum(F.when(over, limit)), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).first()
        if n == count or not kept:
            break
        count, share = n, (total - (cut or 0.0)) / kept
    return ranked.select("source", "size", "n", "rank", F.least(F.lit(share) * F.col("weight"), limit).alias("target"))


def settle_large(p: np.ndarray, size: np.ndarray, rnd: random.Random) -> None:
    """Decide on the largest fiftieth one by one, each step moving all other undecided documents a little.

    The step lies in the null space too: with w = p (1 - p), the others move by w (x + y size), x and y such
    that both totals hold.  A window of three would move a large document by so little that it'd stay undecided.
    """
    for i in np.argsort(-size, kind="stable")[: -(-len(p) // 50)]:
        for _ in range(8):
            if not _EPS < p[i] < 1 - _EPS:
                break
            w = p * (1 - p)
            w[(p <= _EPS) | (p >= 1 - _EPS)] = 0
            w[i] = 0
            a = np.array([[w.sum(), (w * size).sum()], [(w * size).sum(), (w * size * size).sum()]])
            if (w > 0).sum() < 8 or abs(np.linalg.det(a)) < 1e-9 * max(a[0, 0] * a[1, 1], 1e-300):
                break
            x, y = np.linalg.solve(a, [1.0, size[i]])
            u = -w * (x + y * size)
            u[i] = 1.0
            with np.errstate(divide="ignore", invalid="ignore"):
                to_one, to_zero = (1 - p) / np.abs(u), p / np.abs(u)
            on = u != 0
            up = np.where(u > 0, to_one, to_zero)[on].min()
            down = np.where(u > 0, to_zero, to_one)[on].min()
            p += u * (up if rnd.random() * (up + down) < down else -down)
            p[p < _EPS], p[p > 1 - _EPS] = 0.0, 1.0


def flight(p: list[float], size: list[float], rnd: random.Random) -> list[int]:
    """Move p in place until at most two entries are undecided; returns those."""
    held: list[int] = []
    for k in range(len(p)):
        if _EPS < p[k] < 1 - _EPS:
            held.append(k)
            if len(held) == 3:
                a, b, c = (size[i] for i in held)
                _move(p, held, (b - c, c - a, a - b) if a != b or b != c else (1.0, -1.0, 0.0), rnd)
                held = [i for i in held if _EPS < p[i] < 1 - _EPS]
    return held


def landing(p: list[float], size: list[float], held: list[int], rnd: random.Random) -> None:
    """Decide on the last ones, the largest first: pairs with the token total kept, then one by its probability.

    A large document pairs with small ones until it is decided, so the one at the end is small.
    """
    one: int | None = None
    for i in sorted(held, key=lambda i: -size[i]):
        if not _EPS < p[i] < 1 - _EPS:
            continue
        if one is not None:
            a, b = size[one], size[i]
            _move(p, [one, i], (b, -a) if a and b else (1.0, -1.0) if a == b else (0.0, 1.0), rnd)
        one = next((j for j in (one, i) if j is not None and _EPS < p[j] < 1 - _EPS), None)
    if one is not None:
        p[one] = float(rnd.random() < p[one])


def _move(p: list[float], at: list[int], u: Iterable[float], rnd: random.Random) -> None:
    """One step along u or against it, as far as the cube goes, by chances that keep every mean."""
    moves = [(i, x) for i, x in zip(at, u) if x]
    up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in moves)
    down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in moves)
    step = up if rnd.random() * (up + down) < down else -down
    for i, x in moves:
        p[i] += step * x
        if p[i] < _EPS or p[i] > 1 - _EPS:
            p[i] = float(round(p[i]))


def _round(level: int, last: bool):
    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "doc_id", "size", "nth"], kind="stable", na_position="last")
        rnd = random.Random(f"{level}|{rows['rank'].iloc[0]}|{rows['bucket'].iloc[0]}")
        start, size = rows["p"].to_numpy(float).copy(), rows["size"].to_numpy(float)
        settle_large(start, size, rnd)
        p, size = start.tolist(), size.tolist()
        order = sorted(range(len(p)), key=lambda i: size[i])
        n, room = min(SPARE, len(p) // 4), 0.0
        if last:  # as many small ones as can make up for two of the largest
            n = 0
            while n < len(p) // 2 and room < 2 * size[order[-1]]:
                room, n = room + size[order[n]], n + 1
        spare = set(order[:n])
        moving = [i for i in range(len(p)) if i not in spare]
        q = [p[i] for i in moving]
        held = [moving[k] for k in flight(q, [size[i] for i in moving], rnd)]
        for i, x in zip(moving, q):
            p[i] = x
        if last:
            landing(p, size, [*held, *spare], rnd)
        rows["p"] = p
        return rows

    return decide


_ROW = "doc_id long, key long, size long, nth long, rank long, source_size long, target double, whole int, p double, buckets long, bucket long"


def _repeated(n: Column) -> Column:
    """An array of arrays of the numbers from 0 to n - 1, none of them long."""
    some = F.lit(1 << 12)
    return F.transform(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / some)), lambda k: F.sequence(k * some, F.least(k * some + some, n) - 1))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeat: float = REPEAT, columns: list[str] | None = None) -> DataFrame:
    """doc_id, key, size, source_size, target, copies, taken of every row of docs.

    size counts runs of characters other than white space (null text: 0); taken is copies times size.  A null
    source is a source of its own, last in order.  A source whose texts are all empty has target 0 and its
    documents are not taken.  `key` is a hash of `columns`, doc_id and text unless told otherwise.  Rows equal in
    doc_id, key, size and source are counted, then numbered, so many of them fall into many buckets; they may be
    taken a different number of times, and which of them is which is of no account.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(*[F.col(f"`{c}`") for c in columns or ["doc_id", "text"]]).alias("key"),
        F.coalesce(F.regexp_count("text", F.lit(SIZE)), F.lit(0)).cast("long").alias("size"),
        F.col("source").cast("string").alias("source"),
    )
    rows = written(rows.groupBy("doc_id", "key", "size", "source").agg(F.count("*").alias("equal")), "mix-rows")
    totals = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("equal")).alias("size"), F.sum("equal").alias("n"))
    few = totals.limit(FEW_SOURCES + 1).collect()
    if len(few) <= FEW_SOURCES:
        wanted = targets({r["source"]: r["size"] for r in few}, weights, repeat)
        ranked = [(r["source"], r["size"], r["n"], rank, wanted[r["source"]]) for rank, r in enumerate(sorted(few, key=lambda r: (r["source"] is None, r["source"] or "")))]
        by_source = spark.createDataFrame(ranked, "source string, size long, n long, rank long, target double")
    else:
        by_source = _targets_in_jobs(written(totals, "mix-totals"), weights, repeat)
    mean = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0)
    whole = F.least(F.floor(mean + _EPS), F.floor(F.lit(repeat))).cast("int")
    part = mean - whole
    plan = by_source.select(F.col("source").alias("s"), "rank", F.col("size").alias("source_size"), "target", whole.alias("whole"), F.when(part > _EPS, part).otherwise(0.0).alias("p"), F.ceil(F.col("n") / BUCKET).alias("buckets"))
    plan = written(plan, "mix-plan")
    most = plan.agg(F.max("buckets")).first()[0] or 1
    here = join_counted(rows, plan, F.col("source").eqNullSafe(F.col("s")), "inner", FEW_SOURCES)
    here = here.withColumn("nth", F.explode(_repeated(F.col("equal")))).withColumn("nth", F.explode("nth"))
    bucket = F.pmod(F.xxhash64("key", "size", "nth"), "buckets")
    names = [c.split()[0] for c in _ROW.split(", ")]
    here = here.withColumn("bucket", bucket).select(*names)
    fixed = [here.where(f"p <= {_EPS}")]
    here = here.where(f"p > {_EPS}")
    level = 1
    while True:
        last = most <= 1
        here = here.groupBy("rank", "bucket").applyInPandas(_round(level, last), _ROW)
        if last:
            break
        here = written(here, f"mix-level{level}")
        undecided = f"p > {_EPS} and p < 1 - {_EPS}"
        fixed.append(here.where(f"not ({undecided})"))
        fewer = lambda b: -(-(SPARE + 2) * b // BUCKET)
        most, level = fewer(most), level + 1
        here = here.where(undecided).withColumn("buckets", F.ceil((SPARE + 2) * F.col("buckets") / BUCKET)).withColumn("bucket", bucket).select(*names)
    for f in fixed:
        here = here.unionByName(f)
    copies = F.col("whole") + F.round("p").cast("int")
    return here.select("doc_id", "key", "size", "source_size", "target", copies.alias("copies"), (copies.cast("long") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeat: float = REPEAT) -> DataFrame:
    """The mix itself: every row of docs as many times as it is taken, all columns kept.

    Null texts and sources are treated as in mix(); an empty table gives no rows.  Rows equal in all columns share
    their copies; rows that differ in any are decided upon apart.
    """
    # the same two hashes, never null, for grouping and joining: rows are shuffled once
    chosen = mix(docs, weights, repeat, docs.columns).groupBy(F.col("key").alias("key_"), F.xxhash64("doc_id").alias("id_")).agg(F.sum("copies").alias("copies_")).where("copies_ > 0")
    every = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.xxhash64(*every).alias("key_"), F.xxhash64(F.col("doc_id").cast("long")).alias("id_"), F.struct(*every).alias("row_"))
    # equal rows become one before they are shuffled
    rows = rows.groupBy("key_", "id_").agg(F.first("row_").alias("row_"))
    out = rows.join(chosen, ["key_", "id_"])
    out = out.withColumn("copy_", F.explode(_repeated(F.col("copies_").cast("long")))).select("row_", F.explode("copy_"))
    return out.select("row_.*")
