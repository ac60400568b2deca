"""Near-duplicates by DartMinHash sketches, banding and exact checks.

A text is a weighted set of shingles.  Every shingle throws darts: hashed points, uniform over a region as
high as its weight, that arrive in hashed order.  Darts are the same for every text, and one counts for a
text if it falls below the shingle's weight there.  Each dart goes to one of k coordinates, and the earliest
of a coordinate is its minhash; two texts agree in a coordinate with the probability of their weighted Jaccard
similarity.  A text needs about k (ln k + 2) darts, however long it is: later arrivals are never looked at.

Coordinates make bands, and texts that share a band's values share a bucket.  Pairs within buckets are not
spelled out.  Each bucket's most connected text is its centre; every other text is compared with it exactly, a
large centre's members in slices.  Components of the links found come next.  What remains are a centre's members
outside its component: they are held against all its members in blocks, exactly too, through an index of how sets
differ.  So within the candidates of the bands no link is lost.  Until then no step makes more rows than there are
texts in buckets; of a centre with m members, o of them outside, the blocks hold m * o / MEMBERS copies of texts at most
beside the m + o themselves.

Texts go by a 64-bit hash.  Where two different texts share one, which a second hash tells, both get others.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _arrow_schema, join_counted, map_rows, slices, splitmix, unit, written
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
#: At a similarity of 0.8 a pair shares no band with a chance of 1.5e-5, at 0.85 of 8e-8.
BANDS, ROWS = 28, 5
#: Texts, and characters of text, in a block or slice of a centre's members.
MEMBERS, CHARACTERS = 256, 2_000_000
#: Shingles, and texts, that are sketched together.
TOGETHER, TEXTS = 150_000, 256
_WORD = re.compile(r"\w+")
_SALT = {name: np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64) for k, name in enumerate(("wait", "height", "coordinate", "band"))}


@lru_cache(100_000)
def _word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def shingles(text: str | None, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different runs of n words (lower-case \\w+), sorted, and how often each occurs.

    A text of fewer words has one shingle, of all of them; one without words has none.
    """
    ws = _WORD.findall(text.lower()) if text else []
    if not ws:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(_word_hash, ws), np.uint64, len(ws))
    n = min(n, len(ws))
    out = np.zeros(len(ws) - n + 1, np.uint64)
    for k in range(n):
        out = splitmix(out ^ h[k : len(ws) - n + 1 + k])
    return np.unique(out, return_counts=True)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of different hashes; 0 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 0.0


def dart_minhash(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, sets: int, k: int) -> np.ndarray:
    """Sketches, sets by k, of weighted sets given as rows (element hash, weight > 0, number of its set).

    Rows of zero or negative weight are passed over; an empty set's sketch is all zeros.
    """
    some = weights > 0
    elements, weights, owner = elements[some], weights[some].astype(float), owner[some]
    total = np.bincount(owner, weights, sets)
    out = np.zeros((sets, k), np.uint64)
    until = np.full(sets, k * (math.log(k) + 2)) / np.where(total > 0, total, 1)
    open_ = total > 0
    while open_.any():
        rows = open_[owner]
        dart, time, home = _throw(elements[rows], weights[rows], owner[rows], until)
        place = home * k + (splitmix(dart ^ _SALT["coordinate"]) % np.uint64(k)).astype(np.int64)
        order = np.argsort(-time, kind="stable")
        sketch = np.zeros(sets * k, np.uint64)
        sketch[place[order]] = dart[order] | np.uint64(1)  # the last to be written, so the earliest, stays
        sketch = sketch.reshape(sets, k)
        full = open_ & (sketch != 0).all(axis=1)
        out[full] = sketch[full]
        open_ &= ~full
        until = np.where(open_, until * 2, until)
    return out


def _throw(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dart, time, owner) of the darts below the weights that arrive by `until`.

    Heights are cut in strips, [0, 1) and then doubling; a strip's darts arrive at a rate of its height.
    """
    found = []
    low, high, strip = 0.0, 1.0, 0
    while True:
        on = np.flatnonzero(weights > low)
        if not len(on):
            break
        e = splitmix(elements[on] ^ np.uint64(strip * 0x51ED27))
        w, o, limit = weights[on], owner[on], until[owner[on]]
        time, n = np.zeros(len(on)), 0
        while len(e):
            dart = splitmix(e + np.uint64(n))
            time = time - np.log(unit(splitmix(dart ^ _SALT["wait"]))) / (high - low)
            early = time <= limit
            e, w, o, limit, time, dart = e[early], w[early], o[early], limit[early], time[early], dart[early]
            below = low + unit(splitmix(dart ^ _SALT["height"])) * (high - low) < w
            found.append((dart[below], time[below], o[below]))
            n += 1
        low, high, strip = high, high * 2, strip + 1
    return tuple(np.concatenate(x) for x in zip(*found))


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each sketch."""
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _SALT["band"], (len(sketch), bands))
    for r in range(rows):
        h = splitmix(h ^ sketch[:, r::rows][:, :bands])
    return h.astype(np.int64)


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, weight: str = "presence", shingle: int = SHINGLE) -> DataFrame:
    """node, bands for every different text (node: a hash of it) that has a word.

    weight is "presence" (1 for each shingle, so agreement follows the plain Jaccard similarity) or "count".
    """
    schema = _arrow_schema(docs.sparkSession, "node long, bands array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in (part for b in batches for part in slices(b)):
            for node, text in zip(*(c.to_pylist() for c in batch.columns)):
                if node in seen:
                    continue  # copies within a task; the rest go below
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(node)
                e, n = shingles(text, shingle)
                if len(e):
                    held.append((node, e, n))
                    size += len(e)
                if size >= TOGETHER or len(held) >= TEXTS:
                    yield sketch(held)
                    held, size = [], 0
        if held:
            yield sketch(held)

    def sketch(held: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        e = np.concatenate([h[1] for h in held])
        w = np.concatenate([h[2] for h in held]) if weight == "count" else np.ones(len(e))
        owner = np.repeat(np.arange(len(held)), [len(h[1]) for h in held])
        keys = band_keys(dart_minhash(e, w, owner, len(held), bands * rows), bands, rows)
        lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), pa.array(keys.ravel()))
        return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), lists.cast(schema[1].type)], schema=schema)

    return docs.select("node", "text").mapInArrow(run, "node long, bands array<long>").groupBy("node").agg(F.first("bands").alias("bands"))


def _hashes() -> tuple[Column, Column]:
    text = F.coalesce("text", F.lit(""))
    return F.xxhash64(text).alias("node"), F.xxhash64(F.lit(1), text).alias("other")


def _clashes(hashed: DataFrame) -> DataFrame | None:
    """The values of node that stand for several values of other; None if there are none, as it nearly always is."""
    out = written(hashed.groupBy("node").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low <> high").select(F.col("node").alias("clash")), "near-clashes")
    return out if out.limit(1).count() else None


def _told_apart(rows: DataFrame, clash: DataFrame | None) -> DataFrame:
    """rows (node, other, ...) with a node of its own for every text, without other."""
    if clash is not None:
        rows = join_counted(rows, clash, F.col("node") == F.col("clash"), "left")
        rows = rows.withColumn("node", F.when(F.col("clash").isNotNull(), F.xxhash64(F.lit(2), "node", "other")).otherwise(F.col("node"))).drop("clash")
    return rows.drop("other")


def compared(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """a, b, similarity of pairs(a, b) of nodes, by their whole sets of shingles; pairs is a written table.

    An a of many pairs gets several copies of its text, one for each MEMBERS of them, so none fills a task.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        known: dict[int, np.ndarray] = {}

        def of(node: int, text: str) -> np.ndarray:
            if (s := known.get(node)) is None:
                if len(known) >= 64:
                    known.clear()
                s = known[node] = shingles(text, shingle)[0]
            return s

        for a, b, x, y in rows:
            yield a, b, similarity(of(a, x), shingles(y, shingle)[0])

    slices = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("slices"))
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("x")).join(slices, "a")
    left = left.select("a", "x", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    sliced = pairs.select("a", "b").join(slices, "a").select("a", "b", F.pmod(F.xxhash64("b"), "slices").cast("int").alias("slice"))
    both = sliced.join(right, "b").join(left, ["a", "slice"]).select("a", "b", "x", "y")
    return map_rows(both, "a long, b long, similarity double", run)


def _texts_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """node, text once for every node in pairs."""
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-wanted")
    found = join_counted(docs.select("node", "text"), wanted, "node", "left_semi")
    return written(found.groupBy("node").agg(F.first("text").alias("text")), "near-texts")


def links(noded: DataFrame, bands: int = BANDS, rows: int = ROWS, weight: str = "presence", least: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """a, b, similarity: links of at least `least` that hold every component of near-duplicate texts (node, text) together."""
    sketch = written(sketches(noded, bands, rows, weight, shingle), "near-sketches")
    spread = sketch.select("node", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    bucket = written(spread.join(shared, "band"), "near-buckets")
    # the centre: of most company over all buckets, which is what the texts of a group have in common
    company = bucket.groupBy("node").agg(F.sum(F.col("n") - 1).alias("company"))
    bucket = bucket.join(company, "node").select("band", "node", "company")
    centre = bucket.groupBy("band").agg(F.max(F.struct("company", "node")).alias("c")).select("band", F.col("c.node").alias("centre"))
    bucket = written(bucket.join(centre, "band").select("band", "node", "centre"), "near-centres")
    pairs = written(bucket.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "near-pairs")
    texts = _texts_of(noded, pairs)
    first = written(compared(pairs, texts, shingle), "near-first")
    good = first.where(F.col("similarity") >= least)
    root = written(components(good.select("a", "b")), "near-roots")
    second = _among_members(first, root, texts, least, shingle)
    return written(good.unionByName(second), "near-links")


def _among_members(first: DataFrame, root: DataFrame, texts: DataFrame, least: float, shingle: int) -> DataFrame:
    """a, b, similarity: links between members of a centre (a, b of `first`) that its component doesn't hold.

    A centre's members outside its component are held against all its members, block by block; a block pair is
    one unit of work of bounded size, and yields no more links than join the components in it.
    """

    def rooted(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.join(root.select(F.col("node").alias(column), F.col("root").alias("r_")), column, "left").withColumn(name, F.coalesce("r_", column)).drop("r_")

    member = rooted(rooted(first.select(F.col("a").alias("centre"), F.col("b").alias("node"), "similarity"), "node", "own"), "centre", "main")
    member = written(member.join(texts.select("node", F.length("text").alias("n")), "node"), "near-members")
    out = F.col("own") != F.col("main")
    blocks = lambda rows, chars: F.greatest(F.ceil(rows / MEMBERS), F.ceil(chars / CHARACTERS), F.lit(1)).cast("int")
    size = member.groupBy("centre").agg(F.count("*").alias("m"), F.sum("n").alias("mc"), F.count_if(out).alias("o"), F.sum(F.when(out, F.col("n"))).alias("oc")).where("o > 0 and m > 1")
    size = size.select("centre", blocks(F.col("m"), F.col("mc")).alias("ys"), blocks(F.col("o"), F.col("oc")).alias("xs"))
    sized = member.join(size, "centre")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    columns = ["centre", "node", "similarity", "own"]
    outer = sized.where(out).select(*columns, F.lit(True).alias("outer"), mine("xs").alias("x"), "ys").select(*columns, "outer", "x", every("ys").alias("y"))
    whole = sized.select(*columns, F.lit(False).alias("outer"), "xs", mine("ys").alias("y")).select(*columns, "outer", every("xs").alias("x"), "y")
    work = outer.unionByName(whole).join(texts, "node")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_block_links(group, least, shingle), columns=["a", "b", "similarity"])

    return work.groupBy("centre", "x", "y").applyInPandas(run, "a long, b long, similarity double")


def _block_links(group: pd.DataFrame, least: float, shingle: int) -> list[tuple[int, int, float]]:
    """Links of outer texts with all texts of a block pair, but none within what is joined already.

    Sets are held by how they differ from one of them, the pivot: x and y differ by what lies in just one of
    their differences, so an index of the (short) differences gives every similarity exactly.
    """
    inner = group[~group["outer"]].sort_values(["similarity", "node"], ascending=[False, True])
    outer = group[group["outer"]].sort_values("node")
    if not len(inner) or not len(outer):
        return []
    pivot = shingles(inner["text"].iloc[0], shingle)[0]
    own = [(len(s), np.setxor1d(s, pivot, assume_unique=True)) for s in (shingles(t, shingle)[0] for t in inner["text"])]
    sizes, apart = np.array([n for n, _ in own]), np.array([len(d) for _, d in own])
    items = np.concatenate([d for _, d in own])
    holder = np.repeat(np.arange(len(own)), apart)
    order = np.argsort(items, kind="stable")
    items, holder = items[order], holder[order]
    nodes, roots = inner["node"].tolist(), inner["own"].tolist()
    parent: dict[int, int] = {}

    def find(r: int) -> int:
        while parent.get(r, r) != r:
            r = parent[r]
        return r

    out = []
    for node, root, text in zip(outer["node"], outer["own"], outer["text"]):
        s = shingles(text, shingle)[0]
        d = np.setxor1d(s, pivot, assume_unique=True)
        low, high = np.searchsorted(items, d, "left"), np.searchsorted(items, d, "right")
        spans = [holder[a:b] for a, b in zip(low.tolist(), high.tolist()) if b > a]
        common = np.bincount(np.concatenate(spans), minlength=len(own)) if spans else np.zeros(len(own), int)
        differ = len(d) + apart - 2 * common
        both = (len(s) + sizes - differ) / 2
        alike = both / np.maximum(len(s) + sizes - both, 1)
        for k in np.flatnonzero(alike >= least):
            x, y = find(root), find(roots[k])
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((max(node, nodes[k]), min(node, nodes[k]), float(alike[k])))
    return out


def classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, node, class_id of every row of docs: class_id is the least doc_id of its class.

    Equal texts are of one class, a null text counting as empty; other texts are linked if their sets of
    five-word shingles have a similarity of 0.8 or more, and classes are what links connect.  A text of fewer
    than five words has one shingle of all its words; one without words is linked with its equals only.
    Ids may be null or repeat: a class without any id has a null class_id.  An empty table gives no rows.
    """
    return _classified(docs, **options)[0]


def _classified(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame | None]:
    """classes(), and the hashes that several texts share."""
    hashed = written(docs.select("doc_id", *_hashes()), "near-rows")
    clash = _clashes(hashed)
    rows = _told_apart(hashed, clash)
    root = components(links(_told_apart(docs.select(*_hashes(), "text"), clash), **options).select("a", "b"))
    rooted = rows.join(root, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))
    # a table of its own, so that the join deals out both sides and can split a large class
    least = written(rooted.groupBy("root").agg(F.min("doc_id").alias("class_id")), "near-least")
    return rooted.join(least, "root").select("doc_id", "node", "class_id", "root"), clash


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id of every row of docs; see classes()."""
    return classes(docs, **options).select("doc_id", "class_id")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class, all columns kept: that of the least doc_id (null last).

    Of rows equal in doc_id and text that of the least hash of all columns stays; rows of one hash are equal.
    """
    found, clash = _classified(docs, **options)
    found = written(found, "near-classes")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "node")
    kept = written(found.groupBy("root").agg(F.min(order).alias("k")).select("root", "k.doc_id", "k.node"), "near-kept")
    # rows to drop are fewer than rows to keep
    same = [F.col("f.root") == F.col("k.root"), F.col("f.node") == F.col("k.node"), F.col("f.doc_id").eqNullSafe(F.col("k.doc_id"))]
    drop = found.alias("f").join(kept.alias("k"), same, "left_anti").select(F.col("doc_id").alias("drop_id"), F.col("node").alias("drop_node")).distinct()
    drop = written(drop, "near-drop")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"), F.col("doc_id").alias("id_"), *_hashes())
    out = join_counted(_told_apart(held, clash), drop, (F.col("node") == F.col("drop_node")) & F.col("id_").eqNullSafe(F.col("drop_id")), "left_anti")
    if found.groupBy("doc_id", "node").count().where("count > 1").limit(1).count():
        least = F.struct(F.xxhash64("row_"), F.xxhash64(F.lit(1), "row_"))
        out = out.groupBy("id_", "node").agg(F.min_by("row_", least).alias("row_"))  # combined before it is shuffled
    return out.select("row_.*")
