"""Exact top-k search by inner product with vector-approximation files.

Vectors lie in blocks, a file each in the shared folder.  Beside its exact vectors a block has an approximation
of each: per dimension a cell of four bits between quantiles of the block.  For a query, the edges of a vector's
cells bound its score from both sides.  A scan of the approximations keeps the vectors whose upper bound reaches
both the kth largest lower bound and the kth best score so far; their exact vectors are then read in the order of
their bounds until the kth best score found is above every bound that is left.  So results are exact, ties
included, whatever the quantisation.

Queries lie in block files too.  What is dealt out are names: a task reads one block of queries and the blocks of
one group, carrying the best scores from block to block and passing over blocks whose edges bound them out.
Groups are scanned in rounds, each as many as all before, and a round knows the kth best scores of the one before.
So of each round a query has about k hits, and what is shuffled grows with the queries times the logarithm of the
groups, not with the pairs of blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _arrow_schema, filesystem, map_rows, scratch, written

K = 20
SCALE = 64.0
#: Vectors and queries in a block, blocks in a group, and queries whose bounds are held at a time.
BLOCK, QUERY_BLOCK, GROUP, CHUNK = 16384, 512, 16, 128
CELLS = 16
#: Exact vectors that are read before the bound is looked at again.
STEP = 64

_BLOCKS = "block long, dim int, file string"
_HITS = "query_row long, query_id long, vec_id long, score long"


def quantised(column: str, scale: float = SCALE) -> F.Column:
    """floor(scale * x) of every component, x as double; what 64 bits can't hold ends at their limits."""
    most = F.lit(2.0**63)

    def one(x: F.Column) -> F.Column:
        y = F.lit(scale) * x.cast("double")
        return F.when(y >= most, F.lit(2**63 - 1)).when(y < -most, F.lit(-(2**63))).otherwise(F.floor(F.when(F.abs(y) < most, y).otherwise(0.0)))

    return F.transform(F.col(column), one)


def usable(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """vec_id, v of the rows whose id and vector are there and whose components are all finite."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ok).select(F.col("vec_id").cast("long").alias("vec_id"), quantised("embedding", scale).alias("v"))


def approximate(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cells, edges): each value's cell, two to a byte along the vector, and the CELLS + 1 edges per dimension."""
    n, dim = x.shape
    edges = np.quantile(x, np.linspace(0, 1, CELLS + 1), axis=0, method="lower").astype(np.int64) if n else np.zeros((CELLS + 1, dim), np.int64)
    cells = np.empty((n, dim + dim % 2), np.uint8)
    cells[:, dim:] = 0
    for d in range(dim):  # cell c holds edges[c] <= value <= edges[c + 1]
        cells[:, d] = np.clip(np.searchsorted(edges[:, d], x[:, d], side="right") - 1, 0, CELLS - 1)
    return cells[:, 0::2] << 4 | cells[:, 1::2], edges


def bounds(packed: np.ndarray, edges: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper edges of every vector's cells, vectors by dimensions."""
    cells = np.empty((len(packed), 2 * packed.shape[1]), np.uint8)
    cells[:, 0::2], cells[:, 1::2] = packed >> 4, packed & 15
    d = np.arange(dim)
    return edges[cells[:, :dim], d], edges[cells[:, :dim] + 1, d]


def search_block(q: np.ndarray, own: np.ndarray, ids: np.ndarray, x: np.ndarray, packed: np.ndarray, edges: np.ndarray, k: int, floor: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every query (ids, scores) of the block's k best that reach its floor; own: the query's own position in it, or -1."""
    dim = x.shape[1]
    floor = np.full(len(q), _LEAST) if floor is None else floor
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(edges).max(initial=0)) * max(dim, 1)
    if largest >= 2.0**53:
        return [_exact(q[i], own[i], ids, x, k) for i in range(len(q))]
    kind = np.float32 if largest < 2.0**24 else np.float64  # sums of integers below these are exact
    low, high = (b.astype(kind).T for b in bounds(packed, edges, dim))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for a in range(0, len(q), CHUNK):
        part = q[a : a + CHUNK]
        up, down = np.maximum(part, 0).astype(kind), np.minimum(part, 0).astype(kind)
        lower, upper = up @ low + down @ high, up @ high + down @ low
        for i in range(len(part)):
            lo, hi, me = lower[i], upper[i], own[a + i]
            if me >= 0:
                lo[me] = hi[me] = -np.inf
            reach = np.partition(lo, len(lo) - k)[len(lo) - k] if len(lo) > k else -np.inf
            near = np.flatnonzero((hi >= max(reach, floor[a + i])) & (hi > -np.inf))
            near = near[np.argsort(-hi[near], kind="stable")]
            out.append(_refine(part[i], near, hi[near], ids, x, k))
    return out


def _refine(q: np.ndarray, near: np.ndarray, hi: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Read exact vectors by falling upper bound until the kth best score is above what is left."""
    at, score, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    while seen < len(near) and not (len(score) >= k and hi[seen] < score[-1]):
        rows = near[seen : seen + STEP]
        seen += len(rows)
        at, score = np.concatenate([at, rows]), np.concatenate([score, x[rows] @ q])
        best = np.lexsort((ids[at], -score))[:k]
        at, score = at[best], score[best]
    return ids[at], score


def _exact(q: np.ndarray, me: int, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All scores of one query, for values so large that bounds in floating point would not be safe.

    Where a sum may leave 64 bits, Python's integers take over, and scores beyond them end at their limits.
    """
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(x.shape[1], 1) < 2.0**62:
        score = x @ q
    else:
        score = np.array([min(max(s, _LEAST), _MOST) for s in (x.astype(object) @ q.astype(object)).tolist()], np.int64) if x.shape[1] else np.zeros(len(x), np.int64)
    rows = np.flatnonzero(np.arange(len(ids)) != me)
    best = rows[np.lexsort((ids[rows], -score[rows]))[:k]]
    return ids[best], score[best]


_LEAST, _MOST = -(2**63), 2**63 - 1


def _packed(x: np.ndarray) -> bytes:
    """Vectors in the narrowest integers that hold them, the width in front."""
    top = int(np.abs(x).max(initial=0)) if x.size and int(x.min()) > _LEAST else _MOST if x.size else 0
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(t).max)
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _unpacked(b: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(b, f"i{b[0]}", offset=1).reshape(-1, dim).astype(np.int64)


def _save(root: str, parts: list[bytes]) -> str:
    """A file of parts in the shared folder, the lengths in front; a random name, so a task that runs twice harms nothing."""
    fs, top = filesystem(root)
    fs.create_dir(top, recursive=True)
    name = uuid.uuid4().hex
    with fs.open_output_stream(f"{top}/{name}", compression=None) as out:
        out.write(np.array([len(parts), *map(len, parts)], np.int64).tobytes())
        for p in parts:
            out.write(p)
    return name


def _parts(root: str, name: str, wanted: list[int]) -> list[bytes]:
    """Parts of a file by their numbers."""
    fs, top = filesystem(root)
    with fs.open_input_file(f"{top}/{name}") as f:
        n = int(np.frombuffer(f.read_at(8, 0), np.int64)[0])
        lengths = np.frombuffer(f.read_at(8 * n, 8), np.int64)
        ends = 8 + 8 * n + np.cumsum(lengths)
        return [f.read_at(int(lengths[k]), int(ends[k] - lengths[k])) for k in wanted]


#: Parts of a block's file: edges, cells, ids, vectors; of a query block's: ids, homes, vectors.
_EDGES, _CELLS, _IDS, _VECTORS = range(4)


def _gather(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, list[list]]]:
    """(dimensions, columns) of up to `size` rows of equal dimension; at most one unfinished block a dimension is held."""
    held: dict[int, list[list]] = {}
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            cols = held.setdefault(len(row[0]), [[] for _ in row])
            for c, v in zip(cols, row):
                c.append(v)
            if len(cols[0]) >= size:
                yield len(row[0]), held.pop(len(row[0]))
    yield from held.items()


def build(vectors: DataFrame, root: str, scale: float = SCALE) -> DataFrame:
    """block, dim, file of the blocks of every usable vector, in the shared folder.

    Vectors of different dimensions lie in different blocks and have no score with each other.
    """
    rows = usable(vectors, scale)
    parts = max(1, -(-rows.count() // BLOCK))
    schema, size = _arrow_schema(vectors.sparkSession, _BLOCKS), BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 12
        for k, (dim, (v, ids)) in enumerate(_gather(batches, size)):
            x = np.array(v, np.int64).reshape(len(ids), dim)
            cells, edges = approximate(x)
            name = _save(root, [edges.tobytes(), cells.tobytes(), np.array(ids, np.int64).tobytes(), _packed(x)])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([base + k], [dim], [name]), schema)], schema=schema)

    # dealt out round robin after a sort, so a task that runs again gets the same rows
    return written(rows.select("v", "vec_id").repartition(parts).mapInArrow(run, _BLOCKS), "va-blocks")


def _query_blocks(blocks: DataFrame, root: str, every: int) -> DataFrame:
    """qblock, dim, file: rows of the index whose id is divisible by `every`, with their places (block, position)."""
    schema = _arrow_schema(blocks.sparkSession, "v array<long>, id long, home long")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, dim, name in zip(*(c.to_pylist() for c in b.columns)):
                ids, vectors = _parts(root, name, [_IDS, _VECTORS])
                ids = np.frombuffer(ids, np.int64)
                at = np.flatnonzero(ids % every == 0)
                v = _unpacked(vectors, dim)[at].tolist() if dim else [[] for _ in at]
                yield pa.RecordBatch.from_arrays([pa.array(v, schema[0].type), pa.array(ids[at]), pa.array((block << 32) + at)], schema=schema)

    rows = written(blocks.select("block", "dim", "file").mapInArrow(pick, "v array<long>, id long, home long"), "va-query-rows")
    parts, size = max(1, -(-rows.count() // QUERY_BLOCK)), QUERY_BLOCK
    out = _arrow_schema(blocks.sparkSession, "qblock long, dim int, file string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 12
        for k, (dim, (v, ids, homes)) in enumerate(_gather(batches, size)):
            name = _save(root, [np.array(ids, np.int64).tobytes(), np.array(homes, np.int64).tobytes(), _packed(np.array(v, np.int64).reshape(len(ids), dim))])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([base + k], [dim], [name]), out)], schema=out)

    return written(rows.repartition(parts).mapInArrow(run, "qblock long, dim int, file string"), "va-queries")


def scan(root: str, queries: str, dim: int, group: list[tuple[int, str]], known: dict[int, int], k: int) -> tuple[np.ndarray, ...]:
    """(home, query id, vec_id, score) of the k best of a group of blocks for a file of queries; known: kth best scores so far by home."""
    qids, homes, q = _parts(root, queries, [0, 1, 2])
    qids, homes = np.frombuffer(qids, np.int64), np.frombuffer(homes, np.int64)
    q = _unpacked(q, dim) if dim else np.zeros((len(qids), 0), np.int64)
    floor = np.array([known.get(h, _LEAST) for h in homes.tolist()], np.int64)
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
    for block, name in group:
        edges = np.frombuffer(_parts(root, name, [_EDGES])[0], np.int64).reshape(CELLS + 1, dim)
        # the most that a vector within the block's outer edges can have, where floating point sums it up exactly
        most = np.maximum(q, 0).astype(float) @ edges[-1].astype(float) + np.minimum(q, 0).astype(float) @ edges[0].astype(float)
        sure = float(np.abs(q).max(initial=0)) * float(np.abs(edges).max(initial=0)) * max(dim, 1) < 2.0**53
        on = np.flatnonzero(most >= floor) if sure else np.arange(len(q))
        if not len(on):
            continue
        cells, ids, x = _parts(root, name, [_CELLS, _IDS, _VECTORS])
        ids = np.frombuffer(ids, np.int64)
        x = _unpacked(x, dim) if dim else np.zeros((len(ids), 0), np.int64)
        own = np.where(homes[on] >> 32 == block, homes[on] & 0xFFFFFFFF, -1)
        found = search_block(q[on], own, ids, x, np.frombuffer(cells, np.uint8).reshape(len(ids), -1), edges, k, floor[on])
        for i, (vec, score) in zip(on.tolist(), found):
            vec, score = (np.concatenate(c) for c in zip(best[i], (vec, score)))
            top = np.lexsort((vec, -score))[:k]
            best[i] = vec[top], score[top]
            if len(top) == k:
                floor[i] = max(floor[i], score[top[-1]])
    # what is below the floor can't be among the k best of all
    kept = [(v[s >= f], s[s >= f]) for (v, s), f in zip(best, floor.tolist())]
    sizes = [len(v) for v, _ in kept]
    return np.repeat(homes, sizes), np.repeat(qids, sizes), *(np.concatenate(c) if kept else np.zeros(0, np.int64) for c in (list(zip(*kept)) or [(), ()]))


def top_k(vectors: DataFrame, every: int = 20, k: int = K, scale: float = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every row whose id is divisible by `every`.

    Rows without an id, without a vector, or with a null or non-finite component take no part.  A query's own
    row is left out, but not others that repeat its id; ties go to the smaller vec_id.  A query with fewer than
    k others has as many results; an empty table gives none.  Rows that repeat a query's id are queries too.
    Components and scores beyond 64 bits end at the limits of 64 bits.
    """
    spark = vectors.sparkSession
    root = scratch(spark, "va-files")
    blocks = build(vectors, root, scale)
    queries = _query_blocks(blocks, root, every)
    place = F.row_number().over(Window.partitionBy("dim").orderBy("block")) - 1  # one row a block
    groups = blocks.withColumn("group", F.floor(place / GROUP).cast("int")).groupBy("dim", "group").agg(F.array_sort(F.collect_list(F.struct("block", "file"))).alias("blocks"))
    groups = written(groups, "va-groups")
    last = groups.agg(F.max("group")).first()[0]
    schema = _arrow_schema(spark, _HITS)
    state: DataFrame | None = None
    low, high = 0, 1
    while last is not None and low <= last:
        work = groups.where((F.col("group") >= low) & (F.col("group") < high)).join(queries, "dim").select("dim", "blocks", "file", "qblock", "group")
        n = max(1, work.count())
        known = F.lit(None).cast("string")
        if state is not None:
            work = work.join(_known(state, queries, root, k), "file", "left")
            known = F.col("known")
        number = F.row_number().over(Window.orderBy("group", "qblock")) - 1 if n <= 100_000 else F.xxhash64("group", "qblock")
        work = written(work.withColumn("number", number).select("dim", "blocks", "file", known.alias("known"), "number"), "va-work")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for dim, members, file, known in zip(*(c.to_pylist() for c in batch.columns)):
                    floors = {}
                    if known:
                        homes, scores = (np.frombuffer(p, np.int64).tolist() for p in _parts(root, known, [0, 1]))
                        floors = dict(zip(homes, scores))
                    found = scan(root, file, dim, [(m["block"], m["file"]) for m in members], floors, k)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], schema=schema)

        tasks = min(n, 20_000)
        dealt = work.repartitionById(tasks, F.pmod("number", F.lit(tasks)).cast("int")).select("dim", "blocks", "file", "known")
        hits = written(dealt.mapInArrow(run, _HITS), "va-hits")
        rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
        best = (hits if state is None else state.select(*hits.columns).unionByName(hits)).withColumn("rank", rank).where(F.col("rank") <= k)
        low, high = high, 2 * high
        state = written(best, "va-best") if low <= last else best
    if state is None:
        state = spark.createDataFrame([], _HITS + ", rank int")
    return state.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _known(state: DataFrame, queries: DataFrame, root: str, k: int) -> DataFrame:
    """file (of queries), known: a file of the kth best scores of those queries that have k, by home."""
    kth = state.where(F.col("rank") == k).select("query_row", "score")

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column(0).to_pylist():
                h = np.frombuffer(_parts(root, file, [1])[0], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(h)), pa.array(h)], names=["file", "query_row"])

    def save(rows: Iterator[tuple]) -> Iterator[tuple]:
        for file, pairs in rows:
            yield file, _save(root, [np.array([p[c] for p in pairs], np.int64).tobytes() for c in ("query_row", "score")])

    placed = queries.select("file").mapInArrow(homes, "file string, query_row long").join(kth, "query_row")
    listed = placed.groupBy("file").agg(F.collect_list(F.struct("query_row", "score")).alias("pairs"))
    return written(map_rows(listed, "file string, known string", save), "va-known")
