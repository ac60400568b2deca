"""Land in memory, for the functions that walk lines step by step: vectorised tests over raster runs and rings.

What it holds is bounded by the grid and the coastline and not by requests: runs of a world raster, boxes of
rings, and the points of island-scale rings.  build_index() checks the size before anything is collected.
Every test takes arrays, of points, boxes, cells or lines, and flattens the samples of all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import semantics as S

#: Bytes that an index may hold; it is broadcast to every worker.
MAX_BYTES = 1_000_000_000
#: Samples that are looked at together.
SAMPLES = 1_000_000
_TILE, _WIDE_TILE = 1.0, 5.0


def haversine(lon1, lat1, lon2, lat2):
    turn = np.abs(np.asarray(lon2) - lon1) % 360.0
    dlon = np.radians(np.where(turn > 180.0, 360.0 - turn, turn))
    p, q = np.radians(lat1), np.radians(lat2)
    half = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(dlon / 2) ** 2
    return 2 * S.EARTH_KM * np.arcsin(np.sqrt(half))


def numbered(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number within it) of sizes[k] items of every owner k."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def chunks(sizes: np.ndarray, most: int = SAMPLES) -> Iterator[slice]:
    """Slices of owners with about `most` items each."""
    at = 0
    ends = np.cumsum(sizes)
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield slice(at, to)
        at = to


@dataclass
class LandIndex:
    cell: float
    starts: np.ndarray  # row * columns + first column of each run, sorted
    ends: np.ndarray
    boxes: np.ndarray  # of all rings: min_lon, min_lat, max_lon, max_lat
    island_boxes: np.ndarray
    island_points: list[np.ndarray]  # of the rings of island_boxes, n by 2

    def __post_init__(self) -> None:
        self._shared = None
        b = self.boxes
        self._all = Boxes(b, _WIDE_TILE)
        self._small = Boxes(b[np.maximum(b[:, 2] - b[:, 0], b[:, 3] - b[:, 1]) <= S.ISLAND_FEATURE_SPAN], _TILE)
        self._islands = Boxes(self.island_boxes, _TILE)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_shared": None}

    # ---- points ----

    def is_land(self, lon, lat) -> np.ndarray:
        """By the raster; longitudes may be turns off, and what lies off the grid is water."""
        rows, cols = S.raster_shape(self.cell)
        lon, lat = np.atleast_1d(np.asarray(lon, float)), np.atleast_1d(np.asarray(lat, float))
        if len(lon) and (lon.max() >= 180.0 or lon.min() < -180.0):
            lon = np.where((lon >= 180.0) | (lon < -180.0), (lon + 180.0) % 360.0 - 180.0, lon)
        col = np.maximum(np.trunc((lon + 180.0) / self.cell), 0).astype(np.int64)
        row = np.maximum(np.trunc((lat + 90.0) / self.cell), 0).astype(np.int64)
        at = row * cols + col
        run = np.searchsorted(self.starts, at, side="right") - 1
        hit = (run >= 0) & (col < cols) & (row < rows)
        if len(self.starts):
            hit &= at < self.ends[np.maximum(run, 0)]
        return hit

    def is_land_precise(self, lon, lat) -> np.ndarray:
        """Exact within the boxes of island rings, by the raster elsewhere."""
        lon, lat = np.atleast_1d(np.asarray(lon, float)), np.atleast_1d(np.asarray(lat, float))
        out = self.is_land(lon, lat)
        point, ring = self._islands.pairs(lon, lat, lon, lat)
        if len(point):
            odd = np.zeros(len(lon), bool)
            order = np.argsort(ring, kind="stable")
            point, ring = point[order], ring[order]
            for at in np.split(np.arange(len(ring)), np.flatnonzero(np.diff(ring)) + 1):
                p = point[at]
                odd[p] ^= _inside(lon[p], lat[p], self.island_points[ring[at[0]]])
            out[point] = odd[point]
        return out

    # ---- boxes and cells ----

    def overlaps(self, x0, y0, x1, y1) -> np.ndarray:
        """Whether any ring's box touches each of these."""
        return self._all.touched(*np.atleast_1d(x0, y0, x1, y1))

    def cell_kinds(self, depth: np.ndarray, ix: np.ndarray, iy: np.ndarray) -> np.ndarray:
        """water, land or mixed for every cell, by a grid of samples no more than a quarter of a degree apart."""
        out = np.full(len(depth), "water", object)
        for d in np.unique(depth):
            w, h = 360.0 / 2.0**d, 180.0 / 2.0**d
            nx, ny = (max(3, int(np.ceil(x / S.SAMPLE_SPACING)) + 1) for x in (w, h))
            own = np.flatnonzero(depth == d)
            x0, y0 = -180.0 + ix[own] * w, -90.0 + iy[own] * h
            near = self.overlaps(x0, y0, x0 + w, y0 + h)
            own, x0, y0 = own[near], x0[near], y0[near]
            u, v = np.arange(nx) / (nx - 1) * w, np.arange(ny) / (ny - 1) * h
            step = max(1, SAMPLES // (nx * ny))
            for a in range(0, len(own), step):
                k, x, y = own[a : a + step], x0[a : a + step], y0[a : a + step]
                lon = np.broadcast_to((x[:, None] + u)[:, :, None], (len(k), nx, ny))
                lat = np.broadcast_to((y[:, None] + v)[:, None, :], (len(k), nx, ny))
                hit = self.is_land(lon.ravel(), lat.ravel()).reshape(len(k), -1)
                some, every = hit.any(axis=1), hit.all(axis=1)
                isle = self._small.touched(x, y, x + w, y + h)
                out[k] = np.where(every, "land", np.where(some | isle, "mixed", "water"))
        return out

    # ---- lines ----

    def edge_crosses(self, lon1, lat1, lon2, lat2) -> np.ndarray:
        """Whether land lies on each edge between cells, or in the band beside it."""
        lon1, lat1, lon2, lat2 = (np.asarray(x, float) for x in (lon1, lat1, lon2, lat2))
        dx, dy = lon2 - lon1, lat2 - lat1
        length = np.hypot(dx, dy)
        km = length * S.KM_PER_DEGREE
        out = np.zeros(len(dx), bool)
        # no sample of an edge far from every ring's box can be land; past the dateline the same land lies a turn back
        margin = S.EDGE_BAND + 2 * self.cell
        x0, x1, y0, y1 = np.minimum(lon1, lon2) - margin, np.maximum(lon1, lon2) + margin, np.minimum(lat1, lat2) - margin, np.maximum(lat1, lat2) + margin
        near = np.zeros(len(dx), bool)
        for turn in (0.0, 360.0, -360.0):
            near |= self.overlaps(x0 + turn, y0, x1 + turn, y1)
        on = np.flatnonzero(near & (length >= S.EDGE_SHORTEST))
        n = np.maximum(S.EDGE_SAMPLES, np.ceil(km / np.where(km < S.EDGE_SHORT_KM, S.EDGE_STEP_SHORT_KM, S.EDGE_STEP_KM))).astype(np.int64)
        for part in chunks(n[on]):
            e = on[part]
            k, i = numbered(n[e] - 1)
            e_of = e[k]
            t = (i + 1) / n[e_of]
            x, y = lon1[e_of] + t * dx[e_of], lat1[e_of] + t * dy[e_of]
            band = S.EDGE_BAND * np.minimum(km[e_of] / 2.0, 1.0)
            px, py = -dy[e_of] / length[e_of] * band, dx[e_of] / length[e_of] * band
            hit = self.is_land_precise(x, y) | self.is_land(x + px, y + py) | self.is_land(x - px, y - py)
            out[e] = np.bincount(k, hit, len(e)) > 0
        return out

    def clear(self, ax, ay, bx, by, step_km: float, from_a_km: float, from_b_km: float) -> np.ndarray:
        """Whether straight lines are free of land, but for stretches near their ends."""
        ax, ay, bx, by = np.broadcast_arrays(*(np.atleast_1d(np.asarray(x, float)) for x in (ax, ay, bx, by)))
        total = haversine(ax, ay, bx, by)
        out = np.ones(len(total), bool)
        on = np.flatnonzero(total >= 1e-6)
        n = np.maximum(2, np.ceil(total / step_km)).astype(np.int64)
        for part in chunks(n[on] + 1):
            e = on[part]
            k, i = numbered(n[e] + 1)
            t, km = i / n[e][k], total[e][k]
            inner = (t * km > from_a_km) & ((1.0 - t) * km > from_b_km)
            k, t = k[inner], t[inner]
            o = e[k]
            hit = self.is_land_precise(ax[o] + t * (bx[o] - ax[o]), ay[o] + t * (by[o] - ay[o]))
            out[e] = np.bincount(k, hit, len(e)) == 0
        return out

    def bridges_clear(self, ax, ay, bx, by) -> np.ndarray:
        return self.clear(ax, ay, bx, by, S.BRIDGE_STEP_KM, S.BRIDGE_SHORE_KM, S.BRIDGE_SHORE_KM)

    def connectors_clear(self, node_x, node_y, port_x, port_y) -> np.ndarray:
        """A connector's stretch near the port may be land, as ports lie on the coast."""
        return self.clear(node_x, node_y, port_x, port_y, S.SNAP_STEP_KM, -1.0, S.SNAP_SHORE_KM)

    def connector_clear(self, node, port) -> bool:
        return bool(self.connectors_clear(*node, *port)[0])

    def sights(self, x0, y0, x1, y1) -> np.ndarray:
        """Whether straight lines stay in water: no ring's box near, or no land beside their samples."""
        x0, y0, x1, y1 = np.broadcast_arrays(*(np.atleast_1d(np.asarray(x, float)) for x in (x0, y0, x1, y1)))
        out = np.ones(len(x0), bool)
        on = np.flatnonzero(self.overlaps(np.minimum(x0, x1), np.minimum(y0, y1), np.maximum(x0, x1), np.maximum(y0, y1)))
        if not len(on):
            return out
        x, y, dx, dy = x0[on], y0[on], x1[on] - x0[on], y1[on] - y0[on]
        km = np.hypot(dx, dy) * S.KM_PER_DEGREE
        # long lines go in pieces, of which those without a ring's box near are passed over
        n = np.where(km < S.SIGHT_LONG_KM, 1, np.ceil(km / S.SIGHT_CHUNK_KM)).astype(np.int64)
        k, i = numbered(n)
        u, v = x[k] + i / n[k] * dx[k], y[k] + i / n[k] * dy[k]
        p, q = x[k] + (i + 1) / n[k] * dx[k], y[k] + (i + 1) / n[k] * dy[k]
        whole = n[k] == 1
        du, dv = np.where(whole, dx[k], p - u), np.where(whole, dy[k], q - v)
        near = whole | self.overlaps(np.minimum(u, p), np.minimum(v, q), np.maximum(u, p), np.maximum(v, q))
        blocked = self._beside(u[near], v[near], du[near], dv[near])
        out[on] = np.bincount(k[near], blocked, len(on)) == 0
        return out

    def _beside(self, x: np.ndarray, y: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
        """Whether land lies on a sample of each piece or in the band beside it."""
        length = np.hypot(dx, dy)
        n = np.maximum(2, np.ceil(length * S.KM_PER_DEGREE / S.SIGHT_STEP_KM)).astype(np.int64)
        some = length > 1e-10
        safe = np.where(some, length, 1.0)
        px, py = np.where(some, -dy / safe * S.SIGHT_BAND, 0.0), np.where(some, dx / safe * S.SIGHT_BAND, 0.0)
        out = np.zeros(len(x), bool)
        for part in chunks(3 * n):
            k, i = numbered(n[part] - 1)
            t = (i + 1) / n[part][k]
            cx, cy, bx, by = x[part][k] + t * dx[part][k], y[part][k] + t * dy[part][k], px[part][k], py[part][k]
            hit = self.is_land(np.concatenate([cx, cx + bx, cx - bx]), np.concatenate([cy, cy + by, cy - by]))
            out[part] = np.bincount(np.tile(k, 3), hit, part.stop - part.start) > 0
        return out

    def in_sight(self, a, b) -> bool:
        return bool(self.sights(a[0], a[1], b[0], b[1])[0])


class Boxes:
    """Boxes by the tiles that they touch, with sums of tiles from the corner, so that most questions need no look at a box."""

    def __init__(self, boxes: np.ndarray, size: float):
        self.boxes, self.size = boxes, size
        low, high = (np.floor(boxes[:, c] / size).astype(np.int64) for c in (slice(0, 2), slice(2, 4)))
        self.origin = low.min(axis=0, initial=0)
        self.shape = high.max(axis=0, initial=0) - self.origin + 1
        low, span = low - self.origin, high - low + 1
        box, i = numbered(span[:, 0] * span[:, 1])
        tile = (low[box, 0] + i // span[box, 1]) * self.shape[1] + low[box, 1] + i % span[box, 1]
        order = np.argsort(tile, kind="stable")
        self.box = box[order]
        counts = np.bincount(tile, minlength=int(self.shape.prod()))
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.sums = np.zeros(self.shape + 1, np.int64)
        self.sums[1:, 1:] = counts.reshape(self.shape).cumsum(axis=0).cumsum(axis=1)

    def _range(self, x0, y0, x1, y1) -> list[np.ndarray]:
        """First and last tile each way, the last before the first where there are none."""
        f = lambda v, k: np.floor(np.clip(v, -1e9, 1e9) / self.size).astype(np.int64) - self.origin[k]
        a, b, c, d = f(x0, 0), f(y0, 1), f(x1, 0), f(y1, 1)
        return [np.maximum(a, 0), np.maximum(b, 0), np.minimum(c, self.shape[0] - 1), np.minimum(d, self.shape[1] - 1)]

    def _count(self, a, b, c, d) -> np.ndarray:
        ok = (c >= a) & (d >= b)
        a, b, c, d = (np.where(ok, v, 0) for v in (a, b, c, d))
        s = self.sums
        return np.where(ok, s[c + 1, d + 1] - s[a, d + 1] - s[c + 1, b] + s[a, b], 0)

    def touched(self, x0, y0, x1, y1) -> np.ndarray:
        """Whether any box touches each of these."""
        if not len(self.boxes):
            return np.zeros(len(x0), bool)
        a, b, c, d = self._range(x0, y0, x1, y1)
        some = self._count(a, b, c, d) > 0
        # a tile strictly within is covered, so whatever touches it touches
        inner = self._count(*self._inner(x0, y0, x1, y1)) > 0
        out = some & inner
        unsure = np.flatnonzero(some & ~inner)
        if len(unsure):
            q, _ = self.pairs(x0[unsure], y0[unsure], x1[unsure], y1[unsure])
            out[unsure[q]] = True
        return out

    def _inner(self, x0, y0, x1, y1) -> list[np.ndarray]:
        a, b = np.floor(x0 / self.size).astype(np.int64) + 1, np.floor(y0 / self.size).astype(np.int64) + 1
        c, d = np.floor(x1 / self.size).astype(np.int64) - 1, np.floor(y1 / self.size).astype(np.int64) - 1
        return [np.maximum(a - self.origin[0], 0), np.maximum(b - self.origin[1], 0), np.minimum(c - self.origin[0], self.shape[0] - 1), np.minimum(d - self.origin[1], self.shape[1] - 1)]

    def pairs(self, x0, y0, x1, y1) -> tuple[np.ndarray, np.ndarray]:
        """(question, box) once for every box that touches one of these."""
        if not len(self.boxes) or not len(x0):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b, c, d = self._range(x0, y0, x1, y1)
        high = np.maximum(d - b + 1, 0)
        tiles = np.maximum(c - a + 1, 0) * high
        found = []
        for part in chunks(tiles):
            q, i = numbered(tiles[part])
            if not len(q):
                continue
            q += part.start
            tile = (a[q] + i // high[q]) * self.shape[1] + b[q] + i % high[q]
            k, i = numbered(self.first[tile + 1] - self.first[tile])
            q, box = q[k], self.box[self.first[tile[k]] + i]
            m = self.boxes[box]
            hit = (m[:, 0] <= x1[q]) & (m[:, 2] >= x0[q]) & (m[:, 1] <= y1[q]) & (m[:, 3] >= y0[q])
            found.append(np.unique(q[hit] * len(self.boxes) + box[hit]))
        both = np.concatenate(found) if found else np.zeros(0, np.int64)
        return both // len(self.boxes), both % len(self.boxes)


def _inside(lon: np.ndarray, lat: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Whether an odd number of the ring's sides lie to the east of each point."""
    out = np.zeros(len(lon), bool)
    (bx, by), (ax, ay) = ring.T, np.roll(ring, 1, axis=0).T
    leaning = ay != by
    ax, ay, bx, by = ax[leaning], ay[leaning], bx[leaning], by[leaning]
    step = max(1, SAMPLES // max(1, len(ax)))
    for k in range(0, len(lon), step):
        x, y = lon[k : k + step, None], lat[k : k + step, None]
        east = ((by > y) != (ay > y)) & (x < (ax - bx) * (y - by) / (ay - by) + bx)
        out[k : k + step] = east.sum(axis=1) % 2 == 1
    return out


def land_shared(spark: SparkSession, land: LandIndex) -> Broadcast:
    """The broadcast of an index, of which there is one however many operators ask."""
    if land._shared is None or land._shared[0] is not spark.sparkContext:
        land._shared = spark.sparkContext, spark.sparkContext.broadcast(land)
    return land._shared[1]


def build_index(rings: DataFrame, runs: DataFrame, cell: float = S.RASTER_CELL) -> LandIndex:
    """The index of rings (with boxes) and raster runs."""
    _, cols = S.raster_shape(cell)
    sizes = rings.agg(F.count("*"), F.sum(F.when(F.col("is_island"), F.size("pts")).otherwise(0))).first()
    size = 32 * (sizes[0] or 0) + 16 * (sizes[1] or 0) + 16 * runs.count()
    if size > MAX_BYTES:
        raise ValueError(f"the land index would take {size} bytes; use a coarser raster or fewer island rings")
    r = runs.select("row", "col_start", "col_end").toPandas().to_numpy(np.int64).reshape(-1, 3)
    start, end = r[:, 0] * cols + r[:, 1], r[:, 0] * cols + r[:, 2]
    order = np.argsort(start)
    box = ["min_lon", "min_lat", "max_lon", "max_lat"]
    boxes = rings.select(*box).toPandas().to_numpy(float).reshape(-1, 4)
    islands = rings.where("is_island").select(*box, F.transform("pts", lambda p: p["lon"]).alias("x"), F.transform("pts", lambda p: p["lat"]).alias("y")).collect()
    points = [np.column_stack([i["x"], i["y"]]) for i in islands]
    return LandIndex(cell, start[order], end[order], boxes, np.array([[i[b] for b in box] for i in islands], float).reshape(-1, 4), points)
