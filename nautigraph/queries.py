"""The registered queries of the navigation engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from . import semantics as S
from .functions import geo
from .functions.cut import cut
from .functions.tiles import nearest_k
from .operators import components as C
from .operators import graph as G
from .operators import land as L
from .operators import paths as P
from .operators import quadtree as Q
from .plans import engine as E
from .plans import landindex, routing
from .sources import canals, geojson, graphs, requests

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- expressions ----

@query(f"SELECT o_orderkey, round({X.sql_haversine(*[f(k) for k in ('o_orderkey', 'o_custkey') for f in (X.sql_lon, X.sql_lat)])}, 6) AS km FROM orders")
def haversine_pairs(spark, sf_dir):
    a, b = F.col("o_orderkey"), F.col("o_custkey")
    return _table(spark, sf_dir, "orders").select(a, F.round(geo.haversine_km(X.lon(a), X.lat(a), X.lon(b), X.lat(b)), 6).alias("km"))


_RATIO = "CAST(CAST(1 + l_partkey % 16 AS DOUBLE) / 16 AS FLOAT)"
_T = f"(({_RATIO} - 0.2::FLOAT) / (1::FLOAT - 0.2::FLOAT))"


@query(f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(CAST(CASE WHEN {_RATIO} <= 0.2::FLOAT THEN CAST(l_quantity AS FLOAT)
ELSE CAST(l_quantity AS FLOAT) * (1::FLOAT + (CAST(1 + l_suppkey % 9 AS FLOAT) - 1::FLOAT) * {_T} * {_T}) END AS DOUBLE), 2) AS weight FROM lineitem""")
def edge_weight_penalty(spark, sf_dir):
    ratio = geo.depth_ratio(1 + F.col("l_partkey") % 16, F.lit(0), 16.0)
    w = geo.edge_weight(F.col("l_quantity"), ratio, (1 + F.col("l_suppkey") % 9))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(w.cast("double"), 2).alias("weight"))


_TEXT = "CASE c_custkey % 5 WHEN 0 THEN c_custkey || ',' || (c_custkey % 90) WHEN 1 THEN c_custkey || ',foo,' || (c_custkey % 90) || '.5' WHEN 2 THEN c_custkey || ', ' || (c_custkey % 90) WHEN 3 THEN '-' || c_custkey || 'e-1,+.5' ELSE c_custkey || ',1,2' END"
_NUMBERS = f"list_transform(list_filter(string_split({_TEXT}, ','), lambda t: regexp_matches(t, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$')), lambda t: CAST(t AS DOUBLE))"


@query(f"SELECT c_custkey, CASE WHEN len({_NUMBERS}) = 2 THEN ({_NUMBERS})[1] END AS lon, CASE WHEN len({_NUMBERS}) = 2 THEN ({_NUMBERS})[2] END AS lat FROM customer")
def parse_coords(spark, sf_dir):
    t = _table(spark, sf_dir, "customer").select("c_custkey", F.expr(_TEXT).alias("t")).withColumn("p", geo.parse_coords("t"))
    return t.select("c_custkey", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


@query(f"WITH {X.SQL_NODES} SELECT node_id, round(lon * 100000) / 100000 AS lon, round(lat * 100000) / 100000 AS lat, depth FROM gnodes")
def graph_pack(spark, sf_dir):
    nodes = X.graph_nodes(spark, sf_dir)
    return graphs.pack(nodes, nodes.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.col("lon").alias("weight_km")))[0]


@query(f"""WITH p AS (SELECT c_custkey AS k, {X.sql_lon('c_custkey')} AS x, {X.sql_lat('c_custkey')} AS y, {X.sql_lon('c_custkey + 1')} AS x1, {X.sql_lat('c_custkey + 1')} AS y1, {X.sql_lon('c_custkey + 2')} AS x2, {X.sql_lat('c_custkey + 2')} AS y2 FROM customer),
q AS (SELECT *, least(greatest((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0), 1) AS t FROM p)
SELECT k AS port_id, round(sqrt(pow(x - (x1 + t * (x2 - x1)), 2) + pow(y - (y1 + t * (y2 - y1)), 2)), 6) AS d FROM q""")
def segment_distance(spark, sf_dir):
    k = F.col("c_custkey")
    at = [f(k + i) for i in (0, 1, 2) for f in (X.lon, X.lat)]
    return _table(spark, sf_dir, "customer").select(k.alias("port_id"), F.round(geo.distance_from_segment(*at), 6).alias("d"))


# ---- land ----


@query(f"WITH {X.sql_rings()} SELECT ring_id, min_lon, min_lat, max_lon, max_lat, span <= 3.0 AS is_island FROM boxes")
def ring_boxes(spark, sf_dir):
    return X.rings(spark, sf_dir).drop("pts")


@query(f"WITH {X.sql_rings()} SELECT ring_id, CAST(i AS INTEGER) AS i, x0, y0, x1, y1 FROM redges")
def ring_edges(spark, sf_dir):
    return L.ring_edges(X.rings(spark, sf_dir))


def _runs(spark, sf_dir, shifted=False):
    return L.raster_runs(L.ring_edges(X.rings(spark, sf_dir, shifted)), X.CELL)


@query(f"WITH {X.sql_rings(True)}, {X.sql_runs()} SELECT row, col FROM lcells")
def raster_cells(spark, sf_dir):
    return L.raster_cells(_runs(spark, sf_dir, True))


@query(f"""WITH {X.sql_rings(True)}, {X.sql_runs()}, g AS (SELECT row, col, col - row_number() OVER (PARTITION BY row ORDER BY col) AS island FROM lcells)
SELECT row, min(col) AS col_start, max(col) + 1 AS col_end FROM g GROUP BY row, island""")
def raster_runs(spark, sf_dir):
    return _runs(spark, sf_dir, True)


@query(f"WITH {X.SQL_PORTS}, {X.sql_rings()}, {X.sql_runs()}, {X.sql_on_land('ports', 'port_id')} SELECT * FROM coarse")
def point_is_land(spark, sf_dir):
    return L.point_is_land(X.ports(spark, sf_dir), _runs(spark, sf_dir), X.CELL).select("port_id", "on_land")


@query(f"WITH {X.SQL_PORTS}, {X.sql_rings(True)}, {X.sql_in_rings('ports', 'port_id')} SELECT * FROM exact")
def point_in_rings(spark, sf_dir):
    return L.point_in_rings(X.ports(spark, sf_dir), X.rings(spark, sf_dir, True), "port_id")


@query(f"WITH {X.SQL_PORTS}, {X.sql_rings()}, {X.sql_runs()}, {X.sql_precise('ports', 'port_id')} SELECT * FROM precise")
def point_is_land_precise(spark, sf_dir):
    return L.point_is_land_precise(X.ports(spark, sf_dir), X.rings(spark, sf_dir), _runs(spark, sf_dir), "port_id", X.CELL)


def _boxes(spark, sf_dir):
    half = 0.25 + (F.col("port_id") % 8).cast("double") / 4
    box = {"min_lon": F.col("lon") - half, "min_lat": F.col("lat") - half, "max_lon": F.col("lon") + half, "max_lat": F.col("lat") + half}
    return X.ports(spark, sf_dir).withColumns(box)


_BOXES = "pboxes AS (SELECT port_id, lon - h AS min_lon, lat - h AS min_lat, lon + h AS max_lon, lat + h AS max_lat FROM (SELECT *, 0.25::DOUBLE + CAST(port_id % 8 AS DOUBLE) / 4 AS h FROM ports))"
_TOUCH = "p.min_lon <= b.max_lon AND p.max_lon >= b.min_lon AND p.min_lat <= b.max_lat AND p.max_lat >= b.min_lat"


@query(f"WITH {X.SQL_PORTS}, {_BOXES}, {X.sql_rings()} SELECT port_id FROM pboxes p WHERE EXISTS (SELECT 1 FROM boxes b WHERE {_TOUCH})")
def box_overlaps(spark, sf_dir):
    return L.box_overlaps(_boxes(spark, sf_dir), X.rings(spark, sf_dir), "port_id")


@query(f"WITH {X.SQL_PORTS}, {_BOXES}, {X.sql_rings()} SELECT port_id FROM pboxes p WHERE EXISTS (SELECT 1 FROM boxes b WHERE span <= 1.0 AND {_TOUCH})")
def island_feature(spark, sf_dir):
    return L.box_overlaps(_boxes(spark, sf_dir), X.rings(spark, sf_dir), "port_id", S.ISLAND_FEATURE_SPAN)


# ---- quadtree and graph of the derived world ----

DEPTH = 6
_FROM = 4


def _land(spark, sf_dir) -> landindex.LandIndex:
    return landindex.build_index(X.rings(spark, sf_dir), _runs(spark, sf_dir).transform(cut), X.CELL)


def _leaves(spark, sf_dir, land=None) -> DataFrame:
    """Leaves from all cells of depth 4 down to 6."""
    return Q.build(spark, land or _land(spark, sf_dir), DEPTH, _FROM)


def _sql_level(depth: int, cells: str, deepest: int = DEPTH) -> str:
    w, h = 360.0 / 2**depth, 180.0 / 2**depth
    nx, ny = (max(3, -int(-(d / 0.25) // 1) + 1) for d in (w, h))
    n = f"l{depth}"
    b = f"-180.0::DOUBLE + ix * {w}::DOUBLE AS min_lon, -90.0::DOUBLE + iy * {h}::DOUBLE AS min_lat, -180.0::DOUBLE + (ix + 1) * {w}::DOUBLE AS max_lon, -90.0::DOUBLE + (iy + 1) * {h}::DOUBLE AS max_lat"
    pid = f"((CAST(ix AS BIGINT) * 1000 + iy) * 1000 + xi) * 1000 + yi"
    mixed = f"CASE WHEN cc.on_land THEN 'land' ELSE 'water' END" if depth == deepest else "'mixed'"
    centre = f"SELECT CAST(ix AS BIGINT) * 1000 + iy AS cid, (min_lon + max_lon) / 2 AS lon, (min_lat + max_lat) / 2 AS lat FROM {n}b"
    return f"""{n}b AS (SELECT ix, iy, {b} FROM ({cells})), {n}p AS (
  SELECT {pid} AS pid, ix, iy, min_lon + (xi::DOUBLE / {nx - 1}) * (max_lon - min_lon) AS lon, min_lat + (yi::DOUBLE / {ny - 1}) * (max_lat - min_lat) AS lat
  FROM {n}b p, range(0, {nx}) t(xi), range(0, {ny}) u(yi) WHERE EXISTS (SELECT 1 FROM boxes b WHERE {_TOUCH})
), {X.sql_on_land(f'{n}p', 'pid', f'{n}s')}, {n}a AS (SELECT ix, iy, bool_or(on_land) AS some, bool_and(on_land) AS every FROM {n}p JOIN {n}s USING (pid) GROUP BY ix, iy),
{n}c AS ({centre}), {X.sql_on_land(f'{n}c', 'cid', f'{n}d')}, {n} AS (
  SELECT {depth} AS depth, p.ix, p.iy, CASE WHEN a.ix IS NULL THEN 'water' WHEN a.every THEN 'land' WHEN a.some OR EXISTS (SELECT 1 FROM boxes b WHERE span <= 1.0 AND {_TOUCH}) THEN {mixed} ELSE 'water' END AS type
  FROM {n}b p LEFT JOIN {n}a a ON a.ix = p.ix AND a.iy = p.iy JOIN {n}d cc ON cc.cid = CAST(p.ix AS BIGINT) * 1000 + p.iy
)"""


def _sql_kids(parent: str) -> str:
    return f"SELECT 2 * ix + dx AS ix, 2 * iy + dy AS iy FROM {parent}, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) k(dx, dy) WHERE type = 'mixed'"


_LEVELS = ", ".join([X.sql_rings(), X.sql_runs(), _sql_level(4, "SELECT ix, iy FROM range(0, 16) a(ix), range(0, 16) b(iy)"), _sql_level(5, _sql_kids("l4")), _sql_level(6, _sql_kids("l5"))])
_LEAVES = f"{_LEVELS}, leaves AS (SELECT CAST(depth AS INTEGER) AS depth, CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, type FROM (SELECT * FROM l4 UNION ALL SELECT * FROM l5 UNION ALL SELECT * FROM l6) WHERE type <> 'mixed')"


@query(f"WITH {_LEAVES} SELECT * FROM leaves")
def quadtree_leaves(spark, sf_dir):
    return _leaves(spark, sf_dir)


@query(f"WITH {_LEAVES} SELECT type, count(*) AS n FROM leaves GROUP BY type")
def leaf_counts(spark, sf_dir):
    return Q.leaf_counts(_leaves(spark, sf_dir))


_BOUNDED = "lb AS (SELECT *, -180.0::DOUBLE + ix * 360.0::DOUBLE / pow(2, depth) AS min_lon, -90.0::DOUBLE + iy * 180.0::DOUBLE / pow(2, depth) AS min_lat, -180.0::DOUBLE + (ix + 1) * 360.0::DOUBLE / pow(2, depth) AS max_lon, -90.0::DOUBLE + (iy + 1) * 180.0::DOUBLE / pow(2, depth) AS max_lat FROM leaves)"


@query(f"""WITH {_LEAVES}, {_BOUNDED}, w AS (SELECT *, ix // 2 AS px, iy // 2 AS py, (max_lon - min_lon) * 0.1 AS e FROM lb WHERE type = 'water' AND depth = {DEPTH}),
m AS (SELECT px, py FROM w GROUP BY px, py HAVING count(*) = 4 AND bool_and(NOT EXISTS (SELECT 1 FROM lb b WHERE b.type = 'land' AND b.min_lon <= w.max_lon + w.e AND b.max_lon >= w.min_lon - w.e AND b.min_lat <= w.max_lat + w.e AND b.max_lat >= w.min_lat - w.e)))
SELECT depth, ix, iy, type FROM leaves l WHERE NOT (type = 'water' AND depth = {DEPTH} AND EXISTS (SELECT 1 FROM m WHERE m.px = l.ix // 2 AND m.py = l.iy // 2))
UNION ALL SELECT {DEPTH - 1}, CAST(px AS INTEGER), CAST(py AS INTEGER), 'water' FROM m""")
def coarsen_once(spark, sf_dir):
    return Q.coarsen_level(_leaves(spark, sf_dir).transform(cut), DEPTH)


_DIGITS = " || ".join(f"CASE WHEN depth > {k} THEN CAST(((iy >> (depth - {k + 1})) % 2) * 2 + (ix >> (depth - {k + 1})) % 2 AS VARCHAR) ELSE '0' END" for k in range(DEPTH))
_IDS = f"ids AS (SELECT row_number() OVER (ORDER BY {_DIGITS} DESC) - 1 AS node_id, * FROM lb WHERE type = 'water')"


@query(f"WITH {_LEAVES}, {_BOUNDED}, {_IDS} SELECT node_id, (min_lon + max_lon) / 2 AS lon, (min_lat + max_lat) / 2 AS lat, depth FROM ids")
def water_nodes(spark, sf_dir):
    return Q.nodes(Q.water_leaves(_leaves(spark, sf_dir), DEPTH))


_ADJ = """adj AS (
  SELECT i.node_id AS src, j.node_id AS dst FROM ids i JOIN ids j ON j.node_id > i.node_id
  WHERE j.min_lon <= i.max_lon + greatest((i.max_lon - i.min_lon) * 0.01, 0.0001) AND j.max_lon >= i.min_lon - greatest((i.max_lon - i.min_lon) * 0.01, 0.0001)
    AND j.min_lat <= i.max_lat + greatest((i.max_lon - i.min_lon) * 0.01, 0.0001) AND j.max_lat >= i.min_lat - greatest((i.max_lon - i.min_lon) * 0.01, 0.0001)
    AND i.max_lon >= j.min_lon - least(i.max_lon - i.min_lon, j.max_lon - j.min_lon) * 0.5 AND j.max_lon >= i.min_lon - least(i.max_lon - i.min_lon, j.max_lon - j.min_lon) * 0.5
    AND i.max_lat >= j.min_lat - least(i.max_lon - i.min_lon, j.max_lon - j.min_lon) * 0.5 AND j.max_lat >= i.min_lat - least(i.max_lon - i.min_lon, j.max_lon - j.min_lon) * 0.5
)"""


@query(f"WITH {_LEAVES}, {_BOUNDED}, {_IDS}, {_ADJ} SELECT * FROM adj")
def leaf_adjacency(spark, sf_dir):
    return G.adjacency(Q.water_leaves(_leaves(spark, sf_dir), DEPTH).transform(cut))


_ENDS = "ends AS (SELECT src, dst, (a.min_lon + a.max_lon) / 2 AS x1, (a.min_lat + a.max_lat) / 2 AS y1, (b.min_lon + b.max_lon) / 2 AS x2, (b.min_lat + b.max_lat) / 2 AS y2 FROM adj JOIN ids a ON a.node_id = src JOIN ids b ON b.node_id = dst)"
_SPOTS = f"""lens AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len FROM ends),
ns AS (SELECT *, greatest(3, CAST(ceil(len * 111 / CASE WHEN len * 111 < 3 THEN 0.05::DOUBLE ELSE 0.5::DOUBLE END) AS BIGINT)) AS n, 0.0135::DOUBLE * least(len * 111 / 2, 1) AS band FROM lens),
raw AS (SELECT src, dst, n, dx, dy, len, band, x1, y1, unnest(range(1, n)) AS i FROM ns),
spots AS (SELECT (src * 1000000 + dst) * 1000000000 + i * 3 + side + 1 AS pid, src, dst, side, x1 + (i::DOUBLE / n) * dx - dy / len * band * side AS lon, y1 + (i::DOUBLE / n) * dy + dx / len * band * side AS lat FROM raw, (VALUES (0), (1), (-1)) s(side)),
centre AS (SELECT * FROM spots WHERE side = 0), beside AS (SELECT * FROM spots WHERE side <> 0),
{X.sql_precise('centre', 'pid')}, {X.sql_on_land('beside', 'pid', 'band_land')},
crossing AS (SELECT DISTINCT src, dst FROM spots JOIN (SELECT * FROM precise UNION ALL SELECT * FROM band_land) USING (pid) WHERE on_land)"""


@query(f"WITH {_LEAVES}, {_BOUNDED}, {_IDS}, {_ADJ}, {_ENDS}, {_SPOTS} SELECT src, dst FROM crossing")
def edge_crossings(spark, sf_dir):
    leaves = Q.water_leaves(_leaves(spark, sf_dir), DEPTH).transform(cut)
    return G.crossing_edges(G.with_ends(G.adjacency(leaves), Q.nodes(leaves)).transform(cut), X.rings(spark, sf_dir), _runs(spark, sf_dir), X.CELL)


@query(f"WITH {_LEAVES}, {_BOUNDED}, {_IDS}, {_ADJ}, {_ENDS}, {_SPOTS} SELECT src, dst, round({X.sql_haversine('x1', 'y1', 'x2', 'y2')}, 6) AS km FROM ends e WHERE NOT EXISTS (SELECT 1 FROM crossing c WHERE c.src = e.src AND c.dst = e.dst)")
def edge_prune(spark, sf_dir):
    land = _land(spark, sf_dir)
    leaves = Q.water_leaves(_leaves(spark, sf_dir, land), DEPTH).transform(cut)
    return G.prune(G.adjacency(leaves), Q.nodes(leaves), land).select("src", "dst", F.round("weight_km", 6).alias("km"))


@query(f"WITH {_LEAVES}, {_BOUNDED}, {_IDS} SELECT e.node_id AS src, w.node_id AS dst FROM ids e JOIN ids w ON e.max_lon >= 180 - 1e-6 AND w.min_lon <= -180 + 1e-6 AND NOT (e.min_lat >= w.max_lat OR w.min_lat >= e.max_lat)")
def seam_pairs(spark, sf_dir):
    return G.seam_pairs(Q.water_leaves(_leaves(spark, sf_dir), DEPTH).transform(cut))


# ---- components, bridges, canals ----

_GRID = """cells AS (SELECT s_suppkey AS node, s_suppkey % 10 AS x, s_suppkey // 10 AS y FROM supplier WHERE s_suppkey % 7 <> 3),
arcs AS (SELECT a.node AS src, b.node AS dst, round(sqrt(CAST((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS DOUBLE)) * 10) / 10 AS w FROM cells a JOIN cells b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.node <> b.node)"""
_LINKS = "links AS (SELECT a.s_suppkey AS src, b.s_suppkey AS dst FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 WHERE a.s_suppkey % 10 <> 0 AND a.s_suppkey % 17 <> 0 AND b.s_suppkey % 17 <> 0)"
_COMPS = f"{_LINKS}, reach AS (SELECT s_suppkey AS node_id, s_suppkey AS other FROM supplier UNION SELECT r.node_id, e.b FROM reach r JOIN (SELECT src AS a, dst AS b FROM links UNION ALL SELECT dst, src FROM links) e ON e.a = r.other), comps AS (SELECT node_id, min(other) AS comp FROM reach GROUP BY node_id)"


@query(f"WITH RECURSIVE {_COMPS} SELECT * FROM comps")
def components(spark, sf_dir):
    return C.components(X.graph_nodes(spark, sf_dir), X.links(spark, sf_dir))


@query(f"WITH RECURSIVE {_COMPS} SELECT comp, count(*) AS n FROM comps GROUP BY comp")
def component_sizes(spark, sf_dir):
    return C.component_sizes(C.components(X.graph_nodes(spark, sf_dir), X.links(spark, sf_dir)))


_MAIN = "main AS (SELECT comp FROM comps GROUP BY comp ORDER BY count(*) DESC, comp DESC LIMIT 1)"
_KNN = lambda k, points, key, nodes: f"SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY d2, node_id) AS rk FROM (SELECT p.{key}, p.lon, p.lat, n.node_id, n.lon AS nlon, n.lat AS nlat, (n.lon - p.lon) * (n.lon - p.lon) + (n.lat - p.lat) * (n.lat - p.lat) AS d2 FROM {points} p, {nodes} n) QUALIFY rk <= {k}"


def _sql_clear(pairs: str, key: str, step: float, from_a: float, from_b: float, name: str) -> str:
    """CTE name(key, clear) of lines (key, x1, y1, x2, y2, km)."""
    return f"""{name}n AS (SELECT *, greatest(2, CAST(ceil(km / {step}::DOUBLE) AS BIGINT)) AS n FROM {pairs}), {name}i AS (SELECT *, unnest(range(0, n + 1)) AS i FROM {name}n),
{name}s AS (SELECT {key} * 100000 + i AS pid, {key}, x1 + (i::DOUBLE / n) * (x2 - x1) AS lon, y1 + (i::DOUBLE / n) * (y2 - y1) AS lat FROM {name}i WHERE km >= 1e-6 AND (i::DOUBLE / n) * km > {from_a} AND (1 - i::DOUBLE / n) * km > {from_b}),
{X.sql_precise(f'{name}s', 'pid', f'{name}p')}, {name} AS (SELECT l.{key}, coalesce(NOT bool_or(p.on_land), true) AS clear FROM {pairs} l LEFT JOIN {name}s s ON s.{key} = l.{key} LEFT JOIN {name}p p ON p.pid = s.pid GROUP BY l.{key})"""


_BRIDGES = f"""near AS ({_KNN(6, 'isl', 'island', 'mains')}), k AS (SELECT *, island * 100 + rk AS lid, lon AS x1, lat AS y1, nlon AS x2, nlat AS y2, {X.sql_haversine('lon', 'lat', 'nlon', 'nlat')} AS km FROM near),
ok AS (SELECT * FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.island = a.island AND b.rk <= a.rk AND b.km > 3000)), {_sql_clear('ok', 'lid', 2.0, 0.3, 0.3, 'cl')},
f AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY rk) AS o FROM ok JOIN cl USING (lid) WHERE clear), g AS (SELECT comp, island, f.node_id AS main_id, km, row_number() OVER (PARTITION BY comp ORDER BY km, island) AS o2 FROM f JOIN comps c ON c.node_id = f.island WHERE o = 1),
bridged AS (SELECT island, main_id, km FROM g WHERE o2 = 1)"""


@query(f"""WITH RECURSIVE {_COMPS}, {_MAIN}, {X.SQL_NODES}, {X.sql_rings()}, {X.sql_runs()},
isl AS (SELECT node_id AS island, lon, lat FROM gnodes WHERE node_id NOT IN (SELECT node_id FROM comps WHERE comp = (SELECT comp FROM main))), mains AS (SELECT * FROM gnodes WHERE node_id IN (SELECT node_id FROM comps WHERE comp = (SELECT comp FROM main))),
{_BRIDGES} SELECT island AS src, main_id AS dst, round(km, 6) AS km FROM bridged""")
def bridge_islands(spark, sf_dir):
    b = G.bridges(X.graph_nodes(spark, sf_dir), X.links(spark, sf_dir), _land(spark, sf_dir))
    return b.select("src", "dst", F.round("weight_km", 6).alias("km"))


_WAY = "way AS (SELECT canal, seq, lon, lat, CAST((SELECT count(*) FROM supplier) + row_number() OVER (ORDER BY line, seq) - 1 AS BIGINT) AS node_id FROM (VALUES " + ", ".join(f"('{c}', {k}, {x}::DOUBLE, {y}::DOUBLE, {list(canals.CANALS).index(c)})" for c, k, x, y in canals.rows()) + ") v(canal, seq, lon, lat, line))"


@query(f"WITH {_WAY} SELECT canal, CAST(seq AS INTEGER) AS seq, node_id, lon, lat, 1 AS depth FROM way")
def canal_nodes(spark, sf_dir):
    return G.canal_nodes(canals.canals(spark), X.graph_nodes(spark, sf_dir).count())


@query(f"""WITH {_WAY}, {X.SQL_NODES}, e AS (SELECT node_id AS end_id, lon, lat FROM way w WHERE seq = 0 OR seq = (SELECT max(seq) FROM way v WHERE v.canal = w.canal)), k AS ({_KNN(5, 'e', 'end_id', 'gnodes')})
SELECT a.node_id AS src, b.node_id AS dst, round({X.sql_haversine('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 6) AS km FROM way a JOIN way b ON a.canal = b.canal AND b.seq = a.seq + 1
UNION ALL SELECT end_id, node_id, round({X.sql_haversine('lon', 'lat', 'nlon', 'nlat')}, 6) FROM k WHERE {X.sql_haversine('lon', 'lat', 'nlon', 'nlat')} < 100""")
def canal_edges(spark, sf_dir):
    nodes = X.graph_nodes(spark, sf_dir)
    return G.canal_edges(G.canal_nodes(canals.canals(spark), nodes.count()), nodes).select("src", "dst", F.round("weight_km", 6).alias("km"))


@query(f"WITH {_LINKS}, {X.SQL_NODES} SELECT n.node_id, CAST((SELECT count(*) FROM links WHERE src = n.node_id) + (SELECT count(*) FROM links WHERE dst = n.node_id) AS BIGINT) AS degree FROM gnodes n")
def adjacency_degree(spark, sf_dir):
    return G.degrees(X.graph_nodes(spark, sf_dir), X.links(spark, sf_dir))


@query(f"WITH {_LINKS}, {X.SQL_NODES}, d AS (SELECT n.node_id, CAST((SELECT count(*) FROM links WHERE src = n.node_id) + (SELECT count(*) FROM links WHERE dst = n.node_id) AS BIGINT) AS degree FROM gnodes n) SELECT node_id, degree, CAST(coalesce(sum(degree) OVER (ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM d")
def csr_offsets(spark, sf_dir):
    return G.csr_offsets(X.graph_nodes(spark, sf_dir), X.links(spark, sf_dir))


@query(f"""WITH {_LINKS}, {X.SQL_NODES}, e AS (SELECT src, dst, CAST(round({X.sql_haversine('a.lon', 'a.lat', 'b.lon', 'b.lat')} * 10) AS FLOAT) / 10::FLOAT AS w, CAST(CAST(greatest(a.depth, b.depth) AS DOUBLE) / (SELECT max(depth) FROM gnodes) AS FLOAT) AS r FROM links JOIN gnodes a ON a.node_id = src JOIN gnodes b ON b.node_id = dst)
SELECT src, dst, round(CAST(w AS DOUBLE), 3) AS base_w, round(CAST(r AS DOUBLE), 5) AS depth_ratio FROM e UNION ALL SELECT dst, src, round(CAST(w AS DOUBLE), 3), round(CAST(r AS DOUBLE), 5) FROM e""")
def directed_edges(spark, sf_dir):
    nodes = X.graph_nodes(spark, sf_dir)
    e = G.with_ends(X.links(spark, sf_dir), nodes).select("src", "dst", geo.haversine_km("lon1", "lat1", "lon2", "lat2").alias("weight_km"))
    return G.directed(e, nodes).select("src", "dst", F.round(F.col("base_w").cast("double"), 3).alias("base_w"), F.round(F.col("depth_ratio").cast("double"), 5).alias("depth_ratio"))


# ---- nearest, snapping, shortest paths ----


@query(f"WITH {X.SQL_PORTS}, {X.SQL_NODES} SELECT port_id, node_id, CAST(rk AS INTEGER) AS rk FROM ({_KNN(16, 'ports', 'port_id', 'gnodes')})")
def nearest_nodes(spark, sf_dir):
    return nearest_k(X.ports(spark, sf_dir), X.graph_nodes(spark, sf_dir), S.SNAP_NEIGHBOURS, "port_id").select("port_id", "node_id", "rk")


def _sql_clear_near(pairs: str, key: str, step: float, from_a: float, from_b: float, name: str) -> str:
    """As _sql_clear(), but only with samples in the boxes of rings, widened by two raster cells: elsewhere is no land."""
    m = f"{2 * X.CELL}::DOUBLE"
    t = lambda lo, hi, a, b: f"CASE WHEN {b} = {a} THEN CASE WHEN {a} BETWEEN {lo} AND {hi} THEN 0 ELSE 2 END ELSE least(({lo} - {a}) / ({b} - {a}), ({hi} - {a}) / ({b} - {a})) END, CASE WHEN {b} = {a} THEN 1 ELSE greatest(({lo} - {a}) / ({b} - {a}), ({hi} - {a}) / ({b} - {a})) END"
    lon, lat = t(f"b.min_lon - {m}", f"b.max_lon + {m}", "x1", "x2"), t(f"b.min_lat - {m}", f"b.max_lat + {m}", "y1", "y2")
    (x_lo, x_hi), (y_lo, y_hi) = (v.replace(" END, CASE", " END\x00CASE").split("\x00") for v in (lon, lat))
    return f"""{name}n AS (SELECT *, greatest(2, CAST(ceil(km / {step}::DOUBLE) AS BIGINT)) AS n FROM {pairs}),
{name}r AS (SELECT l.{key}, n, greatest(0, {x_lo}, {y_lo}) AS t0, least(1, {x_hi}, {y_hi}) AS t1 FROM {name}n l, boxes b),
{name}i AS (SELECT DISTINCT {key}, unnest(range(greatest(0, CAST(floor(t0 * n) AS BIGINT) - 1), least(n, CAST(ceil(t1 * n) AS BIGINT) + 1) + 1)) AS i FROM {name}r WHERE t0 <= t1),
{name}s AS (SELECT l.{key} * 100000 + i AS pid, l.{key}, x1 + (i::DOUBLE / n) * (x2 - x1) AS lon, y1 + (i::DOUBLE / n) * (y2 - y1) AS lat FROM {name}n l JOIN {name}i s ON s.{key} = l.{key} WHERE km >= 1e-6 AND (i::DOUBLE / n) * km > {from_a} AND (1 - i::DOUBLE / n) * km > {from_b}),
{X.sql_precise(f'{name}s', 'pid', f'{name}p')}, {name} AS (SELECT l.{key}, coalesce(NOT bool_or(p.on_land), true) AS clear FROM {pairs} l LEFT JOIN {name}s s ON s.{key} = l.{key} LEFT JOIN {name}p p ON p.pid = s.pid GROUP BY l.{key})"""


@query(f"""WITH {X.SQL_PORTS}, {X.SQL_NODES}, {X.sql_rings()}, {X.sql_runs()}, near AS ({_KNN(16, 'ports', 'port_id', 'gnodes')}),
k AS (SELECT *, port_id * 100 + rk AS lid, nlon AS x1, nlat AS y1, lon AS x2, lat AS y2, {X.sql_haversine('nlon', 'nlat', 'lon', 'lat')} AS km FROM near), {_sql_clear_near('k', 'lid', 1.0, -1.0, 0.6, 'cl')}
SELECT port_id, arg_min(node_id, CASE WHEN clear THEN 0 ELSE 100 END + rk) AS node_id FROM k JOIN cl USING (lid) GROUP BY port_id""")
def snap_to_water(spark, sf_dir):
    return G.snap(X.ports(spark, sf_dir), X.graph_nodes(spark, sf_dir), _land(spark, sf_dir))


# rounds: no cheapest way in a ten-wide grid has more steps than this
_SOURCES = "(SELECT node FROM cells ORDER BY node LIMIT 1)"
_COSTS = f"{_GRID}, walk AS (SELECT {_SOURCES} AS node, 0::DOUBLE AS cost, 0 AS step UNION ALL SELECT node, min(cost), step FROM (SELECT a.dst AS node, round(w.cost + a.w, 6) AS cost, w.step + 1 AS step FROM walk w JOIN arcs a ON a.src = w.node WHERE w.step < (SELECT 12 + max(y) FROM cells)) GROUP BY node, step)"


@query(f"WITH RECURSIVE {_COSTS} SELECT node, round(min(cost), 6) AS cost FROM walk GROUP BY node")
def shortest_cost(spark, sf_dir):
    cells, arcs = X.grid(spark, sf_dir)
    start = cells.agg(F.min("node").alias("node")).select(F.lit(0).alias("source"), "node")
    return P.shortest_costs(start, arcs.transform(cut)).select("node", F.round("cost", 6).alias("cost"))


def _sql_unwrap(k: str) -> str:
    return f"""t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS seq, {X.sql_lon(k)} AS lon FROM events),
s AS (SELECT *, lon - lag(lon) OVER (PARTITION BY user_id ORDER BY seq) AS d FROM t),
u AS (SELECT *, CASE WHEN d > 180 THEN -ceil((d - 180) / 360) WHEN d < -180 THEN ceil((-180 - d) / 360) ELSE 0 END AS turn FROM s)"""


@query(f"WITH {_sql_unwrap('event_id')} SELECT user_id, CAST(seq AS INTEGER) AS seq, round(lon + 360 * sum(turn) OVER (PARTITION BY user_id ORDER BY seq), 6) AS lon_u FROM u")
def unwrap_track(spark, sf_dir):
    from pyspark.sql import Window

    e = _table(spark, sf_dir, "events").withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("ts")))
    return G.unwrapped(e.select("user_id", "seq", X.lon(F.col("event_id")).alias("lon")), "user_id", "seq").select("user_id", "seq", F.round("lon_u", 6).alias("lon_u"))


@query(f"""WITH {X.SQL_PORTS}, {X.sql_rings()}, {X.sql_runs()}, l AS (SELECT port_id, lon + 0.3::DOUBLE AS x1, lat + 0.2::DOUBLE AS y1, lon AS x2, lat AS y2, {X.sql_haversine('lon + 0.3::DOUBLE', 'lat + 0.2::DOUBLE', 'lon', 'lat')} AS km FROM ports), {_sql_clear('l', 'port_id', 1.0, -1.0, 0.6, 'cl')} SELECT port_id, clear FROM cl""")
def stitch_connector(spark, sf_dir):
    links = X.ports(spark, sf_dir).select("port_id", (F.col("lon") + 0.3).alias("lon1"), (F.col("lat") + 0.2).alias("lat1"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    return G.connectors(links, X.rings(spark, sf_dir), _runs(spark, sf_dir).transform(cut), "port_id", X.CELL)


@query(f"""WITH p AS (SELECT conv_id, turn, {X.sql_lon('conv_id * 31 + turn')} AS lon, {X.sql_lat('conv_id * 31 + turn')} AS lat FROM conversations),
n AS (SELECT *, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, CAST(count(*) AS BIGINT) AS legs, round(sum({X.sql_haversine('lon', 'lat', 'lon2', 'lat2')}), 5) AS km FROM n WHERE lon2 IS NOT NULL GROUP BY conv_id""")
def multi_leg_totals(spark, sf_dir):
    from pyspark.sql import Window

    k = F.col("conv_id") * 31 + F.col("turn")
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = _table(spark, sf_dir, "conversations").select("conv_id", "turn", X.lon(k).alias("lon"), X.lat(k).alias("lat"))
    legs = p.withColumn("lon2", F.lead("lon").over(w)).withColumn("lat2", F.lead("lat").over(w)).where("lon2 is not null")
    return legs.groupBy("conv_id").agg(F.count("*").alias("legs"), F.round(F.sum(geo.haversine_km("lon", "lat", "lon2", "lat2")), 5).alias("km"))


@query(f"""WITH p AS (SELECT conv_id, turn, {X.sql_lon('conv_id * 31 + turn')} AS lon, {X.sql_lat('conv_id * 31 + turn')} AS lat FROM conversations)
SELECT conv_id, name, CASE name WHEN 'raw' THEN '#ff6600' WHEN 'los' THEN '#00ccff' ELSE '#ff4444' END AS color, CAST(count(*) AS INTEGER) AS point_count, CAST(arg_min(lon, turn) AS DOUBLE) AS first_lon FROM p, (VALUES ('raw'), ('los'), ('final')) f(name) GROUP BY conv_id, name""")
def geojson_features(spark, sf_dir):
    k = F.col("conv_id") * 31 + F.col("turn")
    p = _table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", X.lon(k).alias("lon"), X.lat(k).alias("lat")).alias("p")).groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    made = p.select("conv_id", F.explode(F.array(*[geojson.feature(F.lit(n), F.col("ps"), None, n) for n in ("raw", "los", "final")])).alias("f"))
    return made.select("conv_id", F.col("f.properties.name").alias("name"), F.col("f.properties.color").alias("color"), F.col("f.properties.pointCount").alias("point_count"), F.element_at(F.element_at("f.geometry.coordinates", 1), 1).alias("first_lon"))


_BODY = """CASE WHEN turn % 7 = 5 THEN '{"ports":[[' || conv_id || '.5,1]]}' WHEN turn % 7 = 6 THEN 'nonsense' ELSE
'{"ports":[[' || conv_id || '.5,' || (turn % 90) || '],[' || CASE WHEN turn % 7 = 4 THEN '1e300' ELSE '-1.25' END || ',' || (conv_id % 60) || ']' || CASE WHEN turn % 3 = 0 THEN '],"penalty":' || (1 + turn % 4) ELSE ']' END || '}' END"""


@query("""SELECT conv_id * 100 + turn AS req_id, CAST(CASE turn % 7 WHEN 5 THEN 1 WHEN 6 THEN NULL ELSE 2 END AS INTEGER) AS n_ports, CAST(CASE WHEN turn % 3 = 0 AND turn % 7 < 5 THEN 1 + turn % 4 ELSE 5 END AS DOUBLE) AS penalty,
CASE WHEN turn % 7 < 6 THEN CAST(conv_id AS DOUBLE) + 0.5::DOUBLE END AS first_lon, CASE WHEN turn % 7 >= 5 THEN 'Need ≥2 ports' WHEN turn % 7 = 4 THEN 'Invalid coords' END AS error FROM conversations""")
def parse_requests(spark, sf_dir):
    """Bodies of two ports, of one, with a coordinate beyond all bounds, and of no JSON at all."""
    bodies = _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("req_id"), F.expr(_BODY).alias("body"))
    n = F.when(F.col("ports").isNotNull(), F.size("ports"))
    return requests.multi(bodies).select("req_id", n.alias("n_ports"), F.col("penalty").cast("double").alias("penalty"), F.get("ports", F.lit(0))["lon"].alias("first_lon"), "error")


# ---- lines ----


def _calls(spark, sf_dir) -> DataFrame:
    """conv_id, line: the points of an itinerary in order."""
    k = F.col("conv_id") * 31 + F.col("turn")
    p = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", X.lon(k).alias("lon"), X.lat(k).alias("lat")))).alias("line"))
    return p


def _redrawn(lines: DataFrame, land: landindex.LandIndex, draw) -> DataFrame:
    """conv_id, seq, lon, lat of what `draw` makes of each line."""
    shared = lines.sparkSession.sparkContext.broadcast(land)

    def run(batches):
        for b in batches:
            made = routing.together([draw([(p["lon"], p["lat"]) for p in line]) for line in b["line"]], shared.value)
            sizes = list(map(len, made))
            flat = [p for line in made for p in line]
            seq = [k for n in sizes for k in range(n)]
            yield pd.DataFrame({"conv_id": b["conv_id"].repeat(sizes).to_numpy(), "seq": seq, "lon": [p[0] for p in flat], "lat": [p[1] for p in flat]})

    return lines.mapInPandas(run, "conv_id long, seq int, lon double, lat double")


@query(f"""WITH p AS (SELECT conv_id, turn, {X.sql_lon('conv_id * 31 + turn')} AS x, {X.sql_lat('conv_id * 31 + turn')} AS y FROM conversations),
n AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
c AS (SELECT conv_id, i * 2 AS o, x * 0.75::DOUBLE + x2 * 0.25::DOUBLE AS lon, y * 0.75::DOUBLE + y2 * 0.25::DOUBLE AS lat FROM n WHERE n > 2 AND i < n UNION ALL
SELECT conv_id, i * 2 + 1, x * 0.25::DOUBLE + x2 * 0.75::DOUBLE, y * 0.25::DOUBLE + y2 * 0.75::DOUBLE FROM n WHERE n > 2 AND i < n UNION ALL
SELECT conv_id, CASE WHEN i = 1 THEN 0 ELSE 100000 END + i, x, y FROM n WHERE i = 1 OR i = n OR n < 3)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY o) - 1 AS INTEGER) AS seq, round(lon, 6) AS lon, round(lat, 6) AS lat FROM c""")
def smooth_open_water(spark, sf_dir):
    """One round of corner cutting with no land about."""
    none = landindex.build_index(X.rings(spark, sf_dir).limit(0), _runs(spark, sf_dir).limit(0), X.CELL)
    made = _redrawn(_calls(spark, sf_dir), none, lambda line: routing.smooth(line, 1))
    return made.select("conv_id", "seq", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


def _sql_sights(lines: str, name: str) -> str:
    """CTE name(key, seen) of lines(key, x0, y0, x1, y1): whether they stay in water."""
    touch = lambda x, y, u, v: f"EXISTS (SELECT 1 FROM boxes b WHERE least({x}, {u}) <= b.max_lon AND greatest({x}, {u}) >= b.min_lon AND least({y}, {v}) <= b.max_lat AND greatest({y}, {v}) >= b.min_lat)"
    return f"""{name}l AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy FROM {lines} WHERE {touch('x0', 'y0', 'x1', 'y1')}),
{name}n AS (SELECT *, CASE WHEN sqrt(dx * dx + dy * dy) * 111 < 200 THEN 1 ELSE CAST(ceil(sqrt(dx * dx + dy * dy) * 111 / 100) AS BIGINT) END AS n FROM {name}l),
{name}k AS (SELECT *, unnest(range(0, n)) AS k FROM {name}n),
{name}u AS (SELECT key, n, k, dx, dy, x0 + (k::DOUBLE / n) * dx AS u, y0 + (k::DOUBLE / n) * dy AS v, x0 + ((k + 1)::DOUBLE / n) * dx AS p, y0 + ((k + 1)::DOUBLE / n) * dy AS q FROM {name}k),
{name}p AS (SELECT key, k, u, v, CASE WHEN n = 1 THEN dx ELSE p - u END AS du, CASE WHEN n = 1 THEN dy ELSE q - v END AS dv FROM {name}u WHERE n = 1 OR {touch('u', 'v', 'p', 'q')}),
{name}m AS (SELECT *, sqrt(du * du + dv * dv) AS len, greatest(2, CAST(ceil(sqrt(du * du + dv * dv) * 111) AS BIGINT)) AS m FROM {name}p),
{name}i AS (SELECT *, unnest(range(1, m)) AS i FROM {name}m),
{name}s AS (SELECT key AS pid, u + (i::DOUBLE / m) * du - side * (CASE WHEN len > 1e-10 THEN dv / len * 0.027::DOUBLE ELSE 0 END) AS lon, v + (i::DOUBLE / m) * dv + side * (CASE WHEN len > 1e-10 THEN du / len * 0.027::DOUBLE ELSE 0 END) AS lat FROM {name}i, (VALUES (0), (1), (-1)) t(side)),
{X.sql_on_land(f'{name}s', 'pid', f'{name}w')},
{name} AS (SELECT key, key NOT IN (SELECT pid FROM {name}w WHERE on_land) AS seen FROM {lines})"""


_LINE_POINTS = f"pts AS (SELECT conv_id, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, {X.sql_lon('conv_id * 31 + turn')} AS x, {X.sql_lat('conv_id * 31 + turn')} AS y FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"
_RATIOS = ", ".join(f"({k}, {r}::DOUBLE)" for k, r in enumerate(S.SMOOTH_RATIOS, 1))


def _sql_smooth(src: str, out: str) -> str:
    """CTEs up to out(conv_id, i, n, x, y): a round of corner cutting of src.  What a side may be cut like depends on the side before."""
    return f"""{out}a AS (SELECT a.conv_id, a.i, a.n, k, a.x AS sx, a.y AS sy, b.x AS ex, b.y AS ey, a.x * (1 - r) + b.x * r AS qx, a.y * (1 - r) + b.y * r AS qy, a.x * r + b.x * (1 - r) AS rx, a.y * r + b.y * (1 - r) AS ry
  FROM {src} a JOIN {src} b ON b.conv_id = a.conv_id AND b.i = a.i + 1, (VALUES {_RATIOS}) t(k, r) WHERE a.n > 2),
{out}o AS (SELECT conv_id, i, 0 AS o, sx AS x, sy AS y FROM {out}a WHERE k = 1 UNION ALL SELECT conv_id, i + 1, k, rx, ry FROM {out}a WHERE i + 1 < n),
{out}c AS (SELECT conv_id * 1000000 + i * 1000 + k * 10 + 9 AS key, qx AS x0, qy AS y0, rx AS x1, ry AS y1 FROM {out}a
  UNION ALL SELECT a.conv_id * 1000000 + a.i * 1000 + k * 10 + o, o.x, o.y, qx, qy FROM {out}a a JOIN {out}o o ON o.conv_id = a.conv_id AND o.i = a.i),
{out}e AS (SELECT conv_id * 1000000 + i * 1000 + k * 10 + side AS pid, CASE side WHEN 0 THEN qx ELSE rx END AS lon, CASE side WHEN 0 THEN qy ELSE ry END AS lat FROM {out}a, (VALUES (0), (1)) t(side)),
{X.sql_on_land(f'{out}e', 'pid', f'{out}d')}, {_sql_sights(f'{out}c', f'{out}v')},
{out}f AS (SELECT a.conv_id, a.i, o.o, coalesce(min(a.k) FILTER (WHERE NOT d0.on_land AND NOT d1.on_land AND v9.seen AND vo.seen), 0) AS cut FROM {out}a a JOIN {out}o o ON o.conv_id = a.conv_id AND o.i = a.i
  JOIN {out}d d0 ON d0.pid = a.conv_id * 1000000 + a.i * 1000 + a.k * 10 JOIN {out}d d1 ON d1.pid = d0.pid + 1 JOIN {out}v v9 ON v9.key = d0.pid + 9 JOIN {out}v vo ON vo.key = d0.pid + o.o GROUP BY 1, 2, 3),
{out}w AS (SELECT conv_id, i, cut FROM {out}f WHERE i = 1 AND o = 0 UNION ALL SELECT f.conv_id, f.i, f.cut FROM {out}w w JOIN {out}f f ON f.conv_id = w.conv_id AND f.i = w.i + 1 AND f.o = w.cut),
{out}p AS (SELECT conv_id, i * 10 AS nr, x, y FROM {src} WHERE n <= 2 UNION ALL SELECT conv_id, 0, x, y FROM {src} WHERE n > 2 AND i = 1 UNION ALL SELECT conv_id, 100000, x, y FROM {src} WHERE n > 2 AND i = n
  UNION ALL SELECT a.conv_id, a.i * 10 + side, CASE WHEN cut = 0 AND side = 0 THEN sx WHEN cut = 0 THEN ex WHEN side = 0 THEN qx ELSE rx END, CASE WHEN cut = 0 AND side = 0 THEN sy WHEN cut = 0 THEN ey WHEN side = 0 THEN qy ELSE ry END
  FROM {out}w w JOIN {out}a a ON a.conv_id = w.conv_id AND a.i = w.i AND a.k = greatest(w.cut, 1), (VALUES (0), (1)) t(side)),
{out}g AS (SELECT *, lag(x) OVER v AS px, lag(y) OVER v AS py FROM {out}p WINDOW v AS (PARTITION BY conv_id ORDER BY nr)),
{out} AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY nr) AS i, count(*) OVER (PARTITION BY conv_id) AS n, x, y FROM {out}g WHERE px IS NULL OR abs(x - px) >= 1e-9 OR abs(y - py) >= 1e-9)"""


@query(f"WITH RECURSIVE {X.sql_rings()}, {X.sql_runs()}, {_LINE_POINTS}, {_sql_smooth('pts', 'one')}, {_sql_smooth('one', 'two')} SELECT conv_id, CAST(i - 1 AS INTEGER) AS seq, round(x, 6) AS lon, round(y, 6) AS lat FROM two")
def smooth_coast(spark, sf_dir):
    """Two rounds of corner cutting beside land."""
    made = _redrawn(_calls(spark, sf_dir), _land(spark, sf_dir), lambda line: routing.smooth(line, 2))
    return made.select("conv_id", "seq", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(f"""WITH RECURSIVE {X.sql_rings()}, {X.sql_runs()}, {_LINE_POINTS}, far AS (SELECT a.conv_id * 1000000 + a.i * 1000 + b.i AS key, a.conv_id, a.i, b.i AS j, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM pts a JOIN pts b ON b.conv_id = a.conv_id AND b.i > a.i + 1),
{_sql_sights('far', 'seen')}, nxt AS (SELECT p.conv_id, p.i, coalesce(min(f.j) FILTER (WHERE NOT s.seen) - 1, any_value(p.n)) AS j FROM pts p LEFT JOIN far f ON f.conv_id = p.conv_id AND f.i = p.i LEFT JOIN seen s ON s.key = f.key GROUP BY p.conv_id, p.i),
walk AS (SELECT conv_id, 1::BIGINT AS i, 0 AS seq FROM pts WHERE i = 1 UNION ALL SELECT w.conv_id, n.j, w.seq + 1 FROM walk w JOIN nxt n ON n.conv_id = w.conv_id AND n.i = w.i WHERE n.j > w.i)
SELECT conv_id, CAST(seq AS INTEGER) AS seq, x AS lon, y AS lat FROM walk JOIN pts USING (conv_id, i)""")
def line_of_sight(spark, sf_dir):
    return _redrawn(_calls(spark, sf_dir), _land(spark, sf_dir), routing.by_sight)


def _thinned(line):
    """simplify() among the functions that may ask about land; it doesn't."""
    yield from ()
    return routing.simplify(routing.unwrap(line), 5.0)


@query(f"""WITH RECURSIVE {_LINE_POINTS}, st AS (SELECT *, x - lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS d FROM pts),
un AS (SELECT conv_id, i, n, y, x + 360 * sum(CASE WHEN d > 180 THEN -ceil((d - 180) / 360) WHEN d < -180 THEN ceil((-180 - d) / 360) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS x FROM st),
pr AS (SELECT a.conv_id, a.i AS a, b.i AS b, k.i AS k, a.x AS x1, a.y AS y1, b.x - a.x AS dx, b.y - a.y AS dy, k.x, k.y FROM un a JOIN un b ON b.conv_id = a.conv_id AND b.i > a.i + 1 JOIN un k ON k.conv_id = a.conv_id AND k.i > a.i AND k.i < b.i),
tt AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE least(greatest((x - x1) * dx + (y - y1) * dy / (dx * dx + dy * dy), 0), 1) END AS t FROM pr),
ds AS (SELECT conv_id, a, b, k, sqrt(pow(x - (x1 + t * dx), 2) + pow(y - (y1 + t * dy), 2)) AS d FROM tt),
far AS (SELECT * FROM ds QUALIFY row_number() OVER (PARTITION BY conv_id, a, b ORDER BY d DESC, k) = 1),
seg AS (SELECT conv_id, 1::BIGINT AS a, n AS b FROM un WHERE i = 1 UNION ALL SELECT s.conv_id, CASE side WHEN 0 THEN s.a ELSE f.k END, CASE side WHEN 0 THEN f.k ELSE s.b END FROM seg s JOIN far f ON f.conv_id = s.conv_id AND f.a = s.a AND f.b = s.b, (VALUES (0), (1)) t(side) WHERE f.d > 5),
kept AS (SELECT conv_id, a AS i FROM seg UNION SELECT conv_id, b FROM seg)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS INTEGER) AS seq, x AS lon, y AS lat FROM kept JOIN un USING (conv_id, i)""")
def simplify_lines(spark, sf_dir):
    return _redrawn(_calls(spark, sf_dir), _land(spark, sf_dir), _thinned)


# ---- the whole engine over the derived world ----


def _engine(spark, sf_dir, depth=5) -> E.Engine:
    return E.Engine.generate(X.rings(spark, sf_dir), depth, X.CELL)


def _requests(spark, sf_dir) -> DataFrame:
    p = X.ports(spark, sf_dir)
    q = X.ports(spark, sf_dir).select((F.col("port_id") - 7).alias("port_id"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    point = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    return p.join(q, "port_id").select(F.col("port_id").alias("req_id"), F.array(point("lon", "lat"), point("lon2", "lat2")).alias("ports"), F.lit(S.PENALTY).cast("float").alias("penalty"), F.lit(None).cast("string").alias("error"))


@query()
def routes(spark, sf_dir):
    """A route for every port to the seventh after it."""
    r = _engine(spark, sf_dir).routes(_requests(spark, sf_dir))
    return r.select("req_id", F.round("cost_km", 3).alias("cost_km"), "nodes_explored", F.size("raw").alias("raw"), F.size("los").alias("los"), F.size("final").alias("final"), "error")


@query()
def itineraries(spark, sf_dir):
    k = F.col("conv_id") * 31 + F.col("turn")
    p = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", X.lon(k).alias("lon"), X.lat(k).alias("lat")))).alias("t"))
    r = p.select(F.col("conv_id").alias("req_id"), F.transform("t", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("ports"), F.lit(S.PENALTY).cast("float").alias("penalty"))
    r = r.withColumn("error", F.when(F.size("ports") < 2, "Need ≥2 ports"))
    return _engine(spark, sf_dir).routes(r).select("req_id", F.round("cost_km", 3).alias("cost_km"), "nodes_explored", "legs", F.size("raw").alias("raw"), F.size("final").alias("final"), "error")


@query()
def route_geojson(spark, sf_dir):
    return E.to_geojson(_engine(spark, sf_dir).routes(_requests(spark, sf_dir)).withColumn("time_ms", F.lit(0.0)))


def _sql_world(depth: int) -> str:
    """CTEs up to edges(src, dst, km) of the graph that Engine.generate() makes of the derived rings, land and all."""
    levels = [_sql_level(0, "SELECT 0 AS ix, 0 AS iy", depth), *[_sql_level(d, _sql_kids(f"l{d - 1}"), depth) for d in range(1, depth + 1)]]
    every = " UNION ALL ".join(f"SELECT * FROM l{d}" for d in range(depth + 1))
    bound = "-180.0::DOUBLE + ix * 360.0::DOUBLE / pow(2, depth) AS min_lon, -90.0::DOUBLE + iy * 180.0::DOUBLE / pow(2, depth) AS min_lat, -180.0::DOUBLE + (ix + 1) * 360.0::DOUBLE / pow(2, depth) AS max_lon, -90.0::DOUBLE + (iy + 1) * 180.0::DOUBLE / pow(2, depth) AS max_lat"
    out = [X.sql_rings(), X.sql_runs(), *levels, f"lv{depth} AS (SELECT depth, ix, iy, type, {bound} FROM ({every}) WHERE type <> 'mixed')"]
    for d in range(depth, 0, -1):  # four water siblings become one, unless land is within a tenth of their width
        e = "(w.max_lon - w.min_lon) * 0.1"
        out.append(f"""m{d} AS (SELECT ix // 2 AS px, iy // 2 AS py FROM lv{d} w WHERE type = 'water' AND depth = {d} GROUP BY ix // 2, iy // 2 HAVING count(*) = 4
  AND bool_and(NOT EXISTS (SELECT 1 FROM lv{d} b WHERE b.type = 'land' AND b.min_lon <= w.max_lon + {e} AND b.max_lon >= w.min_lon - {e} AND b.min_lat <= w.max_lat + {e} AND b.max_lat >= w.min_lat - {e})))""")
        out.append(f"""lv{d - 1} AS (SELECT * FROM lv{d} l WHERE NOT (type = 'water' AND depth = {d} AND EXISTS (SELECT 1 FROM m{d} m WHERE m.px = l.ix // 2 AND m.py = l.iy // 2))
  UNION ALL SELECT depth, ix, iy, type, {bound} FROM (SELECT {d - 1} AS depth, px AS ix, py AS iy, 'water' AS type FROM m{d}))""")
    digits = " || ".join(f"CASE WHEN depth > {k} THEN CAST(((iy >> (depth - {k + 1})) % 2) * 2 + (ix >> (depth - {k + 1})) % 2 AS VARCHAR) ELSE '0' END" for k in range(depth))
    out.append(f"ids AS (SELECT row_number() OVER (ORDER BY {digits} DESC) - 1 AS node_id, * FROM lv0 WHERE type = 'water')")
    out.append("base AS (SELECT node_id, (min_lon + max_lon) / 2 AS lon, (min_lat + max_lat) / 2 AS lat FROM ids)")
    seam = "SELECT e.node_id AS src, w.node_id AS dst, 360.0::DOUBLE AS turn FROM ids e JOIN ids w ON e.max_lon >= 180 - 1e-6 AND w.min_lon <= -180 + 1e-6 AND NOT (e.min_lat >= w.max_lat OR w.min_lat >= e.max_lat)"
    out += [_ADJ, f"ends AS (SELECT p.src, p.dst, a.lon AS x1, a.lat AS y1, b.lon + p.turn AS x2, b.lat AS y2 FROM (SELECT src, dst, 0.0::DOUBLE AS turn FROM adj UNION ALL {seam}) p JOIN base a ON a.node_id = p.src JOIN base b ON b.node_id = p.dst)", _SPOTS]
    out.append(f"links AS (SELECT src, dst, {X.sql_haversine('x1', 'y1', 'x2', 'y2')} AS km FROM ends e WHERE NOT EXISTS (SELECT 1 FROM crossing c WHERE c.src = e.src AND c.dst = e.dst))")
    out.append("reach AS (SELECT node_id, node_id AS other FROM base UNION SELECT r.node_id, e.b FROM reach r JOIN (SELECT src AS a, dst AS b FROM links UNION ALL SELECT dst, src FROM links) e ON e.a = r.other), comps AS (SELECT node_id, min(other) AS comp FROM reach GROUP BY node_id)")
    out += [_MAIN, "isl AS (SELECT node_id AS island, lon, lat FROM base WHERE node_id NOT IN (SELECT node_id FROM comps WHERE comp = (SELECT comp FROM main))), mains AS (SELECT * FROM base WHERE node_id IN (SELECT node_id FROM comps WHERE comp = (SELECT comp FROM main)))"]
    out += [_BRIDGES, _WAY.replace("SELECT count(*) FROM supplier", "SELECT count(*) FROM base"), f"wends AS (SELECT node_id AS end_id, lon, lat FROM way w WHERE seq = 0 OR seq = (SELECT max(seq) FROM way v WHERE v.canal = w.canal)), wnear AS ({_KNN(5, 'wends', 'end_id', 'base')})"]
    out.append(f"""edges AS (SELECT src, dst, km FROM links UNION ALL SELECT island, main_id, km FROM bridged UNION ALL
  SELECT a.node_id, b.node_id, {X.sql_haversine('a.lon', 'a.lat', 'b.lon', 'b.lat')} FROM way a JOIN way b ON a.canal = b.canal AND b.seq = a.seq + 1 UNION ALL
  SELECT end_id, node_id, {X.sql_haversine('lon', 'lat', 'nlon', 'nlat')} FROM wnear WHERE {X.sql_haversine('lon', 'lat', 'nlon', 'nlat')} < 100)""")
    return ", ".join(out)


@query(f"WITH RECURSIVE {_sql_world(5)} SELECT src, dst, round(km, 3) AS km FROM edges")
def world_graph_edges(spark, sf_dir):
    return _engine(spark, sf_dir).edges.select("src", "dst", F.round("weight_km", 3).alias("km"))


# cells lie 0.008 degrees apart, so that the great circle is never more than a link's base weight; depths give every link its penalty
_STEEP = "CAST(CAST(greatest(1 + src % 16, 1 + dst % 16) AS DOUBLE) / (SELECT max(1 + node % 16) FROM cells) AS FLOAT)"
_RISE = f"(({_STEEP} - 0.2::FLOAT) / (1::FLOAT - 0.2::FLOAT))"


@query(f"""WITH RECURSIVE {_GRID}, steep AS (SELECT src, dst, CAST(CASE WHEN {_STEEP} <= 0.2::FLOAT THEN CAST(w AS FLOAT) ELSE CAST(w AS FLOAT) * (1::FLOAT + 4::FLOAT * {_RISE} * {_RISE}) END AS DOUBLE) AS w FROM arcs),
walk AS (SELECT {_SOURCES} AS node, 0::DOUBLE AS cost, 0 AS step UNION ALL SELECT node, min(cost), step FROM (SELECT a.dst AS node, w.cost + a.w AS cost, w.step + 1 AS step FROM walk w JOIN steep a ON a.src = w.node WHERE w.step < (SELECT 40 + max(y) FROM cells)) GROUP BY node, step)
SELECT node, round(min(cost), 3) AS cost FROM walk WHERE node <> {_SOURCES} GROUP BY node""")
def astar_cost(spark, sf_dir):
    """The search in memory, with its heuristic and penalty 5, to every cell of the grid that it reaches from the first."""
    cells, arcs = X.grid(spark, sf_dir)
    placed = cells.select(F.col("node").alias("node_id"), (F.col("x") * 0.008).alias("lon"), (F.col("y") * 0.008).alias("lat"), (1 + F.col("node") % 16).cast("int").alias("depth"))
    g = routing.load(placed, arcs.where("src < dst").select("src", "dst", F.col("w").alias("weight_km")))
    ids = np.sort(cells.select("node").toPandas()["node"].to_numpy())
    shared = spark.sparkContext.broadcast((g, ids))

    def run(batches):
        g, ids = shared.value
        nodes = np.concatenate([np.zeros(0, np.int64), *(b["node"].to_numpy() for b in batches)])  # no more than the graph has
        cost = routing.costs(g, 0, np.searchsorted(ids, nodes), S.PENALTY)
        out = pd.DataFrame({"node": nodes, "cost": cost})[np.isfinite(cost) & (nodes != ids[:1])]
        for at in range(0, len(out), 10_000):
            yield out.iloc[at : at + 10_000]

    found = cells.select("node").mapInPandas(run, "node long, cost double")
    return found.select("node", F.round("cost", 3).alias("cost"))  # rounds halves up, as SQL does
