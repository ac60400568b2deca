"""Relations with coordinates, derived from the star-schema tables by integer arithmetic; in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.geojson import with_boxes

#: Raster cell in degrees of the derived world; the engine's own default is far finer.
CELL = 0.5


def lon(k: Column) -> Column:
    return ((k.cast("bigint") * 7919) % 36000).cast("double") / 100.0 - 180.0


def lat(k: Column) -> Column:
    return ((k.cast("bigint") * 104729) % 14000).cast("double") / 100.0 - 70.0


def sql_lon(k: str) -> str:
    return f"(CAST((CAST({k} AS BIGINT) * 7919) % 36000 AS DOUBLE) / 100.0::DOUBLE - 180.0::DOUBLE)"


def sql_lat(k: str) -> str:
    return f"(CAST((CAST({k} AS BIGINT) * 104729) % 14000 AS DOUBLE) / 100.0::DOUBLE - 70.0::DOUBLE)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select(k.alias("port_id"), lon(k).alias("lon"), lat(k).alias("lat"))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return _table(spark, sf_dir, "supplier").select(k.alias("node_id"), lon(k).alias("lon"), lat(k).alias("lat"), (1 + k % 16).cast("int").alias("depth"))


def rings(spark: SparkSession, sf_dir: str, shifted: bool = False) -> DataFrame:
    """A square for each nation; shifted: each once more, 0.7 degrees to the east."""
    k = F.col("n_nationkey").cast("bigint")
    half = F.lit(0.4) + (k % 5).cast("double")
    x, y = lon(k), lat(k)
    corner = lambda sx, sy, dx: F.struct((x + dx + half * sx).alias("lon"), (y + half * sy).alias("lat"))
    square = lambda dx: F.array(*[corner(sx, sy, F.lit(dx)) for sx, sy in ((-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0))])
    nation = _table(spark, sf_dir, "nation")
    out = nation.select(k.alias("ring_id"), square(0.0).alias("pts"))
    if shifted:
        out = out.unionByName(nation.select((k + 100).alias("ring_id"), square(0.7).alias("pts")))
    return with_boxes(out)


def grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(cells, arcs): open cells of a ten-wide grid of suppliers, and their links to the eight around them, both ways."""
    k = F.col("s_suppkey")
    cells = _table(spark, sf_dir, "supplier").where(k % 7 != 3).select(k.alias("node"), (k % 10).alias("x"), F.floor(k / 10).alias("y"))
    around = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    reach = cells.select("node", "x", "y", F.inline(around))
    reach = reach.select("node", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), (F.round(F.sqrt((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).cast("double")) * 10.0) / 10.0).alias("w"))
    arcs = reach.join(cells.withColumnRenamed("node", "to"), ["x", "y"]).select(F.col("node").alias("src"), F.col("to").alias("dst"), "w")
    return cells, arcs


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: chains of suppliers, broken after every tenth and around every seventeenth."""
    s = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"))
    pairs = s.select("src", (F.col("src") + 1).alias("dst")).join(s.select(F.col("src").alias("dst")), "dst")
    return pairs.where("src % 10 <> 0 and src % 17 <> 0 and dst % 17 <> 0").select("src", "dst")


SQL_PORTS = f"ports AS (SELECT c_custkey AS port_id, {sql_lon('c_custkey')} AS lon, {sql_lat('c_custkey')} AS lat FROM customer)"
SQL_NODES = f"gnodes AS (SELECT s_suppkey AS node_id, {sql_lon('s_suppkey')} AS lon, {sql_lat('s_suppkey')} AS lat, CAST(1 + s_suppkey % 16 AS INTEGER) AS depth FROM supplier)"


def sql_rings(shifted: bool = False) -> str:
    """CTEs verts, redges, boxes (with span)."""
    k = "CAST(n_nationkey AS BIGINT)"
    copies = "(VALUES (0, 0.0::DOUBLE), (100, 0.7::DOUBLE)) d(add_id, dx)" if shifted else "(VALUES (0, 0.0::DOUBLE)) d(add_id, dx)"
    return f"""verts AS (
  SELECT {k} + add_id AS ring_id, seq, {sql_lon(k)} + dx + (0.4::DOUBLE + CAST({k} % 5 AS DOUBLE)) * sx AS lon, {sql_lat(k)} + (0.4::DOUBLE + CAST({k} % 5 AS DOUBLE)) * sy AS lat
  FROM nation, {copies}, (VALUES (0, -1.0::DOUBLE, -1.0::DOUBLE), (1, 1.0::DOUBLE, -1.0::DOUBLE), (2, 1.0::DOUBLE, 1.0::DOUBLE), (3, -1.0::DOUBLE, 1.0::DOUBLE)) c(seq, sx, sy)
), redges AS (
  SELECT a.ring_id, a.seq AS i, a.lon AS x0, a.lat AS y0, b.lon AS x1, b.lat AS y1 FROM verts a JOIN verts b ON a.ring_id = b.ring_id AND b.seq = (a.seq + 1) % 4
), boxes AS (
  SELECT ring_id, min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat, greatest(max(lon) - min(lon), max(lat) - min(lat)) AS span FROM verts GROUP BY ring_id
)"""


def sql_runs(cell: float = CELL) -> str:
    """CTE lcells(row, col): land cells by cell counting, not by runs."""
    rows, cols = round(180 / cell), round(360 / cell)
    c = f"(-90.0::DOUBLE + (r + 0.5::DOUBLE) * {cell}::DOUBLE)"
    col = lambda x: f"greatest(CAST(trunc(({x} + 180.0::DOUBLE) / {cell}::DOUBLE) AS BIGINT), 0)"
    return f"""crossings AS (
  SELECT ring_id, r AS row, x0 + ({c} - y0) / (y1 - y0) * (x1 - x0) AS x FROM redges, range(0, {rows}) t(r) WHERE y0 <> y1 AND least(y0, y1) <= {c} AND greatest(y0, y1) > {c}
), pairs AS (
  SELECT ring_id, row, x, lead(x) OVER w AS x2, row_number() OVER w AS n FROM crossings WINDOW w AS (PARTITION BY ring_id, row ORDER BY x)
), fills AS (
  SELECT row, least({col('x')}, {cols}) AS a, least({col('x2')} + 1, {cols}) AS b FROM pairs WHERE n % 2 = 1 AND x2 IS NOT NULL
), lcells AS (
  SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col FROM (SELECT row, unnest(range(a, b)) AS col FROM fills) GROUP BY row, col HAVING count(*) % 2 = 1
)"""


def sql_on_land(points: str, key: str, name: str = "coarse", cell: float = CELL) -> str:
    """CTE name(key, on_land) of points(key, lon, lat), by the raster."""
    x = "CASE WHEN lon >= 180 THEN lon - 360 WHEN lon < -180 THEN lon + 360 ELSE lon END"
    at = lambda v: f"greatest(CAST(trunc(({v}) / {cell}::DOUBLE) AS BIGINT), 0)"
    return f"""{name} AS (
  SELECT p.{key}, c.row IS NOT NULL AS on_land FROM (SELECT {key}, {at('lat + 90.0::DOUBLE')} AS r_, {at(f'({x}) + 180.0::DOUBLE')} AS c_ FROM {points}) p LEFT JOIN lcells c ON c.row = p.r_ AND c.col = p.c_
)"""


def sql_in_rings(points: str, key: str, name: str = "exact", where: str = "TRUE") -> str:
    """CTE name(key, tested, inside) of points against the rings that `where` picks from boxes."""
    return f"""{name} AS (
  SELECT p.{key}, count(b.ring_id) > 0 AS tested, coalesce(sum(n) % 2 = 1, false) AS inside
  FROM {points} p LEFT JOIN (SELECT * FROM boxes WHERE {where}) b ON p.lon BETWEEN b.min_lon AND b.max_lon AND p.lat BETWEEN b.min_lat AND b.max_lat
  LEFT JOIN LATERAL (SELECT count(*) AS n FROM redges e WHERE e.ring_id = b.ring_id AND (e.y1 > p.lat) <> (e.y0 > p.lat) AND p.lon < (e.x0 - e.x1) * (p.lat - e.y1) / (e.y0 - e.y1) + e.x1) x ON true
  GROUP BY p.{key}
)"""


def sql_precise(points: str, key: str, name: str = "precise") -> str:
    """CTEs up to name(key, on_land): exact near islands, by the raster elsewhere."""
    return f"""{sql_on_land(points, key, name + '_c')}, {sql_in_rings(points, key, name + '_e', 'span <= 3.0')}, {name} AS (
  SELECT c.{key}, CASE WHEN e.tested THEN e.inside ELSE c.on_land END AS on_land FROM {name}_c c JOIN {name}_e e USING ({key})
)"""


def sql_haversine(a: str, b: str, c: str, d: str) -> str:
    turn = f"(abs(({c}) - ({a})) % 360.0::DOUBLE)"
    dlon = f"radians(CASE WHEN {turn} > 180 THEN 360.0::DOUBLE - {turn} ELSE {turn} END)"
    return f"(12742.0::DOUBLE * asin(sqrt(pow(sin(radians(({d}) - ({b})) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin({dlon} / 2), 2))))"
