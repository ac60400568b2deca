"""Land, graph and routes on small worlds whose results are known."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from nautigraph import semantics as S
from nautigraph.functions.tiles import nearest_k
from nautigraph.operators import graph as G
from nautigraph.operators import land as L
from nautigraph.operators import quadtree as Q
from nautigraph.plans import routing
from nautigraph.plans.engine import LEGS, Engine, kept_raster, to_geojson
from nautigraph.plans.landindex import Boxes, build_index, haversine
from nautigraph.sources import geojson, graphs, requests

def box(x0, y0, x1, y1):
    return [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]


#: Worlds of our own: a quay beside the western node, a shoal between the nodes, an islet and a continent.
QUAY, SHOAL = box(19.3, -12.2, 19.4, -11.8), box(20.9, -12.4, 21.1, -11.9)
SMALL, LARGE = box(-140.3, 30.0, -140.1, 30.2), box(70.0, -8.0, 77.0, -2.0)


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    cache = {}

    def make(*rings, cell=S.RASTER_CELL):
        key = (json.dumps(rings), cell)
        if key not in cache:
            p = tmp_path_factory.mktemp("land") / "land.json"
            p.write_text(json.dumps({"features": [{"geometry": {"type": "Polygon", "coordinates": [r]}} for r in rings]}))
            table = geojson.land_rings(spark, str(p)).cache()
            cache[key] = table, build_index(table, L.raster_runs(L.ring_edges(table), cell), cell)
        return cache[key]

    return make


def two_nodes(spark):
    nodes = spark.createDataFrame([(0, 20.0, -12.0, 1), (1, 22.0, -12.0, 1)], "node_id long, lon double, lat double, depth int")
    return routing.load(nodes, spark.createDataFrame([(0, 1, 250.0)], "src long, dst long, weight_km double"))


def test_route_between_two_nodes(spark, world):
    """Everything by hand: 250 km at full penalty 3, connectors of 1 and 0.5 degrees of longitude at 12 degrees south."""
    ports = [(19.0, -12.0), (22.5, -12.0)]
    r = routing.itinerary(two_nodes(spark), world()[1], ports, 3.0)
    west, east = (float(haversine(0.0, -12.0, d, -12.0)) for d in (1.0, 0.5))
    assert r["cost_km"] == pytest.approx(750 + west + east, abs=1e-6) and r["explored"] == 1 and r["error"] is None
    # the literal projection keeps all points of an east-west line; in open water the ends see each other
    assert r["raw"] == [ports[0], (20.0, -12.0), (22.0, -12.0), ports[1]] and r["los"] == ports and r["final"] == ports
    mended = routing.itinerary(two_nodes(spark), world()[1], ports, 3.0, S.Semantics(literal_projection=False))
    assert mended["raw"] == ports
    # a quay on the western connector: the route begins at the node instead
    r = routing.itinerary(two_nodes(spark), world(QUAY)[1], ports, 3.0)
    assert r["raw"][0] == (20.0, -12.0) and r["raw"][-1] == ports[1] and r["cost_km"] == pytest.approx(750 + east, abs=1e-6)
    # ports at one node are joined by a straight line, at its true length
    r = routing.itinerary(two_nodes(spark), world()[1], [(19.0, -12.0), (19.5, -11.0)], 3.0)
    assert r["raw"] == [(19.0, -12.0), (19.5, -11.0)] and r["explored"] == 0 and r["cost_km"] == pytest.approx(float(haversine(19.0, -12.0, 19.5, -11.0)))


def test_unreachable_nodes_give_errors(spark, world):
    nodes = spark.createDataFrame([(k, float(x), 0.0, 1) for k, x in enumerate((0, 1, 40, 41))], "node_id long, lon double, lat double, depth int")
    g = routing.load(nodes, spark.createDataFrame([(0, 1, 100.0), (2, 3, 100.0)], "src long, dst long, weight_km double"))
    assert g.main.tolist() == [2, 3]  # of two equally large components that of the larger least node
    g.main = np.arange(4)
    g._index = None
    assert routing.itinerary(g, world()[1], [(0.0, 0.0), (41.0, 0.0)])["error"] == "No route found"
    r = routing.itinerary(g, world()[1], [(0.0, 0.0), (1.0, 0.0), (41.0, 0.0)])
    assert r["error"] == "No route for leg 2" and r["raw"] == []


def test_every_component_is_bridged_to_the_largest(spark, world):
    """Three islands east of a main chain; the shoal lies on the shortest line of one of them."""
    places = [(20.0, -12.0), (20.0, -13.0), (20.0, -14.0), (22.0, -12.0), (24.0, -14.0), (24.0, -14.5)]
    nodes = spark.createDataFrame([(k, x, y, 1) for k, (x, y) in enumerate(places)], "node_id long, lon double, lat double, depth int")
    edges = spark.createDataFrame([(0, 1, 111.0), (1, 2, 111.0), (4, 5, 55.0)], "src long, dst long, weight_km double")
    of = lambda land: sorted((r["src"], r["dst"]) for r in G.bridges(nodes, edges, land).collect())
    assert of(world()[1]) == [(3, 0), (4, 2)] and of(world(SHOAL)[1]) == [(3, 1), (4, 2)]


def test_clear_lines_and_boxes(world):
    sea, shoal = world()[1], world(SHOAL)[1]
    lines = np.array([[20.0, -12.1, 22.0, -12.1], [20.0, -13.0, 22.0, -13.0], [20.9, -12.3, 21.0, -12.3], [20.0, -12.0, 20.0, -12.0]]).T
    assert sea.clear(*lines, 2.0, 2.0, 2.0).all()
    assert shoal.clear(*lines, 2.0, 2.0, 2.0).tolist() == [False, True, False, True]
    assert shoal.clear(*lines, 2.0, 2.0, 2000.0).tolist() == [True, True, True, True]  # all but a stretch near its end is let off
    land = world(SMALL, LARGE)[1]
    boxes = [np.array(v, float) for v in zip((-141, 29, -139, 31), (69, -9, 78, -1), (-30, -30, -29, -29), (72, -6, 73, -5), (-140.3, 20, -140.2, 30))]
    assert land.overlaps(*boxes).tolist() == [True, True, False, True, True]
    assert land._small.touched(*boxes).tolist() == [True, False, False, False, True]


def test_boxes_equal_brute_force():
    rng = np.random.default_rng(8)
    for size, span in ((1.0, 3.0), (5.0, 40.0)):
        low = rng.uniform(-90, 90, (300, 2))
        boxes = np.concatenate([low, low + rng.uniform(0, span, (300, 2))], axis=1)
        index = Boxes(boxes, size)
        low = rng.uniform(-120, 120, (500, 2))
        q = np.concatenate([low, low + rng.choice([0.0, 1.0, 30.0], (500, 1)) * rng.uniform(0, 1, (500, 2))], axis=1)
        q[:20, :2] = boxes[:20, 2:]  # corners that touch
        q[:20, 2:] = q[:20, :2]
        hit = (boxes[:, 0] <= q[:, None, 2]) & (boxes[:, 2] >= q[:, None, 0]) & (boxes[:, 1] <= q[:, None, 3]) & (boxes[:, 3] >= q[:, None, 1])
        assert index.touched(*q.T).tolist() == hit.any(axis=1).tolist()
        assert set(zip(*map(np.ndarray.tolist, index.pairs(*q.T)))) == set(zip(*map(np.ndarray.tolist, np.nonzero(hit))))


def test_nearest_nodes_equal_brute_force(spark):
    """In memory and by tiles; nodes spread out, in one tile, on one spot, and fewer than asked for."""
    rng = np.random.default_rng(4)
    clouds = [rng.uniform((-180, -70), (180, 70), (400, 2)), rng.uniform((10.0, 10.0), (10.01, 10.01), (3000, 2)), np.full((30, 2), 5.0), rng.uniform(0, 1, (5, 2))]
    points = np.concatenate([rng.uniform((-180, -80), (180, 80), (40, 2)), rng.uniform((9.9, 9.9), (10.1, 10.1), (10, 2)), [[5.0, 5.0]]])
    for cloud in clouds:
        ids = rng.permutation(len(cloud)) * 3
        d2 = ((points[:, None] - cloud) ** 2).sum(axis=2)
        want = {(p, r + 1, int(ids[j])) for p in range(len(points)) for r, j in enumerate(np.lexsort((ids, d2[p]))[:16])}
        nodes = spark.createDataFrame([(int(i), float(x), float(y)) for i, (x, y) in zip(ids, cloud)], "node_id long, lon double, lat double")
        asked = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(points)] + [(99, None, 1.0)], "k long, lon double, lat double")
        for most in (10**6, 0):
            got = nearest_k(asked, nodes, 16, "k", most)
            assert {(r["k"], r["rk"], r["node_id"]) for r in got.collect()} == want


def test_empty_land(spark, world):
    table, land = world()
    assert table.count() == 0 and not land.is_land([0.0, 200.0], [0.0, 95.0]).any()


def test_multipolygon_holes_and_unknown_geometry(spark, tmp_path):
    doc = {"features": [
        {"geometry": {"type": "MultiPolygon", "coordinates": [[LARGE, [[72, -6], [73, -6], [73, -5], [72, -6]]], [SMALL, [[1, 1], [2, 2]]]]}, "properties": {"x": 1}},
        {"geometry": {"type": "Point", "coordinates": [1, 2]}}, {"geometry": None},
    ]}
    (tmp_path / "l.json").write_text(json.dumps(doc))
    rows = geojson.land_rings(spark, str(tmp_path / "l.json")).orderBy("ring_id").collect()
    assert [(r["ring_id"], len(r["pts"]), r["is_island"]) for r in rows] == [(0, 5, False), (1, 4, True), (2, 5, True)]


def test_hole_of_a_continent_counts_as_island(world):
    # inside the hole's ring: land; in its box but outside the ring: water
    hole = [[72.0, -6.0], [74.0, -6.0], [74.0, -4.0], [72.0, -6.0]]
    land = world(LARGE, hole, cell=0.1)[1]
    assert land.is_land_precise([73.5, 72.2, 71.0], [-5.0, -4.2, -7.0]).tolist() == [True, False, True]
    assert land.is_land([73.5], [-5.0]).tolist() == [False]


def test_relational_tests_agree_with_the_index(spark, world):
    table, land = world(SMALL, LARGE, SHOAL, cell=0.05)
    rng = np.random.default_rng(3)
    pts = np.concatenate([rng.uniform((-140.4, 29.9), (-140.0, 30.3), (60, 2)), rng.uniform((69, -9), (78, -1), (80, 2)), rng.uniform((20.5, -13), (21.5, -11.5), (80, 2))])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "k long, lon double, lat double")
    runs = L.raster_runs(L.ring_edges(table), 0.05).cache()
    coarse = {r["k"]: r["on_land"] for r in L.point_is_land(df, runs, 0.05).collect()}
    exact = {r["k"]: r["on_land"] for r in L.point_is_land_precise(df, table, runs, "k", 0.05).collect()}
    assert [coarse[i] for i in range(len(pts))] == land.is_land(*pts.T).tolist()
    assert [exact[i] for i in range(len(pts))] == land.is_land_precise(*pts.T).tolist()


def test_raster_file_round_trip(spark, world):
    runs = L.raster_runs(L.ring_edges(world(SMALL, LARGE)[0]), 0.5).toPandas().to_numpy(np.int64)
    data = graphs.raster_bytes(runs, 0.5)
    assert sorted(map(tuple, graphs.raster_runs_of(data, 0.5))) == sorted(map(tuple, runs))
    with pytest.raises(ValueError):
        graphs.raster_runs_of(data[:-8], 0.5)


def test_graph_json_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(0, -61.123456, 36.0, 1), (1, -60.0, 36.0, 2)], "node_id long, lon double, lat double, depth int")
    edges = spark.createDataFrame([(0, 1, 90.04)], "src long, dst long, weight_km double")
    text = graphs.graph_json(nodes, edges).first()[0]
    assert json.loads(text) == {"nodeCount": 2, "edgeCount": 1, "nodes": [-61.12346, 36.0, 1.0, -60.0, 36.0, 2.0], "edges": [0.0, 1.0, 900.0]}
    (tmp_path / "g.json").write_text(text)
    n, e = graphs.read_graph_json(spark, str(tmp_path / "g.json"))
    assert n.orderBy("node_id").collect()[0]["lon"] == -61.12346 and e.first()["weight_km"] == 90.0


def test_literal_and_mended_simplification():
    line = [(x / 10, 0.0) for x in range(200)]
    assert len(routing.simplify(line)) == 200 and len(routing.simplify(line, literal=False)) == 2
    assert len(routing.simplify([(0.0, y / 10) for y in range(200)])) == 2


def test_unwrap_and_haversine():
    path = routing.unwrap([(178.0, 0.0), (-179.0, 0.0), (-177.0, 1.0), (179.0, 0.0), (-10.0, 0.0)])
    assert [p[0] for p in path] == [178.0, 181.0, 183.0, 179.0, 350.0]
    assert float(haversine(179.0, 0.0, -179.0, 0.0)) == pytest.approx(222.39, abs=0.01)


def test_adjacency_equals_the_plain_predicate(spark):
    rng = np.random.default_rng(5)
    for _ in range(2):
        cells, out = [(0, 0, 0)], []
        while cells:
            d, x, y = cells.pop()
            if d < 9 and (d < 2 or rng.random() < (0.55 if d > 3 else 0.4)):
                cells += [(d + 1, 2 * x + i, 2 * y + j) for i in (0, 1) for j in (0, 1)]
            elif rng.random() < 0.9:
                out.append((d, x, y, "water"))
        leaves = Q.water_leaves(spark.createDataFrame(out, "depth int, ix int, iy int, type string"), 9).cache()
        rows = leaves.orderBy("node_id").toPandas()
        assert rows["node_id"].tolist() == list(range(len(out)))
        got = {(r["src"], r["dst"]) for r in G.adjacency(leaves).collect()}
        want = set()
        b = rows[["min_lon", "min_lat", "max_lon", "max_lat"]].to_numpy()
        w = b[:, 2] - b[:, 0]
        for i in range(len(b)):
            e = max(w[i] * 0.01, 1e-4)
            h = np.minimum(w[i], w) * 0.5
            ok = (b[:, 0] <= b[i, 2] + e) & (b[:, 2] >= b[i, 0] - e) & (b[:, 1] <= b[i, 3] + e) & (b[:, 3] >= b[i, 1] - e)
            ok &= (b[i, 2] >= b[:, 0] - h) & (b[:, 2] >= b[i, 0] - h) & (b[i, 3] >= b[:, 1] - h) & (b[:, 3] >= b[i, 1] - h)
            want |= {(i, int(j)) for j in np.flatnonzero(ok) if j > i}
        assert got == want


def test_requests_and_errors(spark):
    got = {r["req_id"]: r for r in requests.single(spark.createDataFrame([(1, "1,foo,2", "3,4", None), (2, "1, 2", "3,4", 2.0), (3, "1", "3,4", None), (4, None, "1,2", None)], "req_id long, from string, to string, penalty double")).collect()}
    assert got[1]["error"] is None and got[1]["penalty"] == 5.0 and got[1]["ports"][0]["lat"] == 2.0
    assert all(got[k]["error"] == "Invalid coords" for k in (2, 3, 4))
    got = {r["req_id"]: r for r in requests.multi(spark.createDataFrame([(1, '{"ports":[[1,2],[3,4]],"penalty":2.5}'), (2, '{"ports":[[1,2]]}'), (3, "nonsense"), (4, None)], "req_id long, body string")).collect()}
    assert got[1]["error"] is None and got[1]["penalty"] == 2.5
    assert all(got[k]["error"] for k in (2, 3, 4))


def test_engine_end_to_end(spark, world, tmp_path):
    table, _ = world(SMALL, LARGE, cell=0.5)
    e = Engine.generate(table, 5, 0.5)
    assert e.nodes.count() > 46  # canals, and cells around the land
    reqs = requests.multi(spark.createDataFrame([(1, '{"ports":[[65,-5],[82,-5]]}'), (2, '{"ports":[[170,0],[-170,5],[150,-20]]}'), (3, '{"ports":[[1,2]]}')], "req_id long, body string"))
    rows = {r["req_id"]: r for r in e.routes(reqs).collect()}
    assert rows[1]["error"] is None and rows[2]["legs"] == 2 and rows[3]["error"] == "Need ≥2 ports"
    assert (rows[1]["raw"][0]["lon"], rows[1]["raw"][-1]["lon"]) == (65.0, 82.0)
    steps = np.diff([p["lon"] for p in rows[2]["raw"]])
    assert abs(steps).max() <= 180
    land = e.land
    line = [(p["lon"], p["lat"]) for p in rows[1]["final"]]
    assert not any(land.is_land([x], [y])[0] for x, y in line)
    made = {r["req_id"]: json.loads(r["value"]) for r in to_geojson(e.routes(reqs)).collect()}
    assert [f["properties"]["name"] for f in made[1]["features"]] == ["raw", "los", "final"] and made[3] == {"error": "Need ≥2 ports"}
    assert "legs" not in made[1]["features"][0]["properties"] and made[2]["features"][0]["properties"]["legs"] == 2
    # few bytes, many tasks
    many = spark.range(5 * LEGS).select(F.col("id").alias("req_id"), F.lit('{"ports":[[65,-5],[82,-5]]}').alias("body")).coalesce(1)
    assert e.routes(requests.multi(many)).rdd.getNumPartitions() == 5
    assert e.healthy()
    assert e.counts["nodes"] == e.nodes.count() and e.counts["edges tested"] > e.counts["edges dropped"] >= 0 and e.counts["water leaves"] >= 3 * e.counts["merges"] >= 0
    e.save(str(tmp_path / "graph"))
    nodes, edges = graphs.read_graph(spark, str(tmp_path / "graph"))
    assert nodes.count() == e.nodes.count() and edges.count() == e.edges.count()


def test_stream_of_requests(spark, world, tmp_path):
    from nautigraph.streaming.routes import answer

    table, _ = world(SMALL, LARGE, cell=0.5)
    e = Engine.generate(table, 4, 0.5, canals=False)
    src = tmp_path / "in"
    spark.createDataFrame([(1, '{"ports":[[65,-5],[82,-5]]}'), (2, "{}")], "req_id long, body string").write.json(str(src))
    q = answer(e, spark.readStream.schema("req_id long, body string").json(str(src)), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_flags_mend_odd_rules(spark, tmp_path):
    doc = {"features": [{"geometry": {"type": "Polygon", "coordinates": [LARGE, box(72, -6, 74, -4)]}}]}
    (tmp_path / "l.json").write_text(json.dumps(doc))
    rings = geojson.land_rings(spark, str(tmp_path / "l.json")).cache()
    assert [r["is_hole"] for r in rings.orderBy("ring_id").collect()] == [False, True]
    literal = Engine.generate(rings, 3, 0.5, canals=False, coarsen=False).land
    mended = Engine.generate(rings, 3, 0.5, canals=False, coarsen=False, semantics=S.Semantics(holes_are_islands=False)).land
    assert literal.is_land_precise([73.0], [-5.0])[0] and not mended.is_land_precise([73.0], [-5.0])[0]


def test_command_line(spark, tmp_path, capsys):
    from nautigraph.__main__ import main

    land, out = str(tmp_path / "l.json"), str(tmp_path / "g")
    (tmp_path / "l.json").write_text(json.dumps({"features": [{"geometry": {"type": "Polygon", "coordinates": [LARGE]}}]}))
    several = f"{tmp_path}/detailed.json,{land}"
    assert main([]) == 2 and main(["route", out]) == 2 and main(["generate", several, out, "3"]) == 0
    assert graphs.read_raster(spark, f"{out}/raster.bin") is not None
    rows = [{"req_id": 1, "body": json.dumps({"ports": [[60, -5], [85, -5]]})}, {"req_id": 2, "from": "60,-5", "to": "85,-5", "penalty": 2.0}, {"req_id": 3, "from": "60", "to": "1,2"}]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, rows)))
    assert main(["routes", out, land, str(tmp_path / "r.json"), str(tmp_path / "a")]) == 0
    made = {r["req_id"]: json.loads(r["value"]) for r in spark.read.parquet(str(tmp_path / "a")).collect()}
    assert made[1]["type"] == made[2]["type"] == "FeatureCollection" and made[3] == {"error": "Invalid coords"}
    capsys.readouterr()
    assert main(["route", out, land, "60,-5", "85,-5", "2"]) == 0
    line = json.loads(capsys.readouterr().out)["features"][0]
    assert line["geometry"] == made[2]["features"][0]["geometry"]
    assert main(["health", out, land]) == 0


def test_raster_file_is_kept_and_read(spark, world, tmp_path):
    table, land = world(SMALL, LARGE, cell=0.5)
    path = str(tmp_path / "raster.bin")
    first = kept_raster(table, 0.5, path)
    again = kept_raster(table, 0.5, path)
    assert sorted(map(tuple, first.select("row", "col_start", "col_end").collect())) == sorted(map(tuple, again.collect()))
    assert graphs.read_raster(spark, path, 1.0) is None and graphs.read_raster(spark, path + "x", 0.5) is None  # another grid, no file
    with pytest.raises(FileNotFoundError):
        geojson.land_file(spark, [path + "x", path + "y"])
    assert geojson.land_file(spark, [path + "x", path]) == path


def test_no_land_gives_one_cell(spark, world):
    leaves = Q.build(spark, world()[1], 3)
    assert [tuple(r) for r in leaves.collect()] == [(0, 0, 0, "water")]


def test_whole_sweep_of_coarsening(spark, world):
    leaves = Q.build(spark, world(LARGE, cell=0.5)[1], 6).cache()
    coarse = Q.coarsen(leaves, 6)
    area = lambda df: df.agg(F.sum(F.pow(F.lit(4.0), -F.col("depth")))).first()[0]
    assert area(coarse) == pytest.approx(1.0) and coarse.count() <= leaves.count()
    assert coarse.where("type = 'land'").count() == leaves.where("type = 'land'").count()
