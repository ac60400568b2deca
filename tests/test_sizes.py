"""Operators on more rows than a step, a task or the driver should hold at once."""

import heapq
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from nautigraph import fixtures as X
from nautigraph import queries as N
from nautigraph import semantics as S
from nautigraph.functions.cut import cut
from nautigraph.functions.tiles import sized
from nautigraph.operators import graph as G
from nautigraph.operators import land as L
from nautigraph.operators import paths as P
from nautigraph.plans import routing


def plain(start, arcs):
    """Dijkstra's algorithm: cost of every node that start reaches."""
    cost, heap, out = {start: 0.0}, [(0.0, start)], defaultdict(list)
    for a, b, w in arcs:
        out[a].append((b, w))
    while heap:
        c, k = heapq.heappop(heap)
        for j, w in out[k] if c == cost[k] else ():
            if c + w < cost.get(j, float("inf")):
                cost[j] = c + w
                heapq.heappush(heap, (c + w, j))
    return cost


def test_shortest_costs_take_rounds_by_blocks(spark, monkeypatch):
    """Random graphs and a long chain against Dijkstra's algorithm; a chain of hundreds of steps takes a few rounds."""
    rounds = []
    monkeypatch.setattr(P, "cut", lambda df: rounds.append(1) or cut(df))
    rnd = random.Random(4)
    loose = [(rnd.randrange(-50, 50), rnd.randrange(-50, 50), rnd.choice((0.0, 0.1, 1.7, 3.0))) for _ in range(180)]
    chain = [(k, k + 1, 0.1) for k in range(600)] + [(k + 1, k, 0.1) for k in range(600)]
    for arcs, starts, block, most in ((loose, {"a": -50, "b": 7, None: 3}, 60, 60), (chain, {"a": 300}, 200, 12), (chain, {"a": 0}, 10**6, 4), ([], {"a": 1}, 10, 4)):
        rounds.clear()
        sources = spark.createDataFrame(list(starts.items()), "source string, node long")
        got = P.shortest_costs(sources, spark.createDataFrame(arcs, "src long, dst long, w double"), block)
        assert {(r["source"], r["node"]): r["cost"] for r in got.collect()} == {(s, k): c for s, start in starts.items() for k, c in plain(start, arcs).items()}
        assert len(rounds) <= most
    nothing = spark.createDataFrame([(0, None)], "source int, node long")
    assert [tuple(r) for r in P.shortest_costs(nothing, spark.createDataFrame([], "src long, dst long, w double")).collect()] == [(0, None, 0.0)]


def test_costs_to_many_ends_equal_searches(spark, monkeypatch):
    """One search for all ends gives what a search for each gives, and settles a node once for all of them."""
    rnd = random.Random(5)
    nodes = [(k, rnd.uniform(0, 0.5), rnd.uniform(0, 0.5), rnd.randint(1, 16)) for k in range(120)]
    edges = [(a, b, 111.2 * (np.hypot(nodes[a][1] - nodes[b][1], nodes[a][2] - nodes[b][2]) + 0.01)) for a in range(110) for b in rnd.sample(range(110), 2) if a < b]
    g = routing.load(spark.createDataFrame(nodes, "node_id long, lon double, lat double, depth int"), spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src long, dst long, weight_km double"))
    ends = np.array([7, 7, *rnd.sample(range(120), 60), 119])
    wanted = [found[1] if (found := routing.search(g, 7, int(k), S.PENALTY)) else np.inf for k in ends]
    assert np.isinf(wanted).any() and routing.costs(g, 7, ends, S.PENALTY).tolist() == pytest.approx(wanted, rel=1e-12)
    assert [routing.costs(g, 7, np.array([k]), S.PENALTY)[0] for k in ends[:9]] == wanted[:9] and not len(routing.costs(g, 7, ends[:0], S.PENALTY))
    settled = []
    monkeypatch.setattr(routing, "_settled", lambda *a, f=routing._settled: (settled.append(k) or k for k in f(*a)))
    routing.costs(g, 7, ends, S.PENALTY)
    assert len(settled) == len(set(settled)) > 0


def test_costs_on_a_long_grid(spark, tmp_path):
    """astar_cost on 20 times the suppliers of sf0.1, where a search for each cell settled some 150 million nodes; and on none."""
    duckdb.execute(f"COPY (SELECT i AS s_suppkey FROM range(20000) t(i)) TO '{tmp_path}/supplier.parquet'")
    cells = {k for k in range(20000) if k % 7 != 3}
    arcs, f = [], np.float32
    for k in cells:
        for dx, dy in ((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b):
            j = k + 10 * dy + dx
            if 0 <= k % 10 + dx < 10 and j in cells:
                ratio = f(max(1 + k % 16, 1 + j % 16)) / f(16)
                w, t = f(1.4 if dx and dy else 1.0), (ratio - f(0.2)) / (f(1) - f(0.2))
                arcs.append((k, j, float(w if ratio <= f(0.2) else w * (f(1) + f(4) * t * t))))
    want = plain(0, arcs)
    got = {r["node"]: r["cost"] for r in N.queries()["astar_cost"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() - {0} and all(abs(got[k] - want[k]) < 0.001 for k in got)
    duckdb.execute(f"COPY (SELECT i AS s_suppkey FROM range(0) t(i)) TO '{tmp_path}/supplier.parquet'")
    assert not N.queries()["astar_cost"](spark, str(tmp_path)).count()


def test_connectors_join_samples_with_land_only(spark, sf, monkeypatch):
    """Samples meet rings and runs and no samples: such a side passed through the driver; rings and runs that are too many don't either."""
    k = F.col("id") * 137
    links = spark.range(3000).select(k.alias("port_id"), (X.lon(k) + 0.3).alias("lon1"), (X.lat(k) + 0.2).alias("lat1"), X.lon(k).alias("lon2"), X.lat(k).alias("lat2"))
    runs = N._runs(spark, sf).transform(cut)
    sent = G.connectors(links, X.rings(spark, sf), runs, "port_id", X.CELL)
    assert sent._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    monkeypatch.setattr(L, "sized", lambda side, weight=None: sized(side, weight, 0))
    dealt = G.connectors(links, X.rings(spark, sf), runs, "port_id", X.CELL)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 2 and "BroadcastHashJoin" not in plan
    rows = sorted(map(tuple, sent.collect()))
    assert rows == sorted(map(tuple, dealt.collect())) and len(rows) == 3000 and {clear for _, clear in rows} == {True, False}
