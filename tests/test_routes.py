"""Routes of the derived world against plain Python: one point, one line, one request at a time, without arrays or indexes."""

import json
import math

import pytest

from nautigraph import fixtures as X
from nautigraph import queries as N
from nautigraph.plans.engine import graphs_rounded

CELL, PENALTY = X.CELL, 5.0


def great_circle(a, b):
    (x1, y1), (x2, y2) = ((math.radians(v) for v in p) for p in (a, b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(h))


class Land:
    """Rings as lists of corners; the raster as a set of cells."""

    def __init__(self, rings, runs):
        self.rings = [[(p["lon"], p["lat"]) for p in r["pts"]] for r in rings]
        self.boxes = [(min(x for x, _ in r), min(y for _, y in r), max(x for x, _ in r), max(y for _, y in r)) for r in self.rings]
        self.cells = {(r["row"], c) for r in runs for c in range(r["col_start"], r["col_end"])}

    def coarse(self, x, y):
        x = (x + 180) % 360 - 180 if not -180 <= x < 180 else x
        return (max(int((y + 90) / CELL), 0), max(int((x + 180) / CELL), 0)) in self.cells

    def exact(self, x, y):
        near = [r for r, (a, b, c, d) in zip(self.rings, self.boxes) if max(c - a, d - b) <= 3 and a <= x <= c and b <= y <= d]
        if not near:
            return self.coarse(x, y)
        odd = False
        for r in near:
            for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1]):
                if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                    odd = not odd
        return odd

    def boxed(self, p, q):
        return any(min(p[0], q[0]) <= c and max(p[0], q[0]) >= a and min(p[1], q[1]) <= d and max(p[1], q[1]) >= b for a, b, c, d in self.boxes)

    def connector(self, node, port):
        km = great_circle(node, port)
        n = max(2, math.ceil(km))
        on = [i / n for i in range(n + 1) if (1 - i / n) * km > 0.6]
        return km < 1e-6 or not any(self.exact(node[0] + t * (port[0] - node[0]), node[1] + t * (port[1] - node[1])) for t in on)

    def sampled(self, p, q):
        dx, dy = q[0] - p[0], q[1] - p[1]
        long = math.hypot(dx, dy)
        n = max(2, math.ceil(long * 111))
        for i in range(1, n):
            x, y = p[0] + i / n * dx, p[1] + i / n * dy
            if any(self.coarse(x - s * 0.027 * dy / long, y + s * 0.027 * dx / long) for s in ((0, 1, -1) if long > 1e-10 else (0,))):
                return False
        return True

    def sight(self, p, q):
        if not self.boxed(p, q):
            return True
        km = math.hypot(q[0] - p[0], q[1] - p[1]) * 111
        if km < 200:
            return self.sampled(p, q)
        n = math.ceil(km / 100)
        cuts = [(p[0] + k / n * (q[0] - p[0]), p[1] + k / n * (q[1] - p[1])) for k in range(n + 1)]
        return all(not self.boxed(u, v) or self.sampled(u, v) for u, v in zip(cuts, cuts[1:]))


class Sea:
    def __init__(self, nodes, edges, land):
        self.land = land
        self.at = {r["node_id"]: (r["lon"], r["lat"]) for r in nodes}
        depth = {r["node_id"]: r["depth"] for r in nodes}
        deepest = max(depth.values())
        self.near = {k: [] for k in self.at}
        for r in edges:
            ratio = max(depth[r["src"]], depth[r["dst"]]) / deepest
            w = r["weight_km"] * (1 if ratio <= 0.2 else 1 + (PENALTY - 1) * ((ratio - 0.2) / 0.8) ** 2)
            self.near[r["src"]].append((r["dst"], w))
            self.near[r["dst"]].append((r["src"], w))
        left, parts = {k for k, v in self.near.items() if v}, []
        while left:
            part, todo = set(), [min(left)]
            while todo:
                k = todo.pop()
                if k not in part:
                    part.add(k)
                    todo += [j for j, _ in self.near[k]]
            parts.append(part)
            left -= part
        self.main = max(parts, key=lambda p: (len(p), min(p)))

    def snap(self, p):
        near = sorted(self.main, key=lambda k: ((self.at[k][0] - p[0]) ** 2 + (self.at[k][1] - p[1]) ** 2, k))[:16]
        clear = [k for k in near if self.land.connector(self.at[k], p)]
        return (clear or near)[0], bool(clear)

    def cheapest(self, a, b):
        cost, done = {a: 0.0}, set()
        while open_ := [k for k in cost if k not in done]:
            k = min(open_, key=cost.get)
            if k == b:
                return cost[b]
            done.add(k)
            for j, w in self.near[k]:
                cost[j] = min(cost.get(j, math.inf), cost[k] + w)
        return None


def thinned(line):
    """The odd rule: only the second product is divided by the squared length."""
    if len(line) < 3:
        return line
    (x1, y1), (x2, y2) = line[0], line[-1]
    dx, dy = x2 - x1, y2 - y1
    far, at = -1.0, 0
    for k, (x, y) in enumerate(line[1:-1], 1):
        t = (x - x1) * dx + (y - y1) * dy / (dx * dx + dy * dy) if dx or dy else 0.0
        t = min(max(t, 0.0), 1.0)
        if (d := math.hypot(x - x1 - t * dx, y - y1 - t * dy)) > far:
            far, at = d, k
    return thinned(line[: at + 1])[:-1] + thinned(line[at:]) if far > 0.01 else [line[0], line[-1]]


def seen(line, land):
    out, k = line[:1], 0
    while k < len(line) - 1:
        j = k + 1
        while j + 1 < len(line) and land.sight(line[k], line[j + 1]):
            j += 1
        out.append(line[j])
        k = j
    return out


def rounded(line, rounds, land):
    for _ in range(rounds):
        if len(line) < 3:
            return line
        out = [line[0]]
        for (ax, ay), (bx, by) in zip(line, line[1:]):
            for r in (0.25, 0.10, 0.05):
                q, s = (ax * (1 - r) + bx * r, ay * (1 - r) + by * r), (ax * r + bx * (1 - r), ay * r + by * (1 - r))
                if not land.coarse(*q) and not land.coarse(*s) and land.sight(out[-1], q) and land.sight(q, s):
                    out += [q, s]
                    break
            else:
                out += [(ax, ay), (bx, by)]
        out.append(line[-1])
        line = out[:1]
        for p in out[1:]:
            if abs(p[0] - line[-1][0]) >= 1e-9 or abs(p[1] - line[-1][1]) >= 1e-9:
                line.append(p)
    return line


@pytest.fixture(scope="module")
def world(spark, sf):
    engine = N._engine(spark, sf)
    land = Land(X.rings(spark, sf).collect(), N._runs(spark, sf).collect())
    return engine, Sea(*(t.collect() for t in graphs_rounded(engine.nodes, engine.edges)), land), land


def line(points):
    return [(p["lon"], p["lat"]) for p in points]


def check(ports, got, sea, land):
    """Costs against the cheapest of all ways; the ways' lines against what plain functions make of the raw line."""
    want, direct = 0.0, True
    for a, b in zip(ports, ports[1:]):
        (m, m_clear), (n, n_clear) = sea.snap(a), sea.snap(b)
        if m == n:
            want += great_circle(a, b)
            continue
        direct = False
        want += sea.cheapest(m, n) + (great_circle(a, sea.at[m]) if m_clear else 0) + (great_circle(b, sea.at[n]) if n_clear else 0)
    assert got["error"] is None
    # weights are rounded, so the search may miss the cheapest way by a trifle, and never beats it
    assert want - 1e-2 <= got["cost_km"] <= want * 1.001 + 1e-2
    assert (got["nodes_explored"] == 0) == direct
    raw = line(got["raw"])
    assert all(abs(p[0] - q[0]) <= 180 for p, q in zip(raw, raw[1:]))
    (first, first_clear), (last, last_clear) = sea.snap(ports[0]), sea.snap(ports[-1])
    for end, port, node, clear in ((raw[0], ports[0], first, first_clear), (raw[-1], ports[-1], last, last_clear)):
        goal = port if clear or direct else sea.at[node]
        assert (end[0] - goal[0]) % 360 == pytest.approx(0, abs=1e-6) or (end[0] - goal[0]) % 360 == pytest.approx(360, abs=1e-6)
        assert end[1] == pytest.approx(goal[1])
    return raw


def test_routes(spark, world, sf):
    engine, sea, land = world
    asked = {r["req_id"]: r["ports"] for r in N._requests(spark, sf).collect()}
    made = {r["req_id"]: r for r in engine.routes(N._requests(spark, sf)).collect()}
    counts = {r["req_id"]: r for r in N.queries()["routes"](spark, sf).collect()}
    texts = {r["req_id"]: json.loads(r["value"]) for r in N.queries()["route_geojson"](spark, sf).collect()}
    assert set(asked) == set(made) == set(counts) == set(texts)
    for req, ports in sorted(asked.items())[:60]:
        got = made[req]
        raw = check(line(ports), got, sea, land)
        assert thinned(raw) == raw  # nothing is left to thin out
        sight = seen(raw, land)
        final = rounded(sight, 2 if len(sight) > 20 else 4, land)
        assert line(got["los"]) == sight and len(got["final"]) == len(final)
        assert [v for p in line(got["final"]) for v in p] == pytest.approx([v for p in final for v in p])
        c = counts[req]
        assert (c["raw"], c["los"], c["final"], c["nodes_explored"], c["cost_km"]) == (len(raw), len(sight), len(final), got["nodes_explored"], round(got["cost_km"], 3))
        features = {f["properties"]["name"]: f for f in texts[req]["features"]}
        assert {k: f["properties"]["pointCount"] for k, f in features.items()} == {"raw": len(raw), "los": len(sight), "final": len(final)}
        assert [tuple(p) for p in features["final"]["geometry"]["coordinates"]] == line(got["final"])
        assert features["raw"]["properties"]["distanceKm"] == int(got["cost_km"])


def test_itineraries(spark, world, sf):
    engine, sea, land = world
    rows = {r["req_id"]: r for r in N.queries()["itineraries"](spark, sf).collect()}
    calls = {r["conv_id"]: line(r["line"]) for r in N._calls(spark, sf).collect()}
    assert set(rows) == set(calls)
    for req, ports in sorted(calls.items()):
        r = rows[req]
        if len(ports) < 2:
            assert r["error"] == "Need ≥2 ports"
            continue
        want = 0.0
        for a, b in zip(ports, ports[1:]):
            (m, m_clear), (n, n_clear) = sea.snap(a), sea.snap(b)
            want += great_circle(a, b) if m == n else sea.cheapest(m, n) + (great_circle(a, sea.at[m]) if m_clear else 0) + (great_circle(b, sea.at[n]) if n_clear else 0)
        assert r["error"] is None and r["legs"] == len(ports) - 1
        assert want - 1e-2 <= r["cost_km"] <= want * 1.001 + 1e-2
