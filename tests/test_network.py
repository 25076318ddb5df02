"""Shortest paths, snapping and door paths against plain programs."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from mapweave.operators import doors as D
from mapweave.operators import network as N
from mapweave.operators.chains import contract
from mapweave.operators.lines import segments
from mapweave.operators.snapping import first_come_nodes


def dijkstra(edges, start, banned=frozenset()):
    ways = {}
    for a, b, length in edges:
        if {a, b} != set(banned):
            ways.setdefault(a, []).append((b, length))
    dist, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        d, node = heapq.heappop(heap)
        if d > dist[node]:
            continue
        for other, length in ways.get(node, ()):
            if d + length < dist.get(other, math.inf):
                dist[other] = d + length
                heapq.heappush(heap, (d + length, other))
    return dist


def drawn_graph(rng, junctions, roads, longest):
    """Junctions joined by roads of many points, some of them dead ends, parallel or rings."""
    edges, number = [], 0
    for _ in range(roads):
        a, b = f"j{rng.randrange(junctions)}", f"j{rng.randrange(junctions)}" if rng.random() < 0.85 else None
        nodes = [a]
        for _ in range(rng.randrange(longest)):
            nodes.append(f"p{number:04d}")
            number += 1
        if b is not None:
            nodes.append(b)
        for one, two in zip(nodes, nodes[1:], strict=False):
            if one != two:
                length = float(rng.randint(1, 20))
                edges += [(one, two, length), (two, one, length)]
    return edges


@pytest.mark.parametrize("seed", [1, 2])
def test_shortest_paths_with_excluded_edges(spark, seed):
    rng = random.Random(seed)
    rows, sources, want = [], [], {}
    for area in (1, 2):
        edges = drawn_graph(rng, 8, 16, 9)
        edges += [(f"r{i}", f"r{(i + 1) % 5}", 1.0) for i in range(5)] + [(f"r{(i + 1) % 5}", f"r{i}", 1.0) for i in range(5)]  # a ring that nothing reaches
        rows += [(area, *e) for e in edges]
        least = {}
        for a, b, length in edges:
            least[a, b] = min(length, least.get((a, b), math.inf))
        for number in range(4):
            start, banned = rng.choice(edges)[0], rng.choice(edges)[:2] if number else (None, None)
            sources.append((area, f"s{number}", start, *banned))
            want[area, f"s{number}"] = (dijkstra([(*k, v) for k, v in least.items()], start, banned), least, start, set(banned))
    found = N.shortest_distances(
        spark.createDataFrame(rows, "area_id int, src string, dst string, length double"),
        spark.createDataFrame(sources, "area_id int, source string, node string, ex_a string, ex_b string"),
    ).collect()
    got = {}
    for r in found:
        got.setdefault((r.area_id, r.source), {})[r.node] = (r.dist, r.prev)
    assert got.keys() == want.keys()
    for key, (dist, least, start, banned) in want.items():
        assert {n: round(d, 9) for n, (d, _) in got[key].items()} == {n: round(d, 9) for n, d in dist.items()}
        for node, (d, prev) in got[key].items():
            if node == start:
                assert prev is None
                continue
            lower = min(a for (a, b), length in least.items() if b == node and {a, b} != banned and a in dist and abs(dist[a] + length - d) < 1e-9)
            assert prev == lower


def test_a_long_road_is_one_edge(spark):
    """1,000 points between two junctions are followed in a few rounds, and come out as one edge each way."""
    line = [(1, f"n{i:04d}", f"n{i + 1:04d}", 1.0) for i in range(1_000)]
    edges = spark.createDataFrame(line + [(1, b, a, w) for _, a, b, w in line], "area_id int, src string, dst string, length double")
    short, inner = contract(edges, spark.createDataFrame([(1, "n0000")], "area_id int, node string"))
    assert {(r.src, r.dst, r.length, r.toward) for r in short.collect()} == {("n0000", "n1000", 1000.0, "n0001"), ("n1000", "n0000", 1000.0, "n0999")}
    assert inner.where("node = 'n0400'").orderBy("end").select("end", "length", "toward").collect() == [("n0000", 400.0, "n0399"), ("n1000", 600.0, "n0401")]


@pytest.mark.parametrize("most", [4_096, 20, 1])
def test_nodes_are_first_come_whatever_the_blocks(spark, most):
    """Points 0.5 to 1.4 m apart along roads, crowds, and repeats over several base blocks, cut as finely as can be."""
    rng = random.Random(3)
    spots = []
    for _ in range(5):
        x, z, angle = rng.uniform(-300, 300), rng.uniform(-300, 300), rng.uniform(0, 6.3)
        for _ in range(60):
            step = rng.uniform(0.5, 1.4)
            x, z = x + math.cos(angle) * step, z + math.sin(angle) * step
            spots.append((x, z))
    spots += [(rng.uniform(270, 276), rng.uniform(-3, 3)) for _ in range(120)]
    rows = [(area, f"{n:05d}", x, z) for area in (1, 2) for n, (x, z) in enumerate(spots if area == 1 else spots[::-1])]
    got = {(r.area_id, r.node) for r in first_come_nodes(spark.createDataFrame(rows, "area_id long, node string, x double, z double"), 1.5, most).collect()}
    want = set()
    for area in (1, 2):
        nodes = []
        for a, node, x, z in rows:
            if a == area and not any((x - p) ** 2 + (z - q) ** 2 < 2.25 for p, q in nodes):
                nodes.append((x, z))
                want.add((area, node))
    assert got == want and 100 < len(want)


def near_ring(ring, px, pz, reach):
    inside = False
    for (ax, az), (bx, bz) in zip(ring, ring[1:], strict=False):
        dx, dz = bx - ax, bz - az
        t = max(0.0, min(1.0, ((px - ax) * dx + (pz - az) * dz) / (dx * dx + dz * dz)))
        if math.hypot(px - ax - t * dx, pz - az - t * dz) < reach:
            return True
        if (az > pz) != (bz > pz) and px < dx * (pz - az) / dz + ax:
            inside = not inside
    return inside


def blocked(points, rings, width, owner):
    for index, ((ax, az), (bx, bz)) in enumerate(zip(points, points[1:], strict=False)):
        n = max(1, math.ceil(math.hypot(bx - ax, bz - az) / 0.5))
        for i in range(n + 1):
            px, pz = ax + (bx - ax) * i / n, az + (bz - az) * i / n
            for name, ring in rings.items():
                if name == owner and index == 0 and math.hypot(px - points[0][0], pz - points[0][1]) < width / 2 + 0.4:
                    continue
                if near_ring(ring, px, pz, width / 2 + 0.15):
                    return True
    return False


def plain_path(door, rings, parts):
    """One door at a time: places by distance, straight or over corners."""
    _, _, owner, x, z, dx, dz, width = door
    nx, nz = -dz, dx
    if near_ring(rings[owner], x + nx * 0.2, z + nz * 0.2, -1):
        nx, nz = -nx, -nz
    apron, ends = (x + nx * (width / 2 + 1), z + nz * (width / 2 + 1)), []
    for _, way, idx, ax, az, bx, bz, road in parts:
        ex, ez = bx - ax, bz - az
        t = max(0.0, min(1.0, ((apron[0] - ax) * ex + (apron[1] - az) * ez) / (ex * ex + ez * ez)))
        cx, cz = ax + t * ex, az + t * ez
        distance = math.hypot(apron[0] - cx, apron[1] - cz)
        pull = max(0.0, road / 2 - 0.25) / max(0.01, distance)
        if distance < 150:
            ends.append((distance, way, idx, (cx + (apron[0] - cx) * pull, cz + (apron[1] - cz) * pull)))
    for rank, (*_, end) in enumerate(sorted(ends)[:12], 1):
        if not blocked([(x, z), apron, end], rings, width, owner):
            return rank, False, [(x, z), apron, end]
        pad, nodes = width / 2 + 0.8, {"a": apron, "e": end}
        for name in sorted(rings):
            xs, zs = [p for p, _ in rings[name]], [q for _, q in rings[name]]
            x0, x1, z0, z1 = min(xs) - pad, max(xs) + pad, min(zs) - pad, max(zs) + pad
            if x1 < min(apron[0], end[0]) - 20 or x0 > max(apron[0], end[0]) + 20 or z1 < min(apron[1], end[1]) - 20 or z0 > max(apron[1], end[1]) + 20:
                continue
            nodes |= {f"{name}#{k}": p for k, p in enumerate(((x0, z0), (x1, z0), (x1, z1), (x0, z1)))}
        ways = [
            (a, b, math.dist(nodes[a], nodes[b])) for a in nodes for b in nodes
            if a < b and not blocked([nodes[a], nodes[b]], rings, width, "")
        ]
        ways += [(b, a, w) for a, b, w in ways]
        dist = dijkstra(ways, "a")
        if "e" in dist and not blocked([(x, z), apron], rings, width, owner):
            path = ["e"]
            while path[-1] != "a":
                path.append(min(a for a, b, w in ways if b == path[-1] and a in dist and abs(dist[a] + w - dist[b]) < 1e-9))
            return rank, True, [(x, z), *[nodes[n] for n in path[::-1]]]
    return None, None, []


def test_door_paths_equal_one_door_at_a_time(spark):
    rng = random.Random(12)
    rings, doors = {}, []
    for n in range(26):
        cx, cz, hx, hz = rng.uniform(-60, 60), rng.uniform(8, 90), rng.uniform(3, 9), rng.uniform(3, 7)
        rings[f"b{n:02d}"] = [(cx - hx, cz - hz), (cx + hx, cz - hz), (cx + hx, cz + hz), (cx, cz + hz / 3), (cx - hx, cz + hz), (cx - hx, cz - hz)]
        doors.append((1, f"d{n:02d}", f"b{n:02d}", cx + rng.uniform(-2, 2), cz - hz, 1.0, 0.0, rng.choice((1.2, 3.0))))
    rings["far"] = [(500.0, 500.0), (510.0, 500.0), (510.0, 510.0), (500.0, 500.0)]
    doors.append((1, "far", "far", 505.0, 500.0, 1.0, 0.0, 1.2))
    parts = [(1, 5, i, -90.0 + 30 * i, -4.0, -60.0 + 30 * i, -4.0, 6.0) for i in range(6)] + [(1, 6, 0, 95.0, -20.0, 95.0, 120.0, 8.0)]
    want = {d[1]: plain_path(d, rings, parts) for d in doors}
    assert {kind for _, kind, _ in want.values()} == {True, False, None}
    found = D.door_paths(
        spark.createDataFrame(doors, "area_id int, door_id string, owner_id string, x double, z double, dx double, dz double, width double"),
        spark.createDataFrame([(1, n, [{"x": x, "z": z} for x, z in r]) for n, r in rings.items()], "area_id int, source_id string, ring array<struct<x double, z double>>"),
        spark.createDataFrame(parts, "area_id int, way_id int, idx int, ax double, az double, bx double, bz double, road_width double"),
    )
    got = {}
    for r in found.orderBy("at").collect():
        path = got.setdefault(r.door_id, (r.rank, r.detour, []))
        if r.at is not None:
            path[2].append((round(r.x, 6), round(r.z, 6)))
    assert got == {k: (rank, kind, [(round(x, 6), round(z, 6)) for x, z in points]) for k, (rank, kind, points) in want.items()}


def test_detours_see_the_corners_of_all_buildings(spark):
    """All of over thirty buildings about a trial give corners; of two with the same box the lower id does."""
    boxes = {f"b{n:02d}": (-16.0 + n, 50.0, -15.5 + n, 51.0) for n in range(32)} | {"z": (-9.0, 14.0, 9.0, 20.0), "zz": (-9.0, 14.0, 9.0, 20.0), "far": (300.0, 0.0, 310.0, 9.0)}
    rings = [(1, n, [{"x": x, "z": z} for x, z in ((x0, z0), (x1, z0), (x1, z1), (x0, z1), (x0, z0))]) for n, (x0, z0, x1, z1) in boxes.items()]
    trials = spark.createDataFrame([(1, "d", 1, 1.0, 0.0, 45.0, 0.0, 2.0)], "area_id int, door_id string, rank int, width double, px double, pz double, ex double, ez double")
    nodes = D.corner_nodes(trials, spark.createDataFrame(rings, "area_id int, source_id string, ring array<struct<x double, z double>>"))
    want = {("a", 0.0, 45.0), ("e", 0.0, 2.0)}
    for n in [n for n in boxes if n not in ("zz", "far")]:
        x0, z0, x1, z1 = (v + s * 1.3 for v, s in zip(boxes[n], (-1, -1, 1, 1), strict=True))
        want |= {(f"{n}#{k}", x, z) for k, (x, z) in enumerate(((x0, z0), (x1, z0), (x1, z1), (x0, z1)))}
    assert sorted((r.node, r.x, r.z) for r in nodes.collect()) == sorted(want) and len(want) == 134


def test_copied_roads_are_one_leg_each(spark, monkeypatch):
    """Roads that lie one over the other are searched as one, and the graph is that of all points."""
    from mapweave.operators import routes

    corners = [(0.0, 0.0), (300.0, 0.0), (300.0, 300.0), (0.0, 300.0), (0.0, 0.0)]
    rows = [(1, way, i, x + way % 2 * 0.01, 0.0, z, 7.0, 0.0) for way in range(30) for i, (x, z) in enumerate(corners)]
    points = spark.createDataFrame(rows, "area_id int, way_id int, idx int, x double, y double, z double, width double, layer double")
    legs = N.road_legs(points, carry=("width",))
    assert sorted((r.ax, r.az, r.lo >> N.INDEX_BITS, r.hi >> N.INDEX_BITS) for r in legs.collect()) == sorted(
        (x + odd * 0.01, z, odd, 28 + odd) for odd in (0, 1) for x, z in corners[:4])
    vertices, edges = N.road_graph(points)
    assert sorted((r.node, r.x) for r in vertices.collect()) == [("0:0:0", 0.01), ("0:3000:0", 0.01), ("3000:0:0", 300.01), ("3000:3000:0", 300.01)]
    assert edges.count() == 8 and {r.length for r in edges.collect()} == {300.0}
    sizes = []
    plain = routes.circuits
    monkeypatch.setattr(routes, "circuits", lambda road_set, parts, *rest: sizes.append((road_set.count(), parts.count())) or plain(road_set, parts, *rest))
    start = spark.createDataFrame([(1, 1, 150.0, 2.0, 1.0, 0.0)], "area_id int, start_id int, px double, pz double, hx double, hz double")
    best, _ = routes.candidates(points, segments(points, carry=("width", "layer")), start)
    assert sizes == [(8, 8)] and best.count() >= 1
