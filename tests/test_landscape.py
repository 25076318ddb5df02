"""Plants moved off the pavement against a plain program."""

import math
import random

from pyspark.sql import functions as F

from mapweave.operators.landscape import nudged


def seg(px, pz, ax, az, bx, bz):
    dx, dz = bx - ax, bz - az
    t = max(0.0, min(1.0, ((px - ax) * dx + (pz - az) * dz) / (dx * dx + dz * dz)))
    cx, cz = ax + dx * t, az + dz * t
    return math.hypot(px - cx, pz - cz), cx, cz, -dz / math.hypot(dx, dz), dx / math.hypot(dx, dz)


def first_long(*sides):
    return next((s for s in sides[:-1] if s is not None and math.hypot(*s) >= 0.05), sides[-1])


def touches(x, z, radius, triangle):
    pairs = list(zip(triangle, [*triangle[1:], triangle[0]], strict=True))
    turns = [(q[0] - p[0]) * (z - p[1]) - (q[1] - p[1]) * (x - p[0]) for p, q in pairs]
    return min(turns) >= 0 or max(turns) <= 0 or min(seg(x, z, *p, *q)[0] for p, q in pairs) <= radius


def plain(plant, parts, junctions, pavement, rounds):
    _, _, x, z, radius, fx, fz = plant
    moved = False

    def nearest():
        return min(((*seg(x, z, ax, az, bx, bz), width, way, idx) for _, way, idx, ax, az, bx, bz, width in parts), key=lambda r: (r[0], r[6], r[7]))

    off, rx, rz, ux, uz, width, *_ = nearest()
    clear = width / 2 + radius + 0.35
    if off < clear:
        sx, sz = first_long((x - rx, z - rz), None if fx is None else (fx - rx, fz - rz), (ux, uz))
        x, z, moved = rx + sx / math.hypot(sx, sz) * clear, rz + sz / math.hypot(sx, sz) * clear, True
    for _, _, jx, jz, jr in sorted(junctions, key=lambda j: j[1]):
        if math.hypot(x - jx, z - jz) < jr + radius + 0.35:
            sx, sz = first_long((x - jx, z - jz), None if fx is None else (fx - jx, fz - jz), (1.0, 0.0))
            scale = (jr + radius + 0.35) / math.hypot(sx, sz)
            x, z, moved = jx + sx * scale, jz + sz * scale, True
    for _ in range(rounds):
        if not any(touches(x, z, radius, t) for t in pavement):
            break
        _, rx, rz, ux, uz, *_ = nearest()
        sx, sz = first_long((x - rx, z - rz), (ux, uz))
        size = max(0.05, math.hypot(sx, sz))
        x, z, moved = x + sx / size * 0.5, z + sz / size * 0.5, True
    return x, z, moved


def test_plants_equal_one_plant_at_a_time(spark):
    rng = random.Random(5)
    parts = [(1, 1, i, -40.0 + 20 * i, 0.0, -20.0 + 20 * i, 2.0 * (i % 2), 6.0) for i in range(4)] + [(1, 2, i, 5.0, -45.0 + 30 * i, 6.0, -15.0 + 30 * i, 8.0) for i in range(3)]
    junctions = [(1, "a", 5.0, 1.0, 5.0), (1, "b", -2.0, 3.0, 4.0), (1, "c", 11.0, 4.0, 3.5)]
    pavement = []
    for _, _, _, ax, az, bx, bz, width in parts:
        ux, uz = -(bz - az) / math.hypot(bx - ax, bz - az) * width / 2, (bx - ax) / math.hypot(bx - ax, bz - az) * width / 2
        pavement += [[(ax + ux, az + uz), (bx + ux, bz + uz), (ax - ux, az - uz)], [(bx + ux, bz + uz), (bx - ux, bz - uz), (ax - ux, az - uz)]]
    pavement.append([(-30.0, 5.0), (-24.0, 12.0), (-20.0, 5.0)])  # a square beside the road
    plants = [(1, i, rng.uniform(-45, 45), rng.uniform(-14, 14), rng.choice((0.6, 1.5, 3.0)), *rng.choice(((None, None), (0.0, 30.0)))) for i in range(60)]
    plants += [(1, 90, -10.0, 1.0, 1.0, 0.0, 30.0), (1, 91, 300.0, 300.0, 2.0, None, None)]
    point = "struct<x double, z double>"
    found = nudged(
        spark.createDataFrame(plants, "area_id int, plant_id int, x double, z double, radius double, fx double, fz double"),
        spark.createDataFrame(parts, "area_id int, way_id int, idx int, ax double, az double, bx double, bz double, road_width double"),
        spark.createDataFrame(junctions, "area_id int, junction string, x double, z double, radius double"),
        spark.createDataFrame([(1, *t) for t in pavement], f"area_id int, a {point}, b {point}, c {point}"), 6,
    )
    got = {r.plant_id: (round(r.x, 6), round(r.z, 6), r.moved) for r in found.collect()}
    want = {}
    for p in plants:
        x, z, moved = plain(p, parts, junctions, pavement, 6)
        want[p[1]] = (round(x, 6), round(z, 6), moved)
    assert got == want and len({w[2] for w in want.values()}) == 2
    free = [p for p in plants if not any(touches(*want[p[1]][:2], p[4], t) for t in pavement)]
    assert len(free) >= 55
