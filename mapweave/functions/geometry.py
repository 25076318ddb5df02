"""Rings, lines and triangles as array columns; every array belongs to one feature."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from mapweave.functions.geo import METRES_PER_DEGREE, radians
from mapweave.functions.text import point_key

EPSILON = 1e-8


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once; as a plain column each mention would compute it again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def same_position(a: Column, b: Column) -> Column:
    return (a["lon"] == b["lon"]) & (a["lat"] == b["lat"])


def close_ring(ring: Column) -> Column:
    first = F.get(ring, 0)
    open_ring = (F.size(ring) > 0) & ~same_position(first, F.element_at(ring, -1))
    return F.when(open_ring, F.concat(ring, F.array(first))).otherwise(ring)


def edges(ring: Column) -> Column:
    """Consecutive pairs of a closed ring or line as structs ``a``, ``b``."""
    count = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(
        F.slice(ring, 1, count), F.slice(ring, 2, count), lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    )


def ring_crossings(ring: Column, px: Column, py: Column, x: str = "x", y: str = "z") -> Column:
    """Number of ring edges that a ray from the point crosses; the ring may be open or closed."""
    count = F.size(ring)
    previous = F.concat(F.slice(ring, count, 1), F.slice(ring, 1, count - 1))
    hits = F.zip_with(
        ring, previous,
        lambda a, b: F.when(
            ((a[y] > py) != (b[y] > py))
            & (px < (b[x] - a[x]) * (py - a[y]) / F.nullif(b[y] - a[y], F.lit(0.0)) + a[x]),
            1,
        ).otherwise(0),
    )
    return F.when(count > 0, F.aggregate(hits, F.lit(0), lambda total, hit: total + hit)).otherwise(0)


def point_in_ring(ring: Column, px: Column, py: Column, x: str = "x", y: str = "z") -> Column:
    return ring_crossings(ring, px, py, x, y) % 2 == 1


def point_in_footprint(rings: Column, px: Column, py: Column, x: str = "x", y: str = "z") -> Column:
    """Even-odd over the outer ring and its holes."""
    total = F.aggregate(rings, F.lit(0), lambda seen, ring: seen + ring_crossings(ring, px, py, x, y))
    return total % 2 == 1


def on_edge(a: Column, b: Column, px: Column, py: Column, x: str = "lon", y: str = "lat", slack: float = 1e-9) -> Column:
    dx, dy = b[x] - a[x], b[y] - a[y]
    length = F.sqrt(dx * dx + dy * dy)
    off = F.abs(dx * (py - a[y]) - dy * (px - a[x])) / F.when(length > 0, length).otherwise(1.0)
    return (
        (off < slack)
        & px.between(F.least(a[x], b[x]) - slack, F.greatest(a[x], b[x]) + slack)
        & py.between(F.least(a[y], b[y]) - slack, F.greatest(a[y], b[y]) + slack)
    )


def ring_covers_point(ring: Column, px: Column, py: Column, x: str = "lon", y: str = "lat") -> Column:
    """Inside or on the boundary of a closed ring."""
    return F.exists(edges(ring), lambda e: on_edge(e["a"], e["b"], px, py, x, y)) | point_in_ring(ring, px, py, x, y)


def area_covers(outer: Column, inner: Column) -> Column:
    """All corners inside; enough for convex selections."""
    return F.forall(inner, lambda p: ring_covers_point(outer, p["lon"], p["lat"]))


def segment_ratio(ax: Column, az: Column, bx: Column, bz: Column, px: Column, pz: Column) -> Column:
    """Position of the nearest point along a segment, 0 to 1; 0 for a segment without length."""
    dx, dz = bx - ax, bz - az
    squared = (dx * dx + dz * dz).cast("double")
    share = ((px - ax) * dx + (pz - az) * dz) / F.nullif(squared, F.lit(0.0))
    return F.when(squared > 0, clamp(share, 0.0, 1.0)).otherwise(0.0)


def segment_distance(ax: Column, az: Column, bx: Column, bz: Column, px: Column, pz: Column) -> Column:
    ratio = segment_ratio(ax, az, bx, bz, px, pz)
    ex, ez = px - ax - ratio * (bx - ax), pz - az - ratio * (bz - az)
    return F.sqrt(ex * ex + ez * ez)


def nearest_wall(ring: Column, px: Column, pz: Column) -> Column:
    """Closest wall of one ring with its fraction, length and distance; the first wall wins a tie."""

    def wall(edge: Column, index: Column) -> Column:
        a, b = edge["a"], edge["b"]
        ratio = segment_ratio(a["x"], a["z"], b["x"], b["z"], px, pz)
        ex, ez = px - a["x"] - ratio * (b["x"] - a["x"]), pz - a["z"] - ratio * (b["z"] - a["z"])
        lx, lz = b["x"] - a["x"], b["z"] - a["z"]
        return F.struct(
            F.sqrt(ex * ex + ez * ez).alias("distance"), index.alias("wall"), ratio.alias("fraction"),
            F.sqrt(lx * lx + lz * lz).alias("length"),
        )

    return F.array_min(F.transform(edges(ring), wall))


def local_rings(polygons: Column, frame: Column) -> Column:
    """Polygons of positions as polygons of world points."""
    from mapweave.functions.geo import ecef, local_enu, to_world

    def world(p: Column) -> Column:
        point = to_world(local_enu(ecef(p["lon"], p["lat"], F.coalesce(p["h"], F.lit(0.0))), frame))
        return F.struct(point["x"].alias("x"), point["z"].alias("z"))

    return F.transform(polygons, lambda rings: F.transform(rings, lambda ring: F.transform(ring, world)))


def vertex_mean(points: Column, x: str = "x", z: str = "z") -> Column:
    """Mean of all vertices, the closing one included."""
    count = F.nullif(F.size(points), F.lit(0))
    total = F.aggregate(
        points, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("z")),
        lambda s, p: F.struct((s["x"] + p[x]).alias("x"), (s["z"] + p[z]).alias("z")),
    )
    return F.struct(
        F.coalesce(total["x"] / count, F.lit(0.0)).alias("x"), F.coalesce(total["z"] / count, F.lit(0.0)).alias("z")
    )


def open_ring(ring: Column, x: str = "lon", y: str = "lat") -> Column:
    first, last = F.get(ring, 0), F.element_at(ring, -1)
    closed = (F.size(ring) > 1) & (first[x] == last[x]) & (first[y] == last[y])
    return F.when(closed, F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)


def map_center(ring: Column) -> Column:
    """Mean of the distinct vertices of a ring of positions (imagery tiles)."""
    points = open_ring(ring)
    mean = vertex_mean(points, "lon", "lat")
    return F.when(F.size(points) > 0, F.struct(mean["x"].alias("lon"), mean["z"].alias("lat")))


def drop_close_points(points: Column, gap: float = 0.02) -> Column:
    """Remove points within ``gap`` of the last kept point; a fold, as each decision depends on the previous one."""
    def keep(kept: Column, p: Column) -> Column:
        last = F.element_at(kept, -1)
        far = F.sqrt((p["x"] - last["x"]) * (p["x"] - last["x"]) + (p["z"] - last["z"]) * (p["z"] - last["z"])) > gap
        return F.when(far, F.concat(kept, F.array(p))).otherwise(kept)

    start = F.slice(points, 1, 1)
    return F.aggregate(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), start, keep)


def signed_area(ax, az, bx, bz, cx, cz) -> Column:
    return (bx - ax) * (cz - az) - (bz - az) * (cx - ax)


def triangle_height(t: Column, px: Column, pz: Column) -> Column:
    """Height of a triangle (struct a, b, c) under a point; null outside or for a sliver."""
    a, b, c = t["a"], t["b"], t["c"]
    area = signed_area(a["x"], a["z"], b["x"], b["z"], c["x"], c["z"])
    whole = F.when(F.abs(area) >= EPSILON, area)
    u = signed_area(px, pz, b["x"], b["z"], c["x"], c["z"]) / whole
    v = signed_area(a["x"], a["z"], px, pz, c["x"], c["z"]) / whole
    w = 1 - u - v
    return F.when(F.least(u, v, w) >= -EPSILON, u * a["y"] + v * b["y"] + w * c["y"])


def ring_area(ring: Column, x: str = "x", z: str = "z") -> Column:
    """Unsigned shoelace area of a closed ring."""
    total = F.aggregate(
        edges(ring), F.lit(0.0), lambda s, e: s + (e["a"][x] * e["b"][z] - e["b"][x] * e["a"][z])
    )
    return F.abs(total) / 2.0


def ring_length(ring: Column, x: str = "x", z: str = "z") -> Column:
    return F.aggregate(
        edges(ring), F.lit(0.0),
        lambda s, e: s + F.sqrt(
            (e["b"][x] - e["a"][x]) * (e["b"][x] - e["a"][x]) + (e["b"][z] - e["a"][z]) * (e["b"][z] - e["a"][z])
        ),
    )


def building_volume(rings: Column, height: Column) -> Column:
    """Wall area over all rings and volume of a prism with holes."""
    walls = F.aggregate(rings, F.lit(0.0), lambda s, ring: s + ring_length(ring))
    holes = F.aggregate(
        F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), F.lit(0.0), lambda s, ring: s + ring_area(ring)
    )
    footprint = ring_area(F.get(rings, 0)) - holes
    return F.struct(
        footprint.alias("footprint_area"), (walls * height).alias("wall_area"), (footprint * height).alias("volume"),
        (F.aggregate(rings, F.lit(0), lambda s, ring: s + F.size(ring) - 1) * 2).alias("wall_triangles"),
    )


def disc_triangles(cx: Column, cy: Column, cz: Column, radius: Column, parts: int = 18) -> Column:
    """A fan of triangles around a centre."""
    def vertex(index: Column) -> Column:
        angle = index * (2.0 * math.pi / parts)
        return F.struct(
            (cx + F.cos(angle) * radius).alias("x"), cy.alias("y"), (cz - F.sin(angle) * radius).alias("z")
        )

    hub = F.struct(cx.alias("x"), cy.alias("y"), cz.alias("z"))
    return F.transform(
        F.sequence(F.lit(0), F.lit(parts - 1)),
        lambda i: F.struct(hub.alias("a"), vertex(i).alias("b"), vertex((i + 1) % parts).alias("c")),
    )


def vertical_offset(progress: Column, layer: Column, bridge: Column, tunnel: Column) -> Column:
    """Lift of a bridge, dip of a tunnel or fixed step of a layered road."""
    arc = F.sin(progress * math.pi) * F.greatest(F.lit(3.0), F.abs(layer) * 3)
    return F.when(bridge, arc).when(tunnel, -arc).otherwise(layer * 3.0)


def footprint_signature(polygons: Column) -> Column:
    """JSON that is equal for equal footprints whatever the start vertex, winding or ring order."""
    def edge_text(e: Column) -> Column:
        ends = F.array_sort(F.array(point_key(e["a"]["lon"], e["a"]["lat"]), point_key(e["b"]["lon"], e["b"]["lat"])))
        return F.concat_ws(":", ends)

    def ring_text(ring: Column) -> Column:
        return F.array_sort(F.transform(edges(ring), edge_text))

    return F.to_json(F.array_sort(F.transform(polygons, lambda rings: F.array_sort(F.transform(rings, ring_text)))))


def opening_width(kind: Column, cars: Column, width: Column) -> Column:
    # Garage widths by number of cars.
    garage = F.when(cars == 1, 2.7).when(cars == 2, 5.4).when(cars == 3, 8.1)
    return F.when(kind == "garage", garage).otherwise(width.cast("double"))


def opening_height(kind: Column) -> Column:
    # Clear heights by opening kind.
    return F.when(kind == "window", 1.3).when(kind == "garage", 2.3).otherwise(2.1)


def opening_sill(kind: Column, sill: Column) -> Column:
    return F.when(kind == "window", sill.cast("double")).otherwise(0.0)


def wall_metres(a_lon: Column, a_lat: Column, b_lon: Column, b_lat: Column) -> Column:
    east = (b_lon - a_lon) * METRES_PER_DEGREE * F.cos(radians(a_lat))
    north = (b_lat - a_lat) * METRES_PER_DEGREE
    return F.sqrt(east * east + north * north)


def opening_position(ax: Column, az: Column, bx: Column, bz: Column, fraction: Column) -> Column:
    length = F.nullif(F.sqrt((bx - ax) * (bx - ax) + (bz - az) * (bz - az)), F.lit(0.0))
    return F.struct(
        (ax + (bx - ax) * fraction).alias("x"), (az + (bz - az) * fraction).alias("z"),
        ((bx - ax) / length).alias("dx"), ((bz - az) / length).alias("dz"),
    )


def on_ring_wall(ring: Column, ax: Column, az: Column, bx: Column, bz: Column, reach: float = 0.15) -> Column:
    """Whether a wall given by its ends matches one ring edge in either direction."""
    def near(p: Column, x: Column, z: Column) -> Column:
        return (p["x"] - x) * (p["x"] - x) + (p["z"] - z) * (p["z"] - z) < reach * reach

    return F.exists(
        edges(ring),
        lambda e: (near(e["a"], ax, az) & near(e["b"], bx, bz)) | (near(e["a"], bx, bz) & near(e["b"], ax, az)),
    )


def thin_points(points: Column, step: int = 3) -> Column:
    """Every ``step``-th point and the last one."""
    return F.filter(points, lambda _, i: (i % step == 0) | (i == F.size(points) - 1))


def roof_planes(ring: Column, rise: Column, roof: Column, across: Column) -> Column:
    """Ridge direction by the longest edge and the sloping planes of a gabled or hipped roof."""
    def side(e: Column, index: Column) -> Column:
        dx, dz = e["b"]["x"] - e["a"]["x"], e["b"]["z"] - e["a"]["z"]
        return F.struct(
            F.sqrt(dx * dx + dz * dz).alias("length"), (-index).alias("order"), dx.alias("dx"), dz.alias("dz")
        )

    def axes(top: Column) -> Column:
        ux, uz = top["dx"] / F.nullif(top["length"], F.lit(0.0)), top["dz"] / F.nullif(top["length"], F.lit(0.0))
        return F.struct(F.when(across, -uz).otherwise(ux).alias("x"), F.when(across, ux).otherwise(uz).alias("z"))

    def pair(ax: Column, az: Column) -> Column:
        def planes(ends: Column) -> Column:
            low, high = ends["low"], ends["high"]
            slope = rise / F.greatest(F.lit(0.1), (high - low) / 2.0)
            return F.array(
                F.struct((ax * slope).alias("x"), (az * slope).alias("z"), (-low * slope).alias("c")),
                F.struct((-ax * slope).alias("x"), (-az * slope).alias("z"), (high * slope).alias("c")),
            )

        reach = F.transform(ring, lambda p: p["x"] * ax + p["z"] * az)
        return once(once(reach, lambda r: F.struct(F.array_min(r).alias("low"), F.array_max(r).alias("high"))), planes)

    def roofed(e: Column) -> Column:
        planes = once(pair(-e["z"], e["x"]), lambda gable: F.when(
            roof == "hipped", F.concat(gable, pair(e["x"], e["z"]))).otherwise(gable))
        return F.struct(e["x"].alias("axis_x"), e["z"].alias("axis_z"), planes.alias("planes"))

    return once(once(F.array_max(F.transform(edges(ring), side)), axes), roofed)
