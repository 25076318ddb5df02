"""Geodesy and road lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapweave.derived import duck, view
from mapweave.functions import geo as G
from mapweave.functions import measure as M
from mapweave.operators import lines as L
from mapweave.operators.ordered import hot_keys, spread
from mapweave.registry.catalog import Topic
from mapweave.registry.features import BRIDGE_SQL, LAYER_SQL, TUNNEL_SQL, WIDTH_CTES, road_widths

topic = Topic()

A, E2, MD = "6378137.0e0", "6.69437999014e-3", "111320.0e0"


def ecef_sql(lon: str, lat: str, height: str = "0e0") -> tuple[str, str, str]:
    n = f"({A} / sqrt(1 - {E2} * sin(radians({lat})) * sin(radians({lat}))))"
    return (
        f"(({n} + {height}) * cos(radians({lat})) * cos(radians({lon})))",
        f"(({n} + {height}) * cos(radians({lat})) * sin(radians({lon})))",
        f"(({n} * (1 - {E2}) + {height}) * sin(radians({lat})))",
    )


OX, OY, OZ = ecef_sql("-75e0", "40e0")
FRAME_SQL = (
    f"frame AS (SELECT {OX} AS ox, {OY} AS oy, {OZ} AS oz, sin(radians(40e0)) AS sl, cos(radians(40e0)) AS cl,"
    " sin(radians(-75e0)) AS so, cos(radians(-75e0)) AS co)"
)
PX, PY, PZ = ecef_sql("lon", "lat")
ENU_SQL = f"""{FRAME_SQL},
e AS (SELECT n.*, {PX} - ox AS dx, {PY} - oy AS dy, {PZ} - oz AS dz, sl, cl, so, co, ox, oy, oz FROM v_nodes_ll n, frame),
enu AS (SELECT *, co * dy - so * dx AS east, cl * dz - sl * (co * dx + so * dy) AS north, sl * dz + cl * (co * dx + so * dy) AS up FROM e)"""


def _anchored(df):
    return df.withColumn("frame", G.anchor_frame(F.lit(-75.0), F.lit(40.0)))


@topic.query(duck(f"""
WITH {ENU_SQL} SELECT area_id, way_id, idx, round(east, 3) AS east, round(north, 3) AS north, round(up, 3) + 0.0 AS up FROM enu""", "v_nodes_ll"))
def local_enu(spark, sf_dir):
    nodes = _anchored(view(spark, sf_dir, "v_nodes_ll"))
    enu = G.local_enu(G.ecef(F.col("lon"), F.col("lat"), F.lit(0.0)), F.col("frame"))
    return nodes.withColumn("enu", enu).select(
        "area_id", "way_id", "idx", *[(F.round(f"enu.{c}", 3) + 0.0).alias(c) for c in ("east", "north", "up")]
    )


_ROUNDS = "".join(f""",
r{i} AS (SELECT *, {A} / sqrt(1 - {E2} * sin(phi{i - 1}) * sin(phi{i - 1})) AS rad{i} FROM p{i - 1}),
p{i} AS (SELECT area_id, way_id, idx, ex, ey, ez, flat, flat / cos(phi{i - 1}) - rad{i} AS alt,
 atan2(ez, flat * (1 - {E2} * rad{i} / (flat / cos(phi{i - 1})))) AS phi{i} FROM r{i})""" for i in range(1, 9))


@topic.query(duck(f"""
WITH {ENU_SQL},
b AS (SELECT area_id, way_id, idx, ox + co * (cl * up - sl * north) - so * east AS ex, oy + so * (cl * up - sl * north) + co * east AS ey,
  oz + cl * north + sl * up AS ez FROM enu),
p0 AS (SELECT *, sqrt(ex * ex + ey * ey) AS flat, atan2(ez, sqrt(ex * ex + ey * ey) * (1 - {E2})) AS phi0 FROM b){_ROUNDS}
SELECT area_id, way_id, idx, round(degrees(atan2(ey, ex)), 6) AS lon, round(degrees(phi8), 6) AS lat FROM p8""", "v_nodes_ll"))
def enu_roundtrip(spark, sf_dir):
    nodes = _anchored(view(spark, sf_dir, "v_nodes_ll"))
    enu = nodes.withColumn("enu", G.local_enu(G.ecef(F.col("lon"), F.col("lat"), F.lit(0.0)), F.col("frame")))
    point = G.frame_to_ecef(F.col("enu.east"), F.col("enu.north"), F.col("enu.up"), F.col("frame"))
    back = G.with_geodetic(enu.drop("lon", "lat").withColumn("point", point), "point")
    return back.select("area_id", "way_id", "idx", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


BOX_SQL = "box AS (SELECT area_id, way_id, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM v_nodes_ll GROUP BY 1, 2)"


def _way_boxes(spark, sf_dir):
    return view(spark, sf_dir, "v_nodes_ll").groupBy("area_id", "way_id").agg(
        F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north")
    )


_CLON, _CLAT = "((west + east) / 2e0)", "((south + north) / 2e0)"


def _corner_sql(lon: str, lat: str) -> tuple[str, str]:
    x, y, z = ecef_sql(lon, lat)
    cx, cy, cz = ecef_sql(_CLON, _CLAT)
    so, co, sl, cl = f"sin(radians({_CLON}))", f"cos(radians({_CLON}))", f"sin(radians({_CLAT}))", f"cos(radians({_CLAT}))"
    east = f"({co} * ({y} - {cy}) - {so} * ({x} - {cx}))"
    north = f"({cl} * ({z} - {cz}) - {sl} * ({co} * ({x} - {cx}) + {so} * ({y} - {cy})))"
    return east, north


_E1, _N1 = _corner_sql("west", "south")
_E2, _N2 = _corner_sql("east", "north")


@topic.query(duck(f"""
WITH {BOX_SQL}, m AS (SELECT *, abs({_E2} - {_E1}) AS ew, abs({_N2} - {_N1}) AS ns FROM box)
SELECT area_id, way_id, round(ew * ns / 1000000e0, 6) AS area_km2, ew * ns / 1000000e0 > 0.005 AS too_large,
 cast(least(513, greatest(2, ceil(ew / 10) + 1)) AS bigint) AS columns, cast(least(513, greatest(2, ceil(ns / 10) + 1)) AS bigint) AS rows,
 CASE WHEN east <= west THEN 'east-not-greater' WHEN north <= south THEN 'north-not-greater' END AS bounds_error FROM m""", "v_nodes_ll"))
def way_bounds(spark, sf_dir):
    from mapweave.operators.elevation import grid_dimensions

    sides = [F.col(c) for c in ("west", "south", "east", "north")]
    sized = grid_dimensions(_way_boxes(spark, sf_dir), 10.0, 513).withColumn(
        "area", F.col("extent_x") * F.col("extent_y") / 1_000_000.0
    )
    return sized.select(
        "area_id", "way_id", F.round("area", 6).alias("area_km2"), (F.col("area") > 0.005).alias("too_large"),
        F.col("columns").cast("bigint").alias("columns"), F.col("rows").cast("bigint").alias("rows"),
        M.bounds_error(*sides).alias("bounds_error"),
    )


@topic.query(duck(f"""
WITH s AS (SELECT n.area_id, n.way_id, n.idx, n.lon, n.lat, 400e0 + n.way_id % 1601 AS size_m, cast(n.way_id * 7 % 360 AS double) AS bearing,
  greatest(0.15, cos(radians(n.lat))) * {MD} AS sx FROM v_nodes_ll n),
c AS (SELECT *, lon + size_m / 2 * (-cos(radians(bearing)) - sin(radians(bearing))) / sx AS lon1,
  lon + size_m / 2 * (cos(radians(bearing)) - sin(radians(bearing))) / sx AS lon2,
  lat + size_m / 2 * (-cos(radians(bearing)) + sin(radians(bearing))) / {MD} AS lat1,
  lat + size_m / 2 * (-cos(radians(bearing)) - sin(radians(bearing))) / {MD} AS lat2 FROM s)
SELECT area_id, way_id, idx, round(least(lon1, lon2, 2 * lon - lon1, 2 * lon - lon2), 6) AS west, round(greatest(lon1, lon2, 2 * lon - lon1, 2 * lon - lon2), 6) AS east,
 round(least(lat1, lat2, 2 * lat - lat1, 2 * lat - lat2), 6) AS south, round(greatest(lat1, lat2, 2 * lat - lat1, 2 * lat - lat2), 6) AS north,
 round(lon - size_m / 2 / sx, 6) AS square_west, size_m < 400 OR size_m > 2000 AS bad_selection FROM c""", "v_nodes_ll"))
def selection_envelopes(spark, sf_dir):
    picked = view(spark, sf_dir, "v_nodes_ll").withColumns({
        "size_m": 400.0 + F.col("way_id") % 1601, "bearing": G.normalize_bearing((F.col("way_id") * 7).cast("double")),
    })
    box = G.ring_bounds(G.selection_ring(F.col("lon"), F.col("lat"), F.col("size_m"), F.col("bearing")))
    square = G.bounds_from_center(F.col("lon"), F.col("lat"), F.col("size_m"))
    return picked.withColumn("box", box).select(
        "area_id", "way_id", "idx", *[F.round(f"box.{c}", 6).alias(c) for c in ("west", "east", "south", "north")],
        F.round(square["west"], 6).alias("square_west"),
        M.selection_error(F.col("size_m"), F.col("bearing")).isNotNull().alias("bad_selection"),
    )


SEGMENT_SQL = "seg AS (SELECT * FROM (SELECT area_id, way_id, idx, x AS ax, z AS az, lead(x) OVER w AS bx, lead(z) OVER w AS bz FROM v_way_nodes WINDOW w AS (PARTITION BY area_id, way_id ORDER BY idx)) WHERE bx IS NOT NULL)"


@topic.query(duck(f"WITH {SEGMENT_SQL} SELECT * FROM seg", "v_way_nodes"))
def way_segments(spark, sf_dir):
    nodes = view(spark, sf_dir, "v_way_nodes")
    return L.segments(nodes, block=hot_keys(nodes, L.KEYS))


@topic.query(duck("""
WITH s AS (SELECT *, coalesce(sqrt(cast((x - lag(x) OVER w) * (x - lag(x) OVER w) + (z - lag(z) OVER w) * (z - lag(z) OVER w) AS double)), 0) AS step
 FROM v_way_nodes WINDOW w AS (PARTITION BY area_id, way_id ORDER BY idx))
SELECT area_id, way_id, idx, round(sum(step) OVER (PARTITION BY area_id, way_id ORDER BY idx), 6) AS distance,
 round(sum(step) OVER (PARTITION BY area_id, way_id), 6) AS total FROM s""", "v_way_nodes"))
def way_lengths(spark, sf_dir):
    nodes = view(spark, sf_dir, "v_way_nodes")
    return L.cumulative_distance(nodes, block=hot_keys(nodes, L.KEYS)).select(
        "area_id", "way_id", "idx", F.round("distance", 6).alias("distance"), F.round("total", 6).alias("total")
    )


DENSE_SQL = """
d AS (SELECT area_id, way_id, idx, x, z FROM (SELECT *, lag(x) OVER w AS px, lag(z) OVER w AS pz FROM v_way_nodes WINDOW w AS (PARTITION BY area_id, way_id ORDER BY idx))
  WHERE px IS NULL OR px <> x OR pz <> z),
n AS (SELECT *, lead(x) OVER w AS nx, lead(z) OVER w AS nz FROM d WINDOW w AS (PARTITION BY area_id, way_id ORDER BY idx)),
k AS (SELECT *, CASE WHEN nx IS NULL THEN 1 ELSE cast(greatest(1, ceil(sqrt(cast((nx - x) * (nx - x) + (nz - z) * (nz - z) AS double)) / 4)) AS bigint) END AS steps FROM n),
e AS (SELECT *, unnest(range(steps)) AS step FROM k),
dense AS (SELECT area_id, way_id, row_number() OVER (PARTITION BY area_id, way_id ORDER BY idx, step) - 1 AS idx,
  CASE WHEN step = 0 THEN cast(x AS double) ELSE x + (nx - x) * (step / cast(steps AS double)) END AS x,
  CASE WHEN step = 0 THEN cast(z AS double) ELSE z + (nz - z) * (step / cast(steps AS double)) END AS z FROM e)"""


def dense_points(spark, sf_dir, name: str = "v_way_nodes"):
    nodes = view(spark, sf_dir, name)
    block = hot_keys(nodes, L.KEYS)
    return L.densify(L.drop_repeats(spread(nodes, L.KEYS), block=block), block=block)


@topic.query(duck(f"""
WITH {DENSE_SQL.strip()} SELECT area_id, way_id, idx, round(x, 6) AS x, round(z, 6) AS z FROM dense""", "v_way_nodes"))
def densified_points(spark, sf_dir):
    return dense_points(spark, sf_dir).select(
        "area_id", "way_id", "idx", F.round("x", 6).alias("x"), F.round("z", 6).alias("z")
    )


_HEIGHT = "cast((x * 31 + z * 17 + 100000) % 97 AS double) / 4"


def synthetic_heights(spark, sf_dir):
    """Way nodes with an integer-derived height."""
    y = ((F.col("x") * 31 + F.col("z") * 17 + 100000) % 97).cast("double") / 4
    return view(spark, sf_dir, "v_way_nodes").withColumn("y", y)


def _pass(name: str, source: str) -> str:
    return f"""{name} AS (SELECT area_id, way_id, idx, coalesce(lag(y) OVER w * 0.25 + y * 0.5 + lead(y) OVER w * 0.25, y) AS y
 FROM {source} WINDOW w AS (PARTITION BY area_id, way_id ORDER BY idx))"""


@topic.query(duck(f"""
WITH h AS (SELECT *, {_HEIGHT} AS y FROM v_way_nodes), {_pass('one', 'h')}, {_pass('two', 'one')}
SELECT area_id, way_id, idx, round(y, 6) AS y FROM two""", "v_way_nodes"))
def smoothed_heights(spark, sf_dir):
    nodes = synthetic_heights(spark, sf_dir)
    return L.smooth(nodes, block=hot_keys(nodes, L.KEYS)).select("area_id", "way_id", "idx", F.round("y", 6).alias("y"))


@topic.query(duck(f"""
WITH h AS (SELECT *, {_HEIGHT} AS y FROM v_way_nodes),
s AS (SELECT area_id, way_id, lead(y) OVER w - y AS dy, sqrt(cast((lead(x) OVER w - x) * (lead(x) OVER w - x) + (lead(z) OVER w - z) * (lead(z) OVER w - z) AS double)) AS run
 FROM h WINDOW w AS (PARTITION BY area_id, way_id ORDER BY idx))
SELECT area_id, way_id, round(coalesce(max(CASE WHEN run > 0 THEN abs(dy) / run END), 0) * 100, 6) AS max_grade,
 coalesce(max(CASE WHEN run > 0 THEN abs(dy) / run END), 0) * 100 > 20 AS suspicious FROM s WHERE dy IS NOT NULL GROUP BY 1, 2""", "v_way_nodes"))
def max_grade(spark, sf_dir):
    nodes = synthetic_heights(spark, sf_dir)
    grades = L.maximum_grade(L.segments(nodes, height=True, block=hot_keys(nodes, L.KEYS)))
    return grades.select(
        "area_id", "way_id", F.round("max_grade", 6).alias("max_grade"), (F.col("max_grade") > 20).alias("suspicious")
    )


@topic.query(duck(f"""
WITH lv AS (SELECT area_id, way_id, {LAYER_SQL} AS layer, {BRIDGE_SQL} AS bridge, {TUNNEL_SQL} AS tunnel FROM v_road_tags),
s AS (SELECT *, coalesce(sqrt(cast((x - lag(x) OVER w) * (x - lag(x) OVER w) + (z - lag(z) OVER w) * (z - lag(z) OVER w) AS double)), 0) AS step FROM v_way_nodes WINDOW w AS (PARTITION BY area_id, way_id ORDER BY idx)),
p AS (SELECT area_id, way_id, idx, sum(step) OVER (PARTITION BY area_id, way_id ORDER BY idx) / greatest(1, sum(step) OVER (PARTITION BY area_id, way_id)) AS progress FROM s)
SELECT p.area_id, p.way_id, idx, round(cast(CASE WHEN bridge THEN sin(progress * pi()) * greatest(3, abs(layer) * 3) WHEN tunnel THEN -sin(progress * pi()) * greatest(3, abs(layer) * 3) ELSE layer * 3 END AS double) + 0.1, 6) + 0.0 AS y
FROM p JOIN lv USING (area_id, way_id)""", "v_way_nodes", "v_road_tags"))
def vertical_profiles(spark, sf_dir):
    levels = view(spark, sf_dir, "v_road_tags").select(
        "area_id", "way_id", M.road_layer(F.col("layer")).alias("layer"), M.loose_flag(F.col("bridge")).alias("bridge"),
        M.loose_flag(F.col("tunnel")).alias("tunnel"),
    )
    nodes = view(spark, sf_dir, "v_way_nodes")
    points = nodes.join(levels, ["area_id", "way_id"]).withColumn("y", F.lit(0.1))
    return L.lift(points, block=hot_keys(nodes, L.KEYS)).select("area_id", "way_id", "idx", (F.round("y", 6) + 0.0).alias("y"))


@topic.query(duck(f"""
WITH {WIDTH_CTES.strip()},
d AS (SELECT area_id, way_id, idx, x, z FROM (SELECT *, lag(x) OVER w AS px, lag(z) OVER w AS pz FROM v_way_nodes WINDOW w AS (PARTITION BY area_id, way_id ORDER BY idx)) WHERE px IS NULL OR px <> x OR pz <> z),
n AS (SELECT d.*, road_width AS width, lag(x) OVER w AS px, lag(z) OVER w AS pz, lead(x) OVER w AS nx, lead(z) OVER w AS nz FROM d JOIN widths USING (area_id, way_id) WINDOW w AS (PARTITION BY area_id, way_id ORDER BY idx)),
v AS (SELECT *, (x - px) / sqrt(cast((x - px) * (x - px) + (z - pz) * (z - pz) AS double)) AS ix, (z - pz) / sqrt(cast((x - px) * (x - px) + (z - pz) * (z - pz) AS double)) AS iz,
  (nx - x) / sqrt(cast((nx - x) * (nx - x) + (nz - z) * (nz - z) AS double)) AS ox, (nz - z) / sqrt(cast((nx - x) * (nx - x) + (nz - z) * (nz - z) AS double)) AS oz FROM n WHERE px IS NOT NULL OR nx IS NOT NULL),
u AS (SELECT *, coalesce(ix, ox) AS bx, coalesce(iz, oz) AS bz, coalesce(ox, ix) AS fx, coalesce(oz, iz) AS fz FROM v),
m AS (SELECT *, sqrt((bz + fz) * (bz + fz) + (bx + fx) * (bx + fx)) AS len FROM u),
q AS (SELECT *, CASE WHEN len < 0.001 THEN -fz ELSE (-bz - fz) / len END AS mx, CASE WHEN len < 0.001 THEN fx ELSE (bx + fx) / len END AS mz FROM m),
r AS (SELECT *, least(width / 2 / greatest(0.35, abs(mz * fx - mx * fz)), width / 2 * 2.5) AS reach FROM q)
SELECT area_id, way_id, idx, round(x + mx * reach, 6) + 0.0 AS left_x, round(z + mz * reach, 6) + 0.0 AS left_z, round(x - mx * reach, 6) + 0.0 AS right_x, round(z - mz * reach, 6) + 0.0 AS right_z FROM r""",
    "v_way_nodes", "v_road_tags", "v_overrides"))
def road_strips(spark, sf_dir):
    widths = road_widths(spark, sf_dir).select("area_id", "way_id", F.col("road_width").alias("width"))
    nodes = view(spark, sf_dir, "v_way_nodes")
    block = hot_keys(nodes, L.KEYS)
    strip = L.strip_edges(L.drop_repeats(nodes, block=block).join(widths, ["area_id", "way_id"]), block=block)
    out = [(F.round(f"{side}.{axis}", 6) + 0.0).alias(f"{side}_{axis}") for side in ("left", "right") for axis in ("x", "z")]
    return strip.select("area_id", "way_id", "idx", *out)


@topic.query(duck("""
WITH s AS (SELECT *, coalesce(sqrt(cast((x - lag(x) OVER w) * (x - lag(x) OVER w) + (z - lag(z) OVER w) * (z - lag(z) OVER w) AS double)), 0) AS step FROM v_way_nodes WINDOW w AS (PARTITION BY area_id, way_id ORDER BY idx)),
p AS (SELECT *, sum(step) OVER (PARTITION BY area_id, way_id ORDER BY idx) AS distance, sum(step) OVER (PARTITION BY area_id, way_id) AS total FROM s),
q AS (SELECT *, lag(distance) OVER w AS d0, lag(x) OVER w AS x0, lag(z) OVER w AS z0 FROM p WINDOW w AS (PARTITION BY area_id, way_id ORDER BY idx)),
f AS (SELECT area_id, way_id, total, unnest([0.25, 0.5, 0.75]) AS share FROM (SELECT DISTINCT area_id, way_id, total FROM p WHERE total > 0))
SELECT f.area_id, f.way_id, cast(share AS double) AS share, round(x0 + (x - x0) * ((total * share) - d0) / (distance - d0), 6) AS x, round(z0 + (z - z0) * ((total * share) - d0) / (distance - d0), 6) AS z
FROM (SELECT area_id, way_id, total, cast(share AS double) AS share FROM f) f JOIN (SELECT area_id, way_id, idx, d0, distance, x0, x, z0, z FROM q WHERE d0 IS NOT NULL) s
 ON s.area_id = f.area_id AND s.way_id = f.way_id AND f.total * f.share > s.d0 AND f.total * f.share <= s.distance""", "v_way_nodes"))
def points_at_distance(spark, sf_dir):
    nodes = view(spark, sf_dir, "v_way_nodes")
    block = hot_keys(nodes, L.KEYS)
    measured = L.cumulative_distance(nodes, block=block)
    ends = measured.where(F.col("total") > 0).select("area_id", "way_id", "total").distinct()
    share = F.explode(F.array(*[F.lit(v) for v in (0.25, 0.5, 0.75)]))
    wanted = ends.select("area_id", "way_id", "total", share.alias("share")).select(
        "area_id", "way_id", "share", (F.col("total") * F.col("share")).alias("distance")
    )
    return L.sample_at(measured, wanted, ["area_id", "way_id"], block=block).select(
        "area_id", "way_id", "share", F.round("x", 6).alias("x"), F.round("z", 6).alias("z")
    )
