"""Column functions and small operators on whole tables: distances, bounds, payloads, walls, roofs, rings, diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapweave.derived import duck, places_sql, view
from mapweave.functions import geo as G
from mapweave.functions import geometry as Y
from mapweave.functions import measure as M
from mapweave.functions import text as X
from mapweave.functions.text import places
from mapweave.operators import diagnostics as N
from mapweave.operators import elevation as E
from mapweave.operators import lines as L
from mapweave.operators import ranking as K
from mapweave.operators import spatial as S
from mapweave.operators.doors import aprons
from mapweave.operators.grid import computed
from mapweave.registry.catalog import Topic
from mapweave.registry.doors import DOOR_SQL, blocked_sql, doors
from mapweave.registry.elevation import building_corners
from mapweave.registry.plan import POINT_SQL, VIEWS, grid_points
from mapweave.session import cut_lineage

topic = Topic()


def way_lines(spark, sf_dir):
    """Each road's points in order as one array; a road has at most a few points."""
    point = F.struct("idx", F.col("x").cast("double").alias("x"), F.col("z").cast("double").alias("z"))
    return view(spark, sf_dir, "v_way_nodes").groupBy("area_id", "way_id").agg(F.array_sort(F.collect_list(point)).alias("points"))


@topic.query(duck(f"""
WITH p AS (SELECT *, lag(lon) OVER w AS l, lag(lat) OVER w AS t FROM v_nodes_ll WINDOW w AS (PARTITION BY area_id, way_id ORDER BY idx))
SELECT area_id, way_id, idx, {places_sql('sqrt(pow((lon - l) * 111320e0 * cos((lat + t) / 2 * pi() / 180), 2) + pow((lat - t) * 111320e0, 2))', 3)} AS distance FROM p WHERE l IS NOT NULL""", "v_nodes_ll"))
def node_gaps(spark, sf_dir):
    """Flat distance between the positions of neighbouring nodes."""
    nodes = view(spark, sf_dir, "v_nodes_ll")
    ahead = nodes.select("area_id", "way_id", "idx", F.col("lon").alias("l"), F.col("lat").alias("t"))
    from mapweave.operators.ordered import neighbors

    near = neighbors(ahead, L.KEYS, "idx", ["l", "t"], before="_p").where("_p IS NOT NULL")
    gap = G.flat_distance(F.col("l"), F.col("t"), F.col("_p.l"), F.col("_p.t"))
    return near.select("area_id", "way_id", "idx", places(gap, 3).alias("distance"))


@topic.query(duck(f"""
WITH b AS (SELECT area_id, way_id, min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n, avg(lat) AS m FROM v_nodes_ll GROUP BY 1, 2),
i AS (SELECT area_id, way_id, count(*) AS inside FROM v_nodes_ll JOIN b USING (area_id, way_id) WHERE lon >= w AND lon < e AND lat >= s AND lat < n GROUP BY 1, 2)
SELECT b.area_id, b.way_id, {places_sql('w - 50 / 111320e0 / greatest(0.2, cos(m * pi() / 180))', 7)} AS west, {places_sql('s - 50 / 111320e0', 7)} AS south,
 {places_sql('e + 50 / 111320e0 / greatest(0.2, cos(m * pi() / 180))', 7)} AS east, {places_sql('n + 50 / 111320e0', 7)} AS north, coalesce(inside, 0) AS inside,
 CASE WHEN way_id % 2 = 0 THEN true ELSE greatest(abs(w - {places_sql('w', 5)}), abs(s - {places_sql('s', 5)}), abs(e - {places_sql('e', 5)}), abs(n - {places_sql('n', 5)})) < 1e-7 END AS same
FROM b LEFT JOIN i USING (area_id, way_id)""", "v_nodes_ll"))
def buffered_bounds(spark, sf_dir):
    """Buffered envelope of each road, its nodes in the half-open one, and whether that agrees with a rounded one."""
    nodes = view(spark, sf_dir, "v_nodes_ll")
    ring = F.collect_list(F.struct("lon", "lat"))
    rows = nodes.groupBy("area_id", "way_id").agg(ring.alias("ring")).withColumn("plain", G.ring_bounds(F.col("ring")))
    sides = ("west", "south", "east", "north")
    rounded = F.struct(*[
        F.when(F.col("way_id") % 2 == 0, places(F.col("plain")[c], 8)).otherwise(places(F.col("plain")[c], 5)).alias(c) for c in sides
    ])
    inside = F.size(F.filter("ring", lambda p: G.contains_half_open(F.col("plain"), p["lon"], p["lat"])))
    wide = rows.withColumn("wide", G.buffered_bounds(F.col("ring"), 50.0)).withColumn("rounded", rounded)
    return wide.select(
        "area_id", "way_id", *[places(F.col("wide")[c], 7).alias(c) for c in sides], inside.cast("long").alias("inside"),
        G.bounds_match(F.col("plain"), F.col("rounded")).alias("same"),
    )


@topic.query(duck("""
SELECT area_id, ordinal, CASE WHEN ordinal % 4 IN (0, 1) AND payload_value IS NOT NULL THEN payload_value END AS value, CASE WHEN ordinal % 4 = 0 THEN payload_visible END AS visible,
 ordinal % 4 = 2 OR (ordinal % 4 IN (0, 1) AND payload_value IS NOT NULL) AS has_value FROM v_overrides""", "v_overrides"))
def payload_fields(spark, sf_dir):
    """Typed fields of open payloads: numbers, texts in their place, absent keys and broken JSON."""
    log = view(spark, sf_dir, "v_overrides")
    kind, value = F.col("ordinal") % 4, F.coalesce(F.concat(F.lit('"value":'), F.col("payload_value").cast("string")), F.lit('"other":1'))
    text = F.when(kind == 0, F.concat(F.lit("{"), value, F.lit(',"visible":'), F.col("payload_visible").cast("string"), F.lit("}"))).when(
        kind == 1, F.concat(F.lit("{"), value, F.lit("}"))).when(kind == 2, F.lit('{"value":"wide","visible":"perhaps"}')).otherwise(F.lit('{"value":'))
    rows = log.withColumn("payload", text)
    return rows.select(
        "area_id", "ordinal", X.variant_field(F.col("payload"), "$.value", "double").alias("value"),
        X.variant_field(F.col("payload"), "$.visible", "boolean").alias("visible"), X.has_key(F.col("payload"), "value").alias("has_value"),
    )


@topic.query(duck("""
SELECT area_id, 'road.insufficient-points' AS code, 'warning' AS severity, 'A road needs two different points to be drawn.' AS message, concat('osm:way:', way_id) AS source_id
FROM v_way_nodes GROUP BY area_id, way_id HAVING count(DISTINCT concat(x, ':', z)) < 2
UNION ALL SELECT area_id, 'building.invalid-ring', 'warning', 'A building needs an outer ring of four points.', source_id FROM v_buildings WHERE cx % 3 = 0""", "v_way_nodes", "v_buildings"))
def broken_features(spark, sf_dir):
    """Roads without two different points, and buildings whose ring is too short: those at a multiple of three lose half of it."""
    roads = way_lines(spark, sf_dir).select(
        "area_id", F.concat(F.lit("osm:way:"), F.col("way_id").cast("string")).alias("source_id"),
        F.array_distinct(F.transform("points", lambda p: F.struct(p["x"].alias("x"), p["z"].alias("z")))).alias("points"),
    )
    cut = F.when(F.col("cx") % 3 == 0, F.slice("ring", 1, 3)).otherwise(F.col("ring"))
    houses = building_corners(spark, sf_dir).select("area_id", "source_id", cut.alias("ring"))
    return N.concatenate(N.short_roads(roads), N.invalid_rings(houses)).select("area_id", "code", "severity", "message", "source_id")


@topic.query(duck("""
SELECT area_id, arg_min(source_id, (pow(cx - area_id * 10, 2) + pow(cz + 50, 2), source_id)) AS source_id FROM v_buildings GROUP BY 1""", "v_buildings"))
def center_buildings(spark, sf_dir):
    """The building nearest each area's centre."""
    houses = view(spark, sf_dir, "v_buildings").select("area_id", "source_id", F.col("cx").alias("x"), F.col("cz").alias("z"))
    centers = houses.select("area_id").distinct().select("area_id", (F.col("area_id") * 10).alias("center_x"), F.lit(-50).alias("center_z"))
    return K.closest_to_center(houses, centers, "source_id").select("area_id", "source_id")


@topic.query(duck("""
SELECT area_id, way_id, CASE way_id % 4 WHEN 0 THEN 'forest' WHEN 1 THEN 'water' WHEN 2 THEN '' END AS land,
 CASE WHEN way_id % 3 = 0 THEN 'building:colour=red|roof:shape=gabled' WHEN way_id % 3 = 1 THEN 'building:colour=red' ELSE '' END AS look FROM v_road_tags""", "v_road_tags"))
def land_and_look(spark, sf_dir):
    """Land class and appearance tags of tag maps: a blank land use wins over the natural cover, other tags are left out."""
    kind = F.col("way_id") % 4
    pairs = F.array(
        F.struct(F.lit("landuse").alias("k"), F.when(kind == 0, "forest").when(kind == 2, "").alias("v")),
        F.struct(F.lit("natural").alias("k"), F.when(kind.isin(1, 2), "water").alias("v")),
        F.struct(F.lit("roof:shape").alias("k"), F.when(F.col("way_id") % 3 == 0, "gabled").alias("v")),
        F.struct(F.lit("building:colour").alias("k"), F.when(F.col("way_id") % 3 < 2, "red").alias("v")),
        F.struct(F.lit("name").alias("k"), F.lit("a").alias("v")),
    )
    tags = F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))
    rows = view(spark, sf_dir, "v_road_tags").select("area_id", "way_id", tags.alias("tags"))
    look = F.transform(F.array_sort(F.map_entries(M.appearance_tags(F.col("tags")))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select("area_id", "way_id", M.land_class(F.col("tags")).alias("land"), F.array_join(look, "|").alias("look"))


@topic.query(duck(f"""
WITH g AS (SELECT area_id, way_id, list({{'x': x * 1e0, 'z': z * 1e0}} ORDER BY idx) AS p, avg(x) AS mx, avg(z) AS mz FROM v_way_nodes GROUP BY 1, 2),
k AS (SELECT *, list_reduce(list_transform(p, lambda q: [q]), lambda a, b: CASE WHEN sqrt(pow(b[1].x - a[-1].x, 2) + pow(b[1].z - a[-1].z, 2)) > 40 THEN list_concat(a, b) ELSE a END) AS far FROM g)
SELECT area_id, way_id, {places_sql('mx', 4)} AS x, {places_sql('mz', 4)} AS z, len(far) AS far, {places_sql('far[-1].x', 4)} AS last_x,
 cast((len(p) + 2) // 3 + CASE WHEN len(p) % 3 <> 1 THEN 1 ELSE 0 END AS bigint) AS thinned FROM k""", "v_way_nodes"))
def line_shapes(spark, sf_dir):
    """Mean vertex, points more than 40 m apart, and every third point of each road."""
    lines = way_lines(spark, sf_dir)
    far, middle = Y.drop_close_points(F.col("points"), 40.0), Y.vertex_mean(F.col("points"))
    return lines.withColumns({"f": far, "m": middle}).select(
        "area_id", "way_id", places(F.col("m.x"), 4).alias("x"), places(F.col("m.z"), 4).alias("z"), F.size("f").cast("long").alias("far"),
        places(F.element_at("f", -1)["x"], 4).alias("last_x"), F.size(Y.thin_points(F.col("points"))).cast("long").alias("thinned"),
    )


@topic.query(duck(f"""
WITH u AS (SELECT *, half_x >= half_z AS wide, cx % 2 = 0 AS across, cz % 3 = 0 AS hipped FROM v_buildings),
e AS (SELECT *, CASE WHEN wide <> across THEN 1 ELSE 0 END AS ax, CASE WHEN wide = across THEN CASE WHEN across AND wide THEN 1 ELSE 1 END ELSE 0 END AS az FROM u),
s AS (SELECT *, CASE WHEN across AND NOT wide THEN -1 ELSE ax END AS ex, az AS ez FROM e),
d AS (SELECT *, -ez AS px, ex AS pz FROM s),
r AS (SELECT *, px * cx + pz * cz AS mid, abs(px) * half_x + abs(pz) * half_z AS half FROM d)
SELECT area_id, source_id, ex * 1e0 AS axis_x, ez * 1e0 AS axis_z, CASE WHEN hipped THEN 4 ELSE 2 END AS planes, {places_sql('3e0 / half * px', 6)} AS slope_x, {places_sql('3e0 / half * pz', 6)} AS slope_z,
 {places_sql('-(mid - half) * (3e0 / half)', 4)} AS rise FROM r""", "v_buildings"))
def roof_slopes(spark, sf_dir):
    """Ridge direction and the first sloping plane of each building's roof."""
    # Written as a column once: each use below would evaluate all planes again.
    rows = computed(building_corners(spark, sf_dir), roof=Y.roof_planes(
        F.col("ring"), F.lit(3.0), F.when(F.col("cz") % 3 == 0, "hipped").otherwise("gabled"), F.col("cx") % 2 == 0
    ))
    first = F.col("roof.planes")[0]
    return rows.select(
        "area_id", "source_id", (F.col("roof.axis_x") + 0.0).alias("axis_x"), (F.col("roof.axis_z") + 0.0).alias("axis_z"), F.size("roof.planes").alias("planes"),
        places(first["x"], 6).alias("slope_x"), places(first["z"], 6).alias("slope_z"), places(first["c"], 4).alias("rise"),
    )


WALL_SQL = f"""{DOOR_SQL.strip()},
wl AS (SELECT area_id, source_id, x + nx * 2e0 AS qx, z + nz * 2e0 AS qz, side, cx - half_x AS x0, cx + half_x AS x1, cz - half_z AS z0, cz + half_z AS z1 FROM (SELECT st.*, dn.cx, dn.cz, half_x, half_z, nx, nz, side FROM st JOIN dn USING (area_id, source_id))),
wa AS (SELECT *, unnest([0, 1, 2, 3]) AS wall FROM wl),
we AS (SELECT *, CASE wall WHEN 0 THEN x0 WHEN 1 THEN x1 WHEN 2 THEN x1 ELSE x0 END AS ax, CASE wall WHEN 0 THEN z0 WHEN 1 THEN z0 WHEN 2 THEN z1 ELSE z1 END AS az,
  CASE wall WHEN 0 THEN x1 WHEN 1 THEN x1 WHEN 2 THEN x0 ELSE x0 END AS bx, CASE wall WHEN 0 THEN z0 WHEN 1 THEN z1 WHEN 2 THEN z1 ELSE z0 END AS bz FROM wa),
wt AS (SELECT *, greatest(0e0, least(1e0, ((qx - ax) * (bx - ax) + (qz - az) * (bz - az)) / cast((bx - ax) * (bx - ax) + (bz - az) * (bz - az) AS double))) AS t FROM we),
wd AS (SELECT *, sqrt(pow(qx - ax - t * (bx - ax), 2) + pow(qz - az - t * (bz - az), 2)) AS d FROM wt QUALIFY row_number() OVER (PARTITION BY area_id, source_id ORDER BY d, wall) = 1)"""


@topic.query(duck(f"""
WITH {WALL_SQL} SELECT area_id, source_id, wall, {places_sql('d', 6)} AS distance, {places_sql('t', 6)} AS fraction, {places_sql('ax + (bx - ax) * 0.25e0', 4)} AS x, {places_sql('az + (bz - az) * 0.25e0', 4)} AS z,
 (bx - ax) / sqrt(cast((bx - ax) * (bx - ax) + (bz - az) * (bz - az) AS double)) AS dx, (ax + az) % 2 = 0 AS on_wall FROM wd""", "v_buildings"))
def wall_places(spark, sf_dir):
    """The wall nearest a point before each door, a place a quarter along it, and whether a shifted wall is still the same."""
    houses = building_corners(spark, sf_dir).select("area_id", F.col("source_id").alias("owner_id"), "ring")
    from_wall = aprons(doors(spark, sf_dir), houses.withColumnRenamed("owner_id", "source_id"))
    out = {c: F.col(c) + (F.col(f"p{c}") - F.col(c)) / (F.col("width") / 2 + 1) * 2.0 for c in "xz"}
    near = from_wall.select("area_id", "owner_id", out["x"].alias("qx"), out["z"].alias("qz")).join(houses, ["area_id", "owner_id"])
    near = near.withColumn("w", Y.nearest_wall(F.col("ring"), F.col("qx"), F.col("qz"))).withColumn("e", F.element_at(Y.edges(F.col("ring")), F.col("w.wall") + 1))
    a, b = F.col("e")["a"], F.col("e")["b"]
    spot = Y.opening_position(a["x"], a["z"], b["x"], b["z"], F.lit(0.25))
    moved = F.when((a["x"] + a["z"]) % 2 == 0, 0.1).otherwise(0.2)
    same = Y.on_ring_wall(F.col("ring"), b["x"] + moved, b["z"], a["x"], a["z"] - moved)
    return near.withColumn("s", spot).select(
        "area_id", F.col("owner_id").alias("source_id"), F.col("w.wall").alias("wall"), places(F.col("w.distance"), 6).alias("distance"),
        places(F.col("w.fraction"), 6).alias("fraction"), places(F.col("s.x"), 4).alias("x"), places(F.col("s.z"), 4).alias("z"), F.col("s.dx").alias("dx"), same.alias("on_wall"),
    )


BLOCK_SQL = f"""{DOOR_SQL.strip()},
k0 AS (SELECT area_id, width, x AS ax, z AS az, px AS bx, pz AS bz, source_id AS owner FROM st),
k1 AS (SELECT area_id, width, px AS ax, pz AS az, px + 40 AS bx, pz + 25 AS bz, cast(NULL AS varchar) AS owner FROM st),
{blocked_sql('c0', 'k0').strip()}, {blocked_sql('c1', 'k1').strip()}"""


@topic.query(duck(f"""
WITH {BLOCK_SQL} SELECT area_id, source_id AS route_id FROM st WHERE EXISTS (SELECT 1 FROM c0 WHERE c0.area_id = st.area_id AND c0.width = st.width AND c0.ax = x AND c0.az = z)
 OR EXISTS (SELECT 1 FROM c1 WHERE c1.area_id = st.area_id AND c1.width = st.width AND c1.ax = px AND c1.az = pz)""", "v_buildings"))
def blocked_ways(spark, sf_dir):
    """Ways of two legs from each door that come too close to a building."""
    starts = cut_lineage(aprons(doors(spark, sf_dir), building_corners(spark, sf_dir)))
    spots = F.array(*[
        F.struct(F.lit(n).alias("idx"), x.alias("x"), z.alias("z"))
        for n, (x, z) in enumerate(((F.col("x"), F.col("z")), (F.col("px"), F.col("pz")), (F.col("px") + 40, F.col("pz") + 25)))
    ])
    routes = starts.select("area_id", F.col("door_id").alias("route_id"), "width", "owner_id", F.explode(spots).alias("_p")).select("area_id", "route_id", "width", "owner_id", "_p.*")
    return S.blocked_routes(cut_lineage(routes), cut_lineage(building_corners(spark, sf_dir).select("area_id", "source_id", "ring"))).select("area_id", "route_id")


@topic.query(duck(f"""
WITH {POINT_SQL}, {DOOR_SQL.strip()},
sg AS (SELECT * FROM (SELECT area_id, width AS road_width, x AS ax, z AS az, lead(x) OVER w AS bx, lead(z) OVER w AS bz FROM pt WINDOW w AS (PARTITION BY area_id, way_id ORDER BY idx)) WHERE bx IS NOT NULL),
mt AS (SELECT st.area_id, source_id, px - ax AS ox, pz - az AS oz, bx - ax AS dx, bz - az AS dz, road_width FROM st JOIN sg ON sg.area_id = st.area_id AND px BETWEEN least(ax, bx) - road_width AND greatest(ax, bx) + road_width AND pz BETWEEN least(az, bz) - road_width AND greatest(az, bz) + road_width),
md AS (SELECT *, greatest(0e0, least(1e0, (ox * dx + oz * dz) / cast(dx * dx + dz * dz AS double))) AS t FROM mt)
SELECT DISTINCT area_id, source_id AS door_id FROM md WHERE sqrt(pow(ox - t * dx, 2) + pow(oz - t * dz, 2)) <= road_width / 2 + 0.5""", *VIEWS, "v_buildings"))
def doors_at_roads(spark, sf_dir):
    """Doors whose apron already meets a road."""
    starts = aprons(doors(spark, sf_dir), building_corners(spark, sf_dir)).select("area_id", "door_id", "px", "pz")
    parts = cut_lineage(L.segments(grid_points(spark, sf_dir), carry=("width",)), wide=True)
    return S.meets_road(cut_lineage(starts), parts, ["door_id"]).select("area_id", "door_id")


@topic.query(duck("""
WITH s AS (SELECT area_id, count(*) AS n, max(r) + 1 AS rows, max(c) + 1 AS columns, min(height) AS low, max(height) AS high FROM v_dem GROUP BY 1),
k AS (SELECT d.area_id, r AS row, c AS col, coalesce(height, -1e0) AS height FROM v_dem d WHERE area_id % 3 <> 0
 UNION ALL SELECT area_id, r, c, 0e0 FROM (SELECT DISTINCT area_id FROM v_dem WHERE area_id % 3 = 0), (VALUES (0), (1)) a(r), (VALUES (0), (1)) b(c))
SELECT k.*, CASE WHEN k.area_id % 2 = 0 AND k.area_id % 3 <> 0 THEN 'size' WHEN k.area_id % 5 = 1 THEN 'range' END AS error FROM k""", "v_dem"))
def fallback_grids(spark, sf_dir):
    """Usable grids and flat ones, with the first broken rule of their declared size and range."""
    dem = view(spark, sf_dir, "v_dem").select("area_id", F.col("r").alias("row"), F.col("c").alias("col"), F.coalesce("height", F.lit(-1.0)).alias("height"))
    decisions = dem.select("area_id").distinct().withColumn("flat", F.col("area_id") % 3 == 0)
    grids = cut_lineage(E.with_fallback(dem, decisions))
    sizes = grids.groupBy("area_id").agg(
        F.count("*").alias("n"), (F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("columns"), F.min("height").alias("low"), F.max("height").alias("high")
    )
    # Grids of even areas declare a row too many, some others a range upside down.
    rows = F.col("rows") + F.when((F.col("area_id") % 2 == 0) & (F.col("area_id") % 3 != 0), 1).otherwise(0)
    high = F.when(F.col("area_id") % 5 == 1, F.col("low") - 1).otherwise(F.col("high"))
    errors = sizes.select("area_id", M.grid_error(F.col("n"), F.col("columns"), rows, F.col("low"), high).alias("error"))
    return grids.join(errors, "area_id").select("area_id", "row", "col", "height", "error")
