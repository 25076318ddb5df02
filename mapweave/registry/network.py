"""Road graphs, shortest paths and routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapweave.derived import duck, places_sql, view
from mapweave.functions.text import places
from mapweave.operators import lines as L
from mapweave.operators import network as N
from mapweave.operators import routes as R
from mapweave.operators.ordered import hot_keys
from mapweave.operators.ranking import top_per_group
from mapweave.registry.catalog import Topic
from mapweave.registry.plan import POINT_SQL, VIEWS, grid_points
from mapweave.session import cut_lineage

topic = Topic()

GRAPH_SQL = f"""{POINT_SQL},
nd AS (SELECT *, concat(kx, ':', kz, ':', cast(layer AS bigint)) AS node FROM ky),
pr AS (SELECT *, lead(node) OVER w AS nn, lead(x) OVER w AS nx, lead(z) OVER w AS nz FROM nd WINDOW w AS (PARTITION BY area_id, way_id ORDER BY idx)),
sg AS (SELECT *, sqrt(cast((nx - x) * (nx - x) + (nz - z) * (nz - z) AS double)) AS len FROM pr WHERE nn IS NOT NULL AND (nx <> x OR nz <> z)),
be AS (SELECT area_id, node AS src, nn AS dst, len, way_id, idx FROM sg UNION ALL SELECT area_id, nn, node, len, way_id, idx FROM sg),
eg AS (SELECT area_id, src, dst, arg_min(len, way_id * 1000 + idx) AS len FROM be GROUP BY 1, 2, 3)"""


@topic.query(duck(f"WITH {GRAPH_SQL} SELECT area_id, src, dst, {places_sql('len', 6)} AS length FROM eg", *VIEWS))
def graph_edges(spark, sf_dir):
    _, edges = N.road_graph(grid_points(spark, sf_dir))
    return edges.withColumn("length", places(F.col("length"), 6))


@topic.query(duck(f"""
WITH {GRAPH_SQL}, e AS (SELECT area_id, node, x, z, way_id * 2000 + idx * 2 AS o FROM sg UNION ALL SELECT area_id, nn, nx, nz, way_id * 2000 + idx * 2 + 1 FROM sg)
SELECT area_id, node, arg_max(x, o) AS x, arg_max(z, o) AS z FROM e GROUP BY 1, 2""", *VIEWS))
def graph_vertices(spark, sf_dir):
    vertices, _ = N.road_graph(grid_points(spark, sf_dir))
    return vertices.select("area_id", "node", "x", "z")


@topic.query(duck("""
WITH s AS (SELECT * FROM (SELECT area_id, concat(x, ':', z) AS a, lead(concat(x, ':', z)) OVER (PARTITION BY area_id, way_id ORDER BY idx) AS b FROM v_grid_nodes) WHERE b IS NOT NULL),
u AS (SELECT area_id, a AS node, b AS other FROM s UNION SELECT area_id, b, a FROM s)
SELECT area_id, node, count(DISTINCT other) AS degree FROM u GROUP BY 1, 2""", "v_grid_nodes"))
def node_degrees(spark, sf_dir):
    nodes = view(spark, sf_dir, "v_grid_nodes")
    return N.degrees(L.segments(nodes, block=hot_keys(nodes, L.KEYS)))


def search(spark, sf_dir):
    """Edges, and distances from the node with most edges in each area; the lowest key wins a tie."""
    _, edges = N.road_graph(grid_points(spark, sf_dir))
    edges = cut_lineage(edges)
    counts = edges.groupBy("area_id", "src").agg((-F.count("*")).alias("n"))
    sources = counts.groupBy("area_id").agg(F.min(F.struct("n", "src"))["src"].alias("node")).withColumn("source", F.lit("hub"))
    return edges, N.shortest_distances(edges, sources)


# Two passes of the keyed recursion: a row per node, replaced while it improves.
DIST_SQL = f"""{GRAPH_SQL},
di(area_id, node, dist) USING KEY (area_id, node) AS (
 SELECT area_id, src, 0e0 FROM (SELECT area_id, src, count(*) AS n FROM eg GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY area_id ORDER BY n DESC, src) = 1
 UNION SELECT eg.area_id, eg.dst, min(d.dist + eg.len) FROM di d JOIN eg ON eg.area_id = d.area_id AND eg.src = d.node
  LEFT JOIN recurring.di r ON r.area_id = eg.area_id AND r.node = eg.dst WHERE r.dist IS NULL OR d.dist + eg.len < r.dist GROUP BY 1, 2)"""


@topic.query(duck(f"WITH RECURSIVE {DIST_SQL} SELECT area_id, node, round(dist, 4) AS dist FROM di", *VIEWS))
def shortest_distances(spark, sf_dir):
    return search(spark, sf_dir)[1].select("area_id", "node", F.round("dist", 4).alias("dist"))


@topic.query(duck(f"""
WITH RECURSIVE {DIST_SQL} SELECT area_id, round(max(dist), 4) AS dist, count(*) AS reachable FROM di GROUP BY 1""", *VIEWS))
def farthest_nodes(spark, sf_dir):
    _, found = search(spark, sf_dir)
    return N.farthest(found).select("area_id", F.round("dist", 4).alias("dist")).join(
        found.groupBy("area_id").agg(F.count("*").alias("reachable")), "area_id"
    )


@topic.query(duck(f"""
WITH RECURSIVE {DIST_SQL}, fa AS (SELECT area_id, max(dist) AS dist FROM di GROUP BY 1) SELECT area_id, true AS starts_at_source, round(dist, 4) AS length FROM fa""", *VIEWS))
def farthest_path_lengths(spark, sf_dir):
    """Length of the extracted path to the farthest node, summed over its edges."""
    edges, found = search(spark, sf_dir)
    ends = N.farthest(found).select("area_id", "source", F.col("node").alias("end"))
    walked = N.paths(found, ends)
    order = F.array_sort(F.collect_list(F.struct("dist", "node")))
    # One path per area: its nodes are bounded by the road network's diameter.
    step = walked.join(found.select("area_id", "source", "node", "prev"), ["area_id", "source", "node"]).join(
        edges.select("area_id", F.col("src").alias("prev"), F.col("dst").alias("node"), "length"), ["area_id", "prev", "node"], "left"
    )
    return step.groupBy("area_id").agg(
        F.min_by(F.col("prev").isNull(), "dist").alias("starts_at_source"), F.round(F.sum("length"), 4).alias("length")
    )


def way_courses(spark, sf_dir):
    """Every lattice road with at least two points as a course."""
    return grid_points(spark, sf_dir).where("count > 1").select(
        "area_id", F.col("way_id").alias("course_id"), "idx", "x", "z", "y"
    )


COURSE_SQL = f"""{POINT_SQL},
co AS (SELECT area_id, way_id AS course_id, idx, x, z, y FROM pt WHERE cnt > 1),
st AS (SELECT *, coalesce(sqrt(cast((x - lag(x) OVER w) * (x - lag(x) OVER w) + (z - lag(z) OVER w) * (z - lag(z) OVER w) AS double)), 0) AS step FROM co WINDOW w AS (PARTITION BY area_id, course_id ORDER BY idx)),
me AS (SELECT *, sum(step) OVER (PARTITION BY area_id, course_id ORDER BY idx) AS distance, sum(step) OVER (PARTITION BY area_id, course_id) AS length FROM st),
nr AS (SELECT *, lag(x, 2) OVER w AS bx, lag(z, 2) OVER w AS bz, lead(x, 2) OVER w AS ax, lead(z, 2) OVER w AS az FROM me WINDOW w AS (PARTITION BY area_id, course_id ORDER BY idx)),
an AS (SELECT *, atan2(cast(ax - x AS double), cast(az - z AS double)) - atan2(cast(x - bx AS double), cast(z - bz AS double)) AS dv FROM nr WHERE bx IS NOT NULL AND ax IS NOT NULL),
sh AS (SELECT area_id, course_id, list(distance ORDER BY distance) AS ds FROM an WHERE abs(atan2(sin(dv), cos(dv))) > pi() / 5 AND distance > 35 AND distance < length - 35 GROUP BY 1, 2),
tn AS (SELECT area_id, course_id, unnest(list_reduce(list_transform(ds, lambda d: [d]), lambda a, b: CASE WHEN b[1] - a[len(a)] > 28 THEN list_concat(a, b) ELSE a END)) AS distance FROM sh)"""


@topic.query(duck(f"WITH {COURSE_SQL} SELECT area_id, course_id, {places_sql('distance', 6)} AS distance FROM tn", *VIEWS))
def route_turns(spark, sf_dir):
    return R.turns(way_courses(spark, sf_dir)).withColumn("distance", places(F.col("distance"), 6))


@topic.query(duck(f"""
WITH {COURSE_SQL}, ln AS (SELECT DISTINCT area_id, course_id, length FROM me),
cp AS (SELECT area_id, course_id, unnest(list_append(list_filter(list_transform(range(1, 1000), lambda i: i * 125e0), lambda d: d < length - 30), length)) AS distance FROM ln)
SELECT area_id, course_id, cast(row_number() OVER (PARTITION BY area_id, course_id ORDER BY distance) - 1 AS int) AS checkpoint, {places_sql('distance', 6)} AS distance FROM cp""", *VIEWS))
def route_checkpoints(spark, sf_dir):
    lengths = L.cumulative_distance(way_courses(spark, sf_dir), R.COURSE, "idx", "d", "length").select(
        "area_id", "course_id", "length"
    ).distinct()
    return R.checkpoints(lengths).withColumn("distance", places(F.col("distance"), 6))


def lattice_parts(spark, sf_dir):
    points = grid_points(spark, sf_dir)
    return cut_lineage(L.segments(points, carry=("width", "layer")), wide=True)


@topic.query(duck(f"""
WITH {COURSE_SQL},
se AS (SELECT * FROM (SELECT area_id, way_id, idx, width, x AS ax, z AS az, lead(x) OVER w - x AS dx, lead(z) OVER w - z AS dz FROM pt WINDOW w AS (PARTITION BY area_id, way_id ORDER BY idx)) WHERE dx IS NOT NULL),
sp AS (SELECT DISTINCT area_id, x, z FROM co),
wd AS (SELECT p.area_id, p.x, p.z, arg_min(width, way_id * 1000 + idx) AS width FROM sp p JOIN se s ON s.area_id = p.area_id AND p.x BETWEEN least(ax, ax + dx) AND greatest(ax, ax + dx) AND p.z BETWEEN least(az, az + dz) AND greatest(az, az + dz)
  AND (p.x - ax) * dz = (p.z - az) * dx GROUP BY 1, 2, 3),
de AS (SELECT area_id, x, z, count(DISTINCT concat(ox, ':', oz)) AS degree FROM (SELECT area_id, ax AS x, az AS z, ax + dx AS ox, az + dz AS oz FROM se UNION ALL SELECT area_id, ax + dx, az + dz, ax, az FROM se) GROUP BY 1, 2, 3),
gr AS (SELECT me.*, width, degree, greatest(0, coalesce(me.y - lag(me.y) OVER w, 0)) AS up, CASE WHEN step > 0.1 THEN abs((me.y - lag(me.y) OVER w) / step) END AS grade FROM me JOIN wd USING (area_id, x, z) JOIN de USING (area_id, x, z) WINDOW w AS (PARTITION BY area_id, course_id ORDER BY idx)),
ba AS (SELECT area_id, course_id, max(length) AS length, sum(up) AS gain, coalesce(max(grade), 0) AS max_grade, avg(width) AS aw, 1 - count(DISTINCT concat(x, ':', z)) / count(*) AS rep, count(DISTINCT CASE WHEN degree >= 3 THEN concat(x, ':', z) END) AS crossings FROM gr GROUP BY 1, 2),
tc AS (SELECT area_id, course_id, count(*) AS turns FROM tn GROUP BY 1, 2),
al AS (SELECT ba.*, coalesce(turns, 0) AS turns FROM ba LEFT JOIN tc USING (area_id, course_id))
SELECT area_id, course_id, {places_sql('gain', 4)} AS elevation_gain, {places_sql('max_grade', 6)} AS max_grade, {places_sql('aw', 4)} AS average_width, {places_sql('rep', 6)} AS repetition, crossings AS intersections, turns,
 cast(floor(greatest(0, least(100, 72 + least(12, (aw - 4.5) * 4) + least(1, turns / greatest(4, length / 180)) * 10 + least(6, crossings) - max_grade * 120 - rep * 28)) + 0.5) AS bigint) AS score,
 CASE WHEN turns / greatest(1, length / 1000) + max_grade * 35 + greatest(0, 6 - aw) >= 10 THEN 'Challenging' WHEN turns / greatest(1, length / 1000) + max_grade * 35 + greatest(0, 6 - aw) >= 5 THEN 'Technical' ELSE 'Easy' END AS difficulty FROM al""", *VIEWS))
def route_quality(spark, sf_dir):
    courses = cut_lineage(way_courses(spark, sf_dir))
    scored = R.quality(courses, lattice_parts(spark, sf_dir), R.turns(courses))
    return scored.select(
        "area_id", "course_id", places(F.col("elevation_gain"), 4).alias("elevation_gain"), places(F.col("max_grade"), 6).alias("max_grade"),
        places(F.col("average_width"), 4).alias("average_width"), places(F.col("repetition"), 6).alias("repetition"), "intersections", "turns",
        "score", "difficulty",
    )


@topic.query()
def route_barriers(spark, sf_dir):
    """Barriers beside every lattice road driven as a route."""
    courses = cut_lineage(way_courses(spark, sf_dir))
    return R.barriers(courses, grid_points(spark, sf_dir)).select(
        "area_id", "course_id", "rank", F.round("x", 4).alias("x"), F.round("z", 4).alias("z"), F.round("yaw", 6).alias("yaw")
    )


@topic.query()
def circuit_candidates(spark, sf_dir):
    """Scored circuits from the origin of each area over the lattice roads."""
    points = cut_lineage(grid_points(spark, sf_dir))
    starts = points.select("area_id").distinct().select(
        "area_id", F.col("area_id").alias("start_id"), F.lit(0.0).alias("px"), F.lit(0.0).alias("pz"), F.lit(0.0).alias("hx"), F.lit(-1.0).alias("hz")
    )
    best, _ = R.candidates(points, L.segments(points, carry=("width", "layer")), starts)
    return R.summaries(best)


@topic.query(duck(f"""
WITH {POINT_SQL},
pl AS (SELECT area_id, x, z, min(concat(lpad(cast(way_id AS varchar(20)), 12, '0'), '/', lpad(cast(idx AS varchar(20)), 8, '0'))) AS node,
  arg_min(y, way_id * 1000 + idx) AS ny FROM pt GROUP BY 1, 2, 3),
st AS (SELECT area_id, way_id, idx, node AS src, x, z, ny, lead(node) OVER w AS dst, lead(x) OVER w AS nx, lead(z) OVER w AS nz, lead(ny) OVER w AS nny
  FROM pt JOIN pl USING (area_id, x, z) WINDOW w AS (PARTITION BY area_id, way_id ORDER BY idx)),
ed AS (SELECT area_id, src, dst, sqrt(cast((nx - x) * (nx - x) + (nz - z) * (nz - z) AS double) + (nny - ny) * (nny - ny)) AS len FROM st WHERE dst IS NOT NULL AND dst <> src),
bo AS (SELECT area_id, src, dst, len FROM ed UNION ALL SELECT area_id, dst, src, len FROM ed)
SELECT area_id, src, dst, {places_sql('min(len)', 4)} AS length FROM bo GROUP BY 1, 2, 3""", *VIEWS))
def snapped_edges(spark, sf_dir):
    """Graph of the lattice roads with nearby points joined."""
    points = grid_points(spark, sf_dir).withColumn("tunnel", F.lit(False))
    _, edges = N.snapped_graph(points)
    return edges.withColumn("length", places(F.col("length"), 4))


# The edge from each area's hub to its lowest neighbour is closed; the goal is the second-busiest node.
CLOSED_SQL = f"""{GRAPH_SQL},
hu AS (SELECT area_id, src AS hub, row_number() OVER (PARTITION BY area_id ORDER BY count(*) DESC, src) AS k FROM eg GROUP BY 1, 2),
cl AS (SELECT h.area_id, hub, min(dst) AS other FROM hu h JOIN eg ON eg.area_id = h.area_id AND eg.src = hub WHERE k = 1 GROUP BY 1, 2),
oe AS (SELECT eg.* FROM eg JOIN cl USING (area_id) WHERE NOT ((src = hub AND dst = other) OR (src = other AND dst = hub)))"""


@topic.query(duck(f"""
WITH RECURSIVE {CLOSED_SQL},
di(area_id, node, dist) USING KEY (area_id, node) AS (
 SELECT area_id, hub, 0e0 FROM cl
 UNION SELECT oe.area_id, oe.dst, min(d.dist + oe.len) FROM di d JOIN oe ON oe.area_id = d.area_id AND oe.src = d.node
  LEFT JOIN recurring.di r ON r.area_id = oe.area_id AND r.node = oe.dst WHERE r.dist IS NULL OR d.dist + oe.len < r.dist GROUP BY 1, 2)
SELECT di.area_id, di.node, round(di.dist, 4) AS dist, di.node = other AS closed_end FROM di JOIN cl USING (area_id)""", *VIEWS))
def detour_distances(spark, sf_dir):
    """Distances from the hub when the edge to its lowest neighbour is closed."""
    _, edges = N.road_graph(grid_points(spark, sf_dir))
    edges = cut_lineage(edges)
    hubs = ranked_nodes(edges).where("k = 1").select("area_id", F.col("src").alias("node"))
    first = edges.join(hubs.withColumnRenamed("node", "src"), ["area_id", "src"]).groupBy("area_id", F.col("src").alias("node")).agg(F.min("dst").alias("ex_b"))
    sources = cut_lineage(first.select("area_id", F.lit("hub").alias("source"), "node", F.col("node").alias("ex_a"), "ex_b"))
    found = N.shortest_distances(edges, sources)
    return found.join(sources.select("area_id", "ex_b"), "area_id").select(
        "area_id", "node", F.round("dist", 4).alias("dist"), (F.col("node") == F.col("ex_b")).alias("closed_end")
    )


def ranked_nodes(edges):
    """``area_id, src, k``: nodes of each area by their number of edges, the lowest key first."""
    counts = edges.groupBy("area_id", "src").agg((-F.count("*")).alias("n"))
    return top_per_group(counts, ["area_id"], [F.col("n"), F.col("src")], 2, "k")


@topic.query(duck(f"""
WITH RECURSIVE {GRAPH_SQL},
hu AS (SELECT area_id, src AS goal FROM (SELECT area_id, src, row_number() OVER (PARTITION BY area_id ORDER BY count(*) DESC, src) AS k FROM eg GROUP BY 1, 2) WHERE k = 2),
di(area_id, node, dist) USING KEY (area_id, node) AS (
 SELECT area_id, goal, 0e0 FROM hu
 UNION SELECT eg.area_id, eg.dst, min(d.dist + eg.len) FROM di d JOIN eg ON eg.area_id = d.area_id AND eg.src = d.node
  LEFT JOIN recurring.di r ON r.area_id = eg.area_id AND r.node = eg.dst WHERE r.dist IS NULL OR d.dist + eg.len < r.dist GROUP BY 1, 2),
nx AS (SELECT t.area_id, t.node, arg_min(f.node, (round(f.dist + eg.len, 7), f.node)) AS next FROM di t JOIN eg ON eg.area_id = t.area_id AND eg.dst = t.node JOIN di f ON f.area_id = eg.area_id AND f.node = eg.src
  WHERE f.dist < t.dist GROUP BY 1, 2)
SELECT di.area_id, di.node, round(dist, 4) AS dist, next FROM di LEFT JOIN nx USING (area_id, node)""", *VIEWS))
def goal_routes(spark, sf_dir):
    """Distance and next step from every node to its area's second-busiest node."""
    _, edges = N.road_graph(grid_points(spark, sf_dir))
    edges = cut_lineage(edges)
    goals = ranked_nodes(edges).where("k = 2").select("area_id", F.lit("goal").alias("source"), F.col("src").alias("node"))
    return N.routes_to_goal(edges, goals).select("area_id", "node", F.round("dist", 4).alias("dist"), "next")


DENSE_SQL = """
pt AS (SELECT area_id, way_id, idx, x / 16e0 AS x, z / 16e0 AS z, concat(lpad(cast(way_id AS varchar(20)), 12, '0'), '/', lpad(cast(idx AS varchar(20)), 8, '0')) AS ord FROM v_way_nodes),
pl AS (SELECT area_id, x, z, min(ord) AS node FROM pt GROUP BY 1, 2, 3),
lk AS (SELECT a.area_id, a.node AS a, b.node AS b FROM pl a JOIN pl b ON a.area_id = b.area_id AND a.node > b.node AND b.x BETWEEN a.x - 1.5 AND a.x + 1.5 AND b.z BETWEEN a.z - 1.5 AND a.z + 1.5
  WHERE (a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z) < 2.25),
su(area_id, node, open) USING KEY (area_id, node) AS (
 SELECT area_id, node, true FROM pl WHERE NOT EXISTS (SELECT 1 FROM lk WHERE lk.area_id = pl.area_id AND lk.a = pl.node)
 UNION SELECT lk.area_id, lk.a, NOT coalesce(bool_or(r.open), false) FROM lk LEFT JOIN recurring.su r ON r.area_id = lk.area_id AND r.node = lk.b
  WHERE NOT EXISTS (SELECT 1 FROM recurring.su k WHERE k.area_id = lk.area_id AND k.node = lk.a) AND EXISTS (SELECT 1 FROM su)
  GROUP BY 1, 2 HAVING coalesce(bool_or(r.open), false) OR count(r.node) = count(*))"""


@topic.query(duck(f"WITH RECURSIVE {DENSE_SQL.strip()} SELECT su.area_id, su.node, {places_sql('x', 4)} AS x, {places_sql('z', 4)} AS z FROM su JOIN pl USING (area_id, node) WHERE open", "v_way_nodes"))
def snapped_nodes(spark, sf_dir):
    """Nodes of road points that lie within the snapping radius of many others."""
    near = view(spark, sf_dir, "v_way_nodes").select(
        "area_id", "way_id", "idx", (F.col("x") / 16.0).alias("x"), (F.col("z") / 16.0).alias("z"), F.lit(False).alias("tunnel")
    )
    nodes, _ = N.snapped_graph(near)
    return nodes.select("area_id", "node", places(F.col("x"), 4).alias("x"), places(F.col("z"), 4).alias("z"))


# Courses that go to and fro across their direction, so that most have bends.
BENT_SQL = """
co AS (SELECT area_id, way_id AS course_id, idx, idx * 45 AS x, (way_id * idx * 7) % 4 * 30 AS z, 0e0 AS y FROM v_way_nodes),
""" + COURSE_SQL.split("co AS", 1)[1].split("\n", 1)[1]


@topic.query(duck(f"WITH {BENT_SQL.strip()} SELECT area_id, course_id, {places_sql('distance', 6)} AS distance FROM tn", "v_way_nodes"))
def bent_turns(spark, sf_dir):
    """Turns of courses with bends; those too near to the last one or to an end do not count."""
    bent = view(spark, sf_dir, "v_way_nodes").select(
        "area_id", F.col("way_id").alias("course_id"), "idx", (F.col("idx") * 45).alias("x"), (F.col("way_id") * F.col("idx") * 7 % 4 * 30).alias("z"), F.lit(0.0).alias("y")
    )
    return R.turns(bent).withColumn("distance", places(F.col("distance"), 6))
