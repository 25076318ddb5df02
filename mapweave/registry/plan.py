"""Junctions, chunks and sign posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapweave.derived import duck, places_sql, view
from mapweave.functions import measure as M
from mapweave.functions.text import places
from mapweave.operators import chunks as C
from mapweave.operators import junctions as J
from mapweave.operators import lines as L
from mapweave.operators import overrides as O
from mapweave.operators.components import components
from mapweave.operators.ordered import hot_keys
from mapweave.registry.catalog import Topic
from mapweave.registry.features import CLASS_SQL, LAYER_SQL, WIDTH_CTES, measure_sql, road_widths
from mapweave.session import cut_lineage

topic = Topic()

POINT_SQL = f"""{WIDTH_CTES.strip()},
pt AS (SELECT n.area_id, n.way_id, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY n.area_id, n.way_id) AS cnt, n.x, n.z, {LAYER_SQL} AS layer, road_width AS width,
  cast((n.x * 31 + n.z * 17 + 100000) % 97 AS double) / 4 AS y
  FROM v_grid_nodes n JOIN widths USING (area_id, way_id) WINDOW w AS (PARTITION BY n.area_id, n.way_id ORDER BY n.idx)),
ky AS (SELECT *, x * 10 AS kx, z * 10 AS kz FROM pt),
jn AS (SELECT area_id, layer, kx, kz, concat('junction:', kx, ':', kz, ':', cast(layer AS bigint)) AS junction, arg_min(x, way_id * 1000 + idx) AS x, arg_min(z, way_id * 1000 + idx) AS z, avg(y) AS y, max(width) / 2 AS radius, count(*) AS occurrences,
  count(*) FILTER (WHERE idx = 0 OR idx = cnt - 1) AS endpoints, count(DISTINCT way_id) AS roads FROM ky GROUP BY 1, 2, 3, 4),
jk AS (SELECT *, CASE WHEN roads > 1 OR occurrences > 1 THEN 'intersection' ELSE 'end-cap' END AS kind FROM jn WHERE roads > 1 OR endpoints > 0)"""


def grid_points(spark, sf_dir):
    """Lattice road points with widths, layers and an integer-derived height, numbered from 0."""
    roads = road_widths(spark, sf_dir).select(
        "area_id", "way_id", F.col("road_width").alias("width"), M.road_layer(F.col("layer")).alias("layer")
    )
    nodes = view(spark, sf_dir, "v_grid_nodes")
    y = ((F.col("x") * 31 + F.col("z") * 17 + 100000) % 97).cast("double") / 4
    return L.numbered(nodes, block=hot_keys(nodes, L.KEYS)).join(roads, ["area_id", "way_id"]).withColumn("y", y)


VIEWS = ("v_road_tags", "v_overrides", "v_grid_nodes")


@topic.query(duck(f"""
WITH {POINT_SQL} SELECT area_id, junction, x * 1e0 AS x, z * 1e0 AS z, {places_sql('y', 6)} AS y, {places_sql('radius', 6)} AS radius, occurrences, endpoints, kind FROM jk""", *VIEWS))
def junctions(spark, sf_dir):
    found = J.junctions(grid_points(spark, sf_dir))
    return found.select(
        "area_id", "junction", "x", "z", places(F.col("y"), 6).alias("y"), places(F.col("radius"), 6).alias("radius"),
        "occurrences", "endpoints", "kind",
    )


@topic.query(duck(f"""
WITH {POINT_SQL} SELECT DISTINCT ky.area_id, jk.junction, way_id FROM ky JOIN jk USING (area_id, layer, kx, kz)""", *VIEWS))
def junction_roads(spark, sf_dir):
    points = cut_lineage(grid_points(spark, sf_dir))
    return J.junction_roads(points, J.junctions(points))


CLUSTER_SQL = f"""{POINT_SQL},
sp AS (SELECT *, coalesce(sqrt(cast((x - lag(x) OVER w) * (x - lag(x) OVER w) + (z - lag(z) OVER w) * (z - lag(z) OVER w) AS double)), 0) AS step FROM ky WINDOW w AS (PARTITION BY area_id, way_id ORDER BY idx)),
dl AS (SELECT *, sum(step) OVER (PARTITION BY area_id, way_id ORDER BY idx) AS along FROM sp),
an AS (SELECT dl.area_id, way_id, idx, along, jk.junction, jk.radius + 4 AS reach FROM dl JOIN jk USING (area_id, layer, kx, kz)),
ed AS (SELECT area_id, pj AS a, junction AS b FROM (SELECT *, lag(junction) OVER w AS pj, lag(along) OVER w AS pa, lag(reach) OVER w AS pr FROM an WINDOW w AS (PARTITION BY area_id, way_id ORDER BY idx)) WHERE pj IS NOT NULL AND along - pa <= reach + pr),
bo AS (SELECT DISTINCT area_id, a, b FROM (SELECT area_id, a, b FROM ed UNION ALL SELECT area_id, b, a FROM ed) WHERE a <> b)"""


def grid_anchors(spark, sf_dir):
    points = cut_lineage(grid_points(spark, sf_dir))
    found = cut_lineage(J.junctions(points))
    return points, found, J.anchors(points, found)


@topic.query(duck(f"""
WITH {CLUSTER_SQL} SELECT DISTINCT area_id, a, b FROM ed WHERE a <> b""", *VIEWS))
def junction_links(spark, sf_dir):
    _, _, anchored = grid_anchors(spark, sf_dir)
    return J.cluster_edges(anchored).where("a <> b").distinct()


@topic.query(duck("""
WITH RECURSIVE sh AS (SELECT DISTINCT area_id, x, z, way_id FROM v_grid_nodes),
ed AS (SELECT area_id, x, z, min(way_id) AS hub FROM sh GROUP BY 1, 2, 3),
ln AS (SELECT DISTINCT sh.area_id, way_id AS a, hub AS b FROM sh JOIN ed USING (area_id, x, z) WHERE way_id <> hub),
bo AS (SELECT area_id, a, b FROM ln UNION SELECT area_id, b, a FROM ln),
rc AS (SELECT area_id, a AS node, a AS root FROM bo GROUP BY ALL UNION SELECT bo.area_id, bo.b, rc.root FROM rc JOIN bo ON bo.area_id = rc.area_id AND bo.a = rc.node AND rc.root < bo.b)
SELECT area_id, node, min(root) AS root FROM rc GROUP BY 1, 2""", "v_grid_nodes"))
def road_components(spark, sf_dir):
    """Connected roads: ways that share a lattice point, linked through the lowest way at the point."""
    nodes = view(spark, sf_dir, "v_grid_nodes").select("area_id", "x", "z", "way_id").distinct()
    hubs = nodes.groupBy("area_id", "x", "z").agg(F.min("way_id").alias("hub"))
    links = nodes.join(hubs, ["area_id", "x", "z"]).select("area_id", F.col("way_id").alias("a"), F.col("hub").alias("b"))
    return components(links)


EASED_SQL = f"""{CLUSTER_SQL},
rc AS (SELECT area_id, a AS node, a AS root FROM bo GROUP BY ALL UNION SELECT bo.area_id, bo.b, rc.root FROM rc JOIN bo ON bo.area_id = rc.area_id AND bo.a = rc.node AND rc.root < bo.b),
lb AS (SELECT jk.area_id, junction, y, coalesce(r.root, junction) AS root FROM jk LEFT JOIN (SELECT area_id, node AS junction, min(root) AS root FROM rc GROUP BY 1, 2) r USING (area_id, junction)),
lv AS (SELECT area_id, junction, avg(y) OVER (PARTITION BY area_id, root) AS level FROM lb),
al AS (SELECT an.*, level FROM an JOIN lv USING (area_id, junction)),
of AS (SELECT dl.area_id, dl.way_id, dl.idx, dl.y, al.idx AS ai, level, abs(dl.along - al.along) AS off, reach FROM dl LEFT JOIN al ON al.area_id = dl.area_id AND al.way_id = dl.way_id AND abs(dl.along - al.along) <= reach + 16),
wt AS (SELECT *, off <= reach AS inside, greatest(0, 1 - (off - reach) / 16) AS t FROM of),
pu AS (SELECT area_id, way_id, idx, any_value(y) AS y, arg_min(level, ai) FILTER (WHERE inside) AS flat, sum(t * t * (3 - 2 * t)) FILTER (WHERE NOT inside) AS w, sum(t * t * (3 - 2 * t) * level) FILTER (WHERE NOT inside) AS wl FROM wt GROUP BY 1, 2, 3)
SELECT area_id, way_id, idx, {places_sql('CASE WHEN flat IS NOT NULL THEN flat WHEN w > 0 THEN y + (wl / w - y) * least(1, w) ELSE y END', 5)} AS y FROM pu"""


def eased(points):
    """Road heights of ``points`` after junction clusters are flattened and eased."""
    points = cut_lineage(points)
    found = cut_lineage(J.junctions(points))
    anchored = J.anchors(points, found)
    levels = J.cluster_heights(found, J.cluster_edges(anchored))
    return J.ease_heights(points, anchored, levels).select("area_id", "way_id", "idx", places(F.col("y"), 5).alias("y"))


@topic.query(duck(f"WITH RECURSIVE {EASED_SQL}", *VIEWS))
def reconciled_roads(spark, sf_dir):
    """Road heights after junction clusters are flattened and eased."""
    return eased(grid_points(spark, sf_dir))


# The same roads at three tenths of their size: junctions pull their neighbours, and wide ones form clusters.
SMALL_SQL = EASED_SQL.replace("n.x, n.z, ", "n.x * 3 / 10e0 AS x, n.z * 3 / 10e0 AS z, ").replace(
    "x * 10 AS kx, z * 10 AS kz", "cast(floor(x * 10 + 0.5) AS bigint) AS kx, cast(floor(z * 10 + 0.5) AS bigint) AS kz"
)


@topic.query(duck(f"WITH RECURSIVE {SMALL_SQL}", *VIEWS))
def eased_roads(spark, sf_dir):
    """Road heights where junctions stand close together."""
    return eased(grid_points(spark, sf_dir).withColumns({c: F.col(c) * 3 / F.lit(10.0) for c in "xz"}))


MEMBER_SQL = f"""{POINT_SQL},
it AS (SELECT area_id, 'road' AS kind, concat('road:osm:way:', way_id) AS plan_id, concat('osm:way:', way_id) AS source_id, avg(x) AS x, avg(z) AS z FROM pt GROUP BY area_id, way_id
 UNION ALL SELECT area_id, 'building', concat('building:', source_id, ':0'), source_id, (5 * cx - half_x) / 5e0, (5 * cz - half_z) / 5e0 FROM v_buildings
 UNION ALL SELECT DISTINCT ky.area_id, 'junction', junction, concat('osm:way:', way_id), jk.x, jk.z FROM ky JOIN jk USING (area_id, layer, kx, kz)),
mb AS (SELECT DISTINCT area_id, cast(floor(x / 256) AS bigint) AS chunk_x, cast(floor(z / 256) AS bigint) AS chunk_z, kind, plan_id, source_id FROM it)"""


def plan_items(spark, sf_dir):
    """Roads, buildings and junctions with their centres."""
    points = cut_lineage(grid_points(spark, sf_dir))
    found = J.junctions(points)
    source = F.concat(F.lit("osm:way:"), F.col("way_id").cast("string"))
    roads = C.line_centers(points).select(
        "area_id", F.lit("road").alias("kind"), F.concat(F.lit("road:"), source).alias("plan_id"), source.alias("source_id"), "x", "z"
    )
    # The closing vertex counts, so a centre leans toward the first corner.
    houses = view(spark, sf_dir, "v_buildings").select(
        "area_id", F.lit("building").alias("kind"), F.concat(F.lit("building:"), F.col("source_id"), F.lit(":0")).alias("plan_id"),
        "source_id", ((5 * F.col("cx") - F.col("half_x")) / F.lit(5.0)).alias("x"), ((5 * F.col("cz") - F.col("half_z")) / F.lit(5.0)).alias("z"),
    )
    meets = J.junction_roads(points, found).join(found.select("area_id", "junction", "x", "z"), ["area_id", "junction"]).select(
        "area_id", F.lit("junction").alias("kind"), F.col("junction").alias("plan_id"), source.alias("source_id"), "x", "z"
    )
    return roads.unionByName(houses).unionByName(meets)


@topic.query(duck(f"WITH {MEMBER_SQL} SELECT * FROM mb", *VIEWS, "v_buildings"))
def chunk_members(spark, sf_dir):
    return C.membership(plan_items(spark, sf_dir))


@topic.query(duck(f"""
WITH {MEMBER_SQL}, k AS (SELECT area_id, chunk_x, chunk_z, count(DISTINCT plan_id) FILTER (WHERE kind = 'road') AS roads, count(DISTINCT plan_id) FILTER (WHERE kind = 'building') AS buildings,
 cast(0 AS bigint) AS areas, count(DISTINCT plan_id) FILTER (WHERE kind = 'junction') AS junctions, count(DISTINCT source_id) AS features FROM mb GROUP BY 1, 2, 3) SELECT * FROM k""", *VIEWS, "v_buildings"))
def chunks(spark, sf_dir):
    return C.chunk_summary(cut_lineage(C.membership(plan_items(spark, sf_dir))))


AFFECTED_SQL = f"""
cut AS (SELECT (min(ordinal) + max(ordinal)) // 2 AS c FROM v_overrides),
ow AS (SELECT area_id, target_id, arg_max(payload_value, ordinal) AS w FROM v_overrides, cut WHERE operation = 'set-width' AND ordinal < c GROUP BY 1, 2),
nw AS (SELECT area_id, target_id, arg_max(payload_value, ordinal) AS w FROM v_overrides WHERE operation = 'set-width' GROUP BY 1, 2),
ct AS (SELECT area_id, way_id, cast(floor(avg(x) / 256) AS bigint) AS chunk_x, cast(floor(avg(z) / 256) AS bigint) AS chunk_z FROM v_grid_nodes GROUP BY 1, 2),
ce AS (SELECT ct.*, t.source_id, ow.w AS w1, nw.w AS w2 FROM ct JOIN v_road_tags t USING (area_id, way_id) LEFT JOIN ow ON ow.area_id = ct.area_id AND ow.target_id = t.source_id LEFT JOIN nw ON nw.area_id = ct.area_id AND nw.target_id = t.source_id),
og AS (SELECT area_id, target_id, operation, arg_max(concat(coalesce(cast(payload_value AS varchar), 'n'), '|', payload_visible), ordinal) AS p FROM v_overrides, cut WHERE ordinal < c GROUP BY 1, 2, 3),
ng AS (SELECT area_id, target_id, operation, arg_max(concat(coalesce(cast(payload_value AS varchar), 'n'), '|', payload_visible), ordinal) AS p FROM v_overrides GROUP BY 1, 2, 3),
tg AS (SELECT DISTINCT ng.area_id, ng.target_id FROM ng LEFT JOIN og USING (area_id, target_id, operation) WHERE og.p IS DISTINCT FROM ng.p)"""


@topic.query(duck(f"""
WITH {AFFECTED_SQL.strip()} SELECT DISTINCT area_id, chunk_x, chunk_z FROM ce WHERE w1 IS DISTINCT FROM w2 OR EXISTS (SELECT 1 FROM tg WHERE tg.area_id = ce.area_id AND tg.target_id = ce.source_id)""", *VIEWS))
def affected_chunks(spark, sf_dir):
    """Chunks to rebuild when the second half of the override log is applied."""
    log = view(spark, sf_dir, "v_overrides")
    middle = log.agg(F.expr("(min(ordinal) + max(ordinal)) div 2").alias("cut")).first()["cut"]
    before = log.where(F.col("ordinal") < middle)
    centers = C.line_centers(view(spark, sf_dir, "v_grid_nodes"))
    tags = view(spark, sf_dir, "v_road_tags").select("area_id", "way_id", "source_id")
    roads = cut_lineage(C.with_chunk(centers.join(tags, ["area_id", "way_id"])))
    content = lambda overrides: C.signatures(
        O.apply_values(roads, overrides).drop("set_height"), C.CHUNK_KEY, ["source_id", "x", "z", "set_width"]
    )
    targets = O.changed_targets(before, log, ["payload_value", "payload_visible"])
    return C.affected_chunks(roads, roads, content(before), content(log), targets)


@topic.query(duck(f"""
WITH {POINT_SQL},
rd AS (SELECT DISTINCT ky.area_id, jk.junction, jk.x AS jx, jk.z AS jz, jk.radius, way_id, CASE WHEN way_id % 4 <> 0 THEN concat('Street ', way_id % 7) END AS name FROM ky JOIN jk USING (area_id, layer, kx, kz) WHERE roads > 1),
nm AS (SELECT area_id, junction, any_value(jx) AS jx, any_value(jz) AS jz, any_value(radius) AS radius, string_agg(DISTINCT name, ',' ORDER BY name) AS names, count(DISTINCT name) AS n, count(*) FILTER (WHERE name IS NULL) AS un FROM rd GROUP BY 1, 2),
ok AS (SELECT * FROM nm WHERE n > 0 AND NOT (n = 1 AND un = 0)),
nb AS (SELECT ky.*, jk.junction, lag(ky.x) OVER w AS px, lag(ky.z) OVER w AS pz, lead(ky.x) OVER w AS nx, lead(ky.z) OVER w AS nz FROM ky LEFT JOIN jk USING (area_id, layer, kx, kz) WINDOW w AS (PARTITION BY ky.area_id, way_id ORDER BY idx)),
ag AS (SELECT DISTINCT area_id, junction, angle FROM (SELECT area_id, junction, atan2(cast(pz - z AS double), cast(px - x AS double)) AS angle FROM nb WHERE px IS NOT NULL AND (px <> x OR pz <> z) UNION ALL SELECT area_id, junction, atan2(cast(nz - z AS double), cast(nx - x AS double)) FROM nb WHERE nx IS NOT NULL AND (nx <> x OR nz <> z)) WHERE junction IS NOT NULL),
gp AS (SELECT *, coalesce(lead(angle) OVER w, first_value(angle) OVER w + 2 * pi()) - angle AS gap FROM ag WINDOW w AS (PARTITION BY area_id, junction ORDER BY angle)),
wd AS (SELECT area_id, junction, gap, angle + gap / 2 AS direction FROM gp QUALIFY row_number() OVER (PARTITION BY area_id, junction ORDER BY gap DESC, angle) = 1),
po AS (SELECT ok.*, coalesce(direction, pi() / 4) AS dir, (radius + 1) / greatest(0.3, sin(least(pi(), coalesce(gap, 0)) / 2)) AS away FROM ok LEFT JOIN wd USING (area_id, junction))
SELECT area_id, junction, round(jx + cos(dir) * away, 4) AS x, round(jz + sin(dir) * away, 4) AS z, names FROM po""", *VIEWS))
def road_signs(spark, sf_dir):
    points = cut_lineage(grid_points(spark, sf_dir))
    found = cut_lineage(J.junctions(points).where("shared"))
    bridge = J.junction_roads(points, found)
    named = bridge.withColumn(
        "name", F.when(F.col("way_id") % 4 != 0, F.concat(F.lit("Street "), (F.col("way_id") % 7).cast("string")))
    )
    gaps = J.widest_gap(J.approach_angles(points, found, bridge))
    posts = J.sign_posts(found, J.sign_names(named), gaps)
    return posts.select(
        "area_id", "junction", F.round("x", 4).alias("x"), F.round("z", 4).alias("z"), F.array_join("names", ",").alias("names")
    )
