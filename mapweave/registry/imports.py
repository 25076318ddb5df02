"""Raw elements of every shape through normalisation, diagnostics, snapshots and previews."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapweave.derived import duck, table, view
from mapweave.plans import imports as P
from mapweave.plans.normalize import import_diagnostics as diagnose
from mapweave.plans.normalize import normalize
from mapweave.registry.catalog import Topic
from mapweave.registry.features import measure_sql
from mapweave.schemas import ELEMENT

topic = Topic()

STEP = 1e-4
# Shapes of relations by part key: a hole, a second outer ring, or an outer line that does not close.
HOLE, SECOND, BROKEN = "p_partkey % 3 = 0", "p_partkey % 5 = 0", "p_partkey % 11 = 0"
# Closed and open ways of suppliers: key, value and number of points of each remainder of the key by six.
SHAPES = (
    ("landuse", "grass", 5), ("waterway", "stream", 5), ("waterway", "riverbank", 5), ("barrier", "fence", 2), ("highway", "service", 1),
    ("amenity", "cafe", 5),
)


def square(lon, lat, half):
    """Corners of a closed square, from the lower left."""
    return [F.struct((lat + b * half).alias("lat"), (lon + a * half).alias("lon")) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]


def elements(spark, sf_dir):
    """Ways from line items, relations from parts, other ways from suppliers, nodes from customers; as documents hold them."""
    tagged = lambda **named: F.map_filter(
        F.create_map(*[c for key, value in named.items() for c in (F.lit(key.replace("__", ":")), value)]), lambda _, v: v.isNotNull()
    )
    element = lambda **own: F.struct(*[
        own.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in (
            (f.name, f.dataType) for f in spark.createDataFrame([], f"e {ELEMENT}").schema["e"].dataType.fields)
    ])
    road_tags = view(spark, sf_dir, "v_road_tags")
    named = ("highway", "lanes", "width", "layer", "bridge", "tunnel", "access")
    lines = view(spark, sf_dir, "v_nodes_ll").groupBy("area_id", "way_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", "lat", "lon"))).alias("_p")
    ).join(road_tags.select("area_id", "way_id", tagged(**{n: F.col(n) for n in named}).alias("_t")), ["area_id", "way_id"])
    ways = lines.select("area_id", F.col("way_id").alias("position"), element(
        type=F.lit("way"), id=F.col("way_id"), version=F.lit(1), tags=F.col("_t"),
        geometry=F.transform("_p", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))),
    ).alias("e"))
    part = table(spark, sf_dir, "part").withColumns({"lon": -75.0 + F.col("p_partkey") * STEP, "lat": F.lit(41.0)})
    ring = square(F.col("lon"), F.col("lat"), STEP / 4)
    member = lambda role, points: F.struct(F.lit("way").alias("type"), F.lit(1).cast("long").alias("ref"), F.lit(role).alias("role"), F.array(*points).alias("geometry"))
    none = F.slice(F.array(member("outer", ring)), 1, 0)
    members = F.concat(
        F.array(member("outer", ring[:3])), F.when(F.expr(BROKEN), none).otherwise(F.array(member("outer", ring[2:]))),
        F.when(F.expr(HOLE), F.array(member("inner", square(F.col("lon"), F.col("lat"), STEP / 8)))).otherwise(none),
        F.when(F.expr(SECOND), F.array(member("outer", square(F.col("lon") + 1, F.col("lat"), STEP / 4)))).otherwise(none),
    )
    relations = part.select((F.col("p_partkey") % 8).alias("area_id"), (F.col("p_partkey") + 10_000_000).alias("position"), element(
        type=F.lit("relation"), id=F.col("p_partkey"), version=F.lit(2), members=members,
        tags=tagged(building=F.lit("yes"), height=F.when(F.col("p_size") % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" m"))),
                    building__levels=F.when(F.col("p_size") % 4 == 0, F.lit("3"))),
    ).alias("e"))
    supplier = table(spark, sf_dir, "supplier").withColumns({"lon": -74.0 + F.col("s_suppkey") * STEP, "lat": F.lit(40.5), "_n": F.col("s_suppkey") % len(SHAPES)})
    pick = lambda n: F.element_at(F.array(*[F.lit(s[n]) for s in SHAPES]), (F.col("_n") + 1).cast("int"))
    shapes = supplier.select((F.col("s_suppkey") % 8).alias("area_id"), (F.col("s_suppkey") + 20_000_000).alias("position"), element(
        type=F.lit("way"), id=F.col("s_suppkey") + 20_000_000, tags=F.create_map(pick(0), pick(1)),
        geometry=F.slice(F.array(*square(F.col("lon"), F.col("lat"), STEP / 4)), F.lit(1), pick(2)),
    ).alias("e"))
    nodes = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 8).alias("area_id"), (F.col("c_custkey") + 30_000_000).alias("position"), element(
        type=F.lit("node"), id=F.col("c_custkey"), lat=F.lit(40.25), lon=-75.0 + F.col("c_custkey") * STEP,
        tags=F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("natural"), F.lit("tree"))),
    ).alias("e"))
    every = ways.unionByName(relations).unionByName(shapes).unionByName(nodes)
    return every.select("area_id", "position", "e.*")


_SHAPE_ROWS = ", ".join(f"({n}, '{k}', '{v}', {p})" for n, (k, v, p) in enumerate(SHAPES))
# Every element of interest: whether it has a shape, and what that shape is.
ELEMENT_SQL = f"""
WITH wl AS (SELECT area_id, way_id, count(*) AS n FROM v_nodes_ll GROUP BY 1, 2),
wt AS (SELECT t.*, n, {measure_sql('t.width')} AS width_m, {measure_sql('t.lanes')} AS lanes_n FROM v_road_tags t JOIN wl USING (area_id, way_id)),
pb AS (SELECT *, 1 + ({HOLE})::int + ({SECOND})::int AS nr FROM part),
sh AS (SELECT s_suppkey, k, v, p FROM supplier JOIN (VALUES {_SHAPE_ROWS}) t(n, k, v, p) ON s_suppkey % {len(SHAPES)} = n),
el AS (SELECT area_id, source_id, 'way' AS source_type, 'road' AS kind, CASE WHEN n > 1 THEN 'LineString' END AS shape, 1 AS rings, n AS points,
  1 + (lanes IS NOT NULL)::int + (width IS NOT NULL)::int + (layer IS NOT NULL)::int + (bridge IS NOT NULL)::int + (tunnel IS NOT NULL)::int + (access IS NOT NULL)::int AS n_tags,
  NULL::double AS height, width_m AS width, lanes_n AS lanes, bridge = 'yes' AS bridge, 0 AS warnings FROM wt
 UNION ALL SELECT p_partkey % 8, concat('osm:relation:', p_partkey), 'relation', 'building',
  CASE WHEN {BROKEN} AND {SECOND} THEN 'Polygon' WHEN {BROKEN} THEN NULL WHEN {SECOND} THEN 'MultiPolygon' ELSE 'Polygon' END,
  CASE WHEN {BROKEN} THEN 1 ELSE nr END, 5 * CASE WHEN {BROKEN} THEN 1 ELSE nr END, 1 + (p_size % 3 = 0)::int + (p_size % 4 = 0)::int,
  CASE WHEN p_size % 3 = 0 THEN p_size::double END, NULL, NULL, false, (p_size % 3 <> 0 AND p_size % 4 <> 0)::int FROM pb
 UNION ALL SELECT s_suppkey % 8, concat('osm:way:', s_suppkey + 20000000), 'way',
  CASE k WHEN 'landuse' THEN 'land' WHEN 'waterway' THEN 'water' WHEN 'barrier' THEN 'barrier' ELSE 'road' END,
  CASE WHEN p < 2 THEN NULL WHEN p = 5 AND v <> 'stream' THEN 'Polygon' ELSE 'LineString' END, 1, p, 1, NULL, NULL, NULL, false, 0 FROM sh WHERE k <> 'amenity'
 UNION ALL SELECT c_custkey % 8, concat('osm:node:', c_custkey), 'node', 'land', 'Point', 1, 1, 1, NULL, NULL, NULL, false, 0 FROM customer WHERE c_custkey % 2 = 0)"""
NEEDS = ("v_way_nodes", "v_nodes_ll", "v_road_tags")


@topic.query(duck(f"""{ELEMENT_SQL}
SELECT area_id, source_id, source_type, kind, shape, cast(rings AS bigint) AS rings, cast(points AS bigint) AS points, cast(n_tags AS int) AS n_tags, round(height, 6) AS height,
 round(width, 6) AS width, round(lanes, 6) AS lanes, coalesce(bridge, false) AS bridge, cast(warnings AS int) AS warnings FROM el WHERE shape IS NOT NULL""", *NEEDS))
def normalized_features(spark, sf_dir):
    """Kind, shape, facts and warnings of every usable element."""
    features, _ = normalize(elements(spark, sf_dir))
    rings = F.flatten("geometry.polygons")
    return features.select(
        "area_id", "source_id", "source_type", "kind", F.col("geometry.type").alias("shape"), F.size(rings).cast("long").alias("rings"),
        F.aggregate(rings, F.lit(0), lambda n, r: n + F.size(r)).cast("long").alias("points"), F.size("tags").alias("n_tags"),
        *[F.round(f"facts.{c}", 6).alias(c) for c in ("height", "width", "lanes")], F.coalesce("facts.bridge", F.lit(False)).alias("bridge"),
        F.size("warnings").alias("warnings"),
    )


@topic.query(duck(f"""{ELEMENT_SQL}
SELECT area_id, 'OSM_GEOMETRY_UNUSABLE' AS code, 'warning' AS severity, source_id FROM el WHERE shape IS NULL
UNION ALL SELECT n_nationkey, 'NO_ROADS_FOUND', 'error', NULL FROM nation WHERE n_nationkey NOT IN (SELECT area_id FROM el WHERE kind = 'road' AND shape IS NOT NULL)""", *NEEDS))
def import_diagnostics(spark, sf_dir):
    """Unusable elements, and areas (here one per nation) without any road."""
    features, rejected = normalize(elements(spark, sf_dir))
    areas = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("area_id"))
    return diagnose(areas, features, rejected).select("area_id", "code", "severity", "source_id")


def imported(spark, sf_dir):
    """Snapshots and keyed features of the eight areas that the elements fill."""
    areas = table(spark, sf_dir, "nation").where("n_nationkey < 8").select(
        F.col("n_nationkey").cast("long").alias("area_id"), F.lit(-76.0).alias("west"), F.lit(39.0).alias("south"), F.lit(-73.0).alias("east"), F.lit(42.0).alias("north")
    )
    header = areas.select("area_id", F.sha2(F.col("area_id").cast("string"), 256).alias("content_hash"))
    return P.import_snapshot(areas, elements(spark, sf_dir), header, "public", "2024-01-01 00:00:00")


@topic.query(duck(f"""{ELEMENT_SQL}
SELECT area_id, count(*) AS features, count(DISTINCT source_id) AS sources, 1 AS snapshots, true AS hashed FROM el WHERE shape IS NOT NULL GROUP BY 1""", *NEEDS))
def snapshot_rows(spark, sf_dir):
    """Features filed under each area's one snapshot, which is named by a content hash."""
    snapshots, features, _ = imported(spark, sf_dir)
    named = snapshots.groupBy("area_id").agg(
        F.countDistinct("snapshot_id").cast("int").alias("snapshots"), (F.min(F.length("content_hash")) == 64).alias("hashed")
    )
    counted = features.groupBy("area_id").agg(F.count("*").alias("features"), F.countDistinct("source_id").alias("sources"))
    return counted.join(named, "area_id").select("area_id", "features", "sources", "snapshots", "hashed")


@topic.query(duck(f"""{ELEMENT_SQL}
SELECT area_id, count(*) FILTER (WHERE kind = 'road') AS roads, count(*) FILTER (WHERE kind = 'building') AS buildings, count(*) FILTER (WHERE kind = 'land') AS land,
 count(*) FILTER (WHERE kind = 'water') AS water, count(*) FILTER (WHERE kind = 'barrier') AS barriers, count(*) FILTER (WHERE warnings > 0) AS estimated_heights
FROM el WHERE shape IS NOT NULL GROUP BY 1""", *NEEDS))
def preview_report(spark, sf_dir):
    """Counts by kind and estimated heights of each imported snapshot."""
    snapshots, features, _ = imported(spark, sf_dir)
    return P.preview(features).join(snapshots.select("area_id", "snapshot_id"), "snapshot_id").drop("snapshot_id")
