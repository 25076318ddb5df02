"""Elevation grids and what is draped on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapweave.derived import duck, places_sql, view
from mapweave.functions import measure as M
from mapweave.functions.text import places
from mapweave.operators import elevation as E
from mapweave.operators import lines as L
from mapweave.operators.ordered import TASK_ROWS, hot_keys, key_sizes, spread
from mapweave.registry.catalog import Topic
from mapweave.registry.features import BRIDGE_SQL, LAYER_SQL, TUNNEL_SQL
from mapweave.registry.lines import DENSE_SQL, dense_points
from mapweave.session import cut_lineage

topic = Topic()

DRAPED_ROWS = 50_000  # nodes in a task; each becomes many points, which are sorted in memory


def dem(spark, sf_dir):
    return view(spark, sf_dir, "v_dem").withColumnRenamed("r", "row").withColumnRenamed("c", "col")


def dem_header(grid):
    """Grids lie over the two-kilometre square of each area, in metres east and north."""
    side = {"west": -1000.0, "east": 1000.0, "south": -1000.0, "north": 1000.0}
    return E.summary(grid).withColumns({k: F.lit(v) for k, v in side.items()})


def filled_dem(spark, sf_dir):
    return E.rounded(E.fill_gaps(dem(spark, sf_dir)))


FILL_CTES = """
fw AS (SELECT area_id, r, c, round(coalesce(last_value(height IGNORE NULLS) OVER (PARTITION BY area_id ORDER BY r, c), avg(height) OVER (PARTITION BY area_id)), 3) AS height FROM v_dem),
hd AS (SELECT area_id, max(r) + 1 AS nr, max(c) + 1 AS nc, min(height) AS lo FROM fw GROUP BY 1)"""


def sample_sql(source: str, x: str = "x", z: str = "z", keep: str = "") -> str:
    """SQL steps ending in ``sampled`` with ``g`` for points of ``source``."""
    return f"""
l0 AS (SELECT p.*, hd.nr, hd.nc, lo, (greatest(-1000e0, least(1000e0, {x})) + 1000e0) / 2000e0 * (nc - 1) AS fc,
  (greatest(-1000e0, least(1000e0, -({z}))) + 1000e0) / 2000e0 * (nr - 1) AS fr FROM {source} p JOIN hd USING (area_id)),
l1 AS (SELECT *, cast(floor(fc) AS int) AS c0, cast(floor(fr) AS int) AS r0, fc - floor(fc) AS tx, fr - floor(fr) AS ty FROM l0),
sampled AS (SELECT l1.*, (coalesce(a.height, lo) * (1 - tx) + coalesce(b.height, lo) * tx) * (1 - ty) + (coalesce(c.height, lo) * (1 - tx) + coalesce(d.height, lo) * tx) * ty AS g
 FROM l1 LEFT JOIN fw a ON a.area_id = l1.area_id AND a.r = r0 AND a.c = c0 LEFT JOIN fw b ON b.area_id = l1.area_id AND b.r = r0 AND b.c = c0 + 1
 LEFT JOIN fw c ON c.area_id = l1.area_id AND c.r = r0 + 1 AND c.c = c0 LEFT JOIN fw d ON d.area_id = l1.area_id AND d.r = r0 + 1 AND d.c = c0 + 1)"""


@topic.query(duck(f"WITH {FILL_CTES.strip()} SELECT area_id, r AS row, c AS col, height FROM fw", "v_dem"))
def dem_filled(spark, sf_dir):
    return filled_dem(spark, sf_dir).select("area_id", "row", "col", "height")


@topic.query(duck("""
SELECT area_id, count(*) AS cells, count(*) FILTER (WHERE height IS NULL) AS missing,
 round(count(*) FILTER (WHERE height IS NULL) / count(*), 6) AS missing_share, count(*) FILTER (WHERE height IS NULL) / count(*) > 0.25 AS flat
FROM v_dem GROUP BY 1""", "v_dem"))
def dem_coverage(spark, sf_dir):
    return E.coverage(dem(spark, sf_dir)).withColumn("missing_share", F.round("missing_share", 6))


@topic.query(duck(f"""
WITH {FILL_CTES.strip()} SELECT area_id, max(r) + 1 AS rows, max(c) + 1 AS columns, min(height) AS min_height, max(height) AS max_height, round(max(height) - min(height), 3) AS relief FROM fw GROUP BY 1""", "v_dem"))
def dem_summary(spark, sf_dir):
    return E.summary(filled_dem(spark, sf_dir)).withColumn(
        "relief", F.round(F.col("max_height") - F.col("min_height"), 3)
    )


@topic.query(duck(f"""
WITH {FILL_CTES.strip()}, {sample_sql('v_buildings', 'cx', 'cz').strip()} SELECT area_id, source_id, round(g, 6) AS height FROM sampled""",
    "v_dem", "v_buildings"))
def dem_sample(spark, sf_dir):
    grid = filled_dem(spark, sf_dir)
    points = view(spark, sf_dir, "v_buildings").select(
        "area_id", "source_id", F.col("cx").alias("lon"), (-F.col("cz")).alias("lat")
    )
    return E.sample(points, grid, dem_header(grid)).select("area_id", "source_id", F.round("height", 6).alias("height"))


def building_corners(spark, sf_dir):
    """Closed rings of the rectangular buildings, one row per vertex."""
    corners = F.array(*[
        F.struct((F.col("cx") + sx * F.col("half_x")).alias("x"), (F.col("cz") + sz * F.col("half_z")).alias("z"))
        for sx, sz in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))
    ])
    return view(spark, sf_dir, "v_buildings").withColumn("ring", corners)


CORNER_SQL = """
vt AS (SELECT area_id, source_id, cx + half_x * sx AS x, cz + half_z * sz AS z FROM v_buildings,
  (VALUES (-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)) AS k(sx, sz))"""


@topic.query(duck(f"""
WITH {FILL_CTES.strip()}, {CORNER_SQL.strip()}, {sample_sql('vt').strip()}
SELECT area_id, source_id, round(list_sort(list(g))[len(list(g)) // 2 + 1], 6) AS base_height FROM sampled GROUP BY 1, 2""",
    "v_dem", "v_buildings"))
def building_base(spark, sf_dir):
    grid = filled_dem(spark, sf_dir)
    vertices = building_corners(spark, sf_dir).select("area_id", "source_id", F.explode("ring").alias("p")).select(
        "area_id", "source_id", F.col("p.x").alias("lon"), (-F.col("p.z")).alias("lat")
    )
    heights = E.sample(vertices, grid, dem_header(grid))
    return E.base_heights(heights, ["source_id"]).withColumn("base_height", F.round("base_height", 6))


DRAPED_SQL = f"""
{DENSE_SQL.strip()},
{FILL_CTES.strip()},
{sample_sql('dense').strip()},
y0 AS (SELECT area_id, way_id, idx, x, z, g + 0.1 AS y FROM sampled),
y1 AS (SELECT * REPLACE (coalesce(lag(y) OVER w * 0.25 + y * 0.5 + lead(y) OVER w * 0.25, y) AS y) FROM y0 WINDOW w AS (PARTITION BY area_id, way_id ORDER BY idx)),
y2 AS (SELECT * REPLACE (coalesce(lag(y) OVER w * 0.25 + y * 0.5 + lead(y) OVER w * 0.25, y) AS y) FROM y1 WINDOW w AS (PARTITION BY area_id, way_id ORDER BY idx)),
st AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (z - lag(z) OVER w) * (z - lag(z) OVER w)), 0) AS step FROM y2 WINDOW w AS (PARTITION BY area_id, way_id ORDER BY idx)),
al AS (SELECT *, sum(step) OVER (PARTITION BY area_id, way_id ORDER BY idx) / greatest(1, sum(step) OVER (PARTITION BY area_id, way_id)) AS progress FROM st),
lv AS (SELECT area_id, way_id, {LAYER_SQL} AS layer, {BRIDGE_SQL} AS bridge, {TUNNEL_SQL} AS tunnel FROM v_road_tags),
draped AS (SELECT al.area_id, al.way_id, idx, x, z, layer, bridge, tunnel, y + CASE WHEN bridge THEN sin(progress * pi()) * greatest(3, abs(layer) * 3) WHEN tunnel THEN -sin(progress * pi()) * greatest(3, abs(layer) * 3) ELSE layer * 3 END AS y
  FROM al JOIN lv USING (area_id, way_id))"""


def road_structure(spark, sf_dir):
    return view(spark, sf_dir, "v_road_tags").select(
        "area_id", "way_id", M.road_layer(F.col("layer")).alias("layer"), M.loose_flag(F.col("bridge")).alias("bridge"),
        M.loose_flag(F.col("tunnel")).alias("tunnel"),
    )


def draped(spark, sf_dir):
    """Densified roads on the filled grid, smoothed and lifted by layer."""
    from mapweave.plans.world import drape_roads

    nodes = view(spark, sf_dir, "v_way_nodes")
    grid = filled_dem(spark, sf_dir)
    total, most = key_sizes(nodes, L.KEYS)
    block = hot_keys(nodes, L.KEYS) if most > TASK_ROWS else None
    return drape_roads(spread(nodes, L.KEYS, DRAPED_ROWS, total), road_structure(spark, sf_dir), grid, dem_header(grid), block)


@topic.query(duck(f"""
WITH {DRAPED_SQL.strip()} SELECT area_id, way_id, idx, {places_sql('x', 4)} AS x, {places_sql('y', 4)} AS y, {places_sql('z', 4)} AS z FROM draped""",
    "v_way_nodes", "v_dem", "v_road_tags"))
def draped_roads(spark, sf_dir):
    return draped(spark, sf_dir).select(
        "area_id", "way_id", "idx", *[places(F.col(c), 4).alias(c) for c in "xyz"]
    )


@topic.query(duck(f"""
WITH {DRAPED_SQL.strip()},
ng AS (SELECT area_id, way_id, lead(y) OVER w - y AS dy, sqrt((lead(x) OVER w - x) * (lead(x) OVER w - x) + (lead(z) OVER w - z) * (lead(z) OVER w - z)) AS run FROM draped WINDOW w AS (PARTITION BY area_id, way_id ORDER BY idx))
SELECT area_id, way_id, {places_sql('coalesce(max(CASE WHEN run > 0 THEN abs(dy) / run END), 0) * 100', 4)} AS max_grade FROM ng WHERE dy IS NOT NULL GROUP BY 1, 2""",
    "v_way_nodes", "v_dem", "v_road_tags"))
def draped_grades(spark, sf_dir):
    parts = L.segments(draped(spark, sf_dir), height=True)
    return L.maximum_grade(parts).withColumn("max_grade", places(F.col("max_grade"), 4))


@topic.query(duck("""
SELECT area_id, vec AS vec_id, cast(count(*) AS bigint) AS cells, count(*) FILTER (WHERE height IS NULL) AS missing
FROM (SELECT area_id, r * 8 + area_id AS vec, height FROM v_dem) GROUP BY 1, 2""", "v_dem"))
def dem_sample_text(spark, sf_dir):
    """Sample text batches merged onto the lattice of their area."""
    text = dem(spark, sf_dir).select(
        "area_id", (F.col("row") * 64 + F.col("col")).alias("idx"),
        F.coalesce(F.concat(F.col("height").cast("string"), F.lit(",0")), F.lit("NoData")).alias("value"),
    )
    size = E.summary(dem(spark, sf_dir)).select(
        "area_id", "rows", "columns", *[F.lit(v).alias(k) for k, v in
                                        (("west", -75.01), ("south", 39.99), ("east", -74.99), ("north", 40.01))]
    )
    merged = E.merge_samples(E.lattice(size), text)
    return merged.groupBy("area_id", (F.col("row") * 8 + F.col("area_id")).alias("vec_id")).agg(
        F.count("*").alias("cells"), F.count_if(F.col("height").isNull()).alias("missing")
    )


@topic.query(duck(f"""
WITH {FILL_CTES.strip()}
SELECT fw.area_id, r AS row, c AS col, {places_sql('-75.01 + (-74.99 + 75.01) * c / (nc - 1)', 7)} AS lon, {places_sql('39.99 + (40.01 - 39.99) * r / (nr - 1)', 7)} AS lat, fw.height FROM fw JOIN hd USING (area_id)""", "v_dem"))
def elevation_snapshot(spark, sf_dir):
    """Positions and heights of each area's grid, from sample texts with gaps and texts that are no numbers."""
    grid = cut_lineage(dem(spark, sf_dir))
    bad = F.when(F.col("col") % 2 == 0, "NoData").when(F.col("col") % 3 == 0, "nan").otherwise("Infinity,1")
    text = grid.select(
        "area_id", (F.col("row") * 64 + F.col("col")).alias("idx"), F.coalesce(F.concat(F.col("height").cast("string"), F.lit(",0")), bad).alias("value"),
    )
    sides = (("west", -75.01), ("south", 39.99), ("east", -74.99), ("north", 40.01))
    size = E.summary(grid).select("area_id", "rows", "columns", *[F.lit(v).alias(k) for k, v in sides])
    merged = cut_lineage(E.merge_samples(E.lattice(size), text))
    filled = E.rounded(E.fill_gaps(merged.select("area_id", "row", "col", "height")))
    return merged.select("area_id", "row", "col", "lon", "lat").join(filled, ["area_id", "row", "col"]).select(
        "area_id", "row", "col", places(F.col("lon"), 7).alias("lon"), places(F.col("lat"), 7).alias("lat"), "height"
    )
