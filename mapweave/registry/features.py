"""Tags, measurements, estimates and overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.derived import duck, view
from mapweave.functions import appearance as looks
from mapweave.functions import measure as M
from mapweave.operators import overrides as O
from mapweave.registry.catalog import Topic

topic = Topic()

# SQL text for one measurement, shared by the comparison queries.
def measure_sql(column: str) -> str:
    text = f"lower(trim({column}))"
    feet = r"""'^(\d+(?:\.\d+)?)''\s*(\d+(?:\.\d+)?)?"?$'"""
    metres = r"'^(-?\d+(?:[.,]\d+)?)\s*(m|meter|meters)?$'"
    return (
        f"coalesce(CASE WHEN regexp_matches({text}, {feet}) THEN "
        f"cast(regexp_extract({text}, {feet}, 1) AS double) * 0.3048 + "
        f"coalesce(try_cast(nullif(regexp_extract({text}, {feet}, 2), '') AS double), 0) * 0.0254 END, "
        f"try_cast(replace(nullif(regexp_extract({text}, {metres}, 1), ''), ',', '.') AS double))"
    )


CLASS_SQL = (
    "CASE coalesce(highway, 'unclassified') "
    + " ".join(f"WHEN '{k}' THEN {v}" for k, v in M.ROAD_CLASS_WIDTHS.items()) + " ELSE 5.0 END"
)
IMAGERY_SQL = (
    "CASE coalesce(highway, 'unclassified') "
    + " ".join(f"WHEN '{k}' THEN {v}" for k, v in M.IMAGERY_CLASS_WIDTHS.items()) + " ELSE 5.0 END"
)
WIDTH_CTES = f"""
last_width AS (SELECT area_id, target_id, arg_max(payload_value, ordinal) AS w FROM v_overrides
  WHERE operation = 'set-width' GROUP BY 1, 2),
parsed AS (SELECT t.*, {measure_sql('t.width')} AS width_m, {measure_sql('t.lanes')} AS lanes_n, o.w
  FROM v_road_tags t LEFT JOIN last_width o ON o.area_id = t.area_id AND o.target_id = t.source_id),
widths AS (SELECT area_id, way_id, source_id, highway, layer, bridge, tunnel, access,
  CASE WHEN w > 0 THEN w WHEN width_m > 0 THEN width_m WHEN lanes_n > 0 THEN greatest(3.0, lanes_n * 3.2) ELSE {CLASS_SQL} END AS road_width,
  CASE WHEN w > 0 THEN 'override' WHEN width_m > 0 THEN 'source' WHEN lanes_n > 0 THEN 'lanes' ELSE 'class' END AS width_source
  FROM parsed)"""
LAYER_SQL = (
    "CASE WHEN try_cast(layer AS double) IS NULL THEN 0e0 ELSE greatest(-5e0, least(5e0, try_cast(layer AS double))) END"
)
BRIDGE_SQL = "(bridge IS NOT NULL AND bridge NOT IN ('', 'no', 'false', '0'))"
TUNNEL_SQL = "(tunnel IS NOT NULL AND tunnel NOT IN ('', 'no', 'false', '0'))"


def road_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Road tags with the estimated width and its source, overrides included."""
    tags = O.apply_values(view(spark, sf_dir, "v_road_tags"), view(spark, sf_dir, "v_overrides"))
    estimate = M.width_estimate(
        F.col("set_width"), M.parse_measure(F.col("width")), M.parse_measure(F.col("lanes")), F.col("highway")
    )
    return tags.withColumn("_estimate", estimate).select(
        "area_id", "way_id", "source_id", "highway", "layer", "bridge", "tunnel", "access",
        F.col("_estimate.width").alias("road_width"), "_estimate.width_source",
    )


def building_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings with parsed facts and the estimated height."""
    parsed = view(spark, sf_dir, "v_buildings").withColumns({
        "height_m": M.parse_measure(F.col("height")), "levels_n": M.parse_measure(F.col("levels")),
    })
    estimate = M.height_estimate(
        F.lit(None).cast("double"), F.col("height_m"), F.col("levels_n"), F.lit(3.0), F.lit(8.0)
    )
    return parsed.withColumn("_estimate", estimate).select(
        "area_id", "source_id", "cx", "cz", "half_x", "half_z", "height", "levels", "height_m", "levels_n",
        F.col("_estimate.height").alias("building_height"), "_estimate.height_source",
    )


HEIGHT_CTES = f"""
parsed AS (SELECT *, {measure_sql('height')} AS height_m, {measure_sql('levels')} AS levels_n FROM v_buildings),
heights AS (SELECT *, cast(CASE WHEN height_m > 0 THEN height_m WHEN levels_n > 0 THEN levels_n * 3.0 ELSE 8.0 END AS double) AS building_height,
  CASE WHEN height_m > 0 THEN 'source' WHEN levels_n > 0 THEN 'levels' ELSE 'fallback' END AS height_source FROM parsed)"""


@topic.query(duck(f"""
WITH {HEIGHT_CTES.strip()},
f AS (SELECT area_id, 'building' AS kind, building_height AS h, height_source AS src, height_m, levels_n FROM heights
 UNION ALL SELECT area_id, 'road', NULL, NULL, NULL, NULL FROM v_road_tags)
SELECT area_id, kind, count(*) AS features, count(*) FILTER (WHERE kind = 'building' AND height_m IS NULL AND levels_n IS NULL) AS estimated_heights,
 count(*) FILTER (WHERE src = 'source') AS from_source, count(*) FILTER (WHERE src = 'levels') AS from_levels,
 round(sum(h), 4) AS total_height FROM f GROUP BY 1, 2""", "v_buildings", "v_road_tags"))
def feature_stats(spark, sf_dir):
    buildings = building_heights(spark, sf_dir).select(
        "area_id", F.lit("building").alias("kind"), F.col("building_height").alias("h"), "height_source",
        (F.col("height_m").isNull() & F.col("levels_n").isNull()).alias("estimated"),
    )
    roads = view(spark, sf_dir, "v_road_tags").select("area_id", F.lit("road").alias("kind"))
    return buildings.unionByName(roads, allowMissingColumns=True).groupBy("area_id", "kind").agg(
        F.count("*").alias("features"), F.count_if("estimated").alias("estimated_heights"),
        F.count_if(F.col("height_source") == "source").alias("from_source"),
        F.count_if(F.col("height_source") == "levels").alias("from_levels"),
        F.round(F.sum("h"), 4).alias("total_height"),
    )


@topic.query(duck(f"""
SELECT source_id, 'width' AS field, round({measure_sql('width')}, 6) AS metres FROM v_road_tags
UNION ALL SELECT source_id, 'height', round({measure_sql('height')}, 6) FROM v_buildings
UNION ALL SELECT source_id, 'levels', round({measure_sql('levels')}, 6) FROM v_buildings
UNION ALL SELECT source_id, 'lanes', round({measure_sql('lanes')}, 6) FROM v_road_tags""", "v_road_tags", "v_buildings"))
def parse_measure(spark, sf_dir):
    roads, buildings = view(spark, sf_dir, "v_road_tags"), view(spark, sf_dir, "v_buildings")

    def parsed(df, fields):
        pairs = F.explode(F.array(*[
            F.struct(F.lit(f).alias("field"), F.round(M.parse_measure(F.col(f)), 6).alias("metres")) for f in fields
        ]))
        return df.select("source_id", pairs.alias("p")).select("source_id", "p.*")

    return parsed(roads, ("width", "lanes")).unionByName(parsed(buildings, ("height", "levels")))


@topic.query(duck(f"""
WITH {WIDTH_CTES.strip()} SELECT area_id, source_id, round(road_width, 6) AS width, width_source FROM widths""",
    "v_road_tags", "v_overrides"))
def width_provenance(spark, sf_dir):
    return road_widths(spark, sf_dir).select(
        "area_id", "source_id", F.round("road_width", 6).alias("width"), "width_source"
    )


@topic.query(duck(f"""
SELECT area_id, source_id, cast(CASE WHEN try_cast(width AS double) > 0 THEN try_cast(width AS double)
 WHEN try_cast(lanes AS double) > 0 THEN greatest(3.0, try_cast(lanes AS double) * 3.2) ELSE {IMAGERY_SQL} END AS double) AS width
FROM v_road_tags""", "v_road_tags"))
def imagery_road_widths(spark, sf_dir):
    return view(spark, sf_dir, "v_road_tags").select(
        "area_id", "source_id", M.imagery_width(F.col("width"), F.col("lanes"), F.col("highway")).alias("width")
    )


@topic.query(duck(f"""
WITH {HEIGHT_CTES.strip()}
SELECT area_id, source_id, round(building_height, 6) AS height, height_source,
 (height IS NULL AND levels IS NULL) AS tag_missing, (height_m IS NULL AND levels_n IS NULL) AS fact_missing FROM heights""",
    "v_buildings"))
def height_provenance(spark, sf_dir):
    return building_heights(spark, sf_dir).select(
        "area_id", "source_id", F.round("building_height", 6).alias("height"), "height_source",
        (M.present(F.col("height")).isNull() & M.present(F.col("levels")).isNull()).alias("tag_missing"),
        (F.col("height_m").isNull() & F.col("levels_n").isNull()).alias("fact_missing"),
    )


@topic.query(duck("""
SELECT t.area_id, t.source_id FROM v_road_tags t WHERE NOT EXISTS (SELECT 1 FROM v_overrides o
 WHERE o.area_id = t.area_id AND o.target_id = t.source_id AND o.operation = 'set-visible' AND NOT o.payload_visible)""",
    "v_road_tags", "v_overrides"))
def visible_features(spark, sf_dir):
    tags = view(spark, sf_dir, "v_road_tags").select("area_id", "source_id")
    return O.drop_hidden(tags, view(spark, sf_dir, "v_overrides"))


@topic.query(duck("""
SELECT DISTINCT area_id, target_id FROM v_overrides WHERE operation = 'set-visible' AND NOT payload_visible""", "v_overrides"))
def hidden_features(spark, sf_dir):
    return O.hidden_targets(view(spark, sf_dir, "v_overrides"))


@topic.query(duck("""
SELECT area_id, target_id, operation, max(ordinal) AS ordinal, arg_max(payload_value, ordinal) AS payload_value,
 arg_max(payload_visible, ordinal) AS payload_visible FROM v_overrides GROUP BY 1, 2, 3""", "v_overrides"))
def last_overrides(spark, sf_dir):
    return O.last_override(view(spark, sf_dir, "v_overrides"), "payload_value", "payload_visible")


@topic.query(duck(f"""
WITH {WIDTH_CTES.strip()} SELECT area_id, source_id, round(road_width, 6) AS width FROM widths
WHERE road_width >= 4.2 AND coalesce(highway, '') NOT IN ('cycleway', 'footway', 'path', 'pedestrian', 'steps', 'track')
 AND coalesce(access, '') NOT IN ('no', 'private')""", "v_road_tags", "v_overrides"))
def motor_network(spark, sf_dir):
    blank = F.lit(None).cast("string")
    return road_widths(spark, sf_dir).where(
        M.is_motor_road(F.col("road_width"), F.col("highway"), F.col("access"), blank, blank, blank)
    ).select("area_id", "source_id", F.round("road_width", 6).alias("width"))


@topic.query(duck(f"""
WITH s AS (SELECT area_id, source_id, {LAYER_SQL} AS layer, {BRIDGE_SQL} AS bridge, {TUNNEL_SQL} AS tunnel,
 bridge = 'yes' AS bridge_fact, tunnel = 'yes' AS tunnel_fact,
 highway IN ('path', 'footway', 'cycleway') AS minor FROM v_road_tags)
SELECT area_id, source_id, layer, bridge, tunnel, coalesce(bridge_fact, false) AS bridge_fact, coalesce(tunnel_fact, false) AS tunnel_fact,
 minor, NOT bridge AND NOT tunnel AND layer = 0 AS on_ground, NOT bridge AND (tunnel OR layer = 0) AS grades_terrain FROM s""",
    "v_road_tags"))
def road_levels(spark, sf_dir):
    level = view(spark, sf_dir, "v_road_tags").select(
        "area_id", "source_id", M.road_layer(F.col("layer")).alias("layer"), M.loose_flag(F.col("bridge")).alias("bridge"),
        M.loose_flag(F.col("tunnel")).alias("tunnel"), F.col("bridge").eqNullSafe("yes").alias("bridge_fact"),
        F.col("tunnel").eqNullSafe("yes").alias("tunnel_fact"), M.is_minor_path(F.col("highway")).alias("minor"),
    )
    structure = (F.col("layer"), F.col("bridge"), F.col("tunnel"))
    return level.withColumns({"on_ground": M.on_ground(*structure), "grades_terrain": M.grades_terrain(*structure)})


@topic.query(duck(f"""
WITH s AS (SELECT area_id, source_id, {LAYER_SQL} AS layer, {BRIDGE_SQL} AS bridge, {TUNNEL_SQL} AS tunnel FROM v_road_tags)
SELECT area_id, source_id, 'road.vertical-separation' AS code, 'info' AS severity FROM s WHERE bridge OR tunnel OR layer <> 0
UNION ALL SELECT area_id, source_id, 'BUILDING_HEIGHT_ESTIMATED', 'info' FROM v_buildings WHERE height IS NULL AND levels IS NULL""",
    "v_road_tags", "v_buildings"))
def diagnostics(spark, sf_dir):
    from mapweave.operators.diagnostics import explode_diagnostics, vertical_separation

    roads = view(spark, sf_dir, "v_road_tags").select(
        "area_id", "source_id", M.road_layer(F.col("layer")).alias("layer"), M.loose_flag(F.col("bridge")).alias("bridge"),
        M.loose_flag(F.col("tunnel")).alias("tunnel"),
    )
    missing = M.present(F.col("height")).isNull() & M.present(F.col("levels")).isNull()
    warning = M.diagnostic("BUILDING_HEIGHT_ESTIMATED", "info",
                           "Neither height nor levels are tagged; a default height applies.", F.col("source_id"))
    buildings = view(spark, sf_dir, "v_buildings").withColumn(
        "warnings", F.when(missing, F.array(warning))
    )
    return vertical_separation(roads).unionByName(explode_diagnostics(buildings)).select(
        "area_id", "source_id", "code", "severity"
    )


SEED_SQL = (
    "list_reduce(list_prepend(cast(0 AS bigint), list_transform(string_split(source_id, ''), lambda c: cast(ascii(c) AS bigint))),"
    " lambda s, c: (s * 31 + c) % 4294967296)"
)


@topic.query(duck(f"""
WITH {HEIGHT_CTES.strip()}, s AS (SELECT *, {SEED_SQL} AS seed FROM heights),
a AS (SELECT *, building_height <= 12 AS residential, CASE WHEN building_height <= 12 THEN CASE WHEN seed % 2 = 1 THEN 'gabled' ELSE 'hipped' END ELSE 'flat' END AS roof,
 CASE seed % 3 WHEN 0 THEN 'brick' WHEN 1 THEN 'siding' ELSE 'stucco' END AS finish FROM s),
b AS (SELECT *, CASE WHEN roof = 'flat' THEN 0.0 ELSE least(building_height * 0.4, greatest(0.0, building_height - 2.6), 1.8 + (seed % 8) / 10.0) END AS rise FROM a)
SELECT area_id, source_id, roof, round(cast(rise AS double), 6) AS rise, finish, residential, round(cast(building_height - rise AS double), 6) AS eaves,
 CASE WHEN finish = 'brick' THEN '#a97964' ELSE CASE seed % 3 WHEN 1 THEN '#bbc6bc' ELSE '#d7d4c8' END END AS wall_color,
 CASE seed % 3 WHEN 0 THEN '#514d48' WHEN 1 THEN '#655b52' ELSE '#555e65' END AS roof_color, true AS estimated FROM b""", "v_buildings"))
def appearance_defaults(spark, sf_dir):
    tags = F.create_map().cast("map<string,string>")
    return building_heights(spark, sf_dir).select(
        "area_id", "source_id",
        looks.building_appearance(F.col("source_id"), F.lit(None).cast("string"), F.col("building_height"), tags).alias("a"),
    ).select(
        "area_id", "source_id", "a.roof", F.round("a.rise", 6).alias("rise"), "a.finish", "a.residential",
        F.round("a.eaves", 6).alias("eaves"), "a.wall_color", "a.roof_color", "a.estimated",
    )


@topic.query(duck("""
WITH old AS (SELECT area_id, target_id, operation, arg_max(concat(coalesce(cast(payload_value AS varchar), 'n'), '|', payload_visible), ordinal) AS p
  FROM v_overrides WHERE ordinal < (SELECT (min(ordinal) + max(ordinal)) // 2 FROM v_overrides) GROUP BY 1, 2, 3),
new AS (SELECT area_id, target_id, operation, arg_max(concat(coalesce(cast(payload_value AS varchar), 'n'), '|', payload_visible), ordinal) AS p
  FROM v_overrides GROUP BY 1, 2, 3)
SELECT DISTINCT coalesce(o.area_id, n.area_id) AS area_id, coalesce(o.target_id, n.target_id) AS target_id
FROM old o FULL JOIN new n ON o.area_id = n.area_id AND o.target_id = n.target_id AND o.operation = n.operation
WHERE o.p IS DISTINCT FROM n.p""", "v_overrides"))
def override_diff(spark, sf_dir):
    log = view(spark, sf_dir, "v_overrides")
    # The earlier version of the log ends at the middle ordinal.
    middle = log.agg(F.expr("(min(ordinal) + max(ordinal)) div 2").alias("cut")).first()["cut"]
    before = log.where(F.col("ordinal") < middle)
    return O.changed_targets(before, log, ["payload_value", "payload_visible"])


@topic.query(duck("""
WITH cut AS (SELECT (min(ordinal) + max(ordinal)) // 2 AS c FROM v_overrides),
saved AS (SELECT area_id, target_id, operation, max(ordinal) AS ordinal, arg_max(payload_value, ordinal) AS payload_value FROM v_overrides, cut WHERE ordinal < c GROUP BY 1, 2, 3),
inc AS (SELECT area_id, target_id, operation, max(ordinal) AS ordinal, arg_max(payload_value, ordinal) AS payload_value FROM v_overrides, cut WHERE ordinal >= c GROUP BY 1, 2, 3),
top AS (SELECT area_id, max(ordinal) AS t FROM saved GROUP BY 1)
SELECT s.* FROM saved s WHERE NOT EXISTS (SELECT 1 FROM inc i WHERE i.area_id = s.area_id AND i.target_id = s.target_id AND i.operation = s.operation)
UNION ALL SELECT i.area_id, i.target_id, i.operation, coalesce(t, 0) + i.ordinal, i.payload_value FROM inc i LEFT JOIN top USING (area_id)""", "v_overrides"))
def override_upsert(spark, sf_dir):
    log = view(spark, sf_dir, "v_overrides")
    middle = log.agg(F.expr("(min(ordinal) + max(ordinal)) div 2").alias("cut")).first()["cut"]
    saved = O.last_override(log.where(F.col("ordinal") < middle), "payload_value")
    incoming = O.last_override(log.where(F.col("ordinal") >= middle), "payload_value")
    return O.upsert(saved, incoming)
