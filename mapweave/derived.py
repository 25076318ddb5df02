"""Map-shaped views computed from the driver tables, in Spark SQL and in DuckDB SQL.

Integer arithmetic and at most one division, so both engines hold equal doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "customer", "embeddings", "events", "lineitem", "orders", "part", "supplier", "nation", "region",
)

VIEWS: dict[str, str] = {
    "v_way_nodes": """
SELECT l_orderkey % 8 AS area_id, l_orderkey AS way_id, l_linenumber AS idx,
 (l_orderkey * 7919) % 2000 - 1000 + l_linenumber * ((l_orderkey % 41) - 20) * 3 + min(l_partkey) % 7 AS x,
 (l_orderkey * 6151) % 2000 - 1000 + l_linenumber * ((l_orderkey % 37) - 18) * 3 + min(l_suppkey) % 5 AS z
FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "v_grid_nodes": """
SELECT l_orderkey % 8 AS area_id, l_orderkey AS way_id, l_linenumber AS idx,
 100 * ((l_orderkey * 7919) % 23 - 11 + CASE WHEN l_orderkey % 3 = 0 THEN l_linenumber ELSE 0 END)
  + CASE WHEN l_orderkey % 3 = 2 THEN 60 * l_linenumber ELSE 0 END AS x,
 100 * ((l_orderkey * 6151) % 29 - 14 + CASE WHEN l_orderkey % 3 = 1 THEN l_linenumber ELSE 0 END)
  + CASE WHEN l_orderkey % 3 = 2 THEN 45 * l_linenumber ELSE 0 END AS z
FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "v_nodes_ll": """
SELECT area_id, way_id, idx, -75e0 + x / 85000e0 AS lon, 40e0 - z / 111320e0 AS lat FROM v_way_nodes""",
    "v_road_tags": """
SELECT o_orderkey % 8 AS area_id, o_orderkey AS way_id, concat('osm:way:', cast(o_orderkey AS varchar(20))) AS source_id,
 CASE o_orderkey % 8 WHEN 0 THEN 'residential' WHEN 1 THEN 'primary' WHEN 2 THEN 'footway' WHEN 3 THEN 'service'
  WHEN 4 THEN 'secondary' WHEN 5 THEN 'path' WHEN 6 THEN 'residential' ELSE 'raceway' END AS highway,
 CASE o_custkey % 5 WHEN 0 THEN '2' WHEN 1 THEN '4' WHEN 2 THEN 'many' ELSE NULL END AS lanes,
 CASE o_custkey % 9 WHEN 0 THEN '7.5 m' WHEN 1 THEN '6,5' WHEN 2 THEN '20'' 6"' ELSE NULL END AS width,
 CASE o_orderkey % 23 WHEN 0 THEN '1' WHEN 1 THEN '-1' WHEN 2 THEN '99' WHEN 3 THEN 'x' ELSE NULL END AS layer,
 CASE o_orderkey % 23 WHEN 0 THEN 'yes' WHEN 4 THEN 'viaduct' ELSE NULL END AS bridge,
 CASE o_orderkey % 23 WHEN 1 THEN 'yes' WHEN 5 THEN 'no' ELSE NULL END AS tunnel,
 CASE o_custkey % 13 WHEN 0 THEN 'private' ELSE NULL END AS access
FROM orders""",
    "v_buildings": """
SELECT p_partkey % 8 AS area_id, concat('osm:way:b', cast(p_partkey AS varchar(20))) AS source_id,
 (p_partkey * 6151) % 2000 - 1000 AS cx, (p_partkey * 7919) % 2000 - 1000 AS cz,
 4 + p_size % 8 AS half_x, 4 + p_size % 5 AS half_z,
 CASE p_partkey % 6 WHEN 0 THEN '12 m' WHEN 1 THEN '10'' 6"' WHEN 2 THEN '3,5' WHEN 3 THEN 'tall' ELSE NULL END AS height,
 CASE WHEN p_size % 7 = 0 THEN NULL ELSE cast(p_size % 7 AS varchar(5)) END AS levels
FROM part""",
    "v_overrides": """
SELECT user_id % 8 AS area_id, event_id AS ordinal, concat('osm:way:', cast(user_id * 8 + user_id % 8 AS varchar(20))) AS target_id,
 CASE event_type WHEN 'click' THEN 'set-width' WHEN 'view' THEN 'set-height' WHEN 'purchase' THEN 'set-spawn' ELSE 'set-visible' END AS operation,
 value AS payload_value, event_id % 3 <> 0 AS payload_visible
FROM events""",
    "v_poses": """
SELECT user_id % 8 AS area_id, user_id AS trace_id, ts, event_id,
 (event_id * 7919) % 2000 - 1000 AS x, (event_id * 6151) % 2000 - 1000 AS z, (event_id * 13) % 360 AS heading_in
FROM events""",
    "v_job_events": """
SELECT user_id AS job_id, ts, event_id,
 CASE event_type WHEN 'signup' THEN 'queued' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'complete' ELSE 'running' END AS status,
 cast(floor(value) AS int) % 101 AS progress FROM events""",
    "v_snapshots": """
SELECT c_custkey AS snapshot_id, c_mktsegment AS provider, 1 AS query_version, c_custkey % 50 AS bounds_key,
 c_custkey % 10 = 0 AS is_derived, c_custkey AS retrieved_ordinal FROM customer""",
}

_DEM_HEAD = """
SELECT vec_id % 8 AS area_id, cast((vec_id - vec_id % 8) / 8 AS int) AS r, cast(c AS int) AS c,
 CASE WHEN (vec_id * 7 + c * 3) % 11 = 0 THEN NULL ELSE 100e0 + 10e0 * cast(h AS double) END AS height"""
_PIXEL_HEAD = """
SELECT image_id, cast(x AS int) AS x, cast(y AS int) AS y, (image_id * 31 + x * 7 + y * 3) % 256 AS r,
 (image_id * 17 + x * 5 + y * 11 + CASE WHEN (x - 16) * (x - 16) + (y - 9) * (y - 9) < 30 THEN 120 ELSE 0 END) % 256 AS g,
 (image_id * 13 + x * 3 + y * 2) % 256 AS b"""

SPARK_VIEWS = {
    **VIEWS,
    "v_dem": _DEM_HEAD + " FROM (SELECT vec_id, posexplode(embedding) AS (c, h) FROM embeddings)",
    "v_pixels": _PIXEL_HEAD + """
 FROM (SELECT s_suppkey AS image_id, x, explode(sequence(0, 31)) AS y
       FROM (SELECT s_suppkey, explode(sequence(0, 31)) AS x FROM supplier))""",
}

DUCK_VIEWS = {
    **VIEWS,
    "v_dem": _DEM_HEAD + """
 FROM (SELECT vec_id, unnest(range(len(embedding))) AS c, unnest(embedding) AS h FROM embeddings)""",
    "v_pixels": _PIXEL_HEAD + """
 FROM (SELECT s_suppkey AS image_id, x, unnest(range(32)) AS y
       FROM (SELECT s_suppkey, unnest(range(32)) AS x FROM supplier))""",
}

NEEDS = {"v_nodes_ll": ("v_way_nodes",)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived view over the parquet tables of ``sf_dir``."""
    text = SPARK_VIEWS[name]
    scope = {}
    for other in (*TABLES, *SPARK_VIEWS):
        if other != name and f"FROM {other}" in text:
            scope[other] = view(spark, sf_dir, other) if other in SPARK_VIEWS else table(spark, sf_dir, other)
    for other in scope:
        text = text.replace(f"FROM {other}", f"FROM {{{other}}}")
    return spark.sql(text, **scope)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table. A file too small to be split would keep all that is derived from its rows in one task."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if 2 * rows.rdd.getNumPartitions() <= cores else rows


def places_sql(value: str, count: int) -> str:
    return f"floor(({value}) * 1e{count} + 0.5) / 1e{count}"


def duck(body: str, *views: str) -> str:
    """DuckDB text: the named views as CTEs, then ``body`` (``WITH`` steps or a ``SELECT``)."""
    names: list[str] = []
    for name in views:
        for needed in (*NEEDS.get(name, ()), name):
            if needed not in names:
                names.append(needed)
    steps = [f"{name} AS ({DUCK_VIEWS[name]})" for name in names]
    body = body.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        body = body[len("WITH RECURSIVE"):] if recursive else body[len("WITH"):]
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join([*steps, body.strip()])
    return ("WITH " + ", ".join(steps) + " " if steps else "") + body
