"""Vehicle traces in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapweave.derived import duck, view
from mapweave.functions import geo as G
from mapweave.registry.catalog import Topic
from mapweave.streaming.poses import map_poses, tile_visits as visits

topic = Topic()


def areas(spark, sf_dir):
    """Frame and bounds of each area with poses; all areas share one anchor here."""
    reach_x, reach_y = 1000 / 85000, 1000 / 111320
    return view(spark, sf_dir, "v_poses").select("area_id").distinct().withColumns({
        "frame": G.anchor_frame(F.lit(-75.0), F.lit(40.0)), "west": F.lit(-75.0 - reach_x), "east": F.lit(-75.0 + reach_x),
        "south": F.lit(40.0 - reach_y), "north": F.lit(40.0 + reach_y),
    })


def poses(spark, sf_dir):
    """Poses with a rotation about the vertical axis made from the given heading."""
    half = G.radians(F.col("heading_in") + 0.5) / 2.0
    return view(spark, sf_dir, "v_poses").select(
        "area_id", "trace_id", "ts", "event_id", "x", "z", F.lit(0.0).alias("qx"), (-F.sin(half)).alias("qy"),
        F.lit(0.0).alias("qz"), F.cos(half).alias("qw"),
    )


@topic.query(duck("""
WITH p AS (SELECT *, cast(floor(x / 200.0) AS bigint) AS tx, cast(floor(-z / 200.0) AS bigint) AS tn, sin(radians(heading_in + 0.5)) AS e, cos(radians(heading_in + 0.5)) AS n FROM v_poses),
s AS (SELECT *, abs(e) > abs(n) AS side, CASE WHEN (CASE WHEN abs(e) > abs(n) THEN e ELSE n END) >= 0 THEN 1 ELSE -1 END AS step, CASE WHEN abs(e) > abs(n) THEN x - tx * 200 ELSE -z - tn * 200 END AS off FROM p),
t AS (SELECT area_id, trace_id, tx AS tile_x, tn AS tile_north, ts FROM s UNION ALL SELECT area_id, trace_id, tx + CASE WHEN side THEN step ELSE 0 END, tn + CASE WHEN side THEN 0 ELSE step END, ts FROM s WHERE CASE WHEN step > 0 THEN 200 - off ELSE off END <= 100)
SELECT area_id, trace_id, tile_x, tile_north, min(ts) AS ts FROM t WHERE abs((tile_x + 0.5) * 200) < 1000 AND abs((tile_north + 0.5) * 200) < 1000 GROUP BY 1, 2, 3, 4""", "v_poses"))
def tile_visits(spark, sf_dir):
    return visits(poses(spark, sf_dir), areas(spark, sf_dir)).select("area_id", "trace_id", "tile_x", "tile_north", "ts")


@topic.query(duck("SELECT trace_id, event_id, heading_in + 0.5e0 AS heading, x AS east, -z AS north FROM v_poses", "v_poses"))
def pose_headings(spark, sf_dir):
    """Heading from the rotation, and the map position taken back to whole metres."""
    located = map_poses(poses(spark, sf_dir), areas(spark, sf_dir))
    enu = G.local_enu(G.ecef(F.col("lon"), F.col("lat"), F.lit(0.0)), F.col("frame"))
    return located.withColumn("enu", enu).select(
        "trace_id", "event_id", F.round("heading", 6).alias("heading"),
        F.round("enu.east").cast("bigint").alias("east"), F.round("enu.north").cast("bigint").alias("north"),
    )
