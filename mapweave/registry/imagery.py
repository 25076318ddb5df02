"""Roofs, vegetation and driveways on the pixel tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapweave.derived import duck, places_sql, table, view
from mapweave.functions.text import places
from mapweave.operators import imagery as I
from mapweave.registry.catalog import Topic
from mapweave.session import cut_lineage

topic = Topic()

# One image per supplier: 32 by 32 pixels of about one metre, one building with edges between the pixels.
STEP = 1e-5
WEST, NORTH = -75.0, 40.0
RING = ((8.5, 14.5), (23.5, 14.5), (23.5, 27.5), (8.5, 27.5), (8.5, 14.5))


def images(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("image_id"), F.lit(WEST).alias("west"), F.lit(NORTH - 31 * STEP).alias("south"),
        F.lit(WEST + 31 * STEP).alias("east"), F.lit(NORTH).alias("north"), F.lit(32).alias("width"), F.lit(32).alias("height"),
    )


def buildings(spark, sf_dir):
    ring = F.array(*[F.struct(F.lit(WEST + x * STEP).alias("lon"), F.lit(NORTH - y * STEP).alias("lat")) for x, y in RING])
    plain = table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") % 8).alias("area_id"), F.col("s_suppkey").alias("image_id"),
        F.concat(F.lit("osm:way:s"), F.col("s_suppkey").cast("string")).alias("source_id"), ring.alias("ring"),
    )
    return I.with_pixel_ring(plain, images(spark, sf_dir))


ROOF_SQL = """
px AS (SELECT *, r * 0.299 + g * 0.587 + b * 0.114 AS l FROM v_pixels),
nb AS (SELECT *, lead(l) OVER h - lag(l) OVER h AS gx, lead(l) OVER v - lag(l) OVER v AS gy FROM px WINDOW h AS (PARTITION BY image_id, y ORDER BY x), v AS (PARTITION BY image_id, x ORDER BY y)),
gr AS (SELECT * FROM nb WHERE x > 8.5 AND x < 23.5 AND y > 14.5 AND y < 27.5 AND x % 2 = 0 AND y % 2 = 0),
te AS (SELECT image_id, count(*) AS samples, avg(r) AS red, avg(g) AS green, avg(b) AS blue, coalesce(sum(gx * gx) FILTER (WHERE sqrt(gx * gx + gy * gy) >= 10), 0) AS xx,
 coalesce(sum(gy * gy) FILTER (WHERE sqrt(gx * gx + gy * gy) >= 10), 0) AS yy, coalesce(sum(gx * gy) FILTER (WHERE sqrt(gx * gx + gy * gy) >= 10), 0) AS xy, count(*) FILTER (WHERE sqrt(gx * gx + gy * gy) >= 10) AS gradients FROM gr GROUP BY 1),
ob AS (SELECT *, gradients / samples AS texture, sqrt((xx - yy) * (xx - yy) + 4 * xy * xy) / greatest(1, xx + yy) AS anisotropy, 0.5 * atan2(2 * xy, xx - yy) + pi() / 2 AS ridge FROM te)"""


@topic.query(duck(f"""
WITH {ROOF_SQL.strip()} SELECT image_id, CASE WHEN texture < 0.06 THEN 'flat' WHEN anisotropy > 0.28 THEN 'gabled' ELSE 'hipped' END AS shape,
 CASE WHEN abs(cos(ridge - pi() / 2)) >= sqrt(0.5) THEN 'along' ELSE 'across' END AS orientation,
 concat('#', printf('%02x', cast(floor(red + 0.5) AS int)), printf('%02x', cast(floor(green + 0.5) AS int)), printf('%02x', cast(floor(blue + 0.5) AS int))) AS color,
 round(least(0.88, greatest(0.35, 0.38 + texture * 1.8 + anisotropy * 0.3)), 6) AS confidence FROM ob""", "v_pixels"))
def roof_colour(spark, sf_dir):
    return I.roof_observations(buildings(spark, sf_dir), view(spark, sf_dir, "v_pixels")).select(
        "image_id", "shape", "orientation", "color", F.round("confidence", 6).alias("confidence")
    )


VEG_SQL = """
ce AS (SELECT image_id, x // 3 AS cx, y // 3 AS cy, (y // 3) * 10 + x // 3 AS cell, least(1e0, (g - greatest(r, b)) / 60e0) AS strength FROM v_pixels
 WHERE x % 3 = 0 AND y % 3 = 0 AND x < 30 AND y < 30 AND g > r * 1.08 AND g > b * 1.12 AND g - least(r, b) > 16 AND g < 205 AND NOT (x > 8.5 AND x < 23.5 AND y > 14.5 AND y < 27.5)),
ad AS (SELECT a.image_id, a.cell AS a, b.cell AS b FROM ce a JOIN ce b ON a.image_id = b.image_id AND abs(a.cx - b.cx) + abs(a.cy - b.cy) = 1),
fl AS (SELECT image_id, cell, cell AS root FROM ce UNION SELECT ad.image_id, ad.b, fl.root FROM fl JOIN ad ON ad.image_id = fl.image_id AND ad.a = fl.cell WHERE fl.root < ad.b),
lb AS (SELECT image_id, cell, min(root) AS root FROM fl GROUP BY 1, 2),
gp AS (SELECT image_id, root, avg(cx) * 3 AS px, avg(cy) * 3 AS py, count(*) AS cells, avg(strength) AS strength FROM lb JOIN ce USING (image_id, cell) GROUP BY 1, 2 HAVING count(*) >= 5)"""


def components(spark, sf_dir):
    return I.vegetation_components(I.vegetation_cells(buildings(spark, sf_dir), view(spark, sf_dir, "v_pixels")))


@topic.query(duck(f"""
WITH RECURSIVE {VEG_SQL.strip()} SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY root) AS number, cast(root AS bigint) AS root, {places_sql('px', 6)} AS px, {places_sql('py', 6)} AS py, cells, {places_sql('strength', 6)} AS strength FROM gp""", "v_pixels"))
def vegetation(spark, sf_dir):
    return components(spark, sf_dir).select(
        "image_id", "number", "root", *[places(F.col(c), 6).alias(c) for c in ("px", "py")], "cells", places(F.col("strength"), 6).alias("strength")
    )


@topic.query(duck(f"""
WITH RECURSIVE {VEG_SQL.strip()},
ra AS (SELECT *, sqrt(cells * 9 / pi()) * sqrt(31 * 1e-5 * 111320e0 * cos(radians(40 - 15.5e-5)) / 32 * (31 * 1e-5 * 111320e0 / 32)) AS r FROM gp)
SELECT image_id, cells, CASE WHEN r >= 1.45 THEN 'tree' ELSE 'bush' END AS kind, round(-75 + px * 1e-5, 7) AS lon, round(40 - py * 1e-5, 7) AS lat, round(least(8, greatest(0.5, r)), 4) AS crown_radius,
 round(CASE WHEN r >= 1.45 THEN least(16, greatest(3.5, r * 2.4)) ELSE least(2.2, greatest(0.6, r * 1.35)) END, 4) AS height, round(least(0.9, greatest(0.35, 0.45 + strength * 0.45)), 4) AS confidence FROM ra""", "v_pixels"))
def plants(spark, sf_dir):
    found = components(spark, sf_dir)
    return I.plants(found, images(spark, sf_dir)).join(found.select(*I.KEY, "number", "cells"), [*I.KEY, "number"]).select(
        "image_id", "cells", "kind", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"),
        *[F.round(c, 4).alias(c) for c in ("crown_radius", "height", "confidence")],
    )


def roads(spark, sf_dir):
    """One road along the top of every image, in its own area copy."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("area_id"), F.lit("osm:way:r1").alias("road_id"), F.lit(0).alias("seq"), F.lit(WEST - 20 * STEP).alias("a_lon"),
        F.lit(NORTH - 4 * STEP).alias("a_lat"), F.lit(WEST + 60 * STEP).alias("b_lon"), F.lit(NORTH - 4 * STEP).alias("b_lat"), F.lit(4.5).alias("width"),
    )


@topic.query(duck("""
WITH m AS (SELECT s_suppkey AS image_id, 40 - 4e-5 - (2.25e0 + 0.03e0) / 111320e0 AS edge_lat FROM supplier),
sm AS (SELECT image_id, 16 AS x, cast(floor(14.5 + ((40 - edge_lat) / 1e-5 - 14.5) * (i / 18e0) + 0.5) AS int) AS y FROM m, range(2, 16) t(i)),
sc AS (SELECT sm.image_id, count(*) FILTER (WHERE greatest(r, g, b) - least(r, g, b) < 42 AND (r + g + b) / 3e0 > 55 AND (r + g + b) / 3e0 < 235) / 14e0 AS score FROM sm JOIN v_pixels p ON p.image_id = sm.image_id AND p.x = sm.x AND p.y = sm.y GROUP BY 1)
SELECT image_id, round(score, 6) AS north_score, score >= 0.48 AS north_detected FROM sc""", "v_pixels"))
def driveway_scores(spark, sf_dir):
    """Paved share of the way from the north wall to the road above each building."""
    houses = buildings(spark, sf_dir).withColumn("area_id", F.col("image_id"))
    found = I.driveway_candidates(houses, roads(spark, sf_dir)).where("wall = 0")
    return I.driveways(found, view(spark, sf_dir, "v_pixels")).select(
        "image_id", F.round("score", 6).alias("north_score"), F.col("detected").alias("north_detected")
    )


@topic.query()
def enhancement_proposals(spark, sf_dir):
    """Roof, driveway and landscaping of every building, kept clear of roads and of each other."""
    from mapweave.plans.enhancement import propose

    houses = cut_lineage(buildings(spark, sf_dir).withColumn("area_id", F.col("image_id")))
    offers = propose(houses, images(spark, sf_dir), view(spark, sf_dir, "v_pixels"), roads(spark, sf_dir))
    return offers.select(
        "image_id", "source_id", "shape", "orientation", "color", F.round("roof_confidence", 6).alias("roof_confidence"),
        "driveway_detected", "trees", "bushes",
    )
