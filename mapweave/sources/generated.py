"""Generated inputs: a sample neighbourhood for any number of areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.functions.geo import radians

_POINT = "array<struct<lat:double,lon:double>>"


def sample_elements(areas: DataFrame) -> DataFrame:
    """Six roads, sixteen buildings and a park per area. Areas: ``area_id, west, south, east, north``.

    Everything is placed by fractions of a box about the centre, at most 0.012 by 0.009 degrees.
    """
    mid_lon, mid_lat = (F.col("west") + F.col("east")) / 2.0, (F.col("south") + F.col("north")) / 2.0
    boxed = areas.select(
        "area_id", mid_lon.alias("mx"), mid_lat.alias("my"), F.least(F.col("east") - F.col("west"), F.lit(0.012)).alias("dx"),
        F.least(F.col("north") - F.col("south"), F.lit(0.009)).alias("dy"),
    )

    def at(u, v):
        """Position at fractions of the box from its south-west corner."""
        lat, lon = F.col("my") + (F.lit(v) - 0.5) * F.col("dy"), F.col("mx") + (F.lit(u) - 0.5) * F.col("dx")
        return F.struct(lat.alias("lat"), lon.alias("lon"))

    def item(number, tags, places):
        pairs = [F.lit(v) for pair in tags.items() for v in pair]
        return F.struct(
            F.lit(10_000 + number).cast("bigint").alias("id"), F.create_map(*pairs).alias("tags"), F.array(*places).alias("geometry")
        )

    items = []
    # Names, classes, fractions and counts of the sample.
    for n, (u, name, highway, lanes) in enumerate((
        (0.18, "West Street", "residential", "1"), (0.5, "Open Avenue", "secondary", "2"), (0.82, "East Street", "residential", "1"),
    )):
        tags = {"highway": highway, "name": name, "lanes": lanes, "surface": "asphalt"}
        items.append(item(n, tags, [at(u, 0.0), at(u + 0.015, 0.5), at(u, 1.0)]))
    for n, (v, name, highway) in enumerate((
        (0.18, "South Lane", "residential"), (0.5, "Community Road", "tertiary"), (0.82, "North Lane", "residential"),
    )):
        tags = {"highway": highway, "name": name, "lanes": "2", "surface": "asphalt"}
        items.append(item(3 + n, tags, [at(0.0, v), at(0.5, v + 0.012), at(1.0, v)]))
    for block in range(4):
        for house in range(4):
            column, row = house % 2, house // 2
            u = (0.32, 0.68)[block % 2] + (column - 0.5) * 0.12 * 0.72
            v = (0.32, 0.68)[block // 2] + (row - 0.5) * 0.11 * 0.72
            flats = block == 3
            half_u, half_v = 0.12 * (0.2 if flats else 0.15), 0.11 * (0.18 if flats else 0.14)
            tags = {
                "building": "apartments" if flats else "house",
                "building:levels": str(3 + row if flats else 1 + (house + block) % 2),
                "addr:housenumber": str(100 + block * 10 + house),
            }
            ring = [at(u + sx * half_u, v + sy * half_v) for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]
            items.append(item(6 + block * 4 + house, tags, ring))
    park = [at(u, v) for u, v in ((0.73, 0.73), (0.79, 0.73), (0.79, 0.97), (0.73, 0.97), (0.73, 0.73))]
    items.append(item(22, {"leisure": "park", "name": "Open Data Park"}, park))
    rows = boxed.select("area_id", F.posexplode(F.array(*items)).alias("position", "e"))
    none = F.lit(None)
    return rows.select(
        "area_id", F.col("position").cast("bigint").alias("position"), F.lit("way").alias("type"), "e.id", F.lit(1).alias("version"), "e.tags",
        none.cast("double").alias("lat"), none.cast("double").alias("lon"), F.col("e.geometry").cast(_POINT).alias("geometry"),
        none.cast("array<struct<type:string,ref:bigint,role:string,geometry:array<struct<lat:double,lon:double>>>>").alias("members"),
    )


def rotate_elements(elements: DataFrame, selections: DataFrame) -> DataFrame:
    """Turn each area's elements clockwise about its selection centre. Selections: ``area_id, lon, lat, bearing``."""
    turned = elements.join(selections.select(
        "area_id", F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), radians(F.col("bearing")).alias("_a"),
        F.greatest(F.lit(0.15), F.cos(radians(F.col("lat")))).alias("_s"),
    ), "area_id")

    def turn(p):
        east, north = (p["lon"] - F.col("_lon")) * F.col("_s"), p["lat"] - F.col("_lat")
        return F.struct(
            (F.col("_lat") + north * F.cos("_a") - east * F.sin("_a")).alias("lat"),
            (F.col("_lon") + (east * F.cos("_a") + north * F.sin("_a")) / F.col("_s")).alias("lon"),
        )

    return turned.withColumn("geometry", F.transform("geometry", turn)).drop("_lon", "_lat", "_a", "_s")
