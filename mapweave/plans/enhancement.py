"""Building proposals from imagery, one building or one tile of buildings at a time, over all images at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.operators import imagery as I
from mapweave.operators.ranking import top_per_group
from mapweave.operators.spatial import buildings_in_tiles
from mapweave.session import cut_lineage

TILE_BUILDINGS = 60


def landscape(buildings: DataFrame, images: DataFrame, pixels: DataFrame, roads: DataFrame) -> DataFrame:
    """Plants of each building after road protection, the sixteen largest."""
    grown = I.plants(I.vegetation_components(I.vegetation_cells(buildings, pixels)), images)
    return I.keep_apart(I.clear_of_roads(grown, buildings, roads))


def propose(buildings: DataFrame, images: DataFrame, pixels: DataFrame, roads: DataFrame) -> DataFrame:
    """Roof, driveway and landscaping evidence of each building in one row."""
    roof = I.roof_observations(buildings, pixels).withColumnRenamed("confidence", "roof_confidence")
    ways = I.driveways(I.driveway_candidates(buildings, roads), pixels).select(
        *I.KEY, "wall", "road_id", "edge", F.col("score").alias("driveway_confidence"), F.col("detected").alias("driveway_detected")
    )
    green = I.landscaping_totals(landscape(buildings, images, pixels, roads)).withColumnRenamed("confidence", "vegetation_confidence")
    return roof.join(ways, I.KEY, "left").join(green, I.KEY, "left").withColumns({
        "driveway_detected": F.coalesce("driveway_detected", F.lit(False)), "trees": F.coalesce("trees", F.lit(0)),
        "bushes": F.coalesce("bushes", F.lit(0)), "vegetation_confidence": F.coalesce("vegetation_confidence", F.lit(0.25)),
    })


def garage_openings(proposals: DataFrame, openings: DataFrame) -> DataFrame:
    """Detected driveways of buildings that have no garage yet."""
    owned = openings.where(F.col("kind") == "garage").select("source_id").distinct()
    return proposals.where("driveway_detected").join(owned, "source_id", "left_anti").select(
        "source_id", F.lit("aerial-garage").alias("id"), F.lit("garage").alias("kind"), "wall", F.lit(0.5).alias("fraction"),
        F.lit(1).alias("cars"), "road_id", "edge",
    )


def enhance_tiles(tiles: DataFrame, centers: DataFrame, saved: DataFrame, buildings: DataFrame, images: DataFrame,
                  pixels: DataFrame, roads: DataFrame, tile_size: float = 200.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pending buildings of each tile, their plants unique within the tile, and the tile report.

    Tiles: ``area_id, tile_x, tile_z``; centers: ``area_id, source_id, px, pz``; saved: ``area_id, source_id``. One image
    may show many buildings: each is analysed on its own crop, its ring with a margin.
    """
    key = ["area_id", "tile_x", "tile_z"]
    building = ["area_id", "source_id"]
    inside = cut_lineage(buildings_in_tiles(centers, tiles, tile_size).select(*key, "source_id"))
    open_ = inside.join(saved.select(*building).distinct(), building, "left_anti")
    pending = cut_lineage(top_per_group(open_, key, [F.col("source_id")], TILE_BUILDINGS).select(*key, "source_id"))
    wanted = cut_lineage(buildings.join(pending.select(*building), building, "left_semi"))
    own, frames, cut = (cut_lineage(df) for df in I.cropped(wanted, I.windows(wanted, images), pixels))
    grown = landscape(own, frames, cut, roads).join(pending, building)
    seen = I.roof_observations(own, cut).select("image_id", "source_id").join(own.select("image_id", *building), ["image_id", "source_id"])
    analysed = seen.join(pending, building).select(*key, "source_id")
    return pending, I.unique_in_tile(grown, key), I.tile_report(inside, pending, analysed, key)
