"""Vehicle poses as map positions and tile visits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.functions import geo as G


def map_poses(poses: DataFrame, areas: DataFrame) -> DataFrame:
    """Longitude, latitude and heading of each pose; works on batches and streams.

    ``areas``: static ``area_id, frame, west, south, east, north`` with the frame computed once per area.
    """
    joined = poses.join(areas, "area_id")
    located = G.local_to_map(joined, F.col("x"), F.col("z"), F.col("frame"), ("lon", "lat", "_h")).drop("_h")
    return located.withColumn("heading", G.heading_degrees(F.col("qx"), F.col("qy"), F.col("qz"), F.col("qw")))


def pose_tiles(poses: DataFrame, size: float = G.TILE_METRES) -> DataFrame:
    """Tile under each pose and the one ahead near its edge. Poses: ``x, z, heading``; the tile row counts north."""
    tiles = G.tiles_for_pose(F.col("x"), -F.col("z"), F.col("heading"), size)
    return poses.withColumn("_t", F.explode(tiles)).select("*", "_t.tile_x", "_t.tile_north").drop("_t")


def within_area(tiles: DataFrame, size: float = G.TILE_METRES) -> DataFrame:
    """Tiles whose centre lies in the area's bounds, borders included; needs ``frame`` and the bounds."""
    middle = lambda c: (F.col(c) + 0.5) * size
    located = G.local_to_map(tiles, middle("tile_x"), -middle("tile_north"), F.col("frame"), ("tile_lon", "tile_lat", "_h"))
    bounds = F.struct("west", "south", "east", "north")
    return located.where(G.contains_closed(bounds, F.col("tile_lon"), F.col("tile_lat"))).drop("_h")


def tile_visits(poses: DataFrame, areas: DataFrame, delay: str = "12 hours") -> DataFrame:
    """Each tile once per trace of an area. The watermark delay must exceed the longest trace, as tiles are remembered that long.

    On a batch the same call needs no watermark: visits are counted first, and only the distinct tiles of an area are located.
    """
    heading = G.heading_degrees(F.col("qx"), F.col("qy"), F.col("qz"), F.col("qw"))
    key = ["area_id", "trace_id", "tile_x", "tile_north"]
    if poses.isStreaming:
        visited = within_area(pose_tiles(poses.withColumn("heading", heading)).join(areas, "area_id"))
        visited = visited.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)
        return visited.select(*key, "ts", "tile_lon", "tile_lat")
    first = pose_tiles(poses.withColumn("heading", heading)).groupBy(*key).agg(F.min("ts").alias("ts"))
    tiles = first.select("area_id", "tile_x", "tile_north").distinct()
    placed = within_area(tiles.join(areas, "area_id")).select("area_id", "tile_x", "tile_north", "tile_lon", "tile_lat")
    return first.join(placed, ["area_id", "tile_x", "tile_north"]).select(*key, "ts", "tile_lon", "tile_lat")
