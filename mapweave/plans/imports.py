"""Imports: normalised snapshots, sub-areas cut from stored ones, previews and elevation snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.functions.text import content_hash, derived_hash
from mapweave.operators import elevation as E
from mapweave.operators.chunks import signatures
from mapweave.operators.snapshots import recent_originals
from mapweave.operators.spatial import covering_area, features_in_area
from mapweave.plans.normalize import import_diagnostics, normalize


def elevation_snapshot(areas: DataFrame, samples: DataFrame, spacing: float = 10.0, largest: int = 513) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Filled and rounded grids, coverage decisions and header rows for all areas.

    Areas: ``area_id, west, south, east, north``; samples: ``area_id, idx, value``. Areas with too many gaps are flat.
    """
    sized = E.grid_dimensions(areas, spacing, largest)
    merged = E.merge_samples(E.lattice(sized), samples)
    decisions = E.coverage(merged)
    usable = merged.join(decisions.where("NOT flat").select("area_id"), "area_id", "left_semi")
    filled = E.rounded(E.fill_gaps(usable)).select("area_id", "row", "col", "height")
    flat = E.flat_grid(decisions.where("flat"))
    grid = filled.unionByName(flat)
    header = E.summary(grid).join(areas.select("area_id", "west", "south", "east", "north"), "area_id").join(E.grid_hash(grid), "area_id")
    return grid, decisions, header


def import_snapshot(areas: DataFrame, elements: DataFrame, elevation_header: DataFrame, provider: str, retrieved_at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Snapshot rows, features keyed by snapshot, and diagnostics.

    The snapshot hash combines the element content and the elevation content of each area.
    """
    features, rejected = normalize(elements)
    raw = signatures(elements.withColumn("tags", F.array_sort(F.map_entries("tags"))), ["area_id"],
                     [c for c in elements.columns if c not in ("area_id", "position")], "raw_hash")
    named = areas.join(raw, "area_id", "left").join(elevation_header.select("area_id", F.col("content_hash").alias("_grid")), "area_id", "left")
    selection = F.when(F.col("size_m").isNotNull(), F.to_json(F.struct("size_m", "bearing_deg"))) if "size_m" in areas.columns else F.lit(None).cast("string")
    hashed = named.withColumn("content_hash", content_hash(F.coalesce("raw_hash", F.lit("")), F.coalesce("_grid", F.lit("")), selection))
    snapshots = hashed.select(
        "area_id", F.col("content_hash").alias("snapshot_id"), F.lit(provider).alias("provider"), F.lit(1).alias("query_version"),
        "west", "south", "east", "north", selection.alias("selection"), F.lit(retrieved_at).cast("timestamp").alias("retrieved_at"), "content_hash",
        F.lit(None).cast("string").alias("derived_from"),
    )
    keyed = features.join(snapshots.select("area_id", "snapshot_id"), "area_id")
    return snapshots, keyed, import_diagnostics(areas, features, rejected)


def derive_snapshots(requests: DataFrame, snapshots: DataFrame, features: DataFrame, cell: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """The snapshot of each request and the new snapshots' features, where one of the five latest originals covers it.

    Equal requests share one snapshot; each of them is answered.

    Requests: ``request_id, provider, query_version, ring, bounds_json, selection_json``; snapshots: ``snapshot_id,
    provider, query_version, original_ring, retrieved_at, content_hash, is_derived``; features: ``snapshot_id, source_id,
    ring``.
    """
    served = covering_area(requests, recent_originals(snapshots)).where(F.col("parent_id").isNotNull())
    parents = snapshots.select(F.col("snapshot_id").alias("parent_id"), F.col("content_hash").alias("parent_hash"))
    derived = served.join(parents, "parent_id").withColumn(
        "snapshot_id", derived_hash(F.col("parent_hash"), F.col("bounds_json"), F.col("selection_json"))
    )
    # The snapshot's name holds its bounds, so the rows that share it have one ring.
    areas = derived.select(F.col("parent_id").alias("area_id"), F.col("snapshot_id").alias("new_snapshot"), F.col("ring").alias("area_ring"))
    areas = areas.dropDuplicates(["area_id", "new_snapshot"])
    inside = features_in_area(features.withColumnRenamed("snapshot_id", "area_id"), areas, cell)
    return derived, inside.drop("area_ring", "area_id").withColumnRenamed("new_snapshot", "snapshot_id")


def preview(features: DataFrame) -> DataFrame:
    """Counts by kind and estimated building heights of each snapshot."""
    facts_missing = F.col("facts.height").isNull() & F.col("facts.levels").isNull()
    count = lambda kind: F.count_if(F.col("kind") == kind)
    return features.groupBy("snapshot_id").agg(
        count("road").alias("roads"), count("building").alias("buildings"), count("land").alias("land"), count("water").alias("water"),
        count("barrier").alias("barriers"), F.count_if((F.col("kind") == "building") & facts_missing).alias("estimated_heights"),
    )


# Attribution of the map data.
MAP_ATTRIBUTION = ("© OpenStreetMap contributors", "https://www.openstreetmap.org/copyright", "ODbL 1.0")


def attribution(snapshots: DataFrame, elevation: DataFrame) -> DataFrame:
    """Map attribution and, where there is one, the grid's. Elevation: ``snapshot_id, text, url, license``."""
    own = F.struct(*[F.lit(v).alias(n) for v, n in zip(MAP_ATTRIBUTION, ("text", "url", "license"))])
    grid = elevation.select("snapshot_id", F.array(F.struct("text", "url", "license")).alias("_grid"))
    return snapshots.select("snapshot_id").join(grid, "snapshot_id", "left").select(
        "snapshot_id", F.concat(F.array(own), F.coalesce("_grid", F.slice(F.array(own), 1, 0))).alias("attribution")
    )


def definitions(worlds: DataFrame, features: DataFrame, overrides: DataFrame, customizations: DataFrame) -> DataFrame:
    """Numbers of what belongs to each world; the detail tables join on the same keys."""
    counted = lambda df, key, name: df.groupBy(key).agg(F.count("*").alias(name))
    return (
        worlds.join(counted(features, "snapshot_id", "features"), "snapshot_id", "left")
        .join(counted(overrides, "world_id", "overrides"), "world_id", "left")
        .join(counted(customizations, "snapshot_id", "customizations"), "snapshot_id", "left")
        .na.fill(0, ["features", "overrides", "customizations"])
    )
