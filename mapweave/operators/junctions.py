"""Junctions of roads: detection, clusters, height reconciliation and sign posts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapweave.functions.text import half_up, plan_id
from mapweave.operators.components import label_nodes
from mapweave.operators.lines import cumulative_distance, gap
from mapweave.operators.ordered import neighbors

KEY = ["area_id", "layer", "kx", "kz"]
# Footprint margin and easing length of a junction, in metres.
INDEX_BITS = 24  # of a point's index in its road; ids have the other 39
MARGIN = 4.0
EASE = 16.0
EASE_BAND = 32.0


def keyed(points: DataFrame) -> DataFrame:
    """Points with their decimetre key; halves round toward positive infinity."""
    return points.withColumns({"kx": half_up(F.col("x"), 10.0), "kz": half_up(F.col("z"), 10.0)})


def junctions(points: DataFrame, height: bool = True) -> DataFrame:
    """Shared points and road ends. Points: ``area_id, way_id, idx, count, layer, width, x, z`` (and ``y``).

    The centre is the first point by road and index, the height the mean, the radius the widest half road. Only
    combining aggregates: a key that many roads share costs one row per task.
    """
    end = (F.col("idx") == 0) | (F.col("idx") == F.col("count") - 1)
    # One number ranks points by road and index, and columns are picked one by one, so the aggregate stays a hash aggregate.
    rank = F.shiftleft(F.col("way_id").cast("long"), INDEX_BITS) + F.col("idx")
    found = keyed(points).groupBy(*KEY).agg(
        *[F.min_by(F.col(c).cast("double"), rank).alias(c) for c in "xz"],
        *([F.avg("y").alias("y")] if height else []),
        (F.max("width") / 2.0).alias("radius"), F.min("way_id").alias("_lo"), F.max("way_id").alias("_hi"),
        F.count("*").alias("occurrences"), F.count_if(end).alias("endpoints"),
    )
    shared = F.col("_lo") != F.col("_hi")
    return found.where(shared | (F.col("endpoints") > 0)).select(
        *KEY, junction_key().alias("junction"), "x", "z",
        *(["y"] if height else []), "radius", "occurrences", "endpoints", shared.alias("shared"),
        F.when(shared | (F.col("occurrences") > 1), "intersection").otherwise("end-cap").alias("kind"),
    )


def junction_key() -> Column:
    return plan_id("junction", F.col("kx"), F.col("kz"), F.format_string("%.0f", F.col("layer")))


def junction_roads(points: DataFrame, found: DataFrame) -> DataFrame:
    """Bridge table of junctions and their roads."""
    return keyed(points).select(*KEY, "way_id").distinct().join(found.select(*KEY, "junction"), KEY).select(
        "area_id", "junction", "way_id"
    )


def anchors(points: DataFrame, found: DataFrame, block: DataFrame | None = None) -> DataFrame:
    """Road points at junctions, with their distance along the road and the junction's reach."""
    measured = cumulative_distance(points, name="along", total=None, block=block)
    return keyed(measured).join(found.select(*KEY, "junction", (F.col("radius") + MARGIN).alias("reach")), KEY).select(
        "area_id", "way_id", "idx", "along", "junction", "reach"
    )


def cluster_edges(anchored: DataFrame, block: DataFrame | None = None) -> DataFrame:
    """Junctions next to each other on a road that are no farther apart than their reaches together."""
    near = neighbors(anchored, ["area_id", "way_id"], "idx", ["along", "reach", "junction"], before="_prev", block=block)
    touching = F.col("along") - F.col("_prev.along") <= F.col("reach") + F.col("_prev.reach")
    return near.where(F.col("_prev").isNotNull() & touching).select(
        "area_id", F.col("_prev.junction").alias("a"), F.col("junction").alias("b")
    )


def cluster_heights(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean height of each junction's cluster: ``area_id, junction, root, level``."""
    labelled = label_nodes(found.select("area_id", "junction", "y"), edges, "junction")
    means = labelled.groupBy("area_id", "root").agg(F.avg("y").alias("level"))
    return labelled.join(means, ["area_id", "root"]).select("area_id", "junction", "root", "level")


def ease_heights(points: DataFrame, anchored: DataFrame, levels: DataFrame, block: DataFrame | None = None) -> DataFrame:
    """Flatten roads inside junction footprints and ease them over the next sixteen metres.

    The first anchor whose footprint holds the point wins; elsewhere the anchors within reach are averaged by a
    smoothstep weight. Points meet anchors of their road in bands of distance, not all with all.
    """
    reach = F.col("reach") + EASE
    banded = anchored.join(levels.select("area_id", "junction", "level"), ["area_id", "junction"]).select(
        "area_id", "way_id", F.col("idx").alias("_at"), F.col("along").alias("_d"), "reach", "level",
        F.explode(F.sequence(F.floor((F.col("along") - reach) / EASE_BAND), F.floor((F.col("along") + reach) / EASE_BAND))).alias("_band"),
    )
    measured = cumulative_distance(points, name="_along", total=None, block=block)
    off = F.abs(F.col("_along") - F.col("_d"))
    t = F.greatest(F.lit(0.0), 1 - (off - F.col("reach")) / EASE)
    weight = t * t * (3 - 2 * t)
    inside = off <= F.col("reach")
    pulled = measured.select("area_id", "way_id", "idx", "_along", F.floor(F.col("_along") / EASE_BAND).alias("_band")).join(
        banded, ["area_id", "way_id", "_band"]
    ).groupBy("area_id", "way_id", "idx").agg(
        F.min_by(F.when(inside, F.col("level")), F.when(inside, F.col("_at"))).alias("_flat"),
        F.sum(F.when(~inside, weight)).alias("_w"), F.sum(F.when(~inside, weight * F.col("level"))).alias("_wl"),
    )
    eased = F.col("y") + (F.col("_wl") / F.nullif(F.col("_w"), F.lit(0.0)) - F.col("y")) * F.least(F.lit(1.0), F.col("_w"))
    return points.join(pulled, ["area_id", "way_id", "idx"], "left").withColumn(
        "y", F.coalesce(F.col("_flat"), F.when(F.col("_w") > 0, eased), F.col("y"))
    ).drop("_flat", "_w", "_wl")


def sign_names(roads_at: DataFrame) -> DataFrame:
    """Distinct trimmed road names per junction; none for a single name shared by all, or for no names.

    Rows: ``area_id, junction, way_id, name`` of intersections with at least two roads.
    """
    name = F.nullif(F.trim("name"), F.lit(""))
    kept = roads_at.withColumn("name", name).groupBy("area_id", "junction").agg(
        F.array_sort(F.collect_set("name")).alias("names"), F.count_if(F.col("name").isNull()).alias("_unnamed")
    )
    alone = (F.size("names") == 1) & (F.col("_unnamed") == 0)
    return kept.where((F.size("names") > 0) & ~alone).select("area_id", "junction", "names")


def approach_angles(points: DataFrame, found: DataFrame, bridge: DataFrame, block: DataFrame | None = None) -> DataFrame:
    """Distinct directions in which roads leave each junction, from the points within 0.1 m of its centre."""
    shifts = F.sequence(F.lit(-1), F.lit(1))
    around = found.select(*KEY, "junction", F.col("x").alias("cx"), F.col("z").alias("cz")).withColumn(
        "_i", F.explode(shifts)
    ).withColumn("_j", F.explode(shifts)).select(
        "area_id", "layer", (F.col("kx") + F.col("_i")).alias("kx"), (F.col("kz") + F.col("_j")).alias("kz"), "junction", "cx", "cz"
    )
    near = keyed(neighbors(points, ["area_id", "way_id"], "idx", ["x", "z"], before="_prev", after="_next", block=block))
    met = near.join(around, KEY).where(gap(F.col("x"), F.col("z"), F.col("cx"), F.col("cz")) <= 0.1)
    met = met.join(bridge, ["area_id", "junction", "way_id"], "left_semi")
    ways = met.select("area_id", "junction", "x", "z", F.explode(F.array("_prev", "_next")).alias("_n")).where(
        F.col("_n").isNotNull() & (gap(F.col("x"), F.col("z"), F.col("_n.x"), F.col("_n.z")) >= 0.01)
    )
    return ways.select(
        "area_id", "junction", F.atan2(F.col("_n.z") - F.col("z"), F.col("_n.x") - F.col("x")).alias("angle")
    ).distinct()


def widest_gap(angles: DataFrame) -> DataFrame:
    """Largest angle between neighbouring approaches and its middle direction; the lowest angle wins a tie."""
    around = Window.partitionBy("area_id", "junction").orderBy("angle")
    following = F.coalesce(F.lead("angle").over(around), F.first("angle").over(around) + 2 * math.pi)
    return angles.withColumn("gap", following - F.col("angle")).groupBy("area_id", "junction").agg(
        F.max(F.struct("gap", (-F.col("angle")).alias("_minus"))).alias("_g")
    ).select("area_id", "junction", F.col("_g.gap").alias("gap"), (F.col("_g.gap") / 2 - F.col("_g._minus")).alias("direction"))


def sign_posts(found: DataFrame, names: DataFrame, gaps: DataFrame) -> DataFrame:
    """Where to put the post: in the widest gap, clear of the road surface."""
    keys = ["area_id", "junction"]
    placed = found.join(names, keys).join(gaps, keys, "left").withColumns({
        "gap": F.coalesce("gap", F.lit(0.0)), "direction": F.coalesce("direction", F.lit(math.pi / 4)),
    })
    away = (F.col("radius") + 1) / F.greatest(F.lit(0.3), F.sin(F.least(F.lit(math.pi), F.col("gap")) / 2))
    return placed.withColumn("_away", away).select(
        *keys, (F.col("x") + F.cos("direction") * F.col("_away")).alias("x"),
        (F.col("z") + F.sin("direction") * F.col("_away")).alias("z"), "names",
    )
