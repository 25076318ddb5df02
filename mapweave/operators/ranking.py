"""Top-k, latest-distinct and nearest-k reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapweave.operators.grid import nearest_few
from mapweave.session import FEW_CELLS, cut_lineage


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], count: int, rank: str = "rank") -> DataFrame:
    """First rows of each group. Catalyst limits each partition before the shuffle, so hot groups arrive reduced."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= count)


def latest_distinct(df: DataFrame, user: list[str], key: list[str], time: str, count: int = 10) -> DataFrame:
    """Latest row per user and key, then the latest ``count`` of each user."""
    rest = [c for c in df.columns if c not in (*user, *key)]
    latest = df.groupBy(*user, *key).agg(F.max_by(F.struct(*rest), time).alias("_row")).select(*user, *key, "_row.*")
    return top_per_group(latest, user, [F.col(time).desc(), *[F.col(k) for k in key]], count)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest row of each key as an aggregate, which combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def nearest_attachments(points: DataFrame, parts: DataFrame, keys: list[str], reach: float, count: int) -> DataFrame:
    """Nearest road segments of each point below ``reach``. Points at one place are measured once."""
    place, order = ["area_id", "px", "pz"], [F.col("distance"), F.col("way_id"), F.col("idx")]
    near = nearest_few(points.select(*place).distinct(), parts, count, reach)
    best = cut_lineage(top_per_group(near, place, order, count).drop("rank").toDF(*[f"_{c}" if c in place else c for c in near.columns]))
    # Few places go to the points, which then keep their partitions.
    best = F.broadcast(best) if best.count() <= FEW_CELLS else best.hint("merge")
    met = points.join(best, [F.col(c) == F.col(f"_{c}") for c in place]).drop(*[f"_{c}" for c in place])
    return top_per_group(met, ["area_id", *keys], order, count)


def spawn_points(nearest: DataFrame, requested: DataFrame) -> DataFrame:
    """Start pose per area: on the road an override names, else on the road nearest the origin.

    Both inputs: ``area_id, way_id, x, z, yaw``.
    """
    chosen = requested.select("area_id", *[F.col(c).alias(f"_{c}") for c in ("way_id", "x", "z", "yaw")])
    return nearest.join(chosen, "area_id", "full").select(
        "area_id", *[F.coalesce(f"_{c}", c).alias(c) for c in ("way_id", "x", "z", "yaw")]
    )


def closest_to_center(items: DataFrame, centers: DataFrame, key: str) -> DataFrame:
    """Item nearest each area's centre (``center_x, center_z``); the lowest key wins a tie."""
    off_x, off_z = F.col("x") - F.col("center_x"), F.col("z") - F.col("center_z")
    return items.join(centers, "area_id").groupBy("area_id").agg(
        F.min(F.struct((off_x * off_x + off_z * off_z).alias("d2"), F.col(key), "x", "z")).alias("_best")
    ).select("area_id", f"_best.{key}", "_best.x", "_best.z")
