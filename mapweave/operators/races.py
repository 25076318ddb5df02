"""Race tables: positions, standings, splits, best times and close followers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.operators.grid import cell_join, point_box
from mapweave.operators.ordered import neighbors, place, running_min


def positions(progress: DataFrame, keys: list[str], block: DataFrame | None = None) -> DataFrame:
    """One more than the number of rivals with greater progress; equals share a position."""
    return place(progress, keys, "progress", None, "position", block)


def standings(entries: DataFrame, keys: list[str], entrant: str, block: DataFrame | None = None) -> DataFrame:
    """Finishers by time, then the others by progress."""
    finished = F.col("time").isNotNull()
    done = entries.groupBy(*keys).agg(F.count("time").alias("_done"))
    scored = entries.withColumns({"finished": finished, "_score": F.when(finished, -F.col("time")).otherwise(F.col("progress"))})
    placed = place(scored, [*keys, "finished"], "_score", entrant, "position", block).join(done, keys)
    return placed.withColumn(
        "position", F.col("position") + F.when(F.col("finished"), 0).otherwise(F.col("_done"))
    ).drop("_score", "_done")


def position_changes(log: DataFrame, keys: list[str], order: str, block: DataFrame | None = None) -> DataFrame:
    """Rows where an entrant's position differs from its previous one."""
    near = neighbors(log, keys, order, ["position"], before="_prev", block=block)
    return near.where(F.col("_prev.position") != F.col("position")).withColumn("previous", F.col("_prev.position")).drop("_prev")


def fastest_splits(splits: DataFrame, keys: list[str], order: str, block: DataFrame | None = None) -> DataFrame:
    """Least difference between successive split times, the first counted from zero."""
    near = neighbors(splits, keys, order, ["time"], before="_prev", block=block)
    return near.groupBy(*keys).agg(F.min(F.col("time") - F.coalesce(F.col("_prev.time"), F.lit(0.0))).alias("fastest"))


def split_deltas(splits: DataFrame, rivals: DataFrame, keys: list[str]) -> DataFrame:
    """Difference to the fastest rival at the same checkpoint; null without one."""
    best = rivals.groupBy(*keys).agg(F.min("time").alias("_best"))
    return splits.join(best, keys, "left").withColumn("delta", F.col("time") - F.col("_best")).drop("_best")


def personal_bests(finishes: DataFrame, keys: list[str], order: str, block: DataFrame | None = None) -> DataFrame:
    """Best earlier time of the course and whether this finish beats it; a first finish does."""
    seen = running_min(finishes, keys, order, "time", "previous_best", block)
    better = F.col("previous_best").isNull() | (F.col("time") < F.col("previous_best"))
    return seen.withColumn("personal_best", better).withColumn("best", F.least("time", "previous_best"))


# Reaches in metres of the slipstream and of the brake zone.
DRAFT = (5.0, 18.0, 2.1)
BRAKE = (2.2, 4.8, 11.0, 2.15)


def _offsets(poses: DataFrame, reach: float) -> DataFrame:
    """Pairs of different entrants of one race and tick in reach; adds distances along and across the heading."""
    mine = poses.select("race_id", "tick", *[F.col(c).alias(f"my_{c}") for c in ("entrant", "x", "z", "fx", "fz")])
    other = poses.select("race_id", "tick", *[F.col(c).alias(f"its_{c}") for c in ("entrant", "x", "z")])
    area = F.struct("race_id", "tick").alias("area_id")
    pairs = cell_join(
        mine.select(area, F.col("my_entrant"), "my_x", "my_z", "my_fx", "my_fz"),
        other.select(area, F.col("its_entrant"), "its_x", "its_z"),
        point_box("my_x", "my_z", reach), point_box("its_x", "its_z"), reach,
    ).where(F.col("my_entrant") != F.col("its_entrant"))
    dx, dz = F.col("its_x") - F.col("my_x"), F.col("its_z") - F.col("my_z")
    return pairs.withColumns({
        "away": F.sqrt(dx * dx + dz * dz), "ahead": dx * F.col("my_fx") + dz * F.col("my_fz"),
        "aside": F.abs(dz * F.col("my_fx") - dx * F.col("my_fz")),
    })


def drafting(poses: DataFrame) -> DataFrame:
    """Boost of each entrant from the first rival, by identifier, in its slipstream."""
    low, high, side = DRAFT
    found = _offsets(poses, high).where((F.col("ahead") > low) & (F.col("ahead") < high) & (F.col("aside") < side))
    first = found.groupBy("area_id", "my_entrant").agg(F.min(F.struct("its_entrant", "ahead")).alias("_rival"))
    return first.select(
        "area_id.race_id", "area_id.tick", F.col("my_entrant").alias("entrant"), F.col("_rival.its_entrant").alias("rival"),
        (0.12 * (1 - (F.col("_rival.ahead") - low) / 20.0)).alias("boost"),
    )


def brake_level(away: Column, ahead: Column, aside: Column, has_heading: Column) -> Column:
    """Brake from 0 to 1 for a rival close by or close ahead."""
    touch, full, none, side = BRAKE
    outside = (ahead <= 0) | (ahead >= none) | (aside > side)
    return (
        F.when(away <= touch, 1.0).when(~has_heading | outside, 0.0).when(ahead <= full, 1.0)
        .otherwise((none - ahead) / (none - full))
    )


def proximity_brakes(poses: DataFrame) -> DataFrame:
    """Strongest brake of each entrant; headings are unit vectors."""
    level = brake_level(F.col("away"), F.col("ahead"), F.col("aside"), F.lit(True))
    return _offsets(poses, BRAKE[2] + BRAKE[3]).groupBy("area_id", "my_entrant").agg(F.max(level).alias("brake")).select(
        "area_id.race_id", "area_id.tick", F.col("my_entrant").alias("entrant"), "brake"
    )
