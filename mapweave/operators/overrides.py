"""The override log: effective values, hiding, upsert and difference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["area_id", "target_id", "operation"]


def effective_values(overrides: DataFrame, value: str = "payload_value", ordinal: str = "ordinal") -> DataFrame:
    """Last value per target for heights and widths, one row per target. Combines before the shuffle."""
    def last(operation: str) -> Column:
        mine = F.col("operation") == operation
        return F.max_by(F.when(mine, F.col(value)), F.when(mine, F.col(ordinal))).alias(operation.replace("-", "_"))

    return (
        overrides.where(F.col("operation").isin("set-height", "set-width"))
        .groupBy("area_id", "target_id").agg(last("set-height"), last("set-width"))
    )


def last_override(overrides: DataFrame, *columns: str) -> DataFrame:
    """Last row of each (target, operation); an aggregate rather than a window, so hot targets combine early."""
    row = F.struct(*[F.col(name) for name in columns])
    return overrides.groupBy(*KEY).agg(F.max("ordinal").alias("ordinal"), F.max_by(row, "ordinal").alias("_row")).select(
        *KEY, "ordinal", "_row.*"
    )


def hidden_targets(overrides: DataFrame, visible: str = "payload_visible") -> DataFrame:
    """Targets that any override hides, even one that a later override shows again."""
    off = (F.col("operation") == "set-visible") & (F.col(visible) == F.lit(False))
    return overrides.where(off).select("area_id", "target_id").distinct()


def drop_hidden(features: DataFrame, overrides: DataFrame, key: str = "source_id") -> DataFrame:
    hidden = hidden_targets(overrides).withColumnRenamed("target_id", key)
    return features.join(hidden, ["area_id", key], "left_anti")


def apply_values(features: DataFrame, overrides: DataFrame, key: str = "source_id") -> DataFrame:
    """Features with the effective ``set_height`` and ``set_width`` of each."""
    values = effective_values(overrides).withColumnRenamed("target_id", key)
    return features.join(values, ["area_id", key], "left")


def upsert(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replace the same (target, operation) and move it last. ``incoming`` has one row per key."""
    top = current.groupBy("area_id").agg(F.max("ordinal").alias("_top"))
    moved = (
        incoming.join(top, "area_id", "left")
        .withColumn("ordinal", F.coalesce(F.col("_top"), F.lit(0)) + F.col("ordinal")).drop("_top")
    )
    kept = current.join(incoming.select(*KEY), KEY, "left_anti")
    return kept.unionByName(moved.select(*current.columns))


def changed_targets(before: DataFrame, after: DataFrame, payload: list[str]) -> DataFrame:
    """Targets with an added, removed or different last payload for any operation."""
    def content(log: DataFrame, name: str) -> DataFrame:
        packed = F.to_json(F.struct(*[F.col(c) for c in payload]), {"ignoreNullFields": "false"})
        return log.groupBy(*KEY).agg(F.max_by(F.sha2(packed, 256), "ordinal").alias(name))

    joined = content(before, "_old").join(content(after, "_new"), KEY, "full")
    return joined.where(~F.col("_old").eqNullSafe(F.col("_new"))).select("area_id", "target_id").distinct()
