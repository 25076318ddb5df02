"""Snapshot register: reuse, insert-ignore, counts and refresh differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.operators.ranking import latest_per_key, top_per_group

REUSABLE = 5


def recent_originals(snapshots: DataFrame, count: int = REUSABLE, time: str = "retrieved_at",
                     derived: str = "is_derived") -> DataFrame:
    """Most recent snapshots per provider and query version that were not cut from another one."""
    return top_per_group(
        snapshots.where(~F.col(derived)), ["provider", "query_version"], [F.col(time).desc(), F.col("snapshot_id").desc()], count
    )


def feature_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("snapshot_id").agg(F.count("*").alias("feature_count"))


def exact_reuse(requests: DataFrame, snapshots: DataFrame, features: DataFrame, keys: list[str],
                time: str = "retrieved_at") -> DataFrame:
    """Latest snapshot with the same request keys and its feature count; requests without one keep nulls.

    The newest snapshot per key is found before the join, so a popular request does not multiply rows.
    """
    newest = latest_per_key(snapshots.select(*keys, "snapshot_id", time), keys, [time, "snapshot_id"])
    counted = newest.join(feature_counts(features), "snapshot_id", "left").withColumn(
        "feature_count", F.coalesce("feature_count", F.lit(0))
    )
    return requests.join(counted.drop(time), keys, "left")


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Rows to append: the first incoming row of each key that is not stored yet."""
    rest = [c for c in incoming.columns if c not in keys]
    first = incoming.groupBy(*keys).agg(F.min_by(F.struct(*rest), position).alias("_row")).select(*keys, "_row.*")
    return first.join(existing.select(*keys), keys, "left_anti")


def resolve_ids(existing: DataFrame, incoming: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """Identifier under which each incoming row is stored: the existing one, else its own."""
    stored = existing.select(*keys, F.col(id_column).alias("_stored"))
    return incoming.join(stored, keys, "left").withColumn(id_column, F.coalesce("_stored", id_column)).drop("_stored")


def refresh_diff(before: DataFrame, after: DataFrame, keys: list[str], content: str = "geometry_hash") -> DataFrame:
    """Status of each feature between two snapshots: added, removed, changed or same."""
    old = before.select(*keys, F.col(content).alias("_old"), F.lit(True).alias("_was"))
    new = after.select(*keys, F.col(content).alias("_new"), F.lit(True).alias("_is"))
    return old.join(new, keys, "full").select(
        *keys,
        F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("changed").alias("status"),
    )


def orphaned(references: DataFrame, features: DataFrame, reference: str, key: str) -> DataFrame:
    """References, such as overrides, whose feature no longer exists."""
    known = features.select("area_id", F.col(key).alias(reference))
    return references.join(known, ["area_id", reference], "left_anti")
