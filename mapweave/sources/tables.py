"""Stored tables: snapshots, features, worlds, overrides and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mapweave.functions.geo import ring_bounds
from mapweave.operators.snapshots import insert_ignore
from mapweave.schemas import FEATURES


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The stored table, or an empty one before the first write."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)


def append_new(incoming: DataFrame, path: str, keys: list[str], position: str, partition: str | None = None) -> DataFrame:
    """Append the rows whose key is not stored yet and return the stored table."""
    spark = incoming.sparkSession
    schema = incoming.drop(position).schema
    fresh = insert_ignore(_read(spark, path, schema), incoming, keys, position).select(*schema.names)
    writer = fresh.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    return spark.read.schema(schema).parquet(path)


def write_features(features: DataFrame, path: str) -> DataFrame:
    """Feature sink: the first element of each (snapshot, source) wins, stored ones stay."""
    return append_new(features, path, ["snapshot_id", "source_id"], "position", "snapshot_id")


def read_features(spark: SparkSession, path: str, snapshot_id: str) -> DataFrame:
    """Features of one snapshot by partition, in source order."""
    stored = spark.read.schema(FEATURES).parquet(path)
    return stored.where(F.col("snapshot_id") == snapshot_id).orderBy("source_id")


def write_overrides(overrides: DataFrame, path: str) -> None:
    """Replace all overrides of the worlds that occur in the input; other worlds stay."""
    overrides.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("world_id").parquet(path)


def world_rows(worlds: DataFrame) -> DataFrame:
    """Worlds with their boundary ring as bounds, latest first."""
    return worlds.withColumn("_b", ring_bounds(F.col("boundary"))).select(
        "*", *[F.col(f"_b.{side}").alias(side) for side in ("west", "south", "east", "north")]
    ).drop("_b").orderBy(F.col("updated_at").desc())


def write_worlds(worlds: DataFrame, path: str) -> None:
    worlds.write.mode("append").parquet(path)


def find_world(spark: SparkSession, path: str, world_id: str) -> DataFrame:
    return world_rows(spark.read.parquet(path).where(F.col("world_id") == world_id))


def geojson_lines(features: DataFrame) -> DataFrame:
    """One GeoJSON feature per row, as text. Features as stored, with the tagged geometry struct."""
    pair = lambda p: F.array(p["lon"], p["lat"])
    shape, kind = F.col("geometry.polygons"), F.col("geometry.type")
    line = F.get(F.get(shape, F.lit(0)), F.lit(0))
    text = (
        F.when(kind == "Point", F.to_json(F.struct(kind.alias("type"), pair(F.get(line, F.lit(0))).alias("coordinates"))))
        .when(kind == "LineString", F.to_json(F.struct(kind.alias("type"), F.transform(line, pair).alias("coordinates"))))
        .when(kind == "Polygon", F.to_json(F.struct(
            kind.alias("type"), F.transform(F.get(shape, F.lit(0)), lambda r: F.transform(r, pair)).alias("coordinates"))))
        .otherwise(F.to_json(F.struct(
            kind.alias("type"), F.transform(shape, lambda g: F.transform(g, lambda r: F.transform(r, pair))).alias("coordinates"))))
    )
    properties = F.to_json(F.struct("source_id", "kind"))
    return features.select(F.concat(
        F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":'), text, F.lit("}")
    ).alias("value"))


def write_geojson(features: DataFrame, path: str) -> None:
    """Feature collection as newline-delimited GeoJSON."""
    geojson_lines(features).write.mode("overwrite").text(path)
