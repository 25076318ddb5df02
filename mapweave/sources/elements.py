"""Element documents, extraction by tag and area, and the raw archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.functions.measure import tag
from mapweave.operators.spatial import line_hits
from mapweave.schemas import DOCUMENTS

# Element types and tag keys that an import asks for.
WANTED = (
    ("way", "highway"), ("way", "building"), ("way", "building:part"), ("relation", "building"),
    ("relation", "building:part"), ("way", "landuse"), ("relation", "landuse"), ("way", "leisure"), ("relation", "leisure"),
    ("way", "natural"), ("relation", "natural"), ("way", "waterway"), ("way", "barrier"),
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Element documents (``.json`` or ``.json.gz``), one row per document with its area."""
    return spark.read.schema(DOCUMENTS).option("multiLine", True).json(path)


def explode_elements(documents: DataFrame) -> DataFrame:
    """One row per element, with its position in the document."""
    return documents.select("area_id", F.posexplode("elements").alias("position", "_e")).select("area_id", "position", "_e.*")


def wanted_element() -> Column:
    rule = F.lit(False)
    for kind, key in WANTED:
        rule = rule | ((F.col("type") == kind) & tag(F.col("tags"), key).isNotNull())
    return rule


def element_lines() -> Column:
    """Lines of an element, each with whether it bounds a hole: its own geometry, or one line per member of a relation."""
    def line(points: Column, hole: Column) -> Column:
        flat = F.transform(F.coalesce(points, F.array()), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
        return F.struct(flat.alias("ring"), hole.alias("hole"))

    own = F.array(line(F.col("geometry"), F.lit(False)))
    members = F.transform(F.coalesce("members", F.array()), lambda m: line(m["geometry"], F.coalesce(m["role"] == "inner", F.lit(False))))
    return F.when(F.col("type") == "relation", members).otherwise(own)


def extract(elements: DataFrame, areas: DataFrame) -> DataFrame:
    """Elements with a wanted tag that intersect their area's ring. Areas: ``area_id, area_ring``.

    Each line is tested by itself, so members that lie apart are not joined by an edge that is not there. An area wholly
    inside a closed line counts unless a hole of the element holds it too.
    """
    key = ["area_id", "position"]
    picked = elements.where(wanted_element())
    lines = picked.select(*key, F.explode(element_lines()).alias("_l")).select(*key, "_l.*").where(F.size("ring") > 0)
    met = line_hits(lines, areas).groupBy(*key).agg(
        F.bool_or("touches").alias("touches"), F.bool_or(F.col("holds") & ~F.col("hole")).alias("holds"),
        F.bool_or(F.col("holds") & F.col("hole")).alias("in_hole"),
    )
    return picked.join(met.where(F.col("touches") | (F.col("holds") & ~F.col("in_hole"))), key, "left_semi")


def archive(documents: DataFrame, path: str) -> None:
    """Write raw documents under their content hash; the committer publishes complete files only."""
    text = F.to_json(F.struct("version", "generator", "elements"))
    documents.select(text.alias("value")).withColumn("content_hash", F.sha2("value", 256)).dropDuplicates(
        ["content_hash"]
    ).write.mode("append").option("compression", "gzip").partitionBy("content_hash").text(path)
