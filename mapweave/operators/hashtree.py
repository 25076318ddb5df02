"""Hash trees over chunk signatures: one hash names a whole plan, and two plans are compared along changed branches only.

Chunks are the leaves of a quadtree. A node's hash is made of its children's, at most four, so nothing is collected and a level
combines before its shuffle. A node with a single child takes the child's hash: the root does not depend on the tree's height.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.session import cut_lineage

LEVELS = 20  # chunks up to half a million from the anchor either way
NODE = ["area_id", "nx", "nz"]


def parents(nodes: DataFrame) -> DataFrame:
    """The next level of ``area_id, nx, nz, hash``."""
    child = F.pmod(F.col("nx"), F.lit(2)) * 2 + F.pmod(F.col("nz"), F.lit(2))
    up = nodes.select("area_id", F.shiftright("nx", 1).alias("nx"), F.shiftright("nz", 1).alias("nz"), child.alias("child"), "hash")
    named = [F.max(F.when(F.col("child") == n, F.concat(F.lit(f"{n}:"), F.col("hash")))).alias(f"_{n}") for n in range(4)]
    grouped = up.groupBy(*NODE).agg(F.count("*").alias("_n"), F.max("hash").alias("_only"), *named)
    joined = F.sha2(F.concat_ws("|", *[f"_{n}" for n in range(4)]), 256)
    return grouped.select(*NODE, F.when(F.col("_n") == 1, F.col("_only")).otherwise(joined).alias("hash"))


def hash_tree(signatures: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``area_id, level, nx, nz, hash`` of all nodes; level 0 are the chunks, the last level is one root an area.

    Signatures: ``area_id, chunk_x, chunk_z, signature``.
    """
    half = 1 << (levels - 1)  # shifted by half, all indexes are positive and meet in one root
    nodes = cut_lineage(signatures.select("area_id", (F.col("chunk_x") + half).alias("nx"), (F.col("chunk_z") + half).alias("nz"), F.col("signature").alias("hash")))
    floors = [nodes]
    for level in range(levels):
        nodes = parents(nodes)
        if level % 5 == 4:
            nodes = cut_lineage(nodes)
        floors.append(nodes)
    return cut_lineage(reduce(DataFrame.unionByName, [f.withColumn("level", F.lit(n)) for n, f in enumerate(floors)])).select(
        "area_id", "level", "nx", "nz", "hash"
    )


def roots(tree: DataFrame) -> DataFrame:
    """``area_id, build_hash``."""
    top = tree.groupBy("area_id").agg(F.max("level").alias("level"))
    return tree.join(top, ["area_id", "level"]).select("area_id", F.col("hash").alias("build_hash"))


def changed_nodes(before: DataFrame, after: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``area_id, level, nx, nz`` of the nodes that differ, found from the roots down: equal branches are not entered."""
    found, above = [], None
    for level in range(levels, -1, -1):
        old, new = (t.where(F.col("level") == level).select(*NODE, "hash") for t in (before, after))
        if above is not None:
            # Only children of changed nodes take part; the list is as short as the change.
            inside = above.select("area_id", F.col("nx").alias("ux"), F.col("nz").alias("uz"))
            old, new = (
                t.withColumns({"ux": F.shiftright("nx", 1), "uz": F.shiftright("nz", 1)}).join(inside, ["area_id", "ux", "uz"], "left_semi").drop("ux", "uz")
                for t in (old, new)
            )
        both = old.withColumnRenamed("hash", "_old").join(new.withColumnRenamed("hash", "_new"), NODE, "full")
        above = cut_lineage(both.where(~F.col("_old").eqNullSafe(F.col("_new"))).select("area_id", F.lit(level).alias("level"), "nx", "nz"))
        found.append(above)
        if above.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def changed_chunks(before: DataFrame, after: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Chunks that appear, vanish or change between two trees: ``area_id, chunk_x, chunk_z``."""
    half = 1 << (levels - 1)
    return changed_nodes(before, after, levels).where("level = 0").select(
        "area_id", (F.col("nx") - half).alias("chunk_x"), (F.col("nz") - half).alias("chunk_z")
    )
