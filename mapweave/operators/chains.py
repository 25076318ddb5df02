"""Roads between junctions as single edges.

Most nodes of a road graph have two neighbours and only pass a path on. ``contract`` follows every chain of them from both ends
at once, by pointer doubling: a chain of n nodes takes log(n) rounds, whatever lies beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.session import cut_lineage

EDGE = ["area_id", "a", "b"]
SAME = 1e-9  # metres; sums of one path differ by rounding with their order


def contract(edges: DataFrame, stops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(short, inner) of symmetric edges ``area_id, src, dst, length``; nodes of ``stops`` (``area_id, node``) are kept.

    ``short``: ``area_id, src, dst, length, direct, toward`` between kept nodes, the shortest with and without nodes in between
    (``direct`` is an edge of the graph); ``toward`` is the node after ``src``. ``inner``: ``area_id, node, end, length,
    toward`` of the others, one row for each end of their chain. Rings without a kept node are unreachable and left out.
    """
    edges = cut_lineage(edges.where(F.col("src") != F.col("dst")).groupBy("area_id", "src", "dst").agg(F.min("length").alias("length")))
    two = edges.groupBy("area_id", F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("dst").alias("lo"), F.max("dst").alias("hi")).where("n = 2")
    passing = cut_lineage(two.join(stops.select("area_id", "node").distinct(), ["area_id", "node"], "left_anti").drop("n"))
    # A way from a over b: its end so far, the node before that, its length, and the edge that goes on where it does.
    onward = passing.select("area_id", F.col("node").alias("b"), "lo", "hi")
    ways = edges.toDF("area_id", "a", "b", "length").join(onward, ["area_id", "b"], "left").select(
        *EDGE, F.col("b").alias("end"), F.col("a").alias("last"), "length",
        F.when(F.col("lo").isNotNull(), F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))).alias("next"),
    )
    ways = cut_lineage(ways)
    done, going = ways.where("next IS NULL"), ways.where("next IS NOT NULL")
    left = going.count()
    while left:
        step = done.unionByName(going).select(
            "area_id", F.col("a").alias("end"), F.col("b").alias("next"), F.col("end").alias("end2"), F.col("last").alias("last2"),
            F.col("length").alias("length2"), F.col("next").alias("next2"),
        )
        moved = going.join(step, ["area_id", "end", "next"]).select(
            *EDGE, F.col("end2").alias("end"), F.col("last2").alias("last"), (F.col("length") + F.col("length2")).alias("length"), F.col("next2").alias("next")
        )
        moved = cut_lineage(moved)
        done, going, before = done.unionByName(moved.where("next IS NULL")), moved.where("next IS NOT NULL"), left
        left = going.count()
        if left == before:  # only rings without a kept node go on for ever
            break
    done = cut_lineage(done)
    inside = passing.select("area_id", F.col("node").alias("a"))
    inner = done.join(inside, ["area_id", "a"], "left_semi").select("area_id", F.col("a").alias("node"), "end", "length", F.col("b").alias("toward"))
    pair = ["area_id", "src", "dst", "direct"]
    between = done.join(inside, ["area_id", "a"], "left_anti").where(F.col("a") != F.col("end")).select(
        "area_id", F.col("a").alias("src"), F.col("end").alias("dst"), (F.col("b") == F.col("end")).alias("direct"), "length", F.col("b").alias("toward")
    )
    least = between.groupBy(*pair).agg(F.min("length").alias("least"))
    # Of chains that are equal but for rounding, the one with the lower first node.
    short = between.join(least, pair).where(F.col("length") <= F.col("least") + SAME).groupBy(*pair, F.col("least").alias("length")).agg(
        F.min("toward").alias("toward")
    )
    return short, inner
