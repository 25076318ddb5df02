"""Road graph: nodes, edges, degrees, shortest paths and path extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.functions.text import half_up
from mapweave.operators.chains import SAME, contract
from mapweave.operators.grid import within_distance
from mapweave.operators.junctions import INDEX_BITS
from mapweave.operators.lines import gap
from mapweave.operators.ordered import neighbors
from mapweave.operators.snapping import first_come_nodes
from mapweave.session import cut_lineage

SHORTEST_EDGE = 0.05
HOPS = 4
PARTS_PER_CUT = 8


def node_key(x: Column, z: Column, layer: Column) -> Column:
    """Decimetre key with the layer."""
    return F.concat_ws(":", half_up(x, 10.0).cast("string"), half_up(z, 10.0).cast("string"), F.format_string("%.0f", layer))


def metre_key(x: Column, z: Column) -> Column:
    return F.concat_ws(":", half_up(x).cast("string"), half_up(z).cast("string"))


def road_legs(points: DataFrame, block: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Distinct edges along roads: their two ends, ``length`` and the ``carry`` columns, with the first and last place ``lo, hi`` in road order.

    Points: ``area_id, way_id, idx, layer, x, z`` (and ``y``).
    """
    axes = [c for c in ("x", "z", "y") if c in points.columns]
    keyed = points.withColumn("node", node_key(F.col("x"), F.col("z"), F.col("layer").cast("double")))
    near = neighbors(keyed, ["area_id", "way_id"], "idx", ["node", *axes], after="_next", block=block)
    length = gap(F.col("x"), F.col("z"), F.col("_next.x"), F.col("_next.z"))
    parts = near.where(F.col("_next").isNotNull()).withColumn("length", length).where(F.col("length") >= SHORTEST_EDGE)
    # One number ranks points by road and index, so all aggregates are hash aggregates.
    order = F.shiftleft(F.col("way_id").cast("long"), INDEX_BITS) + F.col("idx")
    ends = [F.col("node").alias("a"), *[F.col(c).alias(f"a{c}") for c in axes], F.col("_next.node").alias("b"), *[F.col(f"_next.{c}").alias(f"b{c}") for c in axes]]
    flat = parts.select("area_id", *carry, *ends, "length", order.alias("_o"))
    return flat.groupBy(*[c for c in flat.columns if c != "_o"]).agg(F.min("_o").alias("lo"), F.max("_o").alias("hi"))


def graph_of(legs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and directed edges of ``road_legs``. Parallel edges keep the first road's length; a vertex keeps its last point."""
    axes = [c for c in ("x", "z", "y") if f"a{c}" in legs.columns]
    both = legs.select("area_id", "lo", "length", F.explode(F.array(
        F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")),
    )).alias("_e")).select("area_id", "lo", "length", "_e.src", "_e.dst")
    edges = both.groupBy("area_id", "src", "dst").agg(F.min_by("length", "lo").alias("length"))
    ends = legs.select("area_id", F.explode(F.array(*[
        F.struct(F.col(n).alias("node"), (F.col("hi") * 2 + late).alias("o"), *[F.col(f"{n}{c}").alias(c) for c in axes]) for late, n in enumerate("ab")
    ])).alias("_v")).select("area_id", "_v.*")
    vertices = ends.groupBy("area_id", "node").agg(*[F.max_by(c, "o").alias(c) for c in axes])
    return vertices, edges


def road_graph(points: DataFrame, block: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices and directed edges of roads. Points as of ``road_legs``."""
    return graph_of(road_legs(points, block))


def degrees(parts: DataFrame) -> DataFrame:
    """Distinct neighbours of each metre key, layers ignored."""
    a, b = metre_key(F.col("ax"), F.col("az")), metre_key(F.col("bx"), F.col("bz"))
    both = parts.select("area_id", F.explode(F.array(
        F.struct(a.alias("node"), b.alias("other")), F.struct(b.alias("node"), a.alias("other"))
    )).alias("_e")).select("area_id", "_e.*").distinct()
    return both.groupBy("area_id", "node").agg(F.count("*").alias("degree"))


def shortest_distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Distance and predecessor of every node reachable from each source: ``area_id, source, node, dist, prev``.

    Sources: ``area_id, source, node`` and optionally ``ex_a, ex_b``, an edge the search must not use. Roads between junctions
    are contracted first. All sources then search together, and each round only what improved in the last one is passed on,
    ``HOPS`` junctions far; what has settled is looked up, not passed on. Nodes inside roads take the better end at last.
    Paths that are equal but for rounding go to the lower predecessor.
    """
    ban = [c for c in ("ex_a", "ex_b") if c in sources.columns]
    key = ["area_id", "source", "node"]
    sources = cut_lineage(sources.select(*key, *ban))
    stops = [sources.select("area_id", F.col(c).alias("node")) for c in ("node", *ban)]
    short, inner = contract(edges, reduce(DataFrame.unionByName, stops).where("node IS NOT NULL"))
    short, inner = cut_lineage(short), cut_lineage(inner)
    allowed = F.lit(True)
    if ban:
        pairs = [F.col(x).eqNullSafe(F.col("node")) & F.col(y).eqNullSafe(F.col("dst")) for x, y in (ban, ban[::-1])]
        allowed = ~(F.col("direct") & (pairs[0] | pairs[1]))
        # Columns of their own: one search table meets another that came from the same rows.
        banned = sources.select(*[F.col(c).alias(c) for c in ("area_id", "source", *ban)]).distinct()
    graph = short.select("area_id", F.col("src").alias("node"), "dst", "length", "direct")

    def passed_on(rows: DataFrame) -> DataFrame:
        met = rows.join(graph, ["area_id", "node"])
        met = (met.join(banned, ["area_id", "source"]) if ban else met).where(allowed)
        return met.select("area_id", "source", F.col("dst").alias("node"), (F.col("dist") + F.col("length")).alias("dist"))

    def least(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*key).agg(F.min("dist").alias("dist"))

    front = cut_lineage(sources.select(*key, F.lit(0.0).alias("dist")))
    settled, parts = front, 1
    while not front.isEmpty():
        reached = front
        for _ in range(HOPS):
            reached = least(reached.unionByName(passed_on(reached)))
        offers = cut_lineage(reached)
        known = least(settled.join(offers.select(*key), key, "left_semi")).withColumnRenamed("dist", "known")
        front = cut_lineage(offers.join(known, key, "left").where("known IS NULL OR dist < known").drop("known"))
        settled, parts = settled.unionByName(front), parts + 1
        if parts > PARTS_PER_CUT:
            settled, parts = cut_lineage(least(settled)), 1
    settled = cut_lineage(least(settled))

    def by_ends(ways: DataFrame) -> DataFrame:
        """Nodes with the ways to the ends that they can be reached from; the first node of such a way is the last before them."""
        met = ways.join(settled.withColumnRenamed("node", "end"), ["area_id", "end"])
        offered = met.select(*key, (F.col("dist") + F.col("length")).alias("dist"), F.col("toward").alias("prev"))
        best = offered.groupBy(*key).agg(F.min("dist").alias("least"))
        return offered.join(best, key).where(F.col("dist") <= F.col("least") + SAME).groupBy(*key, F.col("least").alias("dist")).agg(
            F.min("prev").alias("prev")
        )

    back = short.select("area_id", F.col("src").alias("node"), "dst", "length", "direct", "toward")
    before = back.withColumnRenamed("dst", "end").join(settled.withColumnRenamed("node", "end").withColumnRenamed("dist", "far"), ["area_id", "end"])
    if ban:
        before = before.withColumnRenamed("end", "dst").join(banned, ["area_id", "source"]).where(allowed).withColumnRenamed("dst", "end")
    offered = before.join(settled, key).where(F.col("far") < F.col("dist")).withColumn("sum", F.col("far") + F.col("length"))
    best = offered.groupBy(*key).agg(F.min("sum").alias("least"))
    prev = offered.join(best, key).where(F.col("sum") <= F.col("least") + SAME).groupBy(*key).agg(F.min("toward").alias("prev"))
    kept = settled.join(prev, key, "left").select(*key, "dist", "prev")
    return cut_lineage(kept.unionByName(by_ends(inner)))  # callers read it several times


def routes_to_goal(edges: DataFrame, goals: DataFrame) -> DataFrame:
    """Distance and next hop from every node to its goal. Goals: ``area_id, source, node``; edges are symmetric."""
    return shortest_distances(edges, goals).select("area_id", "source", "node", "dist", F.col("prev").alias("next"))


def farthest(distances: DataFrame) -> DataFrame:
    """Farthest reachable node of each source; the lowest key wins a tie."""
    return distances.groupBy("area_id", "source").agg(
        F.min(F.struct((-F.col("dist")).alias("_m"), "node")).alias("_f")
    ).select("area_id", "source", "_f.node", (-F.col("_f._m")).alias("dist"))


def paths(distances: DataFrame, ends: DataFrame) -> DataFrame:
    """Nodes of the path from each source to an end node: ``area_id, source, end, node, dist``, in order of distance.

    Follows predecessor links by doubling, so a path of n nodes takes log(n) rounds. Ends: ``area_id, source, end``.
    """
    key = ["area_id", "source"]
    tree = cut_lineage(distances.join(ends.select(*key).distinct(), key, "left_semi"))
    jump = tree.where("prev IS NOT NULL").select(*key, "node", F.col("prev").alias("up"))
    reached = ends.select(*key, "end", F.col("end").alias("node"))
    while True:
        more = reached.join(jump, [*key, "node"]).select(*key, "end", F.col("up").alias("node"))
        reached = cut_lineage(reached.unionByName(more).distinct())
        far = jump.select(*key, F.col("node").alias("up"), F.col("up").alias("far"))
        jump = cut_lineage(jump.join(far, [*key, "up"]).select(*key, "node", F.col("far").alias("up")))
        if jump.isEmpty():
            break
    return reached.join(tree.select(*key, "node", "dist"), [*key, "node"])


def snapped_graph(points: DataFrame, radius: float = 1.5, block: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Graph in which points closer than the radius to an earlier node are that node; tunnels are left out.

    Points come in order of road and index. A place becomes a node where no earlier node lies within the radius; every
    point goes to such a node, of several to that in the first cell of twice the radius, then to the earliest.
    """
    open_roads = points.where(~F.col("tunnel")).withColumn("area_id", F.col("area_id").cast("long"))
    axes = [c for c in ("x", "z", "y") if c in points.columns]
    ordinal = F.concat_ws("/", F.lpad(F.col("way_id").cast("string"), 12, "0"), F.lpad(F.col("idx").cast("string"), 8, "0"))
    numbered = open_roads.withColumn("_at", ordinal)
    # Copies of a place are compared once.
    places = cut_lineage(numbered.groupBy("area_id", "x", "z").agg(F.min("_at").alias("node"), F.min_by(F.struct(*axes), "_at").alias("_p")))
    probes = places.select("area_id", F.col("node").alias("a"), F.col("x").alias("px"), F.col("z").alias("pz"))

    def spots(df: DataFrame) -> DataFrame:
        return df.select(
            "area_id", F.col("node").alias("b"), F.col("x").alias("ax"), F.col("z").alias("az"), F.col("x").alias("bx"), F.col("z").alias("bz")
        )

    chosen = first_come_nodes(places, radius)
    nodes = cut_lineage(places.join(chosen, ["area_id", "node"], "left_semi").select("area_id", "node", "x", "z", "_p"))
    near = within_distance(probes, spots(nodes), radius, size=2 * radius).where(F.col("distance") < radius)
    offers = near.select(
        "area_id", "px", "pz", F.struct(F.floor(F.col("ax") / (2 * radius)).alias("gx"), F.floor(F.col("az") / (2 * radius)).alias("gz"), "b").alias("o")
    )
    met = numbered.select("area_id", "way_id", "idx", "_at", F.col("x").alias("px"), F.col("z").alias("pz")).join(offers, ["area_id", "px", "pz"])
    homes = met.where(F.col("o.b") <= F.col("_at")).groupBy("area_id", "way_id", "idx").agg(F.min("o").alias("o")).select(
        "area_id", "way_id", "idx", F.col("o.b").alias("node")
    )
    rooted = homes.join(nodes.select("area_id", "node", "_p"), ["area_id", "node"])
    walked = neighbors(rooted, ["area_id", "way_id"], "idx", ["node", "_p"], after="_next", block=block)
    moved = walked.where(F.col("_next").isNotNull() & (F.col("node") != F.col("_next.node")))
    cost = F.sqrt(sum((F.col(f"_p.{c}") - F.col(f"_next._p.{c}")) * (F.col(f"_p.{c}") - F.col(f"_next._p.{c}")) for c in axes))
    both = moved.select("area_id", cost.alias("length"), F.explode(F.array(
        F.struct(F.col("node").alias("src"), F.col("_next.node").alias("dst")),
        F.struct(F.col("_next.node").alias("src"), F.col("node").alias("dst")),
    )).alias("_e")).select("area_id", "length", "_e.*")
    edges = both.groupBy("area_id", "src", "dst").agg(F.min("length").alias("length"))
    return nodes.select("area_id", "node", "_p.*"), edges


def nearest_node(vertices: DataFrame, edges: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Nearest node that has an edge. Wanted: ``area_id``, ``keys``, ``px, pz``."""
    from mapweave.operators.grid import nearest_segment

    used = vertices.join(edges.select("area_id", F.col("src").alias("node")).distinct(), ["area_id", "node"], "left_semi")
    spots = used.select(
        "area_id", "node", F.col("x").alias("ax"), F.col("z").alias("az"), F.col("x").alias("bx"), F.col("z").alias("bz")
    )
    return nearest_segment(wanted, spots, keys, ["node"], []).select("area_id", *keys, "node", "distance")
