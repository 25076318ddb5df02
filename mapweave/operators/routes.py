"""Circuits on the road graph and their quality, turns, checkpoints and barriers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapweave.functions.text import half_up
from mapweave.operators.grid import distinct_segments, nearest_segment, within_distance
from mapweave.operators.lines import cumulative_distance, gap
from mapweave.operators.network import degrees, farthest, graph_of, metre_key, node_key, paths, road_legs, shortest_distances
from mapweave.operators.ordered import neighbors
from mapweave.operators.ranking import top_per_group
from mapweave.session import FEW_CELLS, cut_lineage

COURSE = ["area_id", "course_id"]
# Width filters, turn rule, checkpoint spacing and barrier rule.
WIDTH_FILTERS = (0.0, 5.5, 6.5)
TURN_ANGLE = math.pi / 5
TURN_MARGIN, TURN_SPACING = 35.0, 28.0
CHECKPOINT_SPACING, CHECKPOINT_END = 125.0, 30.0
BARRIER_REACH, BARRIER_DOT, BARRIER_COUNT = 0.8, 0.82, 24


def start_edges(starts: DataFrame, parts: DataFrame) -> DataFrame:
    """Nearest segment of at least a decimetre for each start; the first road and segment win a tie.

    Starts: ``area_id, start_id, px, pz, hx, hz``; parts carry ``way_id, idx, layer, width``.
    """
    long_enough = parts.where(
        (F.col("bx") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("bz") - F.col("az")) * (F.col("bz") - F.col("az")) >= 0.01
    )
    lines = distinct_segments(long_enough, ["way_id", "idx"], ["layer", "width"])
    best = nearest_segment(starts, lines, ["start_id"], ["way_id", "idx"], ["layer", "width"])
    layer = F.col("layer").cast("double")
    return best.join(starts.select("area_id", "start_id", "hx", "hz"), ["area_id", "start_id"]).select(
        "area_id", "start_id", "hx", "hz", F.col("width").alias("road_width"),
        node_key(F.col("ax"), F.col("az"), layer).alias("from"), node_key(F.col("bx"), F.col("bz"), layer).alias("to"),
        (F.col("ax") + (F.col("bx") - F.col("ax")) * F.col("ratio")).alias("sx"),
        (F.col("az") + (F.col("bz") - F.col("az")) * F.col("ratio")).alias("sz"),
    )


def turns(course_points: DataFrame) -> DataFrame:
    """Turn distances: bearing changes above 36 degrees, away from the ends and from the last accepted turn."""
    measured = cumulative_distance(course_points, COURSE, "idx", "distance", "length")
    by = Window.partitionBy(*COURSE).orderBy("idx")
    spread = measured.withColumns({
        "_bx": F.lag("x", 2).over(by), "_bz": F.lag("z", 2).over(by), "_ax": F.lead("x", 2).over(by), "_az": F.lead("z", 2).over(by),
    })
    into = F.atan2(F.col("x") - F.col("_bx"), F.col("z") - F.col("_bz"))
    out = F.atan2(F.col("_ax") - F.col("x"), F.col("_az") - F.col("z"))
    bend = F.atan2(F.sin(out - into), F.cos(out - into))
    sharp = spread.where(
        (F.abs(bend) > TURN_ANGLE) & (F.col("distance") > TURN_MARGIN) & (F.col("distance") < F.col("length") - TURN_MARGIN)
    )

    def accept(kept: Column, d: Column) -> Column:
        far = F.coalesce(d - F.element_at(kept, -1) > TURN_SPACING, F.lit(True))
        return F.when(far, F.concat(kept, F.array(d))).otherwise(kept)

    # A course is bounded by its length, so its candidates fit into one array.
    listed = sharp.groupBy(*COURSE).agg(F.array_sort(F.collect_list("distance")).alias("_d"))
    return listed.select(*COURSE, F.explode(F.aggregate(
        F.slice("_d", 2, F.greatest(F.size("_d") - 1, F.lit(0))), F.slice("_d", 1, 1), accept
    )).alias("distance"))


def checkpoints(lengths: DataFrame, spacing: float = CHECKPOINT_SPACING) -> DataFrame:
    """Checkpoint distances at every spacing, none in the last thirty metres, and the finish."""
    count = F.greatest(F.lit(0), F.ceil((F.col("length") - CHECKPOINT_END) / spacing) - 1).cast("int")
    inner = F.transform(F.sequence(F.lit(0), count), lambda i: i * F.lit(spacing))
    each = F.concat(F.slice(inner, 2, F.greatest(F.size(inner) - 1, F.lit(0))), F.array(F.col("length")))
    return lengths.select(*COURSE, F.posexplode(each).alias("checkpoint", "distance"))


def widths_along(course_points: DataFrame, parts: DataFrame) -> DataFrame:
    """Width of the nearest road segment of a decimetre or more at each distinct route place; five metres where there is none."""
    parts = parts.where(gap(F.col("ax"), F.col("az"), F.col("bx"), F.col("bz")) >= 0.1)
    spots = course_points.select("area_id", F.col("x").alias("px"), F.col("z").alias("pz")).distinct().withColumn(
        "spot", F.concat_ws("|", F.col("px").cast("string"), F.col("pz").cast("string"))
    )
    lines = distinct_segments(parts, ["way_id", "idx"], ["width"])
    near = nearest_segment(spots, lines, ["spot"], ["way_id", "idx"], ["width"]).select("area_id", "spot", "width")
    return spots.join(near, ["area_id", "spot"], "left").select(
        "area_id", F.col("px").alias("x"), F.col("pz").alias("z"), F.coalesce("width", F.lit(5.0)).alias("width")
    )


def quality(course_points: DataFrame, parts: DataFrame, turn_rows: DataFrame) -> DataFrame:
    """Ascent, steepest grade, mean width, intersections, repetition, score and difficulty of each course."""
    measured = cumulative_distance(course_points, COURSE, "idx", "distance", "length")
    near = neighbors(measured, COURSE, "idx", ["x", "z", "y"], before="_prev")
    run = gap(F.col("_prev.x"), F.col("_prev.z"), F.col("x"), F.col("z"))
    rise = F.col("y") - F.col("_prev.y")
    flat = near.withColumns({
        "_up": F.greatest(F.lit(0.0), F.coalesce(rise, F.lit(0.0))), "_key": metre_key(F.col("x"), F.col("z")),
        "_grade": F.when(run > 0.1, F.abs(rise / F.nullif(run, F.lit(0.0)))),
    })
    joined = flat.join(widths_along(course_points, parts), ["area_id", "x", "z"]).join(
        degrees(parts).where("degree >= 3").select("area_id", F.col("node").alias("_key"), F.lit(True).alias("_cross")),
        ["area_id", "_key"], "left",
    )
    base = joined.groupBy(*COURSE).agg(
        F.max("length").alias("length"), F.sum("_up").alias("elevation_gain"),
        F.coalesce(F.max("_grade"), F.lit(0.0)).alias("max_grade"), F.avg("width").alias("average_width"),
        (1 - F.countDistinct("_key") / F.count("*")).alias("repetition"),
        F.countDistinct(F.when(F.col("_cross"), F.col("_key"))).alias("intersections"),
    )
    counted = base.join(turn_rows.groupBy(*COURSE).agg(F.count("*").alias("turns")), COURSE, "left").withColumn(
        "turns", F.coalesce("turns", F.lit(0))
    )
    variety = F.least(F.lit(1.0), F.col("turns") / F.greatest(F.lit(4.0), F.col("length") / 180))
    raw = (
        72 + F.least(F.lit(12.0), (F.col("average_width") - 4.5) * 4) + variety * 10 + F.least(F.lit(6), F.col("intersections"))
        - F.col("max_grade") * 120 - F.col("repetition") * 28
    )
    technical = (
        F.col("turns") / F.greatest(F.lit(1.0), F.col("length") / 1000) + F.col("max_grade") * 35
        + F.greatest(F.lit(0.0), 6 - F.col("average_width"))
    )
    return counted.withColumns({
        "score": half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))),
        "difficulty": F.when(technical >= 10, "Challenging").when(technical >= 5, "Technical").otherwise("Easy"),
    })


def barriers(course_points: DataFrame, road_points: DataFrame) -> DataFrame:
    """Barrier places on the branches a route does not take, the first 24 in route order."""
    near = neighbors(course_points, COURSE, "idx", ["x", "z"], before="_prev", after="_next").where(
        F.col("_prev").isNotNull() & F.col("_next").isNotNull()
    )
    visits = near.groupBy(*COURSE, "x", "z", "_prev", "_next").agg(F.min("idx").alias("idx"))

    def toward(p: str) -> Column:
        away = gap(F.col("x"), F.col("z"), F.col(f"{p}.x"), F.col(f"{p}.z"))
        safe = F.when(away > 0, away).otherwise(1.0)
        return F.struct(((F.col(f"{p}.x") - F.col("x")) / safe).alias("x"), ((F.col(f"{p}.z") - F.col("z")) / safe).alias("z"))

    place = ["area_id", "px", "pz"]
    asked = visits.select(*COURSE, "idx", F.col("x").alias("px"), F.col("z").alias("pz"), toward("_prev").alias("_u"), toward("_next").alias("_v"))
    # Which branches a visit has depends on its place and directions alone: each is worked out once, whatever courses pass there.
    shapes = cut_lineage(asked.select(*place, "_u", "_v").distinct())
    linked = neighbors(road_points, ["area_id", "way_id"], "idx", ["x", "z", "y"], before="_before", after="_after")
    branch = ["area_id", "ax", "az", "bx", "bz", "qy", "_n"]
    branches = cut_lineage(linked.select(
        "area_id", "way_id", F.col("idx").alias("at"), F.col("y").alias("qy"), F.col("x").alias("ax"), F.col("z").alias("az"),
        F.col("x").alias("bx"), F.col("z").alias("bz"), F.posexplode(F.array("_before", "_after")).alias("side", "_n"),
    ).where("_n IS NOT NULL").groupBy(*branch).agg(F.min(F.struct("way_id", "at", "side")).alias("_first"), F.count("*").alias("_copies")))
    met = cut_lineage(within_distance(shapes.select(*place).distinct(), branches, BARRIER_REACH).select(*place, "_first.*", "qy", "ax", "az", "_n", "_copies"))
    counts = cut_lineage(met.groupBy(*place).agg(F.sum("_copies").alias("_all")))
    length = gap(F.col("ax"), F.col("az"), F.col("_n.x"), F.col("_n.z"))
    dirs = shapes.join(met, place).withColumn("_l", length).where("_l >= 0.1").withColumns({
        "_dx": (F.col("_n.x") - F.col("ax")) / F.col("_l"), "_dz": (F.col("_n.z") - F.col("az")) / F.col("_l"),
    })
    used = lambda d: F.col(f"{d}.x") * F.col("_dx") + F.col(f"{d}.z") * F.col("_dz") > BARRIER_DOT
    out = F.least(F.lit(5.0), F.col("_l") * 0.45)
    row = ("way_id", "at", "side", "x", "y", "z", "yaw")
    spots_out = dirs.where(~used("_u") & ~used("_v")).select(
        *place, "_u", "_v", "way_id", "at", "side", (F.col("ax") + F.col("_dx") * out).alias("x"),
        (F.col("qy") + (F.col("_n.y") - F.col("qy")) * (out / F.col("_l"))).alias("y"),
        (F.col("az") + F.col("_dz") * out).alias("z"), F.atan2(-F.col("_dx"), -F.col("_dz")).alias("yaw"),
    )
    free = cut_lineage(spots_out.groupBy(*place, "_u", "_v", metre_key(F.col("x"), F.col("z")).alias("_k")).agg(F.min(F.struct(*row)).alias("_s")))
    counts, free = (F.broadcast(df) if df.count() <= FEW_CELLS else df for df in (counts, free))
    at_visit = Window.partitionBy(*COURSE, "idx")
    busy = asked.join(counts, place).withColumn("_all", F.sum("_all").over(at_visit)).where("_all >= 3").drop("_all")
    first = busy.join(free, [*place, "_u", "_v"]).groupBy(*COURSE, "_k").agg(F.min(F.struct("idx", *[F.col(f"_s.{c}") for c in row])).alias("_b")).select(*COURSE, "_b.*")
    return top_per_group(first, COURSE, [F.col(c) for c in ("idx", "way_id", "at", "side")], BARRIER_COUNT)


def _leg_points(nodes: DataFrame, vertices: DataFrame) -> DataFrame:
    return nodes.join(vertices, ["area_id", "node"])


def circuits(road_set: DataFrame, parts: DataFrame, starts: DataFrame, minimum: float = 1000.0) -> DataFrame:
    """Courses of all starts on one road set (``road_legs``): points ``area_id, course_id, start_id, turn, kind, idx, x, y, z``.

    For each start and orientation (``turn`` 0 follows the heading, 1 opposes it): the way back to the start edge without
    using it when that is long enough, else out-and-back legs to the farthest nodes, else nothing.
    """
    vertices, edges = graph_of(road_set)
    vertices, edges = cut_lineage(vertices), cut_lineage(edges)
    first = cut_lineage(start_edges(starts, parts))
    ends = F.explode(F.array(*[
        F.struct(F.lit(n).alias("side"), F.col(n).alias("node")) for n in ("from", "to")
    ]))
    sources = first.select("area_id", "start_id", "from", "to", ends.alias("_e")).select(
        "area_id", F.concat_ws("/", F.col("start_id").cast("string"), F.col("_e.side")).alias("source"), F.col("_e.node").alias("node"),
        F.col("from").alias("ex_a"), F.col("to").alias("ex_b"),
    )
    reach = shortest_distances(edges, sources)
    place = vertices.select("area_id", "node", "x", "z")
    a = place.select("area_id", F.col("node").alias("from"), F.col("x").alias("fx"), F.col("z").alias("fz"))
    b = place.select("area_id", F.col("node").alias("to"), F.col("x").alias("tx"), F.col("z").alias("tz"))
    based = first.join(a, ["area_id", "from"]).join(b, ["area_id", "to"])
    dot = lambda x, z: (F.col(x) - F.col("sx")) * F.col("hx") + (F.col(z) - F.col("sz")) * F.col("hz")
    ahead = F.when(dot("tx", "tz") >= dot("fx", "fz"), "to").otherwise("from")
    turned = based.withColumn("_ahead", ahead).withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "out", F.when((F.col("turn") == 0) == (F.col("_ahead") == "to"), "to").otherwise("from")
    ).withColumns({
        "source": F.concat_ws("/", F.col("start_id").cast("string"), F.col("out")),
        "other": F.concat_ws("/", F.col("start_id").cast("string"), F.when(F.col("out") == "to", "from").otherwise("to")),
        "goal": F.when(F.col("out") == "to", F.col("from")).otherwise(F.col("to")),
        "_near": F.when(F.col("out") == "to", gap(F.col("sx"), F.col("sz"), F.col("tx"), F.col("tz"))).otherwise(gap(F.col("sx"), F.col("sz"), F.col("fx"), F.col("fz"))),
        "_far": F.when(F.col("out") == "to", gap(F.col("sx"), F.col("sz"), F.col("fx"), F.col("fz"))).otherwise(gap(F.col("sx"), F.col("sz"), F.col("tx"), F.col("tz"))),
        "course_id": F.concat_ws("/", F.col("start_id").cast("string"), F.col("turn").cast("string")),
    })
    back = reach.select("area_id", "source", F.col("node").alias("goal"), F.col("dist").alias("_back"))
    most = farthest(reach)
    one = most.select("area_id", "source", F.col("node").alias("end1"), F.col("dist").alias("_d1"))
    two = most.select("area_id", F.col("source").alias("other"), F.col("node").alias("end2"), F.col("dist").alias("_d2"))
    chosen = turned.join(back, ["area_id", "source", "goal"], "left").join(one, ["area_id", "source"], "left").join(
        two, ["area_id", "other"], "left"
    ).withColumns({
        "_loop": F.coalesce(F.col("_near") + F.col("_back") + F.col("_far") >= minimum, F.lit(False)),
        "_leg1": F.col("_near") + F.coalesce("_d1", F.lit(0.0)), "_leg2": F.col("_far") + F.coalesce("_d2", F.lit(0.0)),
    }).where(F.col("_loop") | (2 * (F.col("_leg1") + F.col("_leg2")) >= minimum)).withColumn(
        "kind", F.when(F.col("_loop"), "loop").otherwise("out-and-back")
    )
    chosen = cut_lineage(chosen)
    loops = chosen.where("_loop").select("area_id", "source", F.col("goal").alias("end"), "course_id", F.lit(0).alias("leg"))
    leg1 = chosen.where("NOT _loop AND _leg1 > 0").select("area_id", "source", F.col("end1").alias("end"), "course_id", F.lit(1).alias("leg"))
    # The second leg is ridden only while the first is too short.
    leg2 = chosen.where("NOT _loop AND _leg2 > 0").where((F.col("_leg1") <= 0) | (2 * F.col("_leg1") < minimum)).select(
        "area_id", F.col("other").alias("source"), F.col("end2").alias("end"), "course_id", F.lit(2).alias("leg"))
    legs = cut_lineage(loops.unionByName(leg1).unionByName(leg2).where("end IS NOT NULL"))
    walked = paths(reach, legs.select("area_id", "source", "end").distinct())
    laid = _leg_points(legs.join(walked, ["area_id", "source", "end"]), vertices)
    top = Window.partitionBy("area_id", "course_id", "leg")
    # Order key: the leg, the way out by distance, the way back by distance from its end.
    there = laid.select(*COURSE, F.struct(F.col("leg").alias("l"), F.lit(0).alias("b"), F.col("dist").alias("d")).alias("_o"), "x", "y", "z")
    again = laid.withColumn("_top", F.max("dist").over(top)).where((F.col("leg") > 0) & (F.col("dist") < F.col("_top"))).select(
        *COURSE, F.struct(F.col("leg").alias("l"), F.lit(1).alias("b"), (-F.col("dist")).alias("d")).alias("_o"), "x", "y", "z"
    )
    home = first.join(vertices.select("area_id", F.col("node").alias("from"), F.col("y").alias("_y")), ["area_id", "from"], "left")
    gate = chosen.select(*COURSE, "start_id").join(home.select("area_id", "start_id", "sx", "sz", "_y"), ["area_id", "start_id"])
    start_row = gate.select(*COURSE, F.struct(F.lit(-1).alias("l"), F.lit(0).alias("b"), F.lit(0.0).alias("d")).alias("_o"),
                            F.col("sx").alias("x"), F.coalesce("_y", F.lit(0.0)).alias("y"), F.col("sz").alias("z"))
    closings = legs.select(*COURSE, "leg").join(gate.drop("start_id"), COURSE).select(
        *COURSE, F.struct(F.col("leg").alias("l"), F.lit(2).alias("b"), F.lit(0.0).alias("d")).alias("_o"),
        F.col("sx").alias("x"), F.coalesce("_y", F.lit(0.0)).alias("y"), F.col("sz").alias("z"),
    )
    rows = there.unionByName(again).unionByName(start_row).unionByName(closings)
    numbered = rows.withColumn("idx", F.row_number().over(Window.partitionBy(*COURSE).orderBy("_o")) - 1).drop("_o")
    return numbered.join(chosen.select(*COURSE, "start_id", "turn", "kind", "road_width"), COURSE)


def repeat_laps(course_points: DataFrame, target: float) -> DataFrame:
    """Courses repeated until they reach the target length; adds ``laps`` and ``lap_length``."""
    measured = cumulative_distance(course_points, COURSE, "idx", "_d", "lap_length").drop("_d")
    counted = measured.withColumn("_n", F.count("*").over(Window.partitionBy(*COURSE))).withColumn(
        "laps", F.greatest(F.lit(1), F.ceil(target / F.col("lap_length"))).cast("int")
    )
    each = counted.withColumn("_lap", F.explode(F.sequence(F.lit(0), F.col("laps") - 1)))
    return each.where((F.col("_lap") == 0) | (F.col("idx") > 0)).withColumn(
        "idx", (F.col("idx") + F.col("_lap") * (F.col("_n") - 1)).cast("bigint")
    ).drop("_lap", "_n")


def distinct_courses(course_points: DataFrame, order: list[str]) -> DataFrame:
    """First course of each metre-rounded signature per start."""
    marks = course_points.groupBy(*COURSE, "start_id", *order).agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", metre_key(F.col("x"), F.col("z")).alias("k")))), lambda p: p["k"]), "|"), 256).alias("_s")
    )
    first = marks.groupBy("area_id", "start_id", "_s").agg(F.min_by("course_id", F.struct(*order)).alias("course_id"))
    return course_points.join(first.select(*COURSE), COURSE, "left_semi")


def candidates(points: DataFrame, parts: DataFrame, starts: DataFrame, target: float = 1000.0, count: int = 3) -> tuple[DataFrame, DataFrame]:
    """Best courses per start over the width filters, loops first and then by score, with their points.

    ``points`` carry ``width``; a filter that drops no road of an area is skipped there. Each filter's roads count as an
    area of their own, so one search covers all filters.
    """
    filters = F.array(*[F.struct(F.lit(n).alias("set_no"), F.lit(w).alias("least")) for n, w in enumerate(WIDTH_FILTERS)])
    ways = points.select("area_id", "way_id", "width").distinct().withColumn("_f", F.explode(filters)).where(
        F.col("width") >= F.col("_f.least")
    )
    sizes = ways.groupBy("area_id", F.col("_f.set_no").alias("set_no")).agg(F.count("*").alias("_n"))
    fewer = F.col("_n") != F.coalesce(F.lag("_n").over(Window.partitionBy("area_id").orderBy("set_no")), F.lit(-1))
    used = cut_lineage(sizes.where("_n > 0").withColumn("_new", fewer).where("_new").select(
        F.col("area_id").alias("home"), "set_no", F.concat_ws("#", F.col("area_id").cast("string"), F.col("set_no").cast("string")).alias("area_id"),
        F.element_at(F.array(*[F.lit(w) for w in WIDTH_FILTERS]), F.col("set_no") + 1).alias("least"),
    ))

    def per_set(df: DataFrame, filtered: bool) -> DataFrame:
        joined = df.withColumnRenamed("area_id", "home").join(used, "home")
        return (joined.where(F.col("width") >= F.col("least")) if filtered else joined).drop("home", "set_no", "least")

    # Legs and segments of roads that lie one over the other are kept once, before each filter has a set of its own.
    shape = ["area_id", "ax", "az", "bx", "bz", "layer", "width"]
    lines = parts.groupBy(*shape).agg(F.min(F.struct("way_id", "idx")).alias("_first")).select(*shape, "_first.*")
    set_parts = cut_lineage(per_set(lines, True), wide=True)
    laid = circuits(cut_lineage(per_set(road_legs(points, carry=("width",)), True)), set_parts, per_set(starts, False), min(1000.0, target))
    every = cut_lineage(laid.join(used.drop("least"), "area_id").withColumn(
        "course_id", F.concat_ws("/", F.col("set_no").cast("string"), "course_id")
    ).drop("area_id").withColumnRenamed("home", "area_id"))
    full = cut_lineage(repeat_laps(distinct_courses(every, ["set_no", "turn"]), target))
    # Widths and crossings are those of the roads that the filter kept.
    own = cut_lineage(full.withColumnRenamed("area_id", "home").join(used.drop("least"), ["home", "set_no"]))
    scored = quality(own, set_parts, turns(own)).join(
        own.select(*COURSE, "home", "start_id", "kind", "laps", "lap_length", "set_no", "turn", "road_width").distinct(), COURSE
    ).drop("area_id").withColumnRenamed("home", "area_id")
    best = cut_lineage(top_per_group(
        scored, ["area_id", "start_id"], [F.col("kind"), F.col("score").desc(), F.col("set_no"), F.col("turn")], count
    ))
    return best, full.join(best.select(*COURSE), COURSE, "left_semi")


def summaries(best: DataFrame) -> DataFrame:
    """One descriptive row per course."""
    # Course titles by kind and difficulty.
    title = F.when(F.col("kind") != "loop", "Road Sprint").when(F.col("difficulty") == "Easy", "Flowing Circuit").when(
        F.col("difficulty") == "Technical", "Technical Circuit").otherwise("Challenge Circuit")
    return best.select(
        "area_id", "start_id",
        F.concat_ws("-", (F.col("rank") - 1).cast("string"), half_up(F.col("length")).cast("string"), F.col("score").cast("string")).alias("id"),
        F.concat_ws(" ", title, F.col("rank").cast("string")).alias("title"), "length", "lap_length", "laps", "kind", "difficulty",
        "elevation_gain", (F.col("max_grade") * 100).alias("max_grade_percent"), "average_width", F.col("turns").alias("turn_count"), "score",
    )
