"""Road lines in long form: one row per point, ordered by an integer within (area, way)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapweave.functions.geometry import vertical_offset
from mapweave.operators.ordered import neighbors, position, running_sum

KEYS = ["area_id", "way_id"]
STEP_METRES = 4.0


def gap(ax, az, bx, bz) -> Column:
    return F.sqrt((bx - ax) * (bx - ax) + (bz - az) * (bz - az))


def segments(points: DataFrame, keys: list[str] = KEYS, order: str = "idx", carry: tuple[str, ...] = (),
             height: bool = False, block: DataFrame | None = None) -> DataFrame:
    """Consecutive points as segments ``ax, az, bx, bz`` (and ``ay, by``); ``idx`` is the start point's."""
    axes = ["x", "z", "y"] if height else ["x", "z"]
    paired = neighbors(points, keys, order, axes, after="_next", block=block).where(F.col("_next").isNotNull())
    return paired.select(
        *keys, order, *carry,
        *[F.col(axis).alias(f"a{axis}") for axis in axes], *[F.col(f"_next.{axis}").alias(f"b{axis}") for axis in axes],
    )


def cumulative_distance(points: DataFrame, keys: list[str] = KEYS, order: str = "idx", name: str = "distance",
                        total: str | None = "total", block: DataFrame | None = None) -> DataFrame:
    """Distance along the line at each point and the line's length."""
    stepped = neighbors(points, keys, order, ["x", "z"], before="_prev", block=block)
    step = F.coalesce(gap(F.col("_prev.x"), F.col("_prev.z"), F.col("x"), F.col("z")), F.lit(0.0))
    return running_sum(stepped, keys, order, step, name, total, block).drop("_prev")


def drop_repeats(points: DataFrame, keys: list[str] = KEYS, order: str = "idx", limit: float = 0.02,
                 block: DataFrame | None = None) -> DataFrame:
    """Remove points within ``limit`` of the last kept point of their line.

    A point farther than twice the limit from its predecessor is kept whatever came before, so a line falls apart into
    independent runs there. Exact repeats go first; only points of a run of several are folded, over the run so far.
    """
    near = gap(F.col("_prev.x"), F.col("_prev.z"), F.col("x"), F.col("z"))
    first = neighbors(points, keys, order, ["x", "z"], before="_prev", block=block)
    moved = first.where(F.coalesce(near > 0, F.lit(True))).drop("_prev")
    marked = neighbors(moved, keys, order, ["x", "z"], before="_prev", block=block).withColumn(
        "_start", F.when(F.coalesce(near > 2 * limit, F.lit(True)), 1).otherwise(0)
    ).drop("_prev")
    counted = running_sum(marked, keys, order, F.col("_start"), "_run", block=block)
    row = F.struct(F.col(order).alias("at"), "x", "z")

    def keep(last: Column, p: Column) -> Column:
        return F.when(gap(last["x"], last["z"], p["x"], p["z"]) > limit, p).otherwise(last)

    so_far = Window.partitionBy(*keys, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    runs = counted.withColumn("_row", row).withColumn("_list", F.collect_list("_row").over(so_far))
    last_kept = F.aggregate(
        F.slice("_list", 2, F.greatest(F.size("_list") - 1, F.lit(0))), F.get("_list", F.lit(0)), keep
    )
    kept = (F.col("_start") == 1) | (last_kept["at"] == F.col(order))
    return runs.where(kept).drop("_start", "_run", "_row", "_list")


def densify(points: DataFrame, keys: list[str] = KEYS, order: str = "idx", limit: float = STEP_METRES,
            carry: tuple[str, ...] = (), block: DataFrame | None = None) -> DataFrame:
    """Points no more than ``limit`` apart along each line, with dense positions ``idx`` from 0.

    Assumes repeats are gone. One explode per segment: no sort and no array of a whole line.
    """
    ahead = neighbors(points, keys, order, ["x", "z"], after="_next", block=block)
    steps = F.greatest(F.lit(1), F.ceil(gap(F.col("x"), F.col("z"), F.col("_next.x"), F.col("_next.z")) / limit))
    # The start point stands for step 0 of its own segment, and of nothing on the last point.
    counted = ahead.withColumn("_steps", F.when(F.col("_next").isNotNull(), steps).otherwise(1).cast("bigint"))
    based = running_sum(counted, keys, order, F.col("_steps"), "_end", block=block)
    ratio = F.col("_step") / F.col("_steps").cast("double")

    def lerp(axis: str) -> Column:
        start = F.col(axis).cast("double")
        return F.when(F.col("_step") == 0, start).otherwise(start + (F.col(f"_next.{axis}") - start) * ratio)

    return based.withColumn("_step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_steps") - 1))).select(
        *keys, (F.col("_end") - F.col("_steps") + F.col("_step")).alias("idx"), *carry,
        lerp("x").alias("x"), lerp("z").alias("z"),
    )


def smooth(points: DataFrame, keys: list[str] = KEYS, order: str = "idx", passes: int = 2,
           block: DataFrame | None = None) -> DataFrame:
    """Weighted mean of each height with its two neighbours; the end points stay."""
    result = points
    for _ in range(passes):
        near = neighbors(result, keys, order, ["y"], before="_prev", after="_next", block=block)
        mean = F.col("_prev.y") * 0.25 + F.col("y") * 0.5 + F.col("_next.y") * 0.25
        result = near.withColumn("y", F.coalesce(mean, F.col("y"))).drop("_prev", "_next")
    return result


def lift(points: DataFrame, keys: list[str] = KEYS, order: str = "idx", block: DataFrame | None = None) -> DataFrame:
    """Add the vertical offset of bridges, tunnels and layers; needs ``layer, bridge, tunnel`` and ``y``."""
    measured = cumulative_distance(points, keys, order, "_along", "_total", block)
    progress = F.col("_along") / F.greatest(F.lit(1.0), F.col("_total"))
    return measured.withColumn(
        "y", F.col("y") + vertical_offset(progress, F.col("layer"), F.col("bridge"), F.col("tunnel"))
    ).drop("_along", "_total")


def maximum_grade(parts: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Steepest grade of each line in percent, from segments with heights."""
    run = gap(F.col("ax"), F.col("az"), F.col("bx"), F.col("bz"))
    grade = F.when(run > 0, F.abs(F.col("by") - F.col("ay")) / F.nullif(run, F.lit(0.0)))
    return parts.groupBy(*keys).agg((F.coalesce(F.max(grade), F.lit(0.0)) * 100).alias("max_grade"))


def sample_at(lines: DataFrame, wanted: DataFrame, keys: list[str], order: str = "idx", span: float = 128.0,
              block: DataFrame | None = None) -> DataFrame:
    """Point of a line at a distance. ``lines``: points with ``distance, total``; ``wanted``: ``keys, distance``.

    Each segment enters the distance bands it covers, so the range join is an equi-join on the band.
    """
    axes = [c for c in ("x", "y", "z") if c in lines.columns]
    parts = neighbors(lines, keys, order, [*axes, "distance"], before="_prev", block=block).where(F.col("_prev").isNotNull())
    banded = parts.select(
        *keys, F.col(order).alias("_order"), F.col("_prev"), F.struct(*axes, "distance").alias("_here"),
        F.explode(F.sequence(F.floor(F.col("_prev.distance") / span), F.floor(F.col("distance") / span))).alias("_band"),
    )
    ends = lines.select(*keys, "total").distinct()
    clamped = wanted.withColumnRenamed("distance", "wanted").join(ends, keys).withColumn(
        "_at", F.greatest(F.lit(0.0), F.least(F.col("total"), F.col("wanted")))
    ).withColumn("_band", F.floor(F.col("_at") / span))
    hit = clamped.join(banded, [*keys, "_band"]).where(
        (F.col("_at") <= F.col("_here.distance"))
        & ((F.col("_at") > F.col("_prev.distance")) | ((F.col("_at") == 0) & (F.col("_prev.distance") == 0)))
    )
    width = F.nullif(F.col("_here.distance") - F.col("_prev.distance"), F.lit(0.0))
    ratio = F.coalesce((F.col("_at") - F.col("_prev.distance")) / width, F.lit(0.0))
    rest = [c for c in wanted.columns if c not in (*keys, "distance")]
    first = hit.groupBy(*keys, *rest, "wanted").agg(F.min_by(F.struct(*[
        (F.col(f"_prev.{a}") + (F.col(f"_here.{a}") - F.col(f"_prev.{a}")) * ratio).alias(a) for a in axes
    ]), "_order").alias("_p"))
    return first.select(*keys, *rest, F.col("wanted").alias("distance"), "_p.*")


def strip_edges(points: DataFrame, width: str = "width", keys: list[str] = KEYS, order: str = "idx",
                block: DataFrame | None = None) -> DataFrame:
    """Left and right edge points of a mitred strip; the mitre is limited at sharp bends."""
    near = neighbors(points, keys, order, ["x", "z"], before="_prev", after="_next", block=block)

    # Flat columns per step: Catalyst would inline structs at each use.
    step_in, step_out = F.col("_prev").isNotNull(), F.col("_next").isNotNull()
    measured = near.where(step_in | step_out).withColumns({
        "_li": gap(F.col("_prev.x"), F.col("_prev.z"), F.col("x"), F.col("z")),
        "_lo": gap(F.col("x"), F.col("z"), F.col("_next.x"), F.col("_next.z")),
    })

    def unit(difference: Column, length: str, still: float) -> Column:
        return F.coalesce(difference / F.nullif(F.col(length), F.lit(0.0)), F.lit(still))

    headed = measured.withColumns({
        "_ix": F.when(step_in, unit(F.col("x") - F.col("_prev.x"), "_li", 1.0)),
        "_iz": F.when(step_in, unit(F.col("z") - F.col("_prev.z"), "_li", 0.0)),
        "_ox": F.when(step_out, unit(F.col("_next.x") - F.col("x"), "_lo", 1.0)),
        "_oz": F.when(step_out, unit(F.col("_next.z") - F.col("z"), "_lo", 0.0)),
    }).withColumns({
        "_ix": F.coalesce("_ix", "_ox"), "_iz": F.coalesce("_iz", "_oz"),
        "_ox": F.coalesce("_ox", "_ix"), "_oz": F.coalesce("_oz", "_iz"),
    })
    # Normals turn a direction (x, z) into (-z, x); the mitre is their normalised sum.
    sized = headed.withColumns({"_sx": -F.col("_iz") - F.col("_oz"), "_sz": F.col("_ix") + F.col("_ox")}).withColumn(
        "_len", F.sqrt(F.col("_sx") * F.col("_sx") + F.col("_sz") * F.col("_sz"))
    )
    folded = F.col("_len") < 0.001
    safe = F.when(folded, F.lit(1.0)).otherwise(F.col("_len"))
    sized = sized.withColumns({
        "_mx": F.when(folded, -F.col("_oz")).otherwise(F.col("_sx") / safe),
        "_mz": F.when(folded, F.col("_ox")).otherwise(F.col("_sz") / safe),
    })
    facing = F.abs(F.col("_mz") * F.col("_ox") - F.col("_mx") * F.col("_oz"))
    half = F.col(width) / 2.0
    reach = F.least(half / F.greatest(F.lit(0.35), facing), half * 2.5)
    y = F.col("y") if "y" in points.columns else F.lit(0.035)
    side = lambda sign: F.struct(
        (F.col("x") + sign * F.col("_mx") * F.col("_reach")).alias("x"), y.alias("y"),
        (F.col("z") + sign * F.col("_mz") * F.col("_reach")).alias("z"),
    )
    kept = [c for c in points.columns if c not in ("x", "y", "z")]
    return sized.withColumn("_reach", reach).select(*kept, side(1).alias("left"), side(-1).alias("right"))


def strip_triangles(points: DataFrame, width: str = "width", keys: list[str] = KEYS, order: str = "idx",
                    carry: tuple[str, ...] = (), block: DataFrame | None = None) -> DataFrame:
    """Two triangles for each segment of a mitred strip."""
    sides = neighbors(
        strip_edges(points, width, keys, order, block), keys, order, ["left", "right"], after="_next", block=block
    )
    left, right, ahead_left, ahead_right = (F.col(c) for c in ("left", "right", "_next.left", "_next.right"))
    pair = F.array(
        F.struct(left.alias("a"), ahead_left.alias("b"), right.alias("c")),
        F.struct(ahead_left.alias("a"), ahead_right.alias("b"), right.alias("c")),
    )
    return sides.where(F.col("_next").isNotNull()).select(*keys, order, *carry, F.posexplode(pair).alias("part", "t")).select(
        *keys, order, *carry, "part", "t.a", "t.b", "t.c"
    )


def numbered(points: DataFrame, keys: list[str] = KEYS, order: str = "idx", block: DataFrame | None = None) -> DataFrame:
    """Dense ``idx`` from 0 and the number of points ``count``."""
    return position(points, keys, order, "_pos", "count", block).drop(order).withColumnRenamed("_pos", order)
