"""Spatial joins on a uniform grid.

Rows enter every cell their box touches and meet on ``(area_id, cell)`` in an equi-join. A pair is reported in one
cell only, the one with the lower corner of the boxes' overlap, so no distinct is needed afterwards. Cells where both
sides are crowded are cut into finer cells first; crowding on one side alone is left to AQE's skew splitting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.functions.geometry import once, segment_ratio
from mapweave.session import FEW_CELLS, cut_lineage

PAIR_LIMIT = 50_000_000
FINER = 7  # halvings of the smallest cells where they are crowded


def box(min_x: Column, min_z: Column, max_x: Column, max_z: Column) -> Column:
    return F.struct(
        min_x.cast("double").alias("x0"), min_z.cast("double").alias("z0"),
        max_x.cast("double").alias("x1"), max_z.cast("double").alias("z1"),
    )


def point_box(x: str = "x", z: str = "z", reach=0.0) -> Column:
    reach = F.lit(reach) if isinstance(reach, (int, float)) else reach
    return box(F.col(x) - reach, F.col(z) - reach, F.col(x) + reach, F.col(z) + reach)


def segment_box(reach=0.0, ax="ax", az="az", bx="bx", bz="bz") -> Column:
    reach = F.lit(reach) if isinstance(reach, (int, float)) else reach
    return box(
        F.least(ax, bx) - reach, F.least(az, bz) - reach, F.greatest(ax, bx) + reach, F.greatest(az, bz) + reach
    )


def ring_box(ring: Column, reach: float = 0.0, x: str = "x", z: str = "z") -> Column:
    xs, zs = F.transform(ring, lambda p: p[x]), F.transform(ring, lambda p: p[z])
    return box(
        F.array_min(xs) - reach, F.array_min(zs) - reach, F.array_max(xs) + reach, F.array_max(zs) + reach
    )


def cover(df: DataFrame, bounds: str, size: float) -> DataFrame:
    """One row per touched cell, ``cx`` and ``cz``."""
    side = lambda low, high: F.sequence(
        F.floor(F.col(f"{bounds}.{low}") / size), F.floor(F.col(f"{bounds}.{high}") / size)
    )
    return df.withColumn("cx", F.explode(side("x0", "x1"))).withColumn("cz", F.explode(side("z0", "z1")))


def _inner(value: Column, cell: Column, size: float, parts: Column) -> Column:
    """Index of a coordinate among the finer cells of a cell, kept within the cell."""
    return F.greatest(F.lit(0), F.least(parts - 1, F.floor((value - cell * size) * parts / size))).cast("int")


def _refine(df: DataFrame, crowded: DataFrame, bounds: str, size: float) -> DataFrame:
    marked = df.join(crowded, ["area_id", "cx", "cz"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    for axis in "xz":
        low, high = (_inner(F.col(f"{bounds}.{axis}{n}"), F.col(f"c{axis}"), size, F.col("parts")) for n in (0, 1))
        marked = marked.withColumn(f"s{axis}", F.explode(F.sequence(low, high)))
    return marked


def cell_join(left: DataFrame, right: DataFrame, left_box: Column, right_box: Column, size: float,
              limit: int = PAIR_LIMIT) -> DataFrame:
    """Pairs of rows of one area with overlapping boxes; apart from ``area_id`` the sides share no column name.

    Inputs are read twice (crowding count, then join), so hand over written tables where they are costly to compute.
    """
    a = cover(left.withColumn("_lb", left_box), "_lb", size)
    b = cover(right.withColumn("_rb", right_box), "_rb", size)
    cells = ["area_id", "cx", "cz"]
    counted = a.select(*cells, F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(
        b.select(*cells, F.lit(0).alias("l"), F.lit(1).alias("r"))
    ).groupBy(*cells).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    crowded = counted.where(F.col("l") * F.col("r") > limit).select(
        *cells,
        (F.ceil(F.sqrt(F.col("l") * F.col("r") / limit)) * 2).cast("int").alias("parts"),
    )
    keys = list(cells)
    if not crowded.isEmpty():
        crowded = cut_lineage(crowded)
        a, b = _refine(a, crowded, "_lb", size), _refine(b, crowded, "_rb", size).drop("parts")
        keys += ["sx", "sz"]
    # The sides grow by the cells they touch, which size estimates do not see: never broadcast them.
    joined = a.join(b.hint("merge"), keys)
    home = F.lit(True)
    for axis in "xz":
        corner = F.greatest(F.col(f"_lb.{axis}0"), F.col(f"_rb.{axis}0"))
        home = home & (F.floor(corner / size) == F.col(f"c{axis}"))
        home = home & (corner <= F.least(F.col(f"_lb.{axis}1"), F.col(f"_rb.{axis}1")))
        if "sx" in keys:
            home = home & (_inner(corner, F.col(f"c{axis}"), size, F.col("parts")) == F.col(f"s{axis}"))
    return joined.where(home).drop("_lb", "_rb", "cx", "cz", "sx", "sz", "parts")


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns that a later filter can use without Catalyst copying their expressions into the join below.

    A long expression inside a join condition makes the generated method too large for the JVM to compile.
    """
    packed = F.explode(F.array(F.struct(*[value.alias(name) for name, value in columns.items()])))
    return df.withColumn("_computed", packed).select(*df.columns, "_computed.*")


def segment_gap(px="px", pz="pz") -> tuple[Column, Column]:
    """Ratio along the segment and distance for joined point and segment columns."""
    ax, az, bx, bz = (F.col(c) for c in ("ax", "az", "bx", "bz"))
    ratio = segment_ratio(ax, az, bx, bz, F.col(px), F.col(pz))
    ex, ez = F.col(px) - ax - ratio * (bx - ax), F.col(pz) - az - ratio * (bz - az)
    return ratio, F.sqrt(ex * ex + ez * ez)


def within_distance(points: DataFrame, parts: DataFrame, reach, size: float = 32.0) -> DataFrame:
    """Point and segment pairs no farther apart than ``reach`` (a number or a segment column), with ``ratio, distance``.

    ``points`` carry ``px, pz``; ``parts`` carry ``ax, az, bx, bz``.
    """
    pairs = cell_join(points, parts, point_box("px", "pz"), segment_box(reach), size)
    ratio, distance = segment_gap()
    far = F.lit(reach) if isinstance(reach, (int, float)) else reach
    return computed(pairs, ratio=ratio, distance=distance).where(F.col("distance") <= far)


def _cell_candidates(wanted: DataFrame, occupied: DataFrame, size: float) -> DataFrame:
    """For each wanted cell, the occupied cells that can hold the nearest row of any point in it.

    Works on distinct cells. The coarsest common ancestor that is occupied bounds the distance; the cells around it are
    then compared by their least and greatest distances.
    """
    far_out = lambda *names: F.max(F.greatest(*[F.abs(n) for n in names]))
    reach = wanted.agg(far_out("qx", "qz").alias("m")).union(occupied.agg(far_out("cx", "cz").alias("m"))).agg(F.max("m")).first()[0]
    # Shifted by half, all indexes are positive and share the one cell of the last level, however far out they lie.
    height = int(reach or 0).bit_length() + 1
    half = 1 << (height - 1)

    def at(level: Column, name: str) -> Column:
        return F.call_function("shiftright", F.col(name) + half, level)

    levels = F.explode(F.sequence(F.lit(0), F.lit(height))).alias("lv")
    ladder = occupied.select("area_id", "cx", "cz", levels).select(
        "area_id", "lv", at(F.col("lv"), "cx").alias("gx"), at(F.col("lv"), "cz").alias("gz"), "cx", "cz"
    )
    ups = ladder.select("area_id", "lv", "gx", "gz").distinct()
    own = wanted.select("area_id", "qx", "qz", levels).select(
        "area_id", "qx", "qz", "lv", at(F.col("lv"), "qx").alias("gx"), at(F.col("lv"), "qz").alias("gz")
    )
    found = own.join(ups, ["area_id", "lv", "gx", "gz"]).groupBy("area_id", "qx", "qz").agg(F.min("lv").alias("lv"))
    around = F.sequence(F.lit(-2), F.lit(2))
    search = found.withColumn("_i", F.explode(around)).withColumn("_j", F.explode(around)).select(
        "area_id", "qx", "qz", "lv",
        (at(F.col("lv"), "qx") + F.col("_i")).alias("gx"), (at(F.col("lv"), "qz") + F.col("_j")).alias("gz"),
    )
    apart = lambda q, c: F.abs(F.col(q) - F.col(c))
    near = F.sqrt(sum(F.pow(F.greatest(apart(q, c) - 1, F.lit(0)), 2) for q, c in (("qx", "cx"), ("qz", "cz"))))
    far = F.sqrt(sum(F.pow(apart(q, c) + 1, 2) for q, c in (("qx", "cx"), ("qz", "cz"))))
    pairs = search.join(ladder, ["area_id", "lv", "gx", "gz"]).select(
        "area_id", "qx", "qz", "cx", "cz", near.alias("near"), far.alias("far")
    )
    bound = pairs.groupBy("area_id", "qx", "qz").agg(F.min("far").alias("bound"))
    return pairs.join(bound, ["area_id", "qx", "qz"]).where("near <= bound").select("area_id", "qx", "qz", "cx", "cz")


def _entries(parts: DataFrame, size: float) -> DataFrame:
    """Segments in the cells that they cross, not in all cells of their box."""
    dx, dz = F.col("bx") - F.col("ax"), F.col("bz") - F.col("az")
    middle = lambda c: (F.col(c) + 0.5) * size
    off_line = F.abs(dx * (middle("cz") - F.col("az")) - dz * (middle("cx") - F.col("ax")))
    crossed = off_line <= (F.abs(dx) + F.abs(dz)) * (size / 2) * (1 + 1e-9)
    return cover(parts.withColumn("_b", segment_box()), "_b", size).drop("_b").where(crossed)


def _start_bounds(places: DataFrame, parts: DataFrame, count: int, sides: list[float]) -> DataFrame:
    """Places with the least ``_u`` that their cells of ``sides`` with at least ``count`` starts of segments tell."""
    levels = F.explode(F.array(*[F.lit(float(side)) for side in sides])).alias("_side")
    cell = lambda c: F.floor(F.col(c) / F.col("_side"))
    least = sides[0]
    homes = parts.groupBy("area_id", F.floor(F.col("ax") / least).alias("hx"), F.floor(F.col("az") / least).alias("hz")).agg(F.count("*").alias("n"))
    middle = lambda c: ((F.col(c) + 0.5) * least).alias(c)
    full = homes.select("area_id", middle("hx"), middle("hz"), "n", levels).groupBy(
        "area_id", "_side", cell("hx").alias("gx"), cell("hz").alias("gz")
    ).agg(F.sum("n").alias("n")).where(F.col("n") >= count).drop("n")
    spots = places.withColumn("_side", levels).withColumns({"gx": cell("px"), "gz": cell("pz")})
    off = [F.greatest(F.col(f"p{c}") - F.col(f"g{c}") * F.col("_side"), (F.col(f"g{c}") + 1) * F.col("_side") - F.col(f"p{c}")) for c in "xz"]
    return spots.join(full, ["area_id", "_side", "gx", "gz"]).groupBy("area_id", "px", "pz").agg(
        F.min(F.sqrt(off[0] * off[0] + off[1] * off[1]) * (1 + 1e-9) + 1e-6).alias("_u")
    )


def bounded_points(points: DataFrame, parts: DataFrame, count: int, sides: list[float], reach: float | None = None) -> DataFrame:
    """Points with ``_u``, a distance within which at least ``count`` segments lie: the least that cells of ``sides`` tell.

    Segments are counted in the cell of their start. Without such a cell ``_u`` is ``reach``, which is also its upper limit.
    """
    whole = parts.where(F.col("ax").isNotNull() & F.col("az").isNotNull() & F.col("bx").isNotNull() & F.col("bz").isNotNull())
    places = points.select("area_id", "px", "pz").distinct()
    least = sides[0]
    found = _start_bounds(places, whole, count, sides)
    # Where the smallest cells hold many times as many starts, finer ones tell a closer bound; only starts beside points take part.
    spot = lambda a, c: F.floor(F.col(a) / least).alias(c)
    asked = places.select("area_id", spot("px", "hx"), spot("pz", "hz")).distinct()
    homes = whole.groupBy("area_id", spot("ax", "hx"), spot("az", "hz")).count().where(F.col("count") >= 4 * count).drop("count")
    crowded = cut_lineage(homes.join(asked, ["area_id", "hx", "hz"], "left_semi"))
    if not crowded.isEmpty():
        crowded = F.broadcast(crowded) if crowded.count() <= FEW_CELLS else crowded.hint("merge")
        beside = whole.withColumns({"hx": spot("ax", "hx"), "hz": spot("az", "hz")}).join(crowded, ["area_id", "hx", "hz"], "left_semi").drop("hx", "hz")
        finer = _start_bounds(places, beside, count, [least / 2**n for n in range(FINER, 0, -1)])
        found = found.unionByName(finer).groupBy("area_id", "px", "pz").agg(F.min("_u").alias("_u"))
    bounded = points.join(found, ["area_id", "px", "pz"], "left")
    return bounded if reach is None else bounded.withColumn("_u", F.least(F.col("_u"), F.lit(float(reach))))


def close_pairs(points: DataFrame, parts: DataFrame, size: float, once_each: bool = False) -> DataFrame:
    """Pairs of points and segments no farther apart than the point's ``_u``, with ``ratio, distance``.

    With ``once_each`` a pair is reported in the cell of the segment's place nearest the point only, else in all common cells.
    """
    asked = cover(points.withColumn("_lb", point_box("px", "pz", F.col("_u"))), "_lb", size).drop("_lb")
    run = {"_dx": F.col("bx") - F.col("ax"), "_dz": F.col("bz") - F.col("az")}
    # Segments of cells in which no point asks stay where they are.
    cells = cut_lineage(asked.select("area_id", "cx", "cz").distinct())
    crossed = _entries(parts, size)
    if cells.count() <= FEW_CELLS:
        crossed = crossed.join(F.broadcast(cells), ["area_id", "cx", "cz"], "left_semi")
    entries = crossed.withColumns({n: value.cast("double") for n, value in run.items()}).withColumn(
        "_q", F.col("_dx") * F.col("_dx") + F.col("_dz") * F.col("_dz")
    )
    # Most segments of a cell are told apart by their boxes and lines, before any distance is computed.
    # Names of their own: both sides can come from the same rows.
    cell = {"area_id": "_area", "cx": "_cx", "cz": "_cz"}
    entries = entries.withColumnsRenamed(cell)
    near = [F.col(c) == F.col(other) for c, other in cell.items()]
    for c in "xz":
        near += [F.least(f"a{c}", f"b{c}") <= F.col(f"p{c}") + F.col("_u"), F.greatest(f"a{c}", f"b{c}") >= F.col(f"p{c}") - F.col("_u")]
    off_line = F.abs((F.col("px") - F.col("ax")) * F.col("_dz") - (F.col("pz") - F.col("az")) * F.col("_dx"))
    near.append(off_line <= (F.col("_u") + 1e-3) * F.sqrt("_q") + 1e-3)
    met = asked.join(entries.hint("merge"), near).drop(*cell.values())
    along = (F.col("px") - F.col("ax")) * F.col("_dx") + (F.col("pz") - F.col("az")) * F.col("_dz")
    ratio = F.when(F.col("_q") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), along / F.nullif(F.col("_q"), F.lit(0.0))))).otherwise(0.0)

    def gap(share: Column) -> Column:
        ex, ez = (F.col(f"p{c}") - F.col(f"a{c}") - share * F.col(f"_d{c}") for c in "xz")
        return F.struct(share.alias("ratio"), F.sqrt(ex * ex + ez * ez).alias("distance"))

    def here(pair: Column) -> Column:
        within = pair["distance"] <= F.col("_u")
        for c in "xz" if once_each else "":
            low, high = F.least(f"a{c}", f"b{c}").cast("double"), F.greatest(f"a{c}", f"b{c}").cast("double")
            place = F.greatest(low, F.least(high, F.col(f"a{c}") + pair["ratio"] * F.col(f"_d{c}")))
            within = within & (F.floor(place / size) == F.col(f"c{c}"))
        return within

    # Functions of array elements stay out of the generated methods, which would grow too large for the JVM to compile.
    found = F.explode(F.filter(F.array(once(ratio, gap)), here)).alias("_gap")
    return met.select("*", found).select("*", "_gap.*").drop("_gap", "cx", "cz", "_u", "_dx", "_dz", "_q")


def distinct_segments(parts: DataFrame, order: list[str], carry: list[str]) -> DataFrame:
    """One segment of those with the same ends, the lowest by ``order``: the only one of them that can be a nearest one."""
    ends = ["ax", "az", "bx", "bz"]
    first = parts.groupBy("area_id", *ends).agg(F.min(F.struct(*order, *carry)).alias("_first"))
    return cut_lineage(first.select("area_id", *ends, "_first.*"), wide=True)


def nearest_segment(points: DataFrame, parts: DataFrame, keys: list[str], order: list[str], carry: list[str],
                    size: float = 32.0) -> DataFrame:
    """Nearest segment of each point, whatever the distance; ties go to the lowest ``order``.

    Adds ``distance``, ``ratio``, the ``order`` columns and ``carry``. Exact. Where segments start near a point, their cell
    bounds its distance and only segments within that are measured. For points far from all segments, cell distances rule
    out the cells that cannot hold the nearest one.
    """
    columns = ["distance", *order, "ratio", "ax", "az", "bx", "bz", *carry]
    asked = cut_lineage(bounded_points(points.select("area_id", *keys, "px", "pz"), parts, 1, [size / n for n in (32, 16, 8, 4, 2)]))
    met = close_pairs(asked.where("_u IS NOT NULL"), parts, size).select("area_id", *keys, *columns)
    lone = asked.where("_u IS NULL").drop("_u")
    if not lone.isEmpty():
        met = met.unionByName(_far_pairs(lone, parts, keys, size).select("area_id", *keys, *columns))
    best = met.groupBy("area_id", *keys).agg(F.min(F.struct(*columns)).alias("_best"))
    return best.select("area_id", *keys, "_best.*")


def _far_pairs(points: DataFrame, parts: DataFrame, keys: list[str], size: float) -> DataFrame:
    """Points with the segments that can be the nearest. An occupied cell bounds the distance of each point: cells farther
    than the least such bound never meet the point's segments."""
    entries = _entries(parts, size)
    asked = points.withColumns({"qx": F.floor(F.col("px") / size), "qz": F.floor(F.col("pz") / size)})
    cells = _cell_candidates(
        asked.select("area_id", "qx", "qz").distinct(), entries.select("area_id", "cx", "cz").distinct(), size
    )
    gaps = {axis: (F.col(f"c{axis}") * size - F.col(f"p{axis}"), F.col(f"p{axis}") - (F.col(f"c{axis}") + 1) * size) for axis in "xz"}
    least = F.sqrt(sum(F.pow(F.greatest(low, high, F.lit(0.0)), 2) for low, high in gaps.values()))
    most = F.sqrt(sum(F.pow(F.greatest(F.abs(low), F.abs(high)), 2) for low, high in gaps.values()))
    around = computed(asked.join(cells, ["area_id", "qx", "qz"]), _near=least, _far=most)
    bound = around.groupBy("area_id", *keys).agg(F.min("_far").alias("_bound"))
    kept = around.join(bound, ["area_id", *keys]).where(F.col("_near") <= F.col("_bound")).drop("_near", "_far", "_bound", "qx", "qz")
    met = kept.join(entries, ["area_id", "cx", "cz"])
    ratio, distance = segment_gap()
    return met.withColumn("ratio", ratio).withColumn("distance", distance)


def nearest_few(points: DataFrame, parts: DataFrame, count: int, reach: float, size: float = 32.0) -> DataFrame:
    """Pairs below ``reach`` among which the ``count`` nearest segments of each point are, with ``ratio, distance``.

    No pair is made beyond the distance within which so many segments are known to lie.
    """
    sides = [size / 8]
    while sides[-1] < reach:
        sides.append(sides[-1] * 2)
    asked = cut_lineage(bounded_points(points, parts, count, sides, reach))
    crowded = F.col("_u") <= size
    met = close_pairs(asked.where(crowded), parts, size, True).unionByName(close_pairs(asked.where(~crowded), parts, 2 * size, True))
    return met.where(F.col("distance") < reach)
