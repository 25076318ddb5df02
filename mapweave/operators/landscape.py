"""Plants moved off the pavement of a finished plan.

Three passes, each over all plants together: out of the nearest road's clearance; out of junctions, one after the other in order, as
each push decides whether the next junction is met; then, while the crown still touches pavement, half a metre a round away from the
nearest road. Each round is one grid join, and only plants that it moves take part in the next; a plant's neighbours are fixed
within a round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.functions.geometry import segment_distance, signed_area
from mapweave.operators.grid import box, cell_join, computed, nearest_segment
from mapweave.session import cut_lineage

# Distance kept from roads and junctions, least length of a direction, step and rounds of the last pass.
CLEARANCE, SHORT, STEP, ROUNDS = 0.35, 0.05, 0.5, 40
PLANT = ["area_id", "plant_id"]
STATE = [*PLANT, "x", "z", "radius", "fx", "fz", "moved"]


def _side(choices: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """The first direction that is long enough, else the last one."""
    picked = []
    for axis in (0, 1):
        value = choices[-1][axis]
        for choice in reversed(choices[:-1]):
            long_enough = F.sqrt(choice[0] * choice[0] + choice[1] * choice[1]) >= SHORT
            value = F.when(F.coalesce(long_enough, F.lit(False)), choice[axis]).otherwise(value)
        picked.append(value)
    return picked[0], picked[1]


def _nearest(plants: DataFrame, parts: DataFrame) -> DataFrame:
    """Plants with the nearest road's point ``rx, rz``, left normal ``ux, uz``, ``distance`` and ``road_width``."""
    asked = plants.select(*PLANT, F.col("x").alias("px"), F.col("z").alias("pz"))
    near = nearest_segment(asked, parts, ["plant_id"], ["way_id", "idx"], ["road_width"])
    dx, dz = F.col("bx") - F.col("ax"), F.col("bz") - F.col("az")
    length = F.greatest(F.sqrt(dx * dx + dz * dz), F.lit(1e-9))
    return plants.join(near.select(
        *PLANT, "distance", "road_width", (F.col("ax") + F.col("ratio") * dx).alias("rx"), (F.col("az") + F.col("ratio") * dz).alias("rz"),
        (-dz / length).alias("ux"), (dx / length).alias("uz"),
    ), PLANT, "left")


def off_nearest_road(plants: DataFrame, parts: DataFrame) -> DataFrame:
    near = _nearest(plants, parts)
    clear = F.col("road_width") / 2 + F.col("radius") + CLEARANCE
    close = F.coalesce(F.col("distance") < clear, F.lit(False))
    sx, sz = _side([
        (F.col("x") - F.col("rx"), F.col("z") - F.col("rz")), (F.col("fx") - F.col("rx"), F.col("fz") - F.col("rz")), (F.col("ux"), F.col("uz"))
    ])
    turned = near.withColumns({"_sx": sx, "_sz": sz, "_close": close, "_clear": clear})
    size = F.sqrt(F.col("_sx") * F.col("_sx") + F.col("_sz") * F.col("_sz"))
    moved = {c: F.when(F.col("_close"), F.col(f"r{c}") + F.col(f"_s{c}") / size * F.col("_clear")).otherwise(F.col(c)) for c in "xz"}
    return turned.withColumns({**moved, "moved": F.col("_close")}).select(*STATE)


def off_junctions(plants: DataFrame, junctions: DataFrame) -> DataFrame:
    """Junctions: ``area_id, junction, x, z, radius``, in order of ``junction``. A round pushes each plant out of its next one."""
    discs = cut_lineage(junctions.select(
        "area_id", "junction", F.col("x").alias("jx"), F.col("z").alias("jz"), F.col("radius").alias("jr")
    ))
    around = box(*[F.col(f"j{c}") + s * F.col("jr") for s in (-1, 1) for c in "xz"])
    done, active = [], cut_lineage(plants.withColumn("last", F.lit("")))
    while not active.isEmpty():
        reach = F.col("radius") + CLEARANCE
        met = cell_join(active, discs, box(*[F.col(c) + s * reach for s in (-1, 1) for c in "xz"]), around, 32.0)
        ox, oz = F.col("x") - F.col("jx"), F.col("z") - F.col("jz")
        met = computed(met, off=F.sqrt(ox * ox + oz * oz)).where((F.col("junction") > F.col("last")) & (F.col("off") < F.col("jr") + reach))
        first = met.groupBy(*PLANT).agg(F.min("junction").alias("junction"))
        pushed = active.join(first, PLANT).join(discs, ["area_id", "junction"])
        sx, sz = _side([(F.col("x") - F.col("jx"), F.col("z") - F.col("jz")), (F.col("fx") - F.col("jx"), F.col("fz") - F.col("jz")), (F.lit(1.0), F.lit(0.0))])
        pushed = pushed.withColumns({"_sx": sx, "_sz": sz})
        scale = (F.col("jr") + reach) / F.sqrt(F.col("_sx") * F.col("_sx") + F.col("_sz") * F.col("_sz"))
        new = {c: F.col(f"j{c}") + F.col(f"_s{c}") * scale for c in "xz"}
        pushed = cut_lineage(pushed.withColumns({**new, "moved": F.lit(True), "last": F.col("junction")}).select(*STATE, "last"))
        done.append(active.join(pushed.select(*PLANT), PLANT, "left_anti").select(*STATE))
        active = pushed
    return cut_lineage(reduce(DataFrame.unionByName, done)) if done else plants


def touching(plants: DataFrame, pavement: DataFrame) -> DataFrame:
    """Plants whose crown reaches a pavement triangle ``ux, uz, vx, vz, wx, wz``."""
    side = lambda pick, c: pick(*[F.col(f"{n}{c}") for n in "uvw"])
    met = cell_join(
        plants.select(*PLANT, "x", "z", "radius"), pavement, box(*[F.col(c) + s * F.col("radius") for s in (-1, 1) for c in "xz"]),
        box(side(F.least, "x"), side(F.least, "z"), side(F.greatest, "x"), side(F.greatest, "z")), 32.0,
    )
    spot = (F.col("x"), F.col("z"))
    corners = [(F.col(f"{n}x"), F.col(f"{n}z")) for n in "uvw"]
    walls = list(zip(corners, [*corners[1:], corners[0]], strict=True))
    turns = [signed_area(*p, *q, *spot) for p, q in walls]
    inside = (F.least(*turns) >= 0) | (F.greatest(*turns) <= 0)
    apart = F.least(*[segment_distance(*p, *q, *spot) for p, q in walls])
    return computed(met, _in=inside, _off=apart).where(F.col("_in") | (F.col("_off") <= F.col("radius"))).select(*PLANT).distinct()


def nudged(plants: DataFrame, parts: DataFrame, junctions: DataFrame, pavement: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``area_id, plant_id, x, z, moved`` of each plant ``area_id, plant_id, x, z, radius, fx, fz`` (a place to fall back to, or null).

    Parts: road segments ``way_id, idx, road_width``; pavement: triangles ``a, b, c`` with ``x, z``.
    """
    flat = cut_lineage(pavement.select("area_id", *[F.col(f"{p}.{c}").alias(f"{n}{c}") for p, n in zip("abc", "uvw", strict=True) for c in "xz"]))
    start = plants.select(*PLANT, *[F.col(c).cast("double").alias(c) for c in ("x", "z", "radius", "fx", "fz")], F.lit(False).alias("moved"))
    active = off_junctions(cut_lineage(off_nearest_road(start, parts)), junctions)
    done = []
    for _ in range(rounds):
        hit = cut_lineage(touching(active, flat))
        done.append(active.join(hit, PLANT, "left_anti"))
        active = active.join(hit, PLANT)
        if hit.isEmpty():
            break
        near = _nearest(active, parts)
        sx, sz = _side([(F.col("x") - F.col("rx"), F.col("z") - F.col("rz")), (F.col("ux"), F.col("uz"))])
        turned = near.withColumns({"_sx": sx, "_sz": sz})
        size = F.greatest(F.lit(SHORT), F.sqrt(F.col("_sx") * F.col("_sx") + F.col("_sz") * F.col("_sz")))
        step = {c: F.coalesce(F.col(c) + F.col(f"_s{c}") / size * STEP, F.col(c)) for c in "xz"}  # without a road it stays
        active = cut_lineage(turned.withColumns({**step, "moved": F.col("moved") | F.col("rx").isNotNull()}).select(*STATE))
    return reduce(DataFrame.unionByName, [*done, active]).select(*PLANT, "x", "z", "moved")
