"""First-come choice of nodes among close places, in rounds over bounded blocks.

A place becomes a node where no earlier node lies within the radius. Places stand in cells so small that all places of a cell
are close to each other, so a cell holds one node at most and every place meets few nodes. Each round, a task decides one block
of cells in order: a place near a node is closed; one that may have an earlier undecided neighbour waits, for certain when the
neighbour is in the block, and on suspicion when the least undecided place of a cell outside it comes earlier; all others
become nodes. The first undecided place of every neighbourhood is always decided, so each round makes progress, and chains
of close places advance by whole blocks. No pair of places is ever made.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.session import cut_lineage

BLOCK_CELLS = 256
BLOCK_PLACES = 4_096
AROUND = 2  # cells that the radius can reach across
CELL = ["area_id", "cx", "cz"]
BLOCK = ["area_id", "gx", "gz", "bx", "bz"]


def decide(radius: float, side: float):
    """A function from the places of one block (kind 0) and the first undecided places of cells around it (kind 1) to nodes."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("node", "kind", "x", "z", "area_id")), strict=True))
        taken: dict[tuple[int, int], tuple[float, float]] = {}
        waiting: dict[tuple[int, int], list[tuple[float, float]]] = {}
        suspects: set[tuple[int, int]] = set()
        nodes = []
        for node, kind, x, z, area in rows:
            cell = math.floor(x / side), math.floor(z / side)
            if kind:
                suspects.add(cell)
                continue
            near = [(cell[0] + dx, cell[1] + dz) for dx in range(-AROUND, AROUND + 1) for dz in range(-AROUND, AROUND + 1)]
            if any((p := taken.get(c)) and (p[0] - x) ** 2 + (p[1] - z) ** 2 < radius * radius for c in near):
                continue
            stuck = any(c in suspects for c in near) or any(
                (px - x) ** 2 + (pz - z) ** 2 < radius * radius for c in near for px, pz in waiting.get(c, ())
            )
            if stuck:
                waiting.setdefault(cell, []).append((x, z))
            else:
                taken[cell] = (x, z)
                nodes.append((area, node, x, z))
        columns = list(zip(*nodes, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.string(), pa.float64(), pa.float64())
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("area_id", "node", "x", "z"), columns, kinds, strict=True)})

    return run


def _blocks(rows: DataFrame, places: int) -> DataFrame:
    """``rows`` with their block. A crowded block of cells is cut into finer ones, down to one cell."""
    grid = rows.withColumns({"gx": F.floor(F.col("cx") / BLOCK_CELLS), "gz": F.floor(F.col("cz") / BLOCK_CELLS)})
    sizes = grid.groupBy("area_id", "gx", "gz").agg(F.count("*").alias("n"))
    cuts = F.least(F.lit(int(math.log2(BLOCK_CELLS))), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n") / places)) / 2)).cast("int")
    sized = grid.join(sizes.select("area_id", "gx", "gz", F.pow(F.lit(2), cuts).alias("parts")), ["area_id", "gx", "gz"])
    inner = lambda c, g: F.floor((F.col(c) - F.col(g) * BLOCK_CELLS) * F.col("parts") / BLOCK_CELLS)
    return sized.withColumns({"bx": inner("cx", "gx"), "bz": inner("cz", "gz")}).drop("parts")


def _around(rows: DataFrame) -> DataFrame:
    """``rows`` once for each cell that their radius can reach."""
    shifts = F.sequence(F.lit(-AROUND), F.lit(AROUND))
    moved = rows.withColumn("_i", F.explode(shifts)).withColumn("_j", F.explode(shifts))
    return moved.withColumns({"cx": F.col("cx") + F.col("_i"), "cz": F.col("cz") + F.col("_j")}).drop("_i", "_j")


def first_come_nodes(places: DataFrame, radius: float, block_places: int = BLOCK_PLACES) -> DataFrame:
    """The nodes among distinct places (``area_id, node, x, z``), taken in order of ``node`` in each area: ``area_id, node``."""
    side = radius / math.sqrt(2) * (1 - 1e-9)
    at = lambda c: F.floor(F.col(c) / side)
    cells = lambda df: df.withColumns({"cx": at("x"), "cz": at("z")})
    left = cut_lineage(cells(places.select(
        F.col("area_id").cast("long").alias("area_id"), "node", F.col("x").cast("double").alias("x"), F.col("z").cast("double").alias("z")
    )))
    chosen: DataFrame | None = None
    apart: Column = (F.col("x") - F.col("nx")) * (F.col("x") - F.col("nx")) + (F.col("z") - F.col("nz")) * (F.col("z") - F.col("nz"))
    while not left.isEmpty():
        dealt = cut_lineage(_blocks(left, block_places))
        firsts = dealt.groupBy(*CELL, "gx", "gz", "bx", "bz").agg(F.min("node").alias("node"), F.min_by(F.struct("x", "z"), "node").alias("p"))
        owners = firsts.select(*CELL, *[F.col(c).alias(f"to_{c}") for c in BLOCK[1:]])
        met = _around(firsts).join(owners, CELL)
        other = F.lit(False)
        for name in BLOCK[1:]:
            other = other | (F.col(name) != F.col(f"to_{name}"))
        suspects = met.where(other).select(
            "area_id", *[F.col(f"to_{c}").alias(c) for c in BLOCK[1:]], F.lit(1).alias("kind"), "node", F.col("p.x").alias("x"), F.col("p.z").alias("z")
        ).distinct()
        own = dealt.select(*BLOCK, F.lit(0).alias("kind"), "node", "x", "z")
        fresh = own.unionByName(suspects).groupBy(*BLOCK).applyInArrow(decide(radius, side), "area_id long, node string, x double, z double")
        fresh = cut_lineage(fresh)
        near = _around(cells(fresh)).select(*CELL, F.col("x").alias("nx"), F.col("z").alias("nz"))
        closed = left.join(near, CELL).where(apart < radius * radius).select("area_id", "node").distinct()
        left = cut_lineage(left.join(closed, ["area_id", "node"], "left_anti"))
        chosen = fresh if chosen is None else chosen.unionByName(fresh)
    return left.select("area_id", "node") if chosen is None else chosen.select("area_id", "node")
