"""Rings of relations: assembly from member ways and assignment of holes."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from mapweave.functions.geometry import point_in_ring

# Workers get the helper functions themselves, so they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_RINGS = ArrayType(ArrayType(ArrayType(DoubleType())))


def assemble(lines: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Closed rings from lines joined end to end in member order; open chains are dropped."""
    left, rings = list(lines), []
    while left:
        chain = left.pop(0)
        while chain[0] != chain[-1]:
            fit = next((i for i, c in enumerate(left) if {c[0], c[-1]} & {chain[0], chain[-1]}), None)
            if fit is None:
                break
            other = left.pop(fit)
            if chain[-1] in (other[0], other[-1]):
                chain = chain + (other if chain[-1] == other[0] else other[::-1])[1:]
            else:
                chain = (other if chain[0] == other[-1] else other[::-1])[:-1] + chain
        if len(chain) >= 4 and chain[0] == chain[-1]:
            rings.append(chain)
    return rings


@F.arrow_udf(_RINGS)
def _assemble_batch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    shape = pa.list_(pa.list_(pa.list_(pa.float64())))
    for lines in batches:
        yield pa.array([assemble([[tuple(p) for p in line] for line in row]) for row in lines.to_pylist()], shape)


def relation_polygons(relations: DataFrame, keys: list[str]) -> DataFrame:
    """Polygons of each relation: outer rings with the holes whose first point they hold; null without an outer ring.

    One row per relation: its members are one bounded array of the element row, so nothing is grouped.
    """
    def lines(role: str):
        fit = F.filter("members", lambda m: (m["role"] == role) & (F.coalesce(F.size(m["geometry"]), F.lit(0)) > 1))
        return F.transform(fit, lambda m: F.transform(m["geometry"], lambda p: F.array(p["lon"], p["lat"])))

    built = relations.withColumns({"_outer": _assemble_batch(lines("outer")), "_inner": _assemble_batch(lines("inner"))})
    position = lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"), F.lit(None).cast("double").alias("h"))
    rings = lambda c: F.transform(c, lambda ring: F.transform(ring, position))
    shaped = built.withColumns({"_outer": rings("_outer"), "_inner": rings("_inner")})
    holds = lambda outer, hole: point_in_ring(outer, hole[0]["lon"], hole[0]["lat"], "lon", "lat")
    # Each hole knows the first outer ring that holds it.
    owner = F.transform("_inner", lambda hole: F.struct(
        hole.alias("ring"),
        F.array_min(F.filter(F.transform("_outer", lambda outer, i: F.when(holds(outer, hole), i)), lambda i: i.isNotNull())).alias("outer"),
    ))
    owned = shaped.withColumn("_holes", owner)
    polygons = F.transform("_outer", lambda outer, i: F.concat(
        F.array(outer), F.transform(F.filter("_holes", lambda h: h["outer"] == i), lambda h: h["ring"])
    ))
    return owned.withColumn("polygons", F.when(F.size("_outer") > 0, polygons)).drop("_outer", "_inner", "_holes")
