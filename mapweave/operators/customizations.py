"""Saved building edits: write log, checks, defaults, merging and placement of openings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapweave.functions.geometry import (
    edges, footprint_signature, opening_height, opening_sill, opening_width, wall_metres,
)
from mapweave.functions.text import point_key
from mapweave.operators.ordered import hot_keys
from mapweave.schemas import CUSTOMIZATION
from mapweave.session import cut_lineage

KEY = ["provider", "source_id"]


def _next_attempt(log: DataFrame) -> DataFrame:
    """For each write, the first later write of its key that expects one revision more."""
    probes = log.select(*KEY, (F.col("expected_revision") + 1).alias("level"), "seq", F.lit(False).alias("target"))
    targets = log.select(*KEY, F.col("expected_revision").alias("level"), "seq", F.lit(True).alias("target"))
    both = probes.unionByName(targets).withColumn("_back", -F.col("seq")).withColumn(
        "_hit", F.when(F.col("target"), F.col("seq"))
    )
    from mapweave.operators.ordered import last_known

    keys = [*KEY, "level"]
    # A sequence number occurs once per key, so probe and target never share one within a level.
    known = last_known(both, keys, "_back", "_hit", "next_seq", hot_keys(both, keys))
    return known.where(~F.col("target") & F.col("next_seq").isNotNull()).select(*KEY, "seq", "next_seq")


def accept_writes(log: DataFrame) -> DataFrame:
    """Outcome of an ordered write log: ``accepted`` and the revision it produced.

    A write is accepted when it expects the current revision (0 before the first). The accepted writes are a chain: the
    first expecting 0, the first later one expecting 1, and so on. The chain is followed by doubling over next-write
    links, so a key with a very long log is not folded in one task.
    """
    base = cut_lineage(log.select(*KEY, "seq", "expected_revision"))
    jump = cut_lineage(_next_attempt(base))
    reached = base.where("expected_revision = 0").groupBy(*KEY).agg(F.min("seq").alias("seq"))
    while True:
        more = reached.join(jump, [*KEY, "seq"]).select(*KEY, F.col("next_seq").alias("seq"))
        reached = cut_lineage(reached.unionByName(more).distinct())
        ahead = jump.select(*KEY, F.col("seq").alias("next_seq"), F.col("next_seq").alias("far_seq"))
        jump = cut_lineage(jump.join(ahead, [*KEY, "next_seq"]).select(*KEY, "seq", F.col("far_seq").alias("next_seq")))
        if jump.isEmpty():
            break
    marks = reached.withColumn("accepted", F.lit(True))
    return log.join(marks, [*KEY, "seq"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False))).withColumn(
        "revision", F.when(F.col("accepted"), F.col("expected_revision") + 1)
    )


def current_state(outcome: DataFrame, payload: str = "payload") -> DataFrame:
    """Current revision and payload of each key; a null payload is a reset."""
    return outcome.where("accepted").groupBy(*KEY).agg(
        F.max("revision").alias("revision"), F.max_by(payload, "revision").alias(payload)
    )


def rejected(outcome: DataFrame) -> DataFrame:
    return outcome.where("NOT accepted")


def empty_payload(payload: Column) -> Column:
    """The payload, or the empty record of a reset."""
    blank = F.from_json(F.lit('{"footprint":"","openings":[],"boundaries":[],"landscaping":[],"appearance":{}}'),
                        CUSTOMIZATION)
    return F.coalesce(payload, blank)


def has_customization(payload: Column) -> Column:
    def filled(name: str) -> Column:
        return F.coalesce(F.size(payload[name]), F.lit(0)) > 0

    look = payload["appearance"]
    chosen = F.coalesce(*[look[c] for c in ("roof", "roof_orientation", "wall_color", "roof_color", "material")])
    return filled("openings") | filled("boundaries") | filled("landscaping") | payload["enhancement"].isNotNull() | chosen.isNotNull()


def payload_error(payload: Column) -> Column:
    """First broken rule of a payload: content without a footprint, or repeated item identifiers."""
    ids = F.concat(*[
        F.transform(F.coalesce(payload[name], F.array()), lambda item: item["id"])
        for name in ("openings", "boundaries", "landscaping")
    ])
    return F.when((F.coalesce(payload["footprint"], F.lit("")) == "") & has_customization(payload),
                  "Only a reset can have an empty footprint.").when(
        F.size(F.array_distinct(ids)) != F.size(ids), "Item IDs must be unique.")


def for_snapshot(customizations: DataFrame, snapshots: DataFrame, features: DataFrame) -> DataFrame:
    """Saved edits of a snapshot's buildings, by the snapshot's provider."""
    owned = features.where(F.col("kind") == "building").select("snapshot_id", "source_id")
    return snapshots.select("snapshot_id", "provider").join(owned, "snapshot_id").join(customizations, KEY)


def merge_previews(saved: DataFrame, proposals: DataFrame, automatic: DataFrame, keys: list[str]) -> DataFrame:
    """One row per building: a proposal before a saved edit before an automatic one."""
    rows = [df.withColumn("_priority", F.lit(n)) for n, df in enumerate((automatic, saved, proposals))]
    together = rows[0].unionByName(rows[1]).unionByName(rows[2])
    rest = [c for c in saved.columns if c not in keys]
    return together.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_priority").alias("_row")).select(*keys, "_row.*")


def footprint_changed(writes: DataFrame, features: DataFrame) -> DataFrame:
    """Writes whose stored footprint differs from the building's present one. ``features``: ``source_id, polygons``.

    Where both sides name a snapshot or an area, a building is sought within it, as a way occurs in many.
    """
    keys = [k for k in ("area_id", "snapshot_id", "source_id") if k in writes.columns and k in features.columns]
    now = features.select(*keys, footprint_signature(F.col("polygons")).alias("_now"))
    return writes.join(now, keys).where((F.col("footprint") != "") & (F.col("footprint") != F.col("_now")))


def opening_errors(openings: DataFrame, walls: DataFrame) -> DataFrame:
    """First failure of each building by opening order; buildings without failures are absent.

    Openings: ``source_id, ordinal, kind, cars, width, sill, fraction, a_lon, a_lat, b_lon, b_lat``. Walls:
    ``source_id, a_lon, a_lat, b_lon, b_lat``. Neighbours on a wall are compared after grouping by wall, and only rows
    within reach along it meet.
    """
    start, end = point_key(F.col("a_lon"), F.col("a_lat")), point_key(F.col("b_lon"), F.col("b_lat"))
    wall_key = F.concat_ws("|", F.array_sort(F.array(start, end)))
    known = walls.select("source_id", wall_key.alias("wall")).distinct().withColumn("_known", F.lit(True))
    wide = opening_width(F.col("kind"), F.col("cars"), F.col("width"))
    sized = openings.withColumns({
        "wall": wall_key, "length": wall_metres(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat")),
        "opening": wide, "low": opening_sill(F.col("kind"), F.col("sill")), "tall": opening_height(F.col("kind")),
        # Position seen from the wall's lesser end, so reversed walls compare directly.
        "at": F.when(start <= end, F.col("fraction")).otherwise(1 - F.col("fraction")),
    })
    margin = (F.col("opening") / 2.0 + 0.1) / F.nullif(F.col("length"), F.lit(0.0))
    fits = F.col("fraction").between(margin, 1 - margin)
    # Openings and walls grow out of their buildings by explodes, which size estimates do not see: never broadcast them.
    own = sized.join(known.hint("merge"), ["source_id", "wall"], "left").select(
        "source_id", "ordinal",
        F.when(F.col("_known").isNull(), "detached").when(~F.coalesce(fits, F.lit(False)), "does-not-fit").alias("failure"),
    ).where("failure IS NOT NULL").withColumn("stage", F.lit(0))
    # Openings farther apart than the widest one and its margin cannot overlap, so bands of that length suffice.
    band = float(sized.agg(F.max("opening")).first()[0] or 0.0) + 0.2
    metres = F.col("at") * F.col("length")
    banded = sized.withColumn("_band", F.floor(metres / band))
    keep = ("ordinal", "at", "length", "opening", "low", "tall")
    left = banded.select("source_id", "wall", "_band", *[F.col(c).alias(f"l_{c}") for c in keep])
    right = banded.withColumn("_band", F.explode(F.sequence(F.col("_band") - 1, F.col("_band") + 1))).select(
        "source_id", "wall", "_band", *[F.col(c).alias(f"r_{c}") for c in keep]
    )
    close = F.abs(F.col("l_at") - F.col("r_at")) * F.col("l_length") < (F.col("l_opening") + F.col("r_opening")) / 2.0 + 0.1
    level = (F.col("l_low") < F.col("r_low") + F.col("r_tall")) & (F.col("r_low") < F.col("l_low") + F.col("l_tall"))
    overlap = left.join(right.hint("merge"), ["source_id", "wall", "_band"]).where(F.col("l_ordinal") < F.col("r_ordinal")).where(close & level).select(
        "source_id", F.col("l_ordinal").alias("ordinal"), F.lit("overlap").alias("failure"), F.lit(1).alias("stage")
    )
    first = own.unionByName(overlap).groupBy("source_id").agg(F.min(F.struct("stage", "ordinal", "failure")).alias("_f"))
    return first.select("source_id", "_f.ordinal", "_f.failure")


def wall_rows(buildings: DataFrame, polygons: str = "polygons") -> DataFrame:
    """Exterior walls of each building as rows, polygon by polygon."""
    outer = F.explode(F.transform(polygons, lambda rings: F.get(rings, F.lit(0)))).alias("ring")
    kept = [c for c in buildings.columns if c != polygons]
    return buildings.select(*kept, outer).select(*kept, F.posexplode(edges(F.col("ring"))).alias("wall_index", "e")).select(
        *kept, "wall_index", F.col("e.a.lon").alias("a_lon"), F.col("e.a.lat").alias("a_lat"),
        F.col("e.b.lon").alias("b_lon"), F.col("e.b.lat").alias("b_lat"),
    )
