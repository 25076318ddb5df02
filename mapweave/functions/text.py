"""Identity, hashing, keys, fixed-place numbers and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, scale: float = 1.0) -> Column:
    """Round halves toward positive infinity, unlike ``round``."""
    return F.floor(value * scale + 0.5)


def places(value: Column, count: int) -> Column:
    """Round half up by plain arithmetic, which every SQL engine repeats bit for bit."""
    scale = float(10**count)
    return F.floor(value * scale + 0.5).cast("double") / scale


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)


def derived_hash(parent_hash: Column, bounds_json: Column, selection_json: Column) -> Column:
    """Identity of a sub-area cut from a stored snapshot."""
    return content_hash(parent_hash, bounds_json, F.coalesce(selection_json, F.lit("null")))


def canonical_json(value: Column, is_map: bool = False) -> Column:
    """JSON with a fixed order: structs keep theirs and drop nulls, maps become sorted entries."""
    return F.to_json(F.array_sort(F.map_entries(value)) if is_map else value)


def row_signature(*columns: Column) -> Column:
    """Hash of one row's content in a fixed column order."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def source_id(kind: Column, number: Column) -> Column:
    return F.concat_ws(":", F.lit("osm"), kind, number.cast("string"))


def plan_id(prefix: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(prefix), *[part.cast("string") for part in parts])


def request_key(*parts: Column) -> Column:
    return F.concat_ws(":", *[F.coalesce(part.cast("string"), F.lit("")) for part in parts])


def rgb_hex(red: Column, green: Column, blue: Column) -> Column:
    """Text ``#rrggbb`` from channel values clamped to a byte."""

    def channel(value: Column) -> Column:
        byte = F.greatest(F.lit(0), F.least(F.lit(255), half_up(value))).cast("int")
        return F.lpad(F.lower(F.hex(byte)), 2, "0")

    return F.concat(F.lit("#"), channel(red), channel(green), channel(blue))


def is_hex_color(value: Column) -> Column:
    return F.coalesce(value.rlike(r"(?i)^#[\da-f]{6}$"), F.lit(False))


def point_key(lon: Column, lat: Column) -> Column:
    """Seven-place text of a map position."""
    return F.format_string("%.7f,%.7f", lon, lat)


def variant_field(payload: Column, path: str, kind: str) -> Column:
    """One typed field of an open JSON payload; null when absent or of another type."""
    return F.try_variant_get(F.try_parse_json(payload), path, kind)


def has_key(payload: Column, key: str) -> Column:
    return F.array_contains(F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>")), key)
