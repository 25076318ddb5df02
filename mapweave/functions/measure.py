"""Tag columns: measurements, kinds, facts, heights, widths and validity checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted text forms of a length.
FEET_INCHES = r"""^(\d+(?:\.\d+)?)'\s*(\d+(?:\.\d+)?)?"?$"""
METRES = r"^(-?\d+(?:[.,]\d+)?)\s*(m|meter|meters)?$"

# Default carriageway widths in metres by road class.
ROAD_CLASS_WIDTHS = {
    "motorway": 24.0, "trunk": 18.0, "primary": 14.0, "secondary": 12.0, "tertiary": 10.0, "residential": 7.0,
    "living_street": 6.0, "service": 4.5, "unclassified": 6.0, "track": 3.5, "path": 2.0, "footway": 2.0,
    "cycleway": 2.5,
}
# The imagery profile uses narrower foot classes and knows steps.
IMAGERY_CLASS_WIDTHS = {**ROAD_CLASS_WIDTHS, "footway": 1.8, "path": 1.4, "steps": 1.4}
WIDTH_PROFILES = {"plan": ROAD_CLASS_WIDTHS, "imagery": IMAGERY_CLASS_WIDTHS}

# Tag words.
MINOR_PATHS = ("path", "footway", "cycleway")
NON_MOTOR_CLASSES = ("cycleway", "footway", "path", "pedestrian", "steps", "track")
FALSE_WORDS = ("", "no", "false", "0")
AREA_WATERWAYS = ("riverbank", "dock", "boatyard")
APPEARANCE_KEYS = ("building:material", "building:colour")


def present(value: Column) -> Column:
    """The text, with an empty one counted as absent."""
    return F.nullif(value, F.lit(""))


def _number(text: Column) -> Column:
    return F.when(text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), text.try_cast("double"))


def parse_measure(value: Column) -> Column:
    """Text such as ``12``, ``12 m``, ``3,5`` or ``10' 6"`` in metres; null when it is none of these."""
    text = F.lower(F.regexp_replace(value, r"^\s+|\s+$", ""))
    feet = F.regexp_extract(text, FEET_INCHES, 1).try_cast("double")
    inches = F.regexp_extract(text, FEET_INCHES, 2).try_cast("double")
    metres = F.replace(F.regexp_extract(text, METRES, 1), F.lit(","), F.lit(".")).try_cast("double")
    return F.coalesce(feet * 0.3048 + F.coalesce(inches, F.lit(0.0)) * 0.0254, metres)


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def classify(tags: Column) -> Column:
    """Feature kind by the first rule that applies; null for elements of no interest."""

    def has(*keys: str) -> Column:
        return F.coalesce(*[present(tag(tags, key)) for key in keys]).isNotNull()

    return (
        F.when(has("building", "building:part"), "building")
        .when(has("highway"), "road")
        .when(has("waterway", "water") | tag(tags, "natural").eqNullSafe("water"), "water")
        .when(has("landuse", "leisure", "natural"), "land")
        .when(has("barrier"), "barrier")
    )


def facts(tags: Column) -> Column:
    """Typed facts of a feature; flags are set for the literal word ``yes`` only."""

    def flag(key: str) -> Column:
        return F.when(tag(tags, key) == "yes", F.lit(True))

    return F.struct(
        parse_measure(tag(tags, "height")).alias("height"),
        parse_measure(tag(tags, "building:levels")).alias("levels"),
        parse_measure(tag(tags, "width")).alias("width"),
        parse_measure(tag(tags, "lanes")).alias("lanes"),
        *[present(tag(tags, key)).alias(key) for key in ("highway", "building", "surface", "name", "layer")],
        flag("bridge").alias("bridge"),
        flag("tunnel").alias("tunnel"),
    )


def is_linear_waterway(tags: Column) -> Column:
    """Streams, rivers and ditches mapped as centre lines rather than areas."""
    waterway = present(tag(tags, "waterway"))
    return F.coalesce(
        waterway.isNotNull() & ~waterway.isin(*AREA_WATERWAYS) & ~tag(tags, "area").eqNullSafe("yes"), F.lit(False)
    )


def loose_flag(value: Column) -> Column:
    """Any tag value except the empty and the negative words."""
    return F.coalesce(~value.isin(*FALSE_WORDS), F.lit(False))


def road_layer(value: Column) -> Column:
    """Layer number within five levels of the ground; unreadable text is the ground."""
    text = F.when(F.trim(value) == "", F.lit("0")).otherwise(value)
    number = _number(text)
    return F.when(number.isNull(), 0.0).otherwise(F.greatest(F.lit(-5.0), F.least(F.lit(5.0), number)))


def appearance_tags(tags: Column) -> Column:
    return F.map_filter(tags, lambda key, _: key.startswith("roof:") | key.isin(*APPEARANCE_KEYS))


def land_class(tags: Column) -> Column:
    """Land use, else natural cover; a blank land use still wins over the cover."""
    usable = F.coalesce(present(tag(tags, "landuse")), present(tag(tags, "natural"))).isNotNull()
    return F.when(usable, F.coalesce(tag(tags, "landuse"), tag(tags, "natural")))


def height_estimate(override: Column, height: Column, levels: Column, level_height: Column, default: Column) -> Column:
    """Struct of height and its source: override, tag, levels times the level height, or the default."""
    return F.struct(
        F.when(override > 0, override).when(height > 0, height).when(levels > 0, levels * level_height)
        .otherwise(default).cast("double").alias("height"),
        F.when(override > 0, "override").when(height > 0, "source").when(levels > 0, "levels")
        .otherwise("fallback").alias("height_source"),
    )


def class_width(highway: Column, profile: str = "plan") -> Column:
    entries = [F.lit(item) for pair in WIDTH_PROFILES[profile].items() for item in pair]
    known = F.try_element_at(F.create_map(*entries), F.coalesce(highway, F.lit("unclassified")))
    return F.coalesce(known, F.lit(5.0))


def width_estimate(override: Column, width: Column, lanes: Column, highway: Column, profile: str = "plan") -> Column:
    """Struct of width and its source: override, tag, lanes, or the class table."""
    by_lanes = F.greatest(F.lit(3.0), lanes * 3.2)
    return F.struct(
        F.when(override > 0, override).when(width > 0, width).when(lanes > 0, by_lanes)
        .otherwise(class_width(highway, profile)).cast("double").alias("width"),
        F.when(override > 0, "override").when(width > 0, "source").when(lanes > 0, "lanes")
        .otherwise("class").alias("width_source"),
    )


def imagery_width(width_text: Column, lanes_text: Column, highway: Column) -> Column:
    """Width for imagery work: no overrides, numeric text accepted, the imagery class table."""
    return width_estimate(
        F.lit(None).cast("double"), _number(width_text), _number(lanes_text), highway, "imagery"
    )["width"]


def is_motor_road(
    width: Column, highway: Column, access: Column, motor_vehicle: Column, service: Column, area: Column
) -> Column:
    """Roads that a race or a car route may use."""
    blank = F.lit("")
    return (
        (width >= 4.2)
        & ~F.coalesce(highway, blank).isin(*NON_MOTOR_CLASSES)
        & ~F.coalesce(access, blank).isin("no", "private")
        & ~F.coalesce(motor_vehicle, blank).isin("no", "private")
        & ~F.coalesce(service, blank).isin("driveway", "parking_aisle")
        & ~F.coalesce(area, blank).eqNullSafe("yes")
    )


def is_minor_path(highway: Column) -> Column:
    return F.coalesce(highway.isin(*MINOR_PATHS), F.lit(False))


def on_ground(layer: Column, bridge: Column, tunnel: Column) -> Column:
    return ~bridge & ~tunnel & (layer == 0)


def grades_terrain(layer: Column, bridge: Column, tunnel: Column) -> Column:
    """Roads that shape the terrain: ground roads and tunnels, never bridges."""
    return ~bridge & (tunnel | (layer == 0))


def bounds_error(west: Column, south: Column, east: Column, north: Column) -> Column:
    """First reason that a bounding box is unusable, or null."""
    return (
        F.when(~(west.between(-180, 180) & east.between(-180, 180)), "longitude")
        .when(~(south.between(-90, 90) & north.between(-90, 90)), "latitude")
        .when(east <= west, "east-not-greater")
        .when(north <= south, "north-not-greater")
    )


def selection_error(size_m: Column, bearing: Column) -> Column:
    return F.when(~size_m.between(400, 2000), "size").when((bearing < 0) | (bearing >= 360), "bearing")


def grid_error(count: Column, columns: Column, rows: Column, low: Column, high: Column) -> Column:
    return F.when(count != columns * rows, "size").when(high < low, "range")


def diagnostic(code: str, severity: str, message, source_id: Column | None = None) -> Column:
    return F.struct(
        F.lit(code).alias("code"),
        F.lit(severity).alias("severity"),
        (F.lit(message) if isinstance(message, str) else message).alias("message"),
        (F.lit(None).cast("string") if source_id is None else source_id).alias("source_id"),
    )
