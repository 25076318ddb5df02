"""Explicit schemas, as DDL text, of every stored table; nothing is inferred at read time."""

from __future__ import annotations

_POSITION = "struct<lon: double, lat: double, h: double>"
GEOMETRY = f"struct<type: string, polygons: array<array<array<{_POSITION}>>>>"
FACTS = (
    "struct<height: double, levels: double, width: double, lanes: double, highway: string, building: string, "
    "surface: string, name: string, layer: string, bridge: boolean, tunnel: boolean>"
)
DIAGNOSTIC = "struct<code: string, severity: string, message: string, source_id: string>"
_LATLON = "struct<lat: double, lon: double>"
_MEMBER = f"struct<type: string, ref: bigint, role: string, geometry: array<{_LATLON}>>"
ELEMENT = (
    f"struct<type: string, id: bigint, version: int, tags: map<string, string>, lat: double, lon: double, "
    f"geometry: array<{_LATLON}>, members: array<{_MEMBER}>>"
)
_OPENING = (
    "struct<id: string, kind: string, a_lon: double, a_lat: double, b_lon: double, b_lat: double, fraction: double, "
    "cars: int, width: double, sill: double, road_id: string>"
)
_BOUNDARY = "struct<id: string, kind: string, points: array<struct<lon: double, lat: double>>>"
_PLANT = "struct<id: string, kind: string, lon: double, lat: double, crown_radius: double, height: double, confidence: double>"
_APPEARANCE = (
    "struct<roof: string, roof_orientation: string, wall_color: string, roof_color: string, material: string>"
)
_EVIDENCE = (
    "struct<provider: string, analyzed_at: timestamp, buffer_meters: double, source_url: string, attribution: string, "
    "license: string, roof_confidence: double, driveway_confidence: double, vegetation_confidence: double>"
)
CUSTOMIZATION = (
    f"struct<footprint: string, openings: array<{_OPENING}>, boundaries: array<{_BOUNDARY}>, "
    f"landscaping: array<{_PLANT}>, appearance: {_APPEARANCE}, enhancement: {_EVIDENCE}>"
)

DOCUMENTS = (f"area_id bigint, version double, generator string, elements array<{ELEMENT}>")
ELEMENTS = ("area_id bigint, position bigint, " + ELEMENT[len("struct<"):-1].replace(": ", " "))
FEATURES = (
    f"area_id bigint, snapshot_id string, source_id string, source_type string, source_version int, kind string, "
    f"geometry {GEOMETRY}, tags map<string, string>, facts {FACTS}, warnings array<{DIAGNOSTIC}>, geometry_hash string"
)
AREAS = (
    "area_id bigint, west double, south double, east double, north double, anchor_lon double, anchor_lat double, "
    "size_m double, bearing_deg double, building_level_height double, default_building_height double, "
    "include_minor_paths boolean"
)
DEM = ("area_id bigint, row int, col int, height double")
OVERRIDES = (
    "area_id bigint, ordinal bigint, target_id string, operation string, payload_version int, payload string"
)
SNAPSHOTS = (
    "snapshot_id string, provider string, query_version int, west double, south double, east double, north double, "
    "selection string, retrieved_at timestamp, content_hash string, derived_from string"
)
CUSTOMIZATIONS = (f"provider string, source_id string, revision int, payload {CUSTOMIZATION}")
CUSTOMIZATION_LOG = (
    f"provider string, source_id string, seq bigint, expected_revision int, payload {CUSTOMIZATION}"
)
PIXELS = ("image_id bigint, x int, y int, r int, g int, b int")
IMAGES = (
    "image_id bigint, west double, south double, east double, north double, width int, height int"
)
POSES = (
    "area_id bigint, trace_id bigint, ts timestamp, x double, z double, qx double, qy double, qz double, qw double"
)
JOB_EVENTS = ("job_id bigint, ts timestamp, status string, progress int, stage string")
