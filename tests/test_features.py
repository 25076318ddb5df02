import json

import pytest
from pyspark.sql import functions as F

from mapweave.functions import measure as M
from mapweave.operators import customizations as C
from mapweave.plans.imports import preview
from mapweave.plans.normalize import import_diagnostics, normalize
from mapweave.schemas import ELEMENTS
from mapweave.sources.elements import explode_elements, read_documents, wanted_element
from mapweave.sources.generated import rotate_elements, sample_elements
from mapweave.sources.tables import geojson_lines, write_features

BOUNDS = (1, -75.1735, 39.947, -75.161, 39.956)


def areas(spark, *ids):
    return spark.createDataFrame([(i, *BOUNDS[1:]) for i in ids], "area_id bigint, west double, south double, east double, north double")


def element(position, kind, number, tags, geometry=None, members=None, lat=None, lon=None):
    points = [{"lat": y, "lon": x} for x, y in geometry] if geometry else None
    return (1, position, kind, number, 1, tags, lat, lon, points, members)


@pytest.mark.parametrize("text, metres", [
    ("12 m", 12.0), ("10' 6\"", 3.2004), ("3,5", 3.5), ("6'", 1.8288), ("-2", -2.0), ("tall", None), ("", None), (" 7 METERS ", 7.0),
])
def test_measurements(spark, text, metres):
    got = spark.createDataFrame([(text,)], "v string").select(M.parse_measure(F.col("v")).alias("m")).first().m
    assert got == (pytest.approx(metres, abs=1e-9) if metres is not None else None)


def test_layers_and_flags(spark):
    rows = spark.createDataFrame([("1",), ("99",), ("-9",), ("x",), (None,)], "v string")
    assert [r.v for r in rows.select(M.road_layer(F.col("v")).alias("v")).collect()] == [1.0, 5.0, -5.0, 0.0, 0.0]
    flags = spark.createDataFrame([("yes",), ("viaduct",), ("no",), ("",), (None,)], "v string")
    assert [r.v for r in flags.select(M.loose_flag(F.col("v")).alias("v")).collect()] == [True, True, False, False, False]


def test_estimates(spark):
    row = spark.sql("SELECT cast(5 AS double) o, cast(null AS double) n, cast(3 AS double) l")
    got = row.select(
        M.height_estimate(F.col("n"), F.col("n"), F.col("l"), F.lit(3.0), F.lit(8.0)).alias("h"),
        M.width_estimate(F.col("n"), F.col("n"), F.lit(0.5), F.lit("primary")).alias("w"),
        M.width_estimate(F.col("o"), F.col("n"), F.col("l"), F.lit("x")).alias("v"), M.class_width(F.lit("steps")).alias("c"),
        M.class_width(F.lit("steps"), "imagery").alias("i"),
    ).first()
    assert (got.h.height, got.h.height_source) == (9.0, "levels")
    assert (got.w.width, got.w.width_source) == (3.0, "lanes")
    assert (got.v.width, got.v.width_source, got.c, got.i) == (5.0, "override", 5.0, 1.4)


SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]


def test_normalisation(spark):
    outer = [
        {"type": "way", "ref": 1, "role": "outer", "geometry": [{"lat": y, "lon": x} for x, y in SQUARE[:3]]},
        {"type": "way", "ref": 2, "role": "outer", "geometry": [{"lat": y, "lon": x} for x, y in [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0)]]},
        {"type": "way", "ref": 3, "role": "inner", "geometry": [{"lat": y, "lon": x} for x, y in [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]]},
    ]
    rows = [
        element(0, "way", 10, {"highway": "residential", "lanes": "2"}, [(0.0, 0.0), (1.0, 1.0)]),
        element(1, "way", 11, {"building": "house", "building:levels": "2"}, SQUARE),
        element(2, "relation", 20, {"building": "yes"}, members=outer),
        element(3, "way", 30, {"building": "house"}, SQUARE),
        element(4, "way", 40, {"waterway": "stream"}, SQUARE),
        element(5, "way", 50, {"building": "yes"}, [(0.0, 0.0)]),
        element(6, "way", 60, {"name": "nothing"}, SQUARE),
        element(7, "node", 70, {"barrier": "gate"}, lat=1.0, lon=2.0),
        element(8, "relation", 80, {"landuse": "grass"}, members=outer[:1]),
    ]
    elements = spark.createDataFrame(rows, ELEMENTS)
    features, rejected = normalize(elements)
    got = {r.source_id: r for r in features.collect()}
    assert {k: (r.kind, r.geometry.type) for k, r in got.items()} == {
        "osm:way:10": ("road", "LineString"), "osm:way:11": ("building", "Polygon"), "osm:relation:20": ("building", "Polygon"),
        "osm:way:30": ("building", "Polygon"), "osm:way:40": ("water", "LineString"), "osm:node:70": ("barrier", "Point"),
    }
    assert got["osm:way:11"].facts.levels == 2 and got["osm:way:11"].warnings == []
    assert len(got["osm:relation:20"].geometry.polygons[0]) == 2
    assert [w.code for w in got["osm:way:30"].warnings] == ["BUILDING_HEIGHT_ESTIMATED"]
    notes = import_diagnostics(areas(spark, 1, 2), features, rejected).collect()
    assert sorted((n.area_id, n.code, n.source_id or "") for n in notes) == [
        (1, "OSM_GEOMETRY_UNUSABLE", "osm:relation:80"), (1, "OSM_GEOMETRY_UNUSABLE", "osm:way:50"), (2, "NO_ROADS_FOUND", ""),
    ]


def test_sample_areas(spark, tmp_path):
    elements = sample_elements(areas(spark, 1, 2))
    assert elements.where(wanted_element()).count() == 46
    features, _ = normalize(elements)
    keyed = features.withColumn("snapshot_id", F.col("area_id").cast("string"))
    for row in preview(keyed).collect():
        assert (row.roads, row.buildings, row.land, row.estimated_heights) == (6, 16, 1, 0)
    way = features.where("source_id = 'osm:way:10006' AND area_id = 1").first()
    assert way.facts.levels * 3 == 3
    stored = write_features(keyed, str(tmp_path / "features"))
    assert stored.count() == 46 and write_features(keyed, str(tmp_path / "features")).count() == 46
    lines = [json.loads(r.value) for r in geojson_lines(features).collect()]
    assert {line["geometry"]["type"] for line in lines} == {"LineString", "Polygon"}
    turned = rotate_elements(elements, spark.createDataFrame([(1, -75.16725, 39.9515, 90.0), (2, -75.16725, 39.9515, 0.0)], "area_id bigint, lon double, lat double, bearing double"))
    assert turned.count() == 46


def test_documents(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"area_id": 1, "elements": [{"type": "node", "id": 5, "lat": 1.5, "lon": 2.5, "tags": {"barrier": "gate"}}]}))
    row = explode_elements(read_documents(spark, str(folder))).first()
    assert (row.id, row.position, row.tags["barrier"]) == (5, 0, "gate")


def test_revisions(spark):
    log = spark.createDataFrame([("p", "b", i, e, i) for i, e in enumerate([0, 0, 1, 1, 2, 0])], "provider string, source_id string, seq long, expected_revision int, payload long")
    outcome = C.accept_writes(log)
    assert [(r.seq, r.accepted, r.revision) for r in outcome.orderBy("seq").collect()] == [
        (0, True, 1), (1, False, None), (2, True, 2), (3, False, None), (4, True, 3), (5, False, None)]
    now = C.current_state(outcome).first()
    assert (now.revision, now.payload) == (3, 4)


def test_payload_rules(spark):
    from mapweave.schemas import CUSTOMIZATION

    empty = spark.range(1).select(C.empty_payload(F.lit(None).cast(CUSTOMIZATION)).alias("p"))
    row = empty.select(C.has_customization(F.col("p")).alias("has"), C.payload_error(F.col("p")).alias("error")).first()
    assert (row.has, row.error) == (False, None)
