import json
import math
import random

import pytest
from pyspark.sql import functions as F

from mapweave.derived import table
from mapweave.functions import geo as G
from mapweave.functions.geometry import roof_planes
from mapweave.operators import elevation as E
from mapweave.operators import grid as R
from mapweave.operators import lines as L
from mapweave.operators import network as N
from mapweave.operators import ordered as O
from mapweave.operators import ranking
from mapweave.operators import spatial as S
from mapweave.operators import terrain as T
from mapweave.operators.components import components
from mapweave.operators.customizations import opening_errors
from mapweave.operators.imagery import roof_tensor
from mapweave.operators.network import paths, road_graph, shortest_distances
from mapweave.operators.rings import assemble
from mapweave.operators.routes import candidates, summaries
from mapweave.plans.world import drape_roads


def test_pieces_equal_plain_windows(spark):
    rows = [(1, i * 3, float((i * 7) % 5), None if i % 4 else float(i)) for i in range(60)] + [(2, 5, 1.0, None)]
    rows += [(3, i, float(i % 4), None) for i in range(4)]
    df = spark.createDataFrame(rows, "k int, o long, v double, g double")
    hot = spark.createDataFrame([(1, 7), (3, 2)], "k int, _pieces int")  # key 2 stays on the plain way
    for step in (
        lambda b: O.neighbors(df, ["k"], "o", ["v"], "before", "after", b), lambda b: O.running_sum(df, ["k"], "o", F.col("v"), "s", "t", b),
        lambda b: O.position(df, ["k"], "o", "p", "n", b), lambda b: O.last_known(df, ["k"], "o", "g", "f", b),
        lambda b: O.running_min(df, ["k"], "o", "v", "m", b), lambda b: O.place(df, ["k"], "v", "o", "r", b), lambda b: O.place(df, ["k"], "v", None, "r", b),
    ):
        plain, cut = step(None), step(hot)
        assert sorted(map(str, plain.select(*sorted(plain.columns)).collect())) == sorted(map(str, cut.select(*sorted(cut.columns)).collect()))
    assert O.hot_keys(df, ["k"]) is None and [tuple(r) for r in O.hot_keys(df, ["k"], limit=10).collect()] == [(1, 12)]


def test_repeats_and_densify(spark):
    points = spark.createDataFrame([(1, 1, i, x, 0.0) for i, x in enumerate([0.0, 0.0, 0.015, 0.03, 9.0])], "area_id int, way_id int, idx int, x double, z double")
    kept = L.drop_repeats(points)
    assert [r.x for r in kept.orderBy("idx").collect()] == [0.0, 0.03, 9.0]
    dense = [r.x for r in L.densify(kept).orderBy("idx").collect()]
    assert dense[0] == 0.0 and dense[-1] == 9.0 and max(b - a for a, b in zip(dense, dense[1:])) <= 4.0


def test_nearest_is_exact(spark):
    rng = random.Random(5)
    # Short and long diagonals: the boxes of the long ones cover many cells that they do not cross.
    segs = [(1, n, 0, *[rng.uniform(-400, 400) for _ in range(2)]) for n in range(60)]
    segs = [(a, w, i, x, z, x + rng.uniform(-1, 1) * far, z + rng.uniform(-1, 1) * far) for a, w, i, x, z in segs for far in (40 if w % 3 else 600,)]
    pts = [(1, n, rng.uniform(-1, 1) * far, rng.uniform(-1, 1) * far) for n in range(160) for far in (500 if n % 2 else 3000,)]
    best = R.nearest_segment(
        spark.createDataFrame(pts, "area_id int, id int, px double, pz double"),
        spark.createDataFrame(segs, "area_id int, way_id int, idx int, ax double, az double, bx double, bz double"), ["id"], ["way_id", "idx"], [],
    ).collect()

    def distance(p, s):
        dx, dz = s[5] - s[3], s[6] - s[4]
        t = max(0, min(1, ((p[2] - s[3]) * dx + (p[3] - s[4]) * dz) / (dx * dx + dz * dz)))
        return math.hypot(p[2] - s[3] - t * dx, p[3] - s[4] - t * dz)

    assert len(best) == len(pts)
    for row in best:
        assert row.distance == pytest.approx(min(distance(pts[row.id], s) for s in segs), abs=1e-9)


def test_crowded_cells_give_the_same_pairs(spark):
    rng = random.Random(1)
    boxes = [(1, n, rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(0, 9)) for n in range(120)]
    df = spark.createDataFrame(boxes, "area_id int, id int, x double, z double, s double")
    left = df.select("area_id", F.col("id").alias("i"), F.col("x").alias("lx"), F.col("z").alias("lz"), F.col("s").alias("ls"))
    right = df.select("area_id", F.col("id").alias("j"), F.col("x").alias("rx"), F.col("z").alias("rz"), F.col("s").alias("rs"))
    bounds = lambda p: R.box(F.col(p + "x"), F.col(p + "z"), F.col(p + "x") + F.col(p + "s"), F.col(p + "z") + F.col(p + "s"))
    want = sorted((a[1], b[1]) for a in boxes for b in boxes
                  if a[2] <= b[2] + b[4] and b[2] <= a[2] + a[4] and a[3] <= b[3] + b[4] and b[3] <= a[3] + a[4])
    for limit in (R.PAIR_LIMIT, 100):
        got = R.cell_join(left, right, bounds("l"), bounds("r"), 16.0, limit).select("i", "j").collect()
        assert sorted((r.i, r.j) for r in got) == want


def test_components(spark):
    rng = random.Random(3)
    edges = [(1, rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(2, 7, n) for n in range(8, 40)]
    got = {(r.area_id, r.node): r.root for r in components(spark.createDataFrame(edges, "area_id int, a int, b int")).collect()}
    label = {}
    for area, a, b in edges:
        label.setdefault((area, a), a), label.setdefault((area, b), b)
    for _ in range(100):
        for area, a, b in edges:
            label[area, a] = label[area, b] = min(label[area, a], label[area, b])
    assert got == {k: v for k, v in label.items() if any(k[0] == e[0] and k[1] in e[1:] and e[1] != e[2] for e in edges)}


def test_geodesy(spark):
    df = spark.createDataFrame([(-75.002, 40.003, 12.0)], "lon double, lat double, h double")
    frame = G.anchor_frame(F.lit(-75.0), F.lit(40.0))
    enu = G.local_enu(G.ecef(F.col("lon"), F.col("lat"), F.col("h")), frame)
    back = G.with_geodetic(df.withColumn("e", enu).select(G.frame_to_ecef(F.col("e.east"), F.col("e.north"), F.col("e.up"), frame).alias("p")), "p").first()
    assert (back.lon, back.lat) == (pytest.approx(-75.002, abs=1e-9), pytest.approx(40.003, abs=1e-9)) and back.height == pytest.approx(12, abs=1e-4)


def test_slope_grid(spark):
    heights = [[100.0, 102.0, 104.0], [110.0, 112.0, 114.0], [120.0, 122.0, 124.0]]
    dem = spark.createDataFrame([(1, r, c, heights[r][c]) for r in range(3) for c in range(3)], "area_id int, row int, col int, height double")
    head = E.summary(dem).withColumns({k: F.lit(v) for k, v in (("west", -75.003), ("south", 39.997), ("east", -74.997), ("north", 40.003))})
    points = spark.createDataFrame([(1, 0, -75.0, 40.0), (1, 1, -80.0, 30.0)], "area_id int, id int, lon double, lat double")
    got = {r.id: r.height for r in E.sample(points, dem, head).collect()}
    assert got == {0: pytest.approx(112.0), 1: pytest.approx(100.0)}


def test_gap_rule(spark):
    dem = spark.createDataFrame([(1, 0, 0, None), (1, 0, 1, 4.0), (1, 1, 0, None), (1, 1, 1, 8.0)], "area_id int, row int, col int, height double")
    assert [r.height for r in E.fill_gaps(dem).orderBy("row", "col").collect()] == [6.0, 4.0, 4.0, 8.0]
    assert E.coverage(dem).first().flat is True


def test_rings():
    a, b, c, d = (0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)
    assert len(assemble([[a, b, c], [a, d, c]])) == 1
    assert assemble([[a, b], [c, d]]) == []
    assert len(assemble([[a, b, c, a], [c, d], [d, a, c]])) == 2


def area_of(triangles):
    return sum(abs((b[0] - a[0]) * (c[2] - a[2]) - (b[2] - a[2]) * (c[0] - a[0])) / 2 for a, b, c in triangles)


def test_cut_out_conserves_area(spark):
    road = [[(-1.0, 5.0, 1.0), (5.0, 5.0, 1.0), (-1.0, 5.0, 3.0)], [(5.0, 5.0, 1.0), (5.0, 5.0, 3.0), (-1.0, 5.0, 3.0)]]
    left = T.cut_cell(0.0, 0.0, 4.0, (0.0, 0.0, 0.0, 0.0), road)
    assert area_of(left) == pytest.approx(16 - 8)
    border = [p for t in left for p in t if abs(p[2] - 1) < 1e-9 or abs(p[2] - 3) < 1e-9]
    assert border and all(p[1] == pytest.approx(5.0) for p in border)
    point = "struct<x:double,y:double,z:double>"
    pavement = spark.createDataFrame([(1, *t) for t in road], f"area_id int, a {point}, b {point}, c {point}")
    corners = spark.createDataFrame([(1, 0, 0, i, 0, 0.0, 0.0, 0.0, 0.0) for i in (0, 1, 2)], "area_id int, chunk_x long, chunk_z long, ix int, iz int, h00 double, h10 double, h01 double, h11 double")
    pieces = T.cut_out_pavement(corners, pavement)
    total = area_of([[tuple(r[n]) for n in "abc"] for r in pieces.where("ix = 0").collect()])
    assert total == pytest.approx(8.0) and {r.ix for r in pieces.select("ix").distinct().collect()} == {0, 1}
    asked = spark.createDataFrame([(1, 0, 2.0, 2.0), (1, 1, 2.0, 0.5), (1, 2, 10.0, 2.0), (1, 3, 900.0, 0.0)], "area_id int, id int, px double, pz double")
    under = {r.id: r.height for r in T.heights_under(asked, corners, pieces, pavement, ["id"]).collect()}
    assert under[0] == pytest.approx(5.0) and 0 <= under[1] <= 5 and under[2] == under[3] == 0.0


def square_roads(spark, size=300.0, tail=False):
    corners = [(0.0, 0.0), (size, 0.0), (size, size), (0.0, size), (0.0, 0.0)]
    points = [(1, 1, i, x, 0.0, z, 7.0, 0.0) for i, (x, z) in enumerate(corners[:4] if tail else corners)]
    return spark.createDataFrame(points, "area_id int, way_id int, idx int, x double, y double, z double, width double, layer double")


def test_paths(spark):
    _, edges = road_graph(square_roads(spark))
    source = edges.groupBy("area_id").agg(F.lit("0:0:0").alias("node")).withColumn("source", F.lit("s"))
    found = shortest_distances(edges, source)
    assert {r.node: r.dist for r in found.collect()} == {"0:0:0": 0.0, "3000:0:0": 300.0, "0:3000:0": 300.0, "3000:3000:0": 600.0}
    way = paths(found, spark.createDataFrame([(1, "s", "3000:3000:0")], "area_id int, source string, end string"))
    assert [r.dist for r in way.orderBy("dist").collect()] == [0.0, 300.0, 600.0]


@pytest.mark.parametrize("tail, kind", [(False, "loop"), (True, "out-and-back")])
def test_circuits(spark, tail, kind):
    points = square_roads(spark, tail=tail)
    parts = L.segments(points, carry=("width", "layer"))
    start = spark.createDataFrame([(1, 1, 150.0, 2.0, 1.0, 0.0)], "area_id int, start_id int, px double, pz double, hx double, hz double")
    best, rows = candidates(points, parts, start)
    got = summaries(best).collect()
    assert got and all(r.kind == kind for r in got)
    lengths = {r.course_id: 0.0 for r in rows.collect()}
    measured = L.cumulative_distance(rows, ["area_id", "course_id"], "idx").groupBy("course_id").agg(F.max("total").alias("t")).collect()
    assert lengths.keys() == {r.course_id for r in measured} and all(r.t >= 1000 for r in measured)


def test_snapping_is_first_come(spark):
    rng = random.Random(9)
    rows = [(1, 1, i, float(i), 0.0) for i in range(101)]
    rows += [(1, w, i, rng.uniform(0, 12), rng.uniform(0, 12)) for w in range(2, 8) for i in range(30)] + [(1, 9, i, x, 0.0) for i, x in enumerate([100.0, 3.0, 0.4])]
    points = spark.createDataFrame([(*r, False) for r in rows], "area_id long, way_id long, idx long, x double, z double, tunnel boolean")
    nodes, grid, edges, before = [], {}, set(), (None, None)
    for _, way, _, x, z in rows:
        gx, gz = math.floor(x / 3), math.floor(z / 3)
        near = [n for dx in (-1, 0, 1) for dz in (-1, 0, 1) for n in grid.get((gx + dx, gz + dz), []) if (nodes[n][0] - x) ** 2 + (nodes[n][1] - z) ** 2 < 2.25]
        if not near:
            near = [len(nodes)]
            nodes.append((x, z))
            grid.setdefault((gx, gz), []).append(near[0])
        if before[0] == way and before[1] != near[0]:
            edges |= {(before[1], near[0]), (near[0], before[1])}
        before = (way, near[0])
    vertices, found = N.snapped_graph(points)
    got = {r.node: (r.x, r.z) for r in vertices.collect()}
    assert sorted(got.values()) == sorted(nodes) and len([p for p in nodes if p[1] == 0.0]) >= 51
    assert {(got[r.src], got[r.dst]) for r in found.collect()} == {(nodes[a], nodes[b]) for a, b in edges}


def test_nearest_beyond_any_fixed_grid(spark):
    far = 32.0 * 2**21
    best = R.nearest_segment(
        spark.createDataFrame([(1, 1, -far, far), (1, 2, 0.0, 0.0)], "area_id int, id int, px double, pz double"),
        spark.createDataFrame([(1, 5, 0, far, far, far + 1, far), (1, 6, 0, far, -far, far, -far + 1)], "area_id int, way_id int, idx int, ax double, az double, bx double, bz double"),
        ["id"], ["way_id", "idx"], [],
    ).collect()
    assert {r.id: r.way_id for r in best} == {1: 5, 2: 6}


def test_relation_members_are_lines_of_their_own(spark):
    from mapweave.schemas import ELEMENT
    from mapweave.sources.elements import explode_elements, extract

    def box(x, z, half):
        return [{"lon": x + a * half, "lat": z + b * half} for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]

    def relation(number, members):
        return {"type": "relation", "id": number, "tags": {"landuse": "grass"}, "members": [{"type": "way", "ref": n, "role": r, "geometry": g} for n, (r, g) in enumerate(members)]}

    elements = [
        relation(1, [("outer", box(0, 0, 0.1)), ("outer", box(1, 1, 0.1))]),  # apart on both sides of the area
        relation(2, [("outer", box(0.5, 0.5, 0.3))]),  # holds the area
        relation(3, [("outer", box(0.5, 0.5, 0.4)), ("inner", box(0.5, 0.5, 0.2))]),  # holds it in a hole
        relation(4, [("outer", box(0.5, 0.5, 0.4)), ("inner", box(0.45, 0.5, 0.1))]),  # the hole ends inside it
    ]
    documents = spark.createDataFrame([(1, json.dumps(elements))], "area_id long, body string").select(
        "area_id", F.from_json("body", f"array<{ELEMENT}>").alias("elements")
    )
    ring = F.array(*[F.struct(F.lit(p["lon"]).alias("lon"), F.lit(p["lat"]).alias("lat")) for p in box(0.5, 0.5, 0.08)])
    areas = spark.range(1).select(F.lit(1).cast("long").alias("area_id"), ring.alias("area_ring"))
    assert {r.id for r in extract(explode_elements(documents), areas).collect()} == {2, 4}


def test_pieces_of_repeated_buildings_are_numbered_together(spark):
    ring = [(0.0, 0.0), (12.0, 0.0), (12.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    schema = "area_id int, source_id string, rings array<array<struct<x:double,z:double>>>, height double"
    once = spark.createDataFrame([(1, "a", [ring], 9.0)], schema)
    one = S.footprint_samples(once)
    assert not any("Window" in line or "Exchange" in line for line in one._jdf.queryExecution().executedPlan().toString().splitlines())
    rows = sorted(one.collect(), key=lambda r: r.piece)
    assert [r.piece for r in rows] == list(range(1, len(rows) + 1)) and [(r.column, r.row, r.floor) for r in rows] == sorted((r.column, r.row, r.floor) for r in rows)
    twice = S.footprint_samples(once.unionByName(once).unionByName(spark.createDataFrame([(1, "b", [ring], 9.0), (None, None, [ring], 9.0)], schema))).collect()
    assert sorted(r.piece for r in twice if r.source_id == "a") == list(range(1, min(150, 2 * len(rows)) + 1))
    assert sorted(r.piece for r in twice if r.source_id == "b") == sorted(r.piece for r in twice if r.source_id is None) == [r.piece for r in rows]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_at_roads_need_one_road(spark):
    rng = random.Random(8)
    lines = [(1, n, 0, *[rng.uniform(-300, 300) for _ in range(4)], rng.choice([4.0, 9.0])) for n in range(80)]
    pts = [(1, n, rng.uniform(-400, 400), rng.uniform(-400, 400)) for n in range(300)] + [(None, 900, 0.0, 0.0), (2, 901, 0.0, 0.0)]
    met = S.meets_road(
        spark.createDataFrame(pts, "area_id int, id int, px double, pz double"),
        spark.createDataFrame(lines * 2, "area_id int, way_id int, idx int, ax double, az double, bx double, bz double, width double"), ["id"],
    )
    assert "LeftSemi" in _plan(met) and "Inner" not in _plan(met)

    def near(p, s):
        dx, dz = s[5] - s[3], s[6] - s[4]
        t = max(0, min(1, ((p[2] - s[3]) * dx + (p[3] - s[4]) * dz) / (dx * dx + dz * dz)))
        return math.hypot(p[2] - s[3] - t * dx, p[3] - s[4] - t * dz) <= s[7] / 2 + 0.5

    assert sorted(r.id for r in met.collect()) == [p[1] for p in pts if p[0] == 1 and any(near(p, s) for s in lines)]


def test_points_keep_their_partitions_on_a_small_grid(spark):
    dem = spark.createDataFrame([(1, r, c, float(r + c)) for r in range(3) for c in range(3)], "area_id int, row int, col int, height double")
    head = E.summary(dem).selectExpr("*", "0D AS west", "2D AS east", "0D AS south", "2D AS north")
    points = spark.range(4).selectExpr("cast(id - id + 1 AS int) AS area_id", "id", "id / 2D AS lon", "id / 2D AS lat").repartition(3, "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = E.sample(points, dem, head)
        assert _plan(found).count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in _plan(found)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.id: r.height for r in found.collect()} == {0: 0.0, 1: 1.0, 2: 2.0, 3: 3.0}


def test_rows_are_dealt_out_by_their_number(spark):
    df = spark.range(1000).selectExpr("1 AS area_id", "id % 90 AS way_id", "id AS idx")
    assert O.spread(df, ["area_id", "way_id"], 100).rdd.getNumPartitions() == 10 and O.spread(df, ["area_id", "way_id"], 500) is df


def test_sizes_of_keys_are_one_job(spark):
    df = spark.range(1000).selectExpr("1 AS area_id", "nullif(id % 90, 7) AS way_id", "id AS idx")
    assert O.key_sizes(df, ["area_id", "way_id"]) == (1000, 12) and O.key_sizes(df.limit(0), ["area_id"]) == (0, 0)
    assert O.spread(df, ["area_id", "way_id"], 100, 1000).rdd.getNumPartitions() == 10


def test_draped_points_are_sorted_once(spark):
    """Roads are looked up by points that stay in their order; before, the join lost it and all dense points were sorted again."""
    nodes = spark.createDataFrame([(1, w, i, 30.0 * i, 9.0 * w) for w in range(40) for i in range(4)], "area_id long, way_id long, idx long, x double, z double")
    roads = spark.createDataFrame([(1, w, w % 3 - 1, w % 5 == 0, w % 7 == 0) for w in range(40)], "area_id long, way_id long, layer int, bridge boolean, tunnel boolean")
    grid = spark.createDataFrame([(1, r, c, 10.0 * r + c) for r in range(3) for c in range(3)], "area_id long, row int, col int, height double")
    box = {"west": -100.0, "east": 100.0, "south": -100.0, "north": 100.0}
    headers = E.summary(grid).withColumns({k: F.lit(v) for k, v in box.items()})
    draped = drape_roads(nodes, roads, grid, headers)
    over = _plan(draped).partition("Generate explode(sequence")[0]
    assert over.count("+- Sort ") == 1 and "ShuffledHashJoin" in over
    plain = drape_roads(nodes, F.broadcast(roads), grid, headers)
    assert sorted(map(tuple, draped.select(*sorted(draped.columns)).collect())) == sorted(map(tuple, plain.select(*sorted(draped.columns)).collect()))


def test_small_files_are_dealt_out(spark, tmp_path):
    spark.range(40).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    found = table(spark, str(tmp_path), "part")
    assert found.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and sorted(r.id for r in found.collect()) == list(range(40))


def test_openings_and_pixels_are_never_broadcast(spark):
    wall = "0D AS a_lon, 0D AS a_lat, 1e-4D AS b_lon, 0D AS b_lat"
    openings = spark.range(2).selectExpr("'s' AS source_id", "cast(id AS int) AS ordinal", "'window' AS kind", "1 AS cars", "1D AS width", "1D AS sill", "0.5D AS fraction", *wall.split(", "))
    walls = spark.range(1).selectExpr("'s' AS source_id", *wall.split(", "))
    found = opening_errors(openings, walls)
    assert "BroadcastHashJoin" not in _plan(found) and [tuple(r) for r in found.collect()] == [("s", 0, "overlap")]
    pixels = spark.range(100).selectExpr("1 AS image_id", "cast(id % 10 AS int) AS x", "cast(id / 10 AS int) AS y", "9 AS r", "9 AS g", "9 AS b")
    ring = "array(struct(2D AS x, 2D AS y), struct(7D AS x, 2D AS y), struct(7D AS x, 7D AS y), struct(2D AS x, 2D AS y))"
    houses = spark.range(1).selectExpr("1 AS image_id", "'s' AS source_id", "struct(10 AS width, 10 AS height) AS image", f"{ring} AS pixel_ring")
    assert "BroadcastHashJoin" not in _plan(roof_tensor(houses, pixels))


def test_roof_planes_are_short(spark):
    ring = "array(struct(0D AS x, 0D AS z), struct(8D AS x, 0D AS z), struct(8D AS x, 4D AS z), struct(0D AS x, 4D AS z), struct(0D AS x, 0D AS z))"
    df = spark.range(1).selectExpr(f"{ring} AS ring").select(roof_planes(F.col("ring"), F.lit(3.0), F.lit("hipped"), F.lit(False)).alias("r"))
    assert df._jdf.queryExecution().analyzed().toString().count("namedlambdavariable") < 200
    row = df.first().r
    assert (row.axis_x, row.axis_z, len(row.planes)) == (1.0, 0.0, 4) and tuple(row.planes[0]) == (0.0, 1.5, 0.0)


def test_nearest_few_never_lists_far_segments(spark):
    rng = random.Random(8)
    segs = [(1, n, 0, x, z, x + rng.uniform(-9, 9), z + rng.uniform(-9, 9)) for n in range(600) for x, z in ((rng.uniform(-40, 70), rng.uniform(-40, 70)),)]
    segs += [(1, 600 + n, 0, 300.0 + 30 * n, 0.0, 300.0 + 30 * n, 64.0) for n in range(4)]
    spots = [(1, n, rng.uniform(-30, 60), rng.uniform(-30, 60)) for n in range(20)] + [(1, 20, 310.0, 5.0), (1, 21, 32.0, -32.0), (1, 22, None, 1.0)]
    parts = spark.createDataFrame(segs, "area_id int, way_id int, idx int, ax double, az double, bx double, bz double")
    points = spark.createDataFrame(spots, "area_id int, id int, px double, pz double")
    near = R.nearest_few(points, parts, 3, 150.0).collect()
    assert len({(r.id, r.way_id) for r in near}) == len(near) < 23 * 120  # all within reach would be some 13,000

    def distance(p, s):
        (px, pz), (ax, az, bx, bz) = p[2:], s[3:]
        t = max(0.0, min(1.0, ((px - ax) * (bx - ax) + (pz - az) * (bz - az)) / ((bx - ax) ** 2 + (bz - az) ** 2)))
        return math.hypot(px - ax - t * (bx - ax), pz - az - t * (bz - az))

    for p in spots[:-1]:
        want = sorted((distance(p, s), s[1]) for s in segs)[:3]
        got = sorted((r.distance, r.way_id) for r in near if r.id == p[1])[:3]
        assert [w for _, w in got] == [w for d, w in want if d < 150] and all(abs(a - b) < 1e-9 for (a, _), (b, _) in zip(got, want))


def test_crowded_starts_bound_points_closely(spark):
    """Where the smallest cells are crowded, finer ones tell the bound: a point meets few of thousands of segments."""
    rng = random.Random(21)
    segs = [(1, n, 0, x, z, x + rng.uniform(-6, 6), z + rng.uniform(-6, 6)) for n in range(6000) for x, z in ((rng.uniform(0, 12), rng.uniform(0, 12)),)]
    segs += [(1, 9000, 0, None, 0.0, 1.0, 1.0)]
    parts = spark.createDataFrame(segs, "area_id int, way_id int, idx int, ax double, az double, bx double, bz double")
    spots = [(1, n, rng.uniform(1, 11), rng.uniform(1, 11)) for n in range(20)] + [(1, 20, 90.0, 5.0), (1, 21, None, 5.0)]
    points = spark.createDataFrame(spots, "area_id int, id int, px double, pz double")

    def gap(p, s):
        dx, dz = s[5] - s[3], s[6] - s[4]
        t = max(0, min(1, ((p[2] - s[3]) * dx + (p[3] - s[4]) * dz) / (dx * dx + dz * dz)))
        return math.hypot(p[2] - s[3] - t * dx, p[3] - s[4] - t * dz)

    near = R.nearest_few(points, parts, 3, 150.0).collect()
    for p in spots[:21]:
        want = sorted((gap(p, s), s[1]) for s in segs[:6000])[:3]
        assert sorted((r.distance, r.way_id) for r in near if r.id == p[0] * p[1])[:3] == [(pytest.approx(d, abs=1e-9), w) for d, w in want]
    assert sum(r.id < 20 for r in near) < 20 * 1200
    first = {r.id: r.way_id for r in R.nearest_segment(points, parts, ["id"], ["way_id", "idx"], []).collect()}
    assert first == {p[1]: min((gap(p, s), s[1]) for s in segs[:6000])[1] for p in spots[:21]}


def test_points_at_one_place_are_measured_once(spark, monkeypatch):
    sizes, plain = [], ranking.nearest_few
    monkeypatch.setattr(ranking, "nearest_few", lambda places, *rest: sizes.append(places.count()) or plain(places, *rest))
    parts = spark.createDataFrame([(1, n, 0, 0.0, float(n), 9.0, float(n)) for n in range(30)], "area_id int, way_id int, idx int, ax double, az double, bx double, bz double")
    rows = [(1, n, 4.0, 7.2) for n in range(50)] + [(1, 50, 4.0, 20.6), (1, 50, 4.0, 20.6), (1, None, None, 1.0)]
    points = spark.createDataFrame(rows, "area_id int, id int, px double, pz double")
    got = ranking.nearest_attachments(points, parts, ["id"], 150.0, 3).collect()
    assert sizes == [3] and sorted((r.id, r.way_id, r["rank"]) for r in got) == sorted(
        [(n, w, k) for n in range(50) for k, w in enumerate((7, 8, 6), 1)] + [(50, 21, 1), (50, 21, 2), (50, 20, 3)])


def never(*_, **__):
    raise AssertionError("pairs are listed")


def test_blocked_routes_need_one_building(spark, monkeypatch):
    monkeypatch.setattr(S, "cell_join", never)
    house = lambda x, z: [(x - 4.0, z - 4.0), (x + 4.0, z - 4.0), (x + 4.0, z + 4.0), (x - 4.0, z + 4.0), (x - 4.0, z - 4.0)]
    rings = [(1, "a", house(0.0, 0.0)), (1, "b", house(30.0, 0.0)), (1, None, house(0.0, 100.0)), (2, "b", house(0.0, 40.0))]
    buildings = spark.createDataFrame(rings, "area_id int, source_id string, ring array<struct<x:double,z:double>>")
    paths = {
        "out": [("a", 0, 4.0, 0.0), ("a", 1, 6.0, 0.0), ("a", 2, 6.0, 40.0)], "through": [("a", 0, 4.0, 0.0), ("a", 1, 40.0, 0.0)],
        "back": [("a", 0, 8.0, 0.0), ("a", 1, 4.2, 0.0), ("a", 2, 20.0, 9.0)], "nobody": [(None, 0, 4.0, 100.0), (None, 1, 20.0, 100.0)],
    }
    routes = [(1, r, idx, x, z, 1.0, owner) for r, rows in paths.items() for owner, idx, x, z in rows]
    df = spark.createDataFrame(routes, "area_id int, route_id string, idx int, x double, z double, width double, owner_id string")
    assert sorted(r.route_id for r in S.blocked_routes(df, buildings).collect()) == ["back", "nobody", "through"]


def test_land_behind_other_land_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(S, "cell_join", never)
    rng = random.Random(4)
    ring = lambda x, z, w: [(x - w, z - w), (x + w, z - w / 2), (x + w, z + w), (x - w / 2, z + w), (x - w, z - w)]
    land = [(1, n, f"c{n}", [ring(x, z, w)] + ([ring(x, z, w / 3)] if n % 3 else [])) for n in range(300)
            for x, z, w in ((rng.uniform(-50, 50), rng.uniform(-50, 50), rng.uniform(20, 90)),)]
    areas = spark.createDataFrame(land, "area_id int, ordinal int, cover string, rings array<array<struct<x:double,z:double>>>")
    spots = [(1, n, rng.uniform(-200, 200), rng.uniform(-200, 200)) for n in range(300)] + [(1, 300, 500.0, 0.0), (1, 301, 0.0, None)]
    points = spark.createDataFrame(spots, "area_id int, id int, px double, pz double")

    def holds(r, px, pz):
        hit = False
        for (ax, az), (bx, bz) in zip(r, r[-1:] + r[:-1]):
            hit ^= (az > pz) != (bz > pz) and px < (bx - ax) * (pz - az) / (bz - az) + ax
        return hit

    def top(px, pz):
        found = [] if pz is None else [c for _, _, c, (outer, *holes) in land if holds(outer, px, pz) and not any(holds(h, px, pz) for h in holes)]
        return found[-1] if found else "ground"

    assert {r.id: r.cover for r in S.land_cover(points, areas, ["id"]).collect()} == {n: top(x, z) for _, n, x, z in spots}
    entries = R.cover(areas.withColumn("_b", R.ring_box(F.col("rings")[0])), "_b", 16.0)
    assert S._foremost(entries, "c", 16.0).count() * 4 < entries.count()


def test_copies_of_land_are_tried_once(spark, monkeypatch):
    """Of a hundred areas with the same rings the last alone enters the cells; a gap in the one in front opens the cell for the others."""
    sizes, plain = [], S._foremost
    monkeypatch.setattr(S, "_foremost", lambda entries, *rest: sizes.append(entries.count()) or plain(entries, *rest))
    square = lambda w: [(-w, -w), (w, -w), (w, w), (-w, w), (-w, -w)]
    land = [(1, n, f"c{n}", [square(40.0)]) for n in range(100)] + [(1, 200, "ring", [square(40.0), square(30.0)]), (1, 150, "part", [square(9.0)]), (1, None, "none", [square(40.0)])]
    areas = spark.createDataFrame(land, "area_id int, ordinal int, cover string, rings array<array<struct<x:double,z:double>>>")
    points = spark.createDataFrame([(1, n, x, 1.0) for n, x in enumerate((35.0, 20.0, 5.0, 60.0))], "area_id int, id int, px double, pz double")
    assert {r.id: r.cover for r in S.land_cover(points, areas, ["id"]).collect()} == {0: "ring", 1: "c99", 2: "part", 3: "ground"}
    assert sizes[0] == 12 and sizes[1] <= 36 + 36 + 4


def test_surface_height_meets_only_triangles_that_can_be_lowest(spark):
    rng = random.Random(12)
    rows = []
    for i in range(120):  # one over the other, each over all points, in heights of their own
        rows.append((1, (-300.0, 10.0 * i, -300.0), (500.0, 10.0 * i + 3, -300.0), (0.0, 10.0 * i + 5, 600.0)))
    for _ in range(60):  # small ones and slivers, some below the floor of the stack
        x, z = rng.uniform(0, 60), rng.uniform(0, 60)
        rows.append((1, *[(x + rng.uniform(-9, 9), rng.uniform(-4, 9), z + rng.uniform(-9, 9)) for _ in range(3)]))
    rows += [rows[0], (1, (1.0, 1.0, 1.0), (2.0, 1.0, 2.0), (3.0, 1.0, 3.0)), (1, (0.0, None, 0.0), (9.0, 1.0, 0.0), (0.0, 1.0, 9.0))]
    corner = "struct<x:double,y:double,z:double>"
    triangles = spark.createDataFrame(rows, f"area_id long, a {corner}, b {corner}, c {corner}")
    spots = [(1, i, rng.uniform(-20, 80), rng.uniform(-20, 80)) for i in range(150)] + [(1, 900, 16.0, 32.0), (1, 901, 5000.0, 0.0), (2, 902, 0.0, 0.0)]
    points = spark.createDataFrame(spots, "area_id long, id long, px double, pz double")

    def height(a, b, c, x, z):
        turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
        (p, q, r), s = ((n[0], n[2]) for n in (a, b, c)), (x, z)
        if None in (a[1], b[1], c[1]) or abs(turn(p, q, r)) < 1e-8:
            return None
        u, v = turn(s, q, r) / turn(p, q, r), turn(p, s, r) / turn(p, q, r)
        return u * a[1] + v * b[1] + (1 - u - v) * c[1] if min(u, v, 1 - u - v) >= -1e-8 else None

    want = {}
    for area, i, x, z in spots:
        found = [h for r in rows if area == r[0] and (h := height(*r[1:], x, z)) is not None]
        if found:
            want[i] = min(found)
    got = {r.id: r.height for r in S.surface_height(points, triangles, ["id"]).collect()}
    assert got.keys() == want.keys() and 900 in got and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)
    planes = S._planes(triangles).withColumns({"fx": F.lit(0), "fz": F.lit(0)})
    assert planes.count() == 180 and S._lowest(planes, "f", 16.0).where("least >= 10").count() == 0


def test_surface_heights_of_pairs_are_plain_columns(spark):
    """What stands over the join of points and triangles is compiled: no row generator works out each pair."""
    corner = "struct<x:double,y:double,z:double>"
    triangles = spark.createDataFrame([(1, (0.0, 1.0, 0.0), (9.0, 2.0, 0.0), (0.0, 3.0, 9.0))], f"area_id long, a {corner}, b {corner}, c {corner}")
    found = S.surface_height(spark.createDataFrame([(1, 5, 3.0, 3.0), (1, 6, 8.0, 8.0)], "area_id long, id long, px double, pz double"), triangles, ["id"])
    assert [tuple(r) for r in found.collect()] == [(1, 5, pytest.approx(2.0))]
    assert "Generate" not in _plan(found).partition("Join")[0]


def test_corridors_list_no_pairs_for_a_shuffle(spark):
    rng = random.Random(15)
    places = [(1, 4.0 * i, 4.0 * k, float((i * k) % 9)) for i in range(-6, 30) for k in range(-6, 30)]
    ground = spark.createDataFrame(places, "area_id long, x double, z double, height double")
    rows = []
    for way in range(8):
        x, z = rng.uniform(0, 100), rng.uniform(0, 100)
        for idx in range(5):
            nx, nz = x + rng.choice([0.0, 30.0, -25.0]), z + rng.choice([0.0, 40.0, -35.0])
            rows.append((1, way, idx, x, float(idx), z, nx, idx + 1.0, nz, 5.0 + way, way % 3 == 0))
            x, z = nx, nz
    rows += [rows[0], (1, 99, 0, None, 1.0, 0.0, 5.0, 1.0, 5.0, 6.0, False), (1, 98, 0, 0.0, 1.0, 0.0, 5.0, 1.0, 5.0, None, False)]
    parts = spark.createDataFrame(rows, "area_id long, way_id long, idx long, ax double, ay double, az double, bx double, by double, bz double, width double, tunnel boolean")
    want = {}
    for _, x, z, _ in places:
        for _, way, idx, ax, ay, az, bx, by, bz, width, _ in rows[:40]:
            dx, dz = bx - ax, bz - az
            square = dx * dx + dz * dz
            t = max(0.0, min(1.0, ((x - ax) * dx + (z - az) * dz) / square)) if square else 0.0
            d = math.hypot(x - ax - t * dx, z - az - t * dz)
            if d <= width / 2 + 8:
                want[x, z, way] = min(want.get((x, z, way), (math.inf,)), (round(d, 9), idx, ay + (by - ay) * t))
    met = T.corridor_matches(ground, parts, 4.0)
    got = {(r.px, r.pz, r.way_id): (r.distance, r.y) for r in met.collect()}
    assert got.keys() == want.keys() and met.count() == len(want)
    assert all(got[k] == pytest.approx((want[k][0], want[k][2]), abs=1e-6) for k in want)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" in plan and not [line for line in plan.splitlines() if "hashpartitioning" in line and "px#" in line.split("hashpartitioning")[1]]


def test_most_lines_and_areas_are_told_apart_by_boxes(spark):
    """Lines beside an area and lines inside an upright one never reach the edge by edge test, and results are those of a plain scan."""
    rng = random.Random(17)
    boxes = [(n, x, z, x + rng.uniform(0.05, 0.3), z + rng.uniform(0.05, 0.3)) for n in range(12) for x, z in [(rng.random(), rng.random())]]
    rings = [(1, n, [(x0, z0), (x1, z0), (x1, z1), (x0, z1), (x0, z0)]) for n, x0, z0, x1, z1 in boxes] + [(1, 90, [(0.1, 0.1), (0.9, 0.5), (0.1, 0.9), (0.1, 0.1)])]
    lines = [(1, n, [(x + rng.uniform(-0.2, 0.2), z + rng.uniform(-0.2, 0.2)) for _ in range(rng.randrange(1, 5))]) for n in range(60) for x, z in [(rng.random(), rng.random())]]
    ring = "array<struct<lon:double,lat:double>>"
    features, areas = spark.createDataFrame(lines, f"area_id int, way int, ring {ring}"), spark.createDataFrame(rings, f"area_id int, area int, area_ring {ring}")

    def clipped(line, box):
        """Whether a line of straight runs enters a rectangle, by its shares along the axes."""
        for a, b in zip(line, line[1:] or line):
            low, high = 0.0, 1.0
            for n in (0, 1):
                d = b[n] - a[n]
                if d == 0:
                    low, high = (low, high) if box[n] <= a[n] <= box[n + 2] else (1.0, 0.0)
                else:
                    low, high = max(low, min((box[n] - a[n]) / d, (box[n + 2] - a[n]) / d)), min(high, max((box[n] - a[n]) / d, (box[n + 2] - a[n]) / d))
            if low <= high:
                return True
        return False

    found = S.features_in_area(features, areas, 0.25)
    got = {(r.way, r.area) for r in found.where("area < 90").collect()}
    assert got == {(w, n) for _, w, line in lines for n, *box in boxes if clipped(line, box)} and 0 < len(got) < 700
    met = features.crossJoin(areas.drop("area_id")).withColumn("_frame", R.ring_box(F.col("area_ring"), 0.0, "lon", "lat"))
    side = S._side_of_box(F.col("ring.lon"), F.col("ring.lat"), *[f"_frame.{c}" for c in ("x0", "z0", "x1", "z1")], S._upright(F.col("area_ring")))
    told = met.withColumn("side", side).collect()
    assert all(r.side == (1 if (r.way, r.area) in got else -1) for r in told if r.area < 90 and len(r.ring) > 1)
    assert {r.side for r in told if r.area == 90} == {-1, 0} and {r.side for r in told if len(r.ring) == 1} == {0}


def test_barriers_of_copied_roads_are_worked_out_once(spark, monkeypatch):
    """Roads and courses that lie one over the other meet as one; the branches that they leave are as before."""
    from mapweave.operators import routes

    met = []
    plain = routes.within_distance
    monkeypatch.setattr(routes, "within_distance", lambda points, parts, reach: met.append((points.count(), parts.count())) or plain(points, parts, reach))
    across, up = [(-100.0, 0.0), (0.0, 0.0), (100.0, 0.0)], [(0.0, -100.0), (0.0, 0.0), (0.0, 100.0)]
    row = lambda way, line: [(1, way, i, x, z, 1.0) for i, (x, z) in enumerate(line)]
    roads = [r for n in range(20) for r in row(2 * n, across) + row(2 * n + 1, up)]
    points = spark.createDataFrame(roads, "area_id int, way_id int, idx int, x double, z double, y double")
    courses = points.where("way_id % 2 = 0").withColumnRenamed("way_id", "course_id")
    got = sorted((r.course_id, r["rank"], r.idx, r.way_id, r.at, r.side, r.x, r.y, r.z, round(r.yaw, 6)) for r in routes.barriers(courses, points).collect())
    assert got == [(2 * n, k + 1, 1, 1, 1, k, 0.0, 1.0, z, round(math.atan2(0.0, -z), 6)) for n in range(20) for k, z in enumerate((-5.0, 5.0))]
    assert met == [(1, 8)]
