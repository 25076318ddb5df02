"""Evidence from pixel tables: roofs, driveways and vegetation, kept clear of roads."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapweave.functions.geo import METRES_PER_DEGREE, map_to_pixel, pixel_to_map, pixel_window, radians
from mapweave.functions.geometry import edges, point_in_ring
from mapweave.functions.text import half_up, rgb_hex
from mapweave.operators.components import label_nodes
from mapweave.operators.grid import box, cell_join
from mapweave.operators.ranking import top_per_group
from mapweave.session import cut_lineage

KEY = ["image_id", "source_id"]
# Thresholds of the image measurements.
GRADIENT_FLOOR = 10.0
FLAT_TEXTURE, GABLE_ANISOTROPY = 0.06, 0.28
VEGETATION_STRIDE, VEGETATION_CELLS = 3, 5
DRIVEWAY_SAMPLES, DRIVEWAY_SCORE = 18, 0.48
ROAD_CLEARANCE = 0.35
CROWN_LIMIT = 8.0
CROP_METRES = 30.0
CROP_BLOCK = 64  # pixels
PLANT_COUNT = 16


def with_pixel_ring(buildings: DataFrame, images: DataFrame) -> DataFrame:
    """Buildings with their image's header ``image`` and their ring in pixels. Rings are positions in degrees."""
    header = images.select("image_id", F.struct(*[c for c in images.columns if c != "image_id"]).alias("image"))
    return buildings.join(header, "image_id").withColumn(
        "pixel_ring", F.transform("ring", lambda p: map_to_pixel(p["lon"], p["lat"], F.col("image")))
    )


def _inside(df: DataFrame) -> Column:
    return point_in_ring(F.col("pixel_ring"), F.col("x").cast("double"), F.col("y").cast("double"), "x", "y")


def roof_tensor(buildings: DataFrame, pixels: DataFrame) -> DataFrame:
    """Mean colour, gradient tensor and texture share of the roof, on every second pixel inside the ring.

    Only sampled pixels and their four neighbours meet the pixel table, in one equi-join.
    """
    xs, ys = F.transform("pixel_ring", lambda p: p["x"]), F.transform("pixel_ring", lambda p: p["y"])
    low = lambda v: F.greatest(F.lit(1), F.floor(F.array_min(v))).cast("int")
    high = lambda v, n: F.least(n - 2, F.ceil(F.array_max(v))).cast("int")
    span = lambda a, b: F.when(a <= b, F.sequence(a, b, F.lit(2))).otherwise(F.array().cast("array<int>"))
    grid = buildings.withColumn("y", F.explode(span(low(ys), high(ys, F.col("image.height"))))).withColumn(
        "x", F.explode(span(low(xs), high(xs, F.col("image.width"))))
    ).where(_inside(buildings)).select(*KEY, "x", "y")
    around = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))]))
    asked = grid.select(*KEY, F.col("x").alias("sx"), F.col("y").alias("sy"), around.alias("o")).select(
        *KEY, "sx", "sy", "o.*", (F.col("sx") + F.col("o.dx")).alias("x"), (F.col("sy") + F.col("o.dy")).alias("y")
    )
    light = F.col("r") * 0.299 + F.col("g") * 0.587 + F.col("b") * 0.114
    here = (F.col("dx") == 0) & (F.col("dy") == 0)
    pick = lambda c: F.max(F.when(here, F.col(c))).alias(c)
    at = lambda dx, dy: F.max(F.when((F.col("dx") == dx) & (F.col("dy") == dy), light))
    # Neither samples nor pixels show their true size in estimates: never broadcast them.
    sampled = asked.join(pixels.hint("merge"), ["image_id", "x", "y"]).groupBy(*KEY, "sx", "sy").agg(
        pick("r"), pick("g"), pick("b"), (at(1, 0) - at(-1, 0)).alias("gx"), (at(0, 1) - at(0, -1)).alias("gy")
    )
    strong = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) >= GRADIENT_FLOOR
    total = lambda v: F.coalesce(F.sum(F.when(strong, v)), F.lit(0.0))
    return sampled.groupBy(*KEY).agg(
        F.count("*").alias("samples"), F.avg("r").alias("red"), F.avg("g").alias("green"), F.avg("b").alias("blue"),
        total(F.col("gx") * F.col("gx")).alias("xx"), total(F.col("gy") * F.col("gy")).alias("yy"),
        total(F.col("gx") * F.col("gy")).alias("xy"), F.count_if(strong).alias("gradients"),
    )


def longest_wall_angle(ring: Column) -> Column:
    """Image direction of the longest wall; the first wins a tie."""
    def wall(e: Column, index: Column) -> Column:
        dx = (e["b"]["lon"] - e["a"]["lon"]) * F.cos(radians(e["b"]["lat"]))
        dy = e["b"]["lat"] - e["a"]["lat"]
        return F.struct(F.sqrt(dx * dx + dy * dy).alias("length"), (-index).alias("order"), F.atan2(-dy, dx).alias("angle"))

    return F.array_max(F.transform(edges(ring), wall))["angle"]


def roof_observations(buildings: DataFrame, pixels: DataFrame) -> DataFrame:
    """Roof shape, orientation, colour and confidence of each building."""
    measured = buildings.select(*KEY, longest_wall_angle(F.col("ring")).alias("wall")).join(roof_tensor(buildings, pixels), KEY, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    spread = zero("xx") - zero("yy")
    flat = measured.withColumns({
        "texture": F.coalesce(F.col("gradients") / F.greatest(F.lit(1), F.col("samples")), F.lit(0.0)),
        "anisotropy": F.sqrt(spread * spread + 4 * zero("xy") * zero("xy")) / F.greatest(F.lit(1.0), zero("xx") + zero("yy")),
        "ridge": 0.5 * F.atan2(2 * zero("xy"), spread) + math.pi / 2,
    })
    return flat.select(
        *KEY,
        F.when(F.col("texture") < FLAT_TEXTURE, "flat").when(F.col("anisotropy") > GABLE_ANISOTROPY, "gabled").otherwise("hipped").alias("shape"),
        F.when(F.abs(F.cos(F.col("ridge") - F.col("wall"))) >= math.sqrt(0.5), "along").otherwise("across").alias("orientation"),
        rgb_hex(zero("red"), zero("green"), zero("blue")).alias("color"),
        F.least(F.lit(0.88), F.greatest(F.lit(0.35), 0.38 + F.col("texture") * 1.8 + F.col("anisotropy") * 0.3)).alias("confidence"),
        "texture", "anisotropy",
    )


def vegetation_cells(buildings: DataFrame, pixels: DataFrame) -> DataFrame:
    """Green cells outside the building on every third pixel, by cell ``cx, cy`` with their strength."""
    stride = VEGETATION_STRIDE
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    green = (g > r * 1.08) & (g > b * 1.12) & (g - F.least(r, b) > 16) & (g < 205)
    coarse = pixels.where((F.col("x") % stride == 0) & (F.col("y") % stride == 0)).where(green)
    met = coarse.join(buildings.select(*KEY, "image", "pixel_ring"), "image_id")
    columns, rows = F.floor(F.col("image.width") / stride), F.floor(F.col("image.height") / stride)
    cells = met.withColumns({"cx": (F.col("x") / stride).cast("int"), "cy": (F.col("y") / stride).cast("int")})
    return cells.where((F.col("cx") < columns) & (F.col("cy") < rows) & ~_inside(cells)).select(
        *KEY, "cx", "cy", (F.col("cy") * columns + F.col("cx")).cast("bigint").alias("cell"),
        F.least(F.lit(1.0), (g - F.greatest(r, b)) / 60.0).alias("strength"),
    )


def vegetation_components(cells: DataFrame) -> DataFrame:
    """Four-connected groups of at least five green cells: centre, size and mean strength."""
    both = cut_lineage(cells.withColumn("area_id", F.struct(*KEY)))
    at = both.select("area_id", "cx", "cy", F.col("cell").alias("b"))
    links = None
    for axis in ("cx", "cy"):
        pair = both.withColumn(axis, F.col(axis) + 1).select("area_id", "cx", "cy", F.col("cell").alias("a")).join(
            at, ["area_id", "cx", "cy"]
        ).select("area_id", "a", "b")
        links = pair if links is None else links.unionByName(pair)
    labelled = label_nodes(both, links, "cell")
    grouped = labelled.groupBy("area_id", "root").agg(
        (F.avg("cx") * VEGETATION_STRIDE).alias("px"), (F.avg("cy") * VEGETATION_STRIDE).alias("py"),
        F.count("*").alias("cells"), F.avg("strength").alias("strength"),
    ).where(F.col("cells") >= VEGETATION_CELLS)
    order = Window.partitionBy("area_id").orderBy("root")
    return grouped.select("area_id.*", F.row_number().over(order).alias("number"), "root", "px", "py", "cells", "strength")


def plants(components: DataFrame, images: DataFrame) -> DataFrame:
    """Trees and bushes with their position, crown, height and confidence."""
    header = images.select("image_id", F.struct(*[c for c in images.columns if c != "image_id"]).alias("image"))
    placed = components.join(header, "image_id")
    image = F.col("image")
    wide = (image["east"] - image["west"]) * METRES_PER_DEGREE * F.cos(radians((image["north"] + image["south"]) / 2.0)) / image["width"]
    tall = (image["north"] - image["south"]) * METRES_PER_DEGREE / image["height"]
    radius = F.sqrt(F.col("cells") * VEGETATION_STRIDE * VEGETATION_STRIDE / math.pi) * F.sqrt(wide * tall)
    sized = placed.withColumns({"_r": radius, "_p": pixel_to_map(F.col("px"), F.col("py"), image)})
    tree = F.col("_r") >= 1.45
    limit = lambda v, low, high: F.least(F.lit(high), F.greatest(F.lit(low), v))
    return sized.select(
        *KEY, "number", F.concat(F.lit("aerial-landscape-"), F.col("number").cast("string")).alias("id"),
        F.when(tree, "tree").otherwise("bush").alias("kind"), F.col("_p.lon").alias("lon"), F.col("_p.lat").alias("lat"),
        limit(F.col("_r"), 0.5, CROWN_LIMIT).alias("crown_radius"),
        F.when(tree, limit(F.col("_r") * 2.4, 3.5, 16.0)).otherwise(limit(F.col("_r") * 1.35, 0.6, 2.2)).alias("height"),
        limit(0.45 + F.col("strength") * 0.45, 0.35, 0.9).alias("confidence"),
    )


def nearest_map_road(points: DataFrame, roads: DataFrame, keys: list[str], reach: float, cell: float = 0.0005) -> DataFrame:
    """Nearest road segment within ``reach`` metres, in metres about each point's latitude; the lowest road wins a tie.

    Points: ``area_id``, ``keys``, ``lon, lat``; roads: ``area_id, road_id, seq, a_lon, a_lat, b_lon, b_lat, width``.
    """
    scale = METRES_PER_DEGREE * F.cos(radians(F.col("lat")))
    wide, tall = F.lit(reach) / scale, F.lit(reach / METRES_PER_DEGREE)
    around = box(F.col("lon") - wide, F.col("lat") - tall, F.col("lon") + wide, F.col("lat") + tall)
    line = box(F.least("a_lon", "b_lon"), F.least("a_lat", "b_lat"), F.greatest("a_lon", "b_lon"), F.greatest("a_lat", "b_lat"))
    met = cell_join(points.select("area_id", *keys, "lon", "lat"), roads, around, line, cell)
    flat = met.withColumns({
        "_sx": scale, "_ax": (F.col("a_lon") - F.col("lon")) * scale, "_ay": (F.col("a_lat") - F.col("lat")) * METRES_PER_DEGREE,
        "_bx": (F.col("b_lon") - F.col("lon")) * scale, "_by": (F.col("b_lat") - F.col("lat")) * METRES_PER_DEGREE,
    }).withColumns({"_dx": F.col("_bx") - F.col("_ax"), "_dy": F.col("_by") - F.col("_ay")})
    squared = F.greatest(F.lit(1e-9), F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), -(F.col("_ax") * F.col("_dx") + F.col("_ay") * F.col("_dy")) / squared))
    hit = flat.withColumn("_t", ratio).withColumns({
        "_x": F.col("_ax") + F.col("_dx") * F.col("_t"), "_y": F.col("_ay") + F.col("_dy") * F.col("_t"),
        "_len": F.greatest(F.lit(1e-9), F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))),
    }).withColumn("distance", F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y"))).where(F.col("distance") <= reach)
    best = hit.groupBy("area_id", *keys).agg(F.min(F.struct(
        "distance", "road_id", "seq", (F.col("lon") + F.col("_x") / F.col("_sx")).alias("road_lon"),
        (F.col("lat") + F.col("_y") / METRES_PER_DEGREE).alias("road_lat"), F.col("width").alias("road_width"),
        (F.col("_dx") / F.col("_len")).alias("dir_x"), (F.col("_dy") / F.col("_len")).alias("dir_y"),
    )).alias("_b"))
    return best.select("area_id", *keys, "_b.*")


def offset_from_road(lon: Column, lat: Column, clearance: Column, fallback_lon: Column, fallback_lat: Column) -> Column:
    """Point at a clearance from the road point, on the source's side, else the fallback's, else the road's normal."""
    scale = METRES_PER_DEGREE * F.cos(radians(lat))

    def away(x: Column, y: Column) -> Column:
        return F.struct(((x - F.col("road_lon")) * scale).alias("x"), ((y - F.col("road_lat")) * METRES_PER_DEGREE).alias("y"))

    size = lambda v: F.sqrt(v["x"] * v["x"] + v["y"] * v["y"])
    own, other = away(lon, lat), away(fallback_lon, fallback_lat)
    normal = F.struct((-F.col("dir_y")).alias("x"), F.col("dir_x").alias("y"))
    side = F.when(size(own) >= 0.05, own).when(size(other) >= 0.05, other).otherwise(normal)
    length = F.nullif(size(side), F.lit(0.0))
    return F.struct(
        (F.col("road_lon") + side["x"] / length / scale * clearance).alias("lon"),
        (F.col("road_lat") + side["y"] / length / METRES_PER_DEGREE * clearance).alias("lat"),
    )


def clear_of_roads(found: DataFrame, buildings: DataFrame, roads: DataFrame) -> DataFrame:
    """Plants pushed out of the nearest road's clearance. Adds ``moved``.

    Only the nearest road counts. No plant farther from it than half the widest road of the data, the largest crown and
    the clearance can be moved, so that is how far is searched. ``buildings``: keys, ``area_id``, ``ring``; ``found`` as of ``plants``.
    """
    mean = lambda axis: F.aggregate("ring", F.lit(0.0), lambda s, p: s + p[axis]) / F.size("ring")
    centers = buildings.select(*KEY, "area_id", mean("lon").alias("mid_lon"), mean("lat").alias("mid_lat"))
    spots = found.join(centers, KEY)
    widest = float(roads.agg(F.max("width")).first()[0] or 0.0)
    near = nearest_map_road(spots, roads, [*KEY, "number"], widest / 2.0 + CROWN_LIMIT + ROAD_CLEARANCE)
    joined = spots.join(near, ["area_id", *KEY, "number"], "left")
    clearance = F.col("road_width") / 2.0 + F.col("crown_radius") + ROAD_CLEARANCE
    moved = F.coalesce(F.col("distance") < clearance, F.lit(False))
    target = offset_from_road(F.col("lon"), F.col("lat"), clearance, F.col("mid_lon"), F.col("mid_lat"))
    return joined.withColumn("moved", moved).withColumn("_t", F.when(F.col("moved"), target)).select(
        "area_id", *found.columns[:5], F.coalesce("_t.lon", "lon").alias("lon"), F.coalesce("_t.lat", "lat").alias("lat"),
        "crown_radius", "height", "confidence", "moved",
    )


def _metres(a: Column, b: Column) -> Column:
    east = (a["lon"] - b["lon"]) * METRES_PER_DEGREE * F.cos(radians((a["lat"] + b["lat"]) / 2.0))
    north = (a["lat"] - b["lat"]) * METRES_PER_DEGREE
    return F.sqrt(east * east + north * north)


PLANT = ("id", "kind", "lon", "lat", "crown_radius", "height", "confidence", "moved")


def keep_apart(found: DataFrame, count: int = PLANT_COUNT) -> DataFrame:
    """Drop moved trees that collide with a tree that stayed or with one accepted before; then the largest crowns.

    In order of crown size per building. An image bounds the number of its plants.
    """
    item = F.struct((-F.col("crown_radius")).alias("o"), F.col("number").alias("n"), *PLANT)
    listed = found.groupBy("area_id", *KEY).agg(F.array_sort(F.collect_list(item)).alias("_all"))
    still = F.filter("_all", lambda p: ~p["moved"] & (p["kind"] == "tree"))

    def hits(p: Column, q: Column) -> Column:
        return _metres(p, q) < F.greatest(F.lit(2.5), (p["crown_radius"] + q["crown_radius"]) * 0.65)

    def accept(kept: Column, p: Column) -> Column:
        clash = p["moved"] & (p["kind"] == "tree") & (
            F.exists(F.col("_still"), lambda q: hits(p, q)) | F.exists(kept, lambda q: (q["kind"] == "tree") & hits(p, q))
        )
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(p)))

    folded = listed.withColumn("_still", still).withColumn("_kept", F.aggregate("_all", F.slice("_all", 1, 0), accept))
    return folded.select("area_id", *KEY, F.posexplode(F.slice("_kept", 1, count)).alias("place", "_p")).select(
        "area_id", *KEY, "place", *[f"_p.{c}" for c in PLANT]
    )


def unique_in_tile(found: DataFrame, tile: list[str]) -> DataFrame:
    """Drop plants that repeat one of an earlier building of the tile: same kind, within 0.6 of the lesser crown.

    At most sixty buildings with sixteen plants per tile.
    """
    item = F.struct("source_id", "place", *PLANT)
    listed = found.groupBy(*tile).agg(F.array_sort(F.collect_list(item)).alias("_all"))

    def accept(kept: Column, p: Column) -> Column:
        seen = F.exists(kept, lambda q: (q["kind"] == p["kind"]) & (
            _metres(p, q) < F.greatest(F.lit(1.0), F.least(p["crown_radius"], q["crown_radius"]) * 0.6)))
        return F.when(seen, kept).otherwise(F.concat(kept, F.array(p)))

    return listed.select(*tile, F.explode(F.aggregate("_all", F.slice("_all", 1, 0), accept)).alias("_p")).select(*tile, "_p.*")


def landscaping_totals(found: DataFrame) -> DataFrame:
    """Trees, bushes and mean confidence of each building."""
    return found.groupBy(*KEY).agg(
        F.count_if(F.col("kind") == "tree").alias("trees"), F.count_if(F.col("kind") != "tree").alias("bushes"),
        F.avg("confidence").alias("confidence"),
    )


def driveway_candidates(buildings: DataFrame, roads: DataFrame) -> DataFrame:
    """Walls of at least three metres with a road 2 to 45 metres from their middle, and the road's near edge."""
    walls = buildings.select("area_id", *KEY, "image", F.posexplode(edges(F.col("ring"))).alias("wall", "e")).select(
        "area_id", *KEY, "image", "wall", ((F.col("e.a.lon") + F.col("e.b.lon")) / 2.0).alias("lon"),
        ((F.col("e.a.lat") + F.col("e.b.lat")) / 2.0).alias("lat"),
        ((F.col("e.b.lon") - F.col("e.a.lon")) * METRES_PER_DEGREE * F.cos(radians((F.col("e.a.lat") + F.col("e.b.lat")) / 2.0))).alias("_wx"),
        ((F.col("e.b.lat") - F.col("e.a.lat")) * METRES_PER_DEGREE).alias("_wy"),
    ).where(F.sqrt(F.col("_wx") * F.col("_wx") + F.col("_wy") * F.col("_wy")) >= 3)
    near = nearest_map_road(walls, roads, [*KEY, "wall"], 45.0).where("distance >= 2")
    joined = walls.join(near, ["area_id", *KEY, "wall"])
    rx = (F.col("road_lon") - F.col("lon")) * METRES_PER_DEGREE * F.cos(radians(F.col("lat")))
    ry = (F.col("road_lat") - F.col("lat")) * METRES_PER_DEGREE
    length = F.greatest(F.lit(1e-9), F.sqrt(rx * rx + ry * ry))
    # Normals of the way and of the road make the same angle as their directions.
    turn = F.abs((rx * F.col("dir_x") + ry * F.col("dir_y")) / length)
    edge = offset_from_road(F.col("lon"), F.col("lat"), F.col("road_width") / 2.0 + turn * 1.35 + 0.03, F.col("lon"), F.col("lat"))
    return joined.withColumn("edge", edge).select("area_id", *KEY, "image", "wall", "lon", "lat", "road_id", "distance", "edge")


def driveways(candidates: DataFrame, pixels: DataFrame) -> DataFrame:
    """Best wall per building by the share of paved samples on its way to the road; the first wall wins a tie."""
    start = map_to_pixel(F.col("lon"), F.col("lat"), F.col("image"))
    end = map_to_pixel(F.col("edge.lon"), F.col("edge.lat"), F.col("image"))
    lined = candidates.withColumns({"_s": start, "_e": end}).withColumn(
        "_i", F.explode(F.sequence(F.lit(2), F.lit(DRIVEWAY_SAMPLES - 3)))
    )
    share = F.col("_i") / float(DRIVEWAY_SAMPLES)
    on = lambda axis, size: F.greatest(F.lit(0), F.least(
        F.col(f"image.{size}") - 1, half_up(F.col(f"_s.{axis}") + (F.col(f"_e.{axis}") - F.col(f"_s.{axis}")) * share))).cast("int")
    asked = lined.select(*KEY, "wall", "road_id", "edge", on("x", "width").alias("x"), on("y", "height").alias("y"))
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    paved = (F.greatest(r, g, b) - F.least(r, g, b) < 42) & ((r + g + b) / 3.0 > 55) & ((r + g + b) / 3.0 < 235)
    scored = asked.join(pixels.hint("merge"), ["image_id", "x", "y"], "left").groupBy(*KEY, "wall", "road_id", "edge").agg(
        (F.count_if(paved) / float(DRIVEWAY_SAMPLES - 4)).alias("score")
    )
    best = scored.groupBy(*KEY).agg(F.max(F.struct("score", (-F.col("wall")).alias("_w"), "road_id", "edge")).alias("_b"))
    return best.select(
        *KEY, (-F.col("_b._w")).alias("wall"), "_b.road_id", "_b.edge", "_b.score", (F.col("_b.score") >= DRIVEWAY_SCORE).alias("detected")
    )


def windows(buildings: DataFrame, images: DataFrame, padding: float = CROP_METRES) -> DataFrame:
    """Each building's pixel window: its ring's bounds and a margin in metres. Buildings: keys, ``ring`` in degrees."""
    lons, lats = F.transform("ring", lambda p: p["lon"]), F.transform("ring", lambda p: p["lat"])
    middle = F.aggregate(lats, F.lit(0.0), lambda s, v: s + v) / F.size("ring")
    tall = padding / METRES_PER_DEGREE
    wide = padding / (METRES_PER_DEGREE * F.greatest(F.lit(0.2), F.cos(radians(middle))))
    wanted = F.struct(
        (F.array_min(lons) - wide).alias("west"), (F.array_min(lats) - tall).alias("south"),
        (F.array_max(lons) + wide).alias("east"), (F.array_max(lats) + tall).alias("north"),
    )
    header = images.select("image_id", F.struct(*[c for c in images.columns if c != "image_id"]).alias("_i"))
    sized = buildings.join(header, "image_id").withColumn("_w", pixel_window(F.col("_i"), wanted))
    return sized.select(*KEY, "_w.*")


def cropped(buildings: DataFrame, found: DataFrame, pixels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Buildings, images and pixels in which every building has an image of its own, cut from the shared one.

    ``found``: rows of ``windows``. The new ``image_id`` is a struct of the old one and the building. Pixels and windows
    meet by blocks of the image, so a pixel is compared only with the windows over its block.
    """
    own = F.struct("image_id", "source_id").alias("image_id")
    span = lambda low, high: F.sequence(
        F.floor(F.col(low) / CROP_BLOCK), F.floor((F.col(high) - 1) / CROP_BLOCK))
    blocks = found.withColumn("bx", F.explode(span("left", "right"))).withColumn("by", F.explode(span("top", "bottom")))
    tiled = pixels.withColumns({"bx": F.floor(F.col("x") / CROP_BLOCK), "by": F.floor(F.col("y") / CROP_BLOCK)})
    cut = tiled.join(blocks, ["image_id", "bx", "by"]).where(
        (F.col("x") >= F.col("left")) & (F.col("x") < F.col("right")) & (F.col("y") >= F.col("top")) & (F.col("y") < F.col("bottom"))
    ).select(own, (F.col("x") - F.col("left")).cast("int").alias("x"), (F.col("y") - F.col("top")).cast("int").alias("y"), "r", "g", "b")
    frames = found.select(
        own, "west", "south", "east", "north", (F.col("right") - F.col("left")).cast("int").alias("width"),
        (F.col("bottom") - F.col("top")).cast("int").alias("height"),
    )
    kept = [c for c in buildings.columns if c not in ("image_id", "image", "pixel_ring")]
    return with_pixel_ring(buildings.select(own, *kept), frames), frames, cut


def tile_report(inside: DataFrame, pending: DataFrame, analysed: DataFrame, tile: list[str]) -> DataFrame:
    """Analysed, failed and skipped buildings of each tile, and the failed ones, at most as many as a tile may have pending.

    ``inside``: all buildings of the tiles; those not pending are skipped; pending ones without an analysis have failed.
    """
    row = [*tile, "source_id"]
    asked = pending.select(*row).distinct().withColumn("_asked", F.lit(True))
    done = analysed.select(*row).distinct().withColumn("_ok", F.lit(True))
    failed = F.col("_asked") & F.col("_ok").isNull()
    return inside.select(*row).distinct().join(asked, row, "left").join(done, row, "left").groupBy(*tile).agg(
        F.count_if(F.col("_ok")).alias("analysed"), F.count_if(failed).alias("failed"), F.count_if(F.col("_asked").isNull()).alias("skipped"),
        F.array_sort(F.collect_set(F.when(failed, F.col("source_id")))).alias("failed_ids"),
    )


def largest_plants(found: DataFrame, count: int = PLANT_COUNT) -> DataFrame:
    return top_per_group(found, KEY, [F.col("crown_radius").desc(), F.col("number")], count)
