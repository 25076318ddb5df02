"""Coordinates: WGS84, Earth-centred and local metres, tiles, pixels and headings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS84 ellipsoid and metres per degree of latitude.
SEMI_MAJOR = 6_378_137.0
ECCENTRICITY_2 = 6.694_379_990_14e-3
METRES_PER_DEGREE = 111_320.0
TILE_METRES = 200.0
PREFETCH_METRES = 100.0


def radians(degrees: Column) -> Column:
    return degrees * math.pi / 180.0


def degrees(angle: Column) -> Column:
    return angle * 180.0 / math.pi


def normalize_bearing(bearing: Column) -> Column:
    return F.pmod(bearing, F.lit(360.0))


def ecef(lon: Column, lat: Column, height: Column) -> Column:
    """Earth-centred coordinates as a struct of x, y, z."""
    sin_lat, cos_lat = F.sin(radians(lat)), F.cos(radians(lat))
    radius = F.lit(SEMI_MAJOR) / F.sqrt(1 - ECCENTRICITY_2 * sin_lat * sin_lat)
    return F.struct(
        ((radius + height) * cos_lat * F.cos(radians(lon))).alias("x"),
        ((radius + height) * cos_lat * F.sin(radians(lon))).alias("y"),
        ((radius * (1 - ECCENTRICITY_2) + height) * sin_lat).alias("z"),
    )


def anchor_frame(lon: Column, lat: Column, height: Column | None = None) -> Column:
    """Origin and axis factors of a local frame; compute it once per area and join it to the points."""
    origin = ecef(lon, lat, F.lit(0.0) if height is None else height)
    return F.struct(
        origin["x"].alias("ox"), origin["y"].alias("oy"), origin["z"].alias("oz"),
        F.sin(radians(lat)).alias("slat"), F.cos(radians(lat)).alias("clat"),
        F.sin(radians(lon)).alias("slon"), F.cos(radians(lon)).alias("clon"),
    )


def local_enu(point: Column, frame: Column) -> Column:
    """East, north and up of an Earth-centred point about a frame."""
    dx, dy, dz = point["x"] - frame["ox"], point["y"] - frame["oy"], point["z"] - frame["oz"]
    slat, clat, slon, clon = (frame[name] for name in ("slat", "clat", "slon", "clon"))
    return F.struct(
        (clon * dy - slon * dx).alias("east"),
        (clat * dz - slat * (clon * dx + slon * dy)).alias("north"),
        (slat * dz + clat * (clon * dx + slon * dy)).alias("up"),
    )


def to_world(enu: Column) -> Column:
    """World axes: x east, z south, y up."""
    return F.struct(enu["east"].alias("x"), enu["up"].alias("y"), (-enu["north"]).alias("z"))


def frame_to_ecef(east: Column, north: Column, up: Column, frame: Column) -> Column:
    slat, clat, slon, clon = (frame[name] for name in ("slat", "clat", "slon", "clon"))
    level = clat * up - slat * north
    return F.struct(
        (frame["ox"] + clon * level - slon * east).alias("x"),
        (frame["oy"] + slon * level + clon * east).alias("y"),
        (frame["oz"] + clat * north + slat * up).alias("z"),
    )


def geodetic_latitude(point: Column, rounds: int = 8) -> Column:
    """Latitude in radians and height of an Earth-centred point by eight refinements.

    One aggregate expression: it stays small when a filter on the result is pushed through the projection.
    """
    flat = F.sqrt(point["x"] * point["x"] + point["y"] * point["y"])

    def refine(state: Column, _: Column) -> Column:
        sine = F.sin(state["phi"])
        radius = F.lit(SEMI_MAJOR) / F.sqrt(1 - ECCENTRICITY_2 * sine * sine)
        # Radius plus height equals the distance from the axis over the cosine.
        slant = flat / F.cos(state["phi"])
        return F.struct(
            F.atan2(point["z"], flat * (1 - ECCENTRICITY_2 * radius / slant)).alias("phi"), (slant - radius).alias("height")
        )

    start = F.struct(F.atan2(point["z"], flat * (1 - ECCENTRICITY_2)).alias("phi"), F.lit(0.0).alias("height"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, refine)


def with_geodetic(df: DataFrame, point: str, names=("lon", "lat", "height")) -> DataFrame:
    """Add longitude, latitude and height of an Earth-centred struct column."""
    lon, lat, height = names
    solved = df.withColumn("_geo", geodetic_latitude(F.col(point)))
    return solved.withColumns({
        lon: degrees(F.atan2(F.col(f"{point}.y"), F.col(f"{point}.x"))), lat: degrees(F.col("_geo.phi")), height: F.col("_geo.height"),
    }).drop("_geo")


def local_to_map(df: DataFrame, x: Column, z: Column, frame: Column, names=("lon", "lat", "height")) -> DataFrame:
    """World x and z as longitude and latitude."""
    zero = F.lit(0.0)
    return with_geodetic(df.withColumn("_ecef", frame_to_ecef(x, -z, zero, frame)), "_ecef", names).drop("_ecef")


def selection_ring(lon: Column, lat: Column, size_m: Column, bearing: Column) -> Column:
    """Closed ring of a square turned clockwise from north."""
    half, angle = size_m / 2.0, radians(bearing)
    scale = F.greatest(F.lit(0.15), F.cos(radians(lat))) * METRES_PER_DEGREE

    def corner(east: int, north: int) -> Column:
        return F.struct(
            (lon + half * (east * F.cos(angle) + north * F.sin(angle)) / scale).alias("lon"),
            (lat + half * (north * F.cos(angle) - east * F.sin(angle)) / METRES_PER_DEGREE).alias("lat"),
        )

    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1))


def ring_bounds(ring: Column) -> Column:
    """Envelope of a ring of positions."""
    lons, lats = F.transform(ring, lambda p: p["lon"]), F.transform(ring, lambda p: p["lat"])
    return F.struct(
        F.array_min(lons).alias("west"), F.array_min(lats).alias("south"),
        F.array_max(lons).alias("east"), F.array_max(lats).alias("north"),
    )


def bounds_match(left: Column, right: Column, tolerance: float = 1e-7) -> Column:
    agree = F.lit(True)
    for side in ("west", "south", "east", "north"):
        agree = agree & (F.abs(left[side] - right[side]) < tolerance)
    return agree


def bounds_ring(west: Column, south: Column, east: Column, north: Column) -> Column:
    def corner(lon: Column, lat: Column) -> Column:
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    return F.array(corner(west, south), corner(east, south), corner(east, north), corner(west, north), corner(west, south))


def with_extent(df: DataFrame) -> DataFrame:
    """Add ``extent_x`` and ``extent_y``: metres between opposite corners of west..north about their centre.

    The corners stand symmetrically about the centre, so flat columns per step keep the expressions small.
    """
    steps = df.withColumns({
        "_mid": radians((F.col("south") + F.col("north")) / 2.0),
        "_half": radians((F.col("east") - F.col("west")) / 2.0),
        "_sin1": F.sin(radians(F.col("south"))), "_cos1": F.cos(radians(F.col("south"))),
        "_sin2": F.sin(radians(F.col("north"))), "_cos2": F.cos(radians(F.col("north"))),
    }).withColumns({
        "_rad1": F.lit(SEMI_MAJOR) / F.sqrt(1 - ECCENTRICITY_2 * F.col("_sin1") * F.col("_sin1")),
        "_rad2": F.lit(SEMI_MAJOR) / F.sqrt(1 - ECCENTRICITY_2 * F.col("_sin2") * F.col("_sin2")),
    }).withColumns({"_out1": F.col("_rad1") * F.col("_cos1"), "_out2": F.col("_rad2") * F.col("_cos2")})
    # In the meridian plane of the centre the corners differ by this much outward and upward.
    outward = (F.col("_out2") - F.col("_out1")) * F.cos("_half")
    upward = (1 - ECCENTRICITY_2) * (F.col("_rad2") * F.col("_sin2") - F.col("_rad1") * F.col("_sin1"))
    return steps.withColumns({
        "extent_x": F.abs((F.col("_out1") + F.col("_out2")) * F.sin("_half")),
        "extent_y": F.abs(F.cos("_mid") * upward - F.sin("_mid") * outward),
    }).drop("_mid", "_half", "_sin1", "_cos1", "_sin2", "_cos2", "_rad1", "_rad2", "_out1", "_out2")


def bounds_area_km2(df: DataFrame, name: str = "area_km2") -> DataFrame:
    return with_extent(df).withColumn(name, F.col("extent_x") * F.col("extent_y") / 1_000_000.0).drop(
        "extent_x", "extent_y"
    )


def bounds_from_center(lon: Column, lat: Column, size_m: Column, cosine_floor: float = 0.15) -> Column:
    """Square bounds about a centre; imagery uses a cosine floor of 0.2."""
    dlat = size_m / 2.0 / METRES_PER_DEGREE
    dlon = dlat / F.greatest(F.lit(cosine_floor), F.cos(radians(lat)))
    return F.struct(
        (lon - dlon).alias("west"), (lat - dlat).alias("south"), (lon + dlon).alias("east"), (lat + dlat).alias("north")
    )


def area_label(size_m: Column) -> Column:
    return F.format_string("%.2f km²", size_m * size_m / 1_000_000.0)


def buffered_bounds(ring: Column, buffer_m: float) -> Column:
    """Envelope of a ring widened by a buffer at the mean latitude of its vertices."""
    box = ring_bounds(ring)
    mean = F.aggregate(ring, F.lit(0.0), lambda total, p: total + p["lat"]) / F.size(ring)
    dlat = F.lit(buffer_m / METRES_PER_DEGREE)
    dlon = dlat / F.greatest(F.lit(0.2), F.cos(radians(mean)))
    return F.struct(
        (box["west"] - dlon).alias("west"), (box["south"] - dlat).alias("south"),
        (box["east"] + dlon).alias("east"), (box["north"] + dlat).alias("north"),
    )


def contains_half_open(bounds: Column, lon: Column, lat: Column) -> Column:
    return (lon >= bounds["west"]) & (lon < bounds["east"]) & (lat >= bounds["south"]) & (lat < bounds["north"])


def contains_closed(bounds: Column, lon: Column, lat: Column) -> Column:
    return lon.between(bounds["west"], bounds["east"]) & lat.between(bounds["south"], bounds["north"])


def flat_distance(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    """Equirectangular metres at the middle latitude."""
    east = (lon_a - lon_b) * METRES_PER_DEGREE * F.cos(radians((lat_a + lat_b) / 2.0))
    north = (lat_a - lat_b) * METRES_PER_DEGREE
    return F.sqrt(east * east + north * north)


def local_bounds(west: Column, south: Column, east: Column, north: Column, frame: Column) -> Column:
    """World-axis envelope of the four corners."""
    corners = [
        to_world(local_enu(ecef(lon, lat, F.lit(0.0)), frame))
        for lon, lat in ((west, south), (west, north), (east, south), (east, north))
    ]
    return F.struct(
        F.least(*[c["x"] for c in corners]).alias("min_x"), F.least(*[c["z"] for c in corners]).alias("min_z"),
        F.greatest(*[c["x"] for c in corners]).alias("max_x"), F.greatest(*[c["z"] for c in corners]).alias("max_z"),
    )


def map_to_pixel(lon: Column, lat: Column, image: Column) -> Column:
    return F.struct(
        ((lon - image["west"]) / (image["east"] - image["west"]) * (image["width"] - 1)).alias("x"),
        ((image["north"] - lat) / (image["north"] - image["south"]) * (image["height"] - 1)).alias("y"),
    )


def pixel_to_map(x: Column, y: Column, image: Column) -> Column:
    return F.struct(
        (image["west"] + x / (image["width"] - 1) * (image["east"] - image["west"])).alias("lon"),
        (image["north"] - y / (image["height"] - 1) * (image["north"] - image["south"])).alias("lat"),
    )


def pixel_window(image: Column, wanted: Column) -> Column:
    """Half-open pixel window that covers wanted bounds, at least two pixels each way, with its own bounds."""
    width, height = image["width"], image["height"]
    per_x = (image["east"] - image["west"]) / width
    per_y = (image["north"] - image["south"]) / height
    left = F.greatest(F.lit(0), F.least(width - 2, F.floor((wanted["west"] - image["west"]) / per_x)))
    right = F.greatest(left + 2, F.least(width, F.ceil((wanted["east"] - image["west"]) / per_x)))
    top = F.greatest(F.lit(0), F.least(height - 2, F.floor((image["north"] - wanted["north"]) / per_y)))
    bottom = F.greatest(top + 2, F.least(height, F.ceil((image["north"] - wanted["south"]) / per_y)))
    return F.struct(
        left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"),
        (image["west"] + left * per_x).alias("west"), (image["north"] - bottom * per_y).alias("south"),
        (image["west"] + right * per_x).alias("east"), (image["north"] - top * per_y).alias("north"),
    )


def heading_degrees(qx: Column, qy: Column, qz: Column, qw: Column) -> Column:
    """Compass heading of a rotation whose forward axis is -z."""
    forward_x = -2 * (qx * qz + qw * qy)
    forward_z = -(1 - 2 * (qx * qx + qy * qy))
    return F.pmod(degrees(F.atan2(forward_x, -forward_z)), F.lit(360.0))


def tile_index(value: Column, size: float = TILE_METRES) -> Column:
    return F.floor(value / size)


def tile_key(tile_x: Column, tile_north: Column) -> Column:
    return F.concat_ws(":", tile_x.cast("string"), tile_north.cast("string"))


def tiles_for_pose(east: Column, north: Column, heading: Column, size: float = TILE_METRES,
                   prefetch: float = PREFETCH_METRES) -> Column:
    """The tile under a pose and, near its leading edge, the tile ahead."""
    tile_x, tile_n = tile_index(east, size), tile_index(north, size)
    go_east, go_north = F.sin(radians(heading)), F.cos(radians(heading))
    sideways = F.abs(go_east) > F.abs(go_north)
    step = F.when(F.when(sideways, go_east).otherwise(go_north) >= 0, 1).otherwise(-1)
    offset = F.when(sideways, east - tile_x * size).otherwise(north - tile_n * size)
    to_edge = F.when(step > 0, size - offset).otherwise(offset)
    here = F.struct(tile_x.alias("tile_x"), tile_n.alias("tile_north"))
    ahead = F.struct(
        (tile_x + F.when(sideways, step).otherwise(0)).alias("tile_x"),
        (tile_n + F.when(sideways, 0).otherwise(step)).alias("tile_north"),
    )
    return F.when(to_edge <= prefetch, F.array(here, ahead)).otherwise(F.array(here))
