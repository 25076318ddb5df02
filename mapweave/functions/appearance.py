"""Building looks: defaults seeded by the identifier, and saved choices laid over tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mapweave.functions.text import is_hex_color

# Building words, finishes and palettes.
HOUSE_TYPES = ("house", "detached", "residential", "semidetached_house", "terrace", "bungalow")
FINISHES = ("brick", "siding", "stucco")
BRICK_WALLS = ("#a97964", "#916350", "#b69982")
PLAIN_WALLS = ("#d0c5b0", "#bbc6bc", "#d7d4c8")
ROOF_COLORS = ("#514d48", "#655b52", "#555e65")
# Tag key of each saved appearance field.
APPEARANCE_TAGS = {
    "roof": "roof:shape", "roof_orientation": "roof:orientation", "wall_color": "building:colour",
    "roof_color": "roof:colour", "material": "building:material",
}


def identity_seed(identifier: Column) -> Column:
    """Unsigned 32-bit multiply-by-31 seed over the characters of an identifier."""
    return F.aggregate(
        F.split(identifier, ""), F.lit(0).cast("bigint"),
        lambda seed, char: (seed * 31 + F.when(char == "", 0).otherwise(F.ascii(char))) % 4294967296,
    )


def _pick(options, seed: Column) -> Column:
    return F.element_at(F.array(*[F.lit(option) for option in options]), (seed % 3 + 1).cast("int"))


def safe_color(raw: Column, default: Column, named: tuple[str, ...] = ()) -> Column:
    """A six-digit hex colour, or one of the ``named`` colours the caller accepts; else the default."""
    known = is_hex_color(raw)
    if named:
        known = known | F.coalesce(F.lower(raw).isin(*named), F.lit(False))
    return F.when(known, F.lower(raw)).otherwise(default)


def building_appearance(source_id: Column, building: Column, height: Column, tags: Column,
                        named_colors: tuple[str, ...] = ()) -> Column:
    """Roof shape, rise, finish and colours, from tags where usable and from the seed elsewhere."""
    def tag(key: str) -> Column:
        return F.try_element_at(tags, F.lit(key))

    seed = identity_seed(source_id)
    kind = F.coalesce(building, F.lit(""))
    residential = kind.isin(*HOUSE_TYPES) | (kind.isin("", "yes") & (height <= 12))
    shape = F.nullif(tag("roof:shape"), F.lit(""))
    roof = (
        F.when(shape.isin("gabled", "hipped", "flat"), shape)
        .when(shape.isNotNull() | ~residential, "flat")
        .when(seed % 2 == 1, "gabled").otherwise("hipped")
    )
    leading = F.regexp_extract(F.coalesce(tag("roof:height"), F.lit("")), r"^\s*([+-]?(\d+\.?\d*|\.\d+))", 1)
    stated = leading.try_cast("double")
    pitched = F.least(
        height * 0.4, F.greatest(F.lit(0.0), height - 2.6),
        F.when(stated > 0, stated).otherwise(1.8 + (seed % 8) / 10.0),
    )
    rise = F.when(roof == "flat", F.lit(0.0)).otherwise(pitched)
    finish = F.coalesce(tag("building:material"), _pick(FINISHES, seed))
    wall = F.when(finish == "brick", _pick(BRICK_WALLS, seed)).otherwise(_pick(PLAIN_WALLS, seed))
    unset = [F.nullif(tag(key), F.lit("")).isNull() for key in ("roof:shape", "building:colour", "building:material")]
    return F.struct(
        roof.alias("roof"), rise.alias("rise"), finish.alias("finish"), residential.alias("residential"),
        (height - rise).alias("eaves"), safe_color(tag("building:colour"), wall, named_colors).alias("wall_color"),
        safe_color(tag("roof:colour"), _pick(ROOF_COLORS, seed), named_colors).alias("roof_color"),
        (unset[0] | unset[1] | unset[2]).alias("estimated"),
    )


def lay_over_tags(tags: Column, appearance: Column) -> Column:
    """Appearance tags with every saved, non-blank choice taking precedence."""
    pairs = F.array(*[
        F.struct(F.lit(key).alias("key"), F.nullif(appearance[name], F.lit("")).alias("value"))
        for name, key in APPEARANCE_TAGS.items()
    ])
    chosen = F.map_from_entries(F.filter(pairs, lambda pair: pair["value"].isNotNull()))
    kept = F.map_filter(tags, lambda key, _: ~F.map_contains_key(chosen, key))
    return F.when(appearance.isNull(), tags).otherwise(F.map_concat(kept, chosen))
