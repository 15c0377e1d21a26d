"""Soft land covers of pixels: memberships by colour, and what other evidence makes of them.

Covers are columns lawn, scrub, dirt, paved, water and canopy. Each kind of
evidence is a function from covers to covers; masks are shares from 0 to 1 and
leave a pixel as it is where they are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COVERS = ("lawn", "scrub", "dirt", "paved", "water", "canopy")
Covers = dict[str, Column]

# What a coarse land cover class adds to which covers.
PRIOR = {
    "forest": {"canopy": 0.35},
    "shrub": {"scrub": 0.35},
    "grass": {"scrub": 0.2, "dirt": 0.1},
    "barren": {"dirt": 0.4},
    "crop": {"lawn": 0.15, "dirt": 0.15},
    "wetland": {"water": 0.1, "canopy": 0.2},
}


def smoothstep(x: Column, lo: float, hi: float) -> Column:
    t = F.least(F.greatest((x - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))
    return t * t * (3 - 2 * t)


def falling(x: Column, lo: float, hi: float) -> Column:
    return 1 - smoothstep(x, lo, hi)


def by_colour(r: Column, g: Column, b: Column) -> list[Column]:
    """Memberships from colour; scrub gives way to canopy, and 0.05 of it is everywhere."""
    total, top = r + g + b + 1e-3, F.greatest(r, g, b)
    excess_green, bright, warm = (2 * g - r - b) / total, total / 3.0, (r - b) / total
    saturation, bluer = (top - F.least(r, g, b)) / (top + 1e-3), b - r
    canopy = smoothstep(excess_green, 0.0, 0.08) * falling(bright, 55, 85)
    dry = falling(excess_green, 0.06, 0.12) * smoothstep(excess_green, -0.06, 0.02) * falling(bright, 115, 150)
    return [
        (smoothstep(excess_green, 0.04, 0.12) * smoothstep(bright, 60, 90)).alias("lawn"),
        (dry * (1 - canopy) + 0.05).alias("scrub"),
        (smoothstep(warm, 0.04, 0.12) * smoothstep(bright, 110, 150) * falling(excess_green, 0.0, 0.05)).alias("dirt"),
        (falling(saturation, 0.10, 0.22) * smoothstep(bright, 85, 115) * falling(excess_green, 0.01, 0.06)).alias("paved"),
        (smoothstep(bluer, 8, 25) * falling(bright, 80, 120) * falling(excess_green, 0.02, 0.08)).alias("water"),
        canopy.alias("canopy"),
    ]


def _less(covers: Covers, by: Column, *names: str) -> Covers:
    """The named covers (all, if none is named) without the share `by`."""
    return {n: c * (1 - by) if n in names or not names else c for n, c in covers.items()}


def _more(covers: Covers, **amounts: Column) -> Covers:
    return {n: c + amounts[n] if n in amounts else c for n, c in covers.items()}


def _least(covers: Covers, **floors: Column) -> Covers:
    return {n: F.greatest(c, floors[n]) if n in floors else c for n, c in covers.items()}


def kept_green(covers: Covers, mask: Column, sure: float = 0.6) -> Covers:
    """Land used as lawn: at least `sure` of it, the more the less canopy hides it."""
    hidden = F.lit(sure) + (1 - sure) * (1 - covers["canopy"])
    out = covers | {"lawn": covers["lawn"] + mask * (F.greatest(covers["lawn"], hidden) - covers["lawn"])}
    return _less(_less(out, 0.8 * mask, "scrub"), 0.6 * mask, "dirt")


def bare_ground(covers: Covers, mask: Column) -> Covers:
    return _less(_least(covers, dirt=mask), 0.8 * mask, "lawn")


def wild_land(covers: Covers, mask: Column, dry: float = 0.8) -> Covers:
    """What looks like lawn on wild land is mostly scrub."""
    return _less(_more(covers, scrub=dry * mask * covers["lawn"]), dry * mask, "lawn")


def coarse_prior(covers: Covers, masks: dict[str, Column]) -> Covers:
    """Weak evidence of a 10 m land cover map: masks by class of :data:`PRIOR`."""
    for kind, mask in masks.items():
        covers = _more(covers, **{n: w * mask for n, w in PRIOR[kind].items()})
    return covers


def tall_plants(covers: Covers, height: Column, canopy_m: float) -> Covers:
    tree = smoothstep(height, canopy_m * 0.8, canopy_m * 1.2)
    others = [n for n in COVERS if n != "canopy"]
    return _less(_least(covers, canopy=1.5 * tree), 0.8 * tree, *others)


def low_plants(covers: Covers, height: Column, canopy_m: float, shrub_m: float) -> Covers:
    """Knee to head high is scrub; what is flat is no canopy, and dark green there is lawn."""
    shrub = smoothstep(height, shrub_m * 0.5, shrub_m) * falling(height, canopy_m, canopy_m * 1.5)
    flat = falling(height, 0.2, shrub_m * 0.5)
    open_share = 1 - F.least(F.greatest(covers["lawn"], F.lit(0.0)), F.lit(1.0))
    out = _less(_more(covers, scrub=0.6 * shrub * open_share), 0.5 * shrub, "lawn")
    out = _less(out, 0.7 * flat, "canopy")
    return _more(out, lawn=0.5 * flat * out["canopy"])


def mapped_green(covers: Covers, mask: Column) -> Covers:
    """Lawns drawn on a map of their own."""
    return _least(covers, lawn=0.7 * mask, scrub=0.3 * mask)


def trails(covers: Covers, mask: Column) -> Covers:
    return _least(covers, dirt=1.5 * mask)


def pavement(covers: Covers, mask: Column) -> Covers:
    return _more(_less(covers, mask), paved=mask)


def open_water(covers: Covers, mask: Column, bright: Column, saturation: Column) -> Covers:
    """Water, but bright grey water is a covered or dry basin and counts as paved."""
    covered = mask * smoothstep(bright, 150, 190) * falling(saturation, 0.15, 0.3)
    return _more(_less(covers, mask), water=mask - covered, paved=covered)


def landcover_overrides(pixels: DataFrame, canopy_m: float, shrub_m: float, change_m: float) -> DataFrame:
    """Covers of each pixel after land use, coarse prior, heights, maps, paving and water, in that order.

    pixels: the covers; masks m_lawn, m_dirt, m_wild, m_green, m_trail, m_paved,
    m_water and p_<class> of :data:`PRIOR`; heights chm, ndsm and the ground's
    change since; v and sat of the image. Heights count less where the ground
    has changed.
    """
    fresh = falling(F.abs("change"), change_m * 0.6, change_m)
    evidence = [
        lambda c: kept_green(c, F.col("m_lawn")),
        lambda c: bare_ground(c, F.col("m_dirt")),
        lambda c: wild_land(c, F.col("m_wild")),
        lambda c: coarse_prior(c, {k: F.col(f"p_{k}") for k in PRIOR}),
        lambda c: tall_plants(c, F.col("chm") * fresh, canopy_m),
        lambda c: low_plants(c, F.col("ndsm") * fresh, canopy_m, shrub_m),
        lambda c: mapped_green(c, F.col("m_green")),
        lambda c: trails(c, F.col("m_trail")),
        lambda c: pavement(c, F.col("m_paved")),
        lambda c: open_water(c, F.col("m_water"), F.col("v"), F.col("sat")),
    ]
    for judge in evidence:  # a projection each, so that expressions don't grow into each other
        pixels = pixels.withColumns(judge({c: F.col(c) for c in COVERS}))
    return pixels


def shares(covers: Covers) -> Covers:
    """Covers as shares of their sum, negative ones as 0; all scrub where there is none."""
    positive = {n: F.greatest(c, F.lit(0.0)) for n, c in covers.items()}
    total = sum(list(positive.values())[1:], positive[COVERS[0]])
    return {n: F.when(total > 1e-6, c / total).otherwise(F.lit(1.0 if n == "scrub" else 0.0)) for n, c in positive.items()}


def mean_shares(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Mean share of each cover in bytes (weights that add up to 255 a pixel) per group, as a long table: by, cover, share."""
    from gridmill.functions.scalars import weights_to_bytes

    of = shares({c: F.col(c) for c in COVERS})
    pixels = pixels.withColumn("bytes", weights_to_bytes([of[c] for c in COVERS]))
    means = pixels.groupBy(*by).agg(*[(F.avg(F.get("bytes", i)) / 255).alias(c) for i, c in enumerate(COVERS)])
    return means.select(*by, F.explode(F.create_map(*[x for c in COVERS for x in (F.lit(c), F.col(c))])).alias("cover", "share"))
