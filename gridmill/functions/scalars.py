"""Scalar functions over columns: tags, names, clocks, link times, colours."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Capacity per lane and hour, default lanes and default speed (km/h) by road class.
ROAD_CLASSES = {
    "motorway": (2000, 4, 105.0), "primary": (900, 2, 72.0), "secondary": (800, 2, 64.0), "tertiary": (700, 1, 56.0), "residential": (500, 1, 40.0),
}


def clock_to_s(clock: Column) -> Column:
    """'HH:MM' as seconds since midnight; null where it isn't a clock time."""
    h, m = (F.regexp_extract(clock, r"^([0-9]{1,2}):([0-9]{2})$", i) for i in (1, 2))
    h, m = F.nullif(h, F.lit("")).cast("int"), F.nullif(m, F.lit("")).cast("int")
    return F.when((h < 24) & (m < 60), h * 3600 + m * 60)


def s_to_clock(s: Column) -> Column:
    """Seconds as 'HH:MM', to the nearest minute, half to even."""
    minutes = F.bround(s / 60.0, 0).cast("int")
    return F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), minutes % 60)


def parse_number(tag: Column) -> Column:
    """The largest number in a tag; null without any."""
    found = F.transform(F.regexp_extract_all(tag, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1)), lambda x: x.cast("double"))
    return F.array_max(found)


def parse_speed(tag: Column) -> Column:
    """Speed tag in km/h; mph and knots are converted; not above 0 is null."""
    low = F.lower(tag)
    n = parse_number(tag) * F.when(low.contains("mph"), 1.609344).when(low.contains("knots"), 1.852).otherwise(1.0)
    return F.when(n > 0, n)


def parse_height(tag: Column) -> Column:
    """Height tag in metres: feet and inches (30'6"), else the first number, with ft or feet in feet; a comma is a point. Not above 0 is null."""
    t = F.replace(F.lower(tag), F.lit(","), F.lit("."))
    part = lambda pattern, i: F.nullif(F.regexp_extract(t, pattern, i), F.lit("")).cast("double")
    feet = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*'\s*(?:([0-9]+(?:\.[0-9]+)?)\s*\")?\s*$"
    first = part(r"([0-9]+(?:\.[0-9]+)?)", 1) * F.when(t.contains("ft") | t.contains("feet"), 0.3048).otherwise(1.0)
    out = F.coalesce((part(feet, 1) + F.coalesce(part(feet, 2), F.lit(0.0)) / 12) * 0.3048, first)
    return F.when(out > 0, out)


#: Colour names and their hex form.
COLOURS = {
    "white": "ffffff", "silver": "c0c0c0", "gray": "808080", "grey": "808080", "black": "000000", "red": "ff0000", "maroon": "800000", "yellow": "ffff00", "olive": "808000", "lime": "00ff00",
    "green": "008000", "aqua": "00ffff", "cyan": "00ffff", "teal": "008080", "blue": "0000ff", "navy": "000080", "fuchsia": "ff00ff", "magenta": "ff00ff", "purple": "800080", "orange": "ffa500",
    "brown": "a52a2a", "beige": "f5f5dc", "tan": "d2b48c", "pink": "ffc0cb", "gold": "ffd700", "ivory": "fffff0", "lightgray": "d3d3d3", "lightgrey": "d3d3d3", "darkgray": "a9a9a9", "darkgrey": "a9a9a9",
}


def parse_hex_colour(tag: Column) -> Column:
    """#rrggbb, #rgb, bare hex or a colour's name as r,g,b; '' otherwise."""
    low = F.lower(F.trim(tag))
    named = F.coalesce(*[F.when(low == k, F.lit(v)) for k, v in COLOURS.items()])
    h = F.coalesce(named, F.regexp_replace(low, "^#", ""))
    full = F.when(h.rlike("^[0-9a-f]{6}$"), h).when(h.rlike("^[0-9a-f]{3}$"), F.regexp_replace(h, "(.)", "$1$1"))
    byte = lambda i: F.conv(F.substring(full, i, 2), 16, 10)
    return F.concat_ws(",", *[F.when(full.isNotNull(), byte(i)) for i in (1, 3, 5)])


def _accents() -> tuple[str, str]:
    """Letters with accents, and the plain lower-case letter of each, by Unicode decomposition."""
    plain = {chr(c): unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode().lower() for c in range(0xC0, 0x250)}
    return "".join(k for k, v in plain.items() if len(v) == 1), "".join(v for v in plain.values() if len(v) == 1)


def name_key(name: Column) -> Column:
    """Lower-case letters and digits alone, without accents; a leading 'the' and trailing 'campus', 'school' and 'schools' go."""
    letters = F.regexp_replace(F.lower(F.translate(name, *_accents())), "[^a-z0-9]", "")
    return F.regexp_replace(F.regexp_replace(letters, "^the", ""), "(campus|schools|school)+$", "")


def lanes_per_direction(lanes: Column, oneway: Column, highway: Column, directional: Column | None = None) -> Column:
    """The direction's own lanes if tagged; else all lanes of a one-way road, half (rounded up) of a two-way one; the class default without a tag."""
    default = F.coalesce(*[F.when(highway == k, F.lit(v[1])) for k, v in ROAD_CLASSES.items()], F.lit(1))
    total = F.when(lanes >= 1, F.greatest(F.when(oneway, F.bround(lanes.cast("double"))).otherwise(F.ceil(lanes / 2)).cast("int"), F.lit(1)))
    own = F.lit(None).cast("int") if directional is None else F.when(directional >= 1, directional.cast("int"))
    return F.coalesce(own, total, default)


def capacity(highway: Column, lanes: Column) -> Column:
    rate = F.coalesce(*[F.when(highway == k, F.lit(v[0])) for k, v in ROAD_CLASSES.items()], F.lit(500))
    return lanes * rate


def free_flow_s(length_m: Column, kph: Column) -> Column:
    return length_m / (kph / 3.6)


def link_time(t0: Column, vc: Column, alpha: float = 0.15, beta: float = 4.0, cap: float = 3.0) -> Column:
    """Travel time under load: t0 (1 + alpha min(vc, cap)^beta)."""
    return t0 * (1 + F.lit(alpha) * F.pow(F.least(vc, F.lit(cap)), F.lit(beta)))


def node_delay(signalized: Column, vc: Column, freeway: Column, approach: Column | None = None, cap: float = 3.0) -> Column:
    """12 s and 30 s min(vc, cap)^2 at a signal, 2 s without one, nothing on a freeway; times the approach's factor."""
    load = F.least(vc, F.lit(cap))
    delay = F.when(freeway, 0.0).when(signalized, 12.0 + 30.0 * load * load).otherwise(2.0)
    return delay if approach is None else delay * approach


def bin_blend(t: Column, bin_s: int, bins: int) -> list[Column]:
    """Lower bin, upper bin and weight of the upper one, between bin centres."""
    f = F.least(F.greatest(t / bin_s - 0.5, F.lit(0.0)), F.lit(float(bins - 1)))
    low = F.floor(f)
    return [low.alias("bin_low"), F.least(low + 1, F.lit(bins - 1)).alias("bin_high"), (f - low).alias("weight")]


def snap(x: Column, size: float) -> Column:
    """To the nearest multiple of size, half to even."""
    return F.rint(x / size) * size


def ramp(value: Column, stops: list[tuple[float, float]]) -> Column:
    """Piecewise linear from stops (value, out); clamped; NaN and null take the first stop."""
    out = F.lit(stops[-1][1])
    for (a, va), (b, vb) in reversed(list(zip(stops, stops[1:]))):
        out = F.when(value < b, F.lit(va) + (value - a) * ((vb - va) / (b - a))).otherwise(out)
    return F.when(value.isNull() | F.isnan(value) | (value <= stops[0][0]), F.lit(stops[0][1])).otherwise(out)


def school_level(grade: Column, age: Column) -> Column:
    g = F.when(grade >= 0, grade).otherwise(age - 5)
    return F.when(g <= 5, "elementary").when(g <= 8, "middle").otherwise("high")


def by_age(age: Column, limits: list[tuple[int | None, float]]) -> Column:
    """The limit of the first (oldest age included, limit) that an age falls under; None stands for all others."""
    return F.coalesce(*[F.when(age <= top, F.lit(v)) if top is not None else F.lit(v) for top, v in limits])


#: Display bands of ages, both ends included.
AGE_BANDS = [(14, 17, "14-17"), (18, 34, "18-34"), (35, 49, "35-49"), (50, 64, "50-64"), (65, 200, "65+")]


def age_band(age: Column) -> Column:
    """Display band of an age; below the first band the first, above the last the last."""
    inside = [F.when(age.between(a, b), label) for a, b, label in AGE_BANDS]
    return F.coalesce(*inside, F.when(age > AGE_BANDS[-1][0], AGE_BANDS[-1][2]).otherwise(AGE_BANDS[0][2]))


def block_label(hood: Column, street: Column, default: str) -> Column:
    """'hood, near street', or what there is of both, or the default."""
    near = F.concat(F.lit("near "), street)
    return F.coalesce(F.concat(hood, F.lit(", "), near), near, hood, F.lit(default))


def logistic(x: Column) -> Column:
    """1 / (1 + e^-x) without overflow."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def dwelling_units(kind: Column, area: Column, levels: Column) -> Column:
    """1 for a house, area by 120 (half to even, one at least) for a terrace, area x levels by 95 within 2..400 for apartments."""
    terrace = F.greatest(F.bround(area / 120.0, 0), F.lit(1.0))
    flats = F.least(F.greatest(F.bround(area * levels / 95.0, 0), F.lit(2.0)), F.lit(400.0))
    return F.when(kind == "house", 1.0).when(kind == "terrace", terrace).when(kind == "apartments", flats).otherwise(0.0).cast("long")


def height_and_rule(tag: Column, levels: Column, default: Column) -> list[Column]:
    """Height and where it comes from: its tag, 3.2 m a level, or the default."""
    return [F.coalesce(tag, levels * 3.2, default).alias("height"), F.when(tag.isNotNull(), "tag").when(levels.isNotNull(), "levels").otherwise("default").alias("rule")]


def weights_to_bytes(weights: list[Column]) -> Column:
    """Weights as bytes that sum to 255: floors, with the remainder on the largest (the first on ties). All zero puts 255 on the last."""
    w = F.array(*weights)
    total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    floors = F.transform(w, lambda x: F.floor(x * 255 / total).cast("int"))
    rest = F.lit(255) - F.aggregate(floors, F.lit(0), lambda a, x: a + x)
    largest = F.array_position(w, F.array_max(w))
    out = F.transform(floors, lambda x, i: F.when(i + 1 == largest, x + rest).otherwise(x))
    last = F.array(*[F.lit(0)] * (len(weights) - 1), F.lit(255))
    return F.when(total > 0, out).otherwise(last)


_NUMBER = r"([0-9][0-9,]*(?:[.:][0-9]+)?)"
#: Kinds of streets that end an address.
STREET_KINDS = "St|Street|Rd|Road|Ave|Avenue|Dr|Drive|Ct|Court|Ln|Lane|Way|Pl|Place|Blvd|Boulevard|Pkwy|Parkway|Ter|Terrace"


def numbers_ok(text: Column, allowed: Column, clocks: Column | None = None) -> Column:
    """Whether every number in a text is an allowed one (array<double>), within 0.051 or rounded to 0 or 1 digits, and every clock time one of clocks."""
    found = F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(1))
    bare = lambda c: F.regexp_replace(c, "^0+", "")
    told = F.lit(False) if clocks is None else None
    is_clock = lambda tok: told if told is not None else F.exists(clocks, lambda c: bare(c) == bare(tok))
    number = lambda tok: F.replace(tok, F.lit(","), F.lit("")).cast("double")
    near = lambda a, n: (F.abs(F.abs(a) - n) <= 0.051) | (F.bround(F.abs(a), 0) == n) | (F.bround(F.abs(a), 1) == n)
    return F.forall(found, lambda tok: F.when(tok.contains(":"), is_clock(tok)).otherwise(F.exists(allowed, lambda a: near(a, number(tok)))))


def safe_text(text: Column, allowed: Column, clocks: Column | None = None, most: int = 600) -> Column:
    """The text with white space squeezed, cut at a word's end; null if empty, if a number isn't allowed or if it holds a street address."""
    t = F.trim(F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r'^"+|"+$', ""))
    bad = (t == "") | t.rlike(rf"\b[0-9]{{2,6}}\s+[A-Z][a-z]+\s+(?:{STREET_KINDS})\b") | ~numbers_ok(t, allowed, clocks)
    cut = F.concat(F.regexp_replace(F.substring(t, 1, most), r" [^ ]*$", ""), F.lit("..."))
    return F.when(~bad, F.when(F.length(t) > most, cut).otherwise(t))


def delta_phrase(minutes: Column) -> Column:
    """Minutes faster or slower, or about the same (within half a minute); null stays null."""
    # rounds the number itself, ties to even; format_string rounds the digits it prints, so 2.25 and 1.15 would go up
    size = F.call_function("format_number", F.abs(minutes), F.lit("0.0"))
    return F.when(F.abs(minutes) < 0.5, "about the same").when(minutes < 0, F.concat(size, F.lit(" minutes faster"))).when(minutes > 0, F.concat(size, F.lit(" minutes slower")))


def delta_phrases(parts: dict[str, Column]) -> Column:
    """map of label to phrase, without those that are null."""
    return F.map_filter(F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())


#: Kind of roof that a roof shape's tag stands for.
ROOF_SHAPES = {
    "flat": "flat", "skillion": "flat", "hipped": "hipped", "half_hipped": "hipped", "side_hipped": "hipped", "pyramidal": "hipped", "gabled": "gabled", "side_gabled": "gabled",
    "saltbox": "gabled", "gambrel": "gabled", "mansard": "hipped",
}


def roof_kind(shape: Column, is_house: Column, rectangular: Column, courtyard: Column, least: float) -> Column:
    """flat, hipped or gabled: by the tag, but flat around a courtyard; else hipped for a house that is rectangular enough."""
    tagged = F.coalesce(*[F.when(F.lower(shape) == k, F.lit(v)) for k, v in ROOF_SHAPES.items()])
    return F.coalesce(F.when(tagged.isNotNull() & courtyard, F.lit("flat")), tagged, F.when(is_house & (rectangular >= least), "hipped").otherwise("flat"))
