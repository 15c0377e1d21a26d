"""Scalar functions over schools, road references and nested building records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words in the names of schools that take no students by neighbourhood.
NOT_BY_AREA = ["continuation", "preschool", "pre-school", "adult", "montessori", "christian", "torah", "private"]
#: The word that tells a school's grades, first match first.
GRADE_WORDS = [("high", 9, 12), ("middle", 6, 8), ("elementary", 0, 5)]
#: Categories of places that are schools from kindergarten to grade 12.
SCHOOL_CATEGORIES = [
    "school", "elementary_school", "middle_school", "high_school", "public_school", "private_school", "charter_school", "primary_school", "secondary_school", "k_12_school",
]
#: Building tag of a record that has a subtype but no class.
SUBTYPE_BUILDING = {
    "residential": "residential", "commercial": "commercial", "education": "school", "outbuilding": "shed", "industrial": "industrial", "religious": "religious",
    "civic": "civic", "medical": "hospital", "service": "service", "transportation": "transportation", "agricultural": "farm_auxiliary", "military": "military",
}
#: Words at the end of an exit's label that only tell a direction.
DIRECTION_WORDS = ["north", "south", "east", "west", "northbound", "southbound", "eastbound", "westbound"]


def school_grades(name: Column) -> Column:
    """[first, last] grade of a school named after its level; null if the name tells none or the school has no area."""
    low = F.lower(name)
    band = F.coalesce(*[F.when(low.contains(word), F.array(F.lit(a), F.lit(b))) for word, a, b in GRADE_WORDS])
    return F.when(~low.rlike("|".join(NOT_BY_AREA)), band)


def is_school_place(taxonomy: Column, basic: Column, categories: Column) -> Column:
    """Whether a place has a school's category, and its first one, by taxonomy, categories, then basic, is one too.

    taxonomy: struct(primary, hierarchy, alternates); categories: struct(primary, alternate); all may be null.
    """
    known = F.array(*[F.lit(c) for c in SCHOOL_CATEGORIES])
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    every = F.concat(F.array(taxonomy["primary"], basic, categories["primary"]), listed(taxonomy["hierarchy"]), listed(taxonomy["alternates"]), listed(categories["alternate"]))
    given = lambda c: F.nullif(c, F.lit(""))
    first = F.coalesce(given(taxonomy["primary"]), given(categories["primary"]), basic)
    return F.coalesce(F.arrays_overlap(F.array_compact(every), known), F.lit(False)) & F.coalesce(F.array_contains(known, first), F.lit(False))


def road_refs(ref: Column) -> Column:
    """References of a road in one form: upper case, spaces for hyphens, state routes as CA, interstates as I."""
    def one(part: Column) -> Column:
        plain = F.regexp_replace(F.replace(F.upper(F.trim(part)), F.lit("-"), F.lit(" ")), r"\s+", " ")
        return F.regexp_replace(F.regexp_replace(plain, "^(SR|CA|STATE ROUTE) ", "CA "), "^(I|INTERSTATE) ", "I ")

    return F.filter(F.transform(F.split(F.coalesce(ref, F.lit("")), "[;,]"), one), lambda p: p != "")


def road_label(name: Column, ref: Column, labels: list[tuple[str, str | None]]) -> Column:
    """The first of labels (name, refs) that a part of the road's name starts with, else the first that shares a ref, else ''."""
    parts = F.transform(F.split(F.lower(F.coalesce(name, F.lit(""))), ","), lambda p: F.trim(p))
    refs = road_refs(ref)
    starts = lambda n: F.exists(parts, lambda p: p.startswith(n.lower()))
    by_name = [F.when(starts(n), F.lit(n)) for n, _ in labels if n]
    by_ref = [F.when(F.arrays_overlap(refs, road_refs(F.lit(r))), F.lit(n)) for n, r in labels if r]
    return F.coalesce(*by_name, *by_ref, F.lit(""))


def exit_road(label: Column) -> Column:
    """Road of an exit's label: what stands in brackets and directions at the end go."""
    words = F.trim(F.regexp_replace(F.regexp_replace(label, r"\(.*?\)", " "), r"\s+", " "))
    return F.regexp_replace(words, f"(?i)(?:(?:^| )(?:{'|'.join(DIRECTION_WORDS)}))+$", "")


def building_tags(row: Column) -> Column:
    """A nested building record as a flat struct of tags; lengths as text with two decimals.

    row: struct(id, class, subtype, height, min_height, num_floors, roof_height,
    roof_shape, roof_material, roof_color, facade_color, facade_material,
    names struct(primary), sources array<struct(dataset, record_id)>).
    """
    metres = lambda c: F.when(row[c].isNotNull(), F.format_string("%.2f", row[c].cast("double")))
    subtype = F.coalesce(*[F.when(row["subtype"] == k, F.lit(v)) for k, v in SUBTYPE_BUILDING.items()], F.lit("yes"))
    way = F.transform(row["sources"], lambda s: F.when(F.lower(s["dataset"]).startswith("openstreetmap"), F.nullif(F.regexp_extract(s["record_id"], r"^w(\d+)", 1), F.lit(""))))
    return F.struct(
        row["id"].alias("id"), F.coalesce(F.nullif(row["class"], F.lit("")), subtype).alias("building"), metres("height").alias("height"), metres("min_height").alias("min_height"),
        row["num_floors"].cast("int").cast("string").alias("levels"), row["names"]["primary"].alias("name"), row["roof_shape"].alias("roof_shape"), row["roof_material"].alias("roof_material"),
        row["roof_color"].alias("roof_colour"), metres("roof_height").alias("roof_height"), row["facade_color"].alias("building_colour"), row["facade_material"].alias("building_material"),
        row["subtype"].alias("subtype"), row["class"].alias("class"), F.get(row["sources"], 0)["dataset"].alias("source"), F.get(F.array_compact(way), 0).alias("way_id"),
    )
