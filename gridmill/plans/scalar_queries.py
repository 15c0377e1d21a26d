"""Queries over scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmill.functions import scalars as S
from gridmill.plans.views import table
from gridmill.registry import query


def _id():
    return F.col("p_partkey").alias("id")


def _part(spark, sf_dir):
    return table(spark, sf_dir, "part")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 30 < 24 AND p_partkey % 70 < 60 THEN (p_partkey % 30) * 3600 + (p_partkey % 70) * 60 END AS s, CASE WHEN p_partkey % 30 < 24 AND p_partkey % 70 < 60 THEN LPAD(CAST(p_partkey % 30 AS VARCHAR), 2, '0') || ':' || LPAD(CAST(p_partkey % 70 AS VARCHAR), 2, '0') END AS clock FROM {part}")
def clock_conversions(spark, sf_dir):
    s = S.clock_to_s(F.format_string("%02d:%02d", F.col("p_partkey") % 30, F.col("p_partkey") % 70))
    return _part(spark, sf_dir).select(_id(), s.alias("s")).withColumn("clock", F.when(F.col("s").isNotNull(), S.s_to_clock(F.col("s"))))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN NULL ELSE GREATEST(p_size, p_partkey % 9 + 5e-1) END AS number FROM {part}")
def parse_number_tag(spark, sf_dir):
    tag = F.when(F.col("p_size") % 4 == 0, "none").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(";"), (F.col("p_partkey") % 9).cast("string"), F.lit(".5")))
    return _part(spark, sf_dir).select(_id(), S.parse_number(tag).alias("number"))


@query("SELECT p_partkey AS id, ROUND(NULLIF(p_size % 50, 0) * CASE p_partkey % 3 WHEN 0 THEN 1.609344 WHEN 1 THEN 1.852 ELSE 1 END, 6) AS kph FROM {part}")
def parse_speed_tag(spark, sf_dir):
    unit = F.when(F.col("p_partkey") % 3 == 0, " mph").when(F.col("p_partkey") % 3 == 1, " knots").otherwise("")
    return _part(spark, sf_dir).select(_id(), F.round(S.parse_speed(F.concat((F.col("p_size") % 50).cast("string"), unit)), 6).alias("kph"))


@query("SELECT p_partkey AS id, ROUND(CASE p_partkey % 5 WHEN 0 THEN (p_size + 6 / 12e0) * 3.048e-1 WHEN 1 THEN p_size * 3.048e-1 WHEN 2 THEN p_size + 5e-1 WHEN 3 THEN p_size * 1e0 WHEN 4 THEN CASE WHEN p_size % 2 = 0 THEN p_size * 1e0 END END, 6) AS metres FROM {part}")
def parse_height_tag(spark, sf_dir):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    tag = F.when(k == 0, F.concat(n, F.lit("'6\""))).when(k == 1, F.concat(n, F.lit(" ft"))).when(k == 2, F.concat(n, F.lit(",5 m"))).when(k == 3, n).otherwise(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("about "), n, F.lit(" m or 99"))).otherwise("tall"))
    return _part(spark, sf_dir).select(_id(), F.round(S.parse_height(tag), 6).alias("metres"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 9 = 0 THEN '192,192,192' WHEN p_size % 9 = 1 THEN '' ELSE CONCAT_WS(',', p_partkey % 256, p_size, 255 - p_size) END AS rgb FROM {part}")
def parse_colour_tag(spark, sf_dir):
    byte = lambda c: F.lpad(F.hex(c), 2, "0")
    tag = F.concat(F.lit("#"), byte(F.col("p_partkey") % 256), byte(F.col("p_size").cast("long")), byte(255 - F.col("p_size").cast("long")))
    tag = F.when(F.col("p_size") % 9 == 0, " Silver").when(F.col("p_size") % 9 == 1, "no colour").otherwise(tag)
    return _part(spark, sf_dir).select(_id(), S.parse_hex_colour(tag).alias("rgb"))


@query("SELECT p_partkey AS id, LOWER(REPLACE(p_brand, '#', '')) || 'ecole' AS key FROM {part}")
def name_keys(spark, sf_dir):
    return _part(spark, sf_dir).select(_id(), S.name_key(F.concat(F.lit("The "), F.col("p_brand"), F.lit(" - École SchoolsCampus School"))).alias("key"))


_CLASS = "CASE highway WHEN 'motorway' THEN {0} WHEN 'primary' THEN {1} WHEN 'secondary' THEN {2} WHEN 'tertiary' THEN {3} ELSE {4} END"


_LANES = f"CAST(CASE WHEN edge_idx % 7 = 0 THEN 3 WHEN edge_idx % 5 = 0 THEN {_CLASS.format(4, 2, 2, 1, 1)} WHEN u % 2 = 0 THEN lanes ELSE CEIL(lanes / 2e0) END AS INTEGER)"


@query(f"SELECT edge_idx, {_LANES} AS dir_lanes, {_LANES} * {_CLASS.format(2000, 900, 800, 700, 500)} AS veh_h, ROUND(length_m / (5e1 / 3.6), 6) AS t0 FROM {{edges}}")
def lanes_and_capacity(spark, sf_dir):
    tagged, own = F.when(F.col("edge_idx") % 5 != 0, F.col("lanes")), F.when(F.col("edge_idx") % 7 == 0, 3)
    lanes = S.lanes_per_direction(tagged, F.col("u") % 2 == 0, F.col("highway"), own)
    return table(spark, sf_dir, "edges").select("edge_idx", lanes.alias("dir_lanes"), S.capacity(F.col("highway"), lanes).alias("veh_h"), F.round(S.free_flow_s(F.col("length_m"), F.lit(50.0)), 6).alias("t0"))


@query("SELECT seed, variant, edge_idx, bin, ROUND(60 * (1 + 1.5e-1 * POW(LEAST(vc, 3), 4)), 6) AS t, ROUND(CASE WHEN edge_idx % 5 = 0 THEN 0 WHEN edge_idx % 2 = 0 THEN 12 + 30 * LEAST(vc, 3) * LEAST(vc, 3) ELSE 2 END * (1 + edge_idx % 3 * 5e-1), 6) AS delay FROM {seed_edge_bin}")
def link_time(spark, sf_dir):
    rows = table(spark, sf_dir, "seed_edge_bin")
    return rows.select("seed", "variant", "edge_idx", "bin", F.round(S.link_time(F.lit(60.0), F.col("vc")), 6).alias("t"), F.round(S.node_delay(F.col("edge_idx") % 2 == 0, F.col("vc"), F.col("edge_idx") % 5 == 0, 1 + F.col("edge_idx") % 3 * 0.5), 6).alias("delay"))


@query("SELECT trip, step, FLOOR(f) AS bin_low, LEAST(FLOOR(f) + 1, 23) AS bin_high, ROUND(f - FLOOR(f), 6) AS weight FROM (SELECT trip, step, LEAST(GREATEST(enter_s / 60e0 - 5e-1, 0), 23) AS f FROM {trajectory}) t")
def bin_blend(spark, sf_dir):
    rows = table(spark, sf_dir, "trajectory").select("trip", "step", *S.bin_blend(F.col("enter_s"), 60, 24))
    return rows.withColumn("weight", F.round("weight", 6))


@query("SELECT household_id, ROUND_EVEN(x / 150, 0) * 150 AS gx, ROUND_EVEN(z / 150, 0) * 150 AS gz, CASE WHEN vehicles = 0 THEN 'the neighborhood' WHEN vehicles = 1 THEN income_band WHEN vehicles = 2 THEN 'near ' || income_band || ' St' ELSE income_band || ', near ' || income_band || ' St' END AS label FROM {homes}")
def privacy_grid_label(spark, sf_dir):
    return table(spark, sf_dir, "homes").select("household_id", S.snap(F.col("x"), 150).alias("gx"), S.snap(F.col("z"), 150).alias("gz"), S.block_label(F.when(F.col("vehicles").isin(1, 3), F.col("income_band")), F.when(F.col("vehicles") >= 2, F.concat("income_band", F.lit(" St"))), "the neighborhood").alias("label"))


@query("SELECT seed, variant, edge_idx, bin, ROUND(CASE WHEN vc <= 5e-1 THEN 0 WHEN vc < 9e-1 THEN (vc - 5e-1) / 4e-1 * 100 WHEN vc < 2 THEN 100 + (vc - 9e-1) / 1.1 * 155 ELSE 255 END, 5) AS colour FROM {seed_edge_bin}")
def congestion_class(spark, sf_dir):
    rows = table(spark, sf_dir, "seed_edge_bin")
    return rows.select("seed", "variant", "edge_idx", "bin", F.round(S.ramp(F.col("vc"), [(0.5, 0.0), (0.9, 100.0), (2.0, 255.0)]), 5).alias("colour"))


@query("SELECT person_id, CASE WHEN age <= 10 THEN 8e-1 WHEN age <= 13 THEN 1.6 WHEN age <= 18 THEN 2.4 ELSE 3e0 END AS walk_km, CASE WHEN age < 18 THEN '14-17' WHEN age < 35 THEN '18-34' WHEN age < 50 THEN '35-49' WHEN age < 65 THEN '50-64' ELSE '65+' END AS band, CASE WHEN g <= 5 THEN 'elementary' WHEN g <= 8 THEN 'middle' ELSE 'high' END AS level FROM (SELECT person_id, age, CASE WHEN grade >= 0 THEN grade ELSE age - 5 END AS g FROM {persons}) t")
def age_bands(spark, sf_dir):
    return table(spark, sf_dir, "persons").select("person_id", S.by_age(F.col("age"), [(10, 0.8), (13, 1.6), (18, 2.4), (None, 3.0)]).alias("walk_km"), S.age_band(F.col("age")).alias("band"), S.school_level(F.col("grade"), F.col("age")).alias("level"))


@query("SELECT seed, person_id, ROUND(1 / (1 + EXP(-(2.5e-1 * (base_min - plan_min) - 2e-1))), 6) AS approval, 2.5e-1 * (base_min - plan_min) - 2e-1 >= 0 AS approves FROM {seed_person}")
def approval_score(spark, sf_dir):
    score = S.logistic(0.25 * (F.col("base_min") - F.col("plan_min")) - 0.2)
    return table(spark, sf_dir, "seed_person").select("seed", "person_id", F.round(score, 6).alias("approval"), (score >= 0.5).alias("approves"))


@query("SELECT p_partkey AS id, CAST(CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN GREATEST(ROUND_EVEN(p_retailprice / 120, 0), 1) WHEN 2 THEN LEAST(GREATEST(ROUND_EVEN(p_retailprice * p_size / 95, 0), 2), 400) ELSE 0 END AS BIGINT) AS units FROM {part}")
def dwelling_units(spark, sf_dir):
    k = F.col("p_partkey") % 4
    kind = F.when(k == 0, "house").when(k == 1, "terrace").when(k == 2, "apartments").otherwise("shed")
    return _part(spark, sf_dir).select(_id(), S.dwelling_units(kind, F.col("p_retailprice"), F.col("p_size")).alias("units"))


@query("SELECT p_partkey AS id, ROUND(COALESCE(CASE WHEN p_size % 3 = 0 THEN p_size * 1e0 END, CASE WHEN p_size % 3 = 1 THEN p_size * 3.2 END, 5e0), 6) AS height, CASE p_size % 3 WHEN 0 THEN 'tag' WHEN 1 THEN 'levels' ELSE 'default' END AS rule FROM {part}")
def height_priority(spark, sf_dir):
    n = F.col("p_size")
    rows = _part(spark, sf_dir).select(_id(), *S.height_and_rule(F.when(n % 3 == 0, n * 1.0), F.when(n % 3 == 1, n), F.lit(5.0)))
    return rows.withColumn("height", F.round("height", 6))


@query("""
WITH w AS (SELECT p_partkey AS id, [p_size % 2 * 1e0, p_size % 3 * 1e0, p_size % 5 * 1e0, p_size % 7 * 1e0, p_size % 11 * 1e0, p_size % 13 * 1e0] AS w FROM {part}),
f AS (SELECT id, w, list_sum(w) AS total, list_transform(w, lambda x: CAST(FLOOR(x * 255 / list_sum(w)) AS INTEGER)) AS f FROM w)
SELECT id, CASE WHEN total = 0 THEN '0,0,0,0,0,255' ELSE array_to_string(list_transform(f, lambda x, i: CASE WHEN i = list_position(w, list_max(w)) THEN x + 255 - list_sum(f) ELSE x END), ',') END AS bytes FROM f""")
def weights_to_bytes(spark, sf_dir):
    w = S.weights_to_bytes([F.col("p_size") % k * 1.0 for k in (2, 3, 5, 7, 11, 13)])
    return _part(spark, sf_dir).select(_id(), F.array_join(w.cast("array<string>"), ",").alias("bytes"))


@query("""
SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 1 OR p_partkey % 7 = 2 AND p_size % 2 = 0 THEN NULL WHEN p_size % 5 <> 0 OR p_size = 10 THEN 'It takes ' || CASE WHEN p_size % 5 = 0 THEN CAST(p_size AS VARCHAR) ELSE '3.05' END
 || CASE p_partkey % 7 WHEN 2 THEN ' minutes from 7:30' WHEN 3 THEN ' minutes and then...' ELSE ' minutes' END END AS text FROM {part}""")
def number_guard(spark, sf_dir):
    text = F.concat(F.lit("It takes "), F.when(F.col("p_size") % 5 == 0, F.col("p_size").cast("string")).otherwise("3.05"), F.lit(" minutes"))
    k = F.col("p_partkey") % 7
    more = F.when(k == 1, " to 12 Elm  Street").when(k == 2, F.when(F.col("p_size") % 2 == 0, " from 9:15").otherwise("\n from  7:30")).when(k == 3, " and then some").otherwise("")
    return _part(spark, sf_dir).select(_id(), S.safe_text(F.concat(text, more), F.array(F.lit(3.0), F.lit(10.0)), F.array(F.lit("07:30")), 31).alias("text"))


_PHRASE = "CASE WHEN ABS({0}) < 5e-1 THEN 'about the same' ELSE PRINTF('%.1f', ABS({0})) || ' minutes ' || CASE WHEN {0} < 0 THEN 'faster' ELSE 'slower' END END"


@query(f"SELECT seed, person_id, CASE WHEN seed % 2 = 0 THEN 'own commute: ' || {_PHRASE.format('plan_min - base_min')} || '; ' ELSE '' END || 'own trip to school: ' || {_PHRASE.format('(base_min - plan_min) * 3')} AS phrases FROM {{seed_person}}")
def delta_phrases(spark, sf_dir):
    d = F.col("plan_min") - F.col("base_min")
    said = S.delta_phrases({"own commute": S.delta_phrase(F.when(F.col("seed") % 2 == 0, d)), "own trip to school": S.delta_phrase((F.col("base_min") - F.col("plan_min")) * 3)})
    lines = F.transform(F.array_sort(F.map_entries(said)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return table(spark, sf_dir, "seed_person").select("seed", "person_id", F.array_join(lines, "; ").alias("phrases"))
