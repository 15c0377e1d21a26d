"""Queries over choice and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmill.operators import choice as C
from gridmill.plans.views import table
from gridmill.registry import query

_OPTIONS = """SELECT person_id, age % 3 AS band, o.name, CASE o.name WHEN 'drive' THEN (age % 17) / 1e1 WHEN 'walk' THEN (age % 13) / 1e1 ELSE 5e-1 END AS u,
 CASE o.name WHEN 'drive' THEN age >= 16 WHEN 'walk' THEN age % 4 > 0 ELSE age % 5 > 0 END AS available, o.i
FROM {persons} CROSS JOIN (VALUES (1, 'drive'), (2, 'walk'), (3, 'bus')) AS o(i, name)"""


def _options(spark, sf_dir):
    return spark.sql(_OPTIONS, persons=table(spark, sf_dir, "persons"))


@query(f"WITH o AS ({_OPTIONS}) SELECT person_id, COALESCE(ARG_MIN(name, ROW(-u, i)) FILTER (WHERE available), 'drive') AS mode FROM o GROUP BY person_id")
def argmax_choice(spark, sf_dir):
    rows = _options(spark, sf_dir).groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("i", "name", "u", "available"))).alias("o"))
    options = F.transform("o", lambda x: F.struct(x["name"].alias("name"), x["u"].cast("double").alias("u"), x["available"].alias("available")))
    return rows.select("person_id", C.argmax_choice(options).alias("mode"))


@query(f"""
WITH o AS ({_OPTIONS}), p AS (SELECT *, EXP(u) / SUM(EXP(u)) OVER (PARTITION BY person_id) AS p, COUNT(*) OVER (PARTITION BY person_id) AS n FROM o WHERE available)
SELECT band, ROUND(AVG(p), 6) AS share FROM p WHERE n >= 2 AND name = 'walk' GROUP BY band""")
def choice_shares(spark, sf_dir):
    return C.shares(_options(spark, sf_dir), ["band"], "walk").withColumn("share", F.round("share", 6))


@query("SELECT CAST(b.band AS VARCHAR) AS band, CAST(b.share AS DOUBLE) AS share FROM (VALUES (0, 3e-1), (1, 5e-1), (2, 4.5e-1)) AS b(band, share)")
def share_calibration(spark, sf_dir):
    """Shares after calibration, to three decimals: each is on its target."""
    rows = _options(spark, sf_dir).withColumn("band", F.col("band").cast("string"))
    found = C.calibrate(rows, "walk", "band", {"0": 0.3, "1": 0.5, "2": 0.45}, close=1e-4)
    moved = rows.join(F.broadcast(found), "band").withColumn("u", F.when(F.col("name") == "walk", F.col("u") + F.col("constant")).otherwise(F.col("u")))
    return C.shares(moved, ["band"], "walk").withColumn("share", F.round("share", 3))


_MEMBERS = "SELECT person_id, household_id, age % 8 AS area, CASE WHEN age % 3 = 0 THEN 'bus' ELSE 'drive' END AS choice, 'walk' AS alternative, 'drive' AS base, age % 29 AS margin FROM {persons}"


def _members(spark, sf_dir):
    return spark.sql(_MEMBERS, persons=table(spark, sf_dir, "persons"))


@query(f"WITH m AS ({_MEMBERS}) SELECT person_id, CASE WHEN choice = 'bus' AND ROW_NUMBER() OVER (PARTITION BY area, choice ORDER BY margin DESC, person_id) > 4 THEN 'walk' ELSE choice END AS choice FROM m")
def capacity_cap_rechoose(spark, sf_dir):
    return C.cap_rechoose(_members(spark, sf_dir), ["area"], "bus", 4).select("person_id", "choice")


@query(f"WITH m AS ({_MEMBERS}) SELECT person_id, CASE WHEN choice = 'bus' AND ROW_NUMBER() OVER (PARTITION BY area, choice ORDER BY margin DESC, person_id) > FLOOR(COUNT(*) OVER (PARTITION BY area) * 2e-1) THEN 'drive' ELSE choice END AS choice FROM m")
def adoption_cap_revert(spark, sf_dir):
    return C.cap_adoption(_members(spark, sf_dir), ["area"], "bus", 0.2).select("person_id", "choice")


@query("SELECT household_id, COALESCE(MIN(person_id) FILTER (WHERE is_worker), MIN(person_id) FILTER (WHERE age >= 18)) AS driver_id FROM {persons} GROUP BY household_id")
def first_driver(spark, sf_dir):
    return C.first_driver(table(spark, sf_dir, "persons"))


@query("SELECT person_id FROM {persons} p JOIN {households} h USING (household_id) WHERE age >= 14")
def eligible_residents(spark, sf_dir):
    rows = table(spark, sf_dir, "persons").where("age >= 14")
    return rows.join(table(spark, sf_dir, "households").select("household_id"), "household_id").select("person_id")


_STRATA = "SELECT income_band, COUNT(*) AS size FROM {households} GROUP BY income_band"


@query(f"""
WITH s AS ({_STRATA}), q AS (SELECT income_band, size, size * 37 / (SUM(size) OVER () * 1e0) AS exact FROM s),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY ROUND(exact - FLOOR(exact), 9) DESC, income_band) AS k, 37 - SUM(FLOOR(exact)) OVER () AS short FROM q)
SELECT income_band, size, CAST(FLOOR(exact) AS BIGINT) + CASE WHEN k <= short THEN 1 ELSE 0 END AS quota FROM r""")
def largest_remainder(spark, sf_dir):
    sizes = table(spark, sf_dir, "households").groupBy("income_band").agg(F.count("*").alias("size"))
    return C.largest_remainder(sizes, "income_band", 37)


_KIDS = "SELECT household_id, LIST_SORT(LIST(DISTINCT person_id * 7 % (SELECT COUNT(*) FROM {supplier}))) AS schools FROM {persons} WHERE grade >= 0 GROUP BY household_id"


@query(f"""
WITH RECURSIVE kids AS ({_KIDS}),
r AS (SELECT person_id, COALESCE(schools, []) AS schools, income_band, CAST(FLOOR(age / 15.0) AS INTEGER) AS age_band, md5('cover:' || person_id) AS o FROM {{persons}} p JOIN {{households}} h USING (household_id) LEFT JOIN kids USING (household_id) WHERE age >= 14),
tags AS (SELECT person_id, o, 0 AS k, CAST(UNNEST(schools) AS VARCHAR) AS v FROM r UNION ALL SELECT person_id, o, 1, income_band FROM r UNION ALL SELECT person_id, o, 2, CAST(age_band AS VARCHAR) FROM r),
firsts AS (SELECT k, v, ARG_MIN(person_id, o) AS person_id, ROW_NUMBER() OVER (ORDER BY k, v) AS i FROM tags GROUP BY k, v),
full_tags AS (SELECT f.i, f.k, f.v, f.person_id, LIST(t.k || '=' || t.v) AS has FROM firsts f JOIN tags t ON t.person_id = f.person_id GROUP BY ALL),
walk(i, seen, taken) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS BIGINT[])
 UNION ALL SELECT f.i, CASE WHEN LIST_CONTAINS(w.seen, f.k || '=' || f.v) THEN w.seen ELSE LIST_CONCAT(w.seen, f.has) END, CASE WHEN LIST_CONTAINS(w.seen, f.k || '=' || f.v) THEN w.taken ELSE LIST_APPEND(w.taken, f.i) END FROM walk w JOIN full_tags f ON f.i = w.i + 1),
taken AS (SELECT person_id, CASE k WHEN 0 THEN 'schools=' WHEN 1 THEN 'income_band=' ELSE 'age_band=' END || v AS covers_for FROM firsts WHERE i IN (SELECT UNNEST(taken) FROM walk WHERE i = (SELECT MAX(i) FROM walk))),
pool AS (SELECT person_id, o, COALESCE(CAST(schools[1] AS VARCHAR), '') || '|' || income_band || '|' || age_band AS stratum FROM r WHERE person_id NOT IN (SELECT person_id FROM taken)),
s AS (SELECT stratum, COUNT(*) AS size FROM pool GROUP BY stratum), left_over AS (SELECT 150 - COUNT(*) AS n FROM taken),
q AS (SELECT stratum, size * n / (SUM(size) OVER () * 1e0) AS exact, n FROM s, left_over),
quota AS (SELECT stratum, FLOOR(exact) + CASE WHEN ROW_NUMBER() OVER (ORDER BY ROUND(exact - FLOOR(exact), 9) DESC, stratum) <= n - SUM(FLOOR(exact)) OVER () THEN 1 ELSE 0 END AS quota FROM q),
picked AS (SELECT person_id FROM (SELECT person_id, stratum, ROW_NUMBER() OVER (PARTITION BY stratum ORDER BY o) AS k FROM pool) p JOIN quota USING (stratum) WHERE k <= quota)
SELECT person_id, covers_for FROM taken UNION ALL SELECT person_id, NULL FROM picked""")
def stratified_coverage_sample(spark, sf_dir):
    """150 residents: every school, income and age band is there, the rest in proportion. Ordered by md5, which SQL has too."""
    persons = table(spark, sf_dir, "persons")
    n_schools = table(spark, sf_dir, "supplier").count()
    kids = persons.where("grade >= 0").groupBy("household_id").agg(F.array_sort(F.collect_set(F.col("person_id") * 7 % n_schools)).alias("schools"))
    rows = persons.where("age >= 14").join(table(spark, sf_dir, "households").select("household_id", "income_band"), "household_id").join(kids, "household_id", "left")
    none = F.array().cast("array<bigint>")
    rows = rows.select("person_id", F.coalesce("schools", none).alias("schools"), "income_band", F.floor(F.col("age") / 15).cast("int").alias("age_band")).withColumn("primary_school", F.get("schools", 0))
    order = F.md5(F.concat(F.lit("cover:"), F.col("person_id").cast("string")))
    return C.coverage_sample(rows, "person_id", ["schools", "income_band", "age_band"], ["primary_school", "income_band", "age_band"], 150, 0, order).select("person_id", "covers_for")


@query()
def weighted_sample_without_replacement(spark, sf_dir):
    """Households without a car first, then others by their cars: 60 % of all. Tests hold the draw against its definition."""
    rows = table(spark, sf_dir, "households")
    return C.weighted_sample(rows, "household_id", F.col("vehicles"), rows.count() * 3 // 5, 3, F.col("vehicles") == 0).select("household_id", "vehicles")


@query()
def common_random_draws(spark, sf_dir):
    key = F.col("person_id")
    return table(spark, sf_dir, "persons").select("person_id", C.uniform("habit", 0, key).alias("u"), C.normal("taste", 0, F.col("household_id")).alias("z"), C.gumbel("mode", 7, key).alias("g"))


@query()
def weighted_category_draw(spark, sf_dir):
    u = C.uniform("job", 1, F.col("person_id"))
    return table(spark, sf_dir, "persons").select("person_id", C.pick(u, ["office", "shop", "home"], [F.lit(0.5), F.lit(0.3), F.lit(0.2)]).alias("job"))


def _numbered(rows):
    """rows, and how many there are; their index i must run from 0 without gaps, for draws name rows by it."""
    n, least, most, different = rows.agg(F.count("*"), F.min("i"), F.max("i"), F.countDistinct("i")).first()
    if n and (least, most, different) != (0, n - 1, n):
        raise ValueError(f"{n} rows are not numbered 0 to {n - 1}")
    return rows, n


@query()
def bootstrap_indices(spark, sf_dir):
    rows, n = _numbered(table(spark, sf_dir, "schools").select(F.col("school_id").alias("i"), F.col("curb_spots").alias("v")))
    return C.bootstrap_means(rows, "i", "v", n, 400, 9)


@query()
def approval_bootstrap(spark, sf_dir):
    """Share approving with its p10 and p90 over 400 resamples."""
    rows, n = _numbered(table(spark, sf_dir, "schools").select(F.col("school_id").alias("i"), (F.col("curb_spots") > 5).cast("int").alias("v")))
    means = C.bootstrap_means(rows, "i", "v", n, 400, 11)
    q = F.percentile("mean", F.array(F.lit(0.1), F.lit(0.9)))
    return rows.agg((F.avg("v") * 100).alias("approval")).join(means.agg((F.get(q, 0) * 100).alias("p10"), (F.get(q, 1) * 100).alias("p90")))


@query()
def slots_without_replacement(spark, sf_dir):
    """Every household to a slot by the curb, and those that find none to schools by their spots."""
    buildings = table(spark, sf_dir, "schools").select(F.col("school_id").alias("building_id"), (F.col("curb_spots") / 2).cast("int").alias("capacity"), F.col("curb_spots").alias("weight"))
    return C.slots(buildings, table(spark, sf_dir, "households").count(), 5, "weight")


@query("SELECT p_partkey AS id, CASE WHEN u < 1 / 3e0 THEN SQRT(u * 3) ELSE 3 - SQRT((1 - u) * 6) END AS q FROM (SELECT p_partkey, (p_size - 5e-1) / 50 AS u FROM {part}) t")
def triangular_quantile(spark, sf_dir):
    u = (F.col("p_size") - 0.5) / 50
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), C.triangular_quantile(u, F.lit(0.0), F.lit(1.0), F.lit(3.0)).alias("q"))
