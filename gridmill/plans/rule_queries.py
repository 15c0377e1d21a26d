"""Queries over rules, formulas and the remaining joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmill.functions import landcover as L
from gridmill.functions import rules as R
from gridmill.operators import choice as C
from gridmill.operators import population as P
from gridmill.operators import queues as Q
from gridmill.operators import spatial as S
from gridmill.operators.report import finite
from gridmill.plans.views import table
from gridmill.registry import query
from gridmill.sources import scans


def _id():
    return F.col("p_partkey").alias("id")


@query("""
SELECT p_partkey AS id, CASE WHEN p_size = 7 THEN 'school' WHEN p_type = 'LARGE' THEN 'house' WHEN p_type = 'PROMO' THEN 'commercial'
 WHEN p_type = 'STANDARD' THEN CASE WHEN p_retailprice >= 1400 THEN 'apartments' ELSE 'house' END
 WHEN p_retailprice < 1200 THEN CASE WHEN p_retailprice >= 950 THEN 'house' ELSE 'other' END WHEN p_size > 25 AND p_retailprice <= 1500 THEN 'house' ELSE 'commercial' END AS class FROM {part}""")
def building_class_rules(spark, sf_dir):
    tag = F.when(F.col("p_type") == "LARGE", "house").when(F.col("p_type") == "PROMO", "Retail").when(F.col("p_type") == "STANDARD", "residential")
    found = R.building_class(tag, F.col("p_retailprice"), F.col("p_size") == 7, F.col("p_size") > 25, 1200, 1400, 950, 1500)
    return table(spark, sf_dir, "part").select(_id(), found.alias("class"))


@query("""
SELECT p_partkey AS id, CASE WHEN NOT (p_size >= GREATEST(6, (p_partkey % 90) * 2e-1) AND p_partkey % 10 >= 3) THEN 'none' WHEN p_size >= 40 AND p_partkey % 11 >= 7 AND p_type <> 'PROMO' THEN 'good' WHEN p_size >= 12 AND p_type <> 'PROMO' THEN 'fair' ELSE 'poor' END AS quality FROM {part}""")
def roof_quality_flags(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(_id(), R.roof_quality(k % 90, F.col("p_size"), (k % 10) / 10.0, (k % 11) / 10.0, F.col("p_type") != "PROMO").alias("quality"))


@query("""
WITH t AS (SELECT p_partkey AS id, p_size / 2e0 AS h, p_partkey % 60 / 1e1 AS r, p_partkey % 10 / 1e1 AS q, CASE WHEN p_size % 3 > 0 THEN p_partkey % 7 / 1e1 END AS c, CASE WHEN p_size % 4 > 0 THEN p_partkey % 5 / 1e1 END AS m FROM {part})
SELECT id, CASE WHEN h >= 7 AND r <= 2.4 AND r / GREATEST(h, 1e-6) <= 2e-1 AND COALESCE(c, 0) < 3.5e-1 AND COALESCE(m, 1) < 2.5e-1 THEN 'palm' WHEN q < 6.2e-1 AND r / GREATEST(h, 1e-6) < 3.5e-1 AND h >= 6 THEN 'conifer' ELSE 'broadleaf' END AS species FROM t""")
def species_rules(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size")
    found = R.species(n / 2.0, k % 60 / 10.0, k % 10 / 10.0, F.when(n % 3 > 0, k % 7 / 10.0), F.when(n % 4 > 0, k % 5 / 10.0))
    return table(spark, sf_dir, "part").select(_id(), found.alias("species"))


@query("SELECT edge_idx, CASE WHEN edge_idx % 3 = 0 AND highway <> 'residential' THEN highway || '_link' ELSE highway END AS value FROM {edges}")
def overture_highway_tag(spark, sf_dir):
    k = F.col("edge_idx") % 3
    return table(spark, sf_dir, "edges").select("edge_idx", R.highway_value(F.col("highway"), F.when((k == 0) & (F.col("u") % 2 == 0), "link"), F.when((k == 0) & (F.col("u") % 2 == 1), F.array(F.lit("is_link")))).alias("value"))


@query("SELECT p_partkey AS id, CASE WHEN p_size * 1.609344 >= 60 AND p_size % 3 > 0 THEN CAST(p_size AS VARCHAR) || ' mph' ELSE '60' END AS tag FROM {part}")
def speed_limit_pick(spark, sf_dir):
    one = lambda v, unit, cond: F.struct(v.cast("double").alias("value"), F.lit(unit).alias("unit"), cond.alias("conditional"), F.lit(True).alias("whole"))
    limits = F.array(one(F.col("p_size"), "mph", F.col("p_size") % 3 == 0), one(F.lit(60), "km/h", F.lit(False)), one(F.lit(200), "km/h", F.lit(True)))
    return table(spark, sf_dir, "part").select(_id(), R.speed_limit(limits).alias("tag"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'I ' || p_size || ';Main' ELSE 'Main' END AS ref FROM {part}")
def route_refs(spark, sf_dir):
    one = lambda ref, net: F.struct(ref.alias("ref"), net.alias("network"))
    size = F.col("p_size").cast("string")
    routes = F.array(one(size, F.when(F.col("p_size") % 2 == 0, "US:I").otherwise("XX")), one(F.lit("Main"), F.lit("US:I")), one(F.lit("Main"), F.lit("XX")))
    return table(spark, sf_dir, "part").select(_id(), R.route_refs(routes, {"US:I": "I"}).alias("ref"))


def _smooth(x, lo, hi):
    t = f"LEAST(GREATEST(({x} - {lo}) / {hi - lo!r}, 0), 1)"
    return f"({t} * {t} * (3 - 2 * {t}))"


_PIXEL = "SELECT p_partkey AS id, p_partkey % 256 * 1e0 AS r, p_size * 5e0 AS g, p_partkey % 90 * 1e0 AS b FROM {part}"
_INDEX = f"SELECT id, (2 * g - r - b) / (r + g + b + 1e-3) AS e, (r + g + b + 1e-3) / 3 AS v, (r - b) / (r + g + b + 1e-3) AS w, (GREATEST(r, g, b) - LEAST(r, g, b)) / (GREATEST(r, g, b) + 1e-3) AS s, b - r AS d FROM ({_PIXEL}) p"
_CANOPY = f"{_smooth('e', 0.0, 0.08)} * (1 - {_smooth('v', 55, 85)})"


@query(f"""
WITH q AS ({_INDEX})
SELECT id, ROUND({_smooth('e', 0.04, 0.12)} * {_smooth('v', 60, 90)}, 6) AS lawn, ROUND((1 - {_smooth('e', 0.06, 0.12)}) * {_smooth('e', -0.06, 0.02)} * (1 - {_smooth('v', 115, 150)}) * (1 - {_CANOPY}) + 5e-2, 6) AS scrub,
 ROUND({_smooth('w', 0.04, 0.12)} * {_smooth('v', 110, 150)} * (1 - {_smooth('e', 0.0, 0.05)}), 6) AS dirt, ROUND((1 - {_smooth('s', 0.1, 0.22)}) * {_smooth('v', 85, 115)} * (1 - {_smooth('e', 0.01, 0.06)}), 6) AS paved,
 ROUND({_smooth('d', 8, 25)} * (1 - {_smooth('v', 80, 120)}) * (1 - {_smooth('e', 0.02, 0.08)}), 6) AS water, ROUND({_CANOPY}, 6) AS canopy FROM q""")
def pixel_classes(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(_id(), *L.by_colour(k % 256 * 1.0, F.col("p_size") * 5.0, k % 90 * 1.0))
    return rows.select("id", *[F.round(c, 6).alias(c) for c in L.COVERS])


_COVERED = """SELECT p_partkey AS id, p_partkey % 7 / 6e0 AS lawn, p_partkey % 5 / 4e0 AS scrub, p_partkey % 3 / 2e0 AS dirt, p_partkey % 11 / 1e1 AS paved, p_size % 4 / 3e0 AS water, p_size % 6 / 5e0 AS canopy,
 p_size % 2 * 1e0 AS m_lawn, p_size % 3 / 2e0 AS m_dirt, p_size % 5 / 4e0 AS m_wild, p_partkey % 4 / 3e0 AS m_paved, p_partkey % 6 / 5e0 AS m_water, p_size / 5e0 AS chm, p_size / 6e0 AS ndsm, p_partkey % 13 / 3e0 - 2 AS change,
 p_partkey % 256 * 1e0 AS v, p_partkey % 10 / 2e1 AS sat, p_size % 7 / 6e0 AS m_green, p_size % 9 / 8e0 AS m_trail, p_partkey % 17 / 1.6e1 AS p_forest, p_partkey % 19 / 1.8e1 AS p_shrub, p_partkey % 23 / 2.2e1 AS p_grass,
 p_size % 11 / 1e1 AS p_barren, p_size % 13 / 1.2e1 AS p_crop, p_partkey % 29 / 2.8e1 AS p_wetland FROM {part}"""


def _sets(sql, **columns):
    """A select around sql in which some columns are set anew, or added."""
    return f"(SELECT * EXCLUDE ({', '.join(columns)}), {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {sql})"


def _overridden():
    """What the evidence makes of the covers, worked out in SQL on its own."""
    t = f"(SELECT *, 0 AS fresh, 0 AS tree, 0 AS shrub, 0 AS flat, 0 AS grey FROM ({_COVERED}))"
    t = _sets(t, lawn="lawn * (1 - m_lawn) + m_lawn * GREATEST(lawn, 1 - 0.4 * canopy)", scrub="scrub - 0.8 * m_lawn * scrub", dirt="dirt - 0.6 * m_lawn * dirt")
    t = _sets(t, dirt="GREATEST(dirt, m_dirt)", lawn="lawn - 0.8 * m_dirt * lawn")
    t = _sets(t, scrub="scrub + 0.8 * m_wild * lawn", lawn="lawn - 0.8 * m_wild * lawn")
    t = _sets(t, canopy="canopy + 0.35 * p_forest + 0.2 * p_wetland", scrub="scrub + 0.35 * p_shrub + 0.2 * p_grass", dirt="dirt + 0.1 * p_grass + 0.4 * p_barren + 0.15 * p_crop", lawn="lawn + 0.15 * p_crop", water="water + 0.1 * p_wetland")
    t = _sets(t, fresh=f"1 - {_smooth('ABS(change)', 0.9, 1.5)}")
    t = _sets(t, tree=_smooth("(chm * fresh)", 2.4, 3.6), shrub=f"{_smooth('(ndsm * fresh)', 1.0, 2.0)} * (1 - {_smooth('(ndsm * fresh)', 3.0, 4.5)})", flat=f"1 - {_smooth('(ndsm * fresh)', 0.2, 1.0)}")
    t = _sets(t, canopy="GREATEST(canopy, 1.5 * tree)", **{c: f"{c} * (1 - 0.8 * tree)" for c in ("lawn", "scrub", "dirt", "paved", "water")})
    t = _sets(t, scrub="scrub + 0.6 * shrub * (1 - LEAST(GREATEST(lawn, 0), 1))", lawn="lawn * (1 - 0.5 * shrub) + 0.5 * flat * canopy * (1 - 0.7 * flat)", canopy="canopy * (1 - 0.7 * flat)")
    t = _sets(t, lawn="GREATEST(lawn, 0.7 * m_green)", scrub="GREATEST(scrub, 0.3 * m_green)", dirt="GREATEST(dirt, 1.5 * m_trail)")
    t = _sets(t, grey=f"m_water * {_smooth('v', 150, 190)} * (1 - {_smooth('sat', 0.15, 0.3)})", paved="paved * (1 - m_paved) + m_paved", **{c: f"{c} * (1 - m_paved)" for c in ("lawn", "scrub", "dirt", "water", "canopy")})
    return _sets(t, water="water * (1 - m_water) + m_water - grey", paved="paved * (1 - m_water) + grey", **{c: f"{c} * (1 - m_water)" for c in ("lawn", "scrub", "dirt", "canopy")})


@query(f"SELECT id, {', '.join(f'ROUND(CAST({c} AS DOUBLE), 9) AS {c}' for c in L.COVERS)} FROM {_overridden()}")
def landcover_overrides(spark, sf_dir):
    rows = spark.sql(_COVERED, part=table(spark, sf_dir, "part"))
    return L.landcover_overrides(rows, 3.0, 2.0, 1.5).select("id", *[F.round(c, 9).alias(c) for c in L.COVERS])


def _shoulder(refl):
    x = f"GREATEST(({refl} - 1e-2) / 2.9e-1, 0)"
    return f"SQRT(LEAST(CASE WHEN {x} > 6.5e-1 THEN 6.5e-1 + 3.5e-1 * TANH(({x} - 6.5e-1) / 3.5e-1) ELSE {x} END, 1))"


@query(f"""
WITH x AS (SELECT p_partkey AS id, {_shoulder('p_size / 1e2')} AS r, {_shoulder('p_partkey % 40 / 1e2')} AS g, {_shoulder('1e-1')} AS b FROM {{part}}), m AS (SELECT *, (r + g + b) / 3 AS l FROM x)
SELECT id, CAST(FLOOR(LEAST(GREATEST(l + (r - l) * 1.25, 0), 1) * 255 + 5e-1) AS INTEGER) AS r, CAST(FLOOR(LEAST(GREATEST(l + (g - l) * 1.25, 0), 1) * 255 + 5e-1) AS INTEGER) AS g, CAST(FLOOR(LEAST(GREATEST(l + (b - l) * 1.25, 0), 1) * 255 + 5e-1) AS INTEGER) AS b FROM m""")
def tone_map(spark, sf_dir):
    r, g, b = R.tone([F.col("p_size") / 100.0, F.col("p_partkey") % 40 / 100.0, F.lit(0.1)])
    return table(spark, sf_dir, "part").select(_id(), r.alias("r"), g.alias("g"), b.alias("b"))


@query("SELECT node_id, 'r' || CAST(LEAST(GREATEST(FLOOR((z - 5e2) / 1000), 0), 8) AS BIGINT) || '_c' || CAST(LEAST(GREATEST(FLOOR((x - 5e2) / 1000), 0), 6) AS BIGINT) AS tile FROM {nodes}")
def tile_id(spark, sf_dir):
    return table(spark, sf_dir, "nodes").select("node_id", R.tile_id(F.col("x"), F.col("z"), 500, 500, 1000, 9, 7).alias("tile"))


# the transverse Mercator projection by another road than the library's: the meridian's arc and powers of the distance from it
_MERIDIAN = "6.367449145822706e6 * phi - 1.6038508667976e4 * SIN(2 * phi) + 1.6832613333e1 * SIN(4 * phi) - 2.1984404e-2 * SIN(6 * phi) + 3.1148e-5 * SIN(8 * phi)"
_UTM = f"""
WITH p AS (SELECT node_id, RADIANS(3.30165e1 - z * 1e-6) AS phi, RADIANS(-1.171225e2 + x * 1e-6 + 117) AS dl FROM {{nodes}} UNION ALL SELECT -1, RADIANS(3.30165e1), RADIANS(-1.225e-1)),
q AS (SELECT node_id, {_MERIDIAN} AS m, 6378137 / SQRT(1 - 6.69437999014e-3 * POW(SIN(phi), 2)) AS n, POW(TAN(phi), 2) AS t, 6.739496742276e-3 * POW(COS(phi), 2) AS c, dl * COS(phi) AS a, TAN(phi) AS tp FROM p),
e AS (SELECT node_id, 9.996e-1 * n * (a + (1 - t + c) * POW(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * 6.739496742276e-3) * POW(a, 5) / 120) AS e,
 9.996e-1 * (m + n * tp * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * POW(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * 6.739496742276e-3) * POW(a, 6) / 720)) AS n FROM q)
SELECT e.node_id, ROUND(e.e - o.e, 2) AS x, ROUND(o.n - e.n, 2) + 0 AS z FROM e JOIN e o ON o.node_id = -1 WHERE e.node_id >= 0"""


@query(_UTM)
def utm_scene_transform(spark, sf_dir):
    """Scene metres of nodes placed by degrees, to the centimetre."""
    lon, lat = F.col("x") * 1e-6 - 117.1225, 33.0165 - F.col("z") * 1e-6
    x, z = R.scene(lon, lat, -117.1225, 33.0165)
    return table(spark, sf_dir, "nodes").select("node_id", F.round(x, 2).alias("x"), (F.round(z, 2) + 0).alias("z"))


@query()
def poisson_counts(spark, sf_dir):
    u = C.uniform("plants", 1, F.col("node_id"))
    return table(spark, sf_dir, "nodes").select("node_id", R.poisson(u, F.col("x") / 4000.0 + 0.5).alias("n"))


@query()
def demand_jitter(spark, sf_dir):
    """Weight 1 +- 10 % and a departure around 07:30, clipped to the window, for each person and seed."""
    rows = table(spark, sf_dir, "seed_person").select("seed", "person_id")
    keys = (F.col("seed"), F.col("person_id"))
    depart = F.least(F.greatest(27000 + 2100 * C.normal("depart", *keys), F.lit(21600.0)), F.lit(36000.0))
    return rows.select("seed", "person_id", (0.9 + 0.2 * C.uniform("weight", *keys)).alias("w"), depart.alias("depart_s"))


@query()
def commuters_today(spark, sf_dir):
    rows = table(spark, sf_dir, "persons")
    return rows.select("person_id", (F.col("is_worker") & (C.uniform("day", 4, F.col("person_id")) >= 0.12)).alias("commutes"))


@query("SELECT event_id, CASE WHEN value > 5e1 THEN NULL ELSE value END AS value, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value * 2 END AS nested, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS holes FROM events")
def non_finite_to_null(spark, sf_dir):
    """Numbers in columns, in structs and in arrays of them."""
    bad = float("nan")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("value") > 50, bad).otherwise(F.col("value")).alias("value"), F.struct(F.struct(F.when(F.col("event_id") % 3 == 0, float("inf")).otherwise(F.col("value") * 2).alias("b")).alias("a")).alias("s"), F.array(F.struct(F.lit(1.0).alias("v")), F.struct(F.when(F.col("event_id") % 5 == 0, bad).otherwise(2.0).alias("v"))).alias("list"))
    clean = scans.without_nan(rows)
    return clean.select("event_id", "value", F.col("s.a.b").alias("nested"), F.size(F.filter("list", lambda x: x["v"].isNull())).alias("holes"))


@query("""
WITH e AS (SELECT event_id, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id AS plan_id, k AS tools, 'tool' || CAST(k % 3 AS VARCHAR) AS first_tool, k * 1e1 AS first_amount, CASE WHEN k > 2 THEN 'done' ELSE 'queued' END AS status, event_id % 7 AS votes FROM e""")
def state_tables(spark, sf_dir):
    """Plans, jobs and votes as tables with JSON columns, written and read back under their types."""
    from gridmill.operators.state import read_state, write_state
    from gridmill.operators.network import shared_folder
    import uuid

    k = F.from_json("props", "k long")["k"]
    rows = table(spark, sf_dir, "events").select("event_id", "ts", k.alias("k"))
    tool = F.struct(F.concat(F.lit("tool"), (F.col("k") % 3).cast("string")).alias("tool"), F.create_map(F.lit("amount"), F.col("k") * 10.0).alias("params"))
    folder = f"{shared_folder(spark)}/state/{uuid.uuid4().hex}"
    write_state(rows.select(F.col("event_id").alias("plan_id"), F.col("ts").alias("created_at"), F.array_repeat(tool, F.col("k").cast("int")).alias("tools")), folder, "plans")
    write_state(rows.select(F.col("event_id").alias("plan_id"), F.struct(F.when(F.col("k") > 2, "done").otherwise("queued").alias("status"), F.lit(None).cast("string").alias("error")).alias("job")), folder, "jobs")
    write_state(rows.select(F.col("event_id").alias("plan_id"), F.explode(F.sequence(F.lit(0), (F.col("event_id") % 7).cast("int"))).alias("player_id")).where("player_id > 0").withColumn("value", F.lit(1)), folder, "votes")
    plans, jobs, votes = (read_state(spark, folder, t) for t in ("plans", "jobs", "votes"))
    n = votes.groupBy("plan_id").agg(F.sum("value").alias("votes"))
    first = F.get("tools", 0)
    return plans.join(jobs, "plan_id").join(n, "plan_id", "left").select("plan_id", F.size("tools").cast("long").alias("tools"), F.coalesce(first["tool"], F.concat(F.lit("tool"), F.lit("0"))).alias("first_tool"), F.coalesce(first["params"]["amount"], F.lit(0.0)).alias("first_amount"), F.col("job.status").alias("status"), F.coalesce("votes", F.lit(0)).alias("votes"))


@query("SELECT CAST(p_partkey AS INTEGER) AS id, p_brand AS brand, 'none' AS label FROM {part}")
def columnar_scan(spark, sf_dir):
    rows = scans.columnar_scan(spark, f"{sf_dir}/part.parquet", {"p_partkey": "int", "p_brand": "string", "label": "string"}, {"label": "none"})
    return rows.toDF("id", "brand", "label")


@query("SELECT c_custkey AS persona_id, c_mktsegment AS segment, c_custkey % 5 = 0 AS mine, COALESCE(CAST(ROUND(c_acctbal / 100) AS BIGINT), 0) AS balance FROM {customer}")
def public_view(spark, sf_dir):
    """Only what the list allows goes out; columns that name a person, household or building never do."""
    from gridmill.operators.state import public

    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("persona_id"), F.col("c_mktsegment").alias("segment"), (F.col("c_custkey") % 5 == 0).alias("mine"), F.round(F.col("c_acctbal") / 100).cast("long").alias("balance"), F.col("c_name").alias("person_id"), F.col("c_nationkey").alias("household_id"))
    return public(rows, ["persona_id", "segment", "mine", "balance"])


@query("SELECT p_partkey AS id, CASE WHEN p_size % 4 IN (1, 2) AND p_size BETWEEN 3 AND 40 AND p_type <> 'PROMO' THEN p_size * 1e0 ELSE p_retailprice END AS height, CASE WHEN p_size % 4 IN (1, 2) AND p_size BETWEEN 3 AND 40 AND p_type <> 'PROMO' THEN 'measured' ELSE 'mapped' END AS source FROM {part}")
def usable_measurement_override(spark, sf_dir):
    ok = (F.col("p_size") % 4).isin(1, 2) & F.col("p_size").between(3, 40) & (F.col("p_type") != "PROMO")
    return table(spark, sf_dir, "part").select(_id(), F.when(ok, F.col("p_size") * 1.0).otherwise(F.col("p_retailprice")).alias("height"), F.when(ok, "measured").otherwise("mapped").alias("source"))


@query("SELECT p_partkey AS id, LEAST(GREATEST(p_size / 2e0, 5e-1), 15) AS radius FROM {part} WHERE p_partkey % 3 = 0 OR ABS(p_partkey % 50 - 25) <= 15")
def stale_tree_filter(spark, sf_dir):
    change = F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey") % 50 - 25)
    rows = table(spark, sf_dir, "part").where(F.coalesce(F.abs(change), F.lit(0)) <= 15)
    return rows.select(_id(), F.least(F.greatest(F.col("p_size") / 2.0, F.lit(0.5)), F.lit(15.0)).alias("radius"))


@query("SELECT edge_idx FROM {edges} WHERE highway IN ('primary', 'secondary') AND edge_idx % 7 <> 0")
def road_segment_filter(spark, sf_dir):
    flags = F.array(F.struct(F.when(F.col("edge_idx") % 7 == 0, "is_abandoned").otherwise("is_bridge").alias("flag"), F.lit(True).alias("whole")))
    rows = table(spark, sf_dir, "edges").withColumn("flags", flags)
    gone = F.exists("flags", lambda f: f["flag"].isin("is_abandoned", "is_under_construction") & f["whole"])
    return rows.where(F.col("highway").isin("primary", "secondary") & ~gone).select("edge_idx")


@query("SELECT s_suppkey FROM {supplier} WHERE s_acctbal BETWEEN 0 AND 5e3 AND s_nationkey BETWEEN 3 AND 15")
def lonlat_bbox_filter(spark, sf_dir):
    return table(spark, sf_dir, "supplier").where(F.col("s_acctbal").between(0, 5e3) & F.col("s_nationkey").between(3, 15)).select("s_suppkey")


@query("SELECT b.box_id, COUNT(p.z) AS n, ROUND(COALESCE(QUANTILE_CONT(p.z, 0.5), 0), 6) AS median_z, ROUND(COALESCE(QUANTILE_CONT(p.z, 0.9), 0), 6) AS p90_z FROM {boxes} b LEFT JOIN (SELECT x * 50 + 1.3e-1 AS x, y * 50 + 1.7e-1 AS z0, z FROM {points}) p ON p.x > b.x0 AND p.x < b.x1 AND p.z0 > b.z0 AND p.z0 < b.z1 GROUP BY b.box_id")
def zonal_stats(spark, sf_dir):
    points = table(spark, sf_dir, "points").select((F.col("x") * 50 + 0.13).alias("x"), (F.col("y") * 50 + 0.17).alias("z"), F.col("z").alias("value"))
    boxes = table(spark, sf_dir, "boxes").select("box_id", S.box_ring(F.col("x0"), F.col("z0"), F.col("x1"), F.col("z1")).alias("ring"))
    q = F.percentile("value", F.array(F.lit(0.5), F.lit(0.9)))
    met = S.points_in_polygons(points, boxes, 500).groupBy("box_id").agg(F.count("*").alias("n"), F.round(F.get(q, 0), 6).alias("median_z"), F.round(F.get(q, 1), 6).alias("p90_z"))
    return boxes.select("box_id").join(met, "box_id", "left").na.fill(0)


@query("""
WITH b AS (SELECT h.household_id, h.x, h.z, (40e0 + h.household_id % 60) * CASE WHEN h.household_id % 9 = 0 THEN 2.5 ELSE 1 END AS w FROM {homes} h WHERE h.household_id % 4 < 3),
s AS (SELECT b.household_id, ANY_VALUE(b.w) AS w, ARG_MIN(n.node_id, ROW(ROUND(SQRT(POW(n.x - b.x, 2) + POW(n.z - b.z, 2)), 6), n.node_id)) AS node_id FROM b CROSS JOIN {nodes} n WHERE n.node_id % 2 = 0 GROUP BY 1)
SELECT node_id, ROUND(SUM(w), 4) AS jobs, ROUND(SUM(w) / SUM(SUM(w)) OVER (), 8) AS share FROM s GROUP BY node_id""")
def jobs_from_footprints(spark, sf_dir):
    """Job weights by floor area, schools times a factor, at the nearest node."""
    k = F.col("household_id")
    homes = table(spark, sf_dir, "homes").where("household_id % 4 < 3").select(k.alias("building_id"), "x", "z", (40.0 + k % 60).alias("area"), (k % 9 == 0).alias("school"))
    nodes = table(spark, sf_dir, "nodes").where("node_id % 2 = 0").select("node_id", F.col("x").alias("x2"), F.col("z").alias("z2"))
    return P.footprint_jobs(homes, nodes, 2.5).select("node_id", F.round("jobs", 4).alias("jobs"), F.round("share", 8).alias("share"))


_PIXEL = "SELECT p_brand, " + ", ".join(f"p_partkey * {k} % 97 * 1e0 AS {c}" for c, k in zip(L.COVERS, (1, 5, 11, 17, 23, 31))) + " FROM {part}"


@query(f"""
WITH p AS ({_PIXEL}), w AS (SELECT p_brand, [{', '.join(L.COVERS)}] AS w FROM p),
s AS (SELECT p_brand, CASE WHEN list_sum(w) > 0 THEN list_transform(w, lambda x: x / list_sum(w)) ELSE [0, 1, 0, 0, 0, 0] END AS w FROM w),
b AS (SELECT p_brand, w, list_transform(w, lambda x: FLOOR(x * 255 / list_sum(w))) AS f FROM s),
c AS (SELECT p_brand, UNNEST(list_transform(range(1, 7), lambda i: {{'cover': {list(L.COVERS)}[i], 'n': f[i] + CASE WHEN i = list_position(w, list_max(w)) THEN 255 - list_sum(f) ELSE 0 END}})) AS c FROM b)
SELECT p_brand AS tile, c.cover AS cover, ROUND(AVG(c.n) / 255, 6) AS share FROM c GROUP BY 1, 2""")
def landcover_shares(spark, sf_dir):
    """Six covers a pixel, as bytes, and their mean share in each tile."""
    rows = spark.sql(_PIXEL, part=table(spark, sf_dir, "part")).withColumnRenamed("p_brand", "tile")
    return L.mean_shares(rows, ["tile"]).withColumn("share", F.round("share", 6))


@query("SELECT ARG_MAX(o_orderkey, ROW(-ROUND(o_totalprice % 100, 4), o_orderdate, o_orderkey)) AS scene FROM (SELECT * FROM {orders} WHERE o_totalprice < 1e5 ORDER BY o_totalprice, o_orderkey LIMIT 8) t")
def best_scene(spark, sf_dir):
    few = table(spark, sf_dir, "orders").where("o_totalprice < 1e5").orderBy("o_totalprice", "o_orderkey").limit(8)
    return few.agg(F.max_by("o_orderkey", F.struct(-F.round(F.col("o_totalprice") % 100, 4), "o_orderdate", "o_orderkey")).alias("scene"))


@query("SELECT CAST(FLOOR(x / 1000) AS BIGINT) AS bx, CAST(FLOOR(z / 1000) AS BIGINT) AS bz, COUNT(*) AS n FROM {homes} GROUP BY 1, 2 ORDER BY n DESC, bx, bz LIMIT 5")
def densest_boxes(spark, sf_dir):
    counts = table(spark, sf_dir, "homes").groupBy(S.cell(F.col("x"), 1000).alias("bx"), S.cell(F.col("z"), 1000).alias("bz")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "bx", "bz").limit(5)


@query("SELECT trip, SUM(dwell_s) AS seconds, ARRAY_TO_STRING(LIST(edge_idx ORDER BY step DESC), ',') AS back FROM {trajectory} GROUP BY trip")
def path_concat(spark, sf_dir):
    rows = table(spark, sf_dir, "trajectory").groupBy("trip").agg(F.sum("dwell_s").alias("seconds"), F.array_sort(F.collect_list(F.struct("step", "edge_idx"))).alias("p"))
    return rows.select("trip", "seconds", F.array_join(F.reverse(F.transform("p", lambda x: x["edge_idx"].cast("string"))), ",").alias("back"))


@query("SELECT e.edge_idx, s.box_id FROM {edges} e JOIN (SELECT DISTINCT p_brand AS brand, p_size % 5 AS box_id FROM {part} WHERE p_size < 5) s ON STARTS_WITH(e.name, CONCAT('Road ', s.brand))")
def name_or_ref_theta_join(spark, sf_dir):
    """Prefixes are made into the names they can start, by equality on the whole prefix length."""
    labels = table(spark, sf_dir, "part").where("p_size < 5").select(F.concat(F.lit("Road "), "p_brand").alias("prefix"), (F.col("p_size") % 5).alias("box_id")).distinct()
    lengths = labels.select(F.length("prefix").alias("size")).distinct()
    starts = table(spark, sf_dir, "edges").join(F.broadcast(lengths)).where("length(name) >= size").withColumn("prefix", F.expr("substring(name, 1, size)"))
    return starts.join(labels, "prefix").select("edge_idx", "box_id")


_DOORS = "SELECT school_id, k.k AS door, (node_id + k.k * 3) % (SELECT COUNT(*) FROM {part}) AS node_id, 20e0 + (school_id + k.k) % 4 * 15 AS approach_s, CAST((school_id * 7 + k.k * 5) % 9 AS DOUBLE) * 20 AS wait_s FROM {schools} JOIN (VALUES (0), (1), (2)) AS k(k) ON k.k <= school_id % 3"
_STOPS = "SELECT person_id, person_id % 10 AS school_id, person_id % 3 = 0 AS walks, h.home_node FROM {persons} p JOIN {households} h ON h.household_id = p.household_id WHERE p.grade >= 0"


@query(f"""
WITH d AS ({_DOORS}), t AS ({_STOPS}), c AS (SELECT t.person_id, t.walks, d.door, ABS(d.node_id - t.home_node) % 97 * 4 + approach_s + wait_s AS cost FROM t JOIN d ON d.school_id = t.school_id)
SELECT person_id, CASE WHEN BOOL_OR(walks) THEN MIN(door) ELSE ARG_MIN(door, ROW(cost, door)) END AS entrance FROM c GROUP BY person_id""")
def entrance_choice(spark, sf_dir):
    """Each stop's cheapest entrance of its own school: skim, approach and learned wait; who doesn't queue takes the first."""
    doors = spark.sql(_DOORS, schools=table(spark, sf_dir, "schools"), part=table(spark, sf_dir, "part"))
    stops = spark.sql(_STOPS, persons=table(spark, sf_dir, "persons"), households=table(spark, sf_dir, "households"))
    wanted = stops.join(doors, "school_id").select("home_node", "node_id").distinct()
    skim = wanted.withColumn("seconds", F.abs(F.col("node_id") - F.col("home_node")) % 97 * 4)
    return P.entrance_choice(stops, doors, skim)


@query("""
WITH d AS (SELECT h.household_id, MIN(SQRT(POW(h.x - b.x0, 2) + POW(h.z - b.z0, 2))) * 1.3 / 1000 AS km FROM {homes} h JOIN {boxes} b ON SQRT(POW(h.x - b.x0, 2) + POW(h.z - b.z0, 2)) <= 1.04 * 1000 / 1.3 GROUP BY 1),
c AS (SELECT household_id, CASE WHEN household_id % 3 > 0 THEN household_id % 11 / 1e1 END AS cur FROM {homes})
SELECT c.household_id, ROUND(CASE WHEN km IS NOT NULL AND (cur IS NULL OR km < cur) THEN km ELSE cur END, 6) AS walk_km, km IS NOT NULL AND (cur IS NULL OR km < cur) AS replaced FROM c LEFT JOIN d ON d.household_id = c.household_id""")
def transit_stop_access(spark, sf_dir):
    stops = table(spark, sf_dir, "boxes").select(F.col("x0").alias("x2"), F.col("z0").alias("z2"))
    homes = table(spark, sf_dir, "homes").withColumn("cur", F.when(F.col("household_id") % 3 > 0, F.col("household_id") % 11 / 10.0))
    return S.stop_access(homes, stops, "household_id", 1.04, 1.3, "cur").withColumn("walk_km", F.round("walk_km", 6))


@query("SELECT trip, MIN(enter_s) AS start_s, MAX(enter_s + dwell_s) AS end_s, COUNT(*) AS n FROM {trajectory} GROUP BY trip")
def demand_override_hook(spark, sf_dir):
    """User functions from DataFrame to DataFrame, applied in order."""
    hooks = [lambda t: t.groupBy("trip").agg(F.min("enter_s").alias("start_s"), F.max(F.col("enter_s") + F.col("dwell_s")).alias("end_s"), F.count("*").alias("n")), lambda t: t.where("n > 0")]
    rows = table(spark, sf_dir, "trajectory")
    for hook in hooks:
        rows = rows.transform(hook)
    return rows


@query("SELECT bin, edge_idx, CASE WHEN bin BETWEEN 10 AND 14 AND edge_idx % 9 = 0 THEN 2.5e-1 ELSE 1e0 END AS factor FROM (SELECT DISTINCT bin, edge_idx FROM {seed_edge_bin}) t")
def time_event_hook(spark, sf_dir):
    """A user's event gives closures, which fold into the links."""
    links = table(spark, sf_dir, "seed_edge_bin").select("bin", "edge_idx").distinct()
    event = links.where("edge_idx % 9 = 0").select("edge_idx").distinct().selectExpr("edge_idx", "10 AS start_bin", "15 AS end_bin", "25e-2D AS factor", "0 AS delay_s")
    return Q.with_closures(links, event).select("bin", "edge_idx", "factor")
