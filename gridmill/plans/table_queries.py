"""Queries over the world's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmill.operators import tables as T
from gridmill.plans.views import table
from gridmill.registry import query


@query("""
WITH r AS (SELECT l_suppkey AS supplier, ARG_MIN(l_extendedprice, ROW(l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS v FROM {lineitem} WHERE l_quantity = 50 GROUP BY 1)
SELECT s_suppkey AS supplier, v IS NOT NULL AS matched, COALESCE(v, s_acctbal) AS price FROM {supplier} LEFT JOIN r ON r.supplier = s_suppkey""")
def first_match_left_join(spark, sf_dir):
    left = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_acctbal").alias("price"))
    right = table(spark, sf_dir, "lineitem").where("l_quantity = 50").withColumnsRenamed({"l_suppkey": "supplier", "l_extendedprice": "price"})
    return T.first_match(left, right, "supplier", "price", ["l_orderkey", "l_linenumber", "l_partkey", "price"]).select("supplier", "matched", "price")


@query("SELECT p.person_id, COALESCE(b.choice, -1) AS habit FROM {persons} p LEFT JOIN (SELECT person_id, age % 4 AS choice FROM {persons} WHERE person_id % 3 = 0) b ON b.person_id = p.person_id")
def habit_align(spark, sf_dir):
    persons = table(spark, sf_dir, "persons")
    return T.habit_align(persons.select("person_id"), persons.where("person_id % 3 = 0").select("person_id", (F.col("age") % 4).alias("choice")))


@query("""
WITH d AS (SELECT person_id, plan_min - base_min AS delta FROM {seed_person} WHERE seed = 1 AND person_id % 2 = 0),
r AS (SELECT p.person_id, p.household_id, d.delta FROM {persons} p LEFT JOIN d ON d.person_id = p.person_id)
SELECT person_id, ROUND(COALESCE(delta, AVG(delta) OVER (PARTITION BY household_id)), 6) AS delta FROM r""")
def household_fallback_lookup(spark, sf_dir):
    d = table(spark, sf_dir, "seed_person").where("seed = 1 and person_id % 2 = 0").select("person_id", (F.col("plan_min") - F.col("base_min")).alias("delta"))
    return T.household_fallback(table(spark, sf_dir, "persons"), d, "delta").withColumn("delta", F.round("delta", 6))


@query("SELECT p.person_id, n.x, n.z, h.income_band FROM {persons} p JOIN {households} h ON h.household_id = p.household_id JOIN {nodes} n ON n.node_id = h.home_node")
def star_join(spark, sf_dir):
    return T.star_join(*(table(spark, sf_dir, t) for t in ("persons", "households", "nodes"))).select("person_id", "x", "z", "income_band")


@query("SELECT edge_idx, ROUND(CASE WHEN edge_idx % 5 < 3 THEN GREATEST(length_m, 1) / (40 / 3.6) ELSE length_m / 20 END, 6) AS free_flow_s, CASE WHEN edge_idx % 4 < 2 THEN lanes * 6e2 ELSE 7e2 END AS capacity_vph FROM {edges}")
def edge_repair(spark, sf_dir):
    k = F.col("edge_idx")
    rows = table(spark, sf_dir, "edges").select("edge_idx", "length_m", "lanes", F.when(k % 5 == 0, float("nan")).when(k % 5 == 1, -1.0).when(k % 5 > 2, F.col("length_m") / 20).alias("free_flow_s"), F.when(k % 4 == 0, 0.0).when(k % 4 > 1, 700.0).alias("capacity_vph"))
    return T.repaired_edges(rows).select("edge_idx", F.round("free_flow_s", 6).alias("free_flow_s"), "capacity_vph")


@query("""
WITH h AS (SELECT household_id, x, z, household_id * 31 % (SELECT COUNT(*) * 2 FROM {part}) AS home_node FROM {homes}), n AS (SELECT * FROM {nodes} WHERE node_id % 3 > 0)
SELECT household_id, COALESCE((SELECT node_id FROM n WHERE n.node_id = h.home_node), (SELECT ARG_MIN(n.node_id, ROW(ROUND(SQRT(POW(n.x - h.x, 2) + POW(n.z - h.z, 2)), 6), n.node_id)) FROM n)) AS home_node FROM h""")
def home_repair(spark, sf_dir):
    """Homes whose node is gone or was never there move to the nearest."""
    n = table(spark, sf_dir, "part").count() * 2
    homes = table(spark, sf_dir, "homes").select("household_id", "x", "z", (F.col("household_id") * 31 % n).alias("home_node"))
    nodes = table(spark, sf_dir, "nodes").where("node_id % 3 > 0").select("node_id", F.col("x").alias("x2"), F.col("z").alias("z2"))
    return T.repaired_homes(homes, nodes)


@query("SELECT person_id, CASE WHEN person_id % 14 IN (SELECT school_id FROM {schools}) THEN person_id % 14 END AS school_id FROM {persons} WHERE household_id IN (SELECT household_id FROM {households} WHERE vehicles > 0)")
def referential_repair(spark, sf_dir):
    persons = table(spark, sf_dir, "persons").withColumn("school_id", F.col("person_id") % 14)
    return T.repaired(persons, table(spark, sf_dir, "households").where("vehicles > 0"), table(spark, sf_dir, "schools")).select("person_id", "school_id")


@query("SELECT o_orderkey AS id, a.x AS h_x, b.x AS w_x FROM {orders} JOIN {nodes} a ON a.node_id = o_orderkey % 3000 JOIN {nodes} b ON b.node_id = o_custkey")
def od_crosswalk_join(spark, sf_dir):
    od = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3000).alias("h_block"), F.col("o_custkey").alias("w_block"))
    return T.crosswalk(od, table(spark, sf_dir, "nodes").select(F.col("node_id").alias("block"), "x", "z")).select("id", "h_x", "w_x")


@query("SELECT CASE WHEN z > 48 THEN 'too tall' WHEN x < 20 THEN 'outside' WHEN cls = 7 THEN 'noise' ELSE 'kept' END AS reason, COUNT(*) AS n FROM {points} GROUP BY 1")
def tree_quality_filter(spark, sf_dir):
    return T.reason_counts(table(spark, sf_dir, "points"), [("too tall", F.col("z") > 48), ("outside", F.col("x") < 20), ("noise", F.col("cls") == 7)])


@query("SELECT dataset, license, COUNT(*) AS n FROM (SELECT DISTINCT p_partkey, dataset, license FROM (SELECT p_partkey, p_type AS dataset, CASE WHEN p_size % 2 = 0 THEN 'ODbL' ELSE 'CC0' END AS license FROM {part} UNION ALL SELECT p_partkey, CASE WHEN p_size > 25 THEN 'LARGE' ELSE p_type END, 'ODbL' FROM {part}) t) u GROUP BY 1, 2")
def license_tally(spark, sf_dir):
    """Features of each (dataset, license) pair, a feature once for a pair however often it names it."""
    pair = lambda d, l: F.struct(d.alias("dataset"), l.alias("license"))
    sources = F.array(pair(F.col("p_type"), F.when(F.col("p_size") % 2 == 0, "ODbL").otherwise("CC0")), pair(F.when(F.col("p_size") > 25, "LARGE").otherwise(F.col("p_type")), F.lit("ODbL")))
    return T.tally(table(spark, sf_dir, "part"), sources, []).select("value.dataset", "value.license", "n")


@query("""
WITH g AS (SELECT s_suppkey AS id, GREATEST(s_acctbal, 0) AS a, s_nationkey * 1e0 AS b, s_suppkey % 40 AS kids, s_suppkey % 55 AS workers, s_suppkey % 9 AS home, 100 + s_suppkey % 3 * 50 AS households, s_suppkey % 5 / 4e0 AS inside FROM {supplier})
SELECT id, ROUND(CASE WHEN a + b > 0 THEN a / (a + b) ELSE 5e-1 END, 6) AS a_share, ROUND(CASE WHEN a + b > 0 THEN b / (a + b) ELSE 5e-1 END, 6) AS b_share, ROUND(kids / households, 6) AS kids_ratio, ROUND(workers / households, 6) AS workers_ratio,
 ROUND(CASE WHEN workers > 0 THEN LEAST(home * 1e0 / workers, 1) ELSE 1.5e-1 END, 6) AS wfh_share, CAST(ROUND_EVEN(households * inside, 0) AS BIGINT) AS households FROM g""")
def census_distributions(spark, sf_dir):
    """Two shares with their defaults, ratios a household, and the households inside."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("id"), F.col("s_acctbal").alias("a"), F.col("s_nationkey").alias("b"), (k % 40).alias("kids"), (k % 55).alias("workers"), (k % 9).alias("home"), (100 + k % 3 * 50).alias("households"), (k % 5 / 4.0).alias("inside"))
    out = T.group_ratios(T.shares_or_default(rows, ["a", "b"], [0.5, 0.5]), 0.15)
    return out.select("id", *[F.round(c, 6).alias(c) for c in ("a_share", "b_share", "kids_ratio", "workers_ratio", "wfh_share")], "households")


_JOBS = "SELECT o_custkey % 20 AS grp, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 50 END AS node, CASE WHEN o_orderkey % 4 = 0 THEN 'exit' || CAST(o_custkey % 3 AS STRING) END AS exit, 1 + o_orderkey % 2 AS jobs FROM {orders}"


@query(f"""
WITH j AS ({_JOBS.replace('STRING', 'VARCHAR')}), i AS (SELECT grp, node, SUM(jobs) AS jobs FROM j WHERE node IS NOT NULL GROUP BY GROUPING SETS ((grp, node), (node))), x AS (SELECT grp, exit, SUM(jobs) AS jobs FROM j WHERE node IS NULL GROUP BY GROUPING SETS ((grp, exit), (exit)))
SELECT grp, 'node ' || CAST(node AS VARCHAR) AS place, ROUND(jobs / SUM(jobs) OVER (PARTITION BY grp), 6) AS share FROM i UNION ALL SELECT grp, exit, ROUND(jobs / SUM(jobs) OVER (PARTITION BY grp), 6) FROM x
 UNION ALL SELECT grp, 'inside', ROUND(SUM(jobs) FILTER (WHERE node IS NOT NULL) / SUM(jobs), 6) FROM j GROUP BY GROUPING SETS ((grp), ())""")
def work_model(spark, sf_dir):
    """Shares of each home group's jobs inside, by node, and by exit, and of all groups together (grp null)."""
    return T.work_model(spark.sql(_JOBS, orders=table(spark, sf_dir, "orders"))).withColumn("share", F.round("share", 6))


@query("WITH g AS (SELECT household_id % 25 AS grp, COUNT(DISTINCT household_id) AS households, COUNT(*) FILTER (WHERE age BETWEEN 19 AND 64) AS working_age FROM {persons} GROUP BY 1) SELECT grp, ROUND(LEAST(9.7e-1, 1.2 * households / GREATEST(working_age, 1)), 6) AS rate FROM g")
def employment_rate(spark, sf_dir):
    groups = table(spark, sf_dir, "persons").groupBy((F.col("household_id") % 25).alias("grp")).agg(F.countDistinct("household_id").alias("households"), F.count_if(F.col("age").between(19, 64)).alias("working_age"))
    return T.employment_rate(groups, 1.2).withColumn("rate", F.round("rate", 6))


@query("SELECT household_id, ARRAY_TO_STRING(LIST(DISTINCT person_id % 10 ORDER BY person_id % 10), ',') AS schools FROM {persons} WHERE grade >= 0 GROUP BY household_id")
def household_schools(spark, sf_dir):
    persons = table(spark, sf_dir, "persons").withColumn("school_id", F.when(F.col("grade") >= 0, F.col("person_id") % 10))
    return T.household_schools(persons).select("household_id", F.array_join(F.col("schools").cast("array<string>"), ",").alias("schools"))


@query("""
WITH m AS (SELECT person_id AS route, MEDIAN(plan_min) AS simulated FROM {seed_person} GROUP BY 1), o AS (SELECT s_suppkey AS route, CASE WHEN s_suppkey % 3 > 0 THEN 2.4e1 END AS observed FROM {supplier})
SELECT route, ROUND(ABS(simulated - observed) / observed * 100, 6) AS error_pct, CASE WHEN observed IS NULL THEN 'no target' WHEN ABS(simulated - observed) / observed * 100 <= 5 THEN 'ok' ELSE 'off' END AS status FROM m JOIN o USING (route)""")
def route_calibration_table(spark, sf_dir):
    simulated = table(spark, sf_dir, "seed_person").select(F.col("person_id").alias("route"), F.col("plan_min").alias("minutes"))
    observed = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("route"), F.when(F.col("s_suppkey") % 3 > 0, 24.0).alias("observed"))
    return T.calibration_table(simulated, observed, 5.0).select("route", F.round("error_pct", 6).alias("error_pct"), "status")


@query("""
WITH m AS (SELECT person_id AS route, MEDIAN(plan_min) AS simulated FROM {seed_person} GROUP BY 1), o AS (SELECT s_suppkey AS route, CASE WHEN s_suppkey % 3 > 0 THEN 2.4e1 END AS observed FROM {supplier}), e AS (SELECT ABS(simulated - observed) / observed * 100 AS e FROM m JOIN o USING (route))
SELECT COUNT(e) AS targets, ROUND(MEDIAN(e), 6) AS median_pct, CASE WHEN COUNT(e) < 5 THEN 'too few targets' WHEN MEDIAN(e) <= 5 THEN 'calibrated' ELSE 'off' END AS status FROM e""")
def route_calibration_status(spark, sf_dir):
    simulated = table(spark, sf_dir, "seed_person").select(F.col("person_id").alias("route"), F.col("plan_min").alias("minutes"))
    observed = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("route"), F.when(F.col("s_suppkey") % 3 > 0, 24.0).alias("observed"))
    return T.calibration_status(T.calibration_table(simulated, observed, 5.0), 5.0, 5).withColumn("median_pct", F.round("median_pct", 6))


@query("""
WITH c AS (SELECT person_id AS knob, seed AS candidate, base_min AS error, seed = 3 AS is_current FROM {seed_person})
SELECT knob, ARG_MIN(candidate, ROW(error, candidate)) AS best, MIN(error) < MAX(error) FILTER (WHERE is_current) AS accepted FROM c GROUP BY knob""")
def knob_argmin(spark, sf_dir):
    rows = table(spark, sf_dir, "seed_person").select(F.col("person_id").alias("knob"), F.col("seed").alias("candidate"), F.col("base_min").alias("error"), (F.col("seed") == 3).alias("is_current"))
    return T.knob_argmin(rows)


@query("SELECT type, cx, cz, n, SUM(n) OVER (PARTITION BY type ORDER BY cz, cx) - n AS \"offset\" FROM (SELECT cls AS type, CAST(FLOOR(x / 50) AS BIGINT) AS cx, CAST(FLOOR(y / 50) AS BIGINT) AS cz, COUNT(*) AS n FROM {points} GROUP BY 1, 2, 3) t")
def cell_sections(spark, sf_dir):
    return T.cell_sections(table(spark, sf_dir, "points").select(F.col("cls").alias("type"), "x", F.col("y").alias("z")), 50)


@query("SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_totalprice, o_orderkey) AS id FROM {orders}")
def stable_ids(spark, sf_dir):
    return T.stable_ids(table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "id")


@query("SELECT o_orderkey FROM (SELECT *, MAX(EXTRACT(YEAR FROM o_orderdate)) OVER (PARTITION BY o_custkey % 10) AS y FROM {orders}) t WHERE EXTRACT(YEAR FROM o_orderdate) = y")
def latest_year_items(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("g", F.col("o_custkey") % 10)
    return T.latest_year(rows, "o_orderdate", ["g"]).select("o_orderkey")


@query("SELECT DISTINCT age FROM {persons} WHERE age NOT IN (SELECT age FROM {persons} WHERE person_id < 60)")
def set_coverage(spark, sf_dir):
    persons = table(spark, sf_dir, "persons")
    return T.uncovered(persons, persons.where("person_id < 60"), "age")


@query("SELECT c_custkey AS id, c_name AS name, NULL AS size FROM {customer} UNION ALL SELECT p_partkey, NULL, p_size FROM {part}")
def append_with_alignment(spark, sf_dir):
    return T.append_aligned(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size")))


@query("SELECT p_type AS class, ROUND(LEAST(GREATEST(4e1 / MEDIAN(p_size), 1), 4), 6) AS factor FROM {part} WHERE p_type IN ('LARGE', 'PROMO') GROUP BY p_type")
def class_scale_factor(spark, sf_dir):
    rows = table(spark, sf_dir, "part").where("p_type in ('LARGE', 'PROMO')").select(F.col("p_type").alias("class"), F.col("p_size").alias("ratio"))
    return T.class_scale(rows, {"LARGE": 40.0, "PROMO": 40.0}).withColumn("factor", F.round("factor", 6))


@query("SELECT 'type ' || p_type AS what, COUNT(*) AS n FROM {part} GROUP BY 1 UNION ALL SELECT 'signals', COUNT(*) FROM {nodes} WHERE signalized UNION ALL SELECT 'workers', COUNT(*) FROM {persons} WHERE is_worker UNION ALL SELECT 'students', COUNT(*) FROM {persons} WHERE grade >= 0 UNION ALL SELECT 'school ' || CAST(s.school_id AS VARCHAR), COUNT(p.person_id) FROM {schools} s LEFT JOIN {persons} p ON p.grade >= 0 AND p.person_id % 14 = s.school_id GROUP BY s.school_id")
def build_counts(spark, sf_dir):
    """Buildings by type, signals, workers, students, and the students of every school."""
    persons = table(spark, sf_dir, "persons").withColumn("school_id", F.when(F.col("grade") >= 0, F.col("person_id") % 14))
    types = table(spark, sf_dir, "part").groupBy(F.concat(F.lit("type "), "p_type").alias("what")).agg(F.count("*").alias("n"))
    signals = table(spark, sf_dir, "nodes").where("signalized").agg(F.lit("signals").alias("what"), F.count("*").alias("n"))
    people = persons.agg(F.array(F.struct(F.lit("workers").alias("what"), F.count_if("is_worker").alias("n")), F.struct(F.lit("students").alias("what"), F.count("school_id").alias("n"))).alias("a")).select(F.inline("a"))
    schools = T.students_by_school(persons, table(spark, sf_dir, "schools")).select(F.concat(F.lit("school "), F.col("school_id").cast("string")).alias("what"), F.col("students").alias("n"))
    return types.union(signals).union(people).union(schools)


@query("""
WITH c AS (SELECT home_node, COUNT(*) AS n FROM {households} GROUP BY 1), s AS (SELECT s.school_id, n.x, n.z FROM {schools} s JOIN {nodes} n ON n.node_id = s.node_id),
h AS (SELECT n.node_id, ARG_MIN(s.school_id, ROW(ROUND(SQRT(POW(n.x - s.x, 2) + POW(n.z - s.z, 2)), 6), s.school_id)) AS hood FROM {nodes} n CROSS JOIN s GROUP BY 1), r AS (SELECT u AS node_id, ARG_MIN(name, edge_idx) AS street FROM {edges} WHERE highway = 'residential' GROUP BY 1)
SELECT n.node_id, COALESCE(c.n, 0) AS households, 'Hood ' || CAST(h.hood AS VARCHAR) || COALESCE(', near ' || r.street, '') AS label FROM {nodes} n LEFT JOIN c ON c.home_node = n.node_id LEFT JOIN h ON h.node_id = n.node_id LEFT JOIN r ON r.node_id = n.node_id""")
def building_detail(spark, sf_dir):
    """Households of each building, and its block: the nearest hood, and its street if it has one."""
    from gridmill.functions.scalars import block_label
    from gridmill.operators.spatial import nearest

    nodes, homes = table(spark, sf_dir, "nodes"), table(spark, sf_dir, "households").groupBy(F.col("home_node").alias("node_id")).agg(F.count("*").alias("households"))
    sites = table(spark, sf_dir, "schools").join(nodes, "node_id").select("school_id", F.col("x").alias("x2"), F.col("z").alias("z2"))
    hoods = nearest(nodes.select("node_id", "x", "z"), sites, "node_id", "school_id", 1000.0, digits=6).select("node_id", "school_id")
    streets = table(spark, sf_dir, "edges").where("highway = 'residential'").groupBy(F.col("u").alias("node_id")).agg(F.min_by("name", "edge_idx").alias("street"))
    rows = nodes.select("node_id").join(homes, "node_id", "left").join(hoods, "node_id", "left").join(streets, "node_id", "left").na.fill(0, ["households"])
    return rows.select("node_id", "households", block_label(F.concat(F.lit("Hood "), F.col("school_id").cast("string")), F.col("street"), "the neighborhood").alias("label"))
