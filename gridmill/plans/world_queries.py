"""Queries over schools, places, streets and candidates for buildings."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmill.functions import tags as T
from gridmill.operators import spatial as S
from gridmill.operators import world as O
from gridmill.plans.views import table
from gridmill.registry import query
from gridmill.sources import scans

_KIND = "CASE p_size % 7 WHEN 0 THEN ' High School' WHEN 1 THEN ' Middle' WHEN 2 THEN ' ELEMENTARY' WHEN 3 THEN ' Montessori Elementary' WHEN 4 THEN ' Continuation High' WHEN 5 THEN ' Senior high and Middle' ELSE ' Library' END"


@query("SELECT p_partkey AS id, CASE WHEN p_size % 7 IN (0, 5) THEN 9 WHEN p_size % 7 = 1 THEN 6 WHEN p_size % 7 = 2 THEN 0 END AS g0, CASE WHEN p_size % 7 IN (0, 5) THEN 12 WHEN p_size % 7 = 1 THEN 8 WHEN p_size % 7 = 2 THEN 5 END AS g1 FROM {part}")
def k12_school_filter(spark, sf_dir):
    grades = T.school_grades(F.concat("p_brand", F.expr(_KIND)))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.get(grades, 0).alias("g0"), F.get(grades, 1).alias("g1"))


@query("SELECT p_partkey AS id, (p_size % 3 = 0 OR p_size % 5 = 0 OR p_partkey % 4 = 0) AND CASE WHEN p_size % 3 = 0 THEN TRUE WHEN p_size % 3 = 1 THEN FALSE WHEN p_partkey % 4 = 0 THEN TRUE ELSE FALSE END AS is_school FROM {part}")
def school_place_filter(spark, sf_dir):
    n, k = F.col("p_size"), F.col("p_partkey")
    primary = F.when(n % 3 == 0, "high_school").when(n % 3 == 1, "dance_school")
    taxonomy = F.struct(primary.alias("primary"), F.when(n % 5 == 0, F.array(F.lit("education"), F.lit("k_12_school"))).alias("hierarchy"), F.lit(None).cast("array<string>").alias("alternates"))
    categories = F.struct(F.when(k % 4 == 0, "public_school").alias("primary"), F.array(F.lit("tutoring")).alias("alternate"))
    return table(spark, sf_dir, "part").select(k.alias("id"), T.is_school_place(taxonomy, F.lit("education"), categories).alias("is_school"))


@query("""
SELECT edge_idx, CASE WHEN edge_idx % 6 = 0 THEN 'Ted Way' WHEN edge_idx % 6 = 1 THEN 'State 56' WHEN edge_idx % 6 = 2 THEN 'Interstate' WHEN edge_idx % 6 = 3 THEN 'State 56' ELSE '' END AS label,
 CASE WHEN edge_idx % 6 = 5 THEN '' ELSE name END AS road FROM {edges}""")
def road_ref_label(spark, sf_dir):
    k = F.col("edge_idx") % 6
    labels = [("Interstate", "I-15"), ("State 56", "CA 56"), ("Ted Way", "SR 56")]
    name = F.when(k == 0, "Old Road, TED WAY East").otherwise(F.col("name"))
    ref = F.when(k == 0, "CA 56").when(k == 1, "sr-56;US 1").when(k == 2, "Interstate  15").when(k == 3, "State Route 56, I 15x").otherwise("I 5")
    label = F.when(k == 5, "North (to SR 56 west) eastbound").otherwise(F.concat("name", F.lit(" south  (to SR 56 west)")))
    return table(spark, sf_dir, "edges").select("edge_idx", T.road_label(name, ref, labels).alias("label"), T.exit_road(label).alias("road"))


@query("""
SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN LOWER(p_type) WHEN p_size % 3 = 1 THEN 'school' ELSE 'yes' END AS building, PRINTF('%.2f', p_retailprice) AS height,
 CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) END AS levels, p_name AS name, CASE p_partkey % 3 WHEN 0 THEN NULL ELSE 'OpenStreetMap' END AS source, CASE WHEN p_partkey % 3 = 1 THEN CAST(p_partkey AS VARCHAR) END AS way_id FROM {part}""")
def building_tags_struct(spark, sf_dir):
    n, k = F.col("p_size"), F.col("p_partkey")
    none = F.lit(None).cast("string")
    source = F.struct(F.lit("OpenStreetMap").alias("dataset"), F.concat(F.when(k % 3 == 1, "w").otherwise("n"), k.cast("string"), F.lit("@1")).alias("record_id"))
    row = F.struct(
        k.cast("string").alias("id"), F.when(n % 3 == 0, F.lower("p_type")).alias("class"), F.when(n % 3 == 1, "education").otherwise("unheard of").alias("subtype"), F.col("p_retailprice").alias("height"), F.lit(None).cast("double").alias("min_height"),
        F.when(n % 2 == 0, n).alias("num_floors"), F.lit(None).cast("double").alias("roof_height"), none.alias("roof_shape"), none.alias("roof_material"), none.alias("roof_color"), none.alias("facade_color"), none.alias("facade_material"),
        F.struct(F.col("p_name").alias("primary")).alias("names"), F.when(k % 3 > 0, F.array(source)).alias("sources"),
    )
    return table(spark, sf_dir, "part").select(k.alias("id"), T.building_tags(row).alias("t")).select("id", "t.building", "t.height", "t.levels", "t.name", "t.source", "t.way_id")


_MATCH = """
WITH f AS (SELECT box_id AS feature_id, x0 + 4e2 AS x0, x1 + 4e2 AS x1, z0, z1, CASE box_id % 5 WHEN 0 THEN 'the nr ' || CAST(box_id + 1 AS VARCHAR) || ' School' WHEN 1 THEN 'Maintenance' WHEN 2 THEN 'Another High' WHEN 3 THEN 'nr 1000000' END AS name, box_id % 7 > 0 AS poly FROM {boxes}),
s AS (SELECT s.school_id, n.x, n.z FROM {schools} s JOIN {nodes} n ON n.node_id = s.node_id),
d AS (SELECT f.feature_id, s.school_id, SQRT(POW(GREATEST(f.x0 - s.x, 0, s.x - f.x1), 2) + POW(GREATEST(f.z0 - s.z, 0, s.z - f.z1), 2)) AS d FROM f JOIN s ON s.x BETWEEN f.x0 - 300 AND f.x1 + 300 AND s.z BETWEEN f.z0 - 300 AND f.z1 + 300 WHERE f.poly AND f.feature_id % 5 <> 0 AND f.feature_id % 5 <> 2),
n AS (SELECT feature_id, MIN(school_id) FILTER (WHERE d = 0) AS inside, ARG_MIN(school_id, ROW(ROUND(d, 6), -school_id)) AS near FROM d WHERE d <= 300 GROUP BY feature_id)
SELECT f.feature_id, CASE WHEN f.feature_id % 5 = 0 AND f.feature_id + 1 IN (SELECT school_id FROM s) THEN f.feature_id + 1 WHEN f.feature_id % 5 = 0 THEN NULL ELSE COALESCE(n.inside, n.near) END AS school_id FROM f LEFT JOIN n ON n.feature_id = f.feature_id"""


@query(_MATCH)
def entity_match_name_then_space(spark, sf_dir):
    k = F.col("box_id")
    name = F.when(k % 5 == 0, F.concat(F.lit("the nr "), (k + 1).cast("string"), F.lit(" School"))).when(k % 5 == 1, "Maintenance").when(k % 5 == 2, "Another High").when(k % 5 == 3, "nr 1000000")
    ring = F.when(k % 7 > 0, S.box_ring(F.col("x0") + 400, F.col("z0"), F.col("x1") + 400, F.col("z1")))
    features = table(spark, sf_dir, "boxes").select(k.alias("feature_id"), name.alias("name"), ring.alias("ring"))
    schools = table(spark, sf_dir, "schools").join(table(spark, sf_dir, "nodes").select("node_id", F.col("x").alias("x2"), F.col("z").alias("z2")), "node_id")
    return O.match_campuses(features, schools.select("school_id", F.concat(F.lit("Nr. "), F.col("school_id").cast("string"), F.lit(" Campus")).alias("name"), "x2", "z2"), 300.0)


@query()
def place_dedupe_join(spark, sf_dir):
    """Campuses are boxes, places lie about homes; each place's rivals are met by cells."""
    polygons = table(spark, sf_dir, "boxes").where("box_id % 4 = 0").select(F.col("box_id").alias("id"), F.when(F.col("box_id") % 8 == 0, F.concat(F.lit("Campus "), F.col("box_id").cast("string"))).alias("name"), S.box_ring(F.col("x0"), F.col("z0"), F.col("x0") + 200, F.col("z0") + 150).alias("ring"))
    name = F.concat(F.when(F.col("household_id") % 11 == 0, "Swim ").otherwise("Place "), (F.col("household_id") % 50).cast("string"))
    places = table(spark, sf_dir, "homes").select(F.col("household_id").alias("id"), name.alias("name"), (F.col("household_id") * 37 % 100 / 100.0).alias("confidence"), F.col("x").alias("x2"), F.col("z").alias("z2"))
    return O.merge_places(polygons, places)


_SPAN = 420


@query(f"""
WITH RECURSIVE s AS (SELECT e.edge_idx, e.highway AS cls, a.x AS x0, a.z AS z0, b.x AS x1, b.z AS z1 FROM {{edges}} e JOIN {{nodes}} a ON a.node_id = e.u JOIN {{nodes}} b ON b.node_id = e.v WHERE e.u < e.v),
c AS (SELECT h.household_id AS id, s.edge_idx, s.cls, h.x, h.z, LEAST(GREATEST(h.x, LEAST(s.x0, s.x1)), GREATEST(s.x0, s.x1)) AS px, LEAST(GREATEST(h.z, LEAST(s.z0, s.z1)), GREATEST(s.z0, s.z1)) AS pz FROM {{homes}} h JOIN s ON s.x0 BETWEEN h.x - 800 AND h.x + 800 AND s.z0 BETWEEN h.z - 800 AND h.z + 800),
d AS (SELECT id, edge_idx, cls, ROUND(SQRT(POW(x - px, 2) + POW(z - pz, 2)), 2) AS d, ROUND(((DEGREES(ATAN2(px - x, z - pz)) % 360) + 360) % 360, 4) AS b FROM c WHERE ROUND(SQRT(POW(x - px, 2) + POW(z - pz, 2)), 2) <= {_SPAN}),
r AS (SELECT id, ROW_NUMBER() OVER (PARTITION BY id ORDER BY d, cls, edge_idx) AS n, d, b FROM d),
w(id, n, kept, names) AS (SELECT DISTINCT id, CAST(0 AS BIGINT), CAST([] AS DOUBLE[]), CAST([] AS DOUBLE[]) FROM r
 UNION ALL SELECT w.id, r.n, CASE WHEN len(kept) < 3 AND len(list_filter(kept, lambda k: LEAST(((r.b - k) % 360 + 360) % 360, 360 - ((r.b - k) % 360 + 360) % 360) <= 25)) = 0 THEN list_append(kept, r.b) ELSE kept END,
  CASE WHEN len(kept) < 3 AND len(list_filter(kept, lambda k: LEAST(((r.b - k) % 360 + 360) % 360, 360 - ((r.b - k) % 360 + 360) % 360) <= 25)) = 0 THEN list_append(names, r.d) ELSE names END FROM w JOIN r ON r.id = w.id AND r.n = w.n + 1)
SELECT h.household_id AS id, COALESCE(len(t.names), 0) AS n, ROUND(COALESCE(list_sum(t.names), 0), 2) AS total_m FROM {{homes}} h LEFT JOIN (SELECT id, ARG_MAX(names, n) AS names FROM w GROUP BY id) t ON t.id = h.household_id""")
def street_context_topk(spark, sf_dir):
    n = table(spark, sf_dir, "nodes")
    at = lambda s, i: n.select(F.col("node_id").alias(s), F.col("x").alias(f"x{i}"), F.col("z").alias(f"z{i}"))
    streets = table(spark, sf_dir, "edges").where("u < v").join(at("u", 0), "u").join(at("v", 1), "v").select(F.col("edge_idx").alias("street_id"), F.col("highway").alias("cls"), "x0", "z0", "x1", "z1")
    out = O.street_context(table(spark, sf_dir, "homes").select(F.col("household_id").alias("id"), "x", "z"), streets, float(_SPAN))
    far = F.aggregate(F.transform("streets", lambda s: s["d"]), F.lit(0.0), lambda a, x: a + x)
    return out.select("id", F.coalesce(F.nullif(F.size("streets"), F.lit(-1)), F.lit(0)).cast("long").alias("n"), F.round(F.coalesce(far, F.lit(0.0)), 2).alias("total_m"))


_FOUND = """SELECT h.household_id AS id, h.x, h.z, 2e0 + h.household_id % 9 AS w, 6e0 + h.household_id % 41 AS len, CASE h.household_id % 6 WHEN 0 THEN 'unknown' WHEN 1 THEN 'flat' ELSE 'gable' END AS roof_type,
 3e0 + h.household_id % 4 AS height, 1e2 + h.household_id % 80 AS area, h.household_id % 70 AS n_points FROM {homes} h"""
_NEAR = """
WITH f AS ({0}), b AS (SELECT x, z FROM {{nodes}} WHERE node_id % 7 = 0), p AS (SELECT x0 AS x, z0 AS z FROM {{boxes}}),
g AS (SELECT f.*, EXISTS (SELECT 1 FROM b WHERE SQRT(POW(b.x - f.x, 2) + POW(b.z - f.z, 2)) <= 60) AS on_bridge, EXISTS (SELECT 1 FROM p WHERE SQRT(POW(p.x - f.x, 2) + POW(p.z - f.z, 2)) <= 90) AS adjacent FROM f),
r AS (SELECT *, CASE WHEN roof_type = 'unknown' THEN 'no_roof_model' WHEN w < 3 OR len / GREATEST(w, 1e-6) > 8 THEN 'thin_or_elongated' WHEN on_bridge THEN 'on_bridge' WHEN NOT (x BETWEEN 500 AND 9000 AND z BETWEEN 0 AND 9000) THEN 'outside_box' END AS reason FROM g)
SELECT CASE WHEN reason IS NULL THEN 'kept ' || CASE WHEN roof_type = 'flat' AND height < 4.5 AND area < 150 OR n_points < 12 THEN 'poor' WHEN adjacent OR n_points < 40 THEN 'fair' ELSE 'good' END ELSE reason END AS reason, COUNT(*) AS n FROM r GROUP BY 1"""


@query(_NEAR.format(_FOUND))
def missing_building_filter(spark, sf_dir):
    found = spark.sql(_FOUND, homes=table(spark, sf_dir, "homes"))
    bridges = table(spark, sf_dir, "nodes").where("node_id % 7 = 0").select(F.col("x").alias("x2"), F.col("z").alias("z2"))
    others = table(spark, sf_dir, "boxes").select(F.col("x0").alias("x2"), F.col("z0").alias("z2"))
    kept, dropped = O.missing_buildings(found, bridges, others, 3.0, 8.0, (500.0, 0.0, 9000.0, 9000.0), 60.0, 90.0)
    return kept.groupBy(F.concat(F.lit("kept "), "quality").alias("reason")).agg(F.count("*").alias("n")).union(dropped)


@query("SELECT 2e0 AS dr, -1e0 AS dc, LEAST(5, COUNT(*)) AS samples FROM (SELECT DISTINCT CAST(FLOOR(x / 40) AS BIGINT), CAST(FLOOR(y / 40) AS BIGINT) FROM {points}) t")
def registration_median(spark, sf_dir):
    """A mask that lies 2 rows before and 1 column behind the footprints is found to."""
    marks = table(spark, sf_dir, "points").where("z > 25").select(F.floor("x").alias("row"), F.floor("y").alias("col")).distinct()
    moved = marks.select((F.col("row") - 2).alias("row"), (F.col("col") + 1).alias("col"))
    return O.registration(moved, marks, 40, 5, 3)


@query("SELECT p_partkey, p_brand FROM {part} UNION ALL SELECT p_partkey, p_brand FROM {part} WHERE p_partkey % 2 = 0")
def cached_extract(spark, sf_dir):
    """The first read fills the cache, the second comes from it; another key reads anew."""
    folder = f"{scans.shared_folder(spark)}/extracts"
    source = f"{sf_dir}/part.parquet"
    read = lambda where: spark.read.parquet(source).where(where).select("p_partkey", "p_brand")
    key = {"path": source, "columns": ["p_partkey", "p_brand"]}
    scans.cached_extract(spark, folder, key | {"rows": "all"}, lambda: read("true"))
    again = scans.cached_extract(spark, folder, key | {"rows": "all"}, lambda: read("false"))
    return again.union(scans.cached_extract(spark, folder, key | {"rows": "even"}, lambda: read("p_partkey % 2 = 0")))
