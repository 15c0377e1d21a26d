"""Queries over the report operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmill.operators import report as R
from gridmill.plans.views import table
from gridmill.registry import query

_SUMMARY = "COALESCE(ROUND(QUANTILE_CONT({v}, 0.5), 3), 0) AS {n}_median, COALESCE(ROUND(QUANTILE_CONT({v}, 0.1), 3), 0) AS {n}_p10, COALESCE(ROUND(QUANTILE_CONT({v}, 0.9), 3), 0) AS {n}_p90"


def _summary(v: str, n: str) -> str:
    return _SUMMARY.format(v=v, n=n)


@query(f"SELECT seed, {_summary('base_min', 'base_min')} FROM {{seed_person}} GROUP BY seed")
def median_p10_p90(spark, sf_dir):
    return R.median_p10_p90(table(spark, sf_dir, "seed_person"), "base_min", ["seed"])


def _sides(spark, sf_dir):
    rows = table(spark, sf_dir, "seed_person")
    return [rows.select("seed", "person_id", F.col(c).alias("minutes")) for c in ("base_min", "plan_min")]


@query("SELECT seed, person_id, ROUND(plan_min - base_min, 6) AS delta FROM {seed_person}")
def paired_seed_join(spark, sf_dir):
    pairs = R.paired(*_sides(spark, sf_dir), ["seed", "person_id"])
    return pairs.select("seed", "person_id", F.round(F.col("plan.minutes") - F.col("base.minutes"), 6).alias("delta"))


@query("SELECT seed, COUNT(*) AS persons, ROUND(AVG(base_min), 6) AS mean_base, ROUND(AVG(plan_min), 6) AS mean_plan, MAX(base_min) AS max_base, COUNT(*) FILTER (WHERE plan_min > 2.4e1) AS n_late FROM {seed_person} GROUP BY seed")
def seed_metrics(spark, sf_dir):
    return table(spark, sf_dir, "seed_person").groupBy("seed").agg(F.count("*").alias("persons"), F.round(F.avg("base_min"), 6).alias("mean_base"), F.round(F.avg("plan_min"), 6).alias("mean_plan"), F.max("base_min").alias("max_base"), F.count_if(F.col("plan_min") > 24).alias("n_late"))


@query(f"""
WITH m AS (SELECT seed, AVG(base_min) AS b, AVG(plan_min) AS p FROM {{seed_person}} GROUP BY seed)
SELECT 'mean_minutes' AS metric, {_summary('b', 'base')}, {_summary('p', 'plan')}, {_summary('p - b', 'delta')} FROM m""")
def paired_delta_summary(spark, sf_dir):
    base, plan = (s.groupBy("seed").agg(F.avg("minutes").alias("mean_minutes")) for s in _sides(spark, sf_dir))
    return R.delta_summary(R.paired(base, plan, ["seed"]), ["mean_minutes"], [])


@query("""
WITH q AS (SELECT person_id, QUANTILE_CONT(plan_min - base_min, 0.5) AS med, QUANTILE_CONT(plan_min - base_min, 0.1) AS p10, QUANTILE_CONT(plan_min - base_min, 0.9) AS p90 FROM {seed_person} GROUP BY person_id)
SELECT COUNT(*) AS persons, COUNT(*) FILTER (WHERE med <= -1.3) AS winners, COUNT(*) FILTER (WHERE p90 <= -1.3) AS winners_low, COUNT(*) FILTER (WHERE p10 <= -1.3) AS winners_high,
 COUNT(*) FILTER (WHERE med >= 1.3) AS losers, COUNT(*) FILTER (WHERE p10 >= 1.3) AS losers_low, COUNT(*) FILTER (WHERE p90 >= 1.3) AS losers_high FROM q""")
def winners_losers(spark, sf_dir):
    return R.winners_losers(R.person_changes(*_sides(spark, sf_dir), "minutes"), 1.3)


_MODES = ["drive_alone", "walk", "bike", "carpool"]


@query(f"""
WITH c AS (SELECT variant, seed, COUNT(*) AS n, {', '.join(f"COUNT(*) FILTER (WHERE mode = '{m}') AS {m}" for m in _MODES)} FROM {{seed_mode}} GROUP BY variant, seed),
l AS ({' UNION ALL '.join(f"SELECT variant, seed, '{m}' AS mode, {m} * 1e2 / n AS pct FROM c" for m in _MODES)})
SELECT variant, mode, {_summary('pct', 'pct')} FROM l GROUP BY variant, mode""")
def mode_share(spark, sf_dir):
    return R.median_p10_p90(R.mode_share(table(spark, sf_dir, "seed_mode"), _MODES, ["variant", "seed"]), "pct", ["variant", "mode"])


_FIELDS = {"wait_min": "wait_min", "spill_m": "spill_m", "queue_cars": "spill_m / 7e0", "late_min": "wait_min * 3e-1", "turned_away": "spill_m % 5 * 1e0"}


def _field(side):
    """A field by its name m.metric, of the rows named side."""
    cases = [f"WHEN '{k}' THEN " + e.replace("wait_min", f"{side}.wait_min").replace("spill_m", f"{side}.spill_m") for k, e in _FIELDS.items()]
    return f"CASE m.metric {' '.join(cases)} END"


_NAMES = ", ".join(f"('{k}')" for k in _FIELDS)


@query(f"SELECT entrance, metric, {_summary('b', 'base')}, {_summary('p', 'plan')}, {_summary('p - b', 'delta')} FROM (SELECT b.entrance, b.seed, m.metric, {_field('b')} AS b, {_field('p')} AS p FROM {{seed_school}} b JOIN {{seed_school}} p ON b.seed = p.seed AND b.entrance = p.entrance AND b.variant = 'baseline' AND p.variant = 'plan' CROSS JOIN (VALUES {_NAMES}) AS m(metric)) t GROUP BY entrance, metric")
def per_school_block(spark, sf_dir):
    """Five fields of each entrance."""
    rows = table(spark, sf_dir, "seed_school").withColumns({k: F.expr(e) for k, e in _FIELDS.items() if k not in ("wait_min", "spill_m")})
    side = lambda v: rows.where(F.col("variant") == v).drop("variant")
    return R.delta_summary(R.paired(side("baseline"), side("plan"), ["seed", "entrance"], strict=False), list(_FIELDS), ["entrance"])


_PEAKS = "SELECT seed, variant, edge_idx, MAX(vc) AS max_vc, ARG_MIN(bin, -vc * 1e3 + bin / 1e2) AS max_bin FROM {seed_edge_bin} WHERE bin BETWEEN 6 AND 41 GROUP BY seed, variant, edge_idx"


def _peaks(spark, sf_dir):
    return R.edge_peak(table(spark, sf_dir, "seed_edge_bin"), ["seed", "variant", "edge_idx"], 6, 41)


@query(_PEAKS)
def edge_peak(spark, sf_dir):
    return _peaks(spark, sf_dir)


@query("SELECT seed, variant, edge_idx, bin, vc FROM {seed_edge_bin} WHERE bin BETWEEN 6 AND 41")
def report_bins(spark, sf_dir):
    return table(spark, sf_dir, "seed_edge_bin").where(F.col("bin").between(6, 41))


@query(f"""
WITH k AS ({_PEAKS}), m AS (SELECT edge_idx, MEDIAN(max_vc) FILTER (WHERE variant = 'baseline') AS b, MEDIAN(max_vc) FILTER (WHERE variant = 'plan') AS p FROM k GROUP BY edge_idx),
n AS (SELECT edge_idx, max_bin, COUNT(*) AS c FROM k WHERE variant = 'plan' GROUP BY edge_idx, max_bin),
t AS (SELECT edge_idx, max_bin AS peak_bin FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY edge_idx ORDER BY c DESC, max_bin) AS r FROM n) WHERE r = 1)
SELECT edge_idx, ROUND(b, 6) AS base_vc, ROUND(p, 6) AS plan_vc, ROUND(p - b, 6) AS rise, peak_bin FROM m JOIN t USING (edge_idx) WHERE b < (SELECT MEDIAN(max_vc) FROM k) AND p >= (SELECT MEDIAN(max_vc) FROM k) ORDER BY rise DESC, edge_idx LIMIT 25""")
def side_effects(spark, sf_dir):
    """Edges that cross the median peak of all, a limit that fits any scale of the table."""
    peaks = _peaks(spark, sf_dir)
    limit = peaks.agg(F.percentile("max_vc", F.lit(0.5))).first()[0]
    return R.side_effects(peaks, limit, 25)


@query("SELECT edge_idx, ROUND(MEDIAN(max_vc), 6) AS median_vc FROM (" + _PEAKS + ") t GROUP BY edge_idx ORDER BY median_vc DESC, edge_idx LIMIT 10")
def ranked_worst_list(spark, sf_dir):
    worst = _peaks(spark, sf_dir).groupBy("edge_idx").agg(F.round(F.percentile("max_vc", F.lit(0.5)), 6).alias("median_vc"))
    return worst.orderBy(F.desc("median_vc"), "edge_idx").limit(10)


@query("SELECT CAST(FLOOR(enter_s / 300.0) AS BIGINT) AS bin, edge_idx, ROUND(SUM(1e0) * 3600 / 300, 6) AS veh_h FROM {trajectory} WHERE enter_s >= 0 AND enter_s < 7200 GROUP BY 1, 2")
def link_volume(spark, sf_dir):
    return R.link_volume(table(spark, sf_dir, "trajectory"), 300, 0, 7200).withColumn("veh_h", F.round("veh_h", 6))


@query("SELECT 'edge' AS place, edge_idx AS id, ROUND(SUM(1e0 * GREATEST(LEAST(enter_s + dwell_s, 1800) - GREATEST(enter_s, 300), 0)) / 3600, 6) AS vht FROM {trajectory} GROUP BY 2 UNION ALL SELECT 'curb', entrance, ROUND(SUM(w * GREATEST(LEAST(arr_s + 240, 32400) - GREATEST(arr_s, 25200), 0)) / 3600, 6) FROM {curb_arrivals} GROUP BY entrance")
def vehicle_hours(spark, sf_dir):
    """Hours on each edge, and in each entrance's curb line."""
    rows, cars = table(spark, sf_dir, "trajectory"), table(spark, sf_dir, "curb_arrivals")
    road = rows.groupBy(F.lit("edge").alias("place"), F.col("edge_idx").alias("id")).agg(F.round(R.overlap_hours(F.col("enter_s"), F.col("enter_s") + F.col("dwell_s"), 300, 1800, F.lit(1.0)), 6).alias("vht"))
    curb = cars.groupBy(F.lit("curb").alias("place"), F.col("entrance").alias("id")).agg(F.round(R.overlap_hours(F.col("arr_s"), F.col("arr_s") + 240, 25200, 32400, F.col("w")), 6).alias("vht"))
    return road.union(curb)


@query("SELECT n.node_id, COALESCE(MAX(e.length_m), 0e0) AS node_length_m FROM {nodes} n LEFT JOIN {edges} e ON n.node_id = e.u OR n.node_id = e.v GROUP BY n.node_id")
def node_max(spark, sf_dir):
    return R.node_max(table(spark, sf_dir, "edges").withColumn("length_m", F.col("length_m").cast("double")), table(spark, sf_dir, "nodes"), "length_m")


_DELTAS = "SELECT seed, person_id, plan_min - base_min AS commute, CASE WHEN person_id % 3 = 0 THEN plan_min * 5e-1 - base_min END AS dropoff, CASE WHEN seed % 2 = 0 AND person_id % 4 = 1 THEN base_min - plan_min * 8e-1 END AS kid_trip FROM {seed_person}"
_HOME_VC = "SELECT seed, variant, edge_idx % 50 AS node_id, MAX(vc) AS max_vc FROM {seed_edge_bin} GROUP BY 1, 2, 3"
_FIRST_MODE = "SELECT person_id, variant, MIN(mode) AS mode FROM {seed_mode} WHERE seed = 1 GROUP BY 1, 2"


@query(f"""
WITH d AS (SELECT person_id, MEDIAN(commute) AS c, MEDIAN(dropoff) AS o, MEDIAN(kid_trip) AS k FROM ({_DELTAS}) t GROUP BY 1), v AS ({_HOME_VC}), m AS ({_FIRST_MODE}),
s AS (SELECT b.node_id, MEDIAN(p.max_vc - b.max_vc) AS v FROM v b JOIN v p ON p.seed = b.seed AND p.node_id = b.node_id AND b.variant = 'baseline' AND p.variant = 'plan' GROUP BY 1)
SELECT d.person_id, ROUND(c, 6) AS commute_delta_min, ROUND(o, 6) AS dropoff_delta_min, ROUND(k, 6) AS kid_trip_delta_min, b.mode AS mode_baseline, p.mode AS mode_plan, ROUND(s.v, 6) AS home_edges_vc_delta
FROM d LEFT JOIN m b ON b.person_id = d.person_id AND b.variant = 'baseline' LEFT JOIN m p ON p.person_id = d.person_id AND p.variant = 'plan' LEFT JOIN s ON s.node_id = d.person_id % 60""")
def person_deltas(spark, sf_dir):
    """Three deltas of each person, modes of the first seed, and what changes on the streets at home."""
    view = lambda sql, name: spark.sql(sql, **{name: table(spark, sf_dir, name)})
    homes = table(spark, sf_dir, "seed_person").select("person_id", (F.col("person_id") % 60).alias("node_id")).distinct()
    out = R.person_deltas(view(_DELTAS, "seed_person"), ["commute", "dropoff", "kid_trip"], view(_FIRST_MODE, "seed_mode"), homes, view(_HOME_VC, "seed_edge_bin"))
    return out.select("person_id", *[F.round(c, 6).alias(f"{c}_delta_min") for c in ("commute", "dropoff", "kid_trip")], "mode_baseline", "mode_plan", F.round("home_edges_vc_delta", 6).alias("home_edges_vc_delta"))


_TRIPS = "SELECT trip, CAST(FLOOR(MIN(enter_s) / 300.0) AS BIGINT) + trip % 30 AS depart_bin, CAST(FLOOR(MAX(enter_s + dwell_s) / 300.0) AS BIGINT) + trip % 30 AS arrive_bin, 1e0 AS w FROM {trajectory} GROUP BY trip"


def _trips(spark, sf_dir):
    return spark.sql(_TRIPS, trajectory=table(spark, sf_dir, "trajectory"))


@query(f"""
WITH t AS ({_TRIPS}), s AS (SELECT depart_bin AS bin, w AS d FROM t UNION ALL SELECT arrive_bin + 1, -w FROM t)
SELECT bin, SUM(COALESCE(d, 0)) OVER (ORDER BY bin) AS on_road FROM (SELECT UNNEST(RANGE(48)) AS bin) b LEFT JOIN (SELECT bin, SUM(d) AS d FROM s GROUP BY bin) g USING (bin)""")
def on_road_histogram(spark, sf_dir):
    return R.on_road(_trips(spark, sf_dir), 48)


_HIST = "SELECT bin, SUM(n) AS n FROM (SELECT CAST(FLOOR((arr_s % 14400) / 300.0) AS BIGINT) AS bin, w AS n FROM {curb_arrivals}) t GROUP BY bin"


@query(f"""
WITH h AS ({_HIST}), r AS (SELECT bin, SUM(n) OVER w AS total, COUNT(*) OVER w AS size, MAX(bin) OVER w AS last_bin FROM h WINDOW w AS (ORDER BY bin ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING))
SELECT bin AS first_bin, last_bin, ROUND(total, 6) AS total FROM r WHERE size = 12 ORDER BY ROUND(total, 6) DESC, bin LIMIT 1""")
def peak_window(spark, sf_dir):
    hist = spark.sql(_HIST, curb_arrivals=table(spark, sf_dir, "curb_arrivals")).withColumn("n", F.col("n").cast("decimal(18,1)"))
    return R.peak_window(hist, 12).withColumn("total", F.round(F.col("total").cast("double"), 6))


@query(f"WITH h AS ({_HIST}) SELECT ROUND(COALESCE(SUM(n) FILTER (WHERE bin BETWEEN 12 AND 23) / SUM(n), 0), 6) AS share FROM h")
def peak_overlap(spark, sf_dir):
    hist = spark.sql(_HIST, curb_arrivals=table(spark, sf_dir, "curb_arrivals"))
    return hist.agg(F.round(F.coalesce(F.sum(F.when(F.col("bin").between(12, 23), F.col("n"))) / F.sum("n"), F.lit(0.0)), 6).alias("share"))
