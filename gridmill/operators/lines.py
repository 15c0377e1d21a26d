"""Lines, tours and map segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridmill.operators.tables import stable_ids


def split_at_connectors(segments: DataFrame) -> DataFrame:
    """Pieces between consecutive different connectors. segments: segment_id, length_m, connectors array<struct(at, id)>."""
    pairs = F.array_sort("connectors")
    zipped = F.transform(F.sequence(F.lit(1), F.size(pairs) - 1), lambda i: F.struct(F.element_at(pairs, i).alias("a"), F.element_at(pairs, i + 1).alias("b")))
    rows = segments.where(F.size("connectors") >= 2).select("segment_id", "length_m", F.explode(zipped).alias("p"))
    return rows.where("p.b.at > p.a.at and p.a.id <> p.b.id").select("segment_id", F.col("p.a.id").alias("from_id"), F.col("p.b.id").alias("to_id"), ((F.col("p.b.at") - F.col("p.a.at")) * F.col("length_m")).alias("piece_m"))


def graph_from_connectors(pieces: DataFrame, both_ways: Column) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): node numbers by the order of connector ids, and an edge for each allowed direction."""
    ids = pieces.select(F.explode(F.array("from_id", "to_id")).alias("connector")).distinct()
    nodes = stable_ids(ids, ["connector"], "node_id")
    number = lambda c, name: nodes.select(F.col("connector").alias(c), F.col("node_id").alias(name))
    found = pieces.withColumn("both", both_ways).join(number("from_id", "u"), "from_id").join(number("to_id", "v"), "to_id")
    edges = found.select("segment_id", "u", "v", "piece_m").union(found.where("both").select("segment_id", F.col("v"), F.col("u"), "piece_m"))
    return nodes, edges


def along(points: DataFrame, key: str, fractions: list[float]) -> DataFrame:
    """Point and heading at fractions of each polyline. points: key, step, x, z; polylines without length are left out."""
    order = W.partitionBy(key).orderBy("step")
    seg = points.select(key, "step", F.col("x").alias("x0"), F.col("z").alias("z0"), F.lead("x").over(order).alias("x1"), F.lead("z").over(order).alias("z1")).where("x1 is not null")
    seg = seg.withColumn("d", F.hypot(F.col("x1") - F.col("x0"), F.col("z1") - F.col("z0")))
    seg = seg.withColumn("end_m", F.sum("d").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("total", F.sum("d").over(W.partitionBy(key))).where("d > 0")
    want = seg.withColumn("f", F.explode(F.array(*[F.lit(float(f)) for f in fractions]))).withColumn("at", F.col("f") * F.col("total"))
    hit = want.where((F.col("at") > F.col("end_m") - F.col("d")) & (F.col("at") <= F.col("end_m")))
    t = (F.col("at") - F.col("end_m") + F.col("d")) / F.col("d")
    return hit.select(key, "f", (F.col("x0") + t * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("z0") + t * (F.col("z1") - F.col("z0"))).alias("z"), F.pmod(F.degrees(F.atan2(F.col("x1") - F.col("x0"), F.col("z0") - F.col("z1"))), F.lit(360.0)).alias("heading"))


def densified(points: DataFrame, key: str, most: float) -> DataFrame:
    """Polylines with points added so that no step is longer than most: key, step, part, x, z. points: key, step, x, z."""
    order = W.partitionBy(key).orderBy("step")
    seg = points.select(key, "step", "x", "z", F.lead("x").over(order).alias("x1"), F.lead("z").over(order).alias("z1"))
    n = F.greatest(F.ceil(F.coalesce(F.hypot(F.col("x1") - F.col("x"), F.col("z1") - F.col("z")), F.lit(0.0)) / most), F.lit(1)).cast("int")
    cut = seg.withColumn("n", n).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = F.col("part") / F.col("n")
    mid = lambda a, b: F.col(a) + F.coalesce(t * (F.col(b) - F.col(a)), F.lit(0.0))
    return cut.select(key, "step", "part", mid("x", "x1").alias("x"), mid("z", "z1").alias("z"))


def every(points: DataFrame, key: str, spacing: float, offset: float) -> DataFrame:
    """Points along each polyline, a spacing apart from half a one on, `offset` metres to the right (left if negative): key, n, x, z."""
    order = W.partitionBy(key).orderBy("step")
    seg = points.select(key, "step", F.col("x").alias("x0"), F.col("z").alias("z0"), F.lead("x").over(order).alias("x1"), F.lead("z").over(order).alias("z1")).where("x1 is not null")
    seg = seg.withColumn("d", F.hypot(F.col("x1") - F.col("x0"), F.col("z1") - F.col("z0"))).withColumn("end_m", F.sum("d").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).where("d > 0")
    first = F.ceil(F.round((F.col("end_m") - F.col("d")) / spacing - 0.5, 9)).cast("int")
    last = F.ceil(F.round(F.col("end_m") / spacing - 0.5, 9)).cast("int") - 1
    hit = seg.withColumn("first", first).withColumn("last", last).where("first <= last").withColumn("n", F.explode(F.sequence("first", "last")))
    t = ((F.col("n") + 0.5) * spacing - F.col("end_m") + F.col("d")) / F.col("d")
    dx, dz = F.col("x1") - F.col("x0"), F.col("z1") - F.col("z0")
    return hit.select(key, "n", (F.col("x0") + t * dx - dz / F.col("d") * offset).alias("x"), (F.col("z0") + t * dz + dx / F.col("d") * offset).alias("z"))


def clip_share(x0: Column, z0: Column, x1: Column, z1: Column, box: tuple[float, float, float, float]) -> Column:
    """Share of a segment inside a rectangle (x0, z0, x1, z1), by Liang and Barsky."""
    lo, hi = F.lit(0.0), F.lit(1.0)
    for p, q in ((x0 - x1, x0 - box[0]), (x1 - x0, box[2] - x0), (z0 - z1, z0 - box[1]), (z1 - z0, box[3] - z0)):
        r = q / F.nullif(p, F.lit(0.0))
        lo = F.when((p == 0) & (q < 0), F.lit(2.0)).when(p < 0, F.greatest(lo, r)).otherwise(lo)
        hi = F.when(p > 0, F.least(hi, r)).otherwise(hi)
    return F.greatest(hi - lo, F.lit(0.0))


def traverse(trips: DataFrame, bin_s: int, bins: int) -> DataFrame:
    """Enter and exit time of every edge of a path, each taking the time of the bin in which it is entered.

    trips: trip, depart_s, path array<struct(edge_idx, times array<double>)> with
    a time for each bin.
    """
    start = F.struct(F.col("depart_s").cast("double").alias("t"), F.array().cast("array<struct<edge_idx:bigint,enter_s:double,exit_s:double>>").alias("seen"))

    def step(s, e):
        b = F.least(F.greatest(F.floor(s["t"] / bin_s), F.lit(0)), F.lit(bins - 1)).cast("int")
        out = s["t"] + F.element_at(e["times"], b + 1)
        return F.struct(out.alias("t"), F.concat(s["seen"], F.array(F.struct(e["edge_idx"].alias("edge_idx"), s["t"].alias("enter_s"), out.alias("exit_s")))).alias("seen"))

    return trips.select("trip", F.explode(F.aggregate("path", start, step)["seen"]).alias("e")).select("trip", "e.*")


def greedy_tour(routes: DataFrame, circuity: float = 1.0) -> DataFrame:
    """Stops of each route in order: farthest from the school first, then the nearest one left; ride_km is each stop's way to the school along the tour.

    routes: route, x, z, stops array<struct(id, x, z)>. Distances that agree to
    six digits are ties, which go by id.
    """
    kind = routes.schema["route"].dataType.simpleString()

    def walk(x: float, z: float, stops: list[dict]) -> tuple[list[int], list[float]]:
        """Each step looks once at the stops that are left, which lie in arrays by id."""
        stops = sorted(stops, key=lambda s: s["id"])
        ids = np.array([s["id"] for s in stops], dtype=np.int64)
        xs, zs = (np.array([s[c] for s in stops], dtype=float) for c in ("x", "z"))
        d = np.round(np.hypot(xs - x, zs - z), 6)
        at = int(np.argmax(d))  # the first of equals, that is the least id
        order = []
        left = np.arange(len(ids))
        while True:
            order.append(at)
            left = left[left != at]
            if not len(left):
                break
            at = int(left[np.argmin(np.round(np.hypot(xs[left] - xs[at], zs[left] - zs[at]), 6))])
        xs, zs = np.append(xs[order], x), np.append(zs[order], z)
        legs = np.hypot(np.diff(xs), np.diff(zs)) * circuity / 1000
        return ids[order].tolist(), np.cumsum(legs[::-1])[::-1].tolist()

    def tours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                _, x, z, stops = (c[0].as_py() for c in row.columns)
                tour, km = walk(x, z, stops)
                yield pa.RecordBatch.from_arrays([row.column(0), pa.array([tour], pa.list_(pa.int64())), pa.array([km], pa.list_(pa.float64()))], ["route", "tour", "ride_km"])

    rows = routes.where(F.size("stops") > 0).select("route", F.col("x").cast("double").alias("x"), F.col("z").cast("double").alias("z"), "stops")
    return rows.mapInArrow(tours, f"route {kind}, tour array<bigint>, ride_km array<double>")


def nearest_two(trees: DataFrame, buildings: DataFrame, roads: DataFrame, key: str) -> DataFrame:
    """Distance of each tree to the nearest building within 250 m and road point within 60 m; infinity without one. buildings, roads: x2, z2."""
    from gridmill.operators.spatial import within

    out = trees.select(key)
    for name, other, reach in (("building_m", buildings, 250.0), ("road_m", roads, 60.0)):
        hit = within(trees.select(key, "x", "z"), other.select("x2", "z2"), reach).groupBy(key).agg(F.min("d").alias(name))
        out = out.join(hit, key, "left").withColumn(name, F.coalesce(name, F.lit(float("inf"))))
    return out


def covered_share(samples: DataFrame, roads: DataFrame, key: str, reach: float) -> DataFrame:
    """Share of each line's sample points within reach of a road; missing when half or less. Sampled, so approximate between points."""
    from gridmill.operators.spatial import within

    numbered = samples.select(key, "step", "x", "z")
    near = within(numbered, roads.select("x2", "z2"), reach).select(key, "step").distinct().withColumn("near", F.lit(1))
    share = numbered.join(near, [key, "step"], "left").groupBy(key).agg(F.avg(F.coalesce("near", F.lit(0))).alias("covered"))
    return share.withColumn("missing", F.col("covered") <= 0.5)


def polar(rows: DataFrame, key: str, value: str, k: int, school: str | None = None, least: int = 3) -> DataFrame:
    """The k lowest and k highest (at most half each), ties by key; with `school`, such that at least `least` schools speak if there are as many.

    While too few do, the least extreme of a side whose school others speak for
    too makes room for the most extreme of the rest who brings a new one. At
    most 2 k rows are chosen, so the swaps are made on the driver.
    """
    n = rows.count()
    k = min(k, n // 2)
    low = rows.orderBy(value, key).limit(k).withColumn("side", F.lit("low"))
    both = low.union(rows.orderBy(F.desc(value), key).limit(k).withColumn("side", F.lit("high")))
    if school is None:
        return both
    chosen = both.collect()
    rest = rows.join(both.select(key), key, "left_anti")
    target = min(least, rows.select(school).where(F.col(school).isNotNull()).distinct().limit(least).count())
    taken: set = set()
    while len({r[school] for r in chosen} - {None}) < target:
        have = {r[school] for r in chosen} - {None}
        for side, order in (("low", F.col(value)), ("high", F.desc(value))):
            new = rest.where(F.col(school).isNotNull() & ~F.col(school).isin(list(have)) & ~F.col(key).isin(list(taken)))
            found = new.orderBy(order, key).limit(1).collect()
            spare = [i for i, r in enumerate(chosen) if r.side == side and sum(c[school] == r[school] for c in chosen) > 1]
            if found and spare:
                i = max(spare, key=lambda i: (chosen[i][value] if side == "low" else -chosen[i][value], chosen[i][key]))
                taken.add(found[0][key])
                chosen[i] = Row(**found[0].asDict(), side=side)
                break
        else:
            break
    return rows.sparkSession.createDataFrame([tuple(r) for r in chosen], both.schema)


def checked_tools(plans: DataFrame, known: DataFrame) -> DataFrame:
    """First error of each tool of a plan, and labels numbered where a tool repeats. plans: plan_id, tools array<struct(tool, amount)>; known: tool, lo, hi, once."""
    t = plans.select("plan_id", F.posexplode("tools").alias("pos", "t")).select("plan_id", "pos", "t.tool", "t.amount")
    t = t.withColumn("nth", F.row_number().over(W.partitionBy("plan_id", "tool").orderBy("pos")))
    met = t.join(F.broadcast(known), "tool", "left")
    error = F.when(F.col("lo").isNull(), "unknown tool").when(F.col("once") & (F.col("nth") > 1), "repeated").when(F.col("amount").isNull(), "no amount").when(~F.col("amount").between(F.col("lo"), F.col("hi")), "out of range")
    label = F.concat("tool", F.when(F.col("nth") > 1, F.concat(F.lit(" "), F.col("nth").cast("string"))).otherwise(""))
    return met.select("plan_id", "pos", label.alias("label"), error.alias("error"))


def flat_leaves(rows: DataFrame, used: DataFrame) -> DataFrame:
    """Parameters of used sections that nobody has verified. rows: path, verified; used: section."""
    return rows.withColumn("section", F.substring_index("path", ".", 1)).join(used, "section", "left_semi").where("not verified").drop("section")
