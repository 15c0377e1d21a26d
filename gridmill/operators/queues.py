"""Curb queues and trip chains."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridmill.operators.tables import running_sum


def fluid_queue(arrivals: DataFrame, by: list[str], order: list[str], arrive: str, service: Column, stretch_s: float = 3600) -> DataFrame:
    """Start, wait and end of service of every arrival at a queue served in order.

    With S the running sum of service times, service ends at S plus the running
    maximum of (arrival - S before me): the recursion end = max(end before me,
    arrival) + service in closed form. `order` must be a total order.
    """
    first = W.unboundedPreceding
    rows = arrivals.withColumn("service", service.cast("double"))
    if order[0] != arrive:
        raise ValueError(f"the order must begin with {arrive}")
    # two levels, so that a long queue is spread: inside stretches of time, then over the stretches
    rows = rows.withColumn("__part", F.floor(F.col(arrive) / stretch_s))
    inside = W.partitionBy(*by, "__part").orderBy(*order).rowsBetween(first, W.currentRow)
    rows = rows.withColumn("__served", F.sum("service").over(inside))
    rows = rows.withColumn("__late", F.max(F.col(arrive) - (F.col("__served") - F.col("service"))).over(inside))
    parts = rows.groupBy(*by, "__part").agg(F.sum("service").alias("__sum"), F.max("__late").alias("__most"))
    over = W.partitionBy(*by).orderBy("__part")
    parts = parts.withColumn("__base", F.sum("__sum").over(over) - F.col("__sum"))
    parts = parts.withColumn("__held", F.max(F.col("__most") - F.col("__base")).over(over.rowsBetween(first, -1))).select(*by, "__part", "__base", "__held")
    rows = rows.join(parts, [*by, "__part"])
    done = F.col("__base") + F.col("__served") + F.greatest(F.col("__late") - F.col("__base"), F.col("__held"))
    rows = rows.withColumn("done", done).withColumn("begin", F.col("done") - F.col("service"))
    return rows.withColumn("wait", F.greatest(F.col("begin") - F.col(arrive), F.lit(0.0))).drop("__part", "__served", "__late", "__base", "__held")


def queue_at_arrival(queued: DataFrame, by: list[str], key: str, arrive: str, weight: str) -> DataFrame:
    """Weighted vehicles waiting when each arrives, itself included: arrivals so far minus services begun by then."""
    moves = F.array(F.struct(F.col(arrive).cast("double").alias("t"), F.lit(1).alias("kind"), F.col(weight).alias("d")), F.struct(F.col("begin").alias("t"), F.lit(0).alias("kind"), (-F.col(weight)).alias("d")))
    events = queued.select(*by, key, F.explode(moves).alias("m")).select(*by, key, "m.*")
    # a service begun at my own arrival is mine or an earlier one's, and comes off first
    return running_sum(events, by, ["t", "kind", key], F.col("d"), "queue").where("kind = 1").select(*by, key, "queue")


def queue_bins(queued: DataFrame, by: list[str], arrive: str, bin_s: int, bins: int, weight: str, spots: int, car_m: float) -> DataFrame:
    """Each bin 0..bins-1 of each queue: arrivals, mean and largest wait (null without arrivals), cars waiting at its end, and the metres they reach past the spots.

    Waiting at a bin's end are the weights that arrived before it less those whose service began before it.
    """
    at = lambda c: F.floor(F.col(c) / bin_s).cast("long")
    moves = F.array(F.struct(at(arrive).alias("bin"), F.col(weight).alias("d")), F.struct(at("begin").alias("bin"), (-F.col(weight)).alias("d")))
    steps = queued.select(*by, F.explode(moves).alias("m")).groupBy(*by, "m.bin").agg(F.sum("m.d").alias("d"))
    grid = queued.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumn("bin", F.col("bin").cast("long"))
    so_far = W.partitionBy(*by).orderBy("bin")  # at most `bins` rows
    dense = grid.join(steps, [*by, "bin"], "left").withColumn("waiting", F.round(F.sum(F.coalesce("d", F.lit(0.0))).over(so_far), 6)).drop("d")
    stats = _waits(queued, by, arrive, bin_s)
    spill = F.greatest(F.col("waiting") - spots, F.lit(0.0)) * car_m
    return dense.withColumn("spill_m", spill).join(stats, [*by, "bin"], "left").withColumn("arrivals", F.coalesce("arrivals", F.lit(0)))


def _waits(queued: DataFrame, by: list[str], arrive: str, bin_s: int) -> DataFrame:
    return queued.groupBy(*by, F.floor(F.col(arrive) / bin_s).cast("long").alias("bin")).agg(F.count("*").alias("arrivals"), F.avg("wait").alias("mean_wait"), F.max("wait").alias("max_wait"))


def queue_with_balking(arrivals: DataFrame, by: list[str], arrive: str, service: str, patience: str, order: list[str]) -> DataFrame:
    """Waits at a queue that arrivals leave at once when the wait would exceed their patience.

    A departure changes every later wait, so this runs in order within each
    queue. Queues stream through a task in sorted order; the state is one
    number, so a long queue needs no more memory than a short one.
    Adds wait (null for those who leave) and balked.
    """
    keys = [c for c in arrivals.columns if c in by]
    out = arrivals.select(*keys, *[c for c in arrivals.columns if c not in by]).repartition(*by).sortWithinPartitions(*by, *order)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema) + ", wait double, balked boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queue, free = None, 0.0
        for batch in batches:
            waits, left = [], []
            for key, at, s, limit in zip(batch[keys].itertuples(index=False, name=None), batch[arrive], batch[service], batch[patience]):
                if key != queue:
                    queue, free = key, float("-inf")
                wait = max(free - at, 0.0)
                left.append(wait > limit)
                waits.append(None if wait > limit else wait)
                if wait <= limit:
                    free = at + wait + s
            yield batch.assign(wait=pd.Series(waits, dtype="float64", index=batch.index), balked=left)

    return out.mapInPandas(run, schema)


def chain_stops(kids: DataFrame, size: int = 3) -> DataFrame:
    """Stops of each household's school run. kids: household_id, person_id, school_id, bell_s, leg_s (to the school).

    Schools in the order of their earliest bell, then id; `size` stops a chain;
    a stop's target is its earliest bell, and the time that the way there takes
    adds up along the chain.
    """
    stops = kids.groupBy("household_id", "school_id").agg(F.min("bell_s").alias("target_s"), F.count("*").alias("kids"), F.max("leg_s").alias("leg_s"))
    rank = F.row_number().over(W.partitionBy("household_id").orderBy("target_s", "school_id"))
    rows = stops.withColumn("r", rank).select("household_id", "school_id", "target_s", "kids", "leg_s", F.floor((F.col("r") - 1) / size).cast("long").alias("chain"), ((F.col("r") - 1) % size).cast("long").alias("stop"))
    return rows.withColumn("expected_s", F.sum("leg_s").over(W.partitionBy("household_id", "chain").orderBy("stop"))).drop("leg_s")


def even_runs(riders: DataFrame, by: list[str], order: list[str], capacity: int) -> DataFrame:
    """Riders in order, dealt evenly over as many runs as their number needs."""
    group = W.partitionBy(*by)
    i = F.row_number().over(group.orderBy(*order)) - 1
    n = F.count("*").over(group)
    return riders.withColumn("run", F.floor(i * F.ceil(n / capacity) / n).cast("long"))


def chain_experience(legs: DataFrame) -> DataFrame:
    """Delay of each leg: a leg leaves when the stop before is left; arrive - leave - free flow + wait, not below 0."""
    left = F.lag(F.col("enter_s") + F.col("dwell_s")).over(W.partitionBy("trip").orderBy("step"))
    return legs.withColumn("depart_s", F.coalesce(left, F.col("enter_s"))).withColumn("delay_s", F.greatest(F.col("enter_s") + F.col("dwell_s") - F.col("depart_s") - F.col("free_s"), F.lit(0)))


def assemble(points: DataFrame) -> DataFrame:
    """Per trip: its edges in order of step, their number, and where they start in a concatenation of all trips by id.

    The running offset goes over one row a trip, inside sampled range partitions
    of trips and then over one row a partition.
    """
    from gridmill.operators.choice import cumulated

    trips = points.groupBy("trip").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "edge_idx"))), lambda p: p["edge_idx"]).alias("edges"))
    trips = trips.select("trip", "edges", F.size("edges").cast("long").alias("n"))
    return cumulated(trips, "trip", "n").select("trip", "edges", "n", F.col("below").alias("offset"))


def position_at(trajectory: DataFrame, times: DataFrame, bucket_s: int = 300) -> DataFrame:
    """Edge of each trip at each time, and how far along it. A range join by time buckets."""
    spans = trajectory.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("enter_s") / bucket_s), F.floor((F.col("enter_s") + F.col("dwell_s")) / bucket_s))))
    at = times.withColumn("bucket", F.floor(F.col("t") / bucket_s))
    met = spans.join(at, "bucket").where((F.col("enter_s") <= F.col("t")) & (F.col("t") < F.col("enter_s") + F.col("dwell_s")))
    return met.select("t", "trip", "edge_idx", ((F.col("t") - F.col("enter_s")) / F.col("dwell_s")).alias("fraction"))


def bin_lookup(entries: DataFrame, values: DataFrame, bin_s: int, bins: int) -> DataFrame:
    """The value of (bin of entry, edge); bins past either end take the last one."""
    at = F.least(F.greatest(F.floor(F.col("enter_s") / bin_s), F.lit(0)), F.lit(bins - 1)).cast("long")
    return entries.withColumn("bin", at).join(values, ["bin", "edge_idx"])


def upstream_edges(edges: DataFrame) -> DataFrame:
    """Edges that end where an edge starts, its own U-turn excluded."""
    a, b = edges.select(F.col("edge_idx").alias("approach"), "u", "v"), edges.select(F.col("edge_idx").alias("upstream"), F.col("u").alias("u2"), F.col("v").alias("v2"))
    return a.join(b, a.u == b.v2).where("u2 <> v").select("approach", "upstream")


def with_closures(links: DataFrame, closures: DataFrame) -> DataFrame:
    """Closures [start_bin, end_bin) applied to (bin, edge) rows: capacity factors multiply, delays add."""
    hit = closures.select("edge_idx", F.explode(F.sequence(F.col("start_bin"), F.col("end_bin") - 1)).alias("bin"), "factor", "delay_s")
    hit = hit.groupBy("bin", "edge_idx").agg(F.product("factor").alias("factor"), F.sum("delay_s").alias("delay_s"))
    return links.join(hit, ["bin", "edge_idx"], "left").withColumn("factor", F.coalesce("factor", F.lit(1.0))).withColumn("delay_s", F.coalesce("delay_s", F.lit(0)))


def arrival_schedule(routes: DataFrame, lead_s: int, window_s: int) -> DataFrame:
    """Runs of a route that end at bell - lead, a headway apart, as many as fit the window (one at least)."""
    n = F.greatest(F.floor(F.lit(window_s) / F.col("headway_s")), F.lit(1)).cast("int")
    run = F.explode(F.sequence(F.lit(0), n - 1)).alias("run")
    return routes.select("*", run).withColumn("arrive_s", F.col("bell_s") - lead_s - F.col("run") * F.col("headway_s"))
