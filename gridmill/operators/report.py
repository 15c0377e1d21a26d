"""Report cards: seed-paired summaries, winners and losers, link and school figures.

NaN means "no value" and is treated as null. Percentiles interpolate linearly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def summary(value: Column, name: str, digits: int = 3, low: float = 0.1, high: float = 0.9) -> list[Column]:
    """Aggregates <name>_median, _p10 and _p90 over finite values; 0.0 where there are none."""
    found = F.percentile(finite(value), F.array(F.lit(0.5), F.lit(low), F.lit(high)))
    at = lambda i: F.coalesce(F.round(F.get(found, i), digits), F.lit(0.0))
    return [at(i).alias(f"{name}_{k}") for i, k in enumerate(("median", "p10", "p90"))]


def median_p10_p90(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Median, p10 and p90 of `value` in each group."""
    return df.groupBy(*by).agg(*summary(F.col(value), value))


def paired(base: DataFrame, plan: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """Baseline and plan rows of the same keys, as structs base and plan.

    strict: a key on one side alone is an error; else such keys are left out.
    """
    side = lambda df, name: df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))
    if not strict:
        return side(base, "base").join(side(plan, "plan"), keys)
    both = side(base, "base").join(side(plan, "plan"), keys, "full")
    lone = F.col("base").isNull() | F.col("plan").isNull()
    return both.withColumn("base", F.when(lone, F.raise_error(F.lit("a seed has no partner"))).otherwise(F.col("base")))


def delta_summary(pairs: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    """Per metric: summaries of baseline, plan and the per-seed difference. A row per group and metric."""
    long = pairs.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"base.{m}").cast("double").alias("b"), F.col(f"plan.{m}").cast("double").alias("p")) for m in metrics])).alias("r"))
    long = long.select(*by, "r.*")
    return long.groupBy(*by, "metric").agg(*summary(F.col("b"), "base"), *summary(F.col("p"), "plan"), *summary(F.col("p") - F.col("b"), "delta"))


def person_changes(base: DataFrame, plan: DataFrame, value: str) -> DataFrame:
    """seed, person_id, change; a side that is missing counts as 0, and rows without either are left out."""
    b = base.select("seed", "person_id", finite(F.col(value)).alias("b"))
    p = plan.select("seed", "person_id", finite(F.col(value)).alias("p"))
    both = b.join(p, ["seed", "person_id"], "full").where("b is not null or p is not null")
    return both.select("seed", "person_id", (F.coalesce("p", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))).alias("change"))


def winners_losers(changes: DataFrame, threshold: float) -> DataFrame:
    """One row: persons whose median change passes the threshold, with the range from their own p90 and p10.

    winners_low counts persons whose p90 passes (surely better), winners_high
    those whose p10 does; losers are mirrored.
    """
    person = changes.groupBy("person_id").agg(F.percentile("change", F.array(F.lit(0.5), F.lit(0.1), F.lit(0.9))).alias("q"))
    med, p10, p90 = (F.get("q", i) for i in range(3))
    n = lambda c, name: F.count_if(c).alias(name)
    return person.agg(
        F.count("*").alias("persons"),
        n(med <= -threshold, "winners"), n(p90 <= -threshold, "winners_low"), n(p10 <= -threshold, "winners_high"),
        n(med >= threshold, "losers"), n(p10 >= threshold, "losers_low"), n(p90 >= threshold, "losers_high"),
    )


def person_deltas(deltas: DataFrame, values: list[str], modes: DataFrame, homes: DataFrame, peaks: DataFrame) -> DataFrame:
    """Each person's median of every delta over the seeds that have it, modes before and after, and the median change of the largest v/c at the home node.

    deltas: seed, person_id, values (null where a seed has none); modes:
    person_id, variant, mode (of one seed); homes: person_id, node_id; peaks:
    seed, variant, node_id, max_vc.
    """
    med = deltas.groupBy("person_id").agg(*[F.percentile(F.when(~F.isnan(v), F.col(v)), F.lit(0.5)).alias(v) for v in values])
    mode = modes.groupBy("person_id").agg(*[F.max(F.when(F.col("variant") == v, F.col("mode"))).alias(f"mode_{v}") for v in ("baseline", "plan")])
    both = peaks.groupBy("seed", "node_id").agg(*[F.max(F.when(F.col("variant") == v, F.col("max_vc"))).alias(v) for v in ("baseline", "plan")])
    change = both.groupBy("node_id").agg(F.percentile(F.col("plan") - F.col("baseline"), F.lit(0.5)).alias("home_edges_vc_delta"))
    return med.join(mode, "person_id", "left").join(homes.join(change, "node_id", "left").drop("node_id"), "person_id", "left")


def mode_share(choices: DataFrame, modes: list[str], by: list[str]) -> DataFrame:
    """Percent of each mode of a fixed list in each group; 0 for modes nobody takes."""
    counts = choices.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(F.col("mode") == m).alias(f"m{i}") for i, m in enumerate(modes)])
    pairs = F.array(*[F.struct(F.lit(m).alias("mode"), (F.col(f"m{i}") * 100.0 / F.col("n")).alias("pct")) for i, m in enumerate(modes)])
    return counts.select(*by, F.inline(pairs))


def edge_peak(vc: DataFrame, by: list[str], first: int, last: int) -> DataFrame:
    """Largest v/c of each edge inside bins first..last, and the first bin that has it."""
    inside = vc.where(F.col("bin").between(first, last))
    return inside.groupBy(*by).agg(F.max("vc").alias("max_vc"), F.min_by("bin", F.struct(-F.col("vc"), F.col("bin"))).alias("max_bin"))


def side_effects(peaks: DataFrame, threshold: float, k: int) -> DataFrame:
    """Edges whose median peak reaches the threshold under the plan and not before; the k largest rises.

    peaks: seed, variant, edge_idx, max_vc, max_bin. The bin is the plan's most
    frequent peak bin, the smallest on ties.
    """
    med = peaks.groupBy("edge_idx").agg(
        F.percentile(F.when(F.col("variant") == "baseline", F.col("max_vc")), F.lit(0.5)).alias("base_vc"),
        F.percentile(F.when(F.col("variant") == "plan", F.col("max_vc")), F.lit(0.5)).alias("plan_vc"),
    )
    bins = peaks.where("variant = 'plan'").groupBy("edge_idx", "max_bin").count()
    bins = bins.groupBy("edge_idx").agg(F.min_by("max_bin", F.struct(-F.col("count"), F.col("max_bin"))).alias("peak_bin"))
    crossed = med.where((F.col("base_vc") < threshold) & (F.col("plan_vc") >= threshold)).join(bins, "edge_idx")
    rise = F.round(F.col("plan_vc") - F.col("base_vc"), 6).alias("rise")
    return crossed.select("edge_idx", F.round("base_vc", 6).alias("base_vc"), F.round("plan_vc", 6).alias("plan_vc"), rise, "peak_bin").orderBy(F.desc("rise"), "edge_idx").limit(k)


def link_volume(entries: DataFrame, bin_s: int, start_s: int, end_s: int, weight: Column | None = None) -> DataFrame:
    """Vehicles an hour entering each (bin, edge) in [start_s, end_s)."""
    w = F.lit(1.0) if weight is None else weight
    inside = entries.where((F.col("enter_s") >= start_s) & (F.col("enter_s") < end_s))
    return inside.groupBy(F.floor((F.col("enter_s") - start_s) / bin_s).cast("long").alias("bin"), "edge_idx").agg((F.sum(w) * 3600.0 / bin_s).alias("veh_h"))


def overlap_hours(start: Column, end: Column, lo: float, hi: float, weight: Column) -> Column:
    """Sum of the weighted overlaps of [start, end] with [lo, hi], in hours."""
    return F.sum(weight * F.greatest(F.least(end, F.lit(hi)) - F.greatest(start, F.lit(lo)), F.lit(0))) / 3600.0


def node_max(edges: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """Largest value over the edges that touch each node; 0 for a node without."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("node_id"), value)
    top = ends.groupBy("node_id").agg(F.max(value).alias(f"node_{value}"))
    return nodes.select("node_id").join(top, "node_id", "left").select("node_id", F.coalesce(f"node_{value}", F.lit(0.0)).alias(f"node_{value}"))


def on_road(trips: DataFrame, bins: int) -> DataFrame:
    """Vehicles on the road in each bin 0..bins-1. trips: depart_bin, arrive_bin, w."""
    steps = trips.select(F.explode(F.array(F.struct(F.col("depart_bin").alias("bin"), F.col("w").alias("d")), F.struct((F.col("arrive_bin") + 1).alias("bin"), (-F.col("w")).alias("d")))).alias("s")).select("s.*")
    grid = trips.sparkSession.range(bins).select(F.col("id").alias("bin"))
    dense = grid.join(steps.groupBy("bin").agg(F.sum("d").alias("d")), "bin", "left")
    # one row a bin of the day: the running sum is over `bins` rows
    return dense.select("bin", F.sum(F.coalesce("d", F.lit(0.0))).over(W.orderBy("bin")).alias("on_road"))


def peak_window(histogram: DataFrame, width: int) -> DataFrame:
    """First and last bin, and total, of the earliest `width` bins with the largest sum; all bins if there are fewer."""
    ahead = W.orderBy("bin").rowsBetween(0, width - 1)
    runs = histogram.select("bin", F.sum("n").over(ahead).alias("total"), F.count("*").over(ahead).alias("size"), F.max("bin").over(ahead).alias("last_bin"), F.count("*").over(W.partitionBy(F.lit(1))).alias("all"))
    full = runs.where((F.col("size") == width) | ((F.col("all") < width) & (F.col("size") == F.col("all"))))
    return full.agg(F.min_by("bin", F.struct(-F.col("total"), F.col("bin"))).alias("first_bin"), F.min_by("last_bin", F.struct(-F.col("total"), F.col("bin"))).alias("last_bin"), F.max("total").alias("total"))
