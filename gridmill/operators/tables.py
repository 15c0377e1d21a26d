"""Joins, filters and counts over the world's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def first_match(left: DataFrame, right: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Left rows with the first right row's value by key; the old value stays where there is none. Adds matched."""
    best = right.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(value, F.struct(*order)).alias("found"))
    return left.join(best, key, "left").withColumn("matched", F.col("found").isNotNull()).withColumn(value, F.coalesce("found", value)).drop("found")


def habit_align(now: DataFrame, before: DataFrame) -> DataFrame:
    """The previous choice of each person, -1 where there is none."""
    return now.join(before.select("person_id", F.col("choice").alias("habit")), "person_id", "left").withColumn("habit", F.coalesce("habit", F.lit(-1)))


def household_fallback(persons: DataFrame, deltas: DataFrame, value: str, how: str = "avg") -> DataFrame:
    """A person's own value, else the mean (or max) over the household's members who have one."""
    rows = persons.join(deltas.select("person_id", value), "person_id", "left")
    v = F.when(~F.isnan(value), F.col(value))
    group = getattr(F, how)(v).over(W.partitionBy("household_id"))
    return rows.select("person_id", F.coalesce(v, group).alias(value))


def star_join(persons: DataFrame, households: DataFrame, nodes: DataFrame) -> DataFrame:
    """Persons with their household and its home node's place."""
    homes = households.join(nodes.select(F.col("node_id").alias("home_node"), "x", "z"), "home_node")
    return persons.join(homes, "household_id")


def repaired_homes(households: DataFrame, nodes: DataFrame, reach: float = 500.0) -> DataFrame:
    """Households whose home node isn't known live at the nearest one. households: household_id, home_node, x, z; nodes: node_id, x2, z2."""
    from gridmill.operators.spatial import nearest

    known = households.join(nodes.select(F.col("node_id").alias("home_node")), "home_node", "left_semi")
    lost = households.join(known.select("household_id"), "household_id", "left_anti")
    near = nearest(lost.select("household_id", "x", "z"), nodes, "household_id", "node_id", reach, digits=6)
    return known.select("household_id", "home_node").union(near.select("household_id", F.col("node_id").alias("home_node")))


def repaired_edges(edges: DataFrame) -> DataFrame:
    """Edges with a free-flow time and a capacity: length at 40 km/h, and 600 a lane, stand for invalid ones; no edge takes under 0.1 s."""
    valid = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) & (F.col(c) > 0)
    time = F.when(valid("free_flow_s"), F.col("free_flow_s")).otherwise(F.greatest("length_m", F.lit(1.0)) / (40 / 3.6))
    return edges.withColumn("free_flow_s", F.greatest(time, F.lit(0.1))).withColumn("capacity_vph", F.when(valid("capacity_vph"), F.col("capacity_vph")).otherwise(F.col("lanes") * 600.0))


def repaired(persons: DataFrame, households: DataFrame, schools: DataFrame) -> DataFrame:
    """Persons of known households; a school that isn't known becomes null."""
    kept = persons.join(households.select("household_id"), "household_id", "left_semi")
    known = schools.select("school_id", F.lit(True).alias("known"))
    return kept.join(known, "school_id", "left").withColumn("school_id", F.when(F.col("known"), F.col("school_id"))).drop("known")


def crosswalk(od: DataFrame, blocks: DataFrame) -> DataFrame:
    """Origin-destination rows with both blocks' places; rows with an unknown block go."""
    end = lambda s: blocks.select(F.col("block").alias(f"{s}_block"), F.col("x").alias(f"{s}_x"), F.col("z").alias(f"{s}_z"))
    return od.join(end("h"), "h_block").join(end("w"), "w_block")


def reason_counts(df: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """Rows under the first reason that holds for each, 'kept' where none does."""
    reason = F.lit("kept")
    for name, test in reversed(reasons):
        reason = F.when(test, name).otherwise(reason)
    return df.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def tally(df: DataFrame, values: Column, by: list[str]) -> DataFrame:
    """Rows that name each value, a row once however often it does."""
    return df.select(*by, F.explode(F.array_distinct(values)).alias("value")).groupBy(*by, "value").agg(F.count("*").alias("n"))


def shares_or_default(df: DataFrame, parts: list[str], defaults: list[float]) -> DataFrame:
    """Parts as shares of their sum; negative and null parts are 0; the defaults where nothing is left."""
    clean = [F.greatest(F.coalesce(F.col(p), F.lit(0)), F.lit(0)) for p in parts]
    total = sum(clean[1:], clean[0])
    return df.withColumns({f"{p}_share": F.when(total > 0, c / F.nullif(total, F.lit(0))).otherwise(F.lit(d)) for p, c, d in zip(parts, clean, defaults)})


def group_ratios(groups: DataFrame, default_wfh: float) -> DataFrame:
    """Kids and workers a household, the share of workers at home (a default without workers, 1 at most), and the households inside. groups: kids, workers, home, households, inside (a share)."""
    n = F.nullif(F.col("households"), F.lit(0))
    wfh = F.when(F.col("workers") > 0, F.least(F.col("home") / F.col("workers"), F.lit(1.0))).otherwise(F.lit(default_wfh))
    out = groups.withColumn("kids_ratio", F.col("kids") / n).withColumn("workers_ratio", F.col("workers") / n).withColumn("wfh_share", wfh)
    return out.withColumn("households", F.bround(F.col("households") * F.col("inside"), 0).cast("long"))


def work_model(jobs: DataFrame) -> DataFrame:
    """grp, place, share: of each home group's jobs inside by node, of those outside by exit, and what share is 'inside'; grp null stands for all groups.

    jobs: grp, node (null outside), exit (null inside), jobs.
    """
    def parts(rows: DataFrame, by: str, name) -> DataFrame:
        sums = rows.groupingSets([["grp", by], [by]], "grp", by).agg(F.sum("jobs").alias("jobs"))
        return sums.select("grp", name.alias("place"), (F.col("jobs") / F.sum("jobs").over(W.partitionBy("grp"))).alias("share"))

    inside = jobs.groupingSets([["grp"], []], "grp").agg((F.sum(F.when(F.col("node").isNotNull(), F.col("jobs")).otherwise(0)) / F.sum("jobs")).alias("share"))
    nodes = parts(jobs.where("node is not null"), "node", F.concat(F.lit("node "), F.col("node").cast("string")))
    return nodes.union(parts(jobs.where("node is null"), "exit", F.col("exit"))).union(inside.select("grp", F.lit("inside"), "share"))


def employment_rate(groups: DataFrame, per_household: float, most: float = 0.97) -> DataFrame:
    """min(most, workers a household x households / persons of working age), in each group. groups: grp, households, working_age."""
    rate = F.lit(per_household) * F.col("households") / F.greatest("working_age", F.lit(1))
    return groups.select("grp", F.least(F.lit(most), rate).alias("rate"))


def household_schools(persons: DataFrame) -> DataFrame:
    """Sorted distinct schools of each household."""
    return persons.where("school_id is not null").groupBy("household_id").agg(F.array_sort(F.collect_set("school_id")).alias("schools"))


def calibration_table(simulated: DataFrame, observed: DataFrame, limit_pct: float) -> DataFrame:
    """Median simulated minutes of each route against the observed ones, and a status; without an observation, 'no target'."""
    med = simulated.groupBy("route").agg(F.percentile("minutes", F.lit(0.5)).alias("simulated"))
    error = F.abs(F.col("simulated") - F.col("observed")) / F.nullif(F.col("observed"), F.lit(0.0)) * 100
    rows = med.join(observed, "route", "left").withColumn("error_pct", error)
    return rows.withColumn("status", F.when(F.col("error_pct").isNull(), "no target").when(F.col("error_pct") <= limit_pct, "ok").otherwise("off"))


def calibration_status(rows: DataFrame, limit_pct: float, least: int) -> DataFrame:
    """One row: targets observed, median error, and whether that is calibrated, off, or drawn from too few targets. rows: error_pct."""
    out = rows.agg(F.count("error_pct").alias("targets"), F.percentile("error_pct", F.lit(0.5)).alias("median_pct"))
    return out.withColumn("status", F.when(F.col("targets") < least, "too few targets").when(F.col("median_pct") <= limit_pct, "calibrated").otherwise("off"))


def students_by_school(persons: DataFrame, schools: DataFrame) -> DataFrame:
    """Students of every school, 0 for those without."""
    counts = persons.where("school_id is not null").groupBy("school_id").agg(F.count("*").alias("students"))
    return schools.select("school_id").join(counts, "school_id", "left").na.fill(0, ["students"])


def knob_argmin(candidates: DataFrame) -> DataFrame:
    """Per knob the candidate of least error, the first on ties, if it beats the current one. candidates: knob, candidate, error, is_current."""
    best = candidates.groupBy("knob").agg(F.min_by("candidate", F.struct(F.coalesce("error", F.lit(float("inf"))), F.col("candidate"))).alias("best"), F.min("error").alias("error"), F.max(F.when(F.col("is_current"), F.col("error"))).alias("current"))
    return best.select("knob", "best", (F.col("error") < F.col("current")).alias("accepted"))


def cell_sections(props: DataFrame, size: float) -> DataFrame:
    """Rows of each (type, cell), and where they start in an order by type and cell."""
    counts = props.groupBy("type", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("z") / size).alias("cz")).agg(F.count("*").alias("n"))
    return counts.withColumn("offset", F.sum("n").over(W.partitionBy("type").orderBy("cz", "cx")) - F.col("n"))


def stable_ids(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Numbers 1..n by an order: Spark's range partitions, whose bounds are sampled, hold n / partitions rows each; ranks within them, plus the rows before each."""
    from gridmill.operators.network import kept

    placed = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    before = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))  # a row for each partition
    before = before.select("__part", (F.sum("n").over(W.orderBy("__part")) - F.col("n")).alias("__base"))
    numbered = placed.withColumn("__part", part).join(F.broadcast(before), "__part")
    return numbered.withColumn(name, F.col("__base") + F.col("__at") - F.shiftleft("__part", 33) + 1).drop("__part", "__base", "__at")


def running_sum(rows: DataFrame, by: list[str], order: list, value: Column, name: str) -> DataFrame:
    """Sum of value over a group's rows up to and with each row, in an order that must be total; null is 0.

    No task sorts a whole group: rows go to sampled range partitions by group and
    order, are summed inside them, and take on what the group holds in earlier ones.
    """
    from gridmill.operators.network import kept

    placed = kept(rows.withColumn("__v", F.coalesce(value, F.lit(0))).repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()))
    inside = W.partitionBy(*by, "__part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = placed.groupBy(*by, "__part").agg(F.sum("__v").alias("__whole"))  # a row for each group in each partition
    earlier = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    whole = whole.withColumn("__base", F.coalesce(F.sum("__whole").over(earlier), F.lit(0))).select(F.struct(*by, "__part").alias("__of"), "__base")
    summed = placed.withColumn("__sum", F.sum("__v").over(inside)).withColumn("__of", F.struct(*by, "__part"))
    met = summed.join(whole.withColumnRenamed("__of", "__of2"), F.col("__of").eqNullSafe(F.col("__of2")))
    return met.withColumn(name, F.col("__base") + F.col("__sum")).drop("__v", "__part", "__sum", "__of", "__of2", "__base")


def latest_year(items: DataFrame, date: str, by: list[str]) -> DataFrame:
    """Items of the most recent year of each group."""
    year = F.year(date)
    last = items.groupBy(*by).agg(F.max(year).alias("last"))
    return items.join(last, by).where(year == F.col("last")).drop("last")


def uncovered(wanted: DataFrame, sample: DataFrame, column: str) -> DataFrame:
    """Values of a column that a sample doesn't hold yet."""
    return wanted.select(column).distinct().join(sample.select(column), column, "left_anti")


def append_aligned(*parts: DataFrame) -> DataFrame:
    """Union by name; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def class_scale(measured: DataFrame, model: dict[str, float], low: float = 1.0, high: float = 4.0) -> DataFrame:
    """Per class the model's ratio over the median measured one, within limits. measured: class, ratio."""
    med = measured.groupBy("class").agg(F.percentile("ratio", F.lit(0.5)).alias("median"))
    ratio = F.coalesce(*[F.when(F.col("class") == k, F.lit(v)) for k, v in model.items()])
    return med.select("class", F.least(F.greatest(ratio / F.col("median"), F.lit(low)), F.lit(high)).alias("factor"))
