"""Plans, votes, chats and other state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def last_votes(votes: DataFrame) -> DataFrame:
    """The last vote of each (plan, player); a value of 0 takes a vote back."""
    last = votes.groupBy("plan_id", "player_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return last.where("value <> 0")


def vote_totals(plans: DataFrame, votes: DataFrame) -> DataFrame:
    """Total of each plan's votes, 0 without any."""
    total = last_votes(votes).groupBy("plan_id").agg(F.sum("value").alias("votes"))
    return plans.select("plan_id").join(total, "plan_id", "left").select("plan_id", F.coalesce("votes", F.lit(0)).alias("votes"))


SORTS = ("new", "votes", "metric")


def list_plans(plans: DataFrame, sort: str, limit: int, offset: int = 0, ascending: bool = False) -> DataFrame:
    """A page of plans with the total before paging. Plans without the metric come last; ties newest first, then by id."""
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {', '.join(SORTS)}")
    column = {"new": "created_at", "votes": "votes", "metric": "metric_value"}[sort]
    key = F.asc_nulls_last(column) if ascending else F.desc_nulls_last(column)
    total = plans.agg(F.count("*").alias("total"))
    page = plans.orderBy(key, F.desc("created_at"), "plan_id").limit(offset + limit).offset(offset)
    return page.join(F.broadcast(total))


def latest(rows: DataFrame, by: list[str], order: list, n: int = 1) -> DataFrame:
    """The n last rows of each group in the order given (descending)."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def first_seen(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Distinct keys in the order in which they are first seen."""
    first = rows.groupBy(key).agg(F.min(F.struct(*order)).alias("at"))
    return first.select(key, *[F.col(f"at.{c}").alias(c) for c in order])


def priority_merge(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of both by key, field by field: the first's value, or the second's where it is null or absent."""
    fields = [c for c in second.columns if c != key]
    a, b = first.alias("a"), second.alias("b")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in fields])


def id_changes(old: DataFrame, new: DataFrame, key: str, tolerance: float) -> DataFrame:
    """One row: ids shared, moved by more than the tolerance, gone and added."""
    a, b = old.alias("a"), new.alias("b")
    far = F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.z") - F.col("b.z")) > tolerance
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    return both.agg(
        F.count_if(F.col(f"a.{key}").isNotNull() & F.col(f"b.{key}").isNotNull()).alias("shared"), F.count_if(far).alias("moved"),
        F.count_if(F.col(f"b.{key}").isNull()).alias("gone"), F.count_if(F.col(f"a.{key}").isNull()).alias("added"),
    )


def metric_map(metrics: DataFrame) -> DataFrame:
    """Per plan, a map of metric to median."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "median"))))
    return metrics.groupBy("plan_id").agg(entries.alias("headline"))


def budgets(lines: DataFrame, upfront: float, yearly: float) -> DataFrame:
    """Cost sums of each plan, and whether either passes its limit."""
    sums = lines.groupBy("plan_id").agg(F.sum("upfront").alias("upfront"), F.sum("yearly").alias("yearly"))
    return sums.withColumn("over_budget", (F.col("upfront") > upfront) | (F.col("yearly") > yearly))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: a hash of all rows that doesn't depend on their order. Pairs of equal rows don't cancel."""
    h = F.xxhash64(*df.columns)
    wide = h.cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.sum(wide).cast("string").alias("sum"), F.bit_xor(F.xxhash64(h, F.lit(1))).alias("xor"))


def goal_status(reports: DataFrame, goals: DataFrame) -> DataFrame:
    """met, missed or unknown for each plan and goal (metric, kind at_most or at_least, target)."""
    grid = reports.select("plan_id").distinct().join(F.broadcast(goals))
    found = grid.join(reports, ["plan_id", "metric"], "left")
    met = F.when(F.col("kind") == "at_most", F.col("value") <= F.col("target")).otherwise(F.col("value") >= F.col("target"))
    return found.select("plan_id", "goal", F.when(F.col("value").isNull(), "unknown").when(met, "met").otherwise("missed").alias("status"))


#: The game's state tables; columns held as JSON text, with their types.
STATE_TABLES = {
    "players": ("player_id long, name string, created_at timestamp_ntz", {}),
    "plans": ("plan_id long, created_at timestamp_ntz, tools string", {"tools": "array<struct<tool: string, params: map<string, double>>>"}),
    "votes": ("plan_id long, player_id long, value int", {}),
    "jobs": ("plan_id long, job string", {"job": "struct<status: string, error: string>"}),
    "reactions": ("plan_id long, persona_id long, reaction string", {"reaction": "struct<approval: double, text: string>"}),
    "chats": ("persona_id long, turn long, message string", {"message": "struct<role: string, text: string>"}),
    "townhalls": ("plan_id long, turns string", {"turns": "array<struct<persona_id: bigint, text: string>>"}),
}


def write_state(df: DataFrame, folder: str, name: str) -> None:
    """Append rows to a state table: nested columns go out as JSON text, others in the table's types."""
    from pyspark.sql.types import _parse_datatype_string

    schema, nested = STATE_TABLES[name]
    fields = _parse_datatype_string(schema).fields
    df.select(*[(F.to_json(f.name) if f.name in nested else F.col(f.name).cast(f.dataType)).alias(f.name) for f in fields]).write.mode("append").parquet(f"{folder}/{name}")


def read_state(spark, folder: str, name: str) -> DataFrame:
    """A state table with its JSON columns parsed."""
    schema, nested = STATE_TABLES[name]
    df = spark.read.schema(schema).parquet(f"{folder}/{name}")
    return df.withColumns({c: F.from_json(c, kind) for c, kind in nested.items()}) if nested else df


#: Columns that no public view may have.
PRIVATE = ("person_id", "household_id", "building_id", "home_node", "email")


def public(df: DataFrame, allowed: list[str]) -> DataFrame:
    """The allowed columns; an error if the list holds a private one."""
    if found := set(allowed) & set(PRIVATE):
        raise ValueError(f"not for the public: {', '.join(sorted(found))}")
    return df.select(*allowed)
