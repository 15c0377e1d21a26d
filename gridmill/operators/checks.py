"""Checks of plan tools' parameters and of estimated levers, given as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.functions.scalars import clock_to_s

#: Modes that students and workers choose from.
STUDENT_MODES = ["drive_dropoff", "carpool", "school_bus", "school_shuttle", "walk", "bike", "teen_drive"]
WORKER_MODES = ["drive_alone", "carpool", "bike", "walk"]

SPEC = "tool string, ord int, pid string, type string, required boolean, default string, min string, max string, options array<string>, most int, allow_all boolean"


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts])


def _latlon_ok(v: Column) -> Column:
    """Whether JSON text is [lat, lon] or {"lat":, "lon":} within range."""
    pair, named = F.from_json(v, "array<double>"), F.from_json(v, "lat double, lon double")
    lat, lon = F.coalesce(F.get(pair, 0), named["lat"]), F.coalesce(F.get(pair, 1), named["lon"])
    return F.coalesce((F.coalesce(F.size(pair), F.lit(2)) == 2) & lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def _parameter_error(v: Column) -> Column:
    """What is wrong with a parameter's value v by its specification's columns; null if nothing."""
    c, pid, kind = F.col, F.col("pid"), F.col("type")
    number = F.expr("try_cast(v AS double)")
    whole = F.abs(number - F.round(number)) <= 1e-9
    s, low, high = clock_to_s(v), clock_to_s(c("min")), clock_to_s(c("max"))
    points = F.from_json(v, "array<string>")
    is_number, is_list = kind.isin("int", "float"), kind.isin("points", "polyline")
    shaped = v.rlike(r"^\s*[\[{]")
    return (
        F.when((kind == "school") & F.coalesce(c("allow_all"), F.lit(False)) & F.lower(v).isin("all", "*"), None)
        .when(kind.isin("school", "entrance") & ~c("known"), _say("unknown ", kind, " '", v, "'"))
        .when((kind == "time") & s.isNull(), _say("'", pid, "' must be a time HH:MM"))
        .when((kind == "time") & (s < low), _say("'", pid, "' ", v, " is earlier than ", c("min")))
        .when((kind == "time") & (s > high), _say("'", pid, "' ", v, " is later than ", c("max")))
        .when(is_number & number.isNull(), _say("'", pid, "' must be a number"))
        .when(is_number & (F.isnan(number) | (F.abs(number) == float("inf"))), _say("'", pid, "' must be finite"))
        .when((kind == "int") & ~whole, _say("'", pid, "' must be a whole number"))
        .when(is_number & (number < c("min").cast("double")), _say("'", pid, "' must be >= ", c("min")))
        .when(is_number & (number > c("max").cast("double")), _say("'", pid, "' must be <= ", c("max")))
        .when((kind == "select") & ~F.coalesce(F.array_contains(c("options"), v), F.lit(False)), _say("'", pid, "' must be one of ", F.array_join("options", ", ")))
        .when((kind == "bool") & ~F.lower(v).isin("true", "false"), _say("'", pid, "' must be true or false"))
        .when((kind == "text") & (F.length(v) > c("most")), _say("'", pid, "' is longer than ", c("most"), " characters"))
        .when((kind == "point") & ~_latlon_ok(v), _say("'", pid, "' must be [lat, lon]"))
        .when(is_list & (F.coalesce(F.size(points), F.lit(0)) < 1), _say("'", pid, "' must be a list of [lat, lon]"))
        .when(is_list & F.exists(points, lambda p: ~_latlon_ok(p)), _say("'", pid, "' must be a list of [lat, lon]"))
        .when((kind == "points") & (F.size(points) > c("most")), _say("'", pid, "' has more than ", c("most"), " points"))
        .when((kind == "polyline") & (F.size(points) < 2), _say("'", pid, "' needs at least 2 points"))
        .when(kind.isin("edge", "node") & shaped & ~_latlon_ok(v), _say("'", pid, "' must be [lat, lon]"))
        .when(kind.isin("edge", "node") & ~shaped & ~c("known"), _say(kind, " ", v, " does not exist"))
    )


def tool_errors(tools: DataFrame, specs: DataFrame, references: DataFrame) -> DataFrame:
    """First error of each tool instance in the order of its parameters, and the unknown parameters.

    tools: plan_id, pos, tool, params (JSON object); specs: see SPEC, a table of
    tools in a program and so small; references: kind (school, entrance, edge,
    node), value: what exists. Returns plan_id, pos, error, unknown (sorted).
    """
    rows = tools.withColumn("params", F.coalesce(F.from_json("params", "map<string,string>"), F.create_map().cast("map<string,string>")))
    each = rows.join(F.broadcast(specs), "tool")
    given = F.col("params")[F.col("pid")]
    absent = given.isNull() | ((given == "") & (F.col("type") != "text"))
    each = each.withColumn("v", F.when(absent, F.col("default")).otherwise(given))
    exist = references.select(F.col("kind").alias("type"), F.col("value").alias("v"), F.lit(True).alias("known")).distinct()
    each = each.join(exist, ["type", "v"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    error = F.when(F.col("v").isNull(), F.when(F.col("required"), _say("missing required parameter '", F.col("pid"), "'"))).otherwise(_parameter_error(F.col("v")))
    first = each.withColumn("error", error).groupBy("plan_id", "pos").agg(F.min(F.when(F.col("error").isNotNull(), F.struct("ord", "error"))).alias("e"), F.collect_set("pid").alias("pids"), F.first("params").alias("params"))
    return first.select("plan_id", "pos", F.col("e.error").alias("error"), F.array_sort(F.array_except(F.map_keys("params"), "pids")).alias("unknown"))


LEVERS = "levers array<struct<type: string, mode: string, applies_to: string, utils: double, school: string, target: string, edge_idx: long, entrance: string, factor: double>>, adoption_range array<double>"


def lever_errors(estimates: DataFrame, references: DataFrame, most_utils: float, factors: tuple[float, float]) -> DataFrame:
    """First error of each estimate, null if it holds. estimates: plan_id, estimate (JSON); references: kind, value.

    The adoption range must be ordered within 0..1. A shift's mode must be one
    its group chooses from, its utility within most_utils, its school known; a
    capacity factor must lie within `factors`, its edge or entrance exist.
    """
    rows = estimates.withColumn("e", F.from_json("estimate", LEVERS)).select("plan_id", "e.levers", "e.adoption_range")
    low, high = F.get("adoption_range", 0), F.get("adoption_range", 1)
    ordered = F.coalesce((F.size("adoption_range") == 2) & (low >= 0) & (low <= high) & (high <= 1), F.lit(False))
    each = rows.select("plan_id", F.posexplode("levers").alias("pos", "l")).select("plan_id", "pos", "l.*")
    is_shift = F.col("type") == "shift"
    kind = F.when(is_shift, "school").when(F.col("target") == "edge", "edge").otherwise("entrance")
    value = F.when(is_shift, F.nullif("school", F.lit(""))).when(F.col("target") == "edge", F.col("edge_idx").cast("string")).otherwise(F.coalesce("entrance", F.lit("")))
    exist = references.select("kind", "value", F.lit(True).alias("known")).distinct()
    each = each.withColumn("kind", kind).withColumn("value", value).join(exist, ["kind", "value"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    fits = (F.col("mode").isin(STUDENT_MODES) & F.col("applies_to").isin("students", "all")) | (F.col("mode").isin(WORKER_MODES) & F.col("applies_to").isin("workers", "all"))
    error = (
        F.when(is_shift & ~F.coalesce(fits, F.lit(False)), _say("mode '", F.col("mode"), "' is not a choice for ", F.col("applies_to")))
        .when(is_shift & (F.abs("utils") > most_utils), _say("utility shift for ", F.col("mode"), f" exceeds {most_utils}"))
        .when(is_shift & F.col("value").isNotNull() & ~F.col("known"), _say("unknown school '", F.col("school"), "'"))
        .when(~is_shift & ~F.coalesce(F.col("factor").between(*factors), F.lit(False)), _say("capacity factor ", F.col("factor"), f" outside [{factors[0]}, {factors[1]}]"))
        .when(~is_shift & ~F.col("known"), _say(F.col("kind"), " ", F.col("value"), " does not exist"))
    )
    first = each.withColumn("error", error).where("error is not null").groupBy("plan_id").agg(F.min(F.struct("pos", "error")).alias("first"))
    joined = rows.select("plan_id", ordered.alias("ordered")).join(first, "plan_id", "left")
    return joined.select("plan_id", F.when(~F.col("ordered"), "adoption_range must be [low, high] with 0 <= low <= high <= 1").otherwise(F.col("first.error")).alias("error"))
