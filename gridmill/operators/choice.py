"""Discrete choice, capacity limits, hashed draws and sampling.

Draws are hashes of (stream, seed, key), so they don't depend on partitioning
and a baseline and a plan share them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridmill.operators.tables import running_sum, stable_ids


def uniform(stream: str, seed: Column | int, *keys: Column) -> Column:
    """A draw in (0, 1) that depends on the stream, the seed and the keys alone."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    h = F.shiftrightunsigned(F.xxhash64(F.lit(stream), seed, *keys), 11)
    return (h.cast("double") + 0.5) * F.lit(2.0**-53)


def normal(stream: str, seed: Column | int, *keys: Column) -> Column:
    """A standard normal draw (Box-Muller)."""
    a, b = uniform(stream + "/a", seed, *keys), uniform(stream + "/b", seed, *keys)
    return F.sqrt(-2 * F.log(a)) * F.cos(2 * F.pi() * b)


def gumbel(stream: str, seed: Column | int, *keys: Column) -> Column:
    return -F.log(-F.log(uniform(stream, seed, *keys)))


def triangular_quantile(u: Column, low: Column, mode: Column, high: Column) -> Column:
    """Inverse of the triangular distribution's CDF."""
    c = (mode - low) / (high - low)
    return F.when(u < c, low + F.sqrt(u * (high - low) * (mode - low))).otherwise(high - F.sqrt((1 - u) * (high - low) * (high - mode)))


def pick(u: Column, names: list[str], shares: list[Column]) -> Column:
    """The category into whose share of the unit interval u falls."""
    total = sum(shares[1:], shares[0])
    out, edge = F.lit(names[-1]), total
    for name, share in reversed(list(zip(names, shares))):
        out = F.when(u * total < edge, F.lit(name)).otherwise(out)
        edge = edge - share
    return out


def argmax_choice(options: Column) -> Column:
    """Name of the best available option of array<struct(name, u, available)>; the first on ties, the first of all if none is available."""
    best = F.aggregate(options, F.lit(None).cast("struct<name:string,u:double,available:boolean>"), lambda b, o: F.when(o["available"] & (b.isNull() | (o["u"] > b["u"])), o).otherwise(b))
    return F.coalesce(best["name"], F.element_at(options, 1)["name"])


def shares(options: DataFrame, by: list[str], mode: str) -> DataFrame:
    """Mean logit probability of a mode per group, over choosers who have it and another. options: person_id, name, u, available, by."""
    able = options.where("available")
    of = W.partitionBy("person_id", *by)
    p = able.withColumn("top", F.max("u").over(of)).withColumn("n", F.count("*").over(of))
    p = p.withColumn("p", F.exp(F.col("u") - F.col("top")) / F.sum(F.exp(F.col("u") - F.col("top"))).over(of))
    return p.where((F.col("n") >= 2) & (F.col("name") == mode)).groupBy(*by).agg(F.avg("p").alias("share"))


def calibrate(options: DataFrame, mode: str, by: str, targets: dict, bound: float = 4.0, rounds: int = 80, close: float = 1e-3) -> DataFrame:
    """Constant of a mode in each group that brings its share to the target, by log-odds steps. One number a group comes back each round."""
    from gridmill.operators.network import kept

    constant = {g: 0.0 for g in targets}
    spark = options.sparkSession
    options = kept(options)
    for _ in range(rounds):
        table = spark.createDataFrame(sorted(constant.items()), f"{by} {options.schema[by].dataType.simpleString()}, constant double")
        moved = options.join(F.broadcast(table), by, "left").withColumn("u", F.when(F.col("name") == mode, F.col("u") + F.coalesce("constant", F.lit(0.0))).otherwise(F.col("u")))
        got = {r[by]: r.share for r in shares(moved, [by], mode).where(F.col(by).isin(list(targets))).collect()}
        off = {g: targets[g] - s for g, s in got.items()}
        if all(abs(d) < close for d in off.values()):
            break
        odds = lambda p: math.log(p / (1 - p))
        for g, s in got.items():
            constant[g] = max(-bound, min(bound, constant[g] + odds(targets[g]) - odds(s)))
    return spark.createDataFrame(sorted(constant.items()), f"{by} string, constant double")


def cap_rechoose(members: DataFrame, by: list[str], mode: str, cap: int) -> DataFrame:
    """Members of a group who take a mode keep it up to cap, largest margin first, then least id; others take their alternative.

    members: person_id (no two alike), choice, alternative, margin. No task sorts
    a whole group: each hands on its first `cap` rows of it.
    """
    on = F.col("choice") == mode
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("margin"), "person_id"))
    stay = members.where(on).withColumn("rank", rank).where(F.col("rank") <= cap).select("person_id", F.lit(True).alias("stays"))
    return members.join(stay, "person_id", "left").withColumn("choice", F.when(on & F.col("stays").isNull(), F.col("alternative")).otherwise(F.col("choice"))).drop("stays").select(members.columns)


def cap_adoption(members: DataFrame, by: list[str], mode: str, share: float) -> DataFrame:
    """At most floor(share x group) may switch to a mode; those of least margin go back to base. members: person_id (no two alike), base, choice, margin."""
    switched = F.coalesce((F.col("choice") == mode) & (F.col("base") != mode), F.lit(False))
    ranked = running_sum(members, by, [F.desc("margin"), "person_id"], switched.cast("long"), "__rank")
    limits = members.groupBy(F.struct(*by).alias("__of")).agg(F.floor(F.count("*") * F.lit(share)).alias("__limit"))
    marked = ranked.join(limits, F.struct(*by).eqNullSafe(F.col("__of")))
    return marked.withColumn("choice", F.when(switched & (F.col("__rank") > F.col("__limit")), F.col("base")).otherwise(F.col("choice"))).select(members.columns)


def first_driver(persons: DataFrame) -> DataFrame:
    """Per household the first worker (least id), else the first adult."""
    return persons.groupBy("household_id").agg(F.coalesce(F.min(F.when(F.col("is_worker"), F.col("person_id"))), F.min(F.when(F.col("age") >= 18, F.col("person_id")))).alias("driver_id"))


def largest_remainder(strata: DataFrame, key: str, n: int) -> DataFrame:
    """n places over strata in proportion to their size: floors first, then by largest remainder, then key. strata: key, size."""
    total = strata.agg(F.sum("size").alias("total"))
    exact = F.col("size") * F.lit(n) / F.col("total")
    q = strata.join(F.broadcast(total)).withColumn("base", F.floor(exact)).withColumn("rest", F.round(exact - F.floor(exact), 9))
    short = q.agg((F.lit(n) - F.sum("base")).alias("short"))
    ranked = q.join(F.broadcast(short)).withColumn("rank", F.row_number().over(W.orderBy(F.desc("rest"), key)))
    return ranked.select(key, "size", (F.col("base") + (F.col("rank") <= F.col("short")).cast("int")).alias("quota"))


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int, seed: int, order: Column | None = None) -> DataFrame:
    """n rows in proportion to the strata, by hashed order (or the order given) within each. No task sorts a whole stratum: each hands on its first n rows of it."""
    order = F.xxhash64(F.lit(seed), F.col(key)) if order is None else order
    quota = largest_remainder(rows.groupBy(stratum).agg(F.count("*").alias("size")), stratum, n)
    rank = F.row_number().over(W.partitionBy(stratum).orderBy(order, key))
    first = rows.withColumn("rank", rank).where(F.col("rank") <= n)  # a limit that Spark applies before the shuffle too
    return first.join(F.broadcast(quota.select(stratum, "quota")), stratum).where("rank <= quota").drop("rank", "quota")


def covering(rows: DataFrame, key: str, covers: list[str], order: Column) -> DataFrame:
    """tag, key: rows that cover every value of the columns `covers` (values or arrays of them).

    Values go by column, then as strings. One that no row taken for an earlier
    value covers takes the first row by `order` that has it. Which values take
    a row is settled in rounds: all whose earlier rivals are settled at once.
    """
    from gridmill.operators.network import kept

    def tagged(k: int, c: str) -> Column:
        values = F.col(c) if rows.schema[c].dataType.typeName() == "array" else F.array(c)
        return F.transform(F.filter(F.array_distinct(values), lambda v: v.isNotNull()), lambda v: F.struct(F.lit(k).alias("column"), v.cast("string").alias("value")))

    tags = F.concat(*[tagged(k, c) for k, c in enumerate(covers)])
    each = rows.select(F.struct(order.alias("o"), F.col(key).alias("key"), tags.alias("tags")).alias("row")).select("row", F.explode("row.tags").alias("tag"))
    first = kept(each.groupBy("tag").agg(F.min("row").alias("row")).select("tag", F.col("row.key").alias(key), F.col("row.tags").alias("tags")))
    rivals = first.select(F.col("tag").alias("by"), F.explode("tags").alias("tag")).where("by < tag")
    done = kept(first.select("tag", F.lit(None).cast("boolean").alias("taken")))
    while not done.where("taken is null").isEmpty():
        known = rivals.join(done.select(F.col("tag").alias("by"), F.col("taken").alias("by_taken")), "by")
        told = known.groupBy("tag").agg(F.max("by_taken").alias("covered"), F.count_if(F.col("by_taken").isNull()).alias("open"))
        state = F.when(F.col("covered"), F.lit(False)).when(F.coalesce("open", F.lit(0)) == 0, F.lit(True))
        done = kept(done.join(told, "tag", "left").select("tag", F.coalesce("taken", state).alias("taken")))
    return first.join(done.where("taken"), "tag").select("tag", key)


def coverage_sample(rows: DataFrame, key: str, covers: list[str], strata: list[str], n: int, seed: int, order: Column | None = None) -> DataFrame:
    """n rows (all, if there are no more): first those that cover all values of `covers`, then the rest in proportion to the strata. Adds covers_for: the value that a row was taken for, else null.

    Where n is less than the covering rows, the first of them by column and
    value stay. The same rows under any partitioning.
    """
    from gridmill.operators.network import kept

    order = F.xxhash64(F.lit(seed), F.col(key)) if order is None else order
    rows = kept(rows)
    taken = kept(covering(rows, key, covers, order).orderBy("tag").limit(n).select(key, F.concat(F.element_at(F.array(*[F.lit(c) for c in covers]), F.col("tag.column") + 1), F.lit("="), F.col("tag.value")).alias("covers_for")))
    rest = n - taken.count()
    pool = rows.join(taken.select(key), key, "left_anti").withColumn("covers_for", F.lit(None).cast("string"))
    if rows.count() > n:
        named = pool.withColumn("stratum", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in strata]))
        pool = stratified_sample(named, "stratum", key, rest, seed, order).drop("stratum") if rest else pool.limit(0)
    return rows.join(taken, key).unionByName(pool)


def weighted_sample(rows: DataFrame, key: str, weight: Column, n: int, seed: int, forced: Column | None = None) -> DataFrame:
    """n rows without replacement: forced ones first, by key, then others with probability in proportion to weight (1e-9 at least)."""
    order = -F.log(uniform("sample", seed, F.col(key))) / F.greatest(weight.cast("double"), F.lit(1e-9))
    if forced is not None:
        order = F.when(forced, F.lit(-1.0)).otherwise(order)
    return stable_ids(rows.withColumn("order", order), ["order", key], "rank").where(F.col("rank") <= n).drop("order", "rank")


def bootstrap_means(rows: DataFrame, index: str, value: str, n: int, replicates: int, seed: int) -> DataFrame:
    """Mean of each resample of n rows numbered 0..n-1 by `index`."""
    draws = rows.sparkSession.range(replicates * n).select(F.floor(F.col("id") / F.lit(max(n, 1))).alias("rep"), (F.col("id") % F.lit(max(n, 1))).cast("int" if n <= 1 << 31 else "long").alias("i"))
    draws = draws.select("rep", F.pmod(F.xxhash64(F.lit(seed), "rep", "i"), F.lit(max(n, 1))).alias(index))
    return draws.join(rows.select(index, value), index).groupBy("rep").agg(F.avg(value).alias("mean"))


def cumulated(rows: DataFrame, key: str, weight: str) -> DataFrame:
    """Rows with below and upto, the running sums of weight by key before and with the row: sums inside sampled range partitions, plus those of the partitions before."""
    from gridmill.operators.network import kept

    placed = kept(rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("part", F.spark_partition_id()))
    whole = placed.groupBy("part").agg(F.sum(weight).alias("w"))  # a row for each partition
    whole = whole.select("part", (F.sum("w").over(W.orderBy("part")) - F.col("w")).alias("base"))
    inside = F.sum(weight).over(W.partitionBy("part").orderBy(key).rowsBetween(W.unboundedPreceding, 0))
    return placed.withColumn("upto", inside).join(F.broadcast(whole), "part").withColumn("upto", F.col("upto") + F.col("base")).withColumn("below", F.col("upto") - F.col(weight)).drop("part", "base")


def drawn_with_replacement(rows: DataFrame, key: str, weight: str, n: int, seed: int) -> DataFrame:
    """draw, key: n independent draws of a row, each with probability in proportion to weight (not negative).

    Rows cover a stretch of the running sum and draws fall into it; both meet on
    as many equal cells as there are rows, so no draw sees more than a few.
    """
    from gridmill.operators.network import kept

    spans = kept(cumulated(rows.select(key, F.col(weight).cast("double").alias("w")).where("w > 0"), key, "w"))
    total, cells = spans.agg(F.max("upto"), F.count("*")).first()
    if not cells:
        return rows.sparkSession.range(0).select(F.col("id").alias("draw")).join(rows.select(key), F.lit(False))
    cell = lambda c: F.floor(F.col(c) / F.lit(total) * cells)
    spread = spans.withColumn("cell", F.explode(F.sequence(cell("below"), cell("upto"))))
    draws = rows.sparkSession.range(n).select(F.col("id").alias("draw"), (uniform("replace", seed, F.col("id")) * total).alias("at"))
    met = draws.withColumn("cell", cell("at")).join(spread, "cell").where("at >= below and at < upto")
    # sums of partitions may leave a gap of a rounding error between two rows; the next row fills it
    return draws.select("draw").join(met.groupBy("draw").agg(F.min(key).alias(key)), "draw")


def slots(buildings: DataFrame, n: int, seed: int, weight: str | None = None) -> DataFrame:
    """n households to dwelling slots: building_id, slot, by hashed order. buildings: building_id, capacity, and, if there may be more households than slots, weight.

    Beyond the slots, households go to buildings in proportion to weight, with
    replacement; their slot is null. Without any slot there are none.
    """
    each = buildings.where("capacity > 0").select("building_id", F.explode(F.sequence(F.lit(1), F.col("capacity"))).alias("slot"))
    room = buildings.where("capacity > 0").agg(F.coalesce(F.sum("capacity"), F.lit(0))).first()[0]
    if n > room and weight is not None and room:
        more = drawn_with_replacement(buildings, "building_id", weight, n - room, seed)
        return each.union(more.select("building_id", F.lit(None).cast("int")))
    ranked = stable_ids(each.withColumn("draw", F.xxhash64(F.lit(seed), "building_id", "slot")), ["draw", "building_id", "slot"], "rank")
    return ranked.where(F.col("rank") <= n).select("building_id", "slot")
