"""Raster cells as tables: row 0 is north, empty cells have no row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def grid_cells(points: DataFrame, x0: float, y1: float, size: float) -> DataFrame:
    """row and col of each point."""
    return points.withColumn("row", F.floor((F.lit(y1) - F.col("y")) / size).cast("long")).withColumn("col", F.floor((F.col("x") - F.lit(x0)) / size).cast("long"))


def cell_stats(points: DataFrame, x0: float, y1: float, size: float, value: str) -> DataFrame:
    """max, min, mean, sum and count of the points of each cell."""
    v = F.col(value)
    return grid_cells(points, x0, y1, size).groupBy("row", "col").agg(F.max(v).alias("max_v"), F.min(v).alias("min_v"), F.avg(v).alias("mean_v"), F.sum(v).alias("sum_v"), F.count(v).alias("n"))


def tiles(points: DataFrame, size: float) -> DataFrame:
    """Aligned half-open tiles of the points' plane, as a name."""
    return points.withColumn("tile", F.format_string("r%d_c%d", F.floor(F.col("y") / size), F.floor(F.col("x") / size)))


def surface_model(points: DataFrame, x0: float, y1: float, size: float, ground: int) -> DataFrame:
    """Per cell with points: ground height (mean of its ground points, gaps filled from around), surface (largest of all, not below ground) and height above ground."""
    cells = grid_cells(points, x0, y1, size).groupBy("row", "col").agg(F.avg(F.when(F.col("cls") == ground, F.col("z"))).alias("dtm"), F.max("z").alias("top"))
    from gridmill.operators.network import kept

    cells = kept(cells)
    cells = cells.drop("dtm").join(filled_frame(cells.select("row", "col", "dtm"), "dtm"), ["row", "col"])
    return cells.select("row", "col", "dtm", F.greatest("top", "dtm").alias("dsm"), F.greatest(F.greatest("top", "dtm") - F.col("dtm"), F.lit(0.0)).alias("height"))


def neighbours(cells: DataFrame, radius: int = 1, centre: bool = True) -> DataFrame:
    """Each cell's row, told to every cell around it: row, col of the receiver; dr, dc; the sender's columns."""
    span = F.sequence(F.lit(-radius), F.lit(radius))
    told = cells.withColumn("dr", F.explode(span)).withColumn("dc", F.explode(span))
    if not centre:
        told = told.where("dr <> 0 or dc <> 0")
    return told.withColumn("row", F.col("row") - F.col("dr")).withColumn("col", F.col("col") - F.col("dc"))


def gap_fill(cells: DataFrame, rows: int, cols: int, value: str, passes: int = 3) -> DataFrame:
    """Every cell of a rows x cols grid; empty ones take the mean of their filled neighbours, pass after pass, and what is left the nearest filled cell (by row, then column, on ties). A cell outside the grid is an error."""
    outside = F.raise_error(F.format_string("cell (%d, %d) lies outside the grid", "row", "col"))
    cells = cells.withColumn(value, F.when((F.col("row") < 0) | (F.col("row") >= rows) | (F.col("col") < 0) | (F.col("col") >= cols), outside.cast("double")).otherwise(F.col(value)))
    frame = cells.sparkSession.range(rows * cols).select(F.floor(F.col("id") / cols).alias("row"), (F.col("id") % cols).alias("col"))
    full = frame.withColumn("framed", F.lit(True)).join(cells.select("row", "col", value), ["row", "col"], "full").where(F.col("framed") | F.col(value).isNotNull()).drop("framed")
    for _ in range(passes):
        around = neighbours(full.where(F.col(value).isNotNull()), centre=False).groupBy("row", "col").agg(F.avg(value).alias("around"))
        full = full.join(around, ["row", "col"], "left").select("row", "col", F.coalesce(value, "around").alias(value))
    from gridmill.operators.network import kept
    from gridmill.operators.spatial import nearest

    full = kept(full)
    place = F.col("row") * cols + F.col("col")
    at = lambda df, x, z, key: df.select(place.alias(key), F.col("row").cast("double").alias(z), F.col("col").cast("double").alias(x))
    empty, filled = full.where(F.col(value).isNull()), full.where(F.col(value).isNotNull())
    near = nearest(at(empty, "x", "z", "place"), at(filled, "x2", "z2", "source"), "place", "source", passes + 2.0, digits=9).select("place", "source")
    given = near.join(filled.select(place.alias("source"), F.col(value).alias("given")), "source").select("place", "given")
    return full.withColumn("place", place).join(given, "place", "left").select("row", "col", F.coalesce(value, "given").alias(value))


def filled_frame(cells: DataFrame, value: str, passes: int = 3) -> DataFrame:
    """:func:`gap_fill` over the frame that the cells themselves span. No cells give no cells."""
    low = cells.agg(F.min("row"), F.min("col"), F.max("row"), F.max("col")).first()
    if low[0] is None:
        return cells
    r0, c0 = low[0], low[1]
    framed = cells.select((F.col("row") - r0).alias("row"), (F.col("col") - c0).alias("col"), value)
    return gap_fill(framed, low[2] - r0 + 1, low[3] - c0 + 1, value, passes).select((F.col("row") + r0).alias("row"), (F.col("col") + c0).alias("col"), value)


def box_mean(cells: DataFrame, radius: int, value: str) -> DataFrame:
    """Sum and count over a square window: a pass along rows, then one along columns."""
    along = W.partitionBy("row").orderBy("col").rangeBetween(-radius, radius)
    first = cells.select("row", "col", F.sum(value).over(along).alias("s"), F.count(value).over(along).alias("n"))
    down = W.partitionBy("col").orderBy("row").rangeBetween(-radius, radius)
    return first.select("row", "col", F.sum("s").over(down).alias("window_sum"), F.sum("n").over(down).alias("window_n"))


def dense(cells: DataFrame, values: list[str]) -> DataFrame:
    """Every cell of the rows and columns that have any, with 0 for values of empty ones."""
    frame = cells.select("row").distinct().join(F.broadcast(cells.select("col").distinct()))
    return frame.join(cells, ["row", "col"], "left").na.fill(0, values)


def window_ratio(cells: DataFrame, radius: int, top: str, bottom: str) -> DataFrame:
    """Sum of one value over that of another in a square window around each cell; null where the other is 0."""
    a, b = box_mean(cells, radius, top), box_mean(cells, radius, bottom)
    both = a.select("row", "col", F.col("window_sum").alias("a")).join(b.select("row", "col", F.col("window_sum").alias("b")), ["row", "col"])
    return both.select("row", "col", (F.col("a") / F.nullif(F.col("b").cast("double"), F.lit(0.0))).alias("ratio"))


def plane_residual(cells: DataFrame, value: str) -> DataFrame:
    """Spread of a full 3x3 window around the plane fitted through it, from sums in closed form."""
    v = F.col(value)
    s = neighbours(cells).groupBy("row", "col").agg(F.count("*").alias("n"), F.sum(v).alias("sz"), F.sum(v * v).alias("szz"), F.sum(v * F.col("dr")).alias("szr"), F.sum(v * F.col("dc")).alias("szc")).where("n = 9")
    left = F.col("szz") - F.col("sz") * F.col("sz") / 9 - (F.col("szr") * F.col("szr") + F.col("szc") * F.col("szc")) / 6
    return s.select("row", "col", F.sqrt(F.greatest(left, F.lit(0.0)) / 9).alias("residual"))


def local_maxima(cells: DataFrame, value: str, radius: int) -> DataFrame:
    """Cells that no cell within the radius exceeds; of equal ones the first by row, then column."""
    told = neighbours(cells.select("row", "col", F.col(value).alias("v"), F.col("row").alias("r2"), F.col("col").alias("c2")), radius, centre=False)
    best = told.groupBy("row", "col").agg(F.max(F.struct("v", (-F.col("r2")).alias("a"), (-F.col("c2")).alias("b"))).alias("best"))
    mine = F.struct(F.col(value).alias("v"), (-F.col("row")).alias("a"), (-F.col("col")).alias("b"))
    return cells.join(best, ["row", "col"], "left").where(F.col("best").isNull() | (mine > F.col("best"))).select("row", "col", value)


def bilinear(points: DataFrame, cells: DataFrame, key: str, rows: int, cols: int, value: str) -> DataFrame:
    """Value at fractional (fr, fc), from the four cells around it, clamped at the edge."""
    r, c = (F.least(F.greatest(F.floor(f), F.lit(0)), F.lit(n - 2)) for f, n in (("fr", rows), ("fc", cols)))
    p = points.select(key, r.alias("r"), c.alias("c"), F.least(F.greatest(F.col("fr") - r, F.lit(0.0)), F.lit(1.0)).alias("a"), F.least(F.greatest(F.col("fc") - c, F.lit(0.0)), F.lit(1.0)).alias("b"))
    corner = lambda i, j: F.struct((F.col("r") + i).alias("row"), (F.col("c") + j).alias("col"), ((F.col("a") if i else 1 - F.col("a")) * (F.col("b") if j else 1 - F.col("b"))).alias("w"))
    four = p.select(key, F.explode(F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)])).alias("k")).select(key, "k.*")
    return four.join(cells.select("row", "col", value), ["row", "col"]).groupBy(key).agg(F.sum(F.col("w") * F.col(value)).alias(value))


def best_shift(mask: DataFrame, other: DataFrame, reach: int) -> DataFrame:
    """One row: the shift of `mask` within +-reach cells with the greatest overlap ratio, the first in (dr, dc) order on ties, and the ratio unshifted."""
    span = F.sequence(F.lit(-reach), F.lit(reach))
    moved = mask.select("row", "col").withColumn("dr", F.explode(span)).withColumn("dc", F.explode(span))
    met = moved.select((F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), "dr", "dc").join(other.select("row", "col"), ["row", "col"]).groupBy("dr", "dc").agg(F.count("*").alias("inter"))
    sizes = mask.agg(F.count("*").alias("na")).join(F.broadcast(other.agg(F.count("*").alias("nb"))))
    ratio = met.join(F.broadcast(sizes)).withColumn("iou", F.round(F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter")), 6))
    best = F.max_by(F.struct("dr", "dc"), F.struct("iou", -F.col("dr"), -F.col("dc")))
    return ratio.agg(best.alias("s"), F.max("iou").alias("iou"), F.coalesce(F.max(F.when((F.col("dr") == 0) & (F.col("dc") == 0), F.col("iou"))), F.lit(0.0)).alias("iou_unshifted")).select("s.dr", "s.dc", "iou", "iou_unshifted")


def exact_quantiles(rows: DataFrame, shares: list[float], most: int = 65536, bins: int = 1024) -> DataFrame:
    """part, share, value: linearly interpolated quantiles of each part, as `percentile` has them, without a part's values in one place.

    rows: part (not null), v (no null, no NaN). Each rank is looked for in a
    range of values: counts of equal slices tell the slice it is in, whose least
    and largest values are the next range, until no more than `most` rows are in
    it; these are sorted.
    """
    from gridmill.operators.network import kept

    rows = kept(rows.select("part", F.col("v").cast("double").alias("v")))
    ends = rows.groupBy("part").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    place = F.col("share") * (F.col("n") - 1)
    goals = ends.withColumn("share", F.explode(F.array(*[F.lit(float(q)) for q in shares]))).withColumn("above", F.explode(F.array(F.lit(0), F.lit(1))))
    goals = kept(goals.select("part", "share", "above", (place - F.floor(place)).alias("rest"), F.least(F.floor(place) + F.col("above"), F.col("n") - 1).alias("k"), "lo", "hi", F.col("n").alias("inside")))
    wide = (F.col("lo") < F.col("hi")) & (F.col("inside") > most)
    while not goals.where(wide).isEmpty():
        ranges = goals.where(wide).select("part", "lo", "hi").distinct()
        slice_ = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins), F.lit(bins - 1))
        counts = rows.join(ranges, "part").where("v between lo and hi").groupBy("part", "lo", "hi", slice_.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.sum("c").over(W.partitionBy("part", "lo", "hi").orderBy("bin"))  # `bins` rows at most
        counts = counts.withColumn("below", upto - F.col("c"))
        narrowed = goals.where(wide).join(counts, ["part", "lo", "hi"]).where((F.col("k") >= F.col("below")) & (F.col("k") < F.col("below") + F.col("c")))
        narrowed = narrowed.select("part", "share", "above", "rest", (F.col("k") - F.col("below")).alias("k"), F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("c").alias("inside"))
        goals = kept(goals.where(~wide).union(narrowed))
    order = F.row_number().over(W.partitionBy("part", "share", "above").orderBy("v"))
    near = rows.join(goals.where("lo < hi"), "part").where("v between lo and hi").withColumn("at", order).where("at = k + 1").select("part", "share", "above", "rest", "v")
    found = near.union(goals.where("lo = hi").select("part", "share", "above", "rest", F.col("lo")))
    pair = found.groupBy("part", "share").agg(F.max(F.when(F.col("above") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("above") == 1, F.col("v"))).alias("b"), F.max("rest").alias("rest"))
    return pair.select("part", "share", (F.col("a") + (F.col("b") - F.col("a")) * F.col("rest")).alias("value"))


def error_summary(df: DataFrame, error: str, by: list[str], pair: tuple[str, str] | None = None) -> DataFrame:
    """n, median, mean, MAE, RMSE, share within 1 and 2, p5 and p95, for all and for each value of each column of `by`; with a pair of columns also their correlation. Rows without an error (null or NaN) don't count."""
    e = F.col("v")
    named = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in by]
    two = [F.col(c).cast("double").alias(n) for c, n in zip(pair, ("left", "right"))] if pair else []
    rows = df.where(F.col(error).isNotNull() & ~F.isnan(F.col(error).cast("double"))).select(F.explode(F.array(F.lit("all"), *named)).alias("part"), F.col(error).cast("double").alias("v"), *two)
    sums = [F.count(e).alias("n"), F.avg(e).alias("mean"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg((F.abs(e) <= 1).cast("int")).alias("within_1"), F.avg((F.abs(e) <= 2).cast("int")).alias("within_2")]
    agg = rows.groupBy("part").agg(*sums, *([F.corr("left", "right").alias("corr")] if pair else []))
    q = exact_quantiles(rows, [0.05, 0.5, 0.95])
    q = q.groupBy("part").agg(*[F.max(F.when(F.col("share") == s, F.col("value"))).alias(n) for s, n in ((0.5, "median"), (0.05, "p5"), (0.95, "p95"))])
    return agg.join(q, "part").select("part", "n", "median", "mean", "mae", "rmse", "within_1", "within_2", "p5", "p95", *(["corr"] if pair else []))
