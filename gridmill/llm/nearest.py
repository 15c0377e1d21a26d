"""Nearest neighbours by inner product: multiprobe p-stable hashing.

Inner products become distances: vectors are scaled by the largest norm and
given one more component that makes all of them as long, so that the nearest
point is the one of largest inner product. A table hashes points by K rounded
projections on Gaussian directions, each plus a random offset and over a
common width; several tables are independent. A query visits its own bucket and
perturbed ones by rising sum of squared distances from its projections to the
bucket's sides, the estimated order of success. K, the number of tables and the
visits a query makes are fitted: for a bounded number of vectors the true
nearest neighbours among all rows are found exactly, and of the settings whose
visits meet the target share of them the cheapest is taken. Every row is
indexed, in every table. Candidates of all tables are merged and ranked by the
inner product of the original vectors in double precision.

Buckets with many members or visitors are dealt in blocks, so a task holds a
bounded number of vectors whatever the data look like. A query that has met
fewer than k vectors is searched again against all rows, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridmill.llm.bytehash import mix
from gridmill.llm.common import arrow_map, sorted_groups, stored

NEAREST, QUERY_EVERY = 20, 20
#: Vectors that the index is fitted on, those of them whose neighbours are looked up, and the share of these to be met.
SAMPLE, FIT_QUERIES, TARGET_RECALL = 8192, 128, 0.95
#: Members that an average bucket should hold at least, the most visits to a table, and the settings tried.
PER_BUCKET, MOST_VISITS = 64, 1024
WIDTHS, TABLES, PROJECTIONS = (1.0, 2.0, 3.0), (2, 4), (2, 3, 4, 5, 6, 8, 10, 12, 14, 16)
#: Cells of a direction that a query may visit, nearest first.
STEPS = 6
MEMBERS, VISITORS = 2048, 2048
#: Cost of a visit and of an indexed copy, in comparisons of two vectors.
VISIT_COST, COPY_COST = 50, 50


class Tables:
    """Hash functions, and the buckets of points and queries."""

    def __init__(self, directions: np.ndarray, offsets: np.ndarray, width: float):
        """directions: tables x projections x dimensions; offsets: tables x projections, in widths."""
        self.directions, self.offsets, self.width, self.visits = directions, offsets, width, 1

    def _at(self, points: np.ndarray) -> np.ndarray:
        """Tables x points x projections, in widths."""
        return np.einsum("nd,tkd->tnk", points, self.directions) / self.width + self.offsets[:, None]

    def _bucket(self, table: int, cells: np.ndarray) -> np.ndarray:
        """A number for each row of cells; unequal cells that share one only add candidates."""
        h = np.full(cells.shape[:-1], table + 1, dtype=np.uint64)
        for k in range(cells.shape[-1]):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + cells[..., k].astype(np.int64).view(np.uint64))
        return h.view(np.int64)

    def homes(self, points: np.ndarray) -> np.ndarray:
        """The bucket of each point in each table: points x tables."""
        return np.stack([self._bucket(t, np.floor(x)) for t, x in enumerate(self._at(points))], axis=1)

    def probes(self, points: np.ndarray, visits: int) -> list[np.ndarray]:
        """For each table the buckets that a point visits, in order: points x visits, fewer where there are no more."""
        out = []
        for t, x in enumerate(self._at(points)):
            cell = np.floor(x)
            steps = cell[..., None] + np.arange(-STEPS, STEPS + 1)
            away = np.maximum(np.maximum(steps - x[..., None], x[..., None] - steps - 1), 0) ** 2
            near = np.argsort(away, axis=2, kind="stable")[..., :STEPS]
            steps, away = np.take_along_axis(steps, near, 2), np.take_along_axis(away, near, 2)
            # the best of a sum over directions are made of the best of the sums over the first of them
            total, chosen = away[:, 0], steps[:, 0, :, None]
            for k in range(1, x.shape[1]):
                sums = (total[:, :, None] + away[:, None, k]).reshape(len(x), -1)
                best = np.argsort(sums, axis=1, kind="stable")[:, :visits]
                total = np.take_along_axis(sums, best, 1)
                chosen = np.concatenate((np.take_along_axis(chosen, (best // STEPS)[..., None], 1), np.take_along_axis(steps[:, k], best % STEPS, 1)[..., None]), axis=2)
            out.append(self._bucket(t, chosen[:, :visits]))
        return out


class Index:
    """Fitted tables over points that inner products become distances of."""

    def __init__(self, sample: np.ndarray, largest: float, n: int, queries: np.ndarray, asked: np.ndarray, near: np.ndarray, target: float):
        """near: vectors of true neighbours; asked: the row of queries that each belongs to."""
        self.largest = largest
        scaled = sample / largest
        self.long = float(np.median(np.linalg.norm(scaled, axis=1)))
        self.aside = float(np.sqrt(max(0.0, 1 - self.long**2)))
        points, asks, found = self.points(sample), self.asks(queries), self.points(near)
        rng = np.random.default_rng(23)
        dimensions = points.shape[1]
        spread = float(np.sqrt(((points - points.mean(0)) ** 2).sum() / max(len(points), 1) / dimensions)) or 1.0
        most = max(n / PER_BUCKET, 1)
        best = None
        for k in PROJECTIONS:
            directions, offsets = rng.normal(size=(max(TABLES), k, dimensions)), rng.random((max(TABLES), k))
            for width in WIDTHS:
                for tables in TABLES:
                    trial = Tables(directions[:tables], offsets[:tables], width * spread * np.sqrt(dimensions))
                    homes = trial.homes(points)
                    if len(np.unique(homes[:, 0])) > most and k > PROJECTIONS[0]:
                        continue
                    cost = self._fit(trial, homes, asks, asked, found, n, target)
                    if cost is not None and (best is None or cost < best[0]):
                        best = cost, trial
        self.tables = best[1]

    def points(self, x: np.ndarray) -> np.ndarray:
        x = x / self.largest
        return np.concatenate((x, np.sqrt(np.maximum(0, 1 - (x**2).sum(1, keepdims=True)))), axis=1)

    def asks(self, x: np.ndarray) -> np.ndarray:
        """Queries as points: their length does not change the order, so they are put where most vectors are."""
        x = x * (self.long / np.linalg.norm(x, axis=1, keepdims=True))
        return np.concatenate((x, np.full((len(x), 1), self.aside)), axis=1)

    def _fit(self, trial: Tables, homes: np.ndarray, asks: np.ndarray, asked: np.ndarray, found: np.ndarray, n: int, target: float) -> float | None:
        """Set the visits that meet the target. Returns the cost, in comparisons, or None if no number of visits does."""
        probes = trial.probes(asks, MOST_VISITS)
        theirs = trial.homes(found)
        rank = np.full(len(found), MOST_VISITS)
        for t, p in enumerate(probes):
            hit = p[asked] == theirs[:, t, None]
            rank = np.minimum(rank, np.where(hit.any(1), hit.argmax(1), MOST_VISITS))
        need = int(np.quantile(rank, target, method="higher")) if len(rank) else 0
        if need >= MOST_VISITS:
            return None
        trial.visits = need + 1
        compared = visits = 0.0
        for t, p in enumerate(probes):
            names, counts = np.unique(homes[:, t], return_counts=True)
            at = np.minimum(np.searchsorted(names, p[:, : trial.visits]), len(names) - 1)
            met = names[at] == p[:, : trial.visits]
            compared += (counts[at] * met).sum() / len(p) * n / len(homes)
            visits += met.sum() / len(p)
        return n / QUERY_EVERY * (compared + VISIT_COST * visits) + COPY_COST * n * len(probes)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of doubles, short ones with zeros behind."""
    x = np.zeros((len(column), width))
    sizes = np.diff(column.offsets.to_numpy())
    x[np.repeat(np.arange(len(column)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return x


def _best(q: np.ndarray, score: np.ndarray, low: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best of each q: largest score, then least low."""
    order = np.lexsort((low, -score, q))
    q = q[order]
    start = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[place < k]


def _meet(k: int, width: int):
    """A mapInArrow function over rows sorted by block: the k best members of each visitor among the task's blocks."""

    def scores(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(visitor, member, score) that can be among the k best; a score is summed in the same way wherever the pair meets."""
        rough = a @ b.T
        if rough.shape[1] > k:
            slack = 1e-9 * np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1).max()
            i, j = np.nonzero(rough >= (np.partition(rough, -k, axis=1)[:, -k] - slack)[:, None])
        else:
            i, j = (x.ravel() for x in np.indices(rough.shape))
        return i, j, np.concatenate([(a[i[lo : lo + 65536]] * b[j[lo : lo + 65536]]).sum(1) for lo in range(0, len(i), 65536)] or [np.zeros(0)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            q, v, low, score = (np.concatenate(c) for c in zip(*held))
            best = _best(q, score, low, k)
            return tuple(c[best] for c in (q, v, low, score))

        for table, edges, _ in sorted_groups(batches):
            x = _matrix(table["embedding"].combine_chunks(), width)
            ids, low, member = (table[c].to_numpy() for c in ("id", "low", "member"))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                mine = lo + np.flatnonzero(member[lo:hi])
                theirs = lo + np.flatnonzero(~member[lo:hi])
                for at in range(0, len(theirs) if len(mine) else 0, 512):
                    part = theirs[at : at + 512]
                    i, j, score = scores(x[part], x[mine])
                    best = _best(i, score, low[mine[j]], k)
                    held.append((ids[part[i[best]]], ids[mine[j[best]]], low[mine[j[best]]], score[best]))
            if sum(len(h[0]) for h in held) > 1 << 20:
                held = [out()]
                if len(held[0][0]) > 1 << 19:  # many queries: what is known of them goes on to the merge
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.pop()], ["q", "v", "low", "score"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out()], ["q", "v", "low", "score"])

    return run


def _found(members: DataFrame, visitors: DataFrame, k: int, width: int, name: str, per_member: int = MEMBERS, per_visitor: int = VISITORS) -> DataFrame:
    """q, v, low, score: of each visitor the k best among members it shares a bucket with. members: bucket, id, low, embedding; visitors: bucket, id, embedding.

    Members of a large bucket are dealt to blocks and its visitors to chunks;
    each block meets each chunk in a task of its own.
    """
    own = members.groupBy("bucket").agg(F.ceil(F.count("*") / per_member).cast("int").alias("blocks"))
    seen = visitors.groupBy("bucket").agg(F.ceil(F.count("*") / per_visitor).cast("int").alias("chunks"))
    plan = own.join(seen, "bucket")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = members.join(plan, "bucket").select("bucket", F.expr("pmod(hash(id, 1), blocks)").alias("b"), each("chunks").alias("c"), F.lit(True).alias("member"), "id", "low", "embedding")
    theirs = visitors.join(plan, "bucket").select("bucket", each("blocks").alias("b"), F.expr("pmod(hash(id, 2), chunks)").alias("c"), F.lit(False).alias("member"), "id", F.lit(0).cast("long").alias("low"), "embedding")
    dealt = mine.union(theirs).select(F.xxhash64("bucket", "b", "c").alias("block"), "member", "id", "low", "embedding").repartition("block").sortWithinPartitions("block")
    parts = dealt.mapInArrow(_meet(k, width), "q long, v long, low long, score double")
    merged = parts.groupBy("q", "v", "low").agg(F.max("score").alias("score"))
    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "low"))
    return stored(merged.withColumn("place", place).where(F.col("place") <= k).drop("place"), name)


def nearest(vectors: DataFrame, k: int = NEAREST, every: int = QUERY_EVERY, target: float = TARGET_RECALL, sample: int = SAMPLE, per_member: int = MEMBERS, per_visitor: int = VISITORS) -> DataFrame:
    """The k vectors of largest inner product that multiprobe hashing finds for every query.

    vectors: vec_id long, embedding array. Queries are the rows whose vec_id
    `every` divides, candidates all rows of another vec_id. Returns query_id,
    rank from 1, vec_id, score; equal scores rank by vec_id. A vector that is
    null, empty, zero or holds null or non-finite components takes no part, nor
    does a row without vec_id. Vectors of another length than the query's are
    read as if zeros stood behind the shorter. Rows that repeat count once; a
    vec_id with several vectors has each of them, and a list for each as a
    query. Equal vectors are searched as one and listed each. Fewer than k
    candidates are all listed. An empty table gives no rows; other columns,
    of whatever name, are ignored.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    fine = "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind).alias("embedding")).where(fine).distinct()
    # of equal vectors no query needs more than the k least ids besides its own
    first = rows.withColumn("nth", F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    classes = first.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("id"), "embedding", "ids", F.col("ids")[0].alias("low")), "classes")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    width, n, largest = classes.agg(F.max(F.size("embedding")), F.count("*"), F.max(norm)).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    queries = stored(rows.where(F.col("vec_id") % every == 0).join(classes.select("embedding", "id", "ids"), "embedding").select(F.col("vec_id").alias("query_id"), F.col("id").alias("q"), F.size("ids").alias("copies")), "queries")
    asking = stored(classes.join(queries.select(F.col("q").alias("id")).distinct(), "id", "left_semi").select("id", "embedding"), "asking")
    every_one = F.lit(0).cast("long").alias("bucket")

    # what the index is fitted on: a sample by hash, and for some of it the true neighbours among all rows
    chosen = classes.orderBy(F.xxhash64("embedding"), "id").limit(sample).select("id", "embedding").toArrow()
    x = _matrix(chosen["embedding"].combine_chunks(), width)
    some = chosen["id"].to_numpy()[:FIT_QUERIES]
    probe = classes.where(F.col("id").isin(some.tolist())).select(every_one, "id", "embedding")
    known = _found(classes.select(every_one, "id", "low", "embedding"), probe, k + 1, width, "known").where("q <> v")
    known = known.join(classes.select(F.col("id").alias("v"), "embedding"), "v").select("q", "embedding").toArrow()
    asked = np.searchsorted(np.sort(some), known["q"].to_numpy())
    index = spark.sparkContext.broadcast(Index(x, largest, n, x[np.argsort(some)], asked, _matrix(known["embedding"].combine_chunks(), width), target))

    def homes(batch):
        for lo in range(0, len(batch["id"]), 1024):
            part = {c: v.slice(lo, 1024) for c, v in batch.items()}
            buckets = index.value.tables.homes(index.value.points(_matrix(part["embedding"], width)))
            yield {"buckets": pa.array(buckets.tolist(), type=pa.list_(pa.int64())), "id": part["id"], "low": part["low"], "embedding": part["embedding"]}

    def probes(batch):
        step = max(1, (1 << 20) // (index.value.tables.visits * STEPS))
        for lo in range(0, len(batch["id"]), step):
            part = {c: v.slice(lo, step) for c, v in batch.items()}
            visits = np.concatenate(index.value.tables.probes(index.value.asks(_matrix(part["embedding"], width)), index.value.tables.visits), axis=1)
            yield {"buckets": pa.array(visits.tolist(), type=pa.list_(pa.int64())), "id": part["id"], "embedding": part["embedding"]}

    members = stored(arrow_map(classes.select("id", "low", "embedding"), f"buckets array<long>, id long, low long, embedding {kind}", homes), "members")
    visitors = stored(arrow_map(asking, f"buckets array<long>, id long, embedding {kind}", probes), "visitors")
    met = _found(
        members.select(F.explode("buckets").alias("bucket"), "id", "low", "embedding"), visitors.select(F.explode("buckets").alias("bucket"), "id", "embedding"), k + 1, width, "met", per_member, per_visitor
    )

    # a query that met too few is searched against all rows
    have = met.join(classes.select(F.col("id").alias("v"), F.size("ids").alias("n_ids")), "v").groupBy("q").agg(F.sum("n_ids").alias("n_met"), F.count("*").alias("n_classes"))
    short = asking.join(have, F.col("id") == F.col("q"), "left").where((F.coalesce("n_met", F.lit(0)) <= k) & (F.coalesce("n_classes", F.lit(0)) < n))
    short = stored(short.select("id", "embedding"), "short")
    if short.head(1):
        whole = _found(classes.select(every_one, "id", "low", "embedding"), short.select(every_one, "id", "embedding"), k + 1, width, "whole", per_member, per_visitor)
        met = met.join(short.select(F.col("id").alias("q")), "q", "left_anti").union(whole)
    listed = queries.join(met, "q").join(classes.select(F.col("id").alias("v"), "ids"), "v").select("query_id", "q", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    return listed.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_approximate_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
