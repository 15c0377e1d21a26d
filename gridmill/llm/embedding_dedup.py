"""Embedding near-dedup over an inverted multi-index.

Two codebooks, fitted by k-means on the halves of a bounded sample of unit
vectors, cut space into a grid of cells, one for each pair of codewords. Every
vector is indexed in its own cell. As a query it visits cells by rising sum of
squared distances to their two codewords, the order of multi-sequence
traversal. How many cells are visited is set on the sample: partners at
exactly the linking cosine are drawn at random, and the traversal goes on until
the target share of them is met. A cell that no partner can lie in, because
the planes between codewords are too far away, is passed over. Every candidate
is verified by its cosine in double precision.

A pair counts as found if either vector visits the other's cell. Cells with
many members or visitors are dealt in blocks, so a task holds a bounded number
of vectors whatever the data look like.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.common import arrow_map, connected_components, sorted_groups, stored, unite

COSINE = 0.98
#: Rows of the sample that codebooks and traversal length are fitted on.
SAMPLE = 8192
TARGET_RECALL = 0.98
#: Vectors that an average cell should hold, and the most codewords of a half.
PER_CELL, MOST_CODES = 8, 1024
MEMBERS, VISITORS = 1024, 4096


def _kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), size=k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmin((centre**2).sum(1) - 2 * x[lo : lo + 1024] @ centre.T, axis=1) for lo in range(0, len(x), 1024)])
        n = np.bincount(near, minlength=k)
        for d in range(x.shape[1]):
            centre[:, d] = np.where(n > 0, np.bincount(near, x[:, d], k) / np.maximum(n, 1), centre[:, d])
    return centre


class MultiIndex:
    """Codebooks of both halves, and the number of cells a query visits."""

    def __init__(self, sample: np.ndarray, n_rows: int, cosine: float = COSINE, target: float = TARGET_RECALL):
        self.half = sample.shape[1] // 2
        self.reach = 2 - 2 * cosine  # squared distance of unit vectors at this cosine
        k = int(min(MOST_CODES, max(4, np.sqrt(n_rows / PER_CELL / 8)), max(len(sample) // 4, 1)))
        self.books = [_kmeans(sample[:, : self.half], k), _kmeans(sample[:, self.half :], k)]
        self.gaps = [np.sqrt(((b[:, None] - b[None]) ** 2).sum(2)) for b in self.books]
        self.codes = k
        self.visits = self._fit(sample, cosine, target)

    def _distances(self, x: np.ndarray) -> list[np.ndarray]:
        parts = (x[:, : self.half], x[:, self.half :])
        return [(p**2).sum(1)[:, None] + (b**2).sum(1) - 2 * p @ b.T for p, b in zip(parts, self.books)]

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = self._distances(x)
        return a.argmin(1) * self.codes + b.argmin(1)

    def _fit(self, sample: np.ndarray, cosine: float, target: float) -> int:
        rng = np.random.default_rng(11)
        x = sample[:2048]
        side = rng.normal(size=x.shape)
        side -= (side * x).sum(1, keepdims=True) * x
        side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
        partner = self.home(cosine * x + np.sqrt(1 - cosine**2) * side)
        ranks = []
        step = max(1, (1 << 22) // self.codes**2)  # so many vectors' grids are held at once
        for lo in range(0, len(x), step):
            a, b = self._distances(x[lo : lo + step])
            total = (a[:, :, None] + b[:, None, :]).reshape(len(a), -1)
            ranks.append((total < total[np.arange(len(a)), partner[lo : lo + step]][:, None]).sum(1) + 1)
        return int(np.quantile(np.concatenate(ranks), target, method="higher"))

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cells, valid), both n x visits, nearest first; column 0 is the home cell."""
        a, b = self._distances(x)
        ranks = [np.argsort(d, axis=1) for d in (a, b)]
        sorted_d = [np.take_along_axis(d, r, 1) for d, r in zip((a, b), ranks)]
        # the v nearest pairs have ranks (i, j) with (i + 1) * (j + 1) <= v
        i, j = np.nonzero(np.outer(np.arange(1, self.codes + 1), np.arange(1, self.codes + 1)) <= self.visits)
        total = sorted_d[0][:, i] + sorted_d[1][:, j]
        v = min(self.visits, total.shape[1])
        best = np.argsort(total, axis=1, kind="stable")[:, :v]
        first, second = (np.take_along_axis(r, k[best], 1) for r, k in zip(ranks, (i, j)))
        far = np.zeros(best.shape)
        for d, r, chosen, gap in zip((a, b), ranks, (first, second), self.gaps):
            own = r[:, :1]
            beyond = np.take_along_axis(d, chosen, 1) - np.take_along_axis(d, own, 1)
            plane = beyond / np.maximum(2 * gap[own, chosen], 1e-12)
            far += np.where(chosen == own, 0, plane) ** 2
        return first * self.codes + second, far <= self.reach + 1e-9


def _unit(column: pa.Array, width: int) -> np.ndarray:
    x = np.zeros((len(column), width))
    sizes = np.diff(column.offsets.to_numpy())
    x[np.repeat(np.arange(len(column)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x /= np.maximum(np.abs(x).max(axis=1, keepdims=True), np.finfo(float).tiny)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _compare(members, visitors, cosine: float, across: bool) -> dict:
    """Links inside one block of a cell. across: members come in two sides, and only pairs between sides count.

    root is the least id of the group that the block's links join the vector
    to; least neighbours alone would not keep a group connected.
    """
    ids, n, root = [], [], []

    def link(a: dict, b: dict, keep) -> None:
        start = 0 if a is b else len(a["id"])  # where b's nodes begin
        node = a["id"] if a is b else np.concatenate([a["id"], b["id"]])
        label, count = np.arange(len(node)), np.zeros(len(node), dtype=np.int64)
        for lo in range(0, len(a["id"]), 512):
            i, j = np.nonzero(a["x"][lo : lo + 512] @ b["x"].T >= cosine)
            i += lo
            ok = keep(i, j)
            i, j = i[ok], j[ok]
            for p, copies in ((i, b["copies"][j]), (j + start, a["copies"][i])):
                count += np.bincount(p, copies.astype(float), minlength=len(node)).astype(np.int64)
            unite(label, i, j + start)
        hit = np.flatnonzero(count)
        least = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(least, label, node)
        ids.append(node[hit])
        n.append(count[hit])
        root.append(least[label[hit]])

    if across:
        one, two = ({k: v[members["side"] == s] for k, v in members.items()} for s in (0, 1))
        link(one, two, lambda i, j: np.ones(len(i), dtype=bool))
    elif len(members["id"]):
        if members["first"].any():
            link(members, members, lambda i, j: i < j)
        if len(visitors["id"]):

            def once(i, j):
                """Pairs that the member's own visits also find are left to the lesser cell."""
                again = (members["visits"][j] == visitors["home"][i][:, None]).any(1)
                return ~again | (members["home"][j] < visitors["home"][i])

            link(visitors, members, once)
    ids, n, root = (np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for v in (ids, n, root))
    return {"id": ids, "n": n, "root": root}


def embedding_dedup(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, target: float = TARGET_RECALL, members: int = MEMBERS, visitors: int = VISITORS) -> DataFrame:
    """Link vectors of equal label whose cosine is at least `cosine`.

    vectors: vec_id long, embedding array, label. Returns vec_id, n_links,
    component_id (smallest vec_id reachable), kept, a row for each input row.
    A vector that is null, empty, zero or holds null or non-finite components,
    and one whose label is null, links with nothing. Vectors of different
    lengths don't link. Equal vectors of one label are compared as one and
    counted as many. An empty table gives no rows; other columns, of whatever
    name, are ignored.
    """
    spark = vectors.sparkSession
    # floats travel as they are; cosines are taken in double precision either way
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = vectors.select("vec_id", F.col("embedding").cast(kind).alias("embedding"), "label")
    fine = "label is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)"
    marked = rows.withColumn("fine", F.coalesce(F.expr(fine), F.lit(False)))
    classes = marked.where("fine").groupBy("label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("low"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    width, count = classes.agg(F.max(F.size("embedding")), F.count("*")).first()
    if not count:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    width += width % 2
    chosen = classes.orderBy(F.xxhash64("label", "embedding"), "id").limit(sample).select("embedding").toArrow()["embedding"].combine_chunks()
    index = spark.sparkContext.broadcast(MultiIndex(_unit(chosen, width), count, cosine, target))

    def assign(batch):
        for lo in range(0, len(batch["id"]), 1024):
            part = {k: v.slice(lo, 1024) for k, v in batch.items()}
            cells, valid = index.value.cells(_unit(part["embedding"], width))
            visits = pa.array([c[1:][v[1:]].tolist() for c, v in zip(cells, valid)], type=pa.list_(pa.int32()))
            yield {"space": part["space"], "id": part["id"], "copies": part["copies"], "embedding": part["embedding"], "home": cells[:, 0].astype(np.int32), "visits": visits}

    schema = f"space long, id long, copies long, embedding {kind}, home int, visits array<int>"
    spaced = classes.select(F.xxhash64("label", F.size("embedding")).alias("space"), "id", "copies", "embedding")
    placed = stored(arrow_map(spaced, schema, assign), "placed")
    own = placed.groupBy("space", F.col("home").alias("cell")).agg(F.count("*").alias("n_members"))
    seen = placed.select("space", F.explode("visits").alias("cell")).groupBy("space", "cell").agg(F.count("*").alias("n_visitors"))
    plan = own.join(seen, ["space", "cell"], "left").select("space", "cell", F.ceil(F.col("n_members") / members).cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.coalesce("n_visitors", F.lit(0)) / visitors)).cast("int").alias("chunks"))
    mine = "pmod(hash(id, 1), blocks)"
    tag = "named_struct('b', {b}, 'c', {c}, 'side', {side}, 'first', {first})"
    to = f"""concat(
        transform(sequence(0, chunks - 1), c -> {tag.format(b=f"concat('', {mine})", c="c", side=0, first="c = 0")}),
        transform(filter(sequence(0, blocks - 1), o -> o <> {mine}),
            o -> {tag.format(b=f"concat(least(o, {mine}), '-', greatest(o, {mine}))", c=0, side=f"int({mine} > o)", first="false")}))"""
    as_member = placed.withColumn("cell", F.col("home")).join(plan, ["space", "cell"]).withColumn("to", F.expr(to)).withColumn("member", F.lit(True))
    to = f"transform(sequence(0, blocks - 1), o -> {tag.format(b="concat('', o)", c='pmod(hash(id, 2), chunks)', side=0, first='false')})"
    as_visitor = placed.withColumn("cell", F.explode("visits")).withColumn("visits", F.lit(None).cast("array<int>")).join(plan, ["space", "cell"]).withColumn("to", F.expr(to)).withColumn("member", F.lit(False))
    dealt = as_member.unionByName(as_visitor).withColumn("to", F.explode("to"))
    dealt = dealt.select(F.xxhash64("space", "cell", "to.b", "to.c").alias("block"), "member", "to.side", "to.first", F.col("to.b").contains("-").alias("across"), "id", "copies", "home", "visits", "embedding")
    met = dealt.repartition("block").sortWithinPartitions("block")
    found = stored(met.mapInArrow(_blocks(cosine, width), "id long, n long, root long"), "links")
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    component = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    joined = classes.join(links, "id", "left").join(component, F.col("id") == F.col("node"), "left")
    joined = joined.withColumn("component", F.coalesce("component", "id"))
    low = joined.groupBy("component").agg(F.min("low").alias("component_id"))
    done = joined.join(low, "component").select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    good = marked.where("fine").join(done, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = marked.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _blocks(cosine: float, width: int):
    """A mapInArrow function over rows sorted by block."""

    def arrays(table: pa.Table) -> dict:
        table = table.combine_chunks()
        flat = lambda c: table[c].combine_chunks().to_numpy(zero_copy_only=False)
        out = {c: flat(c) for c in ("id", "copies", "home", "side", "first")}
        out["x"] = _unit(table["embedding"].combine_chunks(), width) if len(table) else np.zeros((0, width))
        lists = table["visits"].to_pylist()
        out["visits"] = np.full((len(table), max([1, *(len(v or ()) for v in lists)])), -1, dtype=np.int64)
        for i, v in enumerate(lists):
            out["visits"][i, : len(v or ())] = v or []
        return out

    def settle(table: pa.Table) -> pa.RecordBatch:
        is_member = table["member"].combine_chunks()
        sides = arrays(table.filter(is_member)), arrays(table.filter(pa.compute.invert(is_member)))
        return pa.RecordBatch.from_pydict(_compare(*sides, cosine, table["across"][0].as_py()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edge, _ in sorted_groups(batches):
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                yield settle(table.slice(lo, hi - lo))

    return run


def op1_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
