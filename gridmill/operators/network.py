"""Road network tables and graph jobs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder on a local master, and an error on a cluster."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/gridmill-{spark.sparkContext.applicationId}"


def kept(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read back, to cut the lineage of a loop."""
    path = f"{shared_folder(df.sparkSession)}/rounds/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what :func:`kept` wrote and no later round reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.kept_path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def ends(edges: DataFrame, *columns: str) -> DataFrame:
    """A row for both ends of each edge: node_id, other, columns."""
    here = edges.select(F.col("u").alias("node_id"), F.col("v").alias("other"), *columns)
    return here.union(edges.select(F.col("v"), F.col("u"), *columns))


def network_flags(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Neighbours of each node over both directions, and whether it is an intersection (three or more)."""
    n = ends(edges).groupBy("node_id").agg(F.countDistinct("other").alias("neighbours"))
    return nodes.select("node_id").join(n, "node_id", "left").na.fill(0, ["neighbours"]).withColumn("intersection", F.col("neighbours") >= 3)


def local_nodes(nodes: DataFrame, edges: DataFrame, freeways: list[str]) -> DataFrame:
    """Nodes that a road other than a freeway touches."""
    return nodes.join(ends(edges.where(~F.col("highway").isin(freeways))).select("node_id"), "node_id", "left_semi")


def undirected(edges: DataFrame, way: str = "name", digits: int = 0) -> DataFrame:
    """One row for each pair of ends, way and rounded length: lanes of both directions added up, name of the least edge."""
    pair = edges.withColumn("a", F.least("u", "v")).withColumn("b", F.greatest("u", "v")).withColumn("way", F.col(way)).withColumn("length", F.round(F.col("length_m").cast("double"), digits))
    return pair.groupBy("a", "b", "way", "length").agg(F.sum("lanes").alias("lanes"), F.min_by("name", "edge_idx").alias("name"), F.count("*").alias("directions"))


def cheapest_edges(edges: DataFrame, cost: str, least: float = 0.001) -> DataFrame:
    """Per (u, v) the edge of least cost, the first on ties; costs are at least `least`."""
    c = F.greatest(F.col(cost).cast("double"), F.lit(least))
    return edges.groupBy("u", "v").agg(F.min_by("edge_idx", F.struct(c, F.col("edge_idx"))).alias("edge_idx"), F.min(c).alias("cost"))


def signals(nodes: DataFrame, edges: DataFrame, major: list[str], ramps: list[str], arterial: list[str], least: int = 3) -> DataFrame:
    """Signals of nodes: as the source has them (signalized), or, where it has none at all, inferred; only junctions of `least` neighbours have one.

    Inferred where two or more differently named major roads meet, or a ramp
    meets an arterial.
    """
    kind = F.col("highway")
    met = ends(edges, "highway", "name").groupBy("node_id").agg(F.countDistinct(F.when(kind.isin(major), F.col("name"))).alias("roads"), (F.max(kind.isin(ramps)) & F.max(kind.isin(arterial))).alias("ramp"), F.countDistinct("other").alias("neighbours"))
    given = not nodes.where("signalized").isEmpty()
    flag = F.col("signalized") if given else (F.col("roads") >= 2) | F.col("ramp")
    return nodes.join(met, "node_id", "left").select("node_id", F.coalesce(flag & (F.col("neighbours") >= least), F.lit(False)).alias("signal"))


def junction_ends(edges: DataFrame, least: int = 3) -> DataFrame:
    """Nodes where `least` or more edge ends meet, with the (edge, starts here) list."""
    both = edges.select("edge_idx", F.explode(F.array(F.struct(F.col("u").alias("node_id"), F.lit(True).alias("starts")), F.struct(F.col("v").alias("node_id"), F.lit(False).alias("starts")))).alias("e"))
    met = both.groupBy(F.col("e.node_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("edge_idx", "e.starts"))).alias("ends"))
    return met.where(F.size("ends") >= least)


def distances(edges: DataFrame, anchors: DataFrame, cost: str, max_rounds: int = 1000) -> DataFrame:
    """Least cost from every node to each anchor, with the edge to take first: anchor, node_id, dist, next_edge.

    Rounds of relaxation move outwards from what changed last; unreachable
    nodes have no row. Bounded by max_rounds; raises if they don't suffice.
    """
    step = cheapest_edges(edges, cost).select(F.col("u").alias("from"), F.col("v").alias("head"), "edge_idx", "cost")
    best = kept(anchors.select(F.col("node_id").alias("anchor"), "node_id").distinct().withColumn("dist", F.lit(0.0)).withColumn("next_edge", F.lit(None).cast("long")))
    front = best
    for _ in range(max_rounds):
        if front.isEmpty():
            return best
        offered = front.join(step, F.col("node_id") == F.col("head")).select("anchor", F.col("from").alias("node_id"), (F.col("dist") + F.col("cost")).alias("dist"), F.col("edge_idx").alias("next_edge"))
        merged = best.withColumn("old", F.lit(True)).union(offered.withColumn("old", F.lit(False)))
        least = merged.groupBy("anchor", "node_id").agg(F.min(F.struct(F.col("dist"), (~F.col("old")).alias("new"), F.col("next_edge"))).alias("m"))
        old, best = best, kept(least.select("anchor", "node_id", "m.dist", "m.next_edge", F.col("m.new").alias("new")))
        path = best.kept_path
        front = best.where("new").drop("new")
        best = best.drop("new")
        best.kept_path = path
        forget(old)
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def paths(tree: DataFrame, edges: DataFrame, starts: DataFrame, max_steps: int = 1000) -> DataFrame:
    """Edges from each start (anchor, node_id) to its anchor along a distance tree: anchor, start, path."""
    hop = tree.where("next_edge is not null").join(edges.select(F.col("edge_idx").alias("next_edge"), F.col("v").alias("head")), "next_edge").select("anchor", F.col("node_id").alias("at"), "next_edge", "head")
    hop = kept(hop)
    walk = starts.select("anchor", F.col("node_id").alias("start"), F.col("node_id").alias("at"), F.array().cast("array<long>").alias("path"))
    done = None
    for i in range(max_steps):
        arrived = walk.where(F.col("at") == F.col("anchor")).select("anchor", "start", "path")
        done = arrived if done is None else done.union(arrived)
        left = walk.where(F.col("at") != F.col("anchor"))
        walk = kept(left.join(hop, ["anchor", "at"]).select("anchor", "start", F.col("head").alias("at"), F.concat("path", F.array("next_edge")).alias("path")))
        if i % 8 == 7:
            done = kept(done)
        if walk.isEmpty():
            return done
    raise RuntimeError(f"a path is longer than {max_steps} edges")


def connected(edges: DataFrame) -> DataFrame:
    """node_id, component (least node) of every node of undirected edges (u, v), in rounds that grow with the logarithm of the longest path."""
    now, before = kept(edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).where("a <> b").distinct()), None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = kept(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).union(root).distinct())
        forget(now)
        now = after
    roots = now.select(F.col("b").alias("node_id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node_id"), F.col("b").alias("component")).union(roots)


def strong_components_two_way(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """As strong_components, for networks that are mostly two-way: what two-way links join is one node of a smaller graph first."""
    pairs = kept(edges.select("u", "v").where("u <> v").distinct())
    mutual = pairs.where("u < v").join(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"])
    every = ends(pairs).select("node_id").distinct()
    joined = connected(mutual)
    clump = kept(every.join(joined, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("clump")))
    to = lambda c: clump.select(F.col("node_id").alias(c), F.col("clump").alias(f"{c}2"))
    between = kept(pairs.join(to("u"), "u").join(to("v"), "v").where("u2 <> v2").select(F.col("u2").alias("u"), F.col("v2").alias("v")).distinct())
    if between.isEmpty():
        return clump.select("node_id", F.col("clump").alias("component"))
    over = strong_components(between, max_rounds).select(F.col("node_id").alias("clump"), "component")
    placed = clump.join(over, "clump", "left").select("node_id", F.coalesce("component", "clump").alias("c"))
    least = placed.groupBy("c").agg(F.min("node_id").alias("component"))
    return placed.join(least, "c").select("node_id", "component")


def _reached(edges: DataFrame, label: DataFrame, forward: bool, max_rounds: int) -> DataFrame:
    """Least label among the nodes that reach each node (forward), or that it reaches."""
    a, b = ("u", "v") if forward else ("v", "u")
    step = edges.select(F.col(a).alias("node_id"), F.col(b).alias("head")).distinct()
    before = None
    for _ in range(max_rounds):
        state = label.agg(F.count("*"), F.bit_xor(F.xxhash64("node_id", "label"))).first()
        if state == before:
            return label
        before = state
        told = label.join(step, "node_id").select(F.col("head").alias("node_id"), "label")
        old, label = label, kept(label.union(told).groupBy("node_id").agg(F.min("label").alias("label")))
        if hasattr(old, "kept_path"):
            forget(old)
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def strong_components(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """node_id, component (least node of its strongly connected component).

    Colours spread forwards from the least node that reaches a node; within a
    colour, what reaches the colour's own node backwards is its component.
    Settled nodes leave, and the rest goes round again.
    """
    edges = kept(edges.select("u", "v").where("u <> v").distinct())
    left = kept(ends(edges).select("node_id").distinct())
    done = None
    for _ in range(max_rounds):
        if left.isEmpty():
            return done
        colour = _reached(edges, left.withColumn("label", F.col("node_id")), True, max_rounds)
        same = edges.join(colour.select(F.col("node_id").alias("u"), F.col("label").alias("cu")), "u").join(colour.select(F.col("node_id").alias("v"), F.col("label").alias("cv")), "v").where("cu = cv").select("u", "v")
        root = colour.where("node_id = label")
        back = root
        while True:
            told = back.join(same, back.node_id == same.v).select(F.col("u").alias("node_id"), "label")
            more = kept(back.union(told).distinct())
            if more.count() == back.count():
                break
            back = more
        found = back.select("node_id", F.col("label").alias("component"))
        done = found if done is None else kept(done.union(found))
        left = kept(left.join(found, "node_id", "left_anti"))
        edges = kept(edges.join(left.select(F.col("node_id").alias("u")), "u", "left_semi").join(left.select(F.col("node_id").alias("v")), "v", "left_semi").select("u", "v"))
    raise RuntimeError(f"components aren't settled after {max_rounds} rounds")


def largest_component(components: DataFrame) -> DataFrame:
    """Nodes of the largest component, the least one on ties."""
    size = components.groupBy("component").agg(F.count("*").alias("n"))
    best = size.agg(F.min_by("component", F.struct(-F.col("n"), F.col("component"))).alias("component"))
    return components.join(F.broadcast(best), "component", "left_semi").select("node_id")
