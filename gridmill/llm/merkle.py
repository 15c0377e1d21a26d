"""Merkle dataset manifest, level by level with lag and lead columns.

Leaves are numbered within their source by sampled range partitions and counts
of rows a partition, so a source of any size is spread over many tasks. A node
at position p of n stands in slot p mod 16 of its run. Lag and lead columns of
fixed offsets 1 to 15, masked by the slot and by the run's length, give a node
its siblings to the left and to the right; the first child of a run hashes
itself and its right siblings to the parent. Windows hold whole runs, a bounded
number of them, never a source. Subroots form the upper tree the same way. The
siblings on a node's way to the root are handed down level by level, each node
joining its parent's, and a leaf hashes and folds them at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridmill.llm.common import stored

FAN_OUT = 16
#: Runs that one window holds.
RUNS = 16


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """Hex SHA-256 of the fields, each its UTF-8 byte count, a colon and its value, or - where null."""
    parts = [c.cast("string") for c in (doc_id, source, lang, n_chars, text)]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]), 256)


def _placed(nodes: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Nodes with p, their place from 0 in their tree by the order, and n, the nodes of the tree. Rows that tie are equal to the order and take any of its places."""
    ranged = nodes.withColumn("__any", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(tree, *order, "__any").sortWithinPartitions(tree, *order, "__any").drop("__any")
    at = stored(ranged.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id()), "ranged")
    runs = at.groupBy(tree, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))  # of a tree a row for each partition
    whole = W.partitionBy(tree)
    before = runs.withColumn("__base", F.sum("__rows").over(whole.orderBy("__part")) - F.col("__rows")).withColumn("n", F.sum("__rows").over(whole)).drop("__rows")
    return at.join(before, [tree, "__part"]).withColumn("p", F.col("__base") + F.col("__at") - F.col("__first")).drop("__part", "__at", "__first", "__base")


def _with_siblings(nodes: DataFrame, tree: str) -> DataFrame:
    """Nodes with before and after: the digests of a run's others, concatenated."""
    slot = F.col("p") % FAN_OUT
    length = F.least(F.lit(FAN_OUT), F.col("n") - (F.col("p") - slot))
    block = W.partitionBy(tree, F.floor(F.col("p") / (FAN_OUT * RUNS))).orderBy("p")
    earlier = [F.when(slot >= k, F.lag("h", k).over(block)) for k in range(FAN_OUT - 1, 0, -1)]
    later = [F.when(slot + k < length, F.lead("h", k).over(block)) for k in range(1, FAN_OUT)]
    return nodes.select("*", F.concat_ws("", *earlier).alias("before"), F.concat_ws("", *later).alias("after"))


def _levels(nodes: DataFrame, tree: str, name: str) -> list[DataFrame]:
    """Stored levels of all trees from the leaves up, each with siblings. A tree that has come to one node stays out of the levels above."""
    levels = [stored(_with_siblings(nodes, tree), f"{name}0")]
    size = levels[0].agg(F.max("n")).first()[0] or 1
    while size > 1:
        first = levels[-1].where((F.col("n") > 1) & (F.col("p") % FAN_OUT == 0))
        up = first.select(tree, F.floor(F.col("p") / FAN_OUT).alias("p"), F.ceil(F.col("n") / FAN_OUT).alias("n"), F.sha2(F.concat("h", "after"), 256).alias("h"))
        levels.append(stored(_with_siblings(up, tree), f"{name}{len(levels)}"))
        size = -(-size // FAN_OUT)
    return levels


def _handed_down(levels: list[DataFrame], tree: str, above: DataFrame) -> DataFrame:
    """The lowest level with way: the siblings (before, after) of each node on its way up, nearest first.

    above: the tree's last node's own way, and what all nodes of the tree carry along.
    """
    carried = [c for c in above.columns if c not in (tree, "way")]
    down = None
    for level in reversed(levels):
        last = level.where("n = 1").join(above, tree)
        if down is not None:
            step = F.array(F.struct("before", "after"))
            parents = down.select(tree, F.col("p").alias("__run"), "way", *carried)
            inner = level.where("n > 1").withColumn("__run", F.floor(F.col("p") / FAN_OUT)).join(parents, [tree, "__run"])
            last = last.unionByName(inner.drop("__run").withColumn("way", F.concat(step, "way")))
        down = last
    return down


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """Digests and proofs of every row of docs (doc_id, text, lang, source, n_chars).

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.
    Every row is a leaf; repeated rows are leaves of their own. Leaves ascend by
    doc_id, null first, of equal doc_ids by their digest. A null source is a
    source. A text is hashed whole; null and empty texts differ. A row without a
    doc_id is not tampered with. A lone leaf is its subroot and a lone subroot
    the root; a proof without siblings is the digest of nothing. No rows give no
    rows. Columns beyond these five are ignored, whatever their names.
    """
    doc_id, source, lang, n_chars, text = (F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    other = F.when(F.crc32(doc_id.cast("string")) % 5 == 0, leaf_digest(doc_id, source, lang, n_chars, F.translate(text, capitals, capitals.lower())))
    # '-' sorts before '=', so the null source comes first
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), source), F.lit("-")).alias("src"), "doc_id", leaf_digest(doc_id, source, lang, n_chars, text).alias("h"), other.alias("tampered")
    )
    levels = _levels(_placed(stored(leaves, "leaves"), "src", ["doc_id", "h"]), "src", "leaves")
    roots = levels[0].where("n = 1").select("src", "h")
    for level in levels[1:]:
        roots = roots.union(level.where("n = 1").select("src", "h"))
    upper = _levels(_placed(roots.withColumn("top", F.lit(0)), "top", ["src"]), "top", "sources")
    root = upper[-1].where("n = 1").select("top", F.array().cast("array<struct<before:string,after:string>>").alias("way"), F.col("h").alias("root"))
    sources = _handed_down(upper, "top", root).select("src", "way", "root", F.col("h").alias("subroot"))
    full = _handed_down(levels, "src", sources)
    folded = F.aggregate("way", F.coalesce("tampered", "h"), lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))
    proof = F.sha2(F.array_join(F.transform("way", lambda s: F.concat(s["before"], s["after"])), ""), 256)
    out = full.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return merkle_manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Levels that the SQL below has room for: 16^5 leaves a source, 16^3 sources.
_SQL_LEVELS, _SQL_UPPER = 5, 3


def crc_sql(codes: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a list of byte values; needs :data:`CRC_TABLE` and its column t."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


#: DuckDB SQL of two tables, the second with one row that holds the 256 steps of CRC-32, from its polynomial.
CRC_TABLE = """crc_bits(i, c, k) AS (
  SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k + 1 FROM crc_bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM crc_bits WHERE k = 8)"""


def _sql() -> str:
    def field(c: str) -> str:
        return f"coalesce(strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')"

    def digest(text: str) -> str:
        return f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"

    def tree(name: str, levels: int) -> str:
        out = ""
        for k in range(levels):
            out += f""",
{name}{k + 1} AS (SELECT tree, p // 16 AS p, (any_value(n) + 15) // 16 AS n, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h
  FROM {name}{k} GROUP BY tree, p // 16)"""
        for k in range(levels):
            run = "OVER (PARTITION BY tree, p // 16 ORDER BY p ROWS BETWEEN"
            out += f""",
{name}s{k} AS (SELECT *, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS z FROM {name}{k})"""
        return out

    lower, upper = [f"ls{k}" for k in range(_SQL_LEVELS)], [f"us{k}" for k in range(_SQL_UPPER)]
    digits = "list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)"
    joins = "".join(f" JOIN {s} ON {s}.tree = ls0.tree AND {s}.p = ls0.p // {16**k}" for k, s in enumerate(lower) if k)
    joins += f" JOIN l{_SQL_LEVELS} top ON top.tree = ls0.tree"
    joins += " JOIN us0 ON us0.src = ls0.tree" + "".join(f" JOIN {s} ON {s}.p = us0.p // {16**k}" for k, s in enumerate(upper) if k)
    proof = " || ".join(f"{s}.a || {s}.z" for s in lower + upper)
    # one fold a step, so that the text doesn't double with each level
    fold = "SELECT *, coalesce(tampered, leaf) AS f0 FROM way"
    for k in range(_SQL_LEVELS + _SQL_UPPER):
        fold = f"SELECT *, CASE WHEN n{k} = 1 THEN f{k} ELSE sha256(a{k} || f{k} || z{k}) END AS f{k + 1} FROM ({fold})"
    carried = ", ".join(f"{s}.n AS n{k}, {s}.a AS a{k}, {s}.z AS z{k}" for k, s in enumerate(lower + upper))
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH RECURSIVE {CRC_TABLE},
leaves AS (SELECT doc_id, coalesce('=' || source, '-') AS tree, {digest('text')} AS h,
  CASE WHEN {crc_sql(digits)} % 5 = 0 THEN {digest(f"translate(text, '{capitals}', '{capitals.lower()}')")} END AS tampered FROM documents, crc),
l0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS p, count(*) OVER (PARTITION BY tree) AS n FROM leaves){tree('l', _SQL_LEVELS)},
u0 AS (SELECT tree AS src, 0 AS tree, h, row_number() OVER (ORDER BY tree) - 1 AS p, count(*) OVER () AS n FROM l{_SQL_LEVELS}){tree('u', _SQL_UPPER)},
way AS (SELECT ls0.doc_id, ls0.h AS leaf, ls0.tampered, top.h AS subroot, u{_SQL_UPPER}.h AS root, sha256({proof}) AS proof_sha256, {carried}
  FROM ls0{joins} CROSS JOIN u{_SQL_UPPER})
SELECT doc_id, leaf, subroot, root, proof_sha256, f{_SQL_LEVELS + _SQL_UPPER} AS folded_root, f{_SQL_LEVELS + _SQL_UPPER} = root AS verified FROM ({fold})"""


SQL = _sql()
