"""Helpers that several text operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: spark.checkpoint.dir. Where that is unset, a temporary folder on a local master, and an error on a cluster."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="gridmill-")
    return _own_folder[app]


#: For rows of megabytes. Unset, a writer holds 100 rows before it looks at their size, and a reader takes up to 4,096 rows of a row group at once.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def stored(df: DataFrame, name: str, path: str | None = None, large_rows: bool = False) -> DataFrame:
    """Write df to the shared folder, or to path, and read it back: cuts lineage, and survives the loss of executors.

    large_rows: rows are of megabytes, so row groups have few of them, however many rows a task writes.
    """
    path = path or f"{shared_folder(df.sparkSession)}/gridmill-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").options(**(LARGE_ROWS if large_rows else {})).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def _path(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def forget(df: DataFrame) -> None:
    """Delete a table that :func:`stored` wrote and nothing needs any more."""
    fs, at = _path(df.sparkSession, df.stored_path)
    fs.delete(at, True)


#: Spark's setting that deletes a query's shuffle files when the query ends; without it they stay until the driver collects garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, shuffle files go with the query that wrote them. For steps that each write a table and never run again; the session's own setting comes back."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return fs.exists(at)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file: the new one is complete before it takes the name."""
    fs, at = _path(spark, path)
    _, new = _path(spark, f"{path}.new")
    out = fs.create(new, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    fs.delete(at, False)
    fs.rename(new, at)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def numbered(docs: DataFrame) -> DataFrame:
    """rid, row: every input row with a number of its own, written down so that the numbers stay. No input column can clash."""
    return stored(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("row")), "numbered")


def text_bytes(column: str = "text") -> F.Column:
    """A text as UTF-8 bytes; null as no bytes."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


#: Limits of an Arrow batch, so that a worker holds few texts at once. They are session settings.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def bound_batches(spark: SparkSession) -> None:
    for name, value in BATCH.items():
        spark.conf.set(name, value)


def arrow_map(df: DataFrame, schema: str, per_batch: Callable[[dict], Iterable[dict]]) -> DataFrame:
    """mapInArrow with batches as dicts of Arrow columns; per_batch yields dicts of arrays in the schema's order."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    bound_batches(df.sparkSession)
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for out in per_batch({n: batch.column(i) for i, n in enumerate(batch.schema.names)}):
                    columns = [v if isinstance(v, pa.Array) else pa.array(v, type=f.type) for v, f in zip(out.values(), target)]
                    yield pa.RecordBatch.from_arrays(columns, schema=target)

    return df.mapInArrow(run, schema)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its group) that join what the edges a-b join: one for each node but the least."""
    node, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(node))
    unite(label, i, j)
    other = np.flatnonzero(label != np.arange(len(node)))
    return node[other], node[label[other]]


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the groups of i and j in place. label names each node's group by its least node, before and after."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def sorted_groups(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[pa.Table, np.ndarray, list[int]]]:
    """(table, edges, over) from batches sorted by their first column (long): whole groups, and where each begins and the last ends.

    A group of over `most` rows is left out and its key listed in over, so that
    no more than that and a batch are ever held.
    """
    waiting: list[pa.RecordBatch] = []
    held, dropped = 0, None

    def whole(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray, list[int]]:
        table = pa.Table.from_batches(parts).combine_chunks()
        key = table.column(0).to_numpy()
        edge = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
        over = np.flatnonzero(np.diff(edge) > most) if most is not None else []
        if not len(over):
            return table, edge, []
        keep = np.repeat(np.diff(edge) <= most, np.diff(edge))
        return (*whole([b for b in table.filter(pa.array(keep)).to_batches() if b.num_rows])[:2], key[edge[over]].tolist()) if keep.any() else (table.slice(0, 0), np.zeros(1, dtype=np.int64), key[edge[over]].tolist())

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        if dropped is not None:
            batch = batch.slice(int(np.argmax(np.append(key != dropped, True))))
            if not batch.num_rows:
                continue
            key, dropped = batch.column(0).to_numpy(), None
        last = len(key) - int(np.argmax(np.append(key[::-1] != key[-1], True)))
        if waiting and (last or waiting[-1].column(0)[0].as_py() != key[0]):
            yield whole([*waiting, batch.slice(0, last)] if last else waiting)
            waiting, held = [], 0
        elif last:
            yield whole([batch.slice(0, last)])
        waiting.append(batch.slice(last))
        held += len(key) - last
        if most is not None and held > most:
            yield waiting[0].schema.empty_table(), np.zeros(1, dtype=np.int64), [int(key[-1])]
            waiting, held, dropped = [], 0, key[-1]
    if waiting:
        yield whole(waiting)


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (least node reachable) of every node in edges (a, b: long).

    Alternates large-star and small-star rounds, each a join and a grouping on
    the node, until every edge points at its component's least node. A hub's
    edges meet as partial minima, and its join is one Spark can split.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(small.union(least).distinct(), "edges")
        forget(now)
        now = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
