"""Playback files: link loads, queues and trajectories of one run in a binary file.

A file is a head (magic, version, length of a JSON header), the header, zeros up
to four bytes, and sections of little-endian numbers that the header names with
type, offset and count. Sections are looked up by name; others are passed over.

``spark.read.format("playback")`` and ``df.write.format("playback")`` work on
folders that driver and executors have mounted, with a partition a file; a
write puts files in place only when all tasks have ended well. For any other
store, :func:`playback_scan` reads the same tables through Spark's own reader.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Fixed values of the format.
MAGIC, VERSION = b"RDPB", 1
NUMBERS = {"float32": "<f4", "uint32": "<u4", "int32": "<i4"}
SECTIONS = {
    "edge_vc": "float32", "edge_speed_kph": "float32", "queue_len": "float32", "traj_offsets": "uint32",
    "traj_kind": "uint32", "traj_edge": "int32", "traj_enter_s": "float32", "traj_exit_s": "float32",
}

#: What each table of a file looks like. A file that can't be read is one row with an error.
TABLES = {
    "edges": "file string, plan_id string, seed long, bin int, edge int, vc double, speed_kph double, error string",
    "queues": "file string, plan_id string, seed long, bin int, entrance_id string, queue_len double, error string",
    "trajectories": "file string, plan_id string, seed long, trajectory long, kind long, step int, edge int, enter_s double, exit_s double, error string",
}
#: What a writer takes: a row a file.
FILE = "file string, plan_id string, seed long, bin_start_s int, bin_s int, n_bins int, n_edges int, entrance_ids array<string>, " + ", ".join(f"{s} array<{'float' if k == 'float32' else 'long'}>" for s, k in SECTIONS.items())
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
#: Rows of an Arrow batch.
_PIECE = 1 << 16


def encode(row: Row) -> bytes:
    """A row of :data:`FILE` as a file."""
    arrays = {s: np.array(row[s] or [], dtype=NUMBERS[k]) for s, k in SECTIONS.items()}
    offsets = arrays["traj_offsets"]
    points = int(offsets[-1]) if len(offsets) else 0
    dense = row["n_bins"] * row["n_edges"]
    sizes = {"edge_vc": dense, "edge_speed_kph": dense, "queue_len": row["n_bins"] * len(row["entrance_ids"] or []), "traj_kind": max(len(offsets) - 1, 0)} | {s: points for s in ("traj_edge", "traj_enter_s", "traj_exit_s")}
    for s, n in sizes.items():
        if len(arrays[s]) != n:
            raise ValueError(f"{row['file']}: section {s} has {len(arrays[s])} numbers, not {n}")
    sections, at = [], 0
    for s, a in arrays.items():
        sections.append({"name": s, "dtype": SECTIONS[s], "offset": at, "count": len(a)})
        at += 4 * len(a)
    head = {k: row[k] for k in ("plan_id", "seed", "bin_start_s", "bin_s", "n_bins", "n_edges", "entrance_ids")}
    head["entrance_ids"] = list(head["entrance_ids"] or [])
    text = json.dumps(head | {"version": VERSION, "n_trajectories": sizes["traj_kind"], "n_points": points, "sections": sections}).encode()
    return MAGIC + struct.pack("<II", VERSION, len(text)) + text + bytes(-(12 + len(text)) % 4) + b"".join(a.tobytes() for a in arrays.values())


def _open(content: bytes) -> tuple[dict, dict[str, np.ndarray]]:
    """(header, sections); a ValueError says what is wrong."""
    if len(content) < 12 or content[:4] != MAGIC:
        raise ValueError("not a playback file")
    version, length = struct.unpack_from("<II", content, 4)
    if version != VERSION:
        raise ValueError(f"version {version} is not known")
    try:
        head = json.loads(content[12 : 12 + length])
        start = 12 + length + -(12 + length) % 4
        found = {}
        for s in head["sections"]:
            if s["name"] in SECTIONS and s["dtype"] in NUMBERS:
                if (start + s["offset"]) % 4:
                    raise ValueError(f"section {s['name']} does not begin at a multiple of four")
                found[s["name"]] = np.frombuffer(content, NUMBERS[s["dtype"]], s["count"], start + s["offset"])
    except (KeyError, TypeError, UnicodeDecodeError, json.JSONDecodeError) as e:
        raise ValueError(f"bad header: {type(e).__name__}") from e
    return head, found


def _columns(table: str, head: dict, found: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """A table's own columns. A missing section is an empty one where the table can do without it."""
    need = lambda s: found[s] if s in found else np.zeros(0, dtype=NUMBERS[SECTIONS[s]])
    if table == "trajectories":
        offsets = need("traj_offsets").astype(np.int64)
        if not len(offsets):
            offsets = np.zeros(1, dtype=np.int64)
        n = np.diff(offsets)
        if (n < 0).any() or offsets[0] or any(len(need(s)) != offsets[-1] for s in ("traj_edge", "traj_enter_s", "traj_exit_s")) or len(need("traj_kind")) != len(n):
            raise ValueError("trajectory sections don't fit each other")
        which = np.repeat(np.arange(len(n)), n)
        return {"trajectory": which, "kind": need("traj_kind").astype(np.int64)[which], "step": np.arange(offsets[-1]) - offsets[which], "edge": need("traj_edge"), "enter_s": need("traj_enter_s"), "exit_s": need("traj_exit_s")}
    across, names = (int(head["n_edges"]), ("edge_vc", "edge_speed_kph")) if table == "edges" else (len(head["entrance_ids"]), ("queue_len",))
    if any(len(need(s)) != int(head["n_bins"]) * across for s in names):
        raise ValueError(f"sections of {table} don't fit the header")
    row, column = np.divmod(np.arange(int(head["n_bins"]) * across), max(across, 1))
    if table == "edges":
        return {"bin": row, "edge": column, "vc": need("edge_vc"), "speed_kph": need("edge_speed_kph")}
    return {"bin": row, "entrance_id": np.array(head["entrance_ids"], dtype=object)[column], "queue_len": need("queue_len")}


def decode(file: str, content: bytes, table: str) -> Iterator[pa.RecordBatch]:
    """One table of a file, piece by piece; one row with an error if the file can't be read."""
    schema = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in TABLES[table].split(", ")])
    try:
        head, found = _open(content)
        columns = _columns(table, head, found)
        plan, seed = head.get("plan_id"), head.get("seed")
    except (ValueError, KeyError, TypeError) as e:
        error = str(e) if isinstance(e, ValueError) else f"bad header: {e}"
        yield pa.RecordBatch.from_pylist([{"file": file, "error": error}], schema=schema)
        return
    n = len(next(iter(columns.values())))
    for lo in range(0, n, _PIECE):
        size = min(_PIECE, n - lo)
        same = {"file": file, "plan_id": plan, "seed": seed, "error": None}
        arrays = [pa.array([same[f.name]] * size, f.type) if f.name in same else pa.array(columns[f.name][lo : lo + size]).cast(f.type) for f in schema]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)


class _OneFile(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, folder: str, table: str):
        self.folder, self.table = folder, table

    def partitions(self) -> list[InputPartition]:
        return [_OneFile(f"{self.folder}/{f}") for f in sorted(os.listdir(self.folder)) if not f.startswith(("_", "."))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is not None and partition.value is not None:
            with open(partition.value, "rb") as f:
                yield from decode(os.path.basename(partition.value), f.read(), self.table)


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.run = folder, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        os.makedirs(self.folder, exist_ok=True)
        files = []
        for row in iterator:
            name = row["file"]
            if not name or name.startswith((".", "_")) or "/" in name:
                raise ValueError(f"{name!r} is no file name")
            waiting = f"{self.folder}/.{self.run}-{uuid.uuid4().hex}"
            with open(waiting, "wb") as f:
                f.write(encode(row))
            files.append((waiting, f"{self.folder}/{name}"))
        return _Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files = [f for m in messages if m for f in m.files]
        names = [to for _, to in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows have the same file name")
        if self.overwrite and os.path.isdir(self.folder):
            for f in os.listdir(self.folder):
                if not f.startswith((".", "_")) and f"{self.folder}/{f}" not in names:
                    os.remove(f"{self.folder}/{f}")
        for waiting, to in files:
            os.replace(waiting, to)
        self._sweep()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._sweep()

    def _sweep(self) -> None:
        """Delete what tasks left that were lost or ran twice."""
        for f in os.listdir(self.folder) if os.path.isdir(self.folder) else []:
            if f.startswith(f".{self.run}-"):
                os.remove(f"{self.folder}/{f}")


class Playback(DataSource):
    """Options: path, a mounted folder; table, one of edges, queues, trajectories."""

    @classmethod
    def name(cls) -> str:
        return "playback"

    def _folder(self) -> str:
        path = self.options["path"].removeprefix("file://").rstrip("/")
        if "://" in path:
            raise ValueError("a mounted folder is needed; read other stores by playback_scan")
        return path

    def schema(self) -> str:
        return TABLES[self.options.get("table", "trajectories")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._folder(), self.options.get("table", "trajectories"))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self._folder(), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Playback)


def playback_scan(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of the playback files of a path that Spark reads, wherever it lies. Spark passes over files without a byte."""
    schema = TABLES[table]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                yield from decode(name.as_py(), content.as_py(), table)

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.mapInArrow(run, schema)


def playback_rows(edges: DataFrame, queues: DataFrame, points: DataFrame, n_bins: int, n_edges: int, entrance_ids: list[str], bin_start_s: int, bin_s: int) -> DataFrame:
    """A row a file from long tables; a run's loads and queues are dense, with 0 where the tables have none.

    edges: file, bin, edge, vc, speed_kph; queues: file, bin, entrance_id,
    queue_len; points: file, trip, kind, step, edge, enter_s, exit_s. Trips of a
    file are in the order of trip. A file is made in one task.
    """
    frame = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    def flat(rows: DataFrame, of: str, n: int, values: list[str]) -> DataFrame:
        files = rows.select("file").distinct()
        full = files.select("file", frame(n_bins, "bin")).select("*", frame(n, of)).join(rows.select("file", "bin", of, *values), ["file", "bin", of], "left")
        listed = full.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("bin", of, *[F.coalesce(F.col(v), F.lit(0)).cast("float").alias(v) for v in values]))).alias("all"))
        return listed.select("file", *[F.col(f"all.{v}").alias(v) for v in values])

    place = F.array_position(F.array(*[F.lit(e) for e in entrance_ids]), F.col("entrance_id")) - 1
    loads = flat(edges, "edge", n_edges, ["vc", "speed_kph"]).select("file", F.col("vc").alias("edge_vc"), F.col("speed_kph").alias("edge_speed_kph"), F.lit(n_edges).alias("n_edges"))
    waits = flat(queues.withColumn("entrance", place.cast("int")), "entrance", len(entrance_ids), ["queue_len"]).withColumn("entrance_ids", F.array(*[F.lit(e) for e in entrance_ids]))
    trips = points.groupBy("file", "trip").agg(F.min("kind").alias("kind"), F.array_sort(F.collect_list(F.struct("step", "edge", F.col("enter_s").cast("float").alias("enter_s"), F.col("exit_s").cast("float").alias("exit_s")))).alias("points"))
    listed = trips.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("trip", "kind", "points"))).alias("trips"))
    ends = F.aggregate("trips", F.array(F.lit(0).cast("long")), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + F.size(t["points"]))))
    every = F.flatten(F.transform("trips", lambda t: t["points"]))
    ways = listed.select("file", ends.alias("traj_offsets"), F.transform("trips", lambda t: t["kind"].cast("long")).alias("traj_kind"), F.transform(every, lambda s: s["edge"].cast("long")).alias("traj_edge"), F.transform(every, lambda s: s["enter_s"]).alias("traj_enter_s"), F.transform(every, lambda s: s["exit_s"]).alias("traj_exit_s"))
    whole = loads.join(waits, "file", "full").join(ways, "file", "full")
    whole = whole.withColumns({"plan_id": F.element_at(F.split("file", "-"), 1), "seed": F.coalesce(F.expr("try_cast(element_at(split(file, '-'), 2) as long)"), F.lit(0)), "bin_start_s": F.lit(bin_start_s), "bin_s": F.lit(bin_s), "n_bins": F.lit(n_bins), "n_edges": F.coalesce("n_edges", F.lit(0))})
    return whole.selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in FILE.split(", ")])
