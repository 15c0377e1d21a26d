"""A family of sorted runs whose sizes grow geometrically, kept in a folder.

A batch arrives as one sorted run at level 0. While the level below holds a
run, the two merge into one run a level up, so n batches leave at most
log2(n) + 1 runs, and each entry is rewritten at most log2(n) times. Taking a
batch in is a merge scan: the pass that merges it with the levels it meets also
tells which of its entries those already hold, and the levels it doesn't meet
are joined with it. Runs never change; a manifest names those that count, so a
later session can open the folder and go on.

Within a run, equal entries share a partition and each partition is sorted by
the entry's columns. (Spark sorts again before a join, for it doesn't know of
the order of files.)
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm.common import exists, forget, read_text, shared_folder, stored, write_text


class Levels:
    """Runs of (*columns, n), sorted by columns; n counts the occurrences of an entry."""

    def __init__(self, spark: SparkSession, columns: list[str], folder: str | None = None):
        self.spark, self.columns = spark, columns
        self.folder = (folder or f"{shared_folder(spark)}/gridmill-{uuid.uuid4().hex}").rstrip("/")
        self.runs: dict[int, DataFrame] = {}
        self.tables: dict[str, list[str]] = {}
        if exists(spark, f"{self.folder}/manifest.json"):
            held = json.loads(read_text(spark, f"{self.folder}/manifest.json"))
            self.tables = held["tables"]
            self.runs = {int(level): self.open(path) for level, path in held["runs"].items()}

    def open(self, path: str) -> DataFrame:
        df = self.spark.read.parquet(path)
        df.stored_path = path
        return df

    def keep(self, kind: str, df: DataFrame) -> DataFrame:
        """Write a table into the folder; it counts from the next :meth:`commit` on."""
        out = stored(df, kind, f"{self.folder}/{kind}-{uuid.uuid4().hex}")
        self.tables.setdefault(kind, []).append(out.stored_path)
        return out

    def kept(self, kind: str) -> DataFrame:
        """All tables of a kind, those of earlier sessions included."""
        return reduce(DataFrame.unionByName, [self.open(p) for p in self.tables[kind]])

    def commit(self) -> None:
        write_text(self.spark, f"{self.folder}/manifest.json", json.dumps({"runs": {k: r.stored_path for k, r in self.runs.items()}, "tables": self.tables}))

    def add(self, batch: DataFrame) -> DataFrame:
        """Take in a batch of (*columns, n), unsorted, entries perhaps repeated. Returns its entries that occur twice or more, in it or with what is held."""
        level, merged = 0, []
        while level in self.runs:
            merged.append(self.runs.pop(level))
            level += 1
        rows = reduce(DataFrame.unionByName, [batch.withColumn("fresh", F.col("n")), *(r.select(*self.columns, "n", F.lit(0).cast("long").alias("fresh")) for r in merged)])
        rows = rows.groupBy(*self.columns).agg(F.sum("n").alias("n"), F.sum("fresh").alias("fresh"))
        run = stored(rows.sortWithinPartitions(*self.columns), "run", f"{self.folder}/run-{uuid.uuid4().hex}")
        fresh = run.where("fresh > 0")
        met = [fresh.where("n > 1").select(*self.columns), *(fresh.select(*self.columns).join(r, self.columns, "left_semi") for r in self.runs.values())]
        self.runs[level] = run
        matches = self.keep("matches", reduce(DataFrame.unionByName, met))
        self.commit()
        for old in merged:
            forget(old)
        return matches
