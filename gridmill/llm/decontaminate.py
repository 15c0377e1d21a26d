"""Benchmark decontamination by a distributed positional inverted index.

The index is stored in segments, as search engines keep it: a segment holds the
postings of a bounded batch of documents, that is each term with the sorted
positions where it stands. The benchmark's windows are a table. Each window is
looked up by its rarest term over the whole index, so it meets only segments
that hold that term. There its posting lists, shifted to the window's start, are
intersected from the rarest on until none is left or all terms agree. Windows
go to a segment in chunks of bounded size; nothing but counts of windows
reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.common import arrow_map, bound_batches, stored, text_bytes

WIDTH = 10
#: Windows that meet a segment at once, about.
CHUNK = 50_000
#: Documents of a segment, and their bytes, about.
SEGMENT, SEGMENT_BYTES = 2000, 8 << 20

#: A-Z to a-z; other ASCII than letters and digits parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def index_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Segment:
    """Postings over some texts; positions number the words of all texts in a row."""

    def __init__(self, terms: list[bytes], counts: np.ndarray, positions: np.ndarray, sizes: np.ndarray):
        self.terms, self.counts, self.positions, self.sizes = terms, counts, positions, sizes
        self.first = np.cumsum(sizes) - sizes
        self.text_of = np.repeat(np.arange(len(sizes)), sizes)
        edge = np.concatenate(([0], np.cumsum(counts)))
        self.place = {t: (a, b) for t, a, b in zip(terms, edge[:-1].tolist(), edge[1:].tolist())}

    @staticmethod
    def of(texts: list[bytes]) -> Segment:
        known: dict[bytes, int] = {}
        words = [index_words(t) for t in texts]
        ids = np.array([known.setdefault(w, len(known)) for doc in words for w in doc], dtype=np.int32)
        order = np.argsort(ids, kind="stable")
        return Segment(list(known), np.bincount(ids, minlength=len(known)), order, np.array([len(w) for w in words], dtype=np.int64))

    def postings(self, term: bytes) -> np.ndarray:
        a, b = self.place.get(term, (0, 0))
        return self.positions[a:b]

    def phrase(self, window: tuple[bytes, ...]) -> np.ndarray:
        """Starts of a window's exact occurrences inside one text."""
        lists = sorted(((self.postings(t), j) for j, t in enumerate(window)), key=lambda x: len(x[0]))
        start = lists[0][0] - lists[0][1]
        for held, j in lists[1:]:
            if not len(start):
                return start
            want = start + j
            i = np.minimum(np.searchsorted(held, want), len(held) - 1)
            start = start[held[i] == want]
        start = start[(start >= 0) & (start + len(window) <= len(self.text_of))]
        return start[self.text_of[start] == self.text_of[start + len(window) - 1]]

    def near(self, window: tuple[bytes, ...], slop: int) -> np.ndarray:
        """Texts where every term of a window stands within `slop` words of its rarest term."""
        lists = sorted((self.postings(t) for t in set(window)), key=len)
        at = lists[0]
        for held in lists[1:]:
            if not len(at):
                break
            i = np.searchsorted(held, np.maximum(at - slop, self.first[self.text_of[at]]))
            near = held[np.minimum(i, len(held) - 1)]
            at = at[(i < len(held)) & (near <= at + slop) & (self.text_of[near] == self.text_of[at])]
        return np.unique(self.text_of[at])


def index_documents(docs: DataFrame) -> DataFrame:
    """The stored index: segment, docs (doc_id and n_words of each text), terms, counts, positions (steps between positions, 4 bytes each).

    docs: doc_id, text. Null texts have no words. No rows give no segments.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"segment long, docs struct<doc_id: array<{kind}>, n_words: array<long>>, terms array<binary>, counts array<long>, positions binary"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo in range(0, batch.num_rows, SEGMENT):
                part = batch.slice(lo, SEGMENT)
                found = Segment.of(part.column(1).to_pylist())
                ids = part.column(0)
                both = pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([found.sizes], pa.list_(pa.int64()))], ["doc_id", "n_words"])
                steps = np.diff(found.positions, prepend=0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([number]), both, pa.array([found.terms], pa.list_(pa.binary())), pa.array([found.counts], pa.list_(pa.int64())), pa.array([steps.tobytes()], pa.binary())], ["segment", "docs", "terms", "counts", "positions"])
                number += 1

    return stored(docs.select("doc_id", text_bytes().alias("text")).mapInArrow(build, schema), "segments", large_rows=True)


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """item (as string), terms: the windows of every item, `width` consecutive words or all of an item with fewer."""

    def cut(batch):
        items, windows = [], []
        for item, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist()):
            words = index_words(text)
            for i in range(max(len(words) - width, 0) + 1 if words else 0):
                items.append(item)
                windows.append(words[i : i + width])
        yield {"item": items, "terms": pa.array(windows, pa.list_(pa.binary()))}

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), text_bytes().alias("text"))
    return arrow_map(rows, "item string, terms array<binary>", cut)


def find_benchmark(index: DataFrame, benchmark: DataFrame, width: int = WIDTH, slop: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Exact occurrences of benchmark windows in indexed documents, and with `slop` proximity matches too.

    index: from index_documents; benchmark: item_id, text. Returns a row for
    each document row: doc_id, n_words, hits (positions of words inside an
    occurrence, ascending), items (ids, as strings, of items with an
    occurrence, sorted), near_items (likewise for proximity: all words of a
    window within `slop` words of its rarest; empty without slop). Null and
    empty texts have no words; long texts count whole; repeated rows each get
    their row. Items with a null id match and are listed as "null"; null items
    have no windows. Repeated items count once; an empty benchmark hits nothing,
    and an empty index gives no rows. Other columns are ignored.
    """
    every = stored(benchmark_windows(benchmark, width), "items")
    windows = stored(every.select("terms").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    chunks = max(1, -(-windows.count() // chunk))
    items = every.join(windows, "terms").select("window", "item").distinct()
    terms = windows.select("window", F.explode(F.array_distinct("terms")).alias("term"))
    # how often each benchmark term stands in the index, and where
    held = index.select("segment", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("segment", F.col("x.terms").alias("term"), F.col("x.counts").alias("n"))
    held = stored(held.join(terms.select("term"), "term", "left_semi"), "held")
    weight = terms.join(held.groupBy("term").agg(F.sum("n").alias("n")), "term", "left")
    rarest = weight.groupBy("window").agg(F.min_by("term", F.struct("n", "term")).alias("term"), F.count_if(F.col("n").isNull()).alias("absent")).where("absent = 0")
    visits = rarest.join(held.select("segment", "term"), "term").join(windows, "window")
    visits = visits.groupBy("segment", F.pmod(F.hash("window"), F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("window", "terms")).alias("visits"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                steps = np.frombuffer(row["positions"], dtype=np.int32)
                held = Segment(row["terms"], np.array(row["counts"], dtype=np.int64), np.cumsum(steps, dtype=np.int64), np.array(row["n_words"], dtype=np.int64))
                hits: dict[int, list] = {}
                near: dict[int, list] = {}
                for visit in row["visits"]:
                    window = tuple(visit["terms"])
                    for s in held.phrase(window).tolist():
                        t = int(held.text_of[s])
                        hits.setdefault(t, []).append((visit["window"], s - int(held.first[t]), len(window)))
                    for t in held.near(window, slop).tolist() if slop is not None else ():
                        near.setdefault(t, []).append(visit["window"])
                out = {"segment": [], "place": [], "hits": [], "windows": [], "near": []}
                for t in sorted({*hits, *near}):
                    found = hits.get(t, [])
                    out["segment"].append(row["segment"])
                    out["place"].append(t)
                    out["hits"].append(sorted({s + i for _, s, n in found for i in range(n)}))
                    out["windows"].append(sorted({w for w, _, _ in found}))
                    out["near"].append(sorted(set(near.get(t, []))))
                if out["place"]:
                    yield pa.RecordBatch.from_arrays([pa.array(out[c], k) for c, k in (("segment", pa.int64()), ("place", pa.int32()), ("hits", pa.list_(pa.int32())), ("windows", pa.list_(pa.int64())), ("near", pa.list_(pa.int64())))], list(out))

    met = index.join(visits, "segment").select("segment", F.col("docs.n_words").alias("n_words"), "terms", "counts", "positions", "visits")
    found = stored(met.mapInArrow(look, "segment long, place int, hits array<int>, windows array<long>, near array<long>"), "found")
    at = ["segment", "place"]
    hits = found.groupBy(*at).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"))
    named = found.select(*at, F.explode("windows").alias("window"), F.lit(False).alias("close")).union(found.select(*at, F.explode("near"), F.lit(True))).join(items, "window")
    names = named.groupBy(*at).agg(*(F.array_sort(F.collect_set(F.when(F.col("close") == c, F.col("item")))).alias(n) for c, n in ((False, "items"), (True, "near_items"))))
    docs = index.select("segment", F.posexplode(F.arrays_zip("docs.doc_id", "docs.n_words")).alias("place", "x")).select(*at, "x.doc_id", "x.n_words")
    out = docs.join(hits, at, "left").join(names, at, "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "n_words", F.coalesce("hits", F.array().cast("array<int>")).alias("hits"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"))


def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    out = find_benchmark(index_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hits, items = F.size("hits").cast("long"), F.array_join("items", ",")
    return out.select("doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(items.cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))
