"""Quality classifier by importance resampling.

Two generative models of hashed n-grams (words and word pairs) share their
features: the target model is fitted on documents labelled good, the raw model
on all documents. A document's importance weight is the ratio of the
probabilities of its whole text under the two. Documents are sampled without
replacement in proportion to their weights by Gumbel top-k: key = log weight /
temperature + Gumbel noise, and the k largest keys stay. The temperature is 1,
so the weights are what the ratio says, and chance decides about documents whose
log weights lie within a few units of the margin. k is the number of documents
whose weight passes the cut that best parts good from bad labels.

The labelled rows used are a bounded sample (LABELS); the raw model, the
weights and the selection cover every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.bytehash import U64, mix, running, slice_hash, word_spans
from gridmill.llm.common import arrow_map, stored, text_bytes
from gridmill.llm.windows import WORD_BYTE

BUCKETS_LOG2 = 14
#: Labelled rows that the target model and the cut are fitted on, at most.
LABELS = 20_000
#: Scale of the log weight against the sampling noise; 1 samples in proportion to the weights.
TEMPERATURE = 1.0
SMOOTH = 0.5
_SLICE = 1 << 18


def features(texts: list[bytes]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(which texts, text number in them, bucket) of every word and word pair."""
    lo = 0
    while lo < len(texts):
        hi, size = lo + 1, len(texts[lo])
        while hi < len(texts) and size + len(texts[hi]) <= _SLICE:
            size += len(texts[hi]) + 1
            hi += 1
        data = np.frombuffer(b" ".join(t.lower() for t in texts[lo:hi]), dtype=np.uint8)
        start, end = word_spans(data, WORD_BYTE)
        edge = np.cumsum([0] + [len(t) + 1 for t in texts[lo:hi]])
        owner = np.searchsorted(edge, start, side="right") - 1
        word = slice_hash(running(data), start, end)
        pair = mix(word[:-1] * U64(3) + word[1:])[owner[:-1] == owner[1:]]
        bucket = (np.concatenate((word, pair)) >> U64(64 - BUCKETS_LOG2)).astype(np.int64)
        yield slice(lo, hi), np.concatenate((owner, owner[:-1][owner[:-1] == owner[1:]])), bucket
        lo = hi


def ngram_counts(docs: DataFrame, good: set) -> tuple[np.ndarray, np.ndarray]:
    """(raw, target) counts of each bucket over all of docs (doc_id, text: binary), and over those in good."""
    size = 1 << BUCKETS_LOG2
    shared = docs.sparkSession.sparkContext.broadcast(good)

    def count(batches):
        raw, target = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            is_good = np.array([i in shared.value for i in ids], dtype=bool)
            for part, owner, bucket in features(texts):
                raw += np.bincount(bucket, minlength=size)
                target += np.bincount(bucket[is_good[part][owner]], minlength=size)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bucket": used, "raw": raw[used], "target": target[used]})

    summed = docs.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    for row in summed.collect():  # at most one row a bucket
        raw[row.bucket], target[row.bucket] = row.raw, row.target
    return raw, target


def best_cut(score: np.ndarray, good: np.ndarray) -> float:
    """The cut with the best mean of the shares of good at or over it and of bad under it; midway between scores."""
    order = np.argsort(score, kind="stable")
    score, good = score[order], good[order]
    bad_under = np.concatenate(([0], np.cumsum(~good))) / max((~good).sum(), 1)
    good_over = 1 - np.concatenate(([0], np.cumsum(good))) / max(good.sum(), 1)
    place = np.flatnonzero(np.concatenate(([True], score[1:] > score[:-1], [True])))
    at = place[np.argmax((bad_under + good_over)[place])]
    if at == 0:
        return -np.inf
    return np.inf if at == len(score) else float(score[at - 1] + score[at]) / 2


def top_key(keys: DataFrame, k: int, bins: int = 4096) -> float:
    """The cut that the k largest of keys (key: double, finite) pass; rows within a 10**10th of the range of it pass too."""
    lo, hi = keys.agg(F.min("key"), F.max("key")).first()
    if lo is None or k <= 0:
        return np.inf
    for _ in range(3):
        if hi <= lo:
            break
        width = (hi - lo) / bins
        place = F.least(F.greatest(F.floor((F.col("key") - lo) / width), F.lit(-1)), F.lit(bins)).alias("bin")
        counts = {r.bin: r.n for r in keys.groupBy(place).agg(F.count("*").alias("n")).collect()}
        above = 0
        for b in range(bins, -2, -1):
            above += counts.get(b, 0)
            if above >= k:
                break
        if b in (-1, bins):
            lo = lo if b == -1 else hi
            break
        lo, hi = lo + b * width, lo + (b + 1) * width
    return lo


def quality_sample(docs: DataFrame, labels: DataFrame, labelled: int = LABELS, temperature: float = TEMPERATURE, seed: int = 17, carry: bool = False) -> DataFrame:
    """Sample documents in proportion to their importance weight.

    docs: doc_id, text; labels: doc_id, quality (1 good, 0 bad; null is
    ignored; the least counts where a doc_id has several). Returns doc_id,
    n_grams, log_weight, key, kept, a row for each input row, and with `carry`
    the input row as a struct, row. Texts without words (null, empty) have
    n_grams 0, a null log_weight and key, and aren't kept. Rows with equal
    doc_id and text share weight, noise and fate; so do rows whose key equals
    the k-th, and all of them stay. A labelled doc_id that several rows share
    is judged by its least weight. Without good labels, or without bad ones,
    nothing tells what to reject, and every text with words is kept. No rows
    give no rows; other columns, of whatever name, are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    draw = F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw")
    rows = docs.select("doc_id", text_bytes().alias("text"), draw, *[F.struct("*").alias("row")] * carry)
    known = labels.select(F.col("doc_id").cast(kind).alias("doc_id"), "quality").dropna().groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    known = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled), "labels")
    raw, target = ngram_counts(rows.select("doc_id", "text"), {r.doc_id for r in known.where("good").collect()})
    share = lambda c: np.log((c + SMOOTH) / (c.sum() + SMOOTH * len(c)))
    ratio = spark.sparkContext.broadcast(share(target) - share(raw))

    def weigh(batch):
        texts = batch.pop("text").to_pylist()
        n, total = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
        for part, owner, bucket in features(texts):
            size = part.stop - part.start
            n[part] = np.bincount(owner, minlength=size)
            total[part] = np.bincount(owner, ratio.value[bucket], minlength=size)
        yield batch | {"n_grams": n, "log_weight": pa.array(total, mask=n == 0)}

    passed = rows.drop("text").schema
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in passed), "n_grams long, log_weight double"])
    weighed = stored(arrow_map(rows, schema, weigh), "weights")
    judged = weighed.where("log_weight is not null").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("log_weight").alias("weight"), F.first("good").alias("good"))
    judged = judged.select("weight", "good").toArrow()  # at most `labelled` rows
    weight, good = judged["weight"].to_numpy(), judged["good"].to_numpy()
    cut = best_cut(weight, good.astype(bool)) if 0 < good.sum() < len(good) else -np.inf
    k = weighed.where(F.col("log_weight") >= F.lit(float(cut))).count()
    uniform = (F.shiftrightunsigned("draw", 11) + F.lit(0.5)) * F.lit(2.0**-53)
    keyed = weighed.withColumn("key", F.col("log_weight") / F.lit(temperature) - F.log(-F.log(uniform))).drop("draw")
    least = top_key(keyed.where("key is not null").select("key"), k)
    return keyed.withColumn("kept", F.coalesce(F.col("key") >= F.lit(float(least)), F.lit(False)))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return quality_sample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
