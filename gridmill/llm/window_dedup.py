"""Substring dedup: a log-structured index of window fingerprints.

History is kept as immutable runs of fingerprints, sorted, one fingerprint for
each neighbourhood of 35-word windows (windows.py): equal windows share it. A
new batch's fingerprints are merge-joined with the runs (levels.py); what meets,
or occurs twice in the batch, is verified on the windows' own words
(repeats.py); the batch becomes a run, and full levels are compacted.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.common import arrow_map
from gridmill.llm.repeats import BATCHES, RepeatIndex, unpacked
from gridmill.llm.windows import Shape, neighbourhoods, normal_bytes

WIDTH = 35
GRAM = 5


def fingerprints(texts: DataFrame, shape: Shape) -> DataFrame:
    """key, n: the window fingerprints of a batch, sorted and counted within each slice of text."""

    def find(batch):
        for f in neighbourhoods([normal_bytes(t, shape.unit) for t in unpacked(batch["blob"])], shape, digested=False):
            key, n = np.unique(f.key, return_counts=True)
            yield {"key": key, "n": n}

    return arrow_map(texts.select("blob"), "key long, n long", find)


def window_dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, batches: int = BATCHES, folder: str | None = None) -> DataFrame:
    """Remove every word covered by a window of `width` words that also starts elsewhere in the corpus.

    docs: doc_id, text. Words are runs of bytes other than space and
    \\x09-\\x0D. Returns doc_id, n_units (words), n_removed, n_spans, kept (kept
    words joined by one space), a row for each input row. A null text has no
    words and texts under `width` words stay whole; long texts are treated
    whole. Repeated rows are copies of each other. An empty table gives no rows;
    other columns, of whatever name, are ignored. With a `folder` the index stays
    there, and documents are also held against those of earlier calls with that
    folder.
    """
    shape = Shape("word", width, gram)
    index = RepeatIndex(docs.sparkSession, shape, ["key"], lambda t: fingerprints(t, shape), lambda m: m.select("key"), folder)
    return index.add(docs, batches)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = window_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
