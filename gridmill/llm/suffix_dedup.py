"""Suffix-array dedup: a logarithmic family of suffix arrays finds long repeated byte strings.

Each batch of texts yields a sparse suffix array: its anchored suffixes in byte
order. An anchored suffix starts at the anchor of a 200-byte window (windows.py),
so two equal windows always own suffixes that agree on at least GRAM bytes;
suffixes elsewhere need no entry. An entry is the suffix's first GRAM bytes
themselves, so entries sort as the suffixes do down to that depth, and suffixes
whose common prefix is shorter never meet. Each batch is merge-scanned against
the levels that earlier batches left (levels.py), which grow geometrically; what
it shares with them, or holds twice, is a match. Matches are extended in both
directions and verified as whole 200-byte strings (repeats.py).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.bytehash import running, slice_hash
from gridmill.llm.common import arrow_map
from gridmill.llm.repeats import BATCHES, RepeatIndex, unpacked
from gridmill.llm.windows import Shape, neighbourhoods

WIDTH = 200
GRAM = 32


def suffix_array(texts: DataFrame, shape: Shape) -> DataFrame:
    """head, n: the first bytes of a batch's anchored suffixes, in byte order within each slice of text, equal ones counted."""

    def find(batch):
        data = unpacked(batch["blob"])
        for f in neighbourhoods(data, shape, digested=False):
            _, first, n = np.unique(f.key, return_index=True, return_counts=True)
            at = (f.start + f.lead)[first].tolist()
            heads = [data[t][a : a + shape.gram] for t, a in zip(f.text[first].tolist(), at)]
            order = sorted(range(len(heads)), key=heads.__getitem__)
            yield {"head": [heads[i] for i in order], "n": n[order]}

    return arrow_map(texts.select("blob"), "head binary, n long", find)


def anchor_keys(heads: DataFrame, shape: Shape) -> DataFrame:
    """key of each head, as neighbourhoods name it."""

    def find(batch):
        data = b"".join(batch["head"].to_pylist())
        at = np.arange(0, len(data), shape.gram)
        yield {"key": slice_hash(running(np.frombuffer(data, dtype=np.uint8)), at, at + shape.gram).view(np.int64)}

    return arrow_map(heads.select("head"), "key long", find)


def suffix_dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, batches: int = BATCHES, folder: str | None = None) -> DataFrame:
    """Remove every byte covered by a `width`-byte string that also starts elsewhere in the corpus.

    docs: doc_id, text. Returns doc_id, n_units (bytes), n_removed, n_spans
    (maximal removed runs), kept (remaining bytes), a row for each input row.
    A null text counts as empty and texts under `width` bytes stay whole; long
    texts are treated whole. Repeated rows are copies of each other. An empty
    table gives no rows; other columns, of whatever name, are ignored. With a
    `folder` the index stays there, and documents are also held against those of
    earlier calls with that folder.
    """
    shape = Shape("byte", width, gram)
    index = RepeatIndex(docs.sparkSession, shape, ["head"], lambda t: suffix_array(t, shape), lambda m: anchor_keys(m, shape), folder)
    return index.add(docs, batches)


def op2_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
