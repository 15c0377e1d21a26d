"""Remove every window of a corpus that starts in more than one place.

An index (levels.py) tells which anchor pieces occur twice or more. Then:

1. Neighbourhoods (windows.py) with such an anchor meet by the digest of their
   whole bytes. Those that occur twice are repeated throughout.
2. One of each kind of neighbourhood is refined. Its windows are numbered by the
   units they hold before the anchor, and cut into blocks of such numbers. The
   windows of a block share a core; a block whose core no other neighbourhood
   has is done. What is left is cut finer, down to single windows, whose digest
   is that of their own bytes. A block that another equals in whole needs no
   finer cut, but for one of its kind that the others are held against.
3. The repeated windows of a text are turned into the units they cover.

Each step counts digests and hands the counts back by a join, so a piece that
any number of neighbourhoods share costs a row each, and no task holds them all.
Digests have 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm.common import arrow_map, forget, passing_shuffles, stored, text_bytes
from gridmill.llm.levels import Levels
from gridmill.llm.windows import Shape, digests, neighbourhoods, normal_bytes, unit_bounds

#: Batches that a query takes its documents in.
BATCHES = 4
#: A rid holds the number of its intake above these bits.
_RID_BITS = 54


def packed(docs: DataFrame, intake: int) -> DataFrame:
    """rid (a number of its own for each row), doc_id, blob (the text, compressed)."""

    def pack(batch):
        squeeze = zstandard.ZstdCompressor(level=1)
        yield {"rid": batch["rid"], "doc_id": batch["doc_id"], "blob": [squeeze.compress(t) for t in batch["text"].to_pylist()]}

    rid = F.monotonically_increasing_id() + F.lit(intake << _RID_BITS)
    rows = docs.select(rid.alias("rid"), "doc_id", text_bytes().alias("text"))
    return arrow_map(rows, f"rid long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, blob binary", pack)


def unpacked(blobs) -> list[bytes]:
    expand = zstandard.ZstdDecompressor()
    return [expand.decompress(b) for b in blobs.to_pylist()]


def _records(texts: DataFrame, shape: Shape) -> DataFrame:
    """key, d1, d2, rid, at of each neighbourhood; at holds start, lead and count."""

    def find(batch):
        rid = batch["rid"].to_numpy()
        for f in neighbourhoods([normal_bytes(t, shape.unit) for t in unpacked(batch["blob"])], shape):
            yield {"key": f.key, "d1": f.digest[:, 0], "d2": f.digest[:, 1], "rid": rid[f.text], "at": (f.start << 16) | (f.lead << 8) | f.count}

    return arrow_map(texts.select("rid", "blob"), "key long, d1 long, d2 long, rid long, at long", find)


def _contents(texts: DataFrame, wanted: DataFrame, shape: Shape) -> DataFrame:
    """rid, at, content of the neighbourhoods in wanted (rid, at)."""
    lists = wanted.groupBy("rid").agg(F.collect_list("at").alias("ats"))

    def cut(batch):
        rid = batch["rid"].to_numpy()
        for i, (text, want) in enumerate(zip(unpacked(batch["blob"]), batch["ats"])):
            data = normal_bytes(text, shape.unit)
            starts, ends = unit_bounds(np.frombuffer(data, dtype=np.uint8), shape.unit)
            at = want.values.to_numpy()
            first = at >> 16
            lo, hi = starts[first].tolist(), ends[first + (at & 255) + shape.width - 2].tolist()
            yield {"rid": np.full(len(at), rid[i]), "at": at, "content": [data[a:b] for a, b in zip(lo, hi)]}

    return arrow_map(texts.join(lists, "rid").select("rid", "blob", "ats"), "rid long, at long, content binary", cut)


def _pieces(contents: DataFrame, shape: Shape, size: int, above: tuple[int, ...]) -> DataFrame:
    """rid, at, block, whole, d1, d2: the cores of the blocks of `size` windows, and (whole) the bytes of all windows of a larger block.

    above: the sizes of coarser blocks so far, the last one split here. With any,
    contents holds hits: block, whole, lead of the blocks that go on.
    """
    most = shape.width - shape.gram

    def find(batch):
        content, at = batch["content"].to_pylist(), batch["at"].to_numpy()
        data = (b"" if shape.unit == "byte" else b" ").join(content)
        starts, ends = unit_bounds(np.frombuffer(data, dtype=np.uint8), shape.unit)
        lead, units = (at >> 8) & 255, (at & 255) + shape.width - 1
        low = lead - (at & 255) + 1
        anchor = np.cumsum(units) - units + lead
        row, block, whole = np.arange(len(at)), low // size, []
        n = lead // size - low // size + 1
        if above:
            hits = batch["hits"]
            flat, n_hits = hits.values, np.diff(hits.offsets.to_numpy())
            row = np.repeat(row, n_hits)
            block, equal, leads = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("block", "whole", "lead"))
            if len(above) > 1:  # blocks equal in whole go on for one of their kind only
                code = row * 1024 + block
                done = code[equal & ~leads]
                going = ~equal & ~np.isin(row * 1024 + block * above[-1] // above[-2], done)
                row, block = row[going], block[going]
            n = np.full(len(row), above[-1] // size)
            parent_row, parent, block = row, block, block * (above[-1] // size)
        again = np.repeat(np.arange(len(row)), n)
        block = block[again] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row = row[again]
        first, last = block * size, np.minimum(block * size + size - 1, most)
        fits = (first <= lead[row]) & (last >= low[row]) & (first <= most)
        row, block, first, last = row[fits], block[fits], first[fits], last[fits]
        lo, hi = anchor[row] - first, anchor[row] + shape.width - last
        whole = np.zeros(len(row), dtype=bool)
        if above and size > 1:
            first, last = parent * above[-1], np.minimum(parent * above[-1] + above[-1] - 1, most)
            fits = (first >= low[parent_row]) & (last <= lead[parent_row])
            lo, hi = np.concatenate((lo, (anchor[parent_row] - last)[fits])), np.concatenate((hi, (anchor[parent_row] + shape.width - first)[fits]))
            row, block = np.concatenate((row, parent_row[fits])), np.concatenate((block, parent[fits]))
            whole = np.concatenate((whole, np.ones(fits.sum(), dtype=bool)))
        digest = digests(data, starts[lo], ends[hi - 1])
        yield {"rid": batch["rid"].take(pa.array(row)), "at": at[row], "block": block.astype(np.int32), "whole": whole, "d1": digest[:, 0], "d2": digest[:, 1]}

    return arrow_map(contents, "rid long, at long, block int, whole boolean, d1 long, d2 long", find)


def repeated_spans(texts: DataFrame, repeated: DataFrame, shape: Shape) -> DataFrame:
    """rid, spans: the runs of repeated windows of each text that has any, as start << 16 | count.

    texts: rid, blob; repeated: key of every anchor piece that occurs at least twice.
    """
    met = stored(_records(texts, shape).join(repeated, "key", "left_semi"), "met")
    kinds = stored(met.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(F.struct("key", "rid", "at")).alias("one")).select("d1", "d2", "n", "one.*"), "kinds")
    whole = met.join(kinds.where("n > 1").select("d1", "d2"), ["d1", "d2"], "left_semi")
    spans = [stored(whole.select("rid", F.expr("shiftleft(shiftright(at, 16), 16) | (at & 255)").alias("span")), "spans")]
    forget(met)
    varied = kinds.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1")
    contents = stored(_contents(texts, kinds.join(varied, "key", "left_semi").select("rid", "at"), shape), "contents")
    forget(kinds)
    going, above, done = contents, (), [spans[0], contents]
    lead, most = "(shiftright(at, 8) & 255)", shape.width - shape.gram
    span = f"shiftleft(shiftright(at, 16) + {lead} - least(block * {{0}} + {{0}} - 1, {most}), 16) | (least({{0}}, {most} + 1 - block * {{0}}))"
    for size in shape.blocks:
        pieces = stored(_pieces(going, shape, size, above), "pieces")
        twice = pieces.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(F.struct("rid", "at")).alias("first")).where("n > 1")
        hits = stored(pieces.join(twice, ["d1", "d2"]).select("rid", "at", "block", "whole", (F.struct("rid", "at") == F.col("first")).alias("lead")), "hits")
        forget(pieces)
        done.append(hits)
        if size == 1:
            spans.append(hits.select("rid", F.expr(span.format(1)).alias("span")))
        elif above:
            spans.append(hits.where("whole").select("rid", F.expr(span.format(above[-1])).alias("span")))
        going = contents.join(hits.groupBy("rid", "at").agg(F.collect_list(F.struct("block", "whole", "lead")).alias("hits")), ["rid", "at"])
        above = (*above, size)
    out = stored(reduce(DataFrame.union, spans).groupBy("rid").agg(F.collect_set("span").alias("spans")), "repeated")
    for table in done:
        forget(table)
    return out


def covered(n_units: int, spans: np.ndarray, width: int) -> np.ndarray:
    """Which units stand in a repeated window."""
    step = np.zeros(n_units + 1, dtype=np.int32)
    start = spans >> 16
    np.add.at(step, start, 1)
    np.add.at(step, start + (spans & 0xFFFF) + width - 1, -1)
    return np.cumsum(step[:-1]) > 0


def cleaned(texts: DataFrame, spans: DataFrame, shape: Shape) -> DataFrame:
    """doc_id, n_units, n_removed, n_spans, kept (bytes): every row, with repeated units taken out."""
    joined = texts.join(spans, "rid", "left").select("doc_id", "blob", "spans")

    def clean(batch):
        total, removed, runs, kept = [], [], [], []
        for text, found in zip(unpacked(batch["blob"]), batch["spans"]):
            data = normal_bytes(text, shape.unit)
            starts, ends = unit_bounds(np.frombuffer(data, dtype=np.uint8), shape.unit)
            total.append(len(starts))
            if not found.is_valid:
                removed.append(0)
                runs.append(0)
                kept.append(data)
                continue
            mask = covered(len(starts), found.values.to_numpy(), shape.width)
            edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
            removed.append(int(mask.sum()))
            runs.append(int((edge == 1).sum()))
            gaps = zip(np.concatenate(([0], np.flatnonzero(edge == -1))).tolist(), np.concatenate((np.flatnonzero(edge == 1), [len(starts)])).tolist())
            kept.append((b"" if shape.unit == "byte" else b" ").join(data[starts[a] : ends[b - 1]] for a, b in gaps if b > a))
        yield {"doc_id": batch["doc_id"], "n_units": total, "n_removed": removed, "n_spans": runs, "kept": kept}

    kind = texts.schema["doc_id"].dataType.simpleString()
    return arrow_map(joined, f"doc_id {kind}, n_units long, n_removed long, n_spans long, kept binary", clean)


class RepeatIndex:
    """Texts, and the levels of an index over their anchor pieces, in one folder.

    entries: texts (rid, blob) to rows of (*columns, n); keys: matched entries to
    rows of key. With a folder that an earlier session filled, what is added now
    is held against all that is there.
    """

    def __init__(self, spark: SparkSession, shape: Shape, columns: list[str], entries: Callable, keys: Callable, folder: str | None = None):
        self.shape, self.entries, self.keys = shape, entries, keys
        self.levels = Levels(spark, columns, folder)

    def add(self, docs: DataFrame, batches: int = BATCHES) -> DataFrame:
        """Take in documents, batch after batch. Returns them cleaned of what repeats among them and all before."""
        with passing_shuffles(docs.sparkSession):
            mine = self.levels.keep("texts", packed(docs, len(self.levels.tables.get("texts", []))))
            for b in range(batches):
                self.levels.add(self.entries(mine.where(F.pmod(F.xxhash64("rid"), F.lit(batches)) == b)))
            spans = repeated_spans(self.levels.kept("texts"), self.keys(self.levels.kept("matches")), self.shape)
        return cleaned(mine, spans, self.shape)
