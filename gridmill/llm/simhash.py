"""SimHash near-dedup by Golay-code fuzzy hashing.

The [23,12] Golay code is perfect: every 23-bit word lies within 3 bits of
exactly one codeword. A segment's keys are the codewords that it, or it with any
one bit turned, decodes to: one key where it is within 2 bits of a codeword,
else six. Two segments that differ in at most 2 bits share a key, for a word
between them lies within one bit of both.

Fingerprints of 64 bits have segments A and B of 23 bits and C of 18. At most 4
differing bits over three segments leave two cases. If a segment has none, one
of the other two has at most 2: key (that segment as it is, a Golay key of the
other), six ordered choices. If every segment has one or more, none has over 2:
key (a Golay key of A, a Golay key of B, a part of C). So no link is missed.

What shares a key is a bucket. Each bucket is visited once, in one task, and
hands on a spanning forest of its links: at most one edge a member, never all
pairs. A bucket over CROWD members is dealt in blocks, so no task holds more.

Texts whose word shingles are similar can differ in more bits. For those,
near_copies takes fingerprints of 92 bits over the set of words: four segments,
a key of each two. Its forests give groups of candidates, and each group's
pairs are verified by the exact similarity of their shingle sets, in blocks too.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.bytehash import word_spans
from gridmill.llm.common import arrow_map, connected_components, sorted_groups, spanning, stored, text_bytes
from gridmill.llm.windows import WORD_BYTE

BITS = 4
SHINGLE = 4
SEED = 42

#: Generator polynomial of the [23,12] Golay code.
GENERATOR = 0xAE3
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Members of a bucket that a task compares at once.
CROWD = 4096
#: near_copies: words in a shingle, the similarity as a fraction, and the bits of 92 that candidates may differ in.
NEAR_SHINGLE, NEAR_SIMILARITY, NEAR_BITS = 5, (4, 5), 16
#: near_copies: texts and their bytes that a task verifies at once, twice for two blocks.
NEAR_CROWD, NEAR_BYTES = 1024, 8 << 20


def _syndrome(words: np.ndarray) -> np.ndarray:
    words = words.copy()
    for bit in range(22, 10, -1):
        words ^= ((words >> bit) & 1) * (GENERATOR << (bit - 11))
    return words


def _error_table() -> np.ndarray:
    """The error of at most 3 bits for each of the 2048 syndromes."""
    errors = np.array([sum(1 << b for b in c) for n in range(4) for c in combinations(range(23), n)], dtype=np.int64)
    table = np.zeros(2048, dtype=np.int64)
    table[_syndrome(errors)] = errors
    return table


_ERRORS = _error_table()
_TURNS = np.array([0] + [1 << b for b in range(23)], dtype=np.int64)


def golay_keys(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, valid), both n x 24: numbers of the codewords; valid marks each different one once."""
    words = segment[:, None] ^ _TURNS
    keys = np.sort((words ^ _ERRORS[_syndrome(words)]) >> 11, axis=1)
    valid = np.ones(keys.shape, dtype=bool)
    valid[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return keys, valid


def bucket_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the buckets of each fingerprint (n x 1, uint64) that hold all within 4 bits."""
    fingerprints = fingerprints[:, 0]
    parts = [((fingerprints >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64) for at, size in SEGMENTS]
    golay = [golay_keys(p) for p in parts]
    rows, keys = [], []
    for tag, (s, t) in enumerate([(s, t) for s in range(3) for t in range(3) if s != t]):
        row, col = np.nonzero(golay[t][1])
        rows.append(row)
        keys.append((tag << 40) | (parts[s][row] << 12) | golay[t][0][row, col])
    both = golay[0][1][:, :, None] & golay[1][1][:, None, :]
    row, i, j = np.nonzero(both)
    for part in range(3):
        rows.append(row)
        keys.append(((6 + part) << 40) | (golay[0][0][row, i] << 18) | (golay[1][0][row, j] << 6) | ((parts[2][row] >> 6 * part) & 63))
    return np.concatenate(rows), np.concatenate(keys)


def wide_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the buckets of fingerprints of 92 bits (n x 2, 46 bits each), one for Golay keys of each two of four segments."""
    golay = [golay_keys(((fingerprints[:, i // 2] >> np.uint64(23 * (i % 2))) & np.uint64((1 << 23) - 1)).astype(np.int64)) for i in range(4)]
    rows, keys = [], []
    for tag, (s, t) in enumerate(combinations(range(4), 2)):
        row, i, j = np.nonzero(golay[s][1][:, :, None] & golay[t][1][:, None, :])
        rows.append(row)
        keys.append((tag << 24) | (golay[s][0][row, i] << 12) | golay[t][0][row, j])
    return np.concatenate(rows), np.concatenate(keys)


_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def _majority(hashes: np.ndarray, owner: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each owner, the bits that over half of its n hashes have."""
    out = np.zeros(len(n), dtype=np.uint64)
    for byte in range(8):
        value = ((hashes >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64)
        ones = np.bincount(owner * 256 + value, minlength=len(n) * 256).reshape(-1, 256) @ _BYTE_BITS
        out |= ((2 * ones > n[:, None]).astype(np.uint64) << np.arange(8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) << np.uint64(8 * byte)
    return out


def simhash(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprint of each text (uint64): a bit is 1 if set in over half the hashes of its shingles."""
    out = np.zeros(len(texts), dtype=np.uint64)
    for lo in range(0, len(texts), 256):
        normal = [b" ".join(t.lower().split()) for t in texts[lo : lo + 256]]
        data = b" ".join(normal)
        starts, ends = word_spans(np.frombuffer(data, dtype=np.uint8), WORD_BYTE)
        edge = np.cumsum([0] + [len(t) + 1 for t in normal])
        first = np.searchsorted(starts, edge)
        words = np.diff(first)
        n = np.where(words == 0, 0, np.maximum(words - shingle + 1, 1))
        owner = np.repeat(np.arange(len(normal)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[owner]
        stop = np.minimum(at + shingle, first[owner + 1]) - 1
        view = memoryview(data)
        h = np.array([xxhash.xxh64_intdigest(view[a:b], SEED) for a, b in zip(starts[at].tolist(), ends[stop].tolist())], dtype=np.uint64)
        out[lo : lo + len(normal)] = _majority(h, owner, n)
    return out


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints (m x k and k, or m x 1 x k and n x k)."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def bucket_forest(bits: np.ndarray, most: int, outside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (i, j) of the links among fingerprints (m x k). Walks from one to all it reaches, then starts anew.

    outside: only links with a row so marked count (on either side).
    """
    if len(bits) <= 64:
        near = np.triu(_differing(bits[:, None], bits[None]) <= most, 1)
        if outside is not None:
            near &= outside[:, None] | outside[None]
        return np.nonzero(near)
    waiting = np.arange(len(bits))
    edges = []
    while len(waiting) > 1:
        front, waiting = [waiting[0]], waiting[1:]
        while front and len(waiting):
            i = front.pop()
            near = _differing(bits[waiting], bits[i]) <= most
            if outside is not None and not outside[i]:
                near &= outside[waiting]
            if near.any():
                hit = waiting[near]
                edges.append((np.full(len(hit), i), hit))
                front += hit.tolist()
                waiting = waiting[~near]
    return tuple(np.concatenate(x) for x in zip(*edges)) if edges else (np.zeros(0, dtype=np.int64),) * 2


def linked_edges(nodes: DataFrame, keys, most: int, crowd: int = CROWD) -> DataFrame:
    """a, b: edges that join all nodes whose fingerprints share a key and differ in at most `most` bits.

    nodes: node (long, distinct), then the fingerprint's longs; a fingerprint
    stands once. keys: fingerprints (n x k, uint64) to (row, key). Rows meet
    sorted by key. A bucket over `crowd` members isn't held in memory but named,
    and those named are dealt in blocks in a second pass: members near its least
    are joined by that, so only pairs with one of the others are left, and blocks
    of these meet blocks of all.
    """
    names = nodes.columns
    width = len(names) - 1 or 1  # a fingerprint of one long can be its own node

    def find(batch):
        columns = [batch[c].to_numpy() for c in names]
        for lo in range(0, len(columns[0]), 4096):
            bits = np.stack([c[lo : lo + 4096].view(np.uint64) for c in columns[-width:]], axis=1)
            row, key = keys(bits)
            yield {"key": key} | {n: c[lo : lo + 4096][row] for n, c in zip(names, columns)}

    rows = arrow_map(nodes, ", ".join(["key long", *(f"{n} long" for n in names)]), find).repartition("key")
    first = rows.withColumn("outside", F.lit(True)).sortWithinPartitions("key").mapInArrow(_visits(names, most, crowd), "a long, b long, crowded long")
    found = stored(first, "links")
    edges = found.where("crowded is null").select("a", "b")
    crowded = found.where("crowded is not null").select(F.col("crowded").alias("key"))
    if crowded.isEmpty():
        return edges
    member = F.struct(*names)
    many = stored(rows.join(crowded, "key", "left_semi"), "crowds")
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"lo.{c}"))) for c in names[-width:]), F.lit(0))
    many = many.join(many.groupBy("key").agg(F.min(member).alias("lo")), "key").withColumn("outside", apart > most)
    hubs = many.where("not outside").select(F.col(f"lo.{names[0]}").alias("a"), F.col(names[0]).alias("b"))
    sizes = many.groupBy("key").agg(F.ceil(F.count("*") / crowd).cast("int").alias("chunks"), F.ceil(F.count_if("outside") / crowd).cast("int").alias("blocks"))
    dealt = many.join(sizes.where("blocks > 0"), "key").withColumn("chunk", F.pmod(F.hash(names[0], F.lit(1)), F.col("chunks"))).withColumn("part", F.pmod(F.hash(names[0], F.lit(2)), F.col("blocks")))
    # all members go to their chunk once for each block of those outside, and those outside to their block once for each chunk
    places = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda p: F.struct(p.alias("p"), F.col("chunk").alias("c"), F.lit(False).alias("o")))
    more = F.when(F.col("outside"), F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.col("part").alias("p"), c.alias("c"), F.lit(True).alias("o"))))
    dealt = dealt.withColumn("to", F.explode(F.concat(places, F.coalesce(more, F.array().cast("array<struct<p:int,c:int,o:boolean>>")))))
    dealt = dealt.select(F.xxhash64("key", "to.p", "to.c").alias("block"), *names, F.col("to.o").alias("outside"))
    second = dealt.repartition("block").sortWithinPartitions("block").mapInArrow(_visits(names, most, None), "a long, b long, crowded long")
    return stored(edges.union(hubs).union(second.select("a", "b")).where("a <> b"), "links")


def _visits(names: list[str], most: int, crowd: int | None):
    """A mapInArrow function over rows sorted by key (or block): spanning edges of each bucket, and the keys of those over `crowd`."""
    width = len(names) - 1 or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        size, crowded = 0, []

        def out() -> pa.RecordBatch:
            a, b = spanning(*(np.concatenate(x) for x in zip(*edges))) if edges else (np.zeros(0, dtype=np.int64),) * 2
            named = pa.array([None] * len(a) + crowded, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([*a.tolist(), *crowded], pa.int64()), pa.array([*b.tolist(), *crowded], pa.int64()), named], ["a", "b", "crowded"])

        for table, edge, over in sorted_groups(batches, crowd):
            crowded += over
            node = table[names[0]].to_numpy()
            bits = np.stack([table[c].to_numpy().view(np.uint64) for c in names[-width:]], axis=1)
            n = np.diff(edge)
            two = edge[:-1][n == 2]
            two = two[_differing(bits[two], bits[two + 1]) <= most]
            found = [(node[two], node[two + 1])] if len(two) else []
            for lo, hi in zip(edge[:-1][n > 2].tolist(), edge[1:][n > 2].tolist()):
                outside = table["outside"].slice(lo, hi - lo).to_numpy() if crowd is None else None
                i, j = bucket_forest(bits[lo:hi], most, outside)
                if len(i):
                    found.append((node[lo + i], node[lo + j]))
            edges += found
            size += sum(len(a) for a, _ in found)
            if size > 200_000:
                yield out()
                edges, size, crowded = [], 0, []
        if edges or crowded:
            yield out()

    return run


def simhash_dedup(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """Fingerprint every document and join those whose fingerprints differ in at most `bits` (<= 4) bits.

    docs: doc_id, text. Returns doc_id, fp (64 bits as a long), component (a
    fingerprint that stands for the group), component_id (smallest doc_id
    reachable over links, own included), a row for each input row. Texts
    without words (null, empty) have fingerprint 0, which links like any other.
    Rows with a null doc_id take part but never name a component unless all its
    doc_ids are null. Repeated rows have one fingerprint. Other columns, of
    whatever name, are ignored; no rows give no rows.
    """

    def find(batch):
        yield {"doc_id": batch["doc_id"], "fp": simhash(batch["text"].to_pylist(), shingle).view(np.int64)}

    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = stored(arrow_map(docs.select("doc_id", text_bytes().alias("text")), f"doc_id {kind}, fp long", find), "fingerprints")
    fps = marked.groupBy("fp").agg(F.min("doc_id").alias("low"))
    component = connected_components(linked_edges(fps.select("fp"), bucket_keys, bits, crowd))
    placed = fps.join(component, fps.fp == component.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("c"))
    low = placed.groupBy("c").agg(F.min("low").alias("component_id"))
    named = placed.join(low, "c").select("fp", F.col("c").alias("component"), "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component", "component_id")


def shingle_set(text: bytes, shingle: int = NEAR_SHINGLE) -> np.ndarray:
    """Hashes of a text's different shingles, sorted; none for a text without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    grams = {b" ".join(words[i : i + shingle]) for i in range(max(len(words) - shingle + 1, 1))}
    return np.unique(np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], dtype=np.uint64).view(np.int64))


def word_prints(texts: list[bytes]) -> np.ndarray:
    """Fingerprint of each text's set of words: 92 bits as two longs of 46."""
    words = [list(set(t.lower().split())) for t in texts]
    n = np.array([len(w) for w in words])
    owner = np.repeat(np.arange(len(texts)), n)
    out = [_majority(np.array([xxhash.xxh64_intdigest(w, seed) for own in words for w in own], dtype=np.uint64), owner, n) for seed in (SEED, SEED + 1)]
    return np.stack(out, axis=1) & np.uint64((1 << 46) - 1)


def similar_forest(sets: list[np.ndarray], similarity: tuple[int, int], side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the pairs of sets whose overlap is at least similarity of their union; with sides, of pairs between them."""
    p, q = similarity
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    shingle, place = np.unique(np.concatenate(sets) if len(owner) else np.zeros(0, dtype=np.int64), return_inverse=True)
    order = np.argsort(place, kind="stable")
    holders, edge = owner[order], np.searchsorted(place[order], np.arange(len(shingle) + 1))
    first = np.cumsum(n) - n
    free = n > 0
    edges = []
    for start in range(len(sets)):
        if not free[start]:
            continue
        free[start] = False
        front = [start]
        while front:
            i = front.pop()
            lists = place[first[i] : first[i] + n[i]]
            overlap = np.bincount(np.concatenate([holders[edge[x] : edge[x + 1]] for x in lists.tolist()]), minlength=len(sets))
            near = free & ((p + q) * overlap >= p * (n[i] + n))
            if side is not None:
                near &= side != side[i]
            hit = np.flatnonzero(near)
            if len(hit):
                free[hit] = False
                edges.append((np.full(len(hit), i), hit))
                front += hit.tolist()
    return tuple(np.concatenate(x) for x in zip(*edges)) if edges else (np.zeros(0, dtype=np.int64),) * 2


def near_copies(rows: DataFrame, shingle: int = NEAR_SHINGLE, similarity: tuple[int, int] = NEAR_SIMILARITY, bits: int = NEAR_BITS, crowd: int = NEAR_CROWD, most_bytes: int = NEAR_BYTES) -> DataFrame:
    """Join texts whose sets of word shingles have a Jaccard similarity of at least p/q, given as (p, q).

    rows: rid (long, of its own), text. Returns rid, component (the least rid of
    the group over chains of links), a row for each input row. Texts with equal
    shingle sets, and those without words (null, empty), are one group each.
    Candidates differ in at most `bits` of 92 bits and share a Golay key; each
    group of candidates is verified pair by pair on whole sets. Other columns
    are ignored; no rows give no rows.
    """

    def mark(batch):
        texts = batch["text"].to_pylist()
        for lo in range(0, len(texts), 256):
            part = texts[lo : lo + 256]
            digest = [xxhash.xxh3_128_digest(shingle_set(t, shingle).tobytes()) for t in part]
            prints = word_prints(part).view(np.int64)
            yield {"rid": batch["rid"].slice(lo, 256), "digest": digest, "f1": prints[:, 0], "f2": prints[:, 1], "size": [len(t) for t in part]}

    texts = rows.select("rid", text_bytes().alias("text"))
    marked = stored(arrow_map(texts, "rid long, digest binary, f1 long, f2 long, size long", mark), "marked")
    kinds = marked.groupBy("digest", "f1", "f2").agg(F.min(F.struct("rid", "size")).alias("one")).where(F.col("digest") != F.lit(xxhash.xxh3_128_digest(b"")))
    kinds = stored(kinds.select("one.*", "f1", "f2"), "kinds")
    prints = stored(kinds.groupBy("f1", "f2").agg(F.min("rid").alias("node")), "prints")
    loose = connected_components(linked_edges(prints.select("node", "f1", "f2"), wide_keys, bits))
    # texts with one fingerprint are candidates too, whether or not theirs meets another
    loose = prints.join(loose, "node", "left").select("f1", "f2", F.coalesce("component", "node").alias("loose"))
    placed = stored(kinds.join(loose, ["f1", "f2"]).select("rid", "size", "loose"), "placed")
    blocks = F.greatest(F.ceil(F.count("*") / crowd), F.ceil(F.sum("size") / most_bytes)).cast("int")
    groups = placed.groupBy("loose").agg(F.count("*").alias("texts"), blocks.alias("blocks")).where("texts > 1")
    wanted = placed.join(groups, "loose").withColumn("part", F.pmod(F.hash("rid"), F.col("blocks")))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("x"), F.greatest(o, F.col("part")).alias("y")))
    dealt = texts.join(wanted.select("rid", "loose", "part", pairs.alias("to")), "rid").withColumn("to", F.explode("to"))
    dealt = dealt.select(F.xxhash64("loose", "to.x", "to.y").alias("block"), "rid", "text", F.when(F.col("to.x") != F.col("to.y"), F.col("part") == F.col("to.x")).alias("side"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edge, _ in sorted_groups(batches):
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                group = table.slice(lo, hi - lo)
                side = None if group["side"].null_count else group["side"].to_numpy(zero_copy_only=False)
                i, j = similar_forest([shingle_set(t, shingle) for t in group["text"].to_pylist()], similarity, side)
                if len(i):
                    ids = group["rid"].to_numpy()
                    a, b = spanning(ids[i], ids[j])
                    yield pa.RecordBatch.from_pydict({"a": a, "b": b})

    edges = stored(dealt.repartition("block").sortWithinPartitions("block").mapInArrow(verify, "a long, b long"), "links")
    component = connected_components(edges)
    low = marked.groupBy("digest").agg(F.min("rid").alias("least"))
    named = low.join(component, F.col("least") == F.col("node"), "left").select("digest", F.coalesce("component", "least").alias("component"))
    return marked.select("rid", "digest").join(named, "digest").select("rid", "component")


def op3_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = simhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
