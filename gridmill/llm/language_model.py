"""LM scoring by online logistic context mixing.

Text is predicted bit by bit, each byte being eight decisions down a binary
tree. For each decision, one predictor per context length (the last 1 to 5
bytes) looks up the counts of zeros and ones in a hashed table. Their logits
are combined by a mixer whose weights are chosen by a gate, the bit's place, the longest context seen before and how often, and a last table refines the mixed
probability by what came true at such predictions. log2 of the result, summed,
gives total bits.

How it is learned from all training texts:

1. Runs of six bytes are counted over the corpus (map-side first).
2. Runs are dealt in PARTS by the two bytes before the last. A part's contexts
   belong to it alone, so it fills its own slots in one task, and no table is
   summed over tasks. A part gets slots in proportion to the different contexts
   that it has, up to SLOTS for each predictor over all parts: what tasks and
   workers hold in memory has that bound, and beyond it contexts share slots.
3. The mixer learns online: each task takes its share of the runs in small
   steps, weighted by how often they occur, and sees each run as if the tables
   hadn't counted it once; tasks' weights are averaged. The refining table is
   counted the same way.

Predictions depend on a run alone, so a worker remembers those it has made, in
a table of fixed size, and sums per text.

Beside it stands a unigram word model with add-half smoothing; its counts of
frequent words travel as a table of fixed size, other words are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.bytehash import mix
from gridmill.llm.common import arrow_map, stored, text_bytes

#: Context bytes of each predictor.
ORDERS = (1, 2, 3, 4, 5)
#: Slots of a predictor's table, at most.
SLOTS = 1 << 21
PARTS = 64
GRAM = 6
#: Counts from which the longest context seen is the more trusted.
TRUST = (1.5, 3.5, 12.5)
GATES = 8 * (len(ORDERS) + 1) * (len(TRUST) + 1)
RUNGS = 33
#: Frequent words whose counts every task holds.
COMMON_WORDS = 1 << 17
#: Different entries that a task gathers before it hands them on.
FLUSH = 1 << 20
#: Counts n are kept as codes of 16 bits, in steps of log2(n + 1): any count fits, to 1 part in 1,400.
_CODE = 1024
_COUNT = (np.exp2(np.arange(1 << 16) / _CODE) - 1).astype(np.float32)
_LOG = np.log(_COUNT + np.float32(0.4))
_BYTES_AT_ONCE = 1 << 19


def coded(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(np.log2(counts + 1.0) * _CODE), (1 << 16) - 1).astype(np.uint16)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(runs, sizes): a run of six bytes for each byte of each text and for its end, which is a zero byte; zeros stand before a text."""
    data = np.frombuffer(b"\0" * (GRAM - 1) + (b"\0" * GRAM).join(texts) + b"\0", dtype=np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    n = len(data) - GRAM + 1
    runs = np.zeros(n, dtype=np.uint64)
    for i in range(GRAM):
        runs = (runs << np.uint64(8)) | data[i : i + n]
    first = np.cumsum(sizes + GRAM - 1) - sizes - GRAM + 1
    keep = np.ones(n, dtype=bool)
    for i in range(GRAM - 1):
        keep[first[1:] - 1 - i] = False
    return runs[keep], sizes


def _portions(texts: list[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > _BYTES_AT_ONCE:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def part_of(runs: np.ndarray) -> np.ndarray:
    """The part of each run, by the two bytes before its last."""
    return (((runs >> np.uint64(8)) & np.uint64(0xFFFF)) * np.uint64(40503) >> np.uint64(10)).astype(np.int64) & (PARTS - 1)


#: The same in SQL.
PART = f"cast(shiftright((shiftright(gram, 8) & 65535) * 40503, 10) & {PARTS - 1} as int)"


def _context(runs: np.ndarray, order: int) -> np.ndarray:
    return (runs >> np.uint64(8)) & np.uint64((1 << 8 * order) - 1)


class Layout:
    """Which slots each part has in each predictor's table."""

    def __init__(self, contexts: np.ndarray, most: int = SLOTS, spread: int = 16):
        """contexts: predictors x parts, the different contexts with the byte that follows; spread: slots for each where there is room."""
        wanted = np.maximum(spread * contexts, 64).astype(np.int64)
        over = np.maximum(wanted.sum(axis=1) / most, 1)[:, None]
        self.size = np.maximum(wanted / over, 64).astype(np.int64)
        flat = np.cumsum(self.size.ravel())
        self.total = int(flat[-1])
        self.start = (flat - self.size.ravel()).reshape(self.size.shape)

    def prepared(self, runs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each predictor, the context of each run with room for the path, and the first slot and the slots of its part."""
        part = part_of(runs)
        return [(_context(runs, order) << np.uint64(8), self.start[i][part], self.size[i][part].astype(np.uint64)) for i, order in enumerate(ORDERS)]

    def nodes(self, prepared: list, byte: np.ndarray, bit: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The slot of each predictor, and the bit that came, at one of the eight decisions."""
        path = (byte | np.uint64(256)) >> np.uint64(8 - bit)
        slots = []
        for i, (context, start, size) in enumerate(prepared):
            h = mix((context | path) * np.uint64(2 * i + 3) + np.uint64(i))
            slots.append(((h >> np.uint64(32)) * size >> np.uint64(32)).view(np.int64) + start)
        return slots, ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)


class Mixer:
    """Bit tables, gated weights and the refining table."""

    def __init__(self, layout: Layout, counts: np.ndarray):
        self.layout, self.counts = layout, counts  # codes of zeros and ones, 2 x slots
        self.weights = np.full((GATES, len(ORDERS)), 0.3)
        self.refined: np.ndarray | None = None  # GATES x RUNGS logits

    def remembered(self):
        """log2 with a memory that lasts as long as this copy of the model."""
        if not hasattr(self, "memory"):
            self.memory = Remembered(self)
        return self.memory.log2

    def inputs(self, prepared: list, byte: np.ndarray, bit: int, without: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logits of the predictors, gate, bit). without: as if the tables had not counted the run once."""
        slots, one = self.layout.nodes(prepared, byte, bit)
        x = np.empty((len(ORDERS), len(byte)), dtype=np.float32)
        longest, at = np.zeros(len(byte), dtype=np.int64), np.zeros(len(byte), dtype=np.int64)
        for i, slot in enumerate(slots):
            n0, n1 = self.counts[0][slot], self.counts[1][slot]
            if without:
                zeros, ones = np.maximum(_COUNT[n0] - ~one, 0), np.maximum(_COUNT[n1] - one, 0)
                x[i] = np.log(ones + np.float32(0.4)) - np.log(zeros + np.float32(0.4))
                seen = zeros + ones > 0.5
            else:
                x[i] = _LOG[n1] - _LOG[n0]
                seen = (n0 | n1) > 0
            np.copyto(longest, i + 1, where=seen)
            np.copyto(at, slot, where=seen)
        total = (_COUNT[self.counts[0][at]] + _COUNT[self.counts[1][at]] - without) * (longest > 0)
        trust = sum((total > least).astype(np.int64) for least in TRUST)
        return x, (longest * (len(TRUST) + 1) + trust) * 8 + bit, one

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip((x * self.weights.T.astype(np.float32)[:, gate]).sum(axis=0), -12, 12)

    def learn(self, runs: np.ndarray, times: np.ndarray, rate: float) -> None:
        """One online step over a few runs: weights move before the next step sees them."""
        prepared, byte = self.layout.prepared(runs), runs & np.uint64(255)
        for bit in range(8):
            x, gate, one = self.inputs(prepared, byte, bit, True)
            error = (one - 1 / (1 + np.exp(-self.mixed(x, gate)))) * times
            total = np.bincount(gate, times, GATES)
            for i in range(len(ORDERS)):
                self.weights[:, i] += rate * np.bincount(gate, error * x[i], GATES) / np.maximum(total, 1)

    def rungs(self, logit: np.ndarray) -> np.ndarray:
        return np.rint((logit + 12) * (RUNGS - 1) / 24).astype(np.int64)

    def log2(self, runs: np.ndarray) -> np.ndarray:
        """log2 of the probability of each run's last byte after its first five."""
        total = np.zeros(len(runs))
        prepared, byte = self.layout.prepared(runs), runs & np.uint64(255)
        for bit in range(8):
            x, gate, one = self.inputs(prepared, byte, bit, False)
            logit = self.mixed(x, gate)
            if self.refined is not None:
                logit = (logit + self.refined[gate, self.rungs(logit)]) / 2
            total -= np.logaddexp(0, np.where(one, -logit, logit))
        return total / np.log(2)


class Remembered:
    """A mixer with a table of fixed size that remembers predictions by run."""

    SLOTS_LOG2 = 21

    def __init__(self, model: Mixer):
        self.model = model
        self.run = np.full(1 << self.SLOTS_LOG2, (1 << 64) - 1, dtype=np.uint64)
        self.value = np.zeros(1 << self.SLOTS_LOG2)

    def log2(self, runs: np.ndarray) -> np.ndarray:
        slot = (mix(runs) >> np.uint64(64 - self.SLOTS_LOG2)).astype(np.int64)
        out = self.value[slot]
        new = np.flatnonzero(self.run[slot] != runs)
        if len(new):
            kinds, where = np.unique(runs[new], return_inverse=True)
            value = self.model.log2(kinds)
            out[new] = value[where]
            slot, first = np.unique((mix(kinds) >> np.uint64(64 - self.SLOTS_LOG2)).astype(np.int64), return_index=True)
            self.run[slot] = kinds[first]
            self.value[slot] = value[first]
        return out


def _gather(fold, schema: str, df: DataFrame) -> DataFrame:
    """mapInArrow that gathers over batches; fold(state, batch) returns (state, record batches to hand on); batch None ends."""

    def run(batches):
        state = None
        for batch in batches:
            if batch.num_rows:
                state, out = fold(state, batch)
                yield from out
        yield from fold(state, None)[1]

    return df.mapInArrow(run, schema)


def count_grams(texts: DataFrame) -> DataFrame:
    """gram, n over all rows of texts (text: binary)."""

    def merged(parts):
        runs, where = np.unique(np.concatenate([r for r, _ in parts]), return_inverse=True)
        return runs, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)

    def fold(state, batch):
        parts, out = state or [], []
        for portion in _portions(batch.column(0).to_pylist()) if batch is not None else ():
            parts.append(np.unique(grams(portion)[0], return_counts=True))
            if sum(len(r) for r, _ in parts) > FLUSH:
                parts = [merged(parts)]
                if len(parts[0][0]) > FLUSH // 2:
                    out.append(parts.pop())
        if batch is None and parts:
            out.append(merged(parts))
        return parts, [pa.RecordBatch.from_pydict({"gram": r.view(np.int64), "n": m}) for r, m in out]

    return _gather(fold, "gram long, n long", texts).groupBy("gram").agg(F.sum("n").alias("n"))


def _layout(counted: DataFrame, *limits: int) -> Layout:
    """Slots by the approximate number of different contexts, with their next byte, in each part."""
    keys = [f"gram & {(1 << 8 * (order + 1)) - 1}" for order in ORDERS]
    found = counted.groupBy(F.expr(PART).alias("part")).agg(*(F.approx_count_distinct(F.expr(k)).alias(f"n{i}") for i, k in enumerate(keys))).collect()
    contexts = np.zeros((len(ORDERS), PARTS))
    for row in found:
        contexts[:, row.part] = row[1:]
    return Layout(contexts, *limits)


def _tables(counted: DataFrame, layout: Layout) -> np.ndarray:
    """Coded zeros and ones of each slot, 2 x slots. Each part fills its own slots, in one stream of its runs."""

    def handed(part: int, state: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"part": [part], "codes": [coded(state).tobytes()]})

    def fill(batches):
        part, state, base, first = -1, None, None, None
        for batch in batches:
            parts = batch.column(0).to_numpy()
            edge = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            for a, b in zip(edge[:-1], edge[1:]):
                if a == b:
                    continue
                if parts[a] != part:
                    if state is not None:
                        yield handed(part, state)
                    part = int(parts[a])
                    size = layout.size[:, part]
                    state, base, first = np.zeros((2, size.sum())), layout.start[:, part], np.cumsum(size) - size
                runs, n = batch.column(1).to_numpy()[a:b].view(np.uint64), batch.column(2).to_numpy()[a:b]
                prepared, byte = layout.prepared(runs), runs & np.uint64(255)
                for bit in range(8):
                    slots, one = layout.nodes(prepared, byte, bit)
                    for i, slot in enumerate(slots):
                        at = slot - base[i] + first[i]
                        np.add.at(state[0], at[~one], n[~one])
                        np.add.at(state[1], at[one], n[one])
        if state is not None:
            yield handed(part, state)

    dealt = counted.select(F.expr(PART).alias("part"), "gram", "n").repartition(PARTS, "part").sortWithinPartitions("part")
    out = np.zeros((2, layout.total), dtype=np.uint16)
    for row in stored(dealt.mapInArrow(fill, "part long, codes binary"), "tables").toLocalIterator():  # of bounded size, see Layout
        codes, at = np.frombuffer(row.codes, dtype=np.uint16).reshape(2, -1), 0
        for i in range(len(ORDERS)):
            start, size = layout.start[i][row.part], layout.size[i][row.part]
            out[:, start : start + size] = codes[:, at : at + size]
            at += size
    return out


def fit(training: DataFrame, *limits: int) -> Mixer:
    """Learn the mixing model from all rows of training (text: binary). limits: see Layout."""
    spark, counted = training.sparkSession, stored(count_grams(training), "grams")
    layout = _layout(counted, *limits)
    counts = _tables(counted, layout)
    shared = spark.sparkContext.broadcast((layout, counts))

    def learn(state, batch):
        if state is None:
            state = (Mixer(*shared.value), 0)
        model, done = state
        if batch is None:
            return state, [pa.RecordBatch.from_pydict({"steps": [done], "weights": [model.weights.ravel()]})] if done else []
        runs, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
        for lo in range(0, len(runs), 1024):
            model.learn(runs[lo : lo + 1024], n[lo : lo + 1024].astype(float), 0.25 / np.sqrt(1 + done / 20))
            done += 1
        return (model, done), []

    learned = _gather(learn, "steps long, weights array<double>", counted).collect()
    model = Mixer(layout, counts)
    if learned:
        model.weights = np.average([r.weights for r in learned], axis=0, weights=[r.steps for r in learned]).reshape(GATES, -1)
    weights = model.weights

    def refine(state, batch):
        if state is None:
            state = (Mixer(*shared.value), np.zeros((2, GATES * RUNGS)))
            state[0].weights = weights
        tuned, seen = state
        if batch is None:
            return state, [pa.RecordBatch.from_pydict({"zeros": [seen[0]], "ones": [seen[1]]})]
        runs, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
        prepared, byte = tuned.layout.prepared(runs), runs & np.uint64(255)
        for bit in range(8):
            x, gate, one = tuned.inputs(prepared, byte, bit, True)
            at = gate * RUNGS + tuned.rungs(tuned.mixed(x, gate))
            seen[0] += np.bincount(at[~one], n[~one], GATES * RUNGS)
            seen[1] += np.bincount(at[one], n[one], GATES * RUNGS)
        return state, []

    seen = _gather(refine, "zeros array<double>, ones array<double>", counted).collect()
    centre = np.tile(np.arange(RUNGS) * 24 / (RUNGS - 1) - 12, GATES)
    prior = 1 / (1 + np.exp(-centre))
    zeros, ones = (np.sum([r[k] for r in seen], axis=0) if seen else np.zeros(GATES * RUNGS) for k in ("zeros", "ones"))
    model.refined = np.log((ones + 20 * prior) / (zeros + 20 * (1 - prior))).reshape(GATES, RUNGS)
    return model


def count_words(texts: DataFrame) -> DataFrame:
    """word, c over all rows of texts (text: binary)."""

    def fold(state, batch):
        counts, out = state if state is not None else Counter(), []
        for t in batch.column(0).to_pylist() if batch is not None else ():
            counts.update(t.lower().split())
            if len(counts) > FLUSH // 2:
                out.append(counts)
                counts = Counter()
        if batch is None:
            out.append(counts)
        return counts, [pa.RecordBatch.from_pydict({"word": pa.array(list(c), pa.binary()), "c": pa.array(list(c.values()), pa.int64())}) for c in out]

    return _gather(fold, "word binary, c long", texts).groupBy("word").agg(F.sum("c").alias("c"))


def lm_scores(docs: DataFrame, common: int = COMMON_WORDS, slots: int = SLOTS, model: Mixer | None = None) -> DataFrame:
    """Score whole texts by both models, learned from rows whose crc32(doc_id as text) mod 5 is not 1.

    docs: doc_id, text. Returns a row for each input row: doc_id, held_out,
    n_tokens (words and one end), n_known, train_tokens, base_score (log10, the
    unigram model), score (log10, the mixing model), bits_per_byte (null for no
    bytes). Null texts are empty and have the end alone. Rows with a null
    doc_id count as training. A `model` that fit() learned spares the learning. Without training rows every count is zero and
    the mixing model gives each bit one half. Repeated rows count each time; long
    texts count whole; other columns, of whatever name, are ignored; no rows give
    no rows.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False)).alias("held_out"), text_bytes().alias("text"))
    training = rows.where("not held_out").select("text")
    vocabulary = stored(count_words(training), "words")
    words, kinds = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = training.select(F.lit(1)).count()
    n_train, n_kinds = words + ends, kinds + (ends > 0)
    frequent = vocabulary.orderBy(F.desc("c"), "word").limit(common).toArrow()
    held = dict(zip(frequent["word"].to_pylist(), frequent["c"].to_pylist()))
    if model is None:
        model = fit(training, slots)
    shared = spark.sparkContext.broadcast((held, model))
    log_all = float(np.log10(n_train + 0.5 * (n_kinds + 1)))

    def score(batch):
        held, model = shared.value
        predict = model.remembered()
        texts = batch["text"].to_pylist()
        n, known, base, rest = [], [], [], []
        for t in texts:
            tokens = t.lower().split()
            c = [held.get(w, 0) for w in tokens]
            rest.append([w for w, k in zip(tokens, c) if not k])
            here = np.array([k for k in c if k], dtype=np.float64)
            n.append(len(tokens) + 1)
            known.append(len(here) + (ends > 0))
            base.append(float(np.log10(here + 0.5).sum() + np.log10(ends + 0.5)))
        mixed = []
        for part in _portions(texts):
            runs, sizes = grams(part)
            mixed.append(np.add.reduceat(predict(runs), np.cumsum(sizes) - sizes))
        bits = np.concatenate(mixed)
        yield {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "n_bytes": [len(t) for t in texts], "n_tokens": n, "known": known, "base": base, "bits": bits, "rest": rest}

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_bytes long, n_tokens long, known long, base double, bits double, rest array<binary>"
    scored = stored(arrow_map(rows, schema, score).withColumn("rid", F.monotonically_increasing_id()), "scored")
    others = scored.select("rid", F.explode("rest").alias("word"))
    met = others.join(vocabulary, "word").groupBy("rid").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 0.5)).alias("plus"))
    out = scored.join(met, "rid", "left")
    more = F.coalesce("more", F.lit(0))
    unknown = (F.size("rest") - more) * float(np.log10(0.5))
    base = F.col("base") + F.coalesce("plus", F.lit(0.0)) + unknown - F.col("n_tokens") * F.lit(log_all)
    total = F.col("bits") * float(np.log10(2))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + more).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), base.alias("base_score"), total.alias("score"), F.expr("-bits / nullif(n_bytes, 0)").alias("bits_per_byte"))


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
