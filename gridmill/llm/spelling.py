"""Spelling variants over a bit-sliced position index.

Words that differ by one code point share all that stands outside a stretch of
the shorter word. Every word goes to the groups of its own length and of the
length below, once with the first half shared and once with the second, so
that two near words of lengths a and a or a + 1 meet in just the group in whose
stretch their first difference lies. A group that is too large, or whose
stretch is too long, is dealt anew with each half of the stretch, until what is
left is bounded by the alphabet; no group is ever capped or paired off.

Inside a block of whole groups each (position, letter) is a bitset over the
block's words. The recurrence goes through the stretch once for all words of
the shorter length: zero-error sets shrink by the bitset of the next letter,
one-error sets take over what just left them and go on in place (a replaced
letter) or with positions shifted by one (an inserted one).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.common import bound_batches, forget, sorted_groups, stored
from gridmill.llm.merkle import CRC_TABLE, crc_sql

LEAST_LENGTH, LEAST_COUNT, RATIO, DELETE_EVERY = 7, 2, 10, 31
#: Words a group may have, and positions its stretch may have, before it is dealt anew.
MOST_WORDS, MOST_POSITIONS = 1024, 32
#: Words of a block of groups.
BLOCK = 2048


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: runs of letters of at least 7 code points and 2 occurrences. One in 31 runs of a document has a letter dropped, see the query's contract."""
    run = F.explode(F.regexp_extract_all("text", F.lit(f"([A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}})"), F.lit(1)))
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    words = runs.select("id", F.translate("run", capitals, capitals.lower()).alias("word")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")))
    at = "int(h % length(word))"
    words = words.selectExpr(f"if(h % {DELETE_EVERY} = 0, concat(substring(word, 1, {at}), substring(word, {at} + 2)), word) as word")
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _grouped(rows: DataFrame) -> DataFrame:
    """Rows (word, n, a, lo, hi) with the group g of words of length a or a + 1 that agree outside [lo, hi) of the shorter one."""
    after = F.expr("substring(word, length(word) - (a - hi) + 1, a - hi)")
    return rows.withColumn("g", F.xxhash64("a", "lo", "hi", F.expr("substring(word, 1, lo)"), after))


def _halved(rows: DataFrame) -> DataFrame:
    """Every row twice, with each half of its stretch."""
    middle = F.expr("lo + (hi - lo) div 2")
    halves = F.explode(F.array(F.struct(middle.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), middle.alias("hi"))))
    return _grouped(rows.select("word", "n", "a", halves.alias("half")).select("word", "n", "a", "half.lo", "half.hi"))


def _bits(member: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    packed = np.packbits(member, axis=-1, bitorder="little")
    room = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.concatenate((packed, np.zeros((*packed.shape[:-1], room), dtype=np.uint8)), axis=-1)).view(np.uint64)


def near_in_block(words: list[str], group: np.ndarray, a: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of near words of one group: word i of length a, word j of length a or a + 1 whose first difference lies in [lo, hi); at the end too where hi is a.

    group: numbers from 0. Words of a group agree outside the stretch and differ.
    """
    width = hi - lo
    letters, code = np.unique(np.array([w[lo : hi + 1] for w in words], dtype=f"U{width + 1}").view(np.uint32).reshape(len(words), width + 1), return_inverse=True)
    code = code.reshape(len(words), width + 1)
    index = _bits(code.T[:, None, :] == np.arange(len(letters))[None, :, None])  # position, letter, words
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    same, longer = _bits((length == a)[None])[0], _bits((length == a + 1)[None])[0]
    asking = np.flatnonzero(length == a)
    zero = _bits(np.arange(group.max() + 1)[:, None] == group[None])[group[asking]]
    replaced = inserted = np.zeros_like(zero)
    for k in range(width):
        here, next_one = index[k, code[asking, k]], index[k + 1, code[asking, k]]
        left = zero & ~here
        replaced = replaced & here | left & same
        inserted = (inserted | left & longer) & next_one
        zero = zero & here
    near = replaced | inserted | (zero & longer if hi == a else np.uint64(0))
    i, j = np.nonzero(np.unpackbits(near.view(np.uint8), axis=1, count=len(words), bitorder="little"))
    return asking[i], j


def _settle(table: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Near words of whole groups: word, how many, and the best of them."""
    a, lo, hi = (table.column(c).to_numpy() for c in ("a", "lo", "hi"))
    size = np.diff(edges)
    first = edges[:-1][size > 1]  # a group of one has nothing to meet
    size = size[size > 1]
    start = 0
    while start < len(first):
        shape = a[first[start]], lo[first[start]], hi[first[start]]
        end, held = start, 0
        while end < len(first) and (a[first[end]], lo[first[end]], hi[first[end]]) == shape and (end == start or held + size[end] <= BLOCK):
            held += size[end]
            end += 1
        rows = np.concatenate([np.arange(f, f + s) for f, s in zip(first[start:end], size[start:end])])
        part = table.take(pa.array(rows))
        words, n = part["word"].to_pylist(), part["n"].to_numpy()
        i, j = near_in_block(words, np.repeat(np.arange(end - start), size[start:end]), *map(int, shape))
        # group keys are hashes: what stands outside the stretch is compared as it is
        cut = int(shape[1]), int(shape[0] - shape[2])
        true = np.fromiter((words[p][: cut[0]] == words[q][: cut[0]] and (not cut[1] or words[p][-cut[1] :] == words[q][-cut[1] :]) for p, q in zip(i.tolist(), j.tolist())), dtype=bool, count=len(i))
        i, j = i[true], j[true]
        back = np.fromiter((len(w) for w in words), dtype=np.int64, count=len(words))[j] == shape[0] + 1  # pairs of equal length turn up from both sides
        one, other = np.concatenate((i, j[back])), np.concatenate((j, i[back]))
        if len(one):
            order = sorted(range(len(words)), key=lambda k: (-n[k], words[k]))
            rank = np.empty(len(words), dtype=np.int64)
            rank[order] = np.arange(len(words))
            count, best = np.bincount(one, minlength=len(words)), np.full(len(words), len(words))
            np.minimum.at(best, one, rank[other])
            hit = np.flatnonzero(count)
            top = [order[best[h]] for h in hit]
            yield pa.RecordBatch.from_pydict({"word": [words[h] for h in hit], "n_near": count[hit].astype(np.int64), "best": [words[t] for t in top], "best_n": n[top]})
        start = end


def _in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, edges, _ in sorted_groups(batches):
        yield from _settle(table, edges)


def near_words(words: DataFrame, most: int = MOST_WORDS, longest: int = MOST_POSITIONS) -> DataFrame:
    """word, n_near, best, best_n of every word (word, n; no word twice) that has a near one: exactly one code point inserted, deleted or replaced. Works for words of any length; no rows give no rows."""
    bound_batches(words.sparkSession)
    size = F.length("word")
    lengths = F.explode(F.array_except(F.array(size, size - 1), F.array(F.lit(0))))
    waiting = _halved(words.select("word", "n", lengths.alias("a")).withColumns({"lo": F.lit(0), "hi": F.col("a")}))
    waiting = stored(waiting, "groups")
    found = None
    while True:
        sizes = waiting.groupBy("g", (F.col("hi") - F.col("lo")).alias("stretch")).agg(F.count("*").alias("rows"))
        large = stored(sizes.where((F.col("rows") > 1) & (F.col("stretch") > 1) & ((F.col("rows") > most) | (F.col("stretch") > longest))).select("g"), "large")
        again = large.head(1)
        rest = waiting.where(F.col("hi") - F.col("lo") <= max(longest, 1)) if not again else waiting.join(large, "g", "left_anti").where(F.col("hi") - F.col("lo") <= max(longest, 1))
        dealt = rest.select("g", "a", "lo", "hi", "word", "n").repartition("g").sortWithinPartitions("a", "lo", "hi", "g")
        part = stored(dealt.mapInArrow(_in_groups, "word string, n_near long, best string, best_n long"), "near")
        found = part if found is None else found.union(part)
        if not again:
            break
        refined = stored(_halved(waiting.join(large, "g", "left_semi")), "groups")
        forget(waiting)
        waiting = refined
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("top")).select("word", "n_near", F.col("top.w").alias("best"), (-F.col("top.m")).alias("best_n"))


def last_forms(forms: DataFrame) -> DataFrame:
    """word, root: where forms (word, form) lead at last. No form leads back; each round doubles the steps taken."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = stored(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        forget(now)
        now = stepped.select("word", "root")
        now.stored_path = stepped.stored_path
        if not stepped.where("moved").head(1):
            return now


def spelling_variants(docs: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """Words of docs (doc_id, text) with the much commoner near word that each may be a variant of.

    Returns word, form, root, n, n_near, form_n, a row for each word. A null
    text has no words, a null doc_id counts as an empty one, and rows that
    repeat count each. Of near words of equal n the first in code-point order
    is the form. Runs of any length are words, whole. No rows, or none with a
    word that occurs twice, give no rows; other columns are ignored.
    """
    words = stored(vocabulary(docs), "words")
    near = words.join(near_words(words, most), "word", "left")
    is_form = F.col("best_n") >= RATIO * F.col("n")
    rows = stored(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "forms")
    roots = last_forms(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variant_grouping(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    utf8 = "flatten(list_transform(string_split(doc_id::VARCHAR || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x)::BIGINT >> 6), 128 + (unicode(x)::BIGINT & 63)] END))"
    return f"""WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{capitals}', '{capitals.lower()}'), '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS w FROM documents),
kinds AS (SELECT doc_id, w, count(*) AS k FROM runs WHERE length(w) >= {LEAST_LENGTH} GROUP BY doc_id, w),
hashed AS (SELECT w, k, {crc_sql(utf8)} AS h FROM kinds, crc),
changed AS (SELECT CASE WHEN h % {DELETE_EVERY} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM hashed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM changed WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
cuts AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS pos FROM words),
less AS (SELECT word, n, pos, substr(word, 1, pos - 1) || substr(word, pos + 1) AS rest FROM cuts),
shorter AS (SELECT DISTINCT l.word AS x, l.n AS xn, w.word AS y, w.n AS yn FROM less l JOIN words w ON w.word = l.rest),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.rest = b.rest AND a.pos = b.pos AND a.word <> b.word
  UNION ALL SELECT x, y, yn FROM shorter UNION ALL SELECT y, x, xn FROM shorter),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS best_n FROM near GROUP BY word),
named AS (SELECT b.word, b.n_near, b.best_n, min(r.other) AS best FROM best b JOIN near r ON r.word = b.word AND r.other_n = b.best_n GROUP BY ALL),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {RATIO} * w.n THEN best END AS form, CASE WHEN best_n >= {RATIO} * w.n THEN best_n END AS form_n FROM words w LEFT JOIN named USING (word)),
steps AS (SELECT word, word AS here, form AS further FROM forms
  UNION ALL SELECT s.word, f.word, f.form FROM steps s JOIN forms f ON f.word = s.further)
SELECT f.word, f.form, s.here AS root, f.n, f.n_near, f.form_n FROM forms f JOIN steps s ON s.word = f.word AND s.further IS NULL"""


SQL = _sql()
