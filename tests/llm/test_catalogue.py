"""Spelling variants, Merkle manifest and nearest neighbours against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmill.llm import queries
from gridmill.llm.merkle import merkle_manifest
from gridmill.llm.nearest import nearest
from gridmill.llm.spelling import near_in_block, near_words, spelling_variants
from tests.oracle import difference

SF = "/root/testdata/sf0.001"
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    assert difference(spark, SF, queries.QUERIES[name], queries.ORACLE_SQL[name]) is None


# spelling


def is_near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k + 1 :]


def spelling_by_hand(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(CAPITALS)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 7
    n = {w: k for w, k in n.items() if k >= 2}
    near = {w: [v for v in n if is_near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


WORDS = ["abcdefg", "abcdefgh", "abcdfeg", "abcdxfg", "xabcdefg", "bcdefgg", "aabcdefg", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "aaabaaaa", "ÀÉîöøþÿé", "àÉîöøþÿé", "×÷×÷×÷×", "zbcdefg", "abcdef", "Abcdefg"]


def spelling_docs():
    rng = np.random.default_rng(3)
    docs = [(k, " ".join(rng.choice(WORDS, size=30)) + "-" + rng.choice(WORDS)) for k in range(40)]
    many = " ".join(["abcdefg"] * 400 + ["abcdefgh"] * 30)
    return [*docs, (None, many), (50, many), (50, many), (51, None), (52, ""), (53, "q" * 5000 + " " + "q" * 4999 + " q" + "q" * 4998), (54, ("q" * 5000 + " ") * 12)]


@pytest.mark.parametrize("most", [1, 3, 1024])
def test_spelling_by_hand(spark, most):
    rows = spelling_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("x"), "n": F.lit(1), "form": F.lit(None).cast("int")})
    got = sorted(tuple(r) for r in spelling_variants(docs, most).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == spelling_by_hand(rows)
    assert any(r[1] for r in got) and any(r[2] not in (r[0], r[1]) for r in got)


def test_spelling_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()) == spelling_by_hand(rows)


def test_near_in_block():
    words = ["aab", "abb", "aabb", "ab", "aaab", "bbb", "aba"]
    pairs = {(i, j) for lo, hi in ((0, 1), (1, 3)) for i, j in zip(*map(list, near_in_block(words, np.zeros(7, dtype=int), 3, lo, hi))) if words[i][:lo] == words[j][:lo] and words[i][hi:] == words[j][len(words[j]) - 3 + hi :]}
    want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if len(a) == 3 and len(b) in (3, 4) and is_near(a, b)}
    assert pairs == want


def test_short_words_are_near_too(spark):
    words = ["a", "b", "ab", "ba", "bab", "c", "é", "aé"]
    got = {r.word: r.n_near for r in near_words(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()}
    assert got == {w: k for w in words if (k := sum(is_near(w, v) for v in words))}


def test_no_spelling(spark, no_docs):
    assert spelling_variants(no_docs).count() == 0
    assert spelling_variants(spark.createDataFrame([(1, "seldomword once")], "doc_id long, text string")).count() == 0


# manifest


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(level: list[str]) -> tuple[str, list[list[tuple[str, str] | None]]]:
    """The root, and for each node the siblings on its way; every step hashes."""
    at, ways = list(range(len(level))), [[] for _ in level]
    while len(level) > 1:
        for way, p in zip(ways, at):
            run = level[p // 16 * 16 : p // 16 * 16 + 16]
            way.append(("".join(run[: p % 16]), "".join(run[p % 16 + 1 :])))
        at = [p // 16 for p in at]
        level = [sha(*level[k : k + 16]) for k in range(0, len(level), 16)]
    return level[0], ways


def manifest_by_hand(docs):
    def leaf(r, text):
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))

    trees = {}
    for r in docs:
        trees.setdefault(r["source"], []).append((r["doc_id"], leaf(r, r["text"]), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(trees[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for s in names}
    climbed = {s: climb([x[1] for x in t]) for s, t in trees.items()}
    root, upper = climb([climbed[s][0] for s in names]) if names else (None, [])
    out = []
    for s, way_up in zip(names, upper):
        for (doc_id, h, r), own in zip(trees[s], climbed[s][1]):
            way, acc = own + way_up, h
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
                acc = leaf(r, None if r["text"] is None else r["text"].translate(CAPITALS))
            for before, after in way:
                acc = sha(before, acc, after)
            out.append((doc_id, h, climbed[s][0], root, sha(*(a + z for a, z in way)), acc, acc == root))
    return sorted(out, key=repr)


def manifest_rows(spark, docs):
    got = merkle_manifest(docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    return sorted((tuple(r) for r in got), key=repr)


@pytest.mark.parametrize("n", [1, 16, 17, 700])
def test_manifest_by_hand(spark, n):
    rng = np.random.default_rng(n)
    sources = [None, "", "-", "a", "A", "é", *(f"s{k}" for k in range(20))]
    docs = [(int(k), f"Text {k} ÀB", rng.choice(["en", "de"]), "hot" if k % 3 else sources[k // 3 % len(sources)], int(k)) for k in range(n)]
    if n > 17:
        docs += [(3, "Text 3 ÀB", "de", "hot", 3)] * 20 + [(None, None, None, None, None), (None, "X", None, "hot", -1), (None, "Y", None, "hot", None), (5, "", "", "", 0), (5, None, "", "", 0), (10, "ONE " * 30_000, "en", "hot", 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"h": F.lit(1), "p": F.lit("x"), "way": F.lit(2.0), "src": F.lit("y"), "n": F.lit(1)})
    got = manifest_rows(spark, df)
    assert got == manifest_by_hand([r.asDict() for r in df.collect()])
    assert n < 700 or {r[-1] for r in got} == {True, False}


def test_manifest_of_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert manifest_rows(spark, df) == manifest_by_hand([r.asDict() for r in df.collect()])


def test_no_manifest(spark):
    assert merkle_manifest(spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")).count() == 0


# neighbours


def neighbours_by_hand(rows, k, every):
    fine = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)})
    ids = np.array([i for i, _ in fine])
    width = max((len(v) for _, v in fine), default=0)
    x = np.array([[*v, *[0] * (width - len(v))] for _, v in fine]).reshape(len(fine), width)
    out = []
    for i, v in zip(ids, x):
        if i % every == 0:
            score = (x * v).sum(1)
            keep = np.flatnonzero(ids != i)
            order = keep[np.lexsort((ids[keep], -score[keep]))][:k]
            out += [(int(i), r + 1, int(ids[o]), float(score[o])) for r, o in enumerate(order)]
    return sorted(out)


def recall(got, want):
    want, got = {(q, v) for q, _, v, _ in want}, {(r.query_id, r.vec_id) for r in got}
    return len(want & got) / max(len(want), 1)


def test_neighbours_of_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = nearest(df).collect()
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = neighbours_by_hand(rows, 20, 20)
    assert len(got) == len(want) and recall(got, want) >= 0.9
    by_id = {i: np.array(v) for i, v in rows}
    for r in got:
        assert r.query_id % 20 == 0 and r.query_id != r.vec_id and abs(r.score - (by_id[r.query_id] * by_id[r.vec_id]).sum()) < 1e-12
    lists = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        lists.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert all(v == sorted(v) and len(v) == 20 for v in lists.values())


@pytest.mark.parametrize("norms", ["unit", "spread"])
def test_recall_with_clusters_copies_and_small_blocks(spark, norms):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(60, 24))
    x = centre[rng.integers(0, 60, size=6000)] + 0.4 * rng.normal(size=(6000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms == "spread":
        x *= rng.lognormal(sigma=0.7, size=(6000, 1))
    x[1000:3000] = x[1000]  # a third are copies
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(df, per_member=100, per_visitor=16).collect()
    want = neighbours_by_hand(rows, 20, 20)
    assert len(got) == len(want) and recall(got, want) >= 0.9
    copies = [(r["rank"], r.vec_id) for r in got if r.query_id == 2000 and abs(r.score - (x[1000] ** 2).sum()) < 1e-12]
    assert [v for _, v in sorted(copies)] == [v for q, _, v, s in want if q == 2000 and abs(s - (x[1000] ** 2).sum()) < 1e-12]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [1.0, 2.0]), (1, [2.0, 1.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (40, [0.0, 0.0]), (60, None), (None, [1.0, 1.0]), (8, [5.0]), (80, [-1.0, 3.0, 2.0]), (9, [1.0, 2.0]), (20, [3.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "rank": F.lit(1), "low": F.lit(2), "query_id": F.lit(3)})
    got = nearest(df).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == neighbours_by_hand(rows, 20, 20)


def test_no_vectors(spark):
    for rows in ([], [(1, None)], [(20, [1.0])]):
        assert nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0
