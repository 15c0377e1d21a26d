import numpy as np
import pyarrow as pa
import pytest
import xxhash

from gridmill.llm.common import connected_components, sorted_groups
from gridmill.llm.embedding_dedup import MultiIndex, _compare, embedding_dedup, op1_embedding_near_dedup
from gridmill.llm.simhash import bucket_keys, linked_edges, near_copies, op3_simhash_near_dedup, simhash_dedup


def components(n, links):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        root[top(a)] = top(b)
    return [top(i) for i in range(n)]


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_simhash(rows):
    fp = [brute_fingerprint(t) for _, t in rows]
    root = components(len(rows), [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4])
    low = {}
    for (doc, _), r in zip(rows, root):
        if doc is not None:
            low[r] = min(low.get(r, doc), doc)
    return sorted(((doc, f"{f:016x}", low.get(r)) for (doc, _), f, r in zip(rows, fp, root)), key=str)


def test_every_near_pair_shares_a_bucket():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for bit in rng.choice(64, size=4, replace=False):
            b ^= 1 << int(bit)
        row, key = bucket_keys(np.array([[a], [b]], dtype=np.uint64))
        assert set(key[row == 0]) & set(key[row == 1])


def test_simhash_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in op3_simhash_near_dedup(spark, sf).collect()), key=str)
    assert got == brute_simhash(rows)


def test_simhash_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = [(r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in simhash_dedup(odd_docs).collect()]
    assert sorted(got, key=str) == brute_simhash(rows)
    assert simhash_dedup(no_docs).count() == 0


@pytest.mark.parametrize("crowd", [4096, 7])
def test_simhash_links_of_dense_groups(spark, crowd):
    """Groups whose members meet in crowded buckets, chains included."""
    rng = np.random.default_rng(2)
    fps = set()
    for _ in range(6):
        at = int(rng.integers(0, 1 << 63))
        for _ in range(60):
            fps.add(at)
            for bit in rng.choice(64, size=int(rng.integers(1, 6)), replace=False):
                at ^= 1 << int(bit)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    root = components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    got = {r.node & (1 << 64) - 1: r.component for r in connected_components(linked_edges(df, bucket_keys, 4, crowd)).collect()}
    pairs = {}
    for f, r in zip(fps, root):
        pairs.setdefault(r, set()).add(got.get(f, f"alone{f}"))
    assert all(len(v) == 1 for v in pairs.values())
    assert len(set().union(*pairs.values())) == len(pairs)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7), (200, 201), (200, 202), (203, 202)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100} | {i: 200 for i in range(200, 204)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_embedding(rows, cosine=0.98):
    ok = [i for i, (_, e, y) in enumerate(rows) if y is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e)]
    links = []
    for a, i in enumerate(ok):
        x = np.array(rows[i][1], dtype=float)
        for j in ok[:a]:
            y = np.array(rows[j][1], dtype=float)
            if rows[i][2] == rows[j][2] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                links.append((i, j))
    root = components(len(rows), links)
    low = {}
    for r, (v, _, _) in zip(root, rows):
        low[r] = min(low.get(r, v), v)
    n = np.bincount(np.array(links, dtype=int).ravel(), minlength=len(rows))
    return {v: (int(n[i]), low[root[i]], low[root[i]] == v) for i, (v, _, _) in enumerate(rows)}


def recall(got, want):
    links = sum(w[0] for w in want.values())
    assert links
    return sum(min(got[v][0], want[v][0]) for v in want) / links


def test_embedding_recall(spark):
    """The table's vectors and, for each, a partner whose cosine is just over the threshold."""
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    rng = np.random.default_rng(4)
    for v, e, y in rows[:300]:
        x = np.array(e) / np.linalg.norm(e)
        side = rng.normal(size=len(x))
        side -= side @ x * x
        rows.append((v + 10_000, (0.9805 * x + np.sqrt(1 - 0.9805**2) * side / np.linalg.norm(side)).tolist(), y))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want = brute_embedding(rows)
    assert all(got[v][0] <= want[v][0] for v in want)
    assert recall(got, want) >= 0.97


def test_embedding_query(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op1_embedding_near_dedup(spark, sf).collect()}
    assert got == brute_embedding(rows)


@pytest.mark.parametrize("limit", [4, 1024])
def test_embedding_groups_and_blocks(spark, limit):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(6):
        centre = rng.normal(size=16)
        for i in range(25):
            rows.append((len(rows), (centre + rng.normal(size=16) * 0.06).tolist(), g % 3))
    rows += [(len(rows) + i, rows[0][1], 0) for i in range(9)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), members=limit, visitors=limit).collect()}
    want = brute_embedding(rows)
    assert all(got[v][0] <= want[v][0] for v in want) and recall(got, want) >= 0.9


@pytest.mark.parametrize("case", ["members", "across", "visitors"])
def test_embedding_block_keeps_chains_whole(case):
    """Vectors on an arc, 10 degrees apart, so that only neighbours link."""
    rng = np.random.default_rng(8)
    for _ in range(100):
        size = int(rng.integers(4, 12))
        order, side = rng.permutation(size), rng.integers(0, 2, size)
        angle = np.radians(10) * order
        ids = rng.permutation(size)
        rows = {"id": ids, "copies": np.ones(size, dtype=np.int64), "home": side, "side": side, "first": np.full(size, case == "members"), "visits": np.full((size, 1), -1), "x": np.stack([np.cos(angle), np.sin(angle)], 1)}
        part = lambda keep: {k: v[keep] for k, v in rows.items()}
        none = part(np.zeros(size, dtype=bool))
        out = _compare(part(side == 0), part(side == 1), 0.98, False) if case == "visitors" else _compare(rows, none, 0.98, case == "across")
        links = [(i, j) for i in range(size) for j in range(i) if abs(order[i] - order[j]) == 1 and (case == "members" or side[i] != side[j])]
        got, want = components(size, zip(out["id"], out["root"])), components(size, [(ids[i], ids[j]) for i, j in links])
        assert [[a == b for b in got] for a in got] == [[a == b for b in want] for a in want]
        assert out["n"].sum() == 2 * len(links)


def test_embedding_odd_rows(spark):
    one = [1.0, 0.0, 0.5, 2.0]
    rows = [
        (0, None, 1, "x"), (1, [], 1, None), (2, [0.0] * 4, 1, "x"), (3, [1.0, None, 0.0, 0.0], 1, "x"), (4, [float("nan")] * 4, 1, "x"), (5, [float("inf"), 1.0, 1.0, 1.0], 1, "x"),
        (6, one, None, "x"), (7, one, 1, "x"), (8, one, 1, "x"), (9, [2 * v for v in one], 1, "x"), (10, one, 2, "x"), (11, one[:3], 1, "x"), (12, [-v for v in one], 1, "x"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup(df).collect()}
    assert got == brute_embedding([r[:3] for r in rows])
    assert got[7] == (2, 7, True) and got[9] == (2, 7, False)
    assert embedding_dedup(df.where("false")).count() == 0
    assert embedding_dedup(df.where("vec_id < 7")).where("n_links > 0").count() == 0


def brute_jaccard(texts):
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set())
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a == b or 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b)]
    root = components(len(texts), links)
    low = {}
    return [low.setdefault(r, i) for i, r in enumerate(root)]


@pytest.mark.parametrize(("crowd", "most_bytes"), [(1024, 8 << 20), (5, 20_000)])
def test_near_copies(spark, crowd, most_bytes):
    """All near copies of sf0.01, and edited ones: no false group, and nearly all true ones, in blocks of any size."""
    rows = [(i, r.text) for i, r in enumerate(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect())]
    edited = [(len(rows) + i, " ".join(w if k % 60 else f"new{k}" for k, w in enumerate(t.split()))) for i, t in rows[:200] if t]
    rows += edited + [(len(rows) + len(edited) + i, t) for i, t in enumerate([None, "", "one two", "One  two", "a b c d e f g h i", "a b c d e f g h"])]
    got = {r.rid: r.component for r in near_copies(spark.createDataFrame(rows, "rid long, text string"), crowd=crowd, most_bytes=most_bytes).collect()}
    want = dict(enumerate(brute_jaccard([t for _, t in rows])))
    groups = {}
    for i, c in got.items():
        groups.setdefault(c, set()).add(want[i])
    assert all(len(g) == 1 for g in groups.values()) and len(got) == len(rows)
    linked = [i for i, c in want.items() if c != i]
    assert sum(got[i] == got[want[i]] for i in linked) >= 0.97 * len(linked)


def test_large_group_of_near_copies(spark):
    """5,000 near copies of one text are one group, in both operators."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(5000):
        own = list(words)
        own[int(rng.integers(150))] = f"x{i}"
        rows.append((i, " ".join(own)))
    rows.append((5000, " ".join(f"other{i}" for i in range(150))))
    df = spark.createDataFrame(rows, "rid long, text string").repartition(8)
    got = {r.rid: r.component for r in near_copies(df).collect()}
    assert sum(got[i] == 0 for i in range(5000)) >= 4950 and got[5000] == 5000
    fp = [brute_fingerprint(t) for _, t in rows]
    by = {r.doc_id: r.component_id for r in simhash_dedup(df.withColumnRenamed("rid", "doc_id")).collect()}
    distinct = sorted(set(fp))
    bits = np.array(distinct, dtype=np.uint64)
    root = components(len(distinct), [(i, int(j)) for i in range(len(bits)) for j in np.flatnonzero(np.bitwise_count(bits[:i] ^ bits[i]) <= 4)])
    low = {}
    for i, f in enumerate(fp):
        low.setdefault(root[distinct.index(f)], i)
    assert by == {i: low[root[distinct.index(f)]] for i, f in enumerate(fp)}


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_sorted_groups(size):
    """Whole groups from batches cut anywhere; groups over the limit are only named."""
    key = np.repeat([5, 6, 7, 8, 9, 11], [1, 9, 2, 30, 1, 12])
    batches = [pa.RecordBatch.from_pydict({"key": key[lo : lo + size], "at": np.arange(len(key))[lo : lo + size]}) for lo in range(0, len(key), size)]
    for most, left in ((None, []), (10, [8, 11])):
        found, over = [], []
        for table, edge, named in sorted_groups(iter(batches), most):
            over += named
            found += [tuple(table["at"].to_pylist()[a:b]) for a, b in zip(edge[:-1], edge[1:])]
        assert sorted(over) == left
        assert sorted(found) == sorted(tuple(np.flatnonzero(key == k).tolist()) for k in set(key.tolist()) - set(left))


@pytest.mark.parametrize("rows", [60_000, 1_000_000])
def test_recall_of_large_indexes(rows):
    """At 784 cells and more: of partners at cosine 0.9805, nine in ten at least are met from one side or the other."""
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centre = rng.normal(size=(60, 64))
    index = MultiIndex(unit(centre[rng.integers(0, 60, 4096)] + rng.normal(size=(4096, 64))), rows)
    assert index.codes**2 >= 784
    a = unit(centre[rng.integers(0, 60, 600)] + rng.normal(size=(600, 64)))
    side = rng.normal(size=a.shape)
    side = unit(side - (side * a).sum(1, keepdims=True) * a)
    b = 0.9805 * a + np.sqrt(1 - 0.9805**2) * side
    (ca, va), (cb, vb) = index.cells(a), index.cells(b)
    met = ((ca == cb[:, :1]) & va).any(1) | ((cb == ca[:, :1]) & vb).any(1)
    assert met.mean() >= 0.9
