import hashlib
import time
from collections import Counter

import pytest

from gridmill.llm.levels import Levels
from gridmill.llm.suffix_dedup import op2_suffix_array_dedup, suffix_dedup
from gridmill.llm.window_dedup import op4_substring_dedup, window_dedup


def brute(rows, unit, width):
    """Per row: units, removed units, removed runs, digest of the kept text."""
    units = [(text or "").encode() if unit == "byte" else (text or "").encode().split() for _, text in rows]
    windows = lambda u: [bytes(u[i : i + width]) if unit == "byte" else tuple(u[i : i + width]) for i in range(len(u) - width + 1)]
    count = Counter(w for u in units for w in windows(u))
    out = []
    for (doc, _), u in zip(rows, units):
        gone = [False] * len(u)
        for i, w in enumerate(windows(u)):
            if count[w] > 1:
                gone[i : i + width] = [True] * width
        kept = [x for x, g in zip(u, gone) if not g]
        runs = sum(g and not b for g, b in zip(gone, [False, *gone]))
        out.append((doc, len(u), sum(gone), runs, hashlib.sha256(bytes(kept) if unit == "byte" else b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_units, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect()), key=str)


@pytest.mark.parametrize(("dedup", "unit", "width", "gram"), [(suffix_dedup, "byte", 40, 8), (window_dedup, "word", 3, 1), (window_dedup, "word", 35, 5)])
def test_odd_rows(spark, odd_docs, no_docs, dedup, unit, width, gram):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert found(dedup(odd_docs, width, gram, 2)) == brute(rows, unit, width)
    assert dedup(no_docs, width, gram, 2).count() == 0


def test_long_text_is_cut_without_loss(spark, monkeypatch):
    from gridmill.llm import windows

    monkeypatch.setattr(windows, "SLICE", 1 << 9)
    text = "".join(chr(97 + (i * i // 7) % 26) for i in range(3000))
    shape = windows.Shape("byte", 50, 10)
    both = [list(windows.neighbourhoods([t], shape)) for t in (text.encode(), text[1100:1400].encode())]
    starts = [sorted(int(s) + i for f in fs for s, n in zip(f.start, f.count) for i in range(n)) for fs in both]
    assert starts[0] == list(range(2951))
    assert {int(k) for f in both[1] for k in f.key} <= {int(k) for f in both[0] for k in f.key}


@pytest.mark.parametrize(("query", "unit", "width"), [(op2_suffix_array_dedup, "byte", 200), (op4_substring_dedup, "word", 35)])
def test_queries(spark, sf, query, unit, width):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r for r in query(spark, sf).collect()}
    want = brute(rows, unit, width)
    assert len(got) == len(want) and sum(w[2] for w in want) > 0
    for doc, n, removed, runs, digest in want:
        assert (got[doc]["n_bytes" if unit == "byte" else "n_words"], got[doc].n_removed, got[doc].kept_sha256) == (n, removed, digest)
        if unit == "byte":
            assert got[doc].n_spans == runs


def test_shared_edges(spark):
    """Many texts with one passage between different words: its edges have as many neighbourhoods as there are texts."""
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"a{i}x{j}" for j in range(i % 50)] + passage[i % 9 :] + [f"b{i}y{j}" for j in range(i % 37)])) for i in range(300)]
    rows += [(300 + i, " ".join(passage[:20] + [f"c{i % 3}"] + passage[20:])) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(window_dedup(df)) == brute(rows, "word", 35)
    assert found(suffix_dedup(df)) == brute(rows, "byte", 200)


@pytest.mark.parametrize("dedup", [suffix_dedup, window_dedup])
def test_leaves_no_files_behind(spark, dedup, tmp_path, monkeypatch):
    """Before the result is asked for, shuffle files are gone and only the index, the texts and the spans are on disk."""
    jvm, go = spark._jvm, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    files = lambda: {f.getName() for f in jvm.scala.jdk.javaapi.CollectionConverters.asJava(jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle")}
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"a{i} {passage} b{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for module in ("common", "levels"):
        monkeypatch.setattr(f"gridmill.llm.{module}.shared_folder", lambda spark: f"file://{tmp_path}")
    before = files()
    out = dedup(df)
    ends = time.time() + 20
    while files() - before and time.time() < ends:
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get(go) == "false"
    held = {p.parent.name.split("-")[0] for p in tmp_path.rglob("*.parquet")}
    assert held == {"texts", "matches", "run", "repeated"}, held
    assert found(out) == (brute(rows, "word", 35) if dedup is window_dedup else brute(rows, "byte", 200))


def test_levels_merge_geometrically(spark):
    levels = Levels(spark, ["key"])
    sizes, matches = [], []
    for b in range(4):
        met = levels.add(spark.createDataFrame([(b, 1), (100, 1), (50 + b // 2, 1)], "key long, n long"))
        sizes.append(sorted(levels.runs))
        matches.append(sorted(r.key for r in met.distinct().collect()))
    assert sizes == [[0], [1], [0, 1], [2]]
    assert matches == [[], [50, 100], [100], [51, 100]]
    assert {r.key: r.n for r in levels.runs[2].collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 50: 2, 51: 2, 100: 4}


@pytest.mark.parametrize(("dedup", "unit", "width", "gram"), [(suffix_dedup, "byte", 40, 8), (window_dedup, "word", 6, 2)])
def test_second_session_meets_history(spark, tmp_path, dedup, unit, width, gram):
    """An index in a folder is opened again, and new documents are held against all that it has."""
    passage = "a passage of several words that is shared by two batches of texts"
    first = [(1, "before " + passage), (2, "nothing of the kind stands in this one at all"), (3, None)]
    second = [(1, passage + " after"), (5, "entirely other words that nobody else has ever used here"), (6, "")]
    third = [(7, "entirely other words that nobody else has ever used here or there"), (8, passage)]
    folder, seen = f"file://{tmp_path}/index", []
    for rows in (first, second, third):
        got = found(dedup(spark.newSession().createDataFrame(rows, "doc_id long, text string"), width, gram, 2, folder))
        seen += rows
        every = [(f"{i}", t) for i, (_, t) in enumerate(seen)]
        want = {int(r[0]): r[1:] for r in brute(every, unit, width)}
        assert got == sorted(((seen[i][0], *want[i]) for i in range(len(seen) - len(rows), len(seen))), key=str)
