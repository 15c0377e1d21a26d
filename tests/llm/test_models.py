import os
import zlib
from collections import Counter
from math import log10

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridmill.llm.language_model import lm_scores
from gridmill.llm.licenses import KNOWN, SQL, TEXTS, license_scan, op9_license_scan
from gridmill.llm.quality import best_cut, op10_quality_classifier, quality_sample, top_key

SF = "/root/testdata/sf0.01"


def brute_unigram(rows):
    words = [(t or "").encode().lower().split() for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows]
    c = Counter(w for ws, h in zip(words, held) if not h for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    return sorted(((d, h, len(ws) + 1, sum(c[w] > 0 for w in [*ws, None]), n, round(sum(log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*ws, None]), 6)) for (d, _), ws, h in zip(rows, words, held)), key=str)


def unigram(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect()), key=str)


@pytest.mark.parametrize("common", [50, 1 << 17])
def test_unigram_and_held_out_bits(spark, common):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = lm_scores(docs, common=common).cache()
    assert unigram(out) == brute_unigram([tuple(r) for r in docs.select("doc_id", "text").collect()])
    held = docs.withColumn("bytes", F.octet_length("text")).join(out.where("held_out"), "doc_id")
    bits, size = held.agg(F.sum("score"), F.sum("bytes")).first()
    assert 1.5 < -bits / np.log10(2) / size < 2.7


def test_lm_odd_rows(spark, odd_docs, no_docs):
    out = lm_scores(odd_docs)
    assert unigram(out) == brute_unigram([tuple(r)[:2] for r in odd_docs.collect()])
    assert lm_scores(no_docs).count() == 0
    nobody = odd_docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)
    assert unigram(lm_scores(nobody)) == brute_unigram([tuple(r)[:2] for r in nobody.collect()])


def test_mixing_is_a_probability():
    """Over all next bytes, the probabilities after a context sum to one."""
    from gridmill.llm.language_model import GATES, ORDERS, PARTS, RUNGS, Layout, Mixer

    rng = np.random.default_rng(0)
    layout = Layout(np.full((len(ORDERS), PARTS), 50))
    model = Mixer(layout, rng.integers(0, 9000, size=(2, layout.total)).astype(np.uint16))
    model.refined = rng.normal(size=(GATES, RUNGS))
    runs = np.uint64(0x616263646500) | np.arange(256, dtype=np.uint64)
    assert abs((2.0 ** model.log2(runs)).sum() - 1) < 1e-6


def test_score_against_brute_force(spark):
    """Bit by bit over whole texts, with counts of contexts gathered in plain dictionaries."""
    from gridmill.llm.language_model import ORDERS, RUNGS, TRUST, fit

    rows = [(i, " ".join(f"w{(i * j) % 13}{'ab' * (j % 3)}" for j in range(i % 23)) + "\nÜber 1." * (i % 2)) for i in range(40)] + [(90, None), (91, "")]
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = fit(spark.createDataFrame([(bytearray((t or "").encode()),) for d, t in rows if not held(d)], "text binary"), 1 << 26, 1 << 13)

    def steps(text):
        data = (text or "").encode() + b"\0"
        for i, byte in enumerate(data):
            before = (b"\0" * 5 + data[:i])[-5:]
            for bit in range(8):
                path = (byte | 256) >> (8 - bit)
                part = (int.from_bytes(before[-2:]) * 40503 >> 10) % 64
                keys = [(order, part, before[-order:], path) for order in ORDERS]
                yield keys, bit, byte >> (7 - bit) & 1

    counts = Counter()
    for d, t in rows:
        if not held(d):
            for keys, _, one in steps(t):
                counts.update((k, one) for k in keys)
    got = {r.doc_id: r.score for r in lm_scores(docs, model=model).collect()}
    for d, t in rows:
        total = 0.0
        for keys, bit, one in steps(t):
            n = [(counts[k, 0], counts[k, 1]) for k in keys]
            x = np.array([np.log(b + 0.4) - np.log(a + 0.4) for a, b in n])
            longest = max([(i + 1) * (len(TRUST) + 1) + sum(a + b > c for c in TRUST) for i, (a, b) in enumerate(n) if a + b], default=0)
            gate = longest * 8 + bit
            logit = np.clip(model.weights[gate] @ x, -12, 12)
            logit = (logit + model.refined[gate, int(np.rint((logit + 12) * (RUNGS - 1) / 24))]) / 2
            total -= np.log10(1 + np.exp(-logit if one else logit))
        assert got[d] == pytest.approx(total, rel=0.05, abs=0.05), d


def test_license_query(spark):
    got = sorted(map(tuple, op9_license_scan(spark, SF).collect()), key=str)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert got == sorted(db.execute(SQL).fetchall(), key=str)
    assert sum(r[3] for r in got) > 10


def test_license_texts(spark):
    mit = "MIT License\n\nCopyright (c) 2020 A\n\n" + KNOWN[0][1]
    texts = [mit.upper().replace("COPYRIGHT (C) 2020 A", "© 1999-2003 Someone & Co., all of them"), mit.replace(", ", "\n").replace("Copyright (c) 2020 A", "Copyright 2015 B"), "x " + mit, "Released under the MIT Licence!", None, "Copyright 2020 C"]
    texts += ["Copyright 2001 A\n" + t for i, _, t in TEXTS if i == "BSD-3-Clause"]
    got = [r.license for r in license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["MIT", "MIT", None, "MIT", None, None, "BSD-3-Clause"]
    lines = ["Licensed under the BSD 3-Clause License.", "This project is licensed under the terms of the GNU General Public License v3", "SPDX-License-Identifier: MPL-2.0", "licensed to nobody"]
    got = license_scan(spark.createDataFrame([(0, "\n".join([*lines, lines[0]]))], "doc_id long, text string")).first()
    assert (got.licenses, got.n_lines) == ("BSD-3-Clause,GPL-3.0,MPL-2.0", 4)


@pytest.mark.skipif(not os.path.exists("/usr/share/common-licenses/GPL-3"), reason="needs the published texts")
@pytest.mark.parametrize("name", ["Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "MPL-2.0"])
def test_published_texts_have_the_listed_digests(spark, name):
    text = open(f"/usr/share/common-licenses/{name}", encoding="utf-8").read()
    wrapped = " ".join(text.split(" ")).replace("\n", "\r\n")
    ids = [r.license for r in license_scan(spark.createDataFrame([(1, text), (2, wrapped)], "doc_id long, text string")).collect()]
    assert ids == [name if "." in name else name + ".0"] * 2


def test_odd_licenses(spark, odd_docs, no_docs):
    assert license_scan(odd_docs).count() == odd_docs.count() and license_scan(no_docs).count() == 0
    assert license_scan(odd_docs, []).where("licenses <> ''").count() == 0


def test_quality_query(spark):
    out = op10_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").cache()
    assert out.where("quality = 1 and kept").count() > 0.97 * out.where("quality = 1").count()
    assert out.where("quality = 0 and not kept").count() > 0.9 * out.where("quality = 0").count()


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, None), (8, 0, 1), (9, 0, 0), (9, 1, 0), (None, 1, 0), (10, None, 0)], "doc_id long, quality int, toxic int")
    out = quality_sample(odd_docs, labels).cache()
    assert out.count() == odd_docs.count() and out.where("n_grams = 0 and log_weight is null and not kept").count() == 3
    assert {r.doc_id for r in out.where("kept").collect()} >= {5, 6} and out.where("kept and doc_id in (8, 9)").count() == 0
    assert quality_sample(odd_docs, labels.where("false")).where("kept").count() == odd_docs.count() - 3
    assert quality_sample(no_docs, labels).count() == 0
    named = odd_docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    by_name = quality_sample(named, labels.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), carry=True)
    assert by_name.where("kept").select("row.*").columns == odd_docs.columns and by_name.where("kept").count() >= 1


def test_quality_against_brute_force(spark):
    """Weights by plain counting of n-grams; then noise at the scale of the weights, and the k largest keys."""
    from gridmill.llm.quality import features

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality_sample(docs, labels).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    quality = {r.doc_id: r.quality for r in labels.collect()}
    grams = {d: Counter(b for _, _, bucket in features([t]) for b in bucket.tolist()) for d, t in texts.items()}
    raw, target = Counter(), Counter()
    for d, c in grams.items():
        raw.update(c)
        target.update(c if quality.get(d) == 1 else {})
    share = lambda c, b: (c[b] + 0.5) / (c.total() + 0.5 * 2**14)
    for d, c in grams.items():
        if c:
            assert got[d].log_weight == pytest.approx(sum(n * np.log(share(target, b) / share(raw, b)) for b, n in c.items()), abs=1e-6)
    known = [(got[d].log_weight, q == 1) for d, q in quality.items() if got[d].log_weight is not None]
    cut = best_cut(*map(np.array, zip(*known)))
    k = sum(c.log_weight is not None and c.log_weight >= cut for c in got.values())
    keyed = sorted((r for r in got.values() if r.key is not None), key=lambda r: -r.key)
    assert {r.doc_id for r in keyed if r.key >= keyed[k - 1].key} == {d for d, r in got.items() if r.kept}
    noise = np.array([r.key - r.log_weight for r in keyed])
    assert abs(noise.mean() - 0.5772) < 0.35 and abs(noise.std() - np.pi / np.sqrt(6)) < 0.35


def test_sampling_follows_the_weights(spark):
    """Of texts with equal weight, chance picks: another seed, another choice."""
    rows = [(i, f"common words here {i}") for i in range(400)] + [(1000, "good good good"), (1001, "bad bad bad")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(200)] + [(1000, 1), (1001, 0)], "doc_id long, quality int")
    one, two = ({r.doc_id for r in quality_sample(docs, labels, seed=s).where("kept").collect()} for s in (1, 2))
    assert one != two and 0.5 < len(one) / len(two) < 2


def test_top_key(spark):
    rng = np.random.default_rng(6)
    keys = np.concatenate((rng.normal(size=3000), [5.0] * 40))
    df = spark.createDataFrame([(float(k),) for k in keys], "key double")
    for k in (1, 30, 41, 1000, 3040):
        kept = int((keys >= top_key(df, k)).sum())
        assert kept == max(k, 40)
    assert top_key(df, 0) == np.inf


def test_best_cut():
    assert 2 < best_cut(np.array([1.0, 2.0, 3.0, 4.0]), np.array([False, False, True, True])) < 3
    assert best_cut(np.array([1.0, 1.0]), np.array([True, False])) == -np.inf


def test_pipeline_stages(spark, sf, odd_docs):
    """Each stage on what the one before kept, against a brute-force version."""
    from tests.llm.test_pairs import brute_jaccard
    from tests.llm.test_texts import brute_benchmark, brute_secrets

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, sf).cache()
        after = {r.doc_id: r for r in docs.collect()}
        assert len(after) == docs.count() and after.keys() <= before.keys(), name
        rows = [(d, r.text) for d, r in before.items()]
        if name != "encode":
            assert docs.columns == columns
        if name == "quality":
            good = [d for d in before if labels.get(d) == 1]
            assert sum(d in after for d in good) > 0.95 * len(good)
            assert sum(d in after for d in before if labels.get(d) == 0) < 0.2 * sum(q == 0 for q in labels.values())
        elif name == "near_duplicates":
            rows.sort()
            assert sorted(after) == sorted({rows[i][0] for i in brute_jaccard([t for _, t in rows])})
        elif name == "benchmark":
            assert sorted(after) == sorted(r[0] for r in brute_benchmark(rows, items) if not r[5])
        elif name == "secrets":
            assert after.keys() == before.keys()
            assert not any(brute_secrets(r.text)[1].replace("hex", "") for r in after.values() if "AKIA" in r.text or "password=" in r.text)
        else:
            assert after.keys() == before.keys()


def test_pipeline_odd_rows(spark, odd_docs, tmp_path):
    rows = odd_docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"), "rid")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b c d"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {5} <= {r.doc_id for r in out}
    kept = corpus_pipeline.near_duplicates(spark, corpus_pipeline.quality(spark, rows, str(tmp_path)), str(tmp_path)).collect()
    assert kept and {(r.doc_id, r.rid) for r in kept} <= {(r.doc_id, r.rid) for r in rows.collect()}
    rows.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
