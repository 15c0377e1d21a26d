import glob
import hashlib
import json
import random
import re
from math import log2

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridmill.llm import decontaminate
from gridmill.llm.bpe import WordBPE, bpe_encode, load, op7_bpe_encoding
from gridmill.llm.decontaminate import find_benchmark, index_documents, op8_benchmark_decontamination
from gridmill.llm.secrets import ALLOW, entropy_spans, op6_secret_scan, secret_scan

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def by_library(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)


def test_bpe_query(spark, library):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op7_bpe_encoding(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for doc, text in texts.items():
        n, ids, decoded = by_library(library, text)
        assert (got[doc].n_tokens, got[doc].ids_sha256, got[doc].decoded_sha256) == (n, SHA(ids), SHA(decoded))


def test_bpe_odd_texts(spark, library, odd_docs, no_docs):
    texts = [r.text for r in odd_docs.collect()]
    texts += ["it's we'LL I'd <|endoftext|>x<|startoftext|><|ENDOFTEXT|>", "ΟΔΟΣ ΣΣ Σ", "İstanbul ǅ ﬃ ß", "áẹ̇", "日本語 テスト 12345 ½ ²", "🙂👩‍👩‍👧 \x00\x1c\x85 z", "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "<|endoftext", "'s't're''''--__==", "thethethethandandandinging" * 20]
    bpe = load(PATH)
    for t in texts:
        got = bpe.encode(t or "")
        assert (got.n, got.ids, bpe.decode(got.ids)) == by_library(library, t), t
    out = bpe_encode(odd_docs, PATH)
    assert out.count() == odd_docs.count() and out.where("n_tokens = 0 and ids = '' and decoded = ''").count() == 3
    assert bpe_encode(no_docs, PATH).count() == 0


def test_bpe_judges_by_parts(library):
    bpe, merged = WordBPE(PATH), []
    plain = bpe._merge
    bpe._merge = lambda parts: merged.append(parts) or plain(parts)
    rng = random.Random(5)
    for letters in ("etaoinshr", "abcdefghijklmnopqrstuvwxyz", "aeéñßü日本"):
        text = " ".join("".join(rng.choices(letters, k=rng.randint(1, 30))) for _ in range(2000))
        got = bpe.encode(text)
        assert (got.n, got.ids, bpe.decode(got.ids)) == by_library(library, text)
    assert not merged  # a pair is judged by its parts; merging every new pair anew took most of the time
    bpe = WordBPE(PATH)
    ids = rng.sample(sorted(i for i, s in bpe.string.items() if not s.endswith("\n")), 300) + [bpe.id_of[c] for c in "aentrs"]
    for a, b in zip(ids, ids[1:] + ids[:1]):
        x, y = bpe.string[a], bpe.string[b]
        assert bpe._compatible(a, b) == (bpe._merge(bpe._symbols(x + y)) == [x, y]), (x, y)


def test_bpe_merges_out_of_order(tmp_path):
    spec = json.loads(open(PATH, encoding="utf-8").read())
    vocab = ["a", "b", "c", "a</w>", "b</w>", "c</w>", "abc</w>", "ab", "bc</w>"]
    spec["added_tokens"] = []
    spec["model"] |= {"vocab": {s: i for i, s in enumerate(vocab)}, "merges": [["a", "bc</w>"], ["ab", "c</w>"], ["b", "c</w>"], ["a", "b"]]}
    path = tmp_path / "small.json"
    path.write_text(json.dumps(spec))
    bpe, small = WordBPE(str(path)), Tokenizer.from_file(str(path))
    assert not bpe.ordered
    for word in ("abc", "ab", "bc", "cab", "abab"):
        assert bpe.encode(word).ids == " ".join(map(str, small.encode(word, add_special_tokens=False).ids)), word


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_benchmark(docs, items, width=10):
    windows = {}
    for item, text in items:
        w = WORD.findall(low(text))
        for i in range(max(len(w) - width, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w = WORD.findall(low(text))
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                ids = windows.get(tuple(w[i : i + size]))
                if ids:
                    hit.update(range(i, i + size))
                    found |= ids
        out.append((doc, len(w), len(hit), len(found), SHA(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=str)


def test_benchmark_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted((tuple(r) for r in op8_benchmark_decontamination(spark, sf).collect()), key=str)
    want = brute_benchmark(docs, items)
    assert got == want and sum(w[5] for w in want) > 10


@pytest.mark.parametrize("chunk", [50_000, 3])
def test_benchmark_odd_rows(spark, odd_docs, no_docs, chunk):
    items = spark.createDataFrame([(1, "A b-C"), (2, None), (3, "..."), (4, "x x x x x x x x x x x x"), (4, "nothing here but a null id"), (10, "one"), (10, "one"), (5, "NULL id")], "item_id long, text string")
    out = find_benchmark(index_documents(odd_docs), items, chunk=chunk)
    got = sorted(((r.doc_id, r.n_words, len(r.hits), len(r["items"]), SHA(",".join(r["items"])), bool(r.hits)) for r in out.collect()), key=str)
    assert got == brute_benchmark([tuple(r)[:2] for r in odd_docs.collect()], [tuple(r) for r in items.collect()])
    assert find_benchmark(index_documents(no_docs), items, chunk=chunk).count() == 0
    assert find_benchmark(index_documents(odd_docs), items.where("false"), chunk=chunk).where("size(hits) > 0").count() == 0


def test_segments_of_a_task_lie_in_several_row_groups(spark, monkeypatch):
    """A task that writes many segments never holds them all, nor does one that reads them."""
    monkeypatch.setattr(decontaminate, "SEGMENT", 20)
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.sha1((F.col("id") * 100_000 + i).cast("string"))))
    index = index_documents(spark.range(0, 200, numPartitions=1).select(F.col("id").alias("doc_id"), F.substring(text, 1, 400_000).alias("text")))
    groups = [g.row_group(i).total_byte_size for path in glob.glob(index.stored_path.removeprefix("file://") + "/*.parquet") for g in [pq.ParquetFile(path).metadata] for i in range(g.num_row_groups)]
    assert index.count() >= 10 and len(groups) > 1 and max(groups) < 48 << 20


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "gamma of the beta and alpha"), (3, "alpha " + "x " * 30 + "beta gamma")], "doc_id long, text string")
    docs = docs.repartition(2)
    items = spark.createDataFrame([(7, "Alpha, beta, gamma")], "item_id long, text string")
    got = {r.doc_id: (r["items"], r.near_items) for r in find_benchmark(index_documents(docs), items, slop=6).collect()}
    assert got == {1: (["7"], ["7"]), 2: ([], ["7"]), 3: ([], [])}


def brute_secrets(text):
    spans = []
    for m in re.finditer(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or ""):
        spans += [(m.start(), 0, m.end())] * (len(m[2]) >= 8)
    for k, p, least in ((1, r"AKIA[A-Z0-9]+", 16), (2, r"[0-9a-f]+", 32)):
        spans += [(m.start(), k, m.end()) for m in re.finditer(p, text or "") if len(m[0]) >= least]
    names = ("assign", "access", "hex")
    return [sum(s[1] == k for s in spans) for k in range(3)], ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))


def test_secret_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op6_secret_scan(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for doc, text in texts.items():
        n, spans = brute_secrets(text)
        r = got[doc]
        assert ([r.n_assign, r.n_access, r.n_hex], r.base_sha256) == (n, SHA(spans))
        assert set(filter(None, spans.split(","))) <= set(r.spans.split(","))
    assert sum(r.n_assign for r in got.values())


def test_secret_odd_rows(spark, odd_docs, no_docs):
    texts = ["Token = 'abcdefgh' secret=short API_KEY:\"k.e-y=+/1234\"", "toKen: tokenſecret=abcdefghi passwdpasswd:12345678", "AKIA123 AKIAABCDEFGHIJKL", "é" * 3 + "0123456789abcdef" * 3, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r, t in zip(secret_scan(df).orderBy("doc_id").collect(), texts):
        n, spans = brute_secrets(t)
        assert ([r.n_assign, r.n_access, r.n_hex], r.base_spans) == (n, spans)
        assert (r.redacted is None) == (t is None)
    assert secret_scan(odd_docs).count() == odd_docs.count() and secret_scan(no_docs).count() == 0


@pytest.mark.parametrize("key", ["k3j9x0q2m7v5b1n8z4w6", "K3J5X2QAM7VTB4NWZ6YH", "QkdXbPzLsRtYvHmCnWaE", "aGVq/bXdLk+ZpRtYwQmF", "x9Kq2Lm7Zp4Rt8Wv3Ys6"])
def test_entropy_of_each_class(key):
    """Lower case + digits, upper case + digits, letters of both cases, base64 without a digit, all three."""
    text = f"the value {key} stays"
    assert [text[a:b] for a, b, _ in entropy_spans(text)] == [key]


@pytest.mark.parametrize("text", ["getElementsByTagNameAndClass", "/usr/share/doc/python3/examples", "chapter12section34paragraph", "covid-19-and-the-2nd-dose-of-it", "AbstractSingletonProxyFactory", "MAX_BUFFER_SIZE_2048_BYTES", "internationalization-and-more"])
def test_words_are_no_secrets(text):
    assert not entropy_spans(text)


def test_entropy_counts_are_right():
    key = "x9Kq2Lm7Zp4Rt8Wv3Ys6Bn1"
    text = f"the value {key} stays, 550e8400-e29b-41d4-a716-446655440000 and aaaaaaaaaaaaaaaaaaaaaaaaa1 go"
    spans = entropy_spans(text)
    assert [text[a:b] for a, b, _ in spans] == [key]
    assert any(p.fullmatch("long-snake_case_name-version2") or p.fullmatch("long-snake_case_name") for p in ALLOW)
    window = key[:20]
    assert -sum(window.count(c) / 20 * log2(window.count(c) / 20) for c in set(window)) > 3.6
