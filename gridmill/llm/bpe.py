"""BPE encoding and decoding by dynamic programming over prefixes.

For each prefix of a word there is exactly one token that ends its encoding.
Candidates are the vocabulary entries that end there, found by an automaton
with suffix links; the one kept is that whose pair with the last token of the
shorter prefix is compatible, i.e. two tokens that stay as they are when their
joined string is encoded. The back-pointers from the whole word give the ids.
Where each token comes from one merge, after those of its parts, two tokens are
judged by the parts at their border; else their joined string is merged.

Words recur, so each Python worker keeps the ids of the words it has seen, up
to a fixed number.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.common import arrow_map

#: Words that a worker remembers, and characters of words and ids together; when full, it starts afresh.
REMEMBERED, REMEMBERED_CHARS = 300_000, 8_000_000
_END = "\n"  # stands for the end-of-word suffix; byte-level text never holds it


def byte_letters() -> dict[int, str]:
    """The letter of each byte in byte-level vocabularies: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoded(NamedTuple):
    n: int
    ids: str


class WordBPE:
    """A byte-level BPE with a word-end suffix, from a tokenizer file in JSON."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        mark = lambda s: s[: -len(suffix)] + _END if s.endswith(suffix) else s
        self.names = {i: s for s, i in model["vocab"].items()}
        self.id_of = {mark(s): i for s, i in model["vocab"].items()}
        self.string = {i: s for s, i in self.id_of.items()}
        self.sizes = {i: len(s) for i, s in self.string.items()}
        self.rank, self.made, self.ordered = {}, {}, True
        for r, (a, b) in enumerate((mark(a), mark(b)) for a, b in model["merges"]):
            self.rank.setdefault((a, b), r)
            self.ordered &= a + b not in self.made and all(p in self.made or len(self._symbols(p)) == 1 for p in (a, b))
            self.made[a + b] = (r, a, b)
        self.automaton = ahocorasick.Automaton()
        self.whole: dict[str, bool] = {}
        for s, i in self.id_of.items():
            if self._whole(s):
                self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.names |= {i: s for s, i in self.special.items()}
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.compatible = lru_cache(1 << 17)(self._compatible)
        self.words: dict[str, str] = {}
        self.held = 0
        self.name_of = {str(i): s for i, s in self.names.items()}

    def _merge(self, parts: list[str]) -> list[str]:
        """Plain merging; used on one or two tokens, to judge them where merges are not in order."""
        while len(parts) > 1:
            rank, at = min((self.rank.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _symbols(self, s: str) -> list[str]:
        return [*s[:-2], s[-2:]] if s.endswith(_END) else list(s)

    def _spine(self, token: str, side: int) -> list[tuple[str, float]]:
        """A token and the parts at its end (side 2) or start (1), each with the rank of the merge that takes it up."""
        out, taken = [(token, float("inf"))], token
        while taken in self.made:
            rank, taken = self.made[taken][0], self.made[taken][side]
            out.append((taken, rank))
        return out

    def _crossed(self, a: str, b: str) -> list[tuple[str, str]]:
        """Pairs across the border of two whole tokens that merge before either part is taken up on its own side; of equal ranks, the left comes first."""
        starts, rank = self._spine(b, 1), self.rank.get
        return [(x, y) for x, to_x in self._spine(a, 2) for y, to_y in starts if (r := rank((x, y))) is not None and r < to_x and r <= to_y]

    def _whole(self, token: str) -> bool:
        """Whether a token's string, encoded, is that token."""
        if token not in self.whole:
            if self.ordered and token in self.made:
                _, a, b = self.made[token]
                self.whole[token] = self._whole(a) and self._whole(b) and self._crossed(a, b) == [(a, b)]
            else:
                self.whole[token] = len(self._merge(self._symbols(token))) == 1
        return self.whole[token]

    def _compatible(self, left: int, right: int) -> bool:
        a, b = self.string[left], self.string[right]
        return not self._crossed(a, b) if self.ordered else self._merge(self._symbols(a + b)) == [a, b]

    def encode_letters(self, word: str) -> list[int]:
        """Ids of one word given in byte letters, word end included."""
        compatible = self.compatible
        last: list[int | None] = [None] * len(word)
        for at, (size, token) in self.automaton.iter(word):  # of a place, the longest first
            if last[at] is None and (size > at or (before := last[at - size]) is not None and compatible(before, token)):
                last[at] = token
        ids, i, sizes = [], len(word), self.sizes
        while i:
            token = last[i - 1]
            if token is None:
                raise ValueError(f"the vocabulary can't spell {word!r}")
            ids.append(token)
            i -= sizes[token]
        return ids[::-1]

    def word(self, word: str) -> str:
        """Ids of one word, remembered."""
        known = self.words.get(word)
        if known is None:
            if len(self.words) >= REMEMBERED or self.held > REMEMBERED_CHARS:
                self.words.clear()
                self.held = 0
            letters = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
            known = self.words[word] = " ".join(map(str, self.encode_letters(letters + _END)))
            self.held += len(word) + len(known)
        return known

    def decode(self, ids: str) -> str:
        """The file names no decoder, so tokens stand as they are, with a space between."""
        return " ".join(map(self.name_of.__getitem__, ids.split()))

    def encode(self, text: str) -> Encoded:
        parts: list[str] = []
        for piece in self.special_pattern.split(text) if self.special_pattern else [text]:
            if piece in self.special:
                parts.append(str(self.special[piece]))
            elif piece:
                normal = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
                known, word = self.words.get, self.word
                parts += [known(w) or word(w) for w in self.pattern.findall(normal)]
        ids = " ".join(parts)
        return Encoded(ids.count(" ") + 1 if ids else 0, ids)


@lru_cache(2)
def load(path: str) -> WordBPE:
    return WordBPE(path)


def bpe_encode(docs: DataFrame, path: str, decode: bool = True) -> DataFrame:
    """Encode whole texts and decode the ids again.

    docs: doc_id, text. Returns doc_id, n_tokens, ids (decimal, one space
    between) and, unless told not to, decoded, a row for each input row. A null
    or empty text has no tokens; long texts are encoded whole; repeated rows are
    each encoded. Strings of special tokens in a text become those tokens. Other
    columns are ignored; no rows give no rows. `path` is a tokenizer file present
    on every executor.
    """

    def encode(batch):
        model = load(path)
        found = [model.encode(t) for t in batch["text"].to_pylist()]
        out = {"doc_id": batch["doc_id"], "n_tokens": [e.n for e in found], "ids": [e.ids for e in found]}
        yield out | {"decoded": [model.decode(e.ids) for e in found]} if decode else out

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return arrow_map(rows, f"doc_id {kind}, n_tokens long, ids string" + ", decoded string" * decode, encode)


def op7_bpe_encoding(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = bpe_encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path("word_bpe_49k.json")))
    return out.select("doc_id", "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
