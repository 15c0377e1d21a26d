"""Secret scans: fixed patterns, and the Shannon entropy of a sliding window.

The entropy scan looks at candidate strings, runs of at least MIN_RUN
characters of A-Z a-z 0-9 + / _ -. A window of WINDOW characters slides over
each; its character counts, and with them the sum of c*log2(c), change by one
character in and one out. Windows are judged by the characters they use: hex
digits only; digits with letters of both cases, of lower case or of upper case;
letters of both cases without a digit. What stays above its class's threshold
becomes a span, unless the allow-list knows the string's form. Letters of one
case alone are not judged, for that is how words look.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmill.llm.common import bound_batches

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Lower-case letters that an assignment can't do without; only texts with one of them are searched.
_HINTS = ("passw", "secret", "token", "api")

WINDOW = 20
MIN_RUN = 20
HEX_BITS = 3.0
MIXED_BITS = 3.6
LOWER_DIGIT_BITS = 3.5
UPPER_DIGIT_BITS = 3.5
LETTER_BITS = 3.6
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{MIN_RUN},}}")
_DIGIT, _LOWER, _UPPER = (re.compile(f"[{c}]") for c in ("0-9", "a-z", "A-Z"))
#: Forms that are no secrets: one character repeated, counting up, UUIDs, numbers, and words joined by - _ or /.
ALLOW = (
    re.compile(r"(.)\1*"),
    re.compile(r"[A-Za-z]*0?123456789[0-9A-Za-z]*"),
    re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I),
    re.compile(r"[0-9_/-]+"),
    re.compile(r"([A-Z]?[a-z]+|[0-9]{1,4})([-_/]([A-Z]?[a-z]+|[0-9]{1,4}))*"),
)
#: More such forms, for strings that lack digits or letters of one case: camel case, short numbers, words with a number, parts of a path.
WORDS = re.compile(
    r"(?:[-_/+]++|(?<![A-Za-z0-9])(?:[A-Za-z]?[a-z]*|[A-Z]+)(?![A-Za-z0-9])|(?:By|Is|To|Of|In|On|At|Id|As|Or)(?![a-z])|[A-Z]?[a-z]{2,3}(?=[A-Z_/+-]|$)"
    r"|[A-Z]?[a-z]{4,}(?![a-z])|[A-Z]{5,}(?![A-Za-z])|[0-9]{1,4}(?:st|nd|rd|th|s)?(?![0-9A-Za-z])|[0-9]{1,4}(?=[A-Z]?[a-z]{4}|[A-Z]{5}))+"
)
_HEX_DIGITS = frozenset("0123456789abcdefABCDEF")
_KINDS = {"assign": 0, "access": 1, "hex": 2, "entropy": 3}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, in code points."""
    spans = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return spans


def _threshold(counts: Counter) -> float | None:
    """Bits that a window of these characters must reach; None for classes that are not judged."""
    used = counts.keys()
    if used <= _HEX_DIGITS:
        return HEX_BITS
    digit, lower, upper = (any(test(c) for c in used) for test in (str.isdigit, str.islower, str.isupper))
    if lower and upper:
        return MIXED_BITS if digit else LETTER_BITS
    if digit and (lower or upper):
        return LOWER_DIGIT_BITS if lower else UPPER_DIGIT_BITS
    return None


def entropy_spans(text: str, window: int = WINDOW) -> list[tuple[int, int, str]]:
    """Merged windows of high entropy."""
    weight = [0.0] + [c * log2(c) for c in range(1, window + 1)]
    full = log2(window)
    spans: list[tuple[int, int, str]] = []
    for m in CANDIDATE.finditer(text):
        run, at = m[0], m.start()
        kinds = sum(bool(p.search(run)) for p in (_DIGIT, _LOWER, _UPPER))
        if kinds < 2 and not _DIGIT.search(run) or any(form.fullmatch(run) for form in ALLOW):
            continue
        if kinds < 3 and WORDS.fullmatch(run):
            continue
        counts = Counter(run[:window])
        total = sum(weight[c] for c in counts.values())
        for i in range(len(run) - window + 1):
            if i:
                gone, come = run[i - 1], run[i + window - 1]
                total += weight[counts[gone] - 1] - weight[counts[gone]]
                counts[gone] -= 1
                if not counts[gone]:
                    del counts[gone]
                total += weight[counts[come] + 1] - weight[counts[come]]
                counts[come] += 1
            least = _threshold(counts)
            if least is not None and full - total / window >= least:
                if spans and spans[-1][1] >= at + i:
                    spans[-1] = (spans[-1][0], at + i + window, "entropy")
                else:
                    spans.append((at + i, at + i + window, "entropy"))
    return spans


def spans_text(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], _KINDS[s[2]])))


def redacted(text: str, spans) -> str:
    """The text with every span, overlapping ones merged, replaced by its first kind in brackets."""
    out, at = [], 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], _KINDS[s[2]])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


FOUND = T.StructType([T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex")] + [T.StructField(n, T.StringType()) for n in ("base_spans", "spans", "redacted")])


@F.arrow_udf(FOUND)
def found_secrets(texts: pa.Array) -> pa.Array:
    """What is found in each text, as a struct; a null text has no spans and stays null."""
    names = FOUND.names
    rows = []
    for text in texts.to_pylist():
        base = base_spans(text or "")
        every = base + entropy_spans(text or "")
        counts = [sum(s[2] == kind for s in base) for kind in ("assign", "access", "hex")]
        rows.append((*counts, spans_text(base), spans_text(every), redacted(text, every) if text is not None else None))
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64() if n.startswith("n_") else pa.string()) for n, c in zip(names, columns)], names)


def secret_scan(docs: DataFrame) -> DataFrame:
    """Find secrets in whole texts.

    docs: doc_id, text. Returns doc_id, n_assign, n_access, n_hex, base_spans,
    spans (kind:start:end by start, in code points, end exclusive) and redacted
    (the text with spans replaced; null stays null), a row for each input row.
    Null and empty texts have no spans; long texts are searched whole; repeated
    rows each get their row. Other columns, of whatever name, are ignored; no rows
    give no rows.
    """
    bound_batches(docs.sparkSession)
    return docs.select("doc_id", found_secrets("text").alias("found")).select("doc_id", "found.*")


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    out = secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")
