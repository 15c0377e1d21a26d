"""Cut texts into *neighbourhoods*: runs of windows that share one anchor.

A window is `width` consecutive units (bytes or words) of one text. Its anchor
is the leftmost `gram`-unit piece with the least hash. The anchor depends on
the window's content alone, so two equal windows have the same anchor piece at
the same offset. Consecutive windows with one anchor position make a
neighbourhood. Neighbourhoods partition the windows of a text, and there are
about 2 / (width - gram + 2) of them per unit, so an index over neighbourhoods
sees every equal pair of windows without storing every window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash

from gridmill.llm.bytehash import U64, gram_hash, running, slice_hash, sliding_min, word_spans

#: Space and \x09-\x0D part words; every other byte belongs to one.
WORD_BYTE = np.ones(256, dtype=bool)
WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes handled at once. A longer text is cut here, with overlap; cuts only split neighbourhoods.
SLICE = 1 << 18


@dataclass(frozen=True)
class Shape:
    """unit: "byte" or "word"; width: units in a window, 255 at most; gram: units in an anchor piece."""

    unit: str
    width: int
    gram: int

    @property
    def blocks(self) -> tuple[int, int, int]:
        """Windows in a block of the first, second and last cut (repeats.py); each divides the one before."""
        return (16, 4, 1) if self.unit == "byte" else (8, 2, 1)


@dataclass
class Found:
    """Neighbourhoods of some texts: arrays of equal length."""

    text: np.ndarray  # which text
    start: np.ndarray  # its first window, in units of the text
    count: np.ndarray  # its windows
    lead: np.ndarray  # units before the anchor in the first window
    key: np.ndarray  # hash of the anchor piece, int64
    digest: np.ndarray  # digest of all bytes that the windows cover, two int64 each


def normal_bytes(text: bytes, unit: str) -> bytes:
    """Bytes as they are; words joined by one space."""
    return text if unit == "byte" else b" ".join(text.split())


def unit_bounds(data: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    if unit == "byte":
        at = np.arange(len(data) + 1)
        return at[:-1], at[1:]
    return word_spans(data, WORD_BYTE)


def digests(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Digests of slices of data, n x 2 int64."""
    view, digest = memoryview(data), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]), dtype=np.int64).reshape(-1, 2)


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about SLICE bytes together."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def _cut(data: bytes, starts, ends, owner, base, shape: Shape, digested: bool) -> Found | None:
    """Neighbourhoods of one slice. owner: the text of each unit; base: its unit number in the text."""
    n, w, k = len(starts), shape.width, shape.gram
    if n < w:
        return None
    sums = running(np.frombuffer(data, dtype=np.uint8))
    if shape.unit == "byte" and len(data) == n:
        h = gram_hash(sums, k)
    else:
        h = slice_hash(sums, starts[: n - k + 1], ends[k - 1 :])
    ranked = (h & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U64)
    anchor = (sliding_min(ranked, w - k + 1) & U64(0xFFFFFFFF)).astype(np.int64)
    at = np.flatnonzero(owner[: n - w + 1] == owner[w - 1 :])
    if not len(at):
        return None
    a = anchor[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    start = at[first]
    digest = digests(data, starts[start], ends[start + count + w - 2]) if digested else np.zeros((0, 2), dtype=np.int64)
    return Found(owner[start], base[start], count, a[first] - start, h[a[first]].view(np.int64), digest)


def neighbourhoods(texts: list[bytes], shape: Shape, digested: bool = True) -> Iterator[Found]:
    """Neighbourhoods of texts in normal form (see normal_bytes)."""
    gap = b"" if shape.unit == "byte" else b" "
    for lo, hi in _groups(texts):
        group = texts[lo:hi]
        data = gap.join(group)
        if len(data) > 2 * SLICE:  # one long text
            yield from _long(data, lo, shape, digested)
            continue
        starts, ends = unit_bounds(np.frombuffer(data, dtype=np.uint8), shape.unit)
        edge = np.cumsum([0] + [len(t) + len(gap) for t in group[:-1]])
        first = np.searchsorted(starts, edge)
        sizes = np.diff(np.append(first, len(starts)))
        owner = np.repeat(np.arange(lo, hi), sizes)
        base = np.arange(len(starts)) - np.repeat(first, sizes)
        found = _cut(data, starts, ends, owner, base, shape, digested)
        if found is not None:
            yield found


def _long(data: bytes, index: int, shape: Shape, digested: bool) -> Iterator[Found]:
    starts, ends = unit_bounds(np.frombuffer(data, dtype=np.uint8), shape.unit)
    step = SLICE if shape.unit == "byte" else SLICE // 8
    for u in range(0, max(len(starts) - shape.width + 1, 0), step):
        v = min(u + step + shape.width - 1, len(starts))
        lo = starts[u]
        part = data[lo : ends[v - 1]]
        found = _cut(part, starts[u:v] - lo, ends[u:v] - lo, np.full(v - u, index), np.arange(u, v), shape, digested)
        if found is not None:
            yield found
