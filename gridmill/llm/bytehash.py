"""Vectorised hashing over byte buffers, shared by the text operators.

A polynomial hash modulo 2**64 gives the hash of any slice from one running
sum. It only ever *proposes* candidates or feeds hashed-feature models; where
equality decides a result, a digest of the bytes themselves is compared.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix constants), so that close inputs spread out."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * _BASE)


def _power(base: U64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=U64)
        steps[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(steps)
    return have[:n]


def running(data: np.ndarray) -> np.ndarray:
    """Running sums over a uint8 buffer; input of :func:`slice_hash`."""
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=out[1:])
    return out


def slice_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each slice [start, end); equal bytes have equal hashes wherever they stand."""
    return mix((sums[end] - sums[start]) * _power(_BASE_INVERSE, len(sums))[start])


def gram_hash(sums: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k bytes."""
    n = max(len(sums) - k, 0)
    return mix((sums[k : k + n] - sums[:n]) * _power(_BASE_INVERSE, n))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of `width` values, by doubling."""
    span = 1
    total = len(x) - width + 1
    if total <= 0:
        return x[:0]
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:total], x[width - span : width - span + total])


def word_spans(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of bytes b with is_word[b]."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = is_word[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
