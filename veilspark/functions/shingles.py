"""Vectorised word splitting and word-shingle hashing for Arrow batches.

Words are the longest runs of letters and digits of the lower-cased text. A whole batch is laid out as one
code point array; word hashes are differences of a polynomial prefix sum modulo 2**64, so no Python object is
made per word. Equal words get equal hashes everywhere; different words collide with probability about 2**-64.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEPS = 1 << 16


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letter-or-digit flags and random values per code point; powers of the base and of its inverse."""
    alnum = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    value = mix(np.arange(0x110000, dtype=U) + U(0x632BE59BD9B4E019))
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([np.ones(1, U), np.full(_STEPS - 1, _BASE)]), dtype=U)
        down = np.cumprod(np.concatenate([np.ones(1, U), np.full(_STEPS - 1, _INVERSE)]), dtype=U)
    return alnum, value, up, down


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche on 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def word_spans(texts: Sequence[str | None], lower: bool = True) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Joined text, its code points, word starts, word ends and the word offset of each text (n + 1 values)."""
    parts = [(t.lower() if lower else t) if t else "" for t in texts]
    joined = "\n".join(parts) + "\n"
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    alnum = _tables()[0][cps]
    edge = np.diff(np.concatenate([np.zeros(1, np.int8), alnum.view(np.int8)]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    return joined, cps, starts, ends, np.searchsorted(starts, np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)]))


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, and the offset of each text's first word (n + 1 values)."""
    _, cps, starts, ends, offsets = word_spans(texts)
    return hash_spans(cps, starts, ends), offsets


def hash_spans(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans of a code point array; a span's hash doesn't depend on its place."""
    _, value, up, down = _tables()
    n = len(cps)
    with np.errstate(over="ignore"):
        terms = value[cps]
        jump, scale = U(pow(int(_BASE), _STEPS, 1 << 64)), U(1)
        for i in range(0, n, _STEPS):  # a block at a time, so the powers stay in the processor's cache
            part = terms[i : i + _STEPS]
            part *= up[: len(part)]
            part *= scale
            scale *= jump
        prefix = np.empty(n + 1, U)
        prefix[0] = 0
        np.cumsum(terms, dtype=U, out=prefix[1:])
        h = prefix[ends] - prefix[starts]
        h *= down[starts & (_STEPS - 1)]
        if n > _STEPS:
            back = U(pow(int(jump), -1, 1 << 64))
            h *= np.cumprod(np.concatenate([np.ones(1, U), np.full(n // _STEPS, back)]), dtype=U)[starts // _STEPS]
        return mix(h + (ends - starts).astype(U))


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of each text, with repeats, and their offsets (n + 1 values)."""
    n = len(words) - k + 1
    counts = np.maximum(np.diff(offsets) - k + 1, 0)
    out = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
    if n <= 0:
        return np.zeros(0, U), np.zeros_like(out)
    with np.errstate(over="ignore"):
        h = np.zeros(n, U)
        for i in range(k):
            h = h * U(0xD1342543DE82EF95) + words[i : i + n]
            h ^= h >> U(29)
        h = mix(h)
    keep = np.arange(out[-1]) - np.repeat(out[:-1], counts) + np.repeat(offsets[:-1], counts)
    return h[keep], out


def shingle_sets(texts: Sequence[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, laid end to end, and their offsets (n + 1 values)."""
    h, offsets = shingle_hashes(*word_hashes(texts), k)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        h[i:j].sort()
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[first], owner[first]
    return h, np.searchsorted(owner, np.arange(len(offsets)))


def set_keys(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums that name the set of each text; 0, 0 for an empty set."""
    with np.errstate(over="ignore"):
        a = np.concatenate([np.zeros(1, U), np.cumsum(mix(h), dtype=U)])
        b = np.concatenate([np.zeros(1, U), np.cumsum(mix(h ^ U(0x5851F42D4C957F2D)), dtype=U)])
        return (a[offsets[1:]] - a[offsets[:-1]]).view(np.int64), (b[offsets[1:]] - b[offsets[:-1]]).view(np.int64)


def minhash(h: np.ndarray, offsets: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Signatures (n, size) of 32-bit values; rows of empty sets are 0."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, size, dtype=np.int64).astype(U) * U(2) + U(1)
    b = rng.integers(0, 1 << 63, size, dtype=np.int64).astype(U)
    out = np.zeros((len(offsets) - 1, size), np.uint32)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        at = offsets[:-1][full]
        with np.errstate(over="ignore"):
            for i in range(size):
                out[full, i] = np.minimum.reduceat(h * a[i] + b[i], at) >> U(32)
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted distinct arrays; 0 when both are empty."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    total = len(both) - common
    return common / total if total else 0.0
