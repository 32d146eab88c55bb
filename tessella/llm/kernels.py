"""Vectorised kernels over words: tokens, 64-bit word hashes, shingle hashes, per-document sets.

Words are maximal runs of anything but space and bytes 0x09-0x0D, with A-Z lower-cased: exactly
what ``bytes.lower().split()`` yields on UTF-8. Words are hashed one by one (a
hash that mixes non-linearly, so no regular text makes words collide), the rest on whole batches.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import xxhash

_U = np.uint64
#: Fixed odd multipliers of the hashes; they only have to stay the same within one run.
_P = 0x9E3779B97F4A7C15
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
#: Seed of the second, independent hash.
WIDE = 0x5EED


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> _U(30))
        h = h * _M1
        h = h ^ (h >> _U(27))
        h = h * _M2
        return h ^ (h >> _U(31))


def words(text: str | None) -> list[bytes]:
    return [] if not text else text.encode("utf-8", "surrogatepass").lower().split()


def hash_words(tokens: list[bytes], seed: int = 0) -> np.ndarray:
    """64-bit XXH3 hashes of words, equal for equal words wherever they stand; another seed gives independent ones."""
    return np.fromiter(map(partial(xxhash.xxh3_64_intdigest, seed=seed) if seed else xxhash.xxh3_64_intdigest, tokens), _U, len(tokens))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows; of the whole sequence if it is shorter (none if empty)."""
    n = len(h)
    if n == 0:
        return h
    k_ = min(k, n)
    with np.errstate(over="ignore"):
        acc = h[: n - k_ + 1].copy()
        for i in range(1, k_):
            acc = mix(acc + _U(i)) * _U(_P) + h[i : n - k_ + 1 + i]
        return mix(acc + _U(k_))


def batch_hashes(texts: list[str | bytes | None], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of several texts in one array, with each text's first word (one offset more than texts)."""
    every: list[bytes] = []
    offsets = np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        if t:
            every += (t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass")).lower().split()
        offsets[i + 1] = len(every)
    return hash_words(every, seed), offsets


def shingle_runs(texts: list[str | bytes | None], k: int, seed: int = 0) -> list[np.ndarray]:
    """Per text: its shingle hashes in the order of the text, repeats included."""
    h, offsets = batch_hashes(texts, seed)
    whole = shingles(h, k) if len(h) >= k else h[:0]
    return [whole[a : b - k + 1] if b - a >= k else shingles(h[a:b], k) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def shingle_sets(texts: list[str | bytes | None], k: int) -> list[np.ndarray]:
    """Per text: its sorted distinct shingle hashes."""
    return [unique(x) for x in shingle_runs(texts, k)]


def wide_sets(texts: list[str | bytes | None], k: int) -> list[np.ndarray]:
    """Per text: its distinct shingles by two independent hashes, as sorted rows of two: what verification compares."""
    out = []
    for x, y in zip(shingle_runs(texts, k), shingle_runs(texts, k, WIDE), strict=True):
        order = np.lexsort((y, x))
        both = np.stack([x[order], y[order]], axis=1)
        out.append(both[np.concatenate(([True], (both[1:] != both[:-1]).any(axis=1)))] if len(both) else both)
    return out


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many rows of two hashes two wide sets share."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y[:, 0], x[:, 0])
    at[at == len(y)] = 0
    hit = y[at, 0] == x[:, 0]
    # rows that agree in the first hash only are told apart by the second; runs of one first hash are as good as never longer than one
    n = int((hit & (y[at, 1] == x[:, 1])).sum())
    for i in np.flatnonzero(hit & (y[at, 1] != x[:, 1])):
        lo, hi = np.searchsorted(y[:, 0], x[i, 0], "left"), np.searchsorted(y[:, 0], x[i, 0], "right")
        n += bool((y[lo:hi, 1] == x[i, 1]).any())
    return n


def unique(x: np.ndarray) -> np.ndarray:
    if len(x) < 2:
        return x
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))]
