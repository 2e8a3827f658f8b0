"""Word and shingle hashes of many texts at once, in numpy.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. A word's hash is a
polynomial over its bytes modulo 2**64, finished by a mixer; it is the same wherever the word stands.

Defined cases: an empty text has no words and no shingles; fewer words than a shingle takes are one shingle; repeated shingles
count once. Memory is some 40 bytes for each byte of a pass, and a single long text is a pass of its own.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def _series(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        _powers["up"] = _series(_BASE, size)
        _powers["down"] = _series(pow(_BASE, -1, 1 << 64), size)
    return _powers["up"][:n], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher for 64-bit values (in place)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the bytes, and how many words each text has."""
    n = len(raw)
    word = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = word[:-1]
    before[edge[:n]] = False
    after = np.empty(n, bool)
    after[n - 1 :] = False
    after[:-1] = word[1:]
    after[edge[1:]] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of lower-cased bytes."""
    up, down = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text; of all its words if they are fewer than k."""
    starts, ends, counts = word_spans(raw, offsets)
    words = span_hashes(raw, starts, ends)
    n = len(words)
    full = np.full(max(0, n - k + 1), k, np.uint64)
    for j in range(k if n >= k else 0):
        full = mix(full * np.uint64(0xFF51AFD7ED558CCD) + words[j : n - k + 1 + j])
    at = np.concatenate([[0], np.cumsum(counts)])
    out = []
    for i, c in enumerate(counts):
        if c >= k:
            out.append(np.unique(full[at[i] : at[i + 1] - k + 1]))
        elif c:
            h = np.full(1, c, np.uint64)
            for w in words[at[i] : at[i + 1]]:
                h = mix(h * np.uint64(0xFF51AFD7ED558CCD) + w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
