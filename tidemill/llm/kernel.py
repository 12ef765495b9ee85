"""Vectorised text primitives that the Python-side operators share.

Texts are handled as UTF-8 bytes.  A *word* is a maximal run of bytes other
than 0x20 and 0x09-0x0D, which is what ``bytes.split()`` returns.  Hashes are
64-bit polynomial hashes (modulo 2**64) over random byte codes, finished by a
mixing step; equal strings always get equal hashes on every machine.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1

# A code for each byte value.
CODES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

STRETCH = 1 << 20

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the longest n so far."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 24:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix_int(x: int) -> int:
    x &= _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i+width]) for each i."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    if have < width:
        d = width - have
        x = np.minimum(x[: len(x) - d], x[d:])
    return x


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte array."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ink = np.empty(len(data) + 2, dtype=np.int8)
    ink[0] = ink[-1] = 0
    np.logical_not(SPACE[data], out=ink[1:-1].view(bool))
    edge = np.diff(ink)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each data[start:end]; spans must not overlap and be ascending. About STRETCH bytes are looked at at a time."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + STRETCH, side="right")))
        low, high = int(starts[a]), int(ends[b - 1])
        # Prefix sums of code * B^-i; a span's sum is then shifted by B^start.
        pre = np.empty(high - low + 1, np.uint64)
        pre[0] = 0
        np.cumsum(CODES[data[low:high]] * powers(_INVERSE, high - low), out=pre[1:])
        first, last = starts[a:b] - low, ends[a:b] - low
        out[a:b] = mix((pre[last] - pre[first]) * powers(_BASE, high - low)[first] + (last - first).astype(np.uint64))
        a = b
    return out


def sequence_windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of h[i:i+width] for each i, where h holds word hashes."""
    n = len(h)
    if n < width:
        return np.empty(0, np.uint64)
    out = h[: n - width + 1].copy()
    b = np.uint64(_BASE)
    for k in range(1, width):
        out *= b
        out += h[k : n - width + 1 + k]
    return mix(out)


def joined(texts: list[bytes], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each followed by ``gap`` spaces, with the start of each (and the end of all)."""
    sep = b" " * gap
    sizes = np.fromiter((len(t) + gap for t in texts), np.int64, len(texts))
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    return np.frombuffer(sep.join(texts) + sep if texts else b"", np.uint8), at


def batches(sizes, most: int):
    """Slices of consecutive items whose sizes add up to about ``most``; one large item stands alone."""
    start, total = 0, 0
    for i, s in enumerate(sizes):
        if i > start and total + s > most:
            yield start, i
            start, total = i, 0
        total += s
    if start < len(sizes):
        yield start, len(sizes)
