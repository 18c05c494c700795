"""Word-shingle hashes of whole texts, by array arithmetic over the bytes."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(7919)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_MIX = [np.uint64(int(x) * 2 + 1) for x in _rng.integers(1, 1 << 62, 16, dtype=np.uint64)]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n - 1).bit_length())
    if size not in _POWERS:
        one = np.ones(size, np.uint64)
        one[1:] = _STEP
        back = np.ones(size, np.uint64)
        back[1:] = _BACK
        _POWERS.clear()
        _POWERS[size] = (np.multiply.accumulate(one), np.multiply.accumulate(back))
    return _POWERS[size]


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word (run of bytes other than space and U+0009 to U+000D), A-Z in lower case."""
    b = _LOWER[np.frombuffer(raw, np.uint8)]
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~_SPACE[b]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    return span_hashes(b, starts, ends)


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes from each start to its end."""
    power, back = _powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * power[: len(b)], out=total[1:])
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _MIX[15])


def shingle_set(raw: bytes, width: int = 4) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words; of all words where there are fewer; none without words."""
    w = word_hashes(raw)
    if not len(w):
        return w
    k = min(width, len(w))
    n = len(w) - k + 1
    h = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        h = mix(h + w[i : i + n] * _MIX[i])
    return np.unique(h)
