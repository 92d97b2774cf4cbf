"""Anchors and rolling hashes of byte strings, chosen by content alone."""

from __future__ import annotations

import numpy as np

_random = np.random.default_rng(20240301)
_byte_hash = _random.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_base = np.uint64(0xD6E8FEB86659FD93)
_inverse = np.uint64(pow(int(_base), -1, 1 << 64))
_places = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[0] = 1
    return np.multiply.accumulate(out)


class Ranges:
    """Hashes of any ranges of a byte string, from running sums of byte hash times base ** place."""

    def __init__(self, data: bytes | np.ndarray):
        data = np.frombuffer(data, np.uint8)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_byte_hash[data] * _powers(_base, len(data) + 1)[:-1], out=self.sums[1:])
            self.back = _powers(_inverse, len(data) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, in linear time."""
    n = len(values)
    full = -(-n // width) * width
    padded = np.concatenate([values, np.full(full - n, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(ranges: Ranges, size: int, gram: int, length: int) -> np.ndarray:
    """Starts of the grams that some string of ``length`` has as its least (the first, if there are more).

    Two equal strings of ``length`` bytes, wherever they are, choose the same gram at the same distance.
    Works on runs of about a million places, so texts may be of any length.
    """
    n = size - gram + 1
    width = length - gram + 1
    found = []
    for a in range(0, max(n - width + 1, 0), _places // 2):
        at = np.arange(a, min(n, a + _places // 2 + width - 1))
        key = ranges(at, at + gram) & ~np.uint64(_places - 1) | (at - a).astype(np.uint64)
        found.append(np.unique(sliding_min(key, width) & np.uint64(_places - 1)).astype(np.int64) + a)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
