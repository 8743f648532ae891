"""Sets of word shingles as sorted 64-bit hashes, computed on whole batches of bytes."""

from __future__ import annotations

import numpy as np

SHINGLE = 5

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD1342543DE82EF95)
# Of an eight-byte lane, the part that lies within a word, by the bytes that it has.
_LANE_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_powers: np.ndarray | None = None
_inverses: np.ndarray | None = None
_byte_codes: np.ndarray | None = None


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit hash over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_codes() -> np.ndarray:
    """A random 64-bit code for each byte."""
    global _byte_codes
    if _byte_codes is None:
        _byte_codes = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
    return _byte_codes


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to ``n``."""
    global _powers, _inverses
    if _powers is None or len(_powers) < n:
        size = max(n, 1 << 16)
        factors = np.full(size, _BASE)
        factors[0] = 1
        back = np.full(size, _INVERSE)
        back[0] = 1
        _powers, _inverses = np.cumprod(factors), np.cumprod(back)
    return _powers[:n], _inverses[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of coded bytes times powers of the base; entry k is for the first k bytes."""
    up, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_codes()[data] * up, out=sums[1:])
    return sums


def substring_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges, equal for equal bytes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, read in lanes of eight bytes with a mixing step after each.

    No two words are bound to collide, as they would be under a polynomial modulo 2**64."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    sizes = ends - starts
    h = mix(sizes.astype(np.uint64) * _STEP)
    left = np.arange(len(starts))
    at = 0
    while len(left):
        inside = np.minimum(sizes[left] - at, 8)
        lane = lanes[starts[left] + at] & _LANE_MASK[inside]
        h[left] = mix((h[left] ^ lane) * _STEP + _BASE)
        at += 8
        left = left[sizes[left] > at]
    return h


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct hashes of five-word shingles, ascending; of all words if there are fewer."""
    if not text:
        return np.empty(0, np.uint64)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.empty(0, np.uint64)
    words = word_hashes(data, starts, ends)
    width = min(SHINGLE, len(words))
    rows = len(words) - width + 1
    h = np.full(rows, np.uint64(width))
    for k in range(width):
        h = mix(h * _STEP + words[k:k + rows])
    return np.unique(h)
