"""Words of many texts at once, in numpy: places in a byte buffer and 64-bit hashes.

Hashes are polynomials over random byte values, mixed at the end. They are the same in every process.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Characters (bytes) that are worked on at once.
CHUNK = 1 << 20

#: The white space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Bits of ``h`` spread over all of it (a bijection)."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


_powers: list[np.ndarray] = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


def hash_ranges(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of buf[start:end] for each range."""
    if not len(starts):
        return np.zeros(0, dtype=U64)
    up, down = powers(len(buf) + 1)
    sums = np.empty(len(buf) + 1, dtype=U64)
    sums[0] = 0
    np.cumsum(_VALUES[buf] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def word_ranges(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``buf``."""
    edge = np.zeros(len(buf) + 2, dtype=np.int8)
    edge[1:-1] = ~SPACE[buf]
    change = np.diff(edge)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def chunks(sizes: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes together; a larger row is alone."""
    at = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


@cache
def _lower() -> bytes:
    return bytes(range(256)).lower()


_kept: dict[str, Callable[[], None]] = {}


def give_back() -> None:
    """Memory that is free by now goes back to the system, where its C library can do that."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def alone(name: str, clear: Callable[[], None] | None = None) -> None:
    """To be called where an operator's work begins in a Python worker: what others keep there (told by ``clear``) is let go,
    and so is memory that is free by now."""
    for other in [k for k in _kept if k != name]:
        _kept.pop(other)()
    give_back()
    if clear:
        _kept[name] = clear


class Texts:
    """Some texts (bytes), with a line feed between, and their words. lower: A-Z become a-z."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n".join(texts)
        self.data = joined.translate(_lower()) if lower else joined
        self.buf = np.frombuffer(self.data, dtype=np.uint8)
        self.sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        #: Place of each text in the buffer.
        self.at = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.starts, self.ends = word_ranges(self.buf)
        self.first = np.searchsorted(self.starts, self.at)
        #: Number of words of each text; ``first`` is its first word.
        self.counts = np.diff(np.append(self.first, len(self.starts)))

    def hashes(self) -> np.ndarray:
        return hash_ranges(self.buf, self.starts, self.ends)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each window of ``k`` words, in order: len(words) - k + 1 of them."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    h = np.zeros(n, dtype=U64)
    for i in range(k):
        h = (h + words[i:i + n]) * U64(0xFF51AFD7ED558CCD)
        h ^= h >> U64(29)
    return mix(h)
