"""Which keys occur more than once among very many, told in bitmaps of a bounded size.

Keys are hashes; 40 bits of each are packed by range, and one task counts a range in numpy. There are as many
ranges, and bits, as the number of keys asks for, up to 2^28 bits (32 MB). Two keys with the same bits are taken for
one: a false hit costs the caller time, and must not change its result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

U64 = np.uint64
KEY_BITS = 40
#: Keys in a range, about, and the most bits of a bitmap.
PER_PART, MOST_BITS = 1 << 21, 28

Batches = Iterable[pa.RecordBatch]
PACKED = "part int, keys binary"


def parts_for(keys: int) -> int:
    """Number of ranges, a power of two."""
    return 1 << max(3, (int(keys) // PER_PART).bit_length())


def bits_for(keys: int) -> int:
    """Bits (as a power of two) of a bitmap: one for each key or two, up to a bound."""
    return max(20, min(MOST_BITS, max(int(keys), 1).bit_length() - 1))


def packed(keys: np.ndarray, parts: int) -> tuple[np.ndarray, list[bytes]]:
    """The ranges that ``keys`` (64 bits) fall into, and their keys, five bytes each."""
    keys = np.sort(keys >> U64(64 - KEY_BITS))
    at = np.searchsorted(keys, np.arange(parts + 1, dtype=U64) * U64((1 << KEY_BITS) // parts))
    full = np.flatnonzero(np.diff(at))
    own = [keys[at[p]:at[p + 1]] for p in full]
    return full, [(k >> U64(8)).astype("<u4").tobytes() + k.astype(np.uint8).tobytes() for k in own]


def unpacked(blob: bytes) -> np.ndarray:
    n = len(blob) // 5
    return np.frombuffer(blob, "<u4", n).astype(U64) << U64(8) | np.frombuffer(blob, np.uint8, n, 4 * n)


def part_bits(keys: np.ndarray, part: int, parts: int, width: int) -> bytes:
    """The bitmap of a range; keys are of that range and as wide as they were packed."""
    out = np.zeros((1 << width) // parts, dtype=np.uint8)
    out[(keys >> U64(KEY_BITS - width)).astype(np.int64) - part * len(out)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def whole(rows: pa.Table, column: str, parts: int, width: int) -> bytes:
    """The bitmaps of all ranges (rows of part and ``column``) in one."""
    step = (1 << width) // parts // 8
    out = bytearray((1 << width) // 8)
    for part, bits in zip(rows.column("part").to_pylist(), rows.column(column).to_pylist()):
        out[part * step:(part + 1) * step] = bits
    return bytes(out)


def has(bitmap: np.ndarray, width: int, hashes: np.ndarray) -> np.ndarray:
    """1 for each hash whose bit is set."""
    at = (hashes >> U64(64 - width)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1


def packing(keys_of: Callable[[pa.RecordBatch], Iterable[np.ndarray]], parts: int, most: int = 1 << 21) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """Rows of PACKED of the keys that ``keys_of`` finds in batches."""

    def row(held: list[np.ndarray]) -> pa.RecordBatch:
        full, blobs = packed(np.concatenate(held), parts)
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "keys"])

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for keys in keys_of(batch):
                held.append(keys)
                size += len(keys)
                if size >= most:
                    yield row(held)
                    held, size = [], 0
        if size:
            yield row(held)

    return run


def twice(keys: DataFrame, parts: int, width: int) -> bytes:
    """The bitmap of the keys that occur twice at least in ``keys`` (PACKED)."""

    def count(batches: Batches) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(part, []).append(unpacked(blob))
        for part in sorted(held):
            own, n = np.unique(np.concatenate(held.pop(part)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([part_bits(own[n > 1], part, parts, width)], pa.binary())], names=["part", "bits"])

    return whole(keys.repartitionById(parts, "part").mapInArrow(count, "part int, bits binary").toArrow(), "bits", parts, width)
