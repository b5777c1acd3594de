"""A pair of Bloom filters that tell which hashes were seen at least twice.

Each task inserts its hashes: one that the once-filter already holds goes into
the twice-filter.  Filters of different tasks merge by
``twice |= other.twice | (once & other.once)`` and ``once |= other.once``, block
by block, in a streaming pass.  A hash that occurs twice is always reported; a
single one is reported with a probability that grows with the filter's load, so
users confirm suspects exactly.  The size in bits has a fixed upper bound
(``MAX_BITS``): beyond about a tenth of that many hashes more suspects are
false and more rows are shuffled, with the same results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 32 MB: what is sent to the driver and broadcast never exceeds this.
MAX_BITS = 1 << 28
_BLOCK_BITS = 1 << 16
_FLUSH = 1 << 18

_PIECES = "block int, once binary, twice binary"


def bits_for(n_hashes: int) -> int:
    """A power of two: 16 bits a hash within ``[2**19, MAX_BITS]``."""
    return min(MAX_BITS, max(_BLOCK_BITS, 1 << max(1, int(16 * n_hashes) - 1).bit_length()))


def positions(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each 64-bit hash."""
    h = hashes.view(np.uint64) if hashes.dtype == np.int64 else hashes.astype(np.uint64)
    mask = np.uint64(bits - 1)
    h = h * np.uint64(0x9FB21C651E98DF25)
    return (h >> np.uint64(3)) & mask, (h >> np.uint64(32)) & mask


def _test(filt: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (filt[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1


def _set(filt: np.ndarray, p: np.ndarray) -> None:
    np.bitwise_or.at(filt, p >> np.uint64(3), np.left_shift(1, p & np.uint64(7)).astype(np.uint8))


def contains(filt: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter may hold."""
    p, q = positions(hashes, len(filt) * 8)
    return (_test(filt, p) & _test(filt, q)).astype(bool)


def _insert(once: np.ndarray, twice: np.ndarray, hashes: np.ndarray) -> None:
    h, n = np.unique(hashes, return_counts=True)
    p, q = positions(h, len(once) * 8)
    again = (n > 1) | (_test(once, p) & _test(once, q)).astype(bool)
    for x in (p, q):
        _set(twice, x[again])
        _set(once, x)


def _packed(bits: np.ndarray) -> bytes:
    """A block's set bits: 2 bytes each while that is shorter than the block."""
    at = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
    return at.astype("<u2").tobytes() if 2 * len(at) < len(bits) else bits.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    if len(raw) == _BLOCK_BITS // 8:
        return np.frombuffer(raw, np.uint8)
    out = np.zeros(_BLOCK_BITS, np.uint8)
    out[np.frombuffer(raw, "<u2")] = 1
    return np.packbits(out, bitorder="little")


def _rows(once: np.ndarray, twice: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts, others = once.reshape(-1, _BLOCK_BITS // 8), twice.reshape(-1, _BLOCK_BITS // 8)
    full = np.flatnonzero(parts.any(axis=1))
    for some in np.array_split(full, max(1, len(full) // 256)):
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([_packed(parts[b]) for b in some], pa.binary()), pa.array([_packed(others[b]) for b in some], pa.binary())], ["block", "once", "twice"])


def pieces_of(hash_arrays: Iterator[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """One task's filters, as rows of blocks."""
    once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
    held, size = [], 0
    for h in hash_arrays:
        if not len(h):
            continue
        held.append(h)
        size += len(h)
        if size >= _FLUSH:
            _insert(once, twice, np.concatenate(held))
            held, size = [], 0
    if held:
        _insert(once, twice, np.concatenate(held))
    yield from _rows(once, twice)


def merged(pieces: DataFrame, bits: int, which: str = "twice") -> np.ndarray:
    """One of the filters over all tasks; at most ``MAX_BITS`` / 8 bytes reach the driver."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for b, o, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                once, twice = _unpacked(o), _unpacked(t)
                if b in held:
                    mine = held[b]
                    mine[1] = mine[1] | twice | (mine[0] & once)
                    mine[0] = mine[0] | once
                else:
                    held[b] = [once, twice]
        found = [(b, pair[which == "twice"]) for b, pair in held.items()]
        found = [(b, bits_of) for b, bits_of in found if bits_of.any()]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([_packed(x) for _, x in found], pa.binary())], ["block", "bits"])

    out = np.zeros(bits // 8, np.uint8)
    size = _BLOCK_BITS // 8
    for row in pieces.repartition("block").mapInArrow(merge, "block int, bits binary").collect():
        out[row.block * size : (row.block + 1) * size] = _unpacked(bytes(row.bits))
    return out


def twice_filter(df: DataFrame, hashes: Column, bits: int) -> np.ndarray:
    """The twice-filter of an ``array<bigint>`` column."""
    return _filter(df, hashes, bits, "twice")


def member_filter(df: DataFrame, hashes: Column, bits: int) -> np.ndarray:
    """A plain Bloom filter of an ``array<bigint>`` column."""
    return _filter(df, hashes, bits, "once")


def _filter(df: DataFrame, hashes: Column, bits: int, which: str) -> np.ndarray:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pieces_of((b.column(0).flatten().to_numpy(zero_copy_only=False) for b in batches), bits)

    return merged(df.select(hashes.alias("hashes")).mapInArrow(build, _PIECES), bits, which)


def twice_filter_of(df: DataFrame, names, bits: int, which: str = "twice") -> np.ndarray:
    """The twice-filter of what ``names(batch)`` yields for each Arrow batch of ``df``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pieces_of((h for b in batches for h in names(b)), bits)

    return merged(df.mapInArrow(build, _PIECES), bits, which)


def member_filter_of(df: DataFrame, names, bits: int) -> np.ndarray:
    """A plain Bloom filter of what ``names(batch)`` yields for each Arrow batch of ``df``."""
    return twice_filter_of(df, names, bits, "once")


def suspects(spark, filt: np.ndarray):
    """A column function: hash to flag, by a broadcast filter."""
    held = spark.sparkContext.broadcast(filt.tobytes())

    @F.arrow_udf("boolean")
    def flag(values: pa.Array) -> pa.Array:
        return pa.array(contains(np.frombuffer(held.value, np.uint8), values.to_numpy(zero_copy_only=False)))

    return flag


def suspect_flags(spark, filt: np.ndarray):
    """A column function: array of hashes to array of flags, by a broadcast filter."""
    held = spark.sparkContext.broadcast(filt.tobytes())

    @F.arrow_udf("array<boolean>")
    def flags(arrays: pa.Array) -> pa.Array:
        bits = np.frombuffer(held.value, np.uint8)
        values = arrays.flatten().to_numpy(zero_copy_only=False)
        found = contains(bits, values) if len(values) else np.zeros(0, bool)
        sizes = np.diff(arrays.offsets.to_numpy()) if len(arrays) else np.zeros(0, np.int64)
        offs = np.zeros(len(sizes) + 1, np.int32)
        np.cumsum(sizes, out=offs[1:])
        return pa.ListArray.from_arrays(pa.array(offs), pa.array(found))

    return flags
